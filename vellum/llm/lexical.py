"""Ranked lexical search: an inverted index in windows of documents, scored window by window.

Index.  Documents are numbered where they are read, and a window is ``WINDOW`` of them in a row (fewer at
the end of a task's share, or where a window would hold more than ``MOST_POSTINGS`` postings).  A window is
a row: its terms (exact strings), and for each term its postings, the documents' places in the window and
their term frequencies.  So no text and no posting is shuffled to build it, and each window is bounded.

Search.  Questions are held by every task in blocks of ``MOST_BYTES``; document frequencies come from the
index for the terms asked for.  For each window and question, postings are traversed term by term and their
scores added into an array with a place for each document of the window (``WINDOW`` * 8 bytes, so that it
stays in the cache), while a bitset marks the places touched.  Only these are harvested into the
question's heap, and only these are cleared.  A task hands on its heaps; the best of tasks are merged in two
steps, first by groups of tasks.

Scores are 64-bit integers.  A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); a document's m is
75 + 25nN div L; a term gives w * (10^9 tf div (1000 tf + 12 m)), repeated terms of a question as often.

Defined cases: a null text has no terms; each row is a document, equal rows and equal ids included; of
equal scores the smaller doc_id is first, null last; each row of the questions is a question, those
without a term or a match have no answer; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import LOWER_ALNUM, Scratch, pieces, utf8

#: Documents of a window, and postings after which it is closed.
WINDOW, MOST_POSTINGS = 4096, 1 << 20
#: Bytes of questions that every task holds at a time.
MOST_BYTES = 32 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "docs long, tokens long, ids array<long>, lengths array<long>, terms array<string>, first array<int>, places binary, tfs binary"


def terms_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms in turn, and the text each is of."""
    data = LOWER_ALNUM[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = data == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    terms = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~space])])
    upto = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return terms, np.searchsorted(upto, start, side="right")


class _Window:
    def __init__(self):
        self.ids, self.lengths, self.parts, self.postings = [], [], [], 0

    def room(self) -> int:
        return 0 if self.postings >= MOST_POSTINGS else WINDOW - len(self.ids)

    def add(self, ids: list, texts: list[bytes]) -> None:
        terms, of = terms_of(texts)
        coded = terms.dictionary_encode()
        n = max(1, len(coded.dictionary))
        pair, tf = np.unique(of * n + coded.indices.to_numpy(), return_counts=True)
        self.parts.append((coded.dictionary, pair // n + len(self.ids), pair % n, tf))
        self.ids += ids
        self.lengths.append(np.bincount(of, minlength=len(texts)))
        self.postings += len(pair)

    def row(self) -> pa.RecordBatch:
        known = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        code, at, codes = known.indices.to_numpy(), 0, []
        for terms, _, own, _ in self.parts:
            codes.append(code[at : at + len(terms)][own])
            at += len(terms)
        codes = np.concatenate(codes)
        order = np.argsort(codes, kind="stable")  # places ascend within a term
        first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(known.dictionary)))))
        places, tfs = (np.concatenate([p[i] for p in self.parts])[order] for i in (1, 3))
        n = np.concatenate(self.lengths)
        return pa.RecordBatch.from_arrays([
            pa.array([len(n)]), pa.array([int(n.sum())]), pa.array([self.ids], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64())),
            pa.ListArray.from_arrays(pa.array([0, len(known.dictionary)], pa.int32()), known.dictionary.cast(pa.string())),
            pa.array([first.tolist()], pa.list_(pa.int32())), pa.array([places.astype("<u2").tobytes()], pa.binary()),
            pa.array([tfs.astype("<u4").tobytes()], pa.binary())], names=["docs", "tokens", "ids", "lengths", "terms", "first", "places", "tfs"])


def index(docs: DataFrame) -> DataFrame:
    """The windows of ``docs`` (doc_id, text), a row each."""

    def run(batches):
        window = _Window()
        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()).to_pylist(), utf8(batch.column("text"))
            for i, j in pieces(texts):
                while i < j:
                    if not window.room():
                        yield window.row()
                        window = _Window()
                    k = min(j, i + window.room())
                    window.add(ids[i:k], texts[i:k])
                    i = k
        if window.ids:
            yield window.row()

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


def questions(items: DataFrame) -> DataFrame:
    """_q (a row's number), item_id, terms: its distinct terms with their repeats."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = items.select(F.monotonically_increasing_id().alias("_q"), "item_id", F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("t"))
    counted = F.transform(F.array_sort(F.array_distinct("t")), lambda t: F.struct(t.alias("term"), F.size(F.filter("t", lambda x: x == t)).alias("k")))
    return rows.select("_q", "item_id", counted.alias("terms")).where("size(terms) > 0")


def _document_frequencies(windows: DataFrame, terms: pa.Array) -> np.ndarray:
    """For each of some terms, how many documents hold it."""
    held = windows.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for own, first in zip(batch.column("terms"), batch.column("first"), strict=True):
                place = pc.index_in(held.value, value_set=own.values.cast(pa.large_string())).fill_null(-1).to_numpy()
                size = np.diff(first.values.to_numpy())
                total[place >= 0] += size[place[place >= 0]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in windows.select("terms", "first").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def lengths_term(n: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    """m of documents of ``n`` terms."""
    if len(n) and int(n.max()) * 25 * docs >= 1 << 63:
        return np.array([75 + 25 * x * docs // tokens for x in n.tolist()], np.int64)
    return 75 + 25 * n * docs // max(1, tokens)


def _scored(window: dict, m: np.ndarray, terms: pa.Array, asked: list, heaps: list, k: int) -> None:
    """Scores one window for all questions; ``asked``: for each its term numbers and weights."""
    place = pc.index_in(terms, value_set=window["terms"].values.cast(pa.large_string())).fill_null(-1).to_numpy()
    first, ids = window["first"].values.to_numpy(), window["ids"].values
    known, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    places, tfs = np.frombuffer(window["places"].as_py(), "<u2"), np.frombuffer(window["tfs"].as_py(), "<u4")
    total, held, size = np.zeros(WINDOW, np.int64), {}, 0

    def opened(t: int):
        """A term's places, what it adds there, and the bits of these places."""
        at = slice(first[place[t]], first[place[t] + 1])
        own, tf = places[at], tfs[at].astype(np.int64)
        mark = np.zeros(WINDOW, bool)
        mark[own] = True
        return own, 1_000_000_000 * tf // (1000 * tf + 12 * m[own]), np.packbits(mark)

    for q, (numbers, weights) in enumerate(asked):
        touched = np.zeros(WINDOW // 8, np.uint8)
        for t, w in zip(numbers, weights, strict=True):
            if place[t] >= 0:
                if t not in held:
                    if size > MOST_POSTINGS * 4:
                        held, size = {}, 0
                    held[t] = opened(t)
                    size += len(held[t][0]) + 64
                own, gain, bits = held[t]
                total[own] += w * gain
                touched |= bits
        at = np.flatnonzero(np.unpackbits(touched))
        if len(at):
            score = total[at]
            total[at] = 0
            heap = heaps[q]
            least = heap[0][0] if len(heap) == k else 1
            if len(at) > k:
                least = max(least, int(np.partition(score, len(at) - k)[len(at) - k]))
            keep = score >= max(least, 1)
            for s, x in zip(score[keep].tolist(), at[keep].tolist(), strict=True):
                entry = (s, bool(known[x]), -int(number[x]))  # the worst first: the lowest score, then no id, then the largest id
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


def search(windows: DataFrame, asked: DataFrame, k: int = 20, most: int = MOST_BYTES) -> DataFrame:
    """_q, item_id, rank, doc_id, score: the ``k`` best documents of each question with a score above 0.

    ``windows`` and ``asked`` are as ``index`` and ``questions`` give them, written once.
    """
    spark = windows.sparkSession
    every = windows.agg(F.sum(F.size(F.filter("lengths", lambda x: x > 0))).alias("n"), F.sum("tokens").alias("l")).first()
    docs, tokens = every["n"] or 0, every["l"] or 0
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t["term"]) + 64)
    blocks = max(1, -(-int(asked.agg(F.sum(size)).first()[0] or 0) // most))
    found = []
    for b in range(blocks):
        some = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b)).toArrow()
        if not some.num_rows:
            continue
        lists = some.column("terms").combine_chunks()
        coded = lists.flatten().field("term").cast(pa.large_string()).dictionary_encode()
        df = _document_frequencies(windows, coded.dictionary)
        w = np.array([weight(docs, int(x)) for x in df], np.int64)[coded.indices.to_numpy()] * lists.flatten().field("k").to_numpy().astype(np.int64)
        cuts = np.cumsum(lists.value_lengths().to_numpy())[:-1]
        own = [(x.tolist(), y.tolist()) for x, y in zip(np.split(coded.indices.to_numpy(), cuts), np.split(w, cuts), strict=True)]
        held = spark.sparkContext.broadcast((coded.dictionary, own, some.column("_q").to_pylist()))

        def run(batches, held=held):
            terms, asked_, numbers = held.value
            heaps = [[] for _ in asked_]
            for batch in batches:
                for i in range(batch.num_rows):
                    window = {c: batch.column(c)[i] for c in batch.schema.names}
                    _scored(window, lengths_term(window["lengths"].values.to_numpy(), docs, tokens), terms, asked_, heaps, k)
            rows = [(q, -d if known else None, s) for q, heap in zip(numbers, heaps, strict=True) for s, known, d in heap]
            q, d, s = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], names=["_q", "doc_id", "score"])

        found.append(windows.select("ids", "lengths", "terms", "first", "places", "tfs").mapInArrow(run, "_q long, doc_id long, score long"))
    if not found:
        return asked.select("_q", "item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = reduce(DataFrame.unionByName, found).withColumn("_group", F.spark_partition_id() % 64)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (["_q", "_group"], ["_q"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return best.join(asked.select("_q", "item_id"), "_q").select("_q", "item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents; index and questions are written for this call."""
    scratch = Scratch(docs.sparkSession)
    windows = scratch.write(index(docs), "windows", group_mb=32)
    return search(windows, scratch.write(questions(items), "questions"), k).drop("_q")
