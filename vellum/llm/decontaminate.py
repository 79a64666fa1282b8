"""Benchmark decontamination with training suffix arrays.

Every task sorts the suffixes of its shard's words (a batch of whole documents) and binary-searches
every test suffix in that order: the run of training suffixes that share its first ``window`` words
are the verbatim matches and their locations.  A match whose words before differ begins a longer one,
which is followed word by word to the right, within its item and document, to its full length.
Nothing is shuffled, and a document never leaves its task.

Only positions can match whose word occurs in the benchmark, so all others are dropped before the
sort; they still separate what stands on both sides.  The benchmark goes to the tasks in blocks of at
most ``block_words`` words (a proven bound; more words mean more passes, not more memory).

Defined cases: a null or empty text has no words and no hits; an item without words is never found;
an item shorter than a window is one window; repeated items each count; repeated documents are judged
alike; items without an id hit as others do and are one null at the end of ``items``, counted once in
``n_items``; an empty benchmark finds nothing; other columns are ignored by ``report``; the longest match is
of one item, and of equal ones the first in the document.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import LOWER_ALNUM, Scratch, Words, numbered, pieces, utf8

MATCH = "array<struct<at: int, length: int, item: string, item_at: int>>"
SCHEMA = f"doc_id long, n_words long, hit array<int>, items array<string>, matches {MATCH}"


class Tests:
    """The windows of one block of benchmark items, ready for search."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        words = Words([t for _, t in items], LOWER_ALNUM)
        self.vocabulary = np.unique(words.hash)
        codes = np.searchsorted(self.vocabulary, words.hash) + 1  # 0: no word of the benchmark
        found: dict[int, dict[bytes, set[str]]] = {}
        places: dict[int, dict[bytes, list[int]]] = {}
        self.names, self.first = [item for item, _ in items], words.first[:-1] + np.arange(1, len(items) + 1)
        #: The items' words one after another, a zero before and after each item.
        self.line = np.zeros(len(codes) + len(items) + 1, np.int32)
        for i, (item, _) in enumerate(items):
            own = codes[words.first[i] : words.first[i + 1]].astype(np.int32)
            self.line[self.first[i] : self.first[i] + len(own)] = own
            n = min(window, len(own))
            for at in range(len(own) - n + 1 if n else 0):
                key = own[at : at + n].tobytes()
                found.setdefault(n, {}).setdefault(key, set()).add(item)
                places.setdefault(n, {}).setdefault(key, []).append(int(self.first[i]) + at)
        #: By length: the distinct test windows as rows of word codes, and the items of each.
        self.by_length = {
            n: (np.array([np.frombuffer(k, np.int32) for k in w]), [list(v) for v in w.values()]) for n, w in found.items()
        }
        #: Of the same windows: their places in ``line``.
        self.places = {n: [np.array(v) for v in w.values()] for n, w in places.items()}
        first = self.vocabulary >> np.uint64(44)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[first] = True

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        good = self.vocabulary[at] == hashes[maybe]
        out[maybe[good]] = at[good] + 1
        return out


def suffix_order(codes: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in the order of their first ``depth`` words, as (starts, words).

    ``codes`` ends in ``depth`` zeros.  Prefix doubling: ranks of 2w words come from pairs of ranks of w.
    """
    rank, width = codes.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        pair = (rank << 32) | np.concatenate((rank[step:], np.zeros(step, np.int64)))
        _, rank = np.unique(pair, return_inverse=True)
        width += step
    order = starts[np.argsort(rank[starts], kind="stable")]
    return order, codes[order[:, None] + np.arange(depth)]


def search(order_words: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of word codes in ascending order: where each test row begins and ends among them."""
    big = order_words.astype(">i4").view(f"S{4 * order_words.shape[1]}").ravel()
    key = test.astype(">i4").view(f"S{4 * test.shape[1]}").ravel()
    return np.searchsorted(big, key, "left"), np.searchsorted(big, key, "right")


def follow(short: np.ndarray, line: np.ndarray, p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the matches that begin at ``p`` of a shard and ``q`` of the items, of ``n`` words at least."""
    length, alive = np.full(len(p), n), np.arange(len(p))
    while len(alive):
        a, b = short[p[alive] + length[alive]], line[q[alive] + length[alive]]
        alive = alive[(a == b) & (a != 0)]
        length[alive] += 1
    return length


def _shard(ids: list, texts: list[bytes], tests: Tests, window: int, places_too: bool = True):
    """Rows of SCHEMA for one shard; without ``places_too`` matches are not followed beyond their windows, nor paired with places of items."""
    words = Words(texts, LOWER_ALNUM)
    codes, first = tests.codes(words.hash), words.first
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    # Documents are set apart by a zero, and the shard ends in zeros.
    place = np.arange(len(codes)) + doc
    line = np.zeros(len(codes) + len(texts) + window, np.int32)
    line[place] = codes
    known = line != 0
    # ``line`` without what can't match: one zero stays between the runs of known words.
    stay = known.copy()
    stay[1:] |= known[:-1]
    stay[-window:] = True
    where = np.flatnonzero(stay)
    short = line[where]
    short = np.concatenate((short, np.zeros(window, np.int32)))
    back = np.full(len(line), -1, np.int64)
    back[place] = np.arange(len(codes))
    word_at = np.concatenate((back[where], np.full(window, -1, np.int64)))
    hit, items, followed = np.zeros(len(codes) + 1, np.int32), {}, {}
    matches = []
    run = np.zeros(len(short) + 1, np.int64)  # known words from here on
    zero = np.flatnonzero(short == 0)
    run[: len(short)] = zero[np.minimum(np.searchsorted(zero, np.arange(len(short))), len(zero) - 1)] - np.arange(len(short))
    for n, (test, owners) in tests.by_length.items():
        starts = np.flatnonzero(run[: len(short) - window] >= n)
        if not len(starts):
            continue
        order, rows = suffix_order(short, starts, n)
        lo, hi = search(rows, test)
        begin = []
        for w in np.flatnonzero(hi > lo):
            at = word_at[order[lo[w] : hi[w]]]
            matches.append((at, n))
            for d in np.unique(doc[at]):
                items.setdefault(int(d), set()).update(owners[w])
            if not places_too:
                continue
            places = tests.places[n][w]
            before, step = tests.line[places - 1], max(1, 1_000_000 // len(places))
            for x in range(lo[w], hi[w], step):
                p = order[x : min(x + step, hi[w])]
                # short[-1] is 0, as is what stands before an item
                i, j = np.nonzero((before == 0) | (before != short[p - 1][:, None]))
                if len(i):
                    begin.append((p[i], places[j]))
        if begin:
            p, q = (np.concatenate(x) for x in zip(*begin, strict=True))
            length, of = follow(short, tests.line, p, q, n), np.searchsorted(tests.first, q, "right") - 1
            for x, size, i, y in zip(word_at[p].tolist(), length.tolist(), of.tolist(), (q - tests.first[of]).tolist(), strict=True):
                d = int(doc[x])
                followed.setdefault(d, set()).add((x - int(first[d]), size, tests.names[i], y))
    for at, n in matches:
        np.add.at(hit, at, 1)
        np.add.at(hit, np.minimum(at + n, len(codes)), -1)
    covered = np.cumsum(hit[:-1]) > 0
    for d, key in enumerate(ids):
        a, b = first[d], first[d + 1]
        found = [dict(zip(("at", "length", "item", "item_at"), m, strict=True)) for m in sorted(followed.get(d, ()), key=str)]
        yield key, int(b - a), np.flatnonzero(covered[a:b]).tolist(), sorted(items.get(d, ()), key=lambda k: (k is None, k)), found


def _blocks(benchmark: DataFrame, block_words: int) -> int:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // (2 * block_words)))  # a word and its separator take two bytes at least


def _held(benchmark: DataFrame, window: int, blocks: int, block: int) -> Broadcast[Tests]:
    """One block of the benchmark, ready for search in every task."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = benchmark.select(F.col("item_id").cast("string").alias("item"), text.alias("text"))
    mine = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
    return benchmark.sparkSession.sparkContext.broadcast(Tests([(r["item"], r["text"].encode()) for r in mine.toLocalIterator()], window))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000, places_too: bool = True) -> DataFrame:
    """A row a document and block of the benchmark: doc_id, n_words, hit word positions, items found, longest matches with their places.

    Items that begin alike, as with a common instruction, give a match for each place of each of them;
    ``places_too=False`` leaves the matches empty, which is all that deciding on documents needs.
    """
    blocks = _blocks(benchmark, block_words)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("item", pa.string()), ("item_at", pa.int32())])))])
    scratch, names = Scratch(docs.sparkSession), []
    for b in range(blocks):
        tests = _held(benchmark, window, blocks, b)

        def run(batches, tests=tests):
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), utf8(batch.column("text"))
                for i, j in pieces(texts):
                    rows = list(_shard(ids[i:j], texts[i:j], tests.value, window, places_too))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
        if blocks == 1:
            return found
        # One block is held at a time: its matches are written, then the driver and the executors let it go.
        names.append(scratch.write(found, f"block{b}"))
        tests.destroy()
    return reduce(DataFrame.union, names)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000, places_too: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated, matches, longest, longest_at; a row per document.

    ``matches``: at and length in words, item and item_at, for each common run of words that neither side extends.
    """
    # Blocks see the same documents, whose rows meet by numbers of their own.
    marked = numbered(docs.select("doc_id", "text"), Scratch(docs.sparkSession)) if _blocks(benchmark, block_words) > 1 else None
    if marked is None:
        rows = matches(docs, benchmark, window, block_words, places_too)
    else:
        parts = matches(marked.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")), benchmark, window, block_words, places_too)
        joined = parts.groupBy("doc_id").agg(
            F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
        rows = joined.join(marked.select(F.col("_row").alias("doc_id"), F.col("_doc.doc_id").alias("_id")), "doc_id").select(
            F.col("_id").alias("doc_id"), "n_words", "hit", "items", "matches")
    rows = rows.withColumn("matches", F.array_sort("matches"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["length"].alias("length"), (-m["at"]).alias("before"))))
    return rows.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        (F.size("hit") > 0).alias("contaminated"),
        "matches", F.coalesce(best["length"], F.lit(0)).alias("longest"), (-best["before"]).alias("longest_at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """The documents without any hit, with all their columns; each row is judged by its own text, whatever its id.

    A block of the benchmark is one pass over the rows, in which those with hits are left out; what the blocks before
    the last leave is written, so that one block is held at a time.
    """
    blocks, scratch = _blocks(benchmark, block_words), Scratch(docs.sparkSession)
    for b in range(blocks):
        tests = _held(benchmark, window, blocks, b)

        def run(batches, tests=tests):
            for batch in batches:
                texts = utf8(batch.column("text"))
                clean = [not hit for i, j in pieces(texts) for _, _, hit, _, _ in _shard(list(range(i, j)), texts[i:j], tests.value, window, False)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if b < blocks - 1:
            docs = scratch.write(docs, f"left{b}")
            tests.destroy()
    return docs
