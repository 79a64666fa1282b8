"""Token-ID / binary output in Simple-8b word-aligned coding.

File format: a table of segments, one row each, in Parquet files that Spark writes to and reads from
any store.  ``shard`` and ``segment`` give the order, ``doc_ids`` and ``counts`` the documents, and
``payload`` the ids: little-endian 64-bit words after a header (magic, ids, blocks, words, escapes)
and a table of word offsets, one a block of 128 ids, so that all blocks decode at once.

A word holds a selector in its top four bits and ids in the other sixty (SELECTORS: ids a word and
bits an id).  Selector 0 escapes an id of more than sixty bits: the word's low bits number the raw
word in the escape list behind the others.

Documents are tokenised where they are read, dealt by doc_id ranges and sorted; a shard is a range.
Where the tokenizer drops white space and never joins words across it (``by_words`` reads that from its
file), a text's ids are its words' ids in turn, and words are encoded once a worker and then looked up
by 64 hash bits.  With any other tokenizer whole texts are encoded.

Defined cases: a null text is empty (only the end id); a null doc_id comes first; documents with one
doc_id keep the order of their ids' checksums; an empty table writes no segment.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import Words, pack_ints, pieces, shuffle_width, unpack_ints, utf8

MAGIC, BLOCK = 0x31423853, 128
#: Fixed values of the coding: selector, ids a word, bits an id.
SELECTORS = [
    (1, 120, 0), (2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7),
    (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60)]
_PER_WORD = np.ones(16, np.int64)
for _s, _n, _ in SELECTORS:
    _PER_WORD[_s] = _n


def encode(ids: np.ndarray) -> bytes:
    """Any number of 64-bit ids as a payload."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, lanes = len(ids), -(-len(ids) // BLOCK)
    grid = np.zeros(lanes * BLOCK, np.uint64)
    grid[:n] = ids
    size = np.full(lanes, BLOCK, np.int64)
    if lanes:
        size[-1] = n - (lanes - 1) * BLOCK
    wide = grid >= np.uint64(1 << 60)
    small = np.where(wide, np.uint64(0), grid)
    width = np.zeros(lanes * BLOCK, np.int8)
    width[:n] = np.ceil(np.log2(small[:n].astype(np.float64) + 1)).astype(np.int8)
    big = small >= np.uint64(1 << 52)  # beyond a float's exactness
    width[big] = [int(x).bit_length() for x in small[big]]
    width[wide] = 61
    width = width.reshape(lanes, BLOCK)
    rest = (size[:, None] - np.arange(BLOCK)).astype(np.int16)
    at = np.arange(BLOCK, dtype=np.int16)
    chosen = np.zeros((lanes, BLOCK), np.int8)
    for sel, per, bits in reversed(SELECTORS):  # the fullest word that fits is set last
        stop = np.where(width > bits, at, np.int16(BLOCK))
        stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1] - at
        chosen[stop >= np.minimum(rest, per)] = sel
    lane, pos = np.arange(lanes), np.zeros(lanes, np.int64)
    taken = []
    while len(lane):  # all blocks advance by a word
        sel = chosen[lane, pos]
        taken.append((lane, pos, sel))
        pos = pos + _PER_WORD[sel]
        more = pos < size[lane]
        lane, pos = lane[more], pos[more]
    if taken:
        lane, pos, sel = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(lane, kind="stable")
        lane, pos, sel = lane[order], pos[order], sel[order]
    else:
        lane, pos, sel = (np.empty(0, np.int64),) * 3
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((small, np.zeros(BLOCK, np.uint64)))
    for s, per, bits in SELECTORS:
        own = np.flatnonzero(sel == s)
        if len(own) and bits:
            base, room = lane[own] * BLOCK + pos[own], size[lane[own]] - pos[own]
            for j in range(per):
                words[own] |= np.where(j < room, padded[base + j], np.uint64(0)) << np.uint64(bits * j)
    escaped = np.flatnonzero(sel == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    raw = grid[lane[escaped] * BLOCK + pos[escaped]]
    offsets = np.searchsorted(lane, np.arange(lanes + 1)).astype("<u4")
    head = np.array([MAGIC, n, lanes, len(words), len(raw)], "<u4")
    return b"".join(x.tobytes() for x in (head, offsets, words.astype("<u8"), raw.astype("<u8")))


def decode(payload: bytes) -> np.ndarray:
    """The ids of a payload."""
    magic, n, lanes, n_words, n_raw = (int(x) for x in np.frombuffer(payload, "<u4", 5))
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    offsets = np.frombuffer(payload, "<u4", lanes + 1, 20).astype(np.int64)
    at = 20 + 4 * (lanes + 1)
    words, raw = np.frombuffer(payload, "<u8", n_words, at), np.frombuffer(payload, "<u8", n_raw, at + 8 * n_words)
    sel = (words >> np.uint64(60)).astype(np.int64)
    full = np.concatenate(([0], np.cumsum(_PER_WORD[sel])))
    block = np.repeat(np.arange(lanes), np.diff(offsets))
    first = block * BLOCK + full[:-1] - full[offsets[:-1]][block]
    out = np.zeros(n + BLOCK, np.uint64)
    for s, per, bits in SELECTORS:
        own = np.flatnonzero(sel == s)
        if len(own) and bits:
            room = np.minimum(BLOCK * (block[own] + 1), n) - first[own]
            for j in range(per):
                fits = j < room
                out[first[own][fits] + j] = (words[own][fits] >> np.uint64(bits * j)) & np.uint64((1 << bits) - 1)
    escaped = np.flatnonzero(sel == 0)
    out[first[escaped]] = raw[(words[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


RAW_SPACE = np.arange(256, dtype=np.uint8)
RAW_SPACE[9:14] = 32
_MOST = 2_000_000


def _tokenizer(model: str):
    """One thread each: Spark's tasks use all cores already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


def _encoded(tokenizer, words: list[str], line: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words in turn and how many each has; they are encoded as lines of words, and offsets tell whose an id is."""
    flat, size = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    lines = [words[i : i + line] for i in range(0, len(words), line)]
    for own, got in zip(lines, tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
        room = np.fromiter((len(w) + 1 for w in own), np.int64, len(own))
        start = np.cumsum(room) - room
        at = np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0]
        flat.append(np.array(got.ids, np.uint32))
        size.append(np.bincount(np.searchsorted(start, at, "right") - 1, minlength=len(own)))
    return np.concatenate(flat), np.concatenate(size)


class WordIds:
    """A tokenizer with the ids of the words met so far, as sorted arrays; emptied beyond ``_MOST`` words."""

    def __init__(self, model: str):
        self.tokenizer = _tokenizer(model)
        self.clear()

    def clear(self) -> None:
        self.hash, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hash) > _MOST:
            self.clear()
        flat, size = _encoded(self.tokenizer, words)
        at = len(self.flat) + np.cumsum(size) - size
        where = np.searchsorted(self.hash, hashes)
        self.hash, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.hash, hashes), (self.at, at), (self.size, size)))
        self.flat = np.concatenate((self.flat, flat))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        words = Words(texts, RAW_SPACE)
        unique, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, unique), max(len(self.hash) - 1, 0))
        new = self.hash[at] != unique if len(self.hash) else np.ones(len(unique), bool)
        if new.any():
            if len(self.hash) > _MOST:
                self.clear()
                new[:] = True
            data = words.data.tobytes()
            self.learn(unique[new], [data[words.start[i] : words.end[i]].decode("utf-8") for i in first[new]])
            at = np.searchsorted(self.hash, unique)
        size, begin = self.size[at][inverse], self.at[at][inverse]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))]
        edge = np.concatenate(([0], ends))[words.first]
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


class TextIds:
    """A tokenizer for whole texts."""

    def __init__(self, model: str):
        self.tokenizer = _tokenizer(model)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]


def _steps(part: dict | None, inner: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, which may be a sequence of them."""
    return [] if part is None else [x for p in part[inner] for x in _steps(p, inner)] if part["type"] == "Sequence" else [part]


def by_words(model: str) -> bool:
    """Whether the tokenizer is known to treat the words between white space one by one; a no costs time only."""
    parts = json.loads(model)
    for step in _steps(parts["normalizer"], "normalizers"):
        spaces = step["type"] == "Replace" and step["pattern"].get("Regex") in (r"\s", r"\s+") and step["content"] == " "
        if not spaces and step["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
            return False
    first = next(iter(_steps(parts["pre_tokenizer"], "pretokenizers")), {"type": None})
    if first["type"] == "Split":
        pattern = first["pattern"].get("Regex")
        if first["behavior"] != "Removed" or not first["invert"] or not pattern:
            return False
        tried = "a b\tc\nd\v1\f2\r' 's . ! \u00e9 \u4e00 _ - a"
        if any(c.isspace() for m in regex.findall(pattern, tried) for c in m) or regex.search(r"(?<!\[)\^|\$|\(\?[=!<]|\\[bBAZzG]", pattern):
            return False
    elif first["type"] not in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return False
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in parts["added_tokens"])


_WORKER: dict[int, WordIds | TextIds] = {}


def ids_of(model: str) -> WordIds | TextIds:
    """One for each Python worker, kept from task to task."""
    key = zlib.crc32(model.encode())
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = WordIds(model) if by_words(model) else TextIds(model)
    return _WORKER[key]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    """doc_id, part (its range), ids (packed), tie."""
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    cuts = np.array(bounds, np.int64)

    def run(batches):
        ids = ids_of(model.value)
        for batch in batches:
            keys, texts = batch.column("doc_id"), utf8(batch.column("text"))
            near = np.array([-1 if k is None else int(np.searchsorted(cuts, k, "left")) for k in keys.to_pylist()])
            for i, j in pieces(texts):
                rows = [np.append(x, np.uint32(end_id)) for x in ids(texts[i:j])]
                yield pa.RecordBatch.from_arrays([
                    keys[i:j].cast(pa.int64()), pa.array(np.maximum(near[i:j], 0).astype(np.int32)),
                    pa.array([pack_ints(x) for x in rows], pa.binary()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in rows], pa.int64())], names=["doc_id", "part", "ids", "tie"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, ids binary, tie long")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_ids: int = 1 << 18) -> None:
    """Writes the ids of all documents, each with the end id, in ascending doc_id order."""
    parts = shuffle_width(docs.sparkSession)
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / parts for i in range(1, parts)], 0.1 / parts)
    rows = tokenize(docs, tokenizer, end_id, sorted({int(c) for c in cuts}))
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "tie")

    def run(batches):
        keys, held, size, part, number = [], [], 0, 0, 0

        def segment():
            counts = [len(x) for x in held]
            payload = encode(np.concatenate(held))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([keys], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["shard", "segment", "doc_ids", "counts", "payload"])

        for batch in batches:
            for key, p, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                part = p
                keys.append(key)
                held.append(unpack_ints(ids))
                size += len(held[-1])
                if size >= segment_ids or len(held) >= 4096:
                    yield segment()
                    keys, held, size, number = [], [], 0, number + 1
        if held:
            yield segment()

    packed = rows.mapInArrow(run, "shard int, segment int, doc_ids array<long>, counts array<long>, payload binary")
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, segment, place (in the segment), ids: the documents as the files have them."""
    schema = "doc_id long, shard int, segment int, place int, ids array<long>"
    return _each(spark, path, schema, lambda ids: pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), "ids")


def _each(spark: SparkSession, path: str, schema: str, column, name: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["payload"])
                ends = np.cumsum(row["counts"])
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()),
                    pa.array(range(n), pa.int32()), column(np.split(ids, ends[:-1]))], names=["doc_id", "shard", "segment", "place", name])

    segments = spark.read.schema("shard int, segment int, doc_ids array<long>, counts array<long>, payload binary").parquet(path)
    return segments.mapInArrow(run, schema)


def index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def digest(ids: list[np.ndarray]) -> pa.Array:
        return pa.array([{"n": len(x), "crc": zlib.crc32(x.astype("<u4").tobytes())} for x in ids], pa.struct([("n", pa.int64()), ("crc", pa.int64())]))

    docs = _each(spark, path, "doc_id long, shard int, segment int, place int, d struct<n: long, crc: long>", digest, "d")
    segments = spark.read.parquet(path).select("shard", "segment", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # A row a shard, then within shards: no window holds all segments.
    shards = segments.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = segments.withColumn("before", before).join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("before")).alias("base"))
    within = F.coalesce(F.sum("d.n").over(Window.partitionBy("shard", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = docs.withColumn("within", within).join(starts, ["shard", "segment"])
    return rows.select("doc_id", (F.col("base") + F.col("within")).alias("start"), F.col("d.n").alias("n_tokens"), F.col("d.crc").alias("ids_crc32"))
