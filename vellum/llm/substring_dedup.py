"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that also starts in a document with a smaller id.

Where to look: every string of LENGTH bytes has an anchor, its 12-byte gram of the smallest hash, so
equal strings have equal anchors at equal places.  The strings of one anchor occurrence are
consecutive; together they are its context.  Equal strings also share the anchor with the 19 bytes
before it, or with the 19 after it; only occurrences with one of these in two documents are kept.  A
side that none of an occurrence's strings holds as a whole doesn't count.

Copies: of rows with one whole text only those of the smallest id are looked at; the others lose all of a
text of LENGTH bytes or more, and no smaller id of a string is lost without them.

What is equal: contexts equal as a whole are settled by counting (the smallest id of each distinct
context).  Where an anchor has several distinct contexts, a Burrows-Wheeler transform of these
contexts is extended backward, breadth first: all intervals of common prefixes grow by one byte a
level, intervals of one suffix end, and the expansion stops at LENGTH.  What is left are the strings
that two contexts share, each with its smallest id.  Contexts were reduced to distinct ones before,
so a passage that a third of all documents have is one context an anchor; anchors with more than
``hot`` distinct contexts (the ends of such a passage) are counted string by string instead, by a
pre-aggregated group on the string itself.

The bytes of a context are fetched for its first occurrence only, and only documents that lose bytes
are joined with their cuts; both by bounded bitmaps that may let others through, never the reverse.
A row that the bitmap of first texts doesn't hold is a copy for certain; a copy it lets through is
treated like any other text, with the same result.

Keys: a context is known by 64 hash bits of its own and 32 of its anchor.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; repeated rows and equal
doc_ids never remove each other's bytes; a null doc_id counts as larger than any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import MULT, Scratch, mix, pieces, shuffle_width, signed, utf8
from vellum.llm.hashbits import Shared, bitmap_bytes, shared

LENGTH, GRAM = 50, 12
SIDE = (LENGTH - GRAM + 1) // 2  # one side of the anchor has as many bytes of the string
SPAN = LENGTH - GRAM + 1  # grams in a string; at most as many strings have one anchor occurrence


class Anchors:
    """Anchor occurrences in some texts: arrays ``doc``, ``lo`` and ``hi`` (first and last string), ``anchor``."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"".join(texts) + bytes(64)
        n = len(self.buffer) - 64
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(size) - size
        if n < LENGTH:
            self.doc = self.lo = self.hi = np.empty(0, np.int64)
            self.anchor, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        word = np.empty(n + 56, np.uint64)  # the eight bytes from each place on
        for j in range(8):
            part = word[j::8]
            part[:] = np.frombuffer(self.buffer, "<u8", len(part), j)
        self.word = word
        gram = mix((word[:n] * MULT[2]) ^ (word[GRAM - 8 : n + GRAM - 8] * MULT[3]))
        low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: n - LENGTH + 1], low[SPAN - width :][: n - LENGTH + 1])
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 1, np.int8)
        long = size >= LENGTH
        np.add.at(inside, self.begin[long], 1)
        np.add.at(inside, (self.begin + size)[long] - LENGTH + 1, -1)
        inside = np.cumsum(inside[: n - LENGTH + 1]) > 0
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        real = inside[first]
        self.lo, self.hi = first[real], last[real]
        self.at = at[self.lo]
        self.anchor = gram[self.at]
        self.doc = np.searchsorted(self.begin, self.lo, "right") - 1

    def keep(self, mask: np.ndarray) -> None:
        for name in ("doc", "lo", "hi", "anchor", "at"):
            setattr(self, name, getattr(self, name)[mask])

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each anchor with the SIDE bytes before it, and with those after it; worth looking at only where ``reach`` holds."""
        out = []
        for k, places in enumerate(((-SIDE, 8 - SIDE, 16 - SIDE, GRAM - 8), (0, 8, 16, GRAM + SIDE - 8))):
            h = np.full(len(self.at), k + 1, np.uint64)
            for j, off in enumerate(places):
                h = (h ^ self.word[np.maximum(self.at + off, 0)]) * MULT[(j + 2 * k) % 8]
                h ^= h >> np.uint64(32)
            out.append(mix(h))
        return out[0], out[1]

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether any of an occurrence's strings holds the whole side before the anchor, and whether any holds that after it."""
        return self.lo <= self.at - SIDE, self.hi >= self.at - SIDE

    def distinct(self) -> np.ndarray:
        """Hashes of sides, each once a document."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        held = np.concatenate(self.reach())
        keys, doc = np.concatenate(self.sides())[held], np.concatenate((self.doc, self.doc))[held]
        order = np.lexsort((doc, keys))
        a, d = keys[order], doc[order]
        return a[np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])))]

    def contexts(self) -> np.ndarray:
        """A hash of each occurrence's context, by its first and last string, which cover it."""

        def string(at, k):
            h = np.zeros(len(at), np.uint64)
            for j, off in enumerate((0, 8, 16, 24, 32, 40, 42)):
                h = (h ^ self.word[at + off]) * MULT[(j + k) % 8]
                h ^= h >> np.uint64(32)
            return h

        return mix(string(self.lo, 0) * MULT[1] + string(self.hi, 3) * MULT[4] + (self.hi - self.lo).astype(np.uint64) * MULT[5])


def _found(texts: list[bytes], bits: Shared | None = None):
    for i, j in pieces(texts, 1 << 17):  # some twenty arrays of eight bytes for each byte of these
        found = Anchors(texts[i:j])
        if bits is not None and len(found.lo):
            (left, right), (before, after) = found.sides(), found.reach()
            before[before] = bits.maybe(left[before])
            after[after] = bits.maybe(right[after])
            found.keep(before | after)
        yield i, found


def _key(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for j, c in enumerate(columns):
        h = (h ^ c.astype(np.int64).view(np.uint64)) * MULT[j]
        h ^= h >> np.uint64(32)
    return mix(h)


def _short(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bwt_shared(contexts: list[bytes], least: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context the smallest ``least`` of the contexts that have its string of ``length`` at 0, 1, ...

    Backward extension, breadth first: an interval of the suffix array holds the suffixes with one
    common prefix; the transform's byte before each suffix splits it into those of the prefixes one
    byte longer, and the LF mapping gives their places.
    """
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    text = np.zeros(int(size.sum()) + len(contexts) + 1, np.int64)
    begin = np.cumsum(size + 1) - size  # a separator stands before each context
    owner = np.repeat(np.arange(len(contexts)), size)
    place = np.arange(int(size.sum())) + owner + 1
    text[place] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
    n = len(text)
    # Seven symbols of nine bits are sorted at once, then ranks of twice as many symbols from pairs of ranks.
    pair, width = np.zeros(n, np.int64), 7
    for j in range(7):
        pair[: max(n - j, 0)] |= text[j:] << (9 * (6 - j))
    while True:
        order = np.argsort(pair)
        step = np.concatenate(([0], (np.diff(pair[order]) != 0).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if width >= length:  # the order of more bytes than that never matters
            break
        pair = rank * (n + 1) + np.concatenate((rank[width:], np.zeros(min(width, n), np.int64)))[:n]
        width *= 2
    suffixes = order
    where = np.empty(n, np.int32)
    where[suffixes] = np.arange(n, dtype=np.int32)
    before = text[suffixes - 1].astype(np.uint16)  # the transform; 0 separates contexts
    to = where[suffixes - 1]  # the LF mapping
    alive, group = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    for _ in range(length):
        byte = before[alive]
        own = byte > 0
        alive, group, byte = alive[own], group[own], byte[own]
        if not len(alive):
            break
        order = np.argsort(byte, kind="stable")
        group, byte = group[order], byte[order]
        new = np.ones(len(order) + 1, bool)  # where an interval begins, and behind the last
        new[1:-1] = (byte[1:] != byte[:-1]) | (group[1:] != group[:-1])
        several = ~(new[1:] & new[:-1])
        alive, group = to[alive[order[several]]], np.cumsum(new[:-1], dtype=np.int32)[several]
    out = [np.full(max(s - length + 1, 0), v) for s, v in zip(size.tolist(), least.tolist(), strict=True)]
    if len(alive):
        starts = suffixes[alive]
        whose = np.searchsorted(begin, starts, "right") - 1
        new = np.concatenate(([True], group[1:] != group[:-1]))
        low = np.minimum.reduceat(least[whose], np.flatnonzero(new))[np.cumsum(new) - 1]
        for c, at, v in zip(whose.tolist(), (starts - begin[whose]).tolist(), low.tolist(), strict=True):
            out[c][at] = v
    return out


MASKS = "anchor int, ctx long, m long, mask long"


def _masks(batches, most: int):
    """MASKS for rows (m, anchor, ctx, context) sorted by anchor, ctx and m: strings that a smaller id has too."""

    def settle(rows):
        anchor, ctx, m, context = (list(x) for x in zip(*rows, strict=True))
        least = np.array(m, np.int64)
        got = bwt_shared(context, least)
        mask = [int(((v < own).astype(np.uint64) << np.arange(len(v), dtype=np.uint64)).sum()) for v, own in zip(got, m, strict=True)]
        keep = [i for i, x in enumerate(mask) if x]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], t) for x, t in ((anchor, pa.int32()), (ctx, pa.int64()), (m, pa.int64()), (mask, pa.int64()))], names=["anchor", "ctx", "m", "mask"])

    held, size, last = [], 0, (None, None)
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("anchor", "ctx", "m", "context")), strict=True):
            if row[:2] == last:  # the same context again, of a later document
                continue
            if size > most and row[0] != last[0]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[3]), row[:2]
    if held:
        yield settle(held)


def _row_key(batch: pa.RecordBatch) -> np.ndarray:
    return _key(batch.column("doc_id").to_numpy(), batch.column("_hash").to_numpy())


def _listed(table: DataFrame, columns: list[str]) -> Shared:
    """A bitmap of the rows of a written table, by its size: others that it lets through are few."""
    def keys(batch):
        return [np.unique(_key(*(batch.column(c).to_numpy() for c in columns)))]

    return shared(table.select(*columns), keys, count=2, size=bitmap_bytes(table.count()), marks=2)


def first_texts(rows: DataFrame) -> Shared:
    """A bitmap of the rows that no row with the same text and a smaller id goes before."""
    scratch = Scratch(rows.sparkSession)
    firsts = rows.groupBy(F.unhex(F.sha2("text", 256)).alias("_digest")).agg(F.min("doc_id").alias("doc_id"), F.min("_hash").alias("_hash"))
    out = _listed(scratch.write(firsts.select("doc_id", "_hash"), "firsts"), ["doc_id", "_hash"])
    scratch.drop("firsts")
    return out


def spans(docs: DataFrame, hot: int = 4000) -> DataFrame:
    """doc_id, _hash (of the text), cuts: array of (lo, mask), the strings to remove; only documents with some that are no copies as a whole."""
    rows = keyed(docs)
    return _spans(rows, docs.sparkSession.sparkContext.broadcast(first_texts(rows)), hot)


def _spans(rows: DataFrame, firsts: Broadcast[Shared], hot: int) -> DataFrame:
    spark = rows.sparkSession
    scratch = Scratch(spark)

    def originals(batches):
        for batch in batches:
            yield batch.filter(pa.array(firsts.value.maybe(_row_key(batch))))

    def sides(batch):
        for part in originals([batch]):
            yield from (f.distinct() for _, f in _found(utf8(part.column("text"))))

    bits = shared(rows.select("doc_id", "_hash", "text"), sides, marks=2)
    held = spark.sparkContext.broadcast(bits)

    def occurrences(batches):
        for batch in originals(batches):
            texts, ids, hashes = utf8(batch.column("text")), batch.column("doc_id"), batch.column("_hash")
            for i, f in _found(texts, held.value):
                if len(f.lo):
                    doc = pa.array(f.doc + i)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(doc), hashes.take(doc), pa.array((f.lo - f.begin[f.doc]).astype(np.int32)), pa.array((f.hi - f.lo + 1).astype(np.int32)),
                        pa.array(_short(f.anchor)), pa.array(signed(f.contexts()))], names=["doc_id", "_hash", "lo", "n", "anchor", "ctx"])

    found = scratch.write(rows.mapInArrow(occurrences, "doc_id long, _hash long, lo int, n int, anchor int, ctx long"), "found")
    distinct = scratch.write(found.groupBy("anchor", "ctx").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("last")), "distinct")
    several = distinct.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("m").alias("a"), F.max("last").alias("z"))
    several = several.where("contexts > 1 and a < z").select("anchor", "contexts")
    unclear = scratch.write(distinct.join(several, "anchor").select("anchor", "ctx", "m", "contexts"), "unclear")

    def fetch(part: DataFrame) -> DataFrame:
        """m, anchor, ctx, context for the rows of ``part``; the bitmap may let a few others through."""
        wanted = spark.sparkContext.broadcast(_listed(part, ["anchor", "ctx", "m"]))

        def texts_of(batches):
            near, first = held.value, wanted.value
            for batch in originals(batches):
                texts, ids = utf8(batch.column("text")), batch.column("doc_id").to_numpy()
                for i, f in _found(texts, near):
                    f.keep(first.maybe(_key(_short(f.anchor), signed(f.contexts()), ids[f.doc + i]))) if len(f.lo) else None
                    if len(f.lo):
                        context = [f.buffer[a : b + LENGTH] for a, b in zip(f.lo.tolist(), f.hi.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids[f.doc + i]), pa.array(_short(f.anchor)), pa.array(signed(f.contexts())), pa.array(context, pa.binary())],
                            names=["m", "anchor", "ctx", "context"])

        return rows.mapInArrow(texts_of, "m long, anchor int, ctx long, context binary")

    usual = fetch(unclear.where(F.col("contexts") <= hot)).repartition(shuffle_width(spark), "anchor").sortWithinPartitions("anchor", "ctx", "m")
    masks = usual.mapInArrow(lambda batches: _masks(batches, 1 << 16), MASKS)
    many = unclear.where(F.col("contexts") > hot).drop("contexts")
    if not many.isEmpty():
        keys = ["anchor", "ctx", "m"]
        strings = fetch(many).dropDuplicates(keys).join(many, keys).select(
            *keys, "context", F.explode(F.sequence(F.lit(0), F.octet_length("context") - LENGTH)).alias("at"))
        strings = scratch.write(strings.withColumn("string", F.md5(F.substring("context", F.col("at") + 1, F.lit(LENGTH)))).drop("context"), "strings")
        low = strings.groupBy("string").agg(F.min("m").alias("low"))
        masks = masks.union(strings.join(low, "string").where("low < m").groupBy(*keys).agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask")))
    # A context of another first document came through a bitmap by chance; one let through beside its hot anchor is merged.
    masks = scratch.write(masks.groupBy("anchor", "ctx", "m").agg(F.bit_or("mask").alias("mask")), "masks")
    scratch.drop("unclear")
    decided = distinct.join(masks, ["anchor", "ctx", "m"], "left").where("m < last or mask is not null")
    decided = scratch.write(decided.select("anchor", "ctx", "m", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")), "decided")
    scratch.drop("distinct", "masks")
    held.destroy()
    cut = found.join(decided, ["anchor", "ctx"]).withColumn(
        "mask", F.when(F.col("doc_id") > F.col("m"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("mask"))).where("mask <> 0")
    cuts = scratch.write(cut.groupBy("doc_id", "_hash").agg(F.collect_set(F.struct("lo", "mask")).alias("cuts")), "cuts", group_mb=32)
    scratch.drop("found", "decided")
    return cuts


def keyed(docs: DataFrame) -> DataFrame:
    """text with doc_id (null as the largest) and 64 bits of the text's hash: rows without an id are told apart by these, repeated rows are one."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), "text", F.xxhash64("text").alias("_hash"), F.col("doc_id").cast("long").alias("_id"))


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def dedup(docs: DataFrame, hot: int = 4000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, binary), kept_sha256; a row per document."""
    rows = keyed(docs)
    firsts = docs.sparkSession.sparkContext.broadcast(first_texts(rows))
    cuts = _spans(rows, firsts, hot)
    held = docs.sparkSession.sparkContext.broadcast(_listed(cuts, ["doc_id", "_hash"]))
    bit = np.arange(SPAN, dtype=np.int64)

    def finished(ids, texts: list[bytes], places: list[np.ndarray | None], copies: bool = False) -> pa.RecordBatch:
        out = []
        for text, start in zip(texts, places, strict=True):
            removed = runs = 0
            kept = text
            if copies and len(text) >= LENGTH:
                removed, runs, kept = len(text), 1, b""
            elif start is not None:
                upto = np.cumsum(start)[: len(text)]
                gone = upto - np.concatenate((np.zeros(LENGTH, np.int64), upto))[: len(text)] > 0
                removed = int(gone.sum())
                runs = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((len(text), removed, runs, kept, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))],
                                          names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    def maybe(batch):
        """Which rows may be first texts, and which of these may lose bytes."""
        key = _row_key(batch)
        first = firsts.value.maybe(key)
        return first, first & held.value.maybe(key)

    def whole(batches):
        for batch in batches:
            first, cut = maybe(batch)
            for mask, copies in ((~first, True), (first & ~cut, False)):
                rest = batch.filter(pa.array(mask))
                if len(rest):
                    yield finished(rest.column("_id"), utf8(rest.column("text")), [None] * len(rest), copies)

    def to_join(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe(batch)[1]))

    def cut(batches):
        for batch in batches:
            texts, lists = utf8(batch.column("text")), batch.column("cuts")
            flat = lists.flatten()
            lo, mask = flat.field("lo").to_numpy(), flat.field("mask").to_numpy()
            edge = np.concatenate(([0], np.cumsum([n or 0 for n in lists.value_lengths().to_pylist()])))
            places = []
            for text, a, b in zip(texts, edge[:-1], edge[1:], strict=True):
                start = None
                if b > a:
                    start = np.zeros(len(text) + 1, np.int64)
                    start[(lo[a:b, None] + bit)[(mask[a:b, None] >> bit) & 1 == 1]] = 1
                places.append(start)
            if texts:
                yield finished(batch.column("_id"), texts, places)

    some = rows.mapInArrow(to_join, rows.schema).join(cuts, ["doc_id", "_hash"], "left").select("_id", "text", "cuts")
    return rows.mapInArrow(whole, KEPT).union(some.mapInArrow(cut, KEPT))
