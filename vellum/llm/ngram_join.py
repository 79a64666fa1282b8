"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

Sets: distinct word shingles, 64 hash bits each (48 where two sets are verified against each other);
documents with equal sets are one class from here on.  Token order: rarest first by exact document counts of the whole corpus (``hashbits``: alone,
shared, or the count of one of the most frequent shingles), then by hash.

Prefixes: two sets with similarity t overlap in alpha = ceil(t * size) tokens at least, so for any l
their first size - alpha + l tokens share l.  Each document takes the l of least estimated cost:
postings read plus candidates to verify, of which at most postings / l can share l tokens.  A pair is
held to the smaller l of its two documents.  Tokens that only one document has find nobody and aren't
sent.

Components grow in three rounds; only classes still apart are ever compared, and links are verified
on the full sets before they join anything:

1. Near copies nearly always share one of ``HEADS`` smallest hashes.  Each such group hands on a
   spanning forest of its candidates.  Large groups of near copies are one component after it.
2. Tokens of the prefixes whose classes are in several components: a spanning forest over components,
   one edge (the nearest two sketches) for each pair that it joins.
3. Tokens with an edge that verification refused: every remaining pair across components, named at
   its first shared prefix token only.

Candidates are compared by size, shared prefix tokens (rounds 2 and 3) and a 512-bit parity sketch,
whose distance never exceeds the sets' true one; none of these loses a pair.  A round-2 forest spans
all of a token's candidates, so a token whose edges all hold has nothing left to find.  A token of more
than ``block`` classes is dealt in blocks: its largest component's blocks meet those of the others only.

``class_links`` counts, for a document's class, the other classes whose similarity with it is t at
least, each once.  Linked classes are in one component, so every pair of classes of a component (of
sizes that allow a link) is verified on the full sets, in pairs of blocks of bounded numbers of classes
and elements; only the counts leave a task.  That work grows with the square of a component, as
the number of links does; ``one_of_each`` doesn't need it.

Defined cases: documents without words have no shingles and link with nothing; with fewer words than
``k``, the whole sequence is the one shingle; null is empty; repeated rows are one class; a null
doc_id is a row of its own component null unless linked; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import LOWER_SPACE, MULT, Scratch, Words, mix, numbered, pack_sorted, pieces, shuffle_width, signed, unpack_sorted, utf8
from vellum.llm.components import components
from vellum.llm.hashbits import Shared, bitmap_bytes, shared

SKETCH, HEADS = 512, 3
#: Longest l to consider, and what verifying a pair costs beside reading a posting: a fixed part and a part of its elements.
MOST_L, VERIFY, VERIFY_PART = 64, 8, 1 / 16
#: A prefix with more tokens than that is sent without the list of them, so l stays 1.
MOST_LISTED = 256
#: Classes and elements of one block of a component, where links are counted.
COUNT_CLASSES, COUNT_ELEMENTS = 1024, 1 << 20


def shingle_sets(texts: list[bytes], k: int):
    """Each text's distinct shingle hashes, ascending."""
    for i, j in pieces(texts):
        words = Words(texts[i:j], LOWER_SPACE)
        h, n = words.hash, len(words.hash)
        all_of = np.zeros(max(n - k + 1, 0), np.uint64)
        for x in range(k):
            all_of = (all_of ^ h[x : n - k + 1 + x]) * MULT[x % 8] + MULT[(x + 3) % 8] if n >= k else all_of
            all_of ^= all_of >> np.uint64(32)
        all_of = mix(all_of)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(all_of[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:  # the sequence as one, apart from any full shingle
                yield np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "<u8")
            else:
                yield np.empty(0, np.uint64)


def prefix(tokens: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[int, np.ndarray, int]:
    """l, the prefix tokens that others have in token order, and how many of them the prefix for l = 1 has."""
    n = len(tokens)
    alpha = -(-num * n // den)
    order = np.lexsort((tokens, counts))
    most = min(MOST_L, alpha, max(1, MOST_LISTED - (n - alpha)))
    head = counts[order[: n - alpha + most]]
    postings = np.cumsum(np.where(head > 1, head - 1, 0))[n - alpha :]
    l = np.arange(1, most + 1)
    best = int(l[np.argmin(postings * (1 + (VERIFY + n * VERIFY_PART) / l))])
    sent = np.flatnonzero(head[: n - alpha + best] > 1)
    return best, tokens[order[sent]], int(np.searchsorted(sent, n - alpha + 1))


def heads(s: np.ndarray) -> np.ndarray:
    """The smallest of the elements' hashes, under ``HEADS`` hash functions."""
    return mix(np.array([(s * MULT[k]).min() for k in range(HEADS)]) + MULT[1 : HEADS + 1])


def profiles(docs: DataFrame, k: int, num: int, den: int, held: Broadcast[Shared]) -> DataFrame:
    """doc_id, n, key (of the set), and for documents with a prefix to send: l, tokens, short, heads, sketch, elements."""
    schema = "doc_id long, n int, key binary, l int, tokens array<long>, short int, heads array<long>, sketch binary, elements binary"

    def run(batches):
        for batch in batches:
            rows = []
            for s in shingle_sets(utf8(batch.column("text")), k):
                row = [len(s), None, 1, [], 0, None, None, None]
                if len(s):
                    row[1] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    row[2], tokens, row[4] = prefix(s, held.value.count(s), num, den)
                    if len(tokens):
                        parity = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
                        row[3], row[5] = signed(tokens), signed(heads(s))
                        row[6:] = np.packbits(parity.astype(np.uint8)).tobytes(), pack_sorted(s >> np.uint64(16))
                rows.append(row)
            kinds = (pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", "n", "key", "l", "tokens", "short", "heads", "sketch", "elements"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Group:
    """The classes of one token (of one pair of blocks), for comparison of one with many."""

    def __init__(self, rows: dict[str, np.ndarray], lists: list | None, num: int, den: int):
        self.num, self.den = num, den
        self.n, self.side, self.sketch, self.id = rows["n"], rows["side"], rows["sketch"], rows["id"]
        _, self.comp = np.unique(rows["comp"], return_inverse=True)
        self.l, self.code, self.lists = rows["l"], None, lists
        if lists is not None and sum(x is not None for x in lists) > 1:
            known = [x if x is not None else () for x in lists]
            size = np.fromiter(map(len, known), np.int64, len(known))
            values, code = np.unique(np.concatenate([np.asarray(x, np.int64) for x in known]), return_inverse=True)
            self.code = np.full((len(known), int(size.max())), len(values), np.int64)
            self.code[np.arange(self.code.shape[1]) < size[:, None]] = code
            self.values, self.listed = values, size > 0

    def near(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``others``, in other components, that class i may be linked with; the distances of their sketches."""
        if self.side[i] != 2:  # in a pair of blocks only across
            others = others[self.side[others] != self.side[i]]
        a, b = self.n[i], self.n[others]
        others = others[(self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)) & (self.comp[others] != self.comp[i])]
        # overlap >= num / (den + num) * (a + b), so the sets differ in a + b - 2 * overlap elements at most
        differ = np.bitwise_count(self.sketch[others] ^ self.sketch[i]).sum(1)
        total = a + self.n[others]
        fit = differ * (self.den + self.num) <= total * (self.den - self.num)
        return others[fit], differ[fit]

    def matching(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of ``others``: which share as many prefix tokens with class i as both ask for."""
        if self.code is None or not self.listed[i]:
            return np.ones(len(others), bool)
        own = np.zeros(len(self.values) + 1, bool)
        own[self.code[i]] = True
        own[-1] = False
        return (own[self.code[others]].sum(1) >= np.minimum(self.l[i], self.l[others])) | ~self.listed[others]

    def first(self, i: int, others: np.ndarray, token: int) -> np.ndarray:
        """Of ``others``: which share no prefix token before ``token`` with class i."""
        if self.code is None or not self.listed[i]:
            return np.ones(len(others), bool)
        own = np.zeros(len(self.values) + 1, bool)
        mine = self.code[i]
        own[mine[: int(np.flatnonzero(mine == np.searchsorted(self.values, token))[0])]] = True
        return ~own[self.code[others]].any(1) | ~self.listed[others]


def _forest(g: Group):
    """Pairs that join the components of a group's candidates: for each two joined, those with the nearest sketches."""
    left = np.arange(len(g.n))
    while len(left):
        queue = left[g.comp[left] == g.comp[left[0]]].tolist()
        left = left[g.comp[left] != g.comp[left[0]]]
        while queue and len(left):
            i = queue.pop()
            got, differ = g.near(i, left)
            if len(got):
                fit = g.matching(i, got)
                got = got[fit][np.argsort(differ[fit], kind="stable")]
                _, best = np.unique(g.comp[got], return_index=True)
                for j in got[best].tolist():
                    yield i, j
                joined = np.isin(g.comp[left], g.comp[got])
                queue.extend(left[joined].tolist())
                left = left[~joined]


def _every(g: Group, token: int):
    """All candidates across components that have no shared prefix token before this one."""
    for i in range(len(g.n) - 1):
        got, _ = g.near(i, np.arange(i + 1, len(g.n)))
        if len(got):
            got = got[g.matching(i, got)]
            for j in got[g.first(i, got, token)].tolist():
                yield i, j


def _candidates(batches, num: int, den: int, every: bool):
    """a, b, token for rows sorted by (token, i, j): edges of each group."""

    def table(batch) -> dict[str, np.ndarray]:
        rows = {k: batch.column(k).to_numpy() for k in ("token", "i", "j", "side", "id", "comp", "n", "l")}
        sketch = batch.column("sketch").cast(pa.binary(SKETCH // 8))
        sketch = sketch.combine_chunks() if isinstance(sketch, pa.ChunkedArray) else sketch
        return rows | {"sketch": np.frombuffer(sketch.buffers()[1], "<u8").reshape(-1, SKETCH // 64)[sketch.offset :][: len(sketch)]}

    def edges(batch):
        rows = table(batch)
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in ("token", "i", "j"):
            change[1:] |= rows[k][1:] != rows[k][:-1]
        first = np.append(np.flatnonzero(change), batch.num_rows)
        lists = batch.column("tokens").to_pylist() if "tokens" in batch.schema.names else None
        a, b, token = [], [], []
        for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if y - x == 1:
                continue
            g = Group({k: v[x:y] for k, v in rows.items()}, lists and lists[x:y], num, den)
            for i, j in _every(g, int(rows["token"][x])) if every else _forest(g):
                a.append(max(g.id[i], g.id[j]))
                b.append(min(g.id[i], g.id[j]))
                token.append(rows["token"][x])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, token)], names=["a", "b", "token"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = [batch.column(k).to_numpy() for k in ("token", "i", "j")]
        same = reduce(np.logical_and, (k == k[-1] for k in keys))
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield edges(batch.slice(0, cut))
        rest = batch.slice(cut)  # the last group may go on in the next batch
    if rest is not None:
        yield edges(rest)


def _verify(batches, num: int, den: int):
    for batch in batches:
        a, b, x, y = (batch.column(k).to_pylist() for k in ("a", "b", "x", "y"))
        keep = []
        for p, q in zip(x, y, strict=True):
            p, q = unpack_sorted(p), unpack_sorted(q)
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            both = int((q[at] == p).sum())
            keep.append(den * both >= num * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])


def _count(rows: list[dict], num: int, den: int) -> np.ndarray:
    """For rows sorted by n: how many of the others each one is linked with (in a pair of blocks: of the other side)."""
    n, side = np.array([r["n"] for r in rows], np.int64), np.array([r["side"] for r in rows])
    sets = [unpack_sorted(r["elements"]) for r in rows]
    first = np.cumsum([0, *map(len, sets)])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    links, own = np.zeros(len(rows), np.int64), np.zeros(len(values), bool)
    for i in range(len(rows) - 1):
        last = int(np.searchsorted(num * n, den * n[i], "right"))  # up to there the sizes allow a link
        if last <= i + 1:
            continue
        own[code[first[i] : first[i + 1]]] = True
        at = first[i + 1]
        both = np.add.reduceat(own[code[at : first[last]]], first[i + 1 : last] - at, dtype=np.int64)
        own[code[first[i] : first[i + 1]]] = False
        size = np.diff(first[i : last + 1])
        linked = den * both >= num * (size[0] + size[1:] - both)
        if side[i] != 2:
            linked &= side[i + 1 : last] != side[i]
        links[i] += linked.sum()
        links[i + 1 : last] += linked
    return links


def _counts(batches, num: int, den: int):
    """id, links for rows sorted by (comp, i, j, n); an id once for each pair of blocks."""

    def batch_of(rows):
        links = _count(rows, num, den)
        return pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows]), pa.array(links)], names=["id", "links"])

    held, last = [], None
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for row in batch.slice(start, 256).to_pylist():
                if (key := (row["comp"], row["i"], row["j"])) != last:
                    if len(held) > 1:
                        yield batch_of(held)
                    held, last = [], key
                held.append(row)
    if len(held) > 1:
        yield batch_of(held)


def link(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block: int = 2048, heavy: int = 1 << 20,
    count_links: bool = True, count_classes: int = COUNT_CLASSES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and, unless left out, class_links; a row per document."""
    spark = docs.sparkSession
    scratch, width = Scratch(spark), shuffle_width(docs.sparkSession)
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = bitmap_bytes(letters // 24)  # a third of the shingles at about eight bytes each
    counts = shared(docs.select("text"), lambda batch: shingle_sets(utf8(batch.column("text")), k), heavy=heavy, size=size)
    held = spark.sparkContext.broadcast(counts)
    prof = scratch.write(profiles(docs, k, num, den, held).withColumn("at", F.monotonically_increasing_id()), "profiles")
    held.destroy()
    # One row a class, whatever ids are null or repeated: the profile of its first row, whose number is the class's id.
    classes = scratch.write(prof.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("at").alias("id")), "classes")
    sends = prof.where("size(tokens) > 0").drop("doc_id", "key")
    reps = scratch.write(sends.join(classes.select("id"), F.col("at") == F.col("id")).drop("at"), "reps")

    def spread(mine: Column, begin: Column, end: Column) -> Column:
        # (i, i): the block itself, side 2; (i, j): the pair of blocks, sides 0 and 1.
        others = F.when(end > begin, F.sequence(begin, F.greatest(begin, end - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(others, lambda o: F.struct(
            F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), F.when(o == mine, 2).when(o > mine, 0).otherwise(1).alias("side")))

    def blocks_of(count: Column) -> Column:
        return F.ceil(count / F.lit(block)).cast("int")

    def block_of(blocks: Column) -> Column:
        return F.pmod(F.xxhash64("id", "token"), F.greatest(blocks, F.lit(1))).cast("int")

    def groups(dealt: DataFrame, lists: Column | None, every: bool, name: str) -> DataFrame:
        """a, b, token from rows (token, id, comp, s)."""
        payload = reps.select("id", "n", "l", "sketch", *([] if lists is None else [lists.alias("tokens")]))
        rows = dealt.select("token", "id", "comp", "s.*").join(payload, "id")
        rows = rows.repartition(width, "token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "id")
        return scratch.write(rows.mapInArrow(lambda batches: _candidates(batches, num, den, every), "a long, b long, token long"), name)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        elements = reps.select("id", "elements")
        left = pairs.join(elements.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
        both = left.join(elements.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")
        return scratch.write(both.mapInArrow(lambda batches: _verify(batches, num, den), "a long, b long, linked boolean"), name)

    def placed(found: DataFrame, comp: DataFrame) -> DataFrame:
        """``found`` (a, b, ...) with the components p and q of its two ends."""
        ends = found.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("p")), "a")
        return ends.join(comp.select(F.col("id").alias("b"), F.col("comp").alias("q")), "b")

    def grown(comp: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """id, comp after the verified links."""
        between = placed(links.where("linked"), comp).select(F.col("p").alias("a"), F.col("q").alias("b"))
        roots = components(between, scratch, name)
        return scratch.write(comp.join(roots, F.col("comp") == F.col("node"), "left").select("id", F.coalesce("root", "comp").alias("comp")), f"{name}_comp")

    alone = reps.select("id", F.col("id").alias("comp"))
    posts = reps.select("id", F.explode("heads").alias("token"))
    lists = posts.groupBy("token").agg(F.count("*").alias("len")).where("len > 1")
    mine = block_of(blocks_of(F.col("len")))
    dealt = posts.join(lists, "token").select("token", "id", F.col("id").alias("comp"), F.struct(mine.alias("i"), mine.alias("j"), F.lit(2).alias("side")).alias("s"))
    found = groups(dealt, None, False, "edges1").select("a", "b").distinct()
    comp = grown(alone, verified(found, "links1"), "cc1")

    def members(comp: DataFrame, only: DataFrame | None) -> DataFrame:
        """token, id, comp and s, for tokens (of ``only``) with several components."""
        posts = reps.select("id", F.explode(F.slice("tokens", F.lit(1), F.col("short"))).alias("token"))
        posts = posts if only is None else posts.join(only, "token", "left_semi")
        posts = scratch.write(posts.join(comp, "id").select("token", "id", "comp"), "posts" if only is None else "open_posts")
        parts = posts.groupBy("token", "comp").agg(F.count("*").alias("size"))
        lists = parts.groupBy("token").agg(F.count("*").alias("comps"), F.sum("size").alias("len"), F.max(F.struct("size", "comp")).alias("top"))
        lists = lists.where("comps > 1").select("token", "len", F.col("top.comp").alias("top"), F.col("top.size").alias("top_size"))
        major, minor = blocks_of(F.col("top_size")), blocks_of(F.col("len") - F.col("top_size"))
        in_major, in_minor = block_of(major), major + block_of(minor)
        one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
        s = F.when(F.col("len") <= block, one).when(F.col("comp") == F.col("top"), spread(in_major, major, major + minor)).otherwise(spread(in_minor, F.lit(0), major + minor))
        return posts.join(lists, "token").select("token", "id", "comp", F.explode(s).alias("s"))

    listed = F.size("tokens") <= MOST_LISTED
    short = F.when(listed & (F.col("l") > 1), F.transform("tokens", lambda t: F.shiftright(t, 32).cast("int")))
    edges = groups(members(comp, None), short, False, "edges2")
    second = verified(edges.select("a", "b").distinct(), "links2")
    comp = grown(comp, second, "cc2")
    still = scratch.write(placed(edges, comp).where("p <> q").select("token").distinct(), "open")
    third = groups(members(comp, still), F.when(listed, F.col("tokens")), True, "edges3").select("a", "b").distinct()
    third = verified(third.join(second.select("a", "b"), ["a", "b"], "left_anti"), "links3")
    comp = grown(comp, third, "cc3")
    scratch.drop("edges1", "edges2", "edges3", "links1", "links2", "links3", "posts", "open_posts", "open", "cc1_comp", "cc2_comp")

    whole = classes.join(comp, "id", "left").select("key", "rep", F.col("id"), F.coalesce("comp", "id").alias("comp"))
    whole = scratch.write(whole.join(reps.select("id", F.col("n").alias("elements_n")), "id", "left"), "whole")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(count_classes)), F.ceil(F.coalesce(F.sum("elements_n"), F.lit(0)) / F.lit(COUNT_ELEMENTS))).cast("int")
    named = scratch.write(whole.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"), parts.alias("parts")), "named")
    whole = whole.join(named, "comp")
    kept = ["component_id"]
    if count_links:
        own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        inside = whole.where("members > 1").select("comp", "id", F.explode(spread(own, F.lit(0), F.col("parts"))).alias("s")).select("comp", "id", "s.*")
        rows = inside.join(reps.select("id", "n", "elements"), "id").repartition(width, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "n", "id")
        links = rows.mapInArrow(lambda batches: _counts(batches, num, den), "id long, links long")
        degree = links.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("class_links"))
        whole = whole.join(degree, F.col("id") == F.col("node"), "left")
        kept.append("class_links")
    # Written, so that the join below stands alone: a class of very many copies is then split by skew handling.
    whole = scratch.write(whole.select(F.col("key").alias("_key"), *kept), "comp")
    out = prof.select("doc_id", "n", "key").join(whole, F.col("key") == F.col("_key"), "left")
    out = out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in kept[1:]])
    return scratch.finish(out)


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay, with all columns: of each component the row with the smallest doc_id.

    Rows are told apart by numbers of their own: a null doc_id comes after all others, and of rows with the same one the first stays.
    """
    scratch = Scratch(docs.sparkSession)
    marked = numbered(docs, scratch)
    groups = link(marked.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")), count_links=False, **how)
    ids = marked.select("_row", F.col("_doc.doc_id").alias("doc_id")).join(groups.select(F.col("doc_id").alias("_id"), "component_id"), F.col("_row") == F.col("_id"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = ids.groupBy("component_id").agg(best.alias("best")).select(F.col("best._row").alias("_kept"))
    return marked.join(kept, marked["_row"] == kept["_kept"], "left_semi").select("_doc.*")
