"""Ranked retrieval: candidates, fusion, reranking, context packing.

A ranked list is a DataFrame with the columns of ``by`` (usually a question id), an item id and
``rank`` (1 is best).  Authorization filters come before every limit, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from vellum.functions.access import allow
from vellum.functions.running import running_sum

#: Bytes of questions (texts, or vectors as doubles) that every task holds at a time; more are asked in blocks.
MOST_BYTES = 16 << 20
#: Scores, and pairs of a document's token with a question that asks for it, that a task holds at a time.
_SCORES = 500_000


def in_blocks(questions: DataFrame, size: Column, ask: Callable[[DataFrame], DataFrame], most: int = MOST_BYTES) -> DataFrame:
    """``ask`` for blocks of questions of about ``most`` bytes each, so that the side that is broadcast is bounded."""
    blocks = max(1, -(-int(questions.agg(F.sum(size)).first()[0] or 0) // most))
    block = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [ask(questions if blocks == 1 else questions.where(block == b)) for b in range(blocks)])


def top_k(df: DataFrame, by: list[str], score: str, item: str, k: int) -> DataFrame:
    """The ``k`` best rows a group with their ``rank``; Spark prunes groups before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(item))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, questions: DataFrame, k: int = 10, digits: int = 6, most: int = MOST_BYTES) -> DataFrame:
    """Exact cosine top-k of unit vectors: question_id, item_id, score, rank.

    ``vectors``: item_id, embedding, already authorized; those that are null, have nulls or another dimension than
    a question's aren't compared with it.  ``questions``: question_id, vector.  Each task holds a block of the questions as a
    matrix, multiplies it with its own vectors some at a time, and hands on its ``k`` best a question, once.
    """
    read = vectors.select("item_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = StructType([questions.schema["question_id"], read.schema["item_id"], StructField("score", DoubleType())])

    def ask(some: DataFrame) -> DataFrame:
        rows = some.select("question_id", F.col("vector").cast("array<double>")).where("vector is not null").toLocalIterator()
        held = vectors.sparkSession.sparkContext.broadcast([(r[0], np.array(r[1], np.float64)) for r in rows])
        return read.mapInArrow(lambda batches: _nearest_best(batches, held.value, k, digits), schema)

    best = in_blocks(questions, 8 * F.size("vector") + 32, ask, most)
    return top_k(best, ["question_id"], "score", "item_id", k)


class _Best:
    """The ``k`` best items of each of ``n`` questions among those that a task has met, and ``least``: what the next one must reach."""

    def __init__(self, n: int, k: int, least: float):
        self.k, self.least, self.rows, self.fresh, self.most = k, np.full(n, least), None, 0, max(2 * n * k, 1 << 16)

    def add(self, question: np.ndarray, score: np.ndarray, item: pa.Array) -> None:
        if len(question):
            more = pa.table({"question": question, "score": score, "item": item})
            self.rows = more if self.rows is None else pa.concat_tables([self.rows, more])
            self.fresh += len(question)
            if self.fresh > self.most:
                self.cut()

    def cut(self) -> pa.Table | None:
        if self.rows is not None and self.fresh:
            rows = self.rows.sort_by([("question", "ascending"), ("score", "descending"), ("item", "ascending")])
            question = rows["question"].to_numpy()
            place = np.arange(len(question)) - np.searchsorted(question, question)
            self.rows, self.fresh = rows.filter(pa.array(place < self.k)).combine_chunks(), 0
            last = np.flatnonzero(place == self.k - 1)
            self.least[question[last]] = rows["score"].to_numpy()[last]
        return self.rows

    def reaching(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the scores (items by questions) that may be among the best, ties with the last included."""
        n, least = len(score), self.least
        if n > self.k:
            least = np.maximum(least, np.partition(score, n - self.k, axis=0)[n - self.k])
        return np.nonzero(score >= least)


def _result(best: _Best, ids: list):
    rows = best.cut()
    if rows is not None:
        question = pa.array([ids[x] for x in rows["question"].to_pylist()])
        yield pa.RecordBatch.from_arrays([question, rows["item"].combine_chunks(), rows["score"].combine_chunks()], names=["question_id", "item_id", "score"])


def _nearest_best(batches, questions: list[tuple], k: int, digits: int):
    """The best rows of a partition for each question, ties by item."""
    sizes = sorted({len(v) for _, v in questions})
    ids = {d: [q for q, v in questions if len(v) == d] for d in sizes}
    matrix = {d: np.array([v for _, v in questions if len(v) == d]).T for d in sizes}
    best, scale = {d: _Best(len(ids[d]), k, np.finfo(np.float64).min) for d in sizes}, 10.0**digits
    for batch in batches:
        lists = batch.column("embedding")
        length = lists.value_lengths().fill_null(-1).to_numpy()
        whole = pc.fill_null(lists.flatten(), float("nan")).to_numpy()
        first = np.concatenate(([0], np.cumsum(np.maximum(length, 0))))
        for d in sizes:
            own = np.flatnonzero(length == d)
            step = max(16, _SCORES // len(ids[d]))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                score = whole[first[some][:, None] + np.arange(d)] @ matrix[d]
                score *= scale
                score += 0.5
                np.floor(score, out=score)
                score /= scale
                score[np.isnan(score)] = -np.inf
                x, q = best[d].reaching(score)
                best[d].add(q, score[x, q], batch.column("item_id").take(pa.array(some[x])))
    for d in sizes:
        yield from _result(best[d], ids[d])


#: A token with a digit, taken with its dotted, hyphened or slashed parts (2.1, 12-b), is an identifier; others are words.
TOKEN = r"[\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*(?:[.\-/][\p{L}\p{N}]+)*|[\p{L}\p{N}]+"
_HAS_DIGIT = r"\p{N}"


def tokens_of(text: Column) -> Column:
    """Distinct lower-case words and identifiers; no stop words are dropped, nothing is stemmed."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def keyword_top(items: DataFrame, questions: DataFrame, k: int = 10, phrase: int = 10, identifier: int = 5, most: int = MOST_BYTES) -> DataFrame:
    """question_id, item_id, score, rank: the ``k`` items with the best scores above 0.

    Score: 1 for each distinct word that both have, ``identifier`` for an identifier, and ``phrase`` more
    if the whole question occurs.  ``items``: item_id, text, already authorized.  ``questions``: question_id,
    question.  Each task holds a block of the questions, scores documents where they are read, and hands on
    its own ``k`` best a question; neither texts nor pairs are shuffled.
    """
    asked = questions.select("question_id", F.lower("question").alias("text"), tokens_of(F.col("question")).alias("tokens"))
    asked = asked.select("*", F.transform("tokens", lambda t: F.when(t.rlike(_HAS_DIGIT), identifier).otherwise(1)).alias("weights"))
    read = items.select("item_id", F.lower("text").alias("text"), tokens_of(F.col("text")).alias("tokens"))
    schema = StructType([asked.schema["question_id"], read.schema["item_id"], StructField("score", LongType())])

    def ask(some: DataFrame) -> DataFrame:
        held = items.sparkSession.sparkContext.broadcast([tuple(r) for r in some.where("size(tokens) > 0").toLocalIterator()])
        return read.mapInArrow(lambda batches: _keyword_best(batches, held.value, k, phrase), schema)

    best = in_blocks(asked, 3 * F.octet_length("text") + 64, ask, most)
    return top_k(best, ["question_id"], "score", "item_id", k)


def _keyword_best(batches, questions: list[tuple], k: int, phrase: int):
    """The best rows of a partition, as one batch."""
    if not questions:
        return
    ids, texts = [q[0] for q in questions], [q[1] for q in questions]
    size = np.array([len(q[2]) for q in questions])
    vocabulary, code = np.unique([t for q in questions for t in q[2]], return_inverse=True)
    order = np.argsort(code, kind="stable")
    asks = np.repeat(np.arange(len(questions)), size)[order]  # the questions of each token, token by token
    weight = np.array([w for q in questions for w in q[3]])[order]
    first = np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
    known, step = pa.array(vocabulary, pa.string()), max(16, min(1024, _SCORES // len(questions)))
    best, q = _Best(len(questions), k, 1), len(questions)

    def scored(some: pa.RecordBatch) -> None:
        items, lists, lowered = (some.column(c) for c in ("item_id", "tokens", "text"))
        n = len(some)
        doc = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy())
        found = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
        doc, found = doc[found >= 0], found[found >= 0]
        many = first[found + 1] - first[found]
        upto = np.cumsum(many)
        if n > 1 and len(upto) and upto[-1] > _SCORES:  # so many pairs are taken in halves
            scored(some.slice(0, n // 2))
            scored(some.slice(n // 2))
            return
        place = np.arange(int(many.sum())) + np.repeat(first[found] - upto + many, many)
        pair = np.repeat(doc, many) * q + asks[place]
        shared = np.bincount(pair, minlength=n * q)
        score = np.bincount(pair, weight[place], n * q).astype(np.int64)
        # A question that occurs as a whole has all its tokens in the text but the first and the last, which may be parts there.
        for x in np.flatnonzero((shared > 0) & (shared >= np.tile(size, n) - 2)).tolist():
            if texts[x % q] in lowered[x // q].as_py():
                score[x] += phrase
        score = score.reshape(n, q)
        d, x = best.reaching(score)
        best.add(x, score[d, x], items.take(pa.array(d)))

    for batch in batches:
        for at in range(0, batch.num_rows, step):
            scored(batch.slice(at, step))
    yield from _result(best, ids)


def rrf(lists: list[DataFrame], by: list[str], item: str, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank) over the lists that have the item, and its new rank."""
    union = reduce(DataFrame.unionByName, [x.select(*by, item, "rank") for x in lists])
    score = F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 12).alias("score")
    fused = union.groupBy(*by, item).agg(score)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), item)))


def union_capped(lists: list[DataFrame], by: list[str], item: str, most: int = 30) -> DataFrame:
    """Candidates of all lists, each item once at its best rank, at most ``most`` a group."""
    union = reduce(DataFrame.unionByName, [x.select(*by, item, "rank") for x in lists])
    best = union.groupBy(*by, item).agg(F.min("rank").alias("best"), F.count("*").alias("lists"))
    order = Window.partitionBy(*by).orderBy("best", item)
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def rerank(candidates: DataFrame, by: list[str], item: str, score: Column, k: int = 5) -> DataFrame:
    """Orders candidates by a scorer; keeps the rank before, the rank after and the movement."""
    order = Window.partitionBy(*by).orderBy(F.col("rerank_score").desc(), F.col(item))
    out = candidates.withColumn("rerank_score", score).withColumn("after", F.row_number().over(order)).where(F.col("after") <= k)
    return out.withColumnRenamed("rank", "before").withColumn("moved", F.col("before") - F.col("after"))


def best_windows(windows: DataFrame, by: list[str], item: str, score: Column, keep: list[str]) -> DataFrame:
    """For each candidate its best window: ``by``, ``item``, window_index, window_spans, window_text, rerank_score and the columns ``keep``.

    A candidate counts as much as its best window; of equal ones the first is kept, with its spans.
    """
    one = F.struct(F.col("rerank_score"), -F.col("window_index"))
    kept = F.struct("window_index", "window_spans", "window_text", "rerank_score", *keep)
    best = windows.withColumn("rerank_score", score).groupBy(*by, item).agg(F.max_by(kept, one).alias("w"))
    return best.select(*by, item, "w.*")


def overlap_score(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the Jaccard similarity of token sets."""
    a, b = tokens_of(question), tokens_of(text)
    return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 6)


def within_budget(ranked: DataFrame, by: list[str], order: list[str], tokens: str, budget: int = 3500) -> DataFrame:
    """The longest prefix in rank order whose tokens fit the budget, with the running total ``used``."""
    return running_sum(ranked, by, order, tokens, "used").where(F.col("used") <= budget)


def with_neighbours(ranked: DataFrame, hops: DataFrame, by: list[str], item: str, additions: int = 10, most: int = 30) -> DataFrame:
    """``by``, ``item``, rank: the ranked list, then items one hop from it that it doesn't have, ``additions`` and ``most`` in all.

    ``hops``: src, dst, already validated and permitted at both ends.  An addition stands where its best seed does.
    """
    near = ranked.join(hops, F.col(item) == F.col("src")).groupBy(*by, F.col("dst").alias(item)).agg(F.min("rank").alias("seed"))
    near = near.join(ranked.select(*by, item), [*by, item], "left_anti")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("seed", item))).where(F.col("place") <= additions)
    both = ranked.select(*by, item, F.lit(0).alias("hop"), F.col("rank").alias("place")).unionByName(near.select(*by, item, F.lit(1).alias("hop"), "place"))
    order = Window.partitionBy(*by).orderBy("hop", "place")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*by, item, "hop", "rank")


def readable(chunks: DataFrame, rules: DataFrame, user: DataFrame, corpora: list[str] | None = None) -> DataFrame:
    """The chunks that the one principal of ``user`` may read, within the selected corpora.

    ``chunks``: tenant_id, corpus_id, document_policy_id, access_policy_id (the section's).  Both rules must
    allow; a missing one denies.  ``rules`` and ``user`` are as ``allow`` reads them.
    """
    if corpora is not None:
        chunks = chunks.where(F.col("corpus_id").isin(*corpora))
    rule = rules.select(F.col("id").alias("_rule"), F.struct("*").alias("_p"))
    own = rule.select(F.col("_rule").alias("_section_rule"), F.col("_p").alias("_s"))
    both = chunks.join(rule, F.col("document_policy_id") == F.col("_rule")).join(own, F.col("access_policy_id") == F.col("_section_rule"))
    both = both.crossJoin(F.broadcast(user.limit(1).select(F.struct("*").alias("_u"))))
    return both.where(allow("_u", F.col("corpus_id"), F.col("tenant_id"), "_p") & allow("_u", F.col("corpus_id"), F.col("tenant_id"), "_s")).select(*chunks.columns)


def get_sections(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """For each wanted section_id its body, or the status ``not_found``; what isn't in ``sections`` (readable ones) looks absent."""
    found = wanted.join(sections.select("section_id", "section_ordinal", "heading", "body"), "section_id", "left")
    return found.withColumn("status", F.when(F.col("body").isNull(), "not_found").otherwise("found"))
