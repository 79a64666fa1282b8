"""Work and memory that must not grow faster than the input."""

import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.ids import Limits
from vellum.llm import hashbits, substring_dedup
from vellum.operators import chunking, retrieval


def test_sums_before(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 3, 4, 5, 9, 10, 17, 1000)]
    for r in spark.createDataFrame(rows, "x array<int>").select("x", T.sums_before(F.col("x")).alias("y")).collect():
        assert r["y"] == list(itertools.accumulate(r["x"], initial=0))[:-1]


def test_a_long_text_is_normalized_in_time(spark):
    """A fold that carries its output takes minutes for so many words."""
    n = 40_000
    one = spark.range(1).select(F.repeat(F.lit("  ab\té"), n).alias("t")).select(T.normalize_spaces(F.col("t")).alias("n"))
    began = time.monotonic()
    got = one.select(F.length("n.normalized").alias("size"), F.size("n.offsets").alias("words"), F.element_at("n.offsets", -1).alias("last")).first()
    assert time.monotonic() - began < 20
    assert (got["size"], got["words"], tuple(got["last"])) == (5 * n - 1, 2 * n, (5 * n - 2, 6 * n - 1))


def test_a_task_hands_on_its_best_vectors_only(spark):
    """However many steps a task takes; what each step found used to be handed on."""
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 4, (20_000, 8)).astype(float)
    batches = [pa.record_batch({"item_id": pa.array(range(at, at + 5000)), "embedding": pa.array(list(v[at : at + 5000]))}) for at in range(0, len(v), 5000)]
    got = pa.Table.from_batches(retrieval._nearest_best(batches, [(q, v[q]) for q in range(500)], 3, 6)).to_pandas()
    assert len(got) == 1500
    for q in (0, 7, 499):
        want = sorted(range(len(v)), key=lambda i: (-(v[i] @ v[q]), i))[:3]
        assert list(got[got.question_id == q].item_id) == want


def test_keyword_pairs_in_memory_are_bounded(spark):
    """Documents that share many words with many questions: all their pairs at once took more than a gigabyte."""
    words = [f"w{i}" for i in range(40)]
    questions = [(q, " ".join(words) + f" q{q}", [*words, f"q{q}"], [1] * 41) for q in range(100)]
    n = 8192
    batch = pa.record_batch({"item_id": pa.array(range(n)), "text": pa.array([" ".join(words)] * n), "tokens": pa.array([words] * n)})
    tracemalloc.start()
    got = pa.Table.from_batches(retrieval._keyword_best([batch], questions, 2, 10)).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(got.item_id) == [0, 1] * 100 and set(got.score) == {40}
    assert peak < 150 << 20


#: The pattern that says what a sentence is, as a search at every character.
PLAIN_SENTENCE = r"""(?sU).*?(?:\n\s*\n|(?<=[.!?])(?!\s*\n\s*\n)\s+(?=[A-Z0-9"“])|\z)"""


def test_sentences_are_those_of_the_plain_pattern(spark):
    r = random.Random(3)
    texts = [("".join(r.choice("aA.?! \n\n\t\u00a07“") for _ in range(r.randrange(30))),) for _ in range(3000)]
    both = spark.createDataFrame(texts, "t string").select("t", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(c) for c, p in (("new", T.SENTENCE), ("plain", PLAIN_SENTENCE))])
    assert both.where("new <> plain").count() == 0


def test_costly_searches_are_spared_only_where_they_find_nothing(spark):
    texts = ["EXCEPT x", "Unleſs y", "an exception applies", "exceptional", "Refer To a", "ſee ſection 3", "SEE THE b", "see section c", "tree the", "", "none", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.is_exception(F.col("t")), F.col("t").rlike(T.EXCEPTION), T.references(F.col("t")), F.array_distinct(F.regexp_extract_all("t", F.lit(T.REFERENCE), F.lit(0)))).collect()
    assert [(r[0], r[2]) for r in got] == [(r[1], r[3]) for r in got]


def test_a_long_table_is_grouped_in_time(spark):
    """A row group is not counted anew for every row, and no fold carries the rows: both cost the square of a table."""
    n = 6000
    text = "T\n\n| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | {i} |" for i in range(n))
    docs = spark.createDataFrame([("v", "Title", "p", text)], "document_version_id string, document_title string, access_policy_id string, text string")
    began = time.monotonic()
    got = chunking.chunk_documents(docs, Limits(20_000, 30_000, 50)).where("table_header is not null").select("text", "token_count").collect()
    assert time.monotonic() - began < 20
    assert sum(c["text"].count("| row ") for c in got) == n and all(len(c["text"].split()) == c["token_count"] <= 30_000 for c in got)


def test_copies_of_a_text_are_set_aside(spark, monkeypatch):
    """Every place of every copy was staged, and its text dealt out with its cuts."""
    text, staged, write = " ".join(f"w{i * i}" for i in range(200)), {}, substring_dedup.Scratch.write

    def counted(self, df, name, *a, **k):
        out = write(self, df, name, *a, **k)
        staged[name] = out.count()
        return out

    monkeypatch.setattr(substring_dedup.Scratch, "write", counted)
    rows = [(i, text) for i in range(5, 50)] + [(90, text[:300] + "!"), (None, text), (3, text[:49]), (4, text[:49]), (None, None)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, n, n if d is None or d > 5 and d < 90 else 300 if d == 90 else 0) for d, t in rows for n in [len(t or "")]]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"])) for r in got)
    assert all(r["n_spans"] == (r["n_removed"] > 0) and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    assert staged["found"] < 2 * len(text) // 10 and staged["cuts"] == 1


def test_sides_that_no_string_holds_are_not_counted():
    """They kept twice as many places, of which nothing could come."""
    texts = [bytes(random.Random(s).choices(range(97, 123), k=400)) for s in range(20)]
    found = substring_dedup.Anchors(texts)
    before, after = found.reach()
    assert (before | after).all() and not (before & after).all()
    assert len(found.distinct()) == before.sum() + after.sum() < 2 * len(found.at)


def test_two_marks_let_fewer_others_through(spark):
    def items(batch):
        return [np.random.default_rng(0).integers(0, 2**64, 400_000, np.uint64)] if batch.num_rows else []

    asked, passed = np.random.default_rng(1).integers(0, 2**64, 100_000, np.uint64), []
    for marks in (1, 2):
        bits = hashbits.shared(spark.range(1), items, count=2, size=1 << 20, marks=marks)
        assert all(bits.maybe(x).all() for x in items(pa.record_batch({"id": [0]})))
        passed.append(bits.maybe(asked).mean())
    assert passed[1] < 0.015 < 0.03 < passed[0]
