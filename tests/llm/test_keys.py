"""Rows without an id, repeated rows, and characters that keys use themselves."""

import pytest
from pyspark.sql import functions as F

from vellum.llm import substring_dedup, url_filter

RULES = [("net", "/", "block"), ("a.net", "/x", "allow")]


@pytest.mark.parametrize(("url", "verdict"), [
    ("http://net\x00foo/", "allow"), ("http://foo\x00net/", "allow"), ("http://foo.net/", "block"), ("http://a.net/x\x00y", "allow"), ("http://b\x01.a.net/x", "allow"),
    ("http://a\x00.net/x", "block"), ("http://a\x01.net/x", "block"), ("http://\x00/", "allow"), ("http://net\x01\x01foo/", "allow")])
def test_control_characters_in_hosts(spark, url, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge(pages, rules).first()["verdict"] == verdict


def equal_hashes(spark):
    """Two different texts with the same 32-bit hash."""
    found = spark.range(200_000).select(F.concat(F.lit("number "), F.col("id"), F.lit(" of many, and no other text has any of it in common with it at all")).alias("t"))
    pair = found.groupBy(F.hash("t").alias("h")).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).where("n > 1").first()
    return pair["a"], pair["b"]


def test_rows_without_an_id_lose_their_own_copies_only(spark):
    a, b = equal_hashes(spark)
    other = "z" * 7 + "".join(chr(97 + i * i % 26) for i in range(160))
    rows = [(1, a), (None, a), (None, b), (None, other)]
    tail = "of many, and no other text has any of it in common with it at all"
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed = {t: 0 if d else n for d, t in rows for n in [len(t) if t == a else len(tail) + 1 if t == b else 0]}
    assert sorted((d is None, n, x) for d, n, x, _ in got) == sorted((d is None, len(t), 0 if d else removed[t]) for d, t in rows)


def test_copies_of_a_row_give_its_cuts_once(spark):
    text = " ".join(f"w{i * i}" for i in range(60))
    docs = spark.createDataFrame([(1, text)] + [(2, text + " end")] * 40, "doc_id long, text string")
    cuts = substring_dedup.spans(docs).collect()
    assert [r["doc_id"] for r in cuts] == [2] and len(cuts[0]["cuts"]) == len({(c["lo"], c["mask"]) for c in cuts[0]["cuts"]}) <= len(text)
    assert {(r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup(docs).collect()} == {(1, 0), (2, len(text))}
