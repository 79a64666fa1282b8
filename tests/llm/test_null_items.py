"""Decontamination with benchmark rows that have no id."""

import pytest

from vellum.llm import decontaminate


@pytest.mark.parametrize("words", [1_000_000, 10])
def test_items_without_id_hit(spark, words):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    bench = spark.createDataFrame([(None, a), (None, b), (7, c)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a} y {b}"), (2, f"{a} {c}"), (3, c), (4, "clean")], "doc_id long, text string")
    # As the query's SQL has it: DISTINCT keeps one null, count(*) counts it and string_agg leaves it out.
    rep = decontaminate.report(docs, bench, block_words=words).selectExpr("doc_id", "n_hit", "n_items", "array_join(items, ',') ids", "items")
    got = {r["doc_id"]: tuple(r)[1:] for r in rep.collect()}
    assert got == {1: (24, 1, "", [None]), 2: (24, 2, "7", ["7", None]), 3: (12, 1, "7", ["7"]), 4: (0, 0, "", [])}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [4]
