"""Filters of the pipeline decide by row, whatever ids are null or repeated."""

from vellum.llm import decontaminate, ngram_join

A, B = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
ROWS = [(None, A), (None, A + " z"), (None, B), (1, B), (1, B), (1, "other words here"), (2, None)]


def test_decontamination_by_row(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    bench = spark.createDataFrame([(1, A)], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect()), key=str)
    assert got == sorted([(None, B), (1, B), (1, B), (1, "other words here"), (2, None)], key=str)


def test_one_row_of_each_component(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = ngram_join.one_of_each(docs).collect()
    a = [r for r in got if r["text"] in (A, A + " z")]
    assert len(a) == 1
    assert sorted((tuple(r) for r in got if r not in a), key=str) == sorted([(1, B), (1, "other words here"), (2, None)], key=str)
