"""Decontamination: longest matches and their places."""

import pytest

from vellum.llm import decontaminate


@pytest.mark.parametrize("words", [1_000_000, 10])
def test_matches_are_followed_within_one_item(spark, words):
    a, b = [f"a{i}" for i in range(10)], [f"b{i}" for i in range(10)]
    c = [f"c{i}" for i in range(25)]
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, "short one")], "item_id long, text string")
    texts = [" ".join(["x", *a, *b, "y"]), " ".join(["x", *c[3:20], "y", *c[5:15], "short", "one"]), "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(docs, bench, block_words=words).collect()}
    assert [tuple(m) for m in got[0]["matches"]] == [(1, 10, "1", 0), (11, 10, "2", 0)]
    assert (got[0]["n_hit"], got[0]["longest"], got[0]["longest_at"]) == (20, 10, 1)
    assert [tuple(m) for m in got[1]["matches"]] == [(1, 17, "3", 3), (19, 10, "3", 5), (29, 2, "4", 0)]
    assert (got[1]["longest"], got[1]["longest_at"]) == (17, 1)
    assert (got[2]["matches"], got[2]["longest"], got[2]["longest_at"]) == ([], 0, None)


def test_items_that_begin_alike(spark):
    """A common instruction in many items, repeated in a document: hits without the pairs of places."""
    start = [f"s{i}" for i in range(10)]
    bench = spark.createDataFrame([(i, " ".join([*start, f"own{i}"])) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(start * 20)), (2, "clean")], "doc_id long, text string")
    hits, places = ({r["doc_id"]: r for r in decontaminate.report(docs, bench, places_too=x).collect()} for x in (False, True))
    assert (hits[1]["n_hit"], hits[1]["n_items"], hits[1]["matches"], len(places[1]["matches"])) == (200, 30, [], 600)
    assert all(hits[d][c] == places[d][c] for d in hits for c in ("n_words", "n_hit", "n_items", "items", "contaminated"))
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [2]
