"""class_links of the n-gram join: all links of a document's class, however tokens and blocks fall."""

import pytest
from brute import shingles
from test_llm import SCHEMA, as_dict, odd_docs

from vellum.llm import ngram_join


def links(rows, k, num, den):
    """doc_id -> the number of other distinct sets that its set is linked with"""
    sets = {d: frozenset(shingles(t, k)) for d, t in rows}
    kinds = set(sets.values()) - {frozenset()}
    degree = {x: sum(x != y and den * len(x & y) >= num * len(x | y) for y in kinds) for x in kinds}
    return {d: (degree.get(s, 0),) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (2, 60)])
def test_every_link_is_counted(spark, k, num):
    words = [f"w{i}" for i in range(200)]
    family = [" ".join([*words, f"end{i}"]) for i in range(12)]  # mutually near, all with the same prefix tokens
    rows = [(d, t) for d, t, *_ in odd_docs()]
    rows += [(1000 + i, t) for i, t in enumerate(family)] + [(2000, family[0])]
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], SCHEMA).repartition(3)
    want = links(rows, k, num, 100)
    assert want[1003] == (11,)
    for how in ({}, {"block": 7, "count_classes": 5}):
        assert as_dict(ngram_join.link(df, k, num, 100, **how), "class_links") == want


def test_repeated_and_null_ids_count_once(spark):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(1, words), (1, words), (2, words + " a"), (None, words + " b"), (None, words + " b")]
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], SCHEMA)
    got = ngram_join.link(df, 3, 90, 100).collect()
    assert len(got) == 5 and {(r["component_id"], r["class_links"]) for r in got} == {(1, 2)}
