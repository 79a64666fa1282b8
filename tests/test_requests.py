"""Requests, runs, entitlement changes, reporting trees, overlapping versions, cached embeddings."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellum.operators import graph, requests, versions
from vellum.sources import generations

START = datetime(2024, 5, 1)


@pytest.mark.parametrize(("request_", "reasons"), [
    ({"question": "May I lend it?"}, []), ({"question": "Why?", "corpora": ["a"], "mode": "hybrid", "as_of": "2024-02-29", "top_k": 3}, []),
    ({"question": "Why?", "roles": ["admin"], "Question": "x"}, ["unknown field: Question", "unknown field: roles"]), ({}, ["missing: question"]), ({"question": ""}, ["length: question"]),
    ({"question": "   "}, ["length: question"]), ({"question": "x" * 2000}, []), ({"question": "x" * 2001}, ["length: question"]), ({"question": None}, ["type: question"]),
    ({"question": ["Why?"]}, ["type: question"]), ({"question": "Why?", "corpora": "a"}, ["type: corpora"]), ({"question": "Why?", "corpora": ["a", 1]}, ["type: corpora"]),
    ({"question": "Why?", "mode": "fast"}, ["mode"]), ({"question": "Why?", "as_of": "2023-02-29"}, ["date: as_of"]), ({"question": "Why?", "top_k": "3"}, ["type: top_k"]), ([1], ["not an object"])])
def test_requests(spark, request_, reasons):
    got = spark.createDataFrame([(json.dumps(request_),)], "r string").select(requests.refusals(F.col("r"))).first()[0]
    assert got == reasons


@pytest.mark.parametrize("text", [None, "", "no JSON", "7", '"text"', "{"])
def test_what_is_no_object(spark, text):
    assert spark.createDataFrame([(text,)], "r string").select(requests.refusals(F.col("r"))).first()[0] == ["not an object"]


def test_run_budgets(spark):
    rng, rows, want = random.Random(3), [], {}
    for run in range(12):
        at, calls = START, []
        for n in range(rng.randint(1, 12)):
            at += timedelta(seconds=rng.choice([0, 5, 40]))
            agent = rng.choice([None, None, 1, 2, 3])
            calls.append((run, run * 100 + n, at, agent, 0 if agent is None else rng.choice([1, 1, 2])))
        rows += calls
        agents, out, first = set(), {}, None
        for n, (_, call, when, agent, depth) in enumerate(calls, 1):
            agents |= {agent} - {None}
            for name, bad in (("calls", n > 6), ("depth", depth > 1), ("subagents", len(agents) > 2), ("seconds", (when - calls[0][2]).total_seconds() > 120)):
                if bad:
                    out.setdefault(name, call)
                    first = first or n
        want[run] = (len(calls), out.get("calls"), out.get("depth"), out.get("subagents"), out.get("seconds"), (first or len(calls) + 1) - 1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run int, call int, at timestamp, agent int, depth int")
    assert {r["run"]: tuple(r)[1:] for r in requests.run_budgets(df).collect()} == want


def test_access_is_decided_again(spark):
    at = lambda h: START + timedelta(hours=h)
    changes = spark.createDataFrame([("a", at(1), 1, True), ("a", at(5), 2, False), ("a", at(9), 3, True), ("b", at(2), 4, True), ("b", at(3), 5, True)], "user_id string, at timestamp, change int, allowed boolean")
    asked = spark.createDataFrame([
        (1, "a", at(0), at(2)), (2, "a", at(2), at(4)), (3, "a", at(2), at(6)), (4, "a", at(4), at(10)), (5, "b", at(2), at(4)), (6, "c", at(2), at(4)), (7, "a", at(1), at(1))],
        "request int, user_id string, started timestamp, returned timestamp")
    got = {r["request"]: (r["revision_before"], r["revision_after"], r["status"]) for r in requests.recheck(asked, changes).collect()}
    assert got == {1: (0, 1, "refused"), 2: (1, 1, "answered"), 3: (1, 2, "withheld"), 4: (1, 3, "decided_again"), 5: (1, 2, "decided_again"), 6: (0, 0, "refused"), 7: (1, 1, "answered")}


def test_reporting_tree_with_circles(spark):
    rng = random.Random(5)
    people = {f"p{i}": f"p{rng.randint(max(0, i - 6), i - 1)}" if i else None for i in range(60)} | {f"line{i}": f"line{i - 1}" if i else "p7" for i in range(40)}
    lost = {"x": "y", "y": "x", "z": "y", "self": "self"}
    labels = graph.tree_labels(spark.createDataFrame([*people.items(), *lost.items(), ("top", "nobody")], "user_id string, manager_id string"))
    got = {r["user_id"]: (r["entry"], r["exit"], r["depth"]) for r in labels.collect()}
    assert set(got) == set(people) | {"top"} and sorted(e for e, _, _ in got.values()) == list(range(1, len(got) + 1))

    def above(u):
        return [] if people.get(u) is None else [people[u], *above(people[u])]

    for m in people:
        assert {u for u in people if u != m and got[m][0] < got[u][0] <= got[m][1]} == {u for u in people if m in above(u)} and got[m][2] == len(above(m))
    amounts = spark.createDataFrame([(u, i) for i, u in enumerate(people)] + [("p3", 1000), ("x", 5)], "user_id string, v int")
    own = {u: i for i, u in enumerate(people)}
    own["p3"] += 1000
    sums = {r["user_id"]: (r["people"], r["v"]) for r in graph.sums_below(labels, amounts, "v").collect()}
    assert all(sums[m] == (len(under), sum(own[u] for u in under)) for m in people for under in [[u for u in people if m in above(u)]])


def test_overlapping_versions(spark):
    rows = [("p", 1, 1, 5, "a"), ("p", 2, 3, 4, "a"), ("p", 3, 5, 9, "b"), ("p", 4, 11, None, "a"), ("p", 5, 50, 60, "c"), ("q", 6, 1, 2, "a"), ("q", 7, 3, 4, "b"), ("r", 8, 1, 9, "a"), ("r", 9, 2, 3, "a")]
    day = lambda n: None if n is None else (START + timedelta(days=n)).date()
    df = spark.createDataFrame([(p, v, day(a), day(b), x) for p, v, a, b, x in rows], "policy string, version int, start date, stop date, value string")
    got = sorted((r["policy"], r["start"], r["versions"], r["values"]) for r in versions.conflict_groups(df, "policy", "version", "start", "stop", "value").collect())
    assert got == [("p", day(1), 3, 2), ("p", day(11), 2, 2)]


def test_a_cached_embedding_needs_all_four(spark):
    kind = "input_sha256 string, model_digest string, dimension int, preprocessing string"
    wanted = spark.createDataFrame([("i1", "m", 64, "v1"), ("i2", "m", 64, "v1")], kind)
    for other in (("i9", "m", 64, "v1"), ("i1", "m2", 64, "v1"), ("i1", "m", 32, "v1"), ("i1", "m", 64, "v2")):
        cache = spark.createDataFrame([other, ("i2", "m", 64, "v1")], kind)
        assert [r["input_sha256"] for r in generations.missing_embeddings(wanted, cache).collect()] == ["i1"]
    assert generations.one_model(wanted) is wanted
    with pytest.raises(ValueError, match="one model"):
        generations.one_model(wanted.union(spark.createDataFrame([("i3", "m2", 64, "v1")], kind)))
