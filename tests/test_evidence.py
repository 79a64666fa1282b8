"""References found in text, authorized intervals, and evidence packs against a plain version."""

import random

import pytest

from vellum.operators import chunking, evidence, references
from vellum.functions.ids import Limits

TEXTS = {
    "a": "Loans of clocks\n1. Purpose\nEvery loan is signed. See section 3 in Rules of transport. Refer to 9 Nowhere.\n2. Vault\nKeys are kept apart. See section 1 of this.\n3. Terms\nThree weeks at most.\n",
    "b": "Rules of transport\nSection 3 – Crates\nCrates are sealed. For more see the Purpose section in Loans of clocks.\n4. Vans\nSee the Rules of transport.\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    kind = "document_version_id string, document_title string, access_policy_id string, text string, access_by_heading map<string,string>"
    docs = spark.createDataFrame([(k, t.split("\n")[0], "open", t, {"2 Vault": "secret"}) for k, t in TEXTS.items()], kind)
    parts = chunking.sections(docs)
    chunks = chunking.chunk_sections(parts, Limits(40, 50, 0))
    return docs, chunks, references.reference_edges(chunks, parts)


def test_references_meet_the_longest_name(graph):
    _, _, edges = graph
    got = {r["phrase"]: (r["document_version_id"], r["dst_document"], r["dst_section"], r["validation_status"]) for r in edges.collect()}
    assert got == {
        "See section 3 in Rules of transport": ("a", "b", 1, "validated"), "Refer to 9 Nowhere": ("a", None, None, "unresolved"), "See section 1 of this": ("a", "a", 1, "validated"),
        "see the Purpose section in Loans of clocks": ("b", "a", 1, "validated"), "See the Rules of transport": ("b", "b", 0, "validated")}


def test_edges_carry_their_span(graph):
    _, _, edges = graph
    assert all(TEXTS[r["document_version_id"]][r["start"] : r["stop"]] == r["phrase"] for r in edges.collect())


def test_an_edge_needs_both_ends_and_its_own_chunk(graph):
    _, chunks, edges = graph
    open_ = chunks.where("access_policy_id = 'open'")
    seen = {r["phrase"] for r in references.visible_edges(edges, open_).collect()}
    assert seen == {"See section 3 in Rules of transport", "see the Purpose section in Loans of clocks", "See the Rules of transport"}
    without = chunks.where("heading_path <> '1 Purpose'")
    assert {r["phrase"] for r in references.visible_edges(edges, without).collect()} == {"See the Rules of transport"}


def test_a_hop_goes_by_section(spark, graph):
    _, chunks, edges = graph
    ids = {(r["document_version_id"], r["heading_path"]): r["chunk_id"] for r in chunks.collect()}
    ranked = spark.createDataFrame([(1, ids["a", "1 Purpose"], 1), (1, ids["a", "3 Terms"], 2)], "q int, chunk_id string, rank int")
    open_ = chunks.where("access_policy_id = 'open'")
    got = [(r["chunk_id"], r["hop"], r["rank"]) for r in references.with_referenced(ranked, references.visible_edges(edges, open_), open_, ["q"]).orderBy("rank").collect()]
    assert got == [(ids["a", "1 Purpose"], 0, 1), (ids["a", "3 Terms"], 0, 2), (ids["b", "Section 3 Crates"], 1, 3)]


def random_corpus(seed):
    """Sections of numbered words with overlapping chunks, some unreadable, some linked as exceptions."""
    rng, chunks, texts = random.Random(seed), [], {}
    for d in "xyz":
        text, at = "", 0
        for s in range(3):
            open_ = rng.random() < 0.75
            start = len(text)
            words = [f"{d}{s}w{i}" for i in range(rng.randint(4, 30))]
            body = " ".join(words)
            text += body + "\n"
            n, i, made = 0, 0, []
            while i < len(words):
                j = min(len(words), i + rng.randint(2, 6))
                lo = start + len(" ".join(words[:i])) + (1 if i else 0)
                made.append((f"{d}{s}c{n}", d, s, n, lo, start + len(" ".join(words[:j])), open_))
                n, i = n + 1, j if j == len(words) or rng.random() < 0.6 else j - 1
            for k, c in enumerate(made):
                chunks.append((*c, [made[k + 1][0]] if k + 1 < len(made) and rng.random() < 0.3 else []))
        texts[d] = text
    return chunks, texts


def plain_pack(chosen, chunks, texts, links, budget, most):
    """The packed words of one question by kind, or None."""
    by_id = {c[0]: c for c in chunks}
    line = {(c[1], c[2], c[3]): c for c in chunks}
    readable = {c[0] for c in chunks if c[6]}
    steps = {}
    for cid, rank in chosen:
        if cid not in readable or rank > most:
            continue
        c = by_id[cid]
        steps.setdefault((0, rank, 0), []).append((c[1], c[4], c[5]))
        x = c
        while x[7]:
            x = line[x[1], x[2], x[3] + 1]
            steps.setdefault((0, rank, 1), []).append((x[1], x[4], x[5]))
        spans = lambda d, s: [(k[1], k[4], k[5]) for k in chunks if k[0] in readable and k[1] == d and (s is None or k[2] == s)]
        for a, b in links:
            if a == (c[1], c[2]) and spans(*b):
                steps.setdefault((1, rank), []).extend(spans(*b))
        steps.setdefault((2, rank), []).extend(spans(c[1], None))
    had, used, out = set(), 0, {}
    for step in sorted(steps):
        new = {(d, i) for d, lo, hi in steps[step] for i in range(lo, hi)} - had
        words = [w for d in texts for w in "".join(ch if (d, i) in new else " " for i, ch in enumerate(texts[d])).split()]
        if used + len(words) > budget:
            if step[0] == 0 and (step[2] == 1 or step == min(steps)):
                return None
            break
        used += len(words)
        had |= new
        out.setdefault(("evidence", "exception", "reference", "parent")[step[2] if step[0] == 0 else step[0] + 1], []).extend(words)
    return {k: sorted(v) for k, v in out.items() if v}


@pytest.mark.parametrize("seed", range(2))
def test_pack(spark, seed):
    chunks, texts = random_corpus(seed)
    rng = random.Random(seed + 100)
    rows = [(c[0], c[1], c[2], c[3], [(c[4], c[5])], c[4], c[5], c[7], c[6]) for c in chunks]
    kind = "chunk_id string, document_version_id string, section_ordinal int, chunk_ordinal int, spans array<struct<start:int,end:int>>, source_start int, source_end int, exception_refs array<string>, open boolean"
    every = spark.createDataFrame(rows, kind)
    links = [((a, s), (b, t)) for a in "xyz" for s in range(3) for b in "xyz" for t in range(3) if (a, s) != (b, t) and rng.random() < 0.15]
    edges = spark.createDataFrame([(a[0], a[1], b[0], b[1]) for a, b in links], "document_version_id string, section_ordinal int, dst_document string, dst_section int")
    chosen = {q: [(c, r) for r, c in enumerate(rng.sample([c[0] for c in chunks], 4), 1)] for q in range(12)}
    selected = spark.createDataFrame([(q, c, r) for q, x in chosen.items() for c, r in x], "q int, chunk_id string, rank int")
    sources = spark.createDataFrame(list(texts.items()), "document_version_id string, text string")
    for budget in (12, 500):
        out = evidence.pack(selected, every, every.where("open"), edges, sources, ["q"], budget, 3).collect()
        got, bad, spans = {}, set(), {}
        for r in out:
            if r["status"] == "answered":
                got.setdefault(r["q"], {}).setdefault(r["kind"], []).extend(r["text"].split())
                spans.setdefault(r["q"], []).append((r["document_version_id"], r["start"], r["stop"]))
                assert texts[r["document_version_id"]][r["start"] : r["stop"]] == r["text"] and r["used"] <= budget
            else:
                bad.add(r["q"])
        closed = {(c[1], i) for c in chunks if not c[6] for i in range(c[4], c[5])}
        for q, x in spans.items():
            places = [(d, i) for d, lo, hi in x for i in range(lo, hi)]
            assert len(places) == len(set(places)) and not closed & set(places)  # no byte twice, nothing restricted
        for q, x in chosen.items():
            wanted = plain_pack(x, chunks, texts, links, budget, 3)
            if wanted is None:
                assert q in bad
            else:
                assert {k: sorted(v) for k, v in got.get(q, {}).items()} == wanted and q not in bad


def test_an_unreadable_exception_is_missing(spark):
    kind = "chunk_id string, document_version_id string, section_ordinal int, chunk_ordinal int, spans array<struct<start:int,end:int>>, source_start int, source_end int, exception_refs array<string>"
    every = spark.createDataFrame([("1", "x", 0, 0, [(0, 4)], 0, 4, ["2"]), ("2", "x", 0, 1, [(5, 9)], 5, 9, [])], kind)
    none = spark.createDataFrame([], "document_version_id string, section_ordinal int, dst_document string, dst_section int")
    texts, selected = spark.createDataFrame([("x", "some more")], "document_version_id string, text string"), spark.createDataFrame([(1, "1", 1)], "q int, chunk_id string, rank int")
    whole, part = (evidence.pack(selected, every, x, none, texts, ["q"]).collect() for x in (every, every.where("chunk_id = '1'")))
    assert [(r["kind"], r["text"]) for r in sorted(whole, key=lambda r: r["start"])] == [("evidence", "some"), ("exception", "more")]
    assert [(r["status"], r["text"]) for r in part] == [("insufficient_evidence", None)]


def test_security_counters_find_planted_violations(spark):
    from vellum.operators import answers

    kind = "user_id string, mode string, question_id int, item_id int, rank int"
    decided = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("c", 1, True)], "user_id string, item_id int, allowed boolean")
    good = [("a", "vector", 1, 1, 1), ("a", "keyword", 1, 1, 1), ("c", "vector", 1, 1, 1), ("c", "keyword", 1, 1, 1)]
    users, modes = ["a", "b", "c"], ["vector", "keyword"]

    def failed(rows):
        return {(r["user_id"], r["mode"], r["disclosed"]) for r in answers.security_counters(spark.createDataFrame(rows, kind), decided, users, modes).collect() if not r["passed"]}

    assert failed(good) == set()
    assert failed([*good, ("a", "vector", 1, 2, 2)]) == {("a", "vector", 1)}  # forbidden
    assert failed([*good, ("a", "keyword", 1, 9, 2)]) == {("a", "keyword", 1)}  # without a decision
    assert failed([*good, ("b", "vector", 1, 1, 1)]) == {("b", "vector", 1)}
    assert failed(good[1:]) == {("a", "vector", 0)}  # starved


def test_clause_recall(spark):
    from vellum.operators import evaluation

    lists = spark.createDataFrame([("v", 1, 10, 1), ("v", 1, 11, 2), ("v", 1, 12, 6), ("k", 2, 10, 1)], "mode string, question_id int, item_id int, rank int")
    clauses = spark.createDataFrame([(1, 10, "a"), (1, 11, "a"), (1, 12, "b"), (1, 13, "c"), (2, 11, "a")], "question_id int, item_id int, clause string")
    got = {(r["mode"], r["question_id"]): (r["clauses"], round(r["recall_5"], 3), round(r["recall_20"], 3)) for r in evaluation.clause_recall(lists, clauses, ["mode"]).collect()}
    assert got == {("v", 1): (3, 0.333, 0.667), ("v", 2): (1, 0.0, 0.0), ("k", 1): (3, 0.0, 0.0), ("k", 2): (1, 0.0, 0.0)}
