"""Governance, retrieval, versions, sources, streaming, and the shapes of plans."""

import hashlib
import struct

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import vectors
from vellum.operators import evaluation, graph, quality, retrieval, versions
from vellum.plans import catalogue
from vellum.sources import corpus, vocabulary
from vellum.sources.generations import GenerationStore, fingerprint, retire, upsert
from vellum.streaming.ingest import activity_windows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_access_matrix(spark):
    got = {(r["user_id"], r["policy_id"]) for r in catalogue.acl_matrix(spark, SF).where("allowed").collect()}
    here = {"ada", "ben", "cleo", "dov", "eve", "fay", "gil"}  # active and entitled to the corpus
    want = {(u, "open") for u in here} | {(u, "staff") for u in here - {"fay"}}
    assert got == want | {("ben", "store"), ("eve", "store"), ("dov", "ledger")}


def test_explicit_deny_and_missing_rules_deny(spark):
    from vellum.functions.access import allow

    kind = "classification string, allowed_roles array<string>, department_ids array<string>, allowed_users array<string>, denied_users array<string>"
    rules = spark.createDataFrame([("public", None, None, None, ["fay"]), ("secret", None, None, None, None), (None, None, None, None, None), ("public", None, None, None, None)], kind)
    rows = rules.select(F.struct("*").alias("p")).crossJoin(catalogue.principals(spark).where("user_id = 'fay'").select(F.struct("*").alias("u")))
    ok = [r[0] for r in rows.select(allow("u", F.lit("core"), F.lit("museum"), "p")).collect()]
    assert ok == [False, False, False, True]
    assert not rows.where(allow("u", F.lit("other"), F.lit("museum"), "p") | allow("u", F.lit("core"), F.lit("else"), "p") | allow("u", F.lit(None).cast("string"), F.lit("museum"), "p")).count()


def test_authorization_stands_below_the_limit(spark):
    ranked = catalogue._hybrid_lists(spark, SF)[0]
    tree = plan(ranked)
    assert "MapInArrow" in tree
    assert tree.index("WindowGroupLimit") < tree.index("LeftSemi")


def test_scans_read_only_what_they_use(spark):
    text = catalogue.corpus_summary(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string,source:string>" in text


def test_questions_in_blocks_get_the_same_answers(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "item_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "question_id long, vector array<float>")
    one, many = (sorted(map(tuple, retrieval.nearest(vectors, asked, 3, most=n).collect())) for n in (1 << 20, 500))
    assert one == many and len(one) == 120


def test_vectors_against_a_plain_version(spark):
    import random

    rng = random.Random(4)
    vectors = [(f"i{i:03}", [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(3)]) for i in range(80)]
    odd = [("null", None), ("part", [1.0, None, 1.0]), ("nan", [1.0, float("nan"), 1.0]), ("short", [1.0, 1.0]), ("none", [])]
    asked = [(q, [rng.choice([0.5, -0.5, 1.0]) for _ in range(3)]) for q in range(9)] + [(90, [1.0, 0.0]), (91, None)]
    df = spark.createDataFrame(vectors + odd, "item_id string, embedding array<float>").repartition(5)
    got = {}
    for r in retrieval.nearest(df, spark.createDataFrame(asked, "question_id long, vector array<float>"), 7).collect():
        got.setdefault(r["question_id"], []).append((r["rank"], r["item_id"], r["score"]))
    want = {}
    for q, v in asked[:-1]:
        scored = sorted((-round(sum(a * b for a, b in zip(v, x, strict=True)), 6), i) for i, x in vectors + odd if x is not None and len(x) == len(v) and all(a is not None and a == a for a in x))
        want[q] = [(n, i, -s) for n, (s, i) in enumerate(scored[:7], 1)]
    assert {q: sorted(x) for q, x in got.items()} == want and want[90] == [(1, "short", 1.0)]


def test_keyword_scores_against_a_plain_version(spark):
    import random
    import re

    rng = random.Random(3)
    vocab = ["a", "no", "Not", "kg", "2.1", "32", "b-12", "Ünit", "IATA", "12/a"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 12))) for _ in range(50)] + [None, "", "concatenated"]
    asked = [" ".join(rng.choices(vocab, k=rng.randint(1, 4))) for _ in range(25)] + [None, "", "?!", "cat", "concatenated"]
    token = re.compile(r"[^\W_]*\d[^\W_]*(?:[.\-/][^\W_]+)*|[^\W_]+")
    want = {}
    for q, question in enumerate(asked):
        scored = []
        for d, text in enumerate(texts):
            both = set(token.findall((question or "").lower())) & set(token.findall((text or "").lower()))
            score = sum(5 if re.search(r"\d", t) else 1 for t in both)
            if score:
                scored.append((-(score + 10 * ((question or "").lower() in text.lower())), d))
        want |= {(q, d): (-s, i + 1) for i, (s, d) in enumerate(sorted(scored)[:4])}
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(3)
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    for most in (1 << 20, 300):
        got = retrieval.keyword_top(items, questions, 4, most=most).collect()
        assert {(r["question_id"], r["item_id"]): (r["score"], r["rank"]) for r in got} == want


def test_fusion_breaks_ties_by_id_and_moves_are_kept(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "q long, item long, rank int")
    b = spark.createDataFrame([(1, 6, 1), (1, 5, 2), (1, 7, 3)], "q long, item long, rank int")
    fused = retrieval.rrf([a, b], ["q"], "item").orderBy("rank").collect()
    assert [r["item"] for r in fused] == [5, 6, 7] and abs(fused[0]["score"] - (1 / 61 + 1 / 62)) < 1e-9
    moved = retrieval.rerank(retrieval.rrf([a, b], ["q"], "item"), ["q"], "item", F.col("item"), 2).orderBy("after").collect()
    assert [(r["item"], r["before"], r["moved"]) for r in moved] == [(7, 3, 2), (6, 2, 0)]
    assert [r["item"] for r in retrieval.union_capped([a, b], ["q"], "item", 2).orderBy("position").collect()] == [5, 6]


def test_budget_is_a_strict_prefix(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 1)], "q long, rank int, tokens long")
    assert [r["rank"] for r in retrieval.within_budget(df, ["q"], ["rank"], "tokens", 10).collect()] == [1]


def test_vector_checks(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([float("nan"), 0.0],), ([1.0],), (None,), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.is_valid(F.col("v"), 2)).collect()] == [True, False, False, False, False]
    assert spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] is None


def test_hop_needs_permission_at_both_ends(spark):
    nodes = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "id string, open boolean")
    edges = spark.createDataFrame([("a", "b", "X", "validated"), ("a", "c", "X", "validated"), ("a", "d", "X", "draft"), ("c", "b", "X", "validated"), ("a", "b", "Y", "validated")], "src string, dst string, type string, validation_status string")
    seeds = spark.createDataFrame([("a",), ("c",)], "seed string")
    assert [(r["seed"], r["neighbour"]) for r in graph.one_hop(seeds, edges, nodes, ["X"], 10, F.col("open")).collect()] == [("a", "b")]


def test_versions(spark):
    v = spark.createDataFrame([("p", 1, "2025-01-01", "2025-06-30", 30), ("p", 2, "2025-07-01", None, 10)], "policy string, version int, f string, t string, minutes int").selectExpr("policy", "version", "date(f) f", "date(t) t", "minutes")
    day = F.to_date(F.lit("2025-08-01"))
    assert versions.as_of(v, "policy", "f", "version", day).first()["version"] == 2
    assert [r["version"] for r in v.where(versions.in_force(F.col("f"), F.col("t"), day)).collect()] == [2]
    assert [(r["supersedes"], r["superseded_by"]) for r in versions.chain(v, "policy", ["f"], "version").orderBy("version").collect()] == [(None, 2), (1, None)]
    assert versions.conflicts(v, "policy", "version", "minutes").count() == 1
    unknown = spark.range(1).select(versions.in_force(F.lit(None).cast("date"), F.lit(None).cast("date"), day, F.lit(True)), versions.in_force(F.lit(None).cast("date"), F.lit(None).cast("date"), day))
    assert tuple(unknown.first()) == (True, False)


def test_evaluation(spark):
    got = spark.range(1).select(
        evaluation.recall(F.array(F.lit(1), F.lit(1), F.lit(2)), F.array(F.array(F.lit(1), F.lit(3)), F.array(F.lit(4)))),
        evaluation.recall(F.array(F.lit(1)), F.array().cast("array<array<int>>")),
        evaluation.case_passes(F.lit("a"), F.lit("a"), F.array(F.lit("x")), F.array(F.lit("y")), F.lit("x z")),
        evaluation.status(F.lit(3), F.lit(0), F.lit(0), F.lit(True))).first()
    assert tuple(got) == (0.5, None, True, "insufficient_evidence")


def write_corpus(tmp_path, tamper=False):
    text = "Lamp Rules\n1. Purpose\nLamps stay off at night.\n"
    (tmp_path / "data").mkdir()
    (tmp_path / "data/a.txt").write_text(text)
    (tmp_path / "data/README.md").write_text("not listed")
    digest = hashlib.sha256(text.encode()).hexdigest() if not tamper else "0" * 64
    entry = f'{{"corpus_id": "maps", "policy_issuer": "Museum", "path": "a.txt", "sha256": "{digest}", "effective_from": null, "classification": "public", "access_policy_id": "public"}}'
    (tmp_path / "m.json").write_text(f'{{\n"tenant_id": "museum", "allowlist_only": true,\n"documents": [{entry}]}}')
    return str(tmp_path / "m.json"), str(tmp_path / "data"), digest


def test_corpus_from_manifest_to_jsonl(spark, tmp_path):
    from vellum.operators.chunking import chunk_documents

    manifest, root, digest = write_corpus(tmp_path)
    docs = corpus.documents(spark, corpus.manifest(spark, manifest), root).withColumn("document_title", F.lit("Lamp Rules")).cache()
    assert [(r["corpus_id"], r["document_version_id"], r["effective_from"]) for r in docs.collect()] == [("maps", f"maps:{digest[:12]}", None)]
    chunks = chunk_documents(docs)
    records = corpus.chunk_records(chunks, docs)
    corpus.write_jsonl(records, str(tmp_path / "out"))
    lines = [x for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    assert len(lines) == 2 and all('"continuation_of":null' in x for x in lines) and len(records.columns) == 18
    s = corpus.summary(chunks, docs).first()
    assert (s["children"], s["sections"], s["max_child_tokens"], s["over_max"], s["headings"]) == (2, 2, 5, [], ["1 Purpose", "Lamp Rules"])


def test_changed_file_fails(spark, tmp_path):
    manifest, root, _ = write_corpus(tmp_path, tamper=True)
    with pytest.raises(Exception, match="checksum mismatch"):
        corpus.documents(spark, corpus.manifest(spark, manifest), root).collect()


def test_generations(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "g"))
    assert store.read() is None
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, v long, x string")
    two = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "k long, v long, x string")
    store.publish(one, "g1")
    with pytest.raises(ValueError):
        store.publish(two, "bad", lambda df: df.count() == 99)
    assert store.current() == "g1"
    store.publish(upsert(store.read(), two, "k", ["v"]), "g2")
    assert sorted(tuple(r) for r in store.read().select("k", "v", "x").collect()) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    again = upsert(store.read().select("k", "v", "x"), two, "k", ["v"])
    assert again.exceptAll(store.read().select("k", "v", "x")).count() == 0
    assert retire(store.read(), two, "k").count() == 2
    store.rollback("g1")
    assert store.read().count() == 2
    assert fingerprint(one, "x") == fingerprint(one.orderBy(F.desc("x")), "x") != fingerprint(two, "x")


def gguf(entries):
    def text(s):
        return struct.pack("<Q", len(s.encode())) + s.encode()

    out = b"GGUF" + struct.pack("<IQQ", 3, 0, len(entries))
    for key, kind, values in entries:
        body = {8: text, 6: lambda v: struct.pack("<f", v), 5: lambda v: struct.pack("<i", v)}[kind]
        out += text(key) + struct.pack("<IIQ", 9, kind, len(values)) + b"".join(map(body, values))
    return out


def test_subword_vocabulary(spark):
    tokens = [f"<0x{i:02X}>" for i in range(256)] + list("Helowrd▁th") + ["He", "ll", "Hell", "Hello", "▁w", "▁wo", "rl", "rld", "▁world", "th", "the", "unused"]
    kinds = [6] * 256 + [1] * (len(tokens) - 257) + [3]
    scores = [0.0] * 266 + [float(i) for i in range(len(tokens) - 266)]
    meta = vocabulary.read_metadata(gguf([("tokenizer.ggml.tokens", 8, tokens), ("tokenizer.ggml.scores", 6, scores), ("tokenizer.ggml.token_type", 5, kinds)]))
    vocab = vocabulary.vocabulary(meta)
    assert "unused" not in vocab.scores
    df = spark.createDataFrame([("Hello world",), ("the",), ("  ",), ("é",), (None,)], "t string")
    assert [r[0] for r in df.select(vocabulary.subword_count(spark, vocab)(F.col("t"))).collect()][1:] == [1, 0, 2, 0]
    assert vocabulary.encode("Hello", vocab) == ["Hello"]
    with pytest.raises(ValueError):
        vocabulary.vocabulary(meta | {"tokenizer.ggml.token_type": [1] * len(tokens)})


def test_stream_gives_the_batch_result(spark):
    got = catalogue.incremental_ingest_stream(spark, SF)
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id")
    assert got.select("user_id", "event_id").exceptAll(want).count() == 0 and got.count() == want.count()


def test_windows_on_a_stream(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = activity_windows(spark.readStream.schema(schema).parquet(f"{SF}/event[s].parquet")).select("window.start", "event_type", "n")
    run = stream.writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.sql("select sum(n) from activity").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_findings(spark):
    one = spark.createDataFrame([(1,), (2,)], "a long")
    assert sorted(tuple(r) for r in quality.findings(x=one, y=one.limit(0)).collect()) == [("x", "1"), ("x", "2")]


def test_entry_without_the_training_data_package(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "vellum", tmp_path / "vellum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_rrf' in q and not any(k.startswith('op1') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_batches_write_only_their_buckets(spark, tmp_path):
    from vellum.sources.generations import BucketedStore

    store = BucketedStore(spark, str(tmp_path / "s"), "id", 8)
    first = spark.createDataFrame([(i, 0, "a") for i in range(40)], "id long, n long, v string")
    store.merge(first, ["n"], "b0")
    store.merge(spark.createDataFrame([(3, 1, "b"), (3, 2, "c"), (99, 1, "d"), (4, -1, "old")], "id long, n long, v string"), ["n"], "b1")
    store.merge(spark.createDataFrame([(3, 9, "again")], "id long, n long, v string"), ["n"], "b1")  # a batch that is repeated
    got = {r["id"]: r["v"] for r in store.read().collect()}
    assert got == {i: "a" for i in range(40)} | {3: "c", 99: "d"}
    assert store.log().where("generation = 'b1'").count() <= 3 < store.log().where("generation = 'b0'").count()


def test_running_sums_with_further_columns(spark, tmp_path):
    """More columns than the sum needs, read from files, in many ranges: all uses of a range must agree on its bounds."""
    from vellum.functions.running import running_sum

    rows = spark.range(60_000).selectExpr("id % 3 as g", "id div 3 as i", "id % 11 as v", "uuid() as more", "repeat('x', 50) as most").repartition(7)
    rows.write.parquet(str(tmp_path / "rows"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        out = running_sum(spark.read.parquet(str(tmp_path / "rows")), ["g"], ["i"], "v", "s")
        exact = F.sum("v").over(Window.partitionBy("g").orderBy("i"))
        assert out.columns == ["g", "i", "v", "more", "most", "s"] and out.withColumn("w", exact).where("s <> w").count() == 0 and out.count() == 60_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_sums_cross_ranges(spark):
    from vellum.functions.running import running_sum

    rows = [(g, i, (i * 7) % 5) for g in ("a", None) for i in range(200)] + [("b", 0, 3)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {(r["g"], r["i"]): r["s"] for r in running_sum(df, ["g"], ["i"], "v", "s").collect()}
    assert len(got) == 401 and all(s == (3 if g == "b" else sum((j * 7) % 5 for j in range(i + 1))) for (g, i), s in got.items())


def test_answer_checks(spark):
    from vellum.functions import checks
    from vellum.operators import answers

    text = "Up to 2.5 kg, 30% or 12 days; at 7:15, never 3,5m."
    assert spark.range(1).select(checks.quantities(F.lit(text))).first()[0] == ["2.5kg", "30%", "12days", "7", "15", "3,5m"]
    assert [spark.range(1).select(checks.negated(F.lit(t))).first()[0] for t in ("It isn't so", "A knot", "No", None)] == [True, False, True, False]
    claims = spark.createDataFrame([(1, 1, "It is 5 kg."), (1, 2, "It is 6 kg."), (1, 3, "Plain."), (1, 4, "Plain.")], "answer_id long, claim long, text string")
    cited = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 4, "nowhere")], "answer_id long, claim long, chunk_id string")
    evidence = spark.createDataFrame([(1, "x", "Five: 5 kg")], "answer_id long, chunk_id string, text string")
    got = {r["claim"]: tuple(r)[2:] for r in answers.supported(claims, cited, evidence).collect()}
    assert got == {1: (1, 0, 0, True), 2: (1, 0, 1, False), 3: (0, 0, 0, False), 4: (1, 1, 0, False)}


def test_merges_are_those_of_the_plain_loop():
    import random

    rng = random.Random(8)
    scores = {c: -50.0 for c in "abc▁"} | {"".join(rng.choices("abc▁", k=rng.randint(2, 5))): -float(rng.randint(1, 9)) for _ in range(60)}
    vocab = vocabulary.Vocabulary(scores, frozenset())

    def plain(text):
        parts = list(text.replace(" ", "▁"))
        while pairs := [(-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    for _ in range(300):
        text = "".join(rng.choices("abc ", k=rng.randint(1, 40)))
        if text.strip():
            assert vocabulary.encode(text, vocab) == plain(text)


def test_the_first_stage_that_loses_the_evidence(spark):
    """Every stage occurs, and what is kept everywhere is kept."""
    stages = ["ingest", "chunk", "authorize", "rank", "fuse", "rerank", "pack"]
    flags = [[j < i for j in range(7)] for i in range(8)] + [[True, True, True, False, True, True, True]]
    kind = "question_id int, item_id int, " + ", ".join(f"{s} boolean" for s in stages)
    clean = spark.createDataFrame([(1, i, *[True] * 7) for i in range(len(flags) + 1)] + [(1, 99, *[True] * 6, False)], kind)
    damaged = spark.createDataFrame([(1, i, *f) for i, f in enumerate(flags)], kind)
    got = {r["item_id"]: r["lost_at"] for r in evaluation.lost_at(clean, damaged, ["question_id", "item_id"], stages).collect()}
    assert got == dict(enumerate([*stages, "kept", "rank", "ingest"]))
