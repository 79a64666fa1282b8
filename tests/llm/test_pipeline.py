"""The pipeline's stages, one after another, each against a plain version on its own input."""

import zlib

import numpy as np
import pyarrow.parquet as pq
from brute import contamination, join

import corpus_pipeline
from vellum.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    # Extra columns whose names the operators use themselves must pass through.
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS score", "'x' AS held_out", "2 AS taken", "3 AS component_id")
    odd = spark.createDataFrame([(9001, None, None, None, 0), (9002, "", "en", "src1", 0), (9003, "12 34 !", "en", None, 7)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs, after)
        if name != "token_output":
            assert after.columns == docs.columns and set(columns) <= set(after.columns)
        docs = after
    before, _, after = seen["language_id"]
    assert {r["doc_id"] for r in after.collect()} == {d for d, t in before.items() if any(c.isalpha() for c in t or "")}
    before, _, after = seen["near_duplicates"]
    assert {r["doc_id"] for r in after.collect()} == {c for _, c in join(list(before.items()), 5, 80, 100).values()}
    before, _, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    bad = contamination(list(before.items()), items)
    assert {r["doc_id"] for r in after.collect()} == {d for d in before if not bad[d][1]}
    before, _, after = seen["mixing"]
    mixed = after.collect()
    size = {d: len(t.split()) for d, t in before.items()}
    assert abs(sum(len(r["text"].split()) for r in mixed) - 1.5 * sum(size.values())) <= 20
    for r in mixed:
        assert r["text"] == before[r["doc_id"]] or r["text"] == " ".join(before[r["doc_id"]].split()[: len(r["text"].split())])
    model = Tokenizer.from_file(queries.default_tokenizer())
    _, docs, after = seen["token_output"]
    want = []
    for r in docs.collect():
        ids = [*model.encode(r["text"], add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    rows = after.orderBy("start").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"} and got.count() > 100
