"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import chat_format, decontaminate, exact_dedup, hmm_lm, language_id, lexical, merkle, mixing, ngram_join, substring_dedup, token_count, token_output, url_filter
from vellum.llm.common import scratch_root


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(_table(spark, sf_dir, "documents"), keep="largest")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(_table(spark, sf_dir, "conversations"))


def op4_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return hmm_lm.score(docs.withColumn("held_out", language_id.held_out(F.col("doc_id"), 7, 2)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


#: The rules of the URL query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = None
    for host, path, verdict in URL_RULES:  # literals, so that no Python runs on executors
        row = spark.range(1).select(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict"))
        rules = row if rules is None else rules.union(row)
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).drop("source")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), places_too=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def default_tokenizer() -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))


def op10_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write(_table(spark, sf_dir, "documents"), path, tokenizer or default_tokenizer())
    return token_output.index(spark, path)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = os.fspath(public_tokenizers.path("piece_bpe_32k.model"))
    return token_count.counts(_table(spark, sf_dir, "documents"), model)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (
        op1_exact_dedup, op2_ngram_join, op3_chat_format, op4_hmm_score, op5_language_id, op6_url_filter, op7_mixing,
        op8_decontaminate, op9_substring_dedup, op10_token_output, op11_lexical_search, op12_token_counts, op13_merkle_manifest)}


_URL_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS n
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM h LEFT JOIN f ON f.page_id = h.page_id AND f.n = 1
"""

_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM c WHERE speaker <> 'system'),
s AS (
  SELECT c.conv_id, perspective, turn, speaker, body, speaker = perspective AS trained,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
         '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
           ELSE 'user name="' || replace(replace(replace(replace(replace(speaker, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), '<|', '<\|') || '"' END || chr(10) AS head
  FROM c JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM s),
o AS (
  SELECT *, row_number() OVER w - 1 AS segment,
         coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg_start
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, segment, turn, speaker, role, rendered, seg_start, seg_start + length(rendered) AS seg_end,
       CASE WHEN trained THEN seg_start + length(head) END AS mask_start,
       CASE WHEN trained THEN seg_start + length(rendered) - 1 END AS mask_end, trained
FROM o
"""

_DECON_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, spots.n, i, item_id FROM spots JOIN win ON win.n = spots.n AND win.s = spots.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, sha256('mix:' || doc_id::VARCHAR) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0 * source_size AS cap FROM s),
b AS (SELECT 1.5 * sum(source_size)::DOUBLE AS budget FROM s),
levels AS (  -- the level that spends the budget if exactly the sources below a cap/weight stop at their caps
  SELECT x.cap / x.weight AS c,
         ((SELECT budget FROM b) - coalesce((SELECT sum(y.cap) FROM w y WHERE y.cap / y.weight < x.cap / x.weight), 0))
         / (SELECT sum(y.weight) FROM w y WHERE y.cap / y.weight >= x.cap / x.weight) AS level FROM w x),
l AS (SELECT arg_min(level, c) AS level FROM levels WHERE c >= level),
t AS (SELECT w.source, source_size, least(cap, coalesce(weight * (SELECT level FROM l), cap))::DOUBLE AS target FROM w),
p AS (
  SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""


_SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
p AS (SELECT doc_id, t, size, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS size, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY t, n),
g AS (SELECT item_id, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // l))))::BIGINT AS score FROM p JOIN f USING (t) JOIN b USING (t), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM g WHERE score > 0 QUALIFY rank <= 20
"""


def _tree_sql(levels: int) -> str:
    """Eight by eight, so many times: nodes a level (n), and each leaf's path; finished trees pass through."""
    out = []
    for name, leaves in (("a", "leaves"), ("t", "groups")):
        out.append(f"{name}0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM {leaves})")
        for i in range(levels):
            out.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM (
  SELECT tree, idx // 8 AS idx, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END AS digest FROM {name}{i} GROUP BY tree, idx // 8))""")
        if name == "a":
            out.append(f"groups AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, tree AS own, digest FROM a{levels})")
    return ",\n".join(out)


def _fold_sql(levels: int) -> str:
    """Each row's way up: its hash so far and the siblings met."""
    out, before = [], "SELECT row_id, tree, idx, coalesce(changed, leaf) AS acc, '' AS proof, NULL AS subroot FROM rows"
    for name in ("a", "t"):
        for i in range(levels):
            out.append(f"""f{name}{i} AS (SELECT row_id, any_value(x.tree) AS tree, any_value(x.idx // 8) AS idx, any_value(subroot) AS subroot,
  CASE WHEN any_value(n.size) > 1 THEN sha256(string_agg(CASE WHEN n.idx = x.idx THEN x.acc ELSE n.digest END, '' ORDER BY n.idx)) ELSE any_value(x.acc) END AS acc,
  any_value(x.proof) || coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (WHERE n.idx <> x.idx), '') AS proof
  FROM ({before}) x JOIN {name}{i} n ON n.tree = x.tree AND n.idx // 8 = x.idx // 8 GROUP BY row_id)""")
            before = f"SELECT * FROM f{name}{i}"
        before = f"SELECT row_id, '' AS tree, g.idx, acc, proof, g.digest AS subroot FROM f{name}{levels - 1} f JOIN groups g ON g.own = f.tree"
    return ",\n".join(out)


_FIELDS_SQL = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_CRC_SQL = """xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)) + z, xor(c, b)), 4294967295), 4294967295)"""
_MERKLE_SQL = f"""
WITH rows AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row_id, coalesce('v' || lang, 'n') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, sha256({_FIELDS_SQL.replace("{text}", "text")}) AS leaf,
    CASE WHEN {_CRC_SQL} % 3 = 0 THEN sha256({_FIELDS_SQL.replace("{text}", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed FROM documents),
leaves AS (SELECT tree, idx, leaf AS digest FROM rows),
{_tree_sql(9)},
{_fold_sql(9)}
SELECT doc_id, leaf, subroot, (SELECT any_value(digest) FROM t9) AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = (SELECT any_value(digest) FROM t9) AS verified FROM ft8 JOIN rows USING (row_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": _DEDUP_SQL, "op3_chat_format": _CHAT_SQL, "op6_url_filter": _URL_SQL, "op7_mixing": _MIX_SQL, "op8_decontaminate": _DECON_SQL,
        "op11_lexical_search": _SEARCH_SQL, "op13_merkle_manifest": _MERKLE_SQL}
