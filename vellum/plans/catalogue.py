"""The engine's own queries over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import access, checks, ids, vectors
from vellum.functions import text as T
from vellum.functions.staging import staged
from vellum.functions.tokenizers import QUADS, WORDS
from vellum.operators import answers, chunking, evaluation, evidence, graph, quality, references, requests, retrieval, versions
from vellum.sources import generations

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most: int = 1 << 30) -> DataFrame:
    """A table below ``most`` bytes, which may be one row group, dealt over all cores; a larger one is read as it lies."""
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < most
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


# ---------------------------------------------------------------- text and chunking


@query("""SELECT doc_id, sha256(text) AS sha256, doc_id % 2 = 0 AS verified FROM documents""")
def doc_hash_gate(spark, sf):
    """Checksums against a manifest; here every odd document's expected sum is of a changed text."""
    docs = table(spark, sf, "documents").withColumn("sha256", F.sha2("text", 256))
    expected = F.when(F.col("doc_id") % 2 == 0, F.col("sha256")).otherwise(F.sha2(F.concat("text", F.lit(" ")), 256))
    return docs.select("doc_id", "sha256", (F.col("sha256") == expected).alias("verified"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS tokens FROM documents""")
def word_token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("tokens"))


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+([A-Z0-9"“])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda s: regexp_replace(s, '\s+$', '')), lambda s: s <> '')"""
_SENT = _SENTENCES.replace("{t}", "text")


@query(f"""SELECT doc_id, i - 1 AS ordinal, s[i] AS sentence FROM (SELECT doc_id, {_SENT} AS s FROM documents), unnest(generate_series(1, len(s))) AS g(i)""")
def sentence_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ordinal", "sentence"))
    return docs.withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"""SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, {_SENT} AS s FROM documents)""")
def sentence_stats(spark, sf):
    s = T.sentences(F.col("text"))
    longest = F.array_max(F.transform(s, lambda x: F.length(x)))
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n"), longest.cast("long").alias("longest"))


def structured(docs: DataFrame) -> DataFrame:
    """Documents with headings around their text, as policy documents have them, and a table of some forty to seventy rows."""
    row = lambda i: F.concat(F.lit("| "), F.col("source"), F.lit(" room "), i, F.lit(" | "), i, F.lit(" kg |"))
    rows = F.transform(F.sequence(F.lit(1).cast("long"), 40 + F.col("doc_id") % 30), row)
    text = F.concat(
        F.lit("Manual "), F.col("doc_id"), F.lit("\n1. Purpose\n"), F.col("text"), F.lit("\nFor loads see section 7 of this one. Unless the list of "), F.col("source"),
        F.lit(" and of the rooms that it names" * 20 + " says otherwise.\n2.1 Review Steps\n2.5 kg is a limit, not a title.\nsee it\n"),
        F.lit("Section 3 – Limits\n# Notes\nKeep the "), F.col("source"), F.lit(" file.\n4. this is no heading\n# neither is this\nSection 5 - nor that.\n"),
        F.lit("7. Weights\nBy room. See section 7 in Manual "), F.col("doc_id") + 1, F.lit(". Exception applies as stated, refer to 1 Purpose of this one. For checks see the Review Steps first. Or refer to 9 Nowhere.\n\n| Room | Weight |\n|---|:--:|\n"),
        F.array_join(rows, "\n"), F.lit("\nRooms not named take nothing. Unless the vault is open.\n\nAll weights are net.\n"))
    return docs.select(
        F.col("doc_id").cast("string").alias("document_version_id"), F.concat(F.lit("Manual "), F.col("doc_id")).alias("document_title"),
        F.lit("internal").alias("access_policy_id"), text.alias("text"), F.create_map(F.lit("2.1 Review Steps"), F.lit("restricted")).alias("access_by_heading"))


_LINES = r"""
WITH t AS (
  SELECT doc_id, 'Manual ' || doc_id || chr(10) || '1. Purpose' || chr(10) || text || chr(10) || 'For loads see section 7 of this one. Unless the list of ' || source || repeat(' and of the rooms that it names', 20) || ' says otherwise.' || chr(10) || '2.1 Review Steps' || chr(10) || '2.5 kg is a limit, not a title.' || chr(10)
    || 'see it' || chr(10) || 'Section 3 – Limits' || chr(10) || '# Notes' || chr(10) || 'Keep the ' || source || ' file.' || chr(10) || '4. this is no heading' || chr(10) || '# neither is this' || chr(10) || 'Section 5 - nor that.' || chr(10)
    || '7. Weights' || chr(10) || 'By room. See section 7 in Manual ' || (doc_id + 1) || '. Exception applies as stated, refer to 1 Purpose of this one. For checks see the Review Steps first. Or refer to 9 Nowhere.' || chr(10) || chr(10) || '| Room | Weight |' || chr(10) || '|---|:--:|' || chr(10)
    || array_to_string(list_transform(generate_series(1, 40 + doc_id % 30), lambda i: '| ' || source || ' room ' || i || ' | ' || i || ' kg |'), chr(10)) || chr(10) || 'Rooms not named take nothing. Unless the vault is open.' || chr(10) || chr(10) || 'All weights are net.' || chr(10) AS text FROM documents),
l AS (SELECT doc_id, text, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS pos
      FROM (SELECT doc_id, text, s, unnest(generate_series(1, len(s))) AS i, s[i] AS line FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM t))),
m AS (SELECT *, regexp_extract(line, '^(#{1,6})\s+(\S.*?)\s*$', 2) AS md, regexp_extract(line, '^Section\s+(\d+)\s+[–—-]\s+(\S.*?)\s*$', 1) AS sn,
        regexp_extract(line, '^Section\s+(\d+)\s+[–—-]\s+(\S.*?)\s*$', 2) AS st,
        regexp_extract(line, '^(\d+(?:\.\d+)*)\.\s+(\S.*?)\s*$', 1) AS dn, regexp_extract(line, '^(\d+(?:\.\d+)*)\.\s+(\S.*?)\s*$', 2) AS dt,
        regexp_extract(line, '^(\d+\.\d+(?:\.\d+)*)\s+(\S.*?)\s*$', 1) AS bn, regexp_extract(line, '^(\d+\.\d+(?:\.\d+)*)\s+(\S.*?)\s*$', 2) AS bt FROM l),
h AS (SELECT doc_id, text, pos, line, CASE WHEN md <> '' AND {title_md} THEN md WHEN st <> '' AND {title_st} THEN 'Section ' || sn || ' ' || st
        WHEN dt <> '' AND {title_dt} THEN dn || ' ' || dt WHEN bt <> '' AND {title_bt} THEN bn || ' ' || bt END AS heading FROM m)
"""
_TITLE = r"""(len(regexp_extract_all({x}, '\S+')) BETWEEN 1 AND 12 AND length({x}) <= 80 AND right({x}, 1) NOT IN ('.', ':', ';') AND regexp_matches({x}, '^\p{Lu}'))"""
for _x in ("md", "st", "dt", "bt"):
    _LINES = _LINES.replace(f"{{title_{_x}}}", _TITLE.replace("{x}", _x))


@query(_LINES + "SELECT doc_id::VARCHAR AS document_version_id, pos::BIGINT AS \"at\", heading FROM h WHERE heading IS NOT NULL")
def heading_detect(spark, sf):
    lines = structured(table(spark, sf, "documents")).select("document_version_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    before = Window.partitionBy("document_version_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))
    return lines.select("document_version_id", "at", T.heading(F.col("line")).alias("heading")).where("heading is not null")


_BODIES = _LINES + """,
b AS (SELECT doc_id, text, pos, heading, pos + length(line) + 1 AS body, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(text)) AS stop FROM h WHERE heading IS NOT NULL),
s AS (SELECT doc_id, 0 AS section_ordinal, 'Manual ' || doc_id AS heading, 0 AS body_start, (SELECT min(pos) FROM b WHERE b.doc_id = t.doc_id) AS body_end, 'internal' AS access_policy_id, text FROM t
      UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos), heading, body, stop, CASE heading WHEN '2.1 Review Steps' THEN 'restricted' ELSE 'internal' END, text FROM b)
"""


@query(_BODIES + "SELECT doc_id::VARCHAR AS document_version_id, section_ordinal, heading, body_start::BIGINT AS body_start, body_end::BIGINT AS body_end, substr(text, (body_start + 1)::BIGINT, (body_end - body_start)::BIGINT) AS body FROM s")
def section_bodies(spark, sf):
    out = chunking.sections(structured(table(spark, sf, "documents")))
    return out.select("document_version_id", F.col("section_ordinal").cast("long"), "heading", F.col("body_start").cast("long"), F.col("body_end").cast("long"), "body")


@query(_BODIES + "SELECT doc_id::VARCHAR AS document_version_id, heading, access_policy_id FROM s")
def section_access_override(spark, sf):
    return chunking.sections(structured(table(spark, sf, "documents"))).select("document_version_id", "heading", "access_policy_id")


@query("SELECT doc_id, i - 1 AS n, l[i] AS line, " + _TITLE.replace("{x}", "l[i]") + " AS is_title FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) AS g(i)")
def title_predicate(spark, sf):
    """Every line of every text: might it be a title?"""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("doc_id", F.col("n").cast("long").alias("n"), "line", T.is_title(F.col("line")).alias("is_title"))


_CFG = ids.fingerprint(ids.Limits())
#: The same in SQL, from its text.
_CFG_SQL = """sha256('{"max_tokens":400,"overlap_tokens":50,"strategy":"section-aware-parent-child","target_tokens":300,"tokenizer":"word-v1"}')"""


@query(f"""SELECT doc_id, sha256(source || ':' || substr(sha256(text), 1, 12) || '|0:' || length(text) || '|0|' || {_CFG_SQL}) AS chunk_id, {_CFG_SQL} AS config FROM documents""")
def chunk_ids(spark, sf):
    version = ids.document_version_id(F.col("source"), F.sha2("text", 256))
    spans = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    return table(spark, sf, "documents").select("doc_id", ids.chunk_id(version, spans, F.lit(0), _CFG).alias("chunk_id"), F.lit(_CFG).alias("config"))


#: What the SQL counts: a text's size, tokens of a size, the size of what joins two texts, and the size between two places.
_WORDS = r"len(regexp_extract_all({x}, '\S+'))"
_MEASURES = {
    "word-v1": {"size": r"len(regexp_extract_all({x}, '\S+'))", "tok": "({x})", "gap": "0", "tail": "list_sum(list_transform(f.sents[j:], lambda y: y.size))",
                "back": "list_sum(list_transform(tail, lambda y: y.size))", "both": "list_sum(list_transform(tail, lambda y: y.size)) + size"},
    "chars-4": {"size": "length({x})", "tok": "(({x} + 3) // 4)", "gap": "1", "tail": "(f.e - x.a)", "back": "(a - tail[1].a)", "both": "(e - tail[1].a)"}}
_SLICES = {
    "word-v1": r"""sl AS (SELECT doc_id, section_ordinal, i, part, a + length(array_to_string(v[1:part * 400], '')) AS a, a + length(array_to_string(v[1:(part + 1) * 400], '')) AS e
  FROM (SELECT *, unnest(generate_series(0, (len(v) - 1) // 400)) AS part FROM (SELECT doc_id, section_ordinal, i, a, regexp_extract_all(t, '\s*\S+\s*') AS v FROM u WHERE kind = 'slice')))""",
    "chars-4": r"""sl0 AS (
  SELECT doc_id, section_ordinal, i, -1 AS part, 0::BIGINT AS a, 0::BIGINT AS e, a AS next, t AS rest FROM u WHERE kind = 'slice'
  UNION ALL
  SELECT doc_id, section_ordinal, i, part + 1, next, next + k, next + length(rest) - length(regexp_replace(substr(rest, k + 1), '^\s+', '')), regexp_replace(substr(rest, k + 1), '^\s+', '')
  FROM (SELECT *, CASE WHEN n < length(rest) AND NOT regexp_matches(substr(rest, n, 1), '\s') AND contains(substr(rest, 1, n), ' ') AND n - strpos(reverse(substr(rest, 1, n)), ' ') > 0
      THEN n - strpos(reverse(substr(rest, 1, n)), ' ') ELSE n END AS k FROM (SELECT *, least(1600, length(rest)) AS n FROM sl0 WHERE rest <> ''))),
sl AS (SELECT doc_id, section_ordinal, i, part, a, e FROM sl0 WHERE part >= 0)"""}
_RULE_SQL = r"'^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$'"
_ROW_SQL = r"'^\s*\|.+\|\s*$'"


def _chunks_sql(tokenizer: str, limits: ids.Limits = ids.Limits()) -> str:  # noqa: B008
    """The whole chunker: blocks, tables, sentences, the packing fold, slices, ids."""
    config = f"""sha256('{{"max_tokens":{limits.most},"overlap_tokens":{limits.overlap},"strategy":"section-aware-parent-child","target_tokens":{limits.target},"tokenizer":"{tokenizer}"}}')"""
    out = _BODIES.replace("WITH t AS", "WITH RECURSIVE t AS") + r""",
c0 AS (SELECT doc_id, section_ordinal, heading, access_policy_id, body_start::BIGINT AS bs, body_end::BIGINT AS be, substr(text, (body_start + 1)::BIGINT, (body_end - body_start)::BIGINT) AS body FROM s),
c AS MATERIALIZED (SELECT *, {tok:size:body} AS tokens, len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, {rule}))) > 0 AS tab FROM c0 WHERE regexp_matches(body, '\S')),
-- blocks: a mark is set behind each separator, so that lengths add up to offsets
k AS MATERIALIZED (SELECT doc_id, section_ordinal, n, x[n] AS raw, regexp_replace(x[n], '\s+$', '') AS block, bs + coalesce(sum(length(x[n])) OVER (PARTITION BY doc_id, section_ordinal ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM (SELECT doc_id, section_ordinal, bs, x, unnest(generate_series(1, len(x))) AS n FROM (SELECT *, string_split(regexp_replace(body, '(\n\s*\n)', '\1' || chr(2), 'g'), chr(2)) AS x FROM c WHERE tokens > 400 OR tab))),
kt AS MATERIALIZED (SELECT *, array_to_string(l[1:p], chr(10)) AS top FROM (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, {rule})), true) AS p FROM (SELECT *, string_split(block, chr(10)) AS l FROM k)) WHERE p > 0),
lines AS MATERIALIZED (SELECT doc_id, section_ordinal, n, j, line, top, o, length(block) AS room, o + sum(length(line) + 1) OVER (PARTITION BY doc_id, section_ordinal, n ORDER BY j) - length(line) - 1 AS a, regexp_matches(line, {row}) AND NOT regexp_matches(line, {rule}) AS row, j <= p AS head, regexp_matches(line, {rule}) AS ruled
  FROM (SELECT *, unnest(generate_series(1, len(l))) AS j, l[j] AS line FROM kt)),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, section_ordinal, n ORDER BY j) AS q, trim(line) AS t, {size:trim(line)} AS size, {size:trim(top)} AS top_size FROM lines WHERE row AND NOT head),
rg AS (SELECT doc_id, section_ordinal, n, q, 1 AS g, top_size + {gap} + size AS total FROM r WHERE q = 1
  UNION ALL SELECT r.doc_id, r.section_ordinal, r.n, r.q, CASE WHEN {tok:rg.total + {gap} + r.size} <= 400 THEN g ELSE g + 1 END, CASE WHEN {tok:rg.total + {gap} + r.size} <= 400 THEN rg.total ELSE top_size END + {gap} + r.size
  FROM rg JOIN r ON r.doc_id = rg.doc_id AND r.section_ordinal = rg.section_ordinal AND r.n = rg.n AND r.q = rg.q + 1),
tg AS (SELECT doc_id, section_ordinal, n, g, max(total) AS total, trim(any_value(top)) || chr(10) || string_agg(t, chr(10) ORDER BY q) AS text,
    list_concat([{'a': any_value(o)::BIGINT, 'e': (any_value(o) + length(any_value(top)) + 1)::BIGINT}], list({'a': a::BIGINT, 'e': least(a + length(line) + 1, o + room)::BIGINT} ORDER BY q)) AS spans FROM rg JOIN r USING (doc_id, section_ordinal, n, q) GROUP BY ALL),
-- what is cut into sentences: blocks without a table, and a table block's lines that are no rows
w AS (SELECT doc_id, section_ordinal, n, 0 AS j, raw AS x, o FROM k WHERE (doc_id, section_ordinal, n) NOT IN (SELECT (doc_id, section_ordinal, n) FROM kt)
      UNION ALL SELECT doc_id, section_ordinal, n, j, line, a FROM lines WHERE NOT head AND NOT row AND NOT ruled),
z AS (SELECT doc_id, section_ordinal, n, j, m, regexp_replace(y[m], '\s+$', '') AS t, o + coalesce(sum(length(y[m])) OVER (PARTITION BY doc_id, section_ordinal, n, j ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM (SELECT *, unnest(generate_series(1, len(y))) AS m FROM (SELECT *, string_split(regexp_replace(regexp_replace(x, '\n\s*\n$', ''), '([.!?]\s+)([A-Z0-9"“])', '\1' || chr(2) || '\2', 'g'), chr(2)) AS y FROM w))),
u0 AS (SELECT doc_id, section_ordinal, n, 1 AS part, j, m, a::BIGINT AS a, (a + length(t))::BIGINT AS e, {size:t} AS size, regexp_matches(t, '(?i)(^\s*exception\b|\b(except|unless)\b|\bexception applies\b)') AS exc, t, NULL AS spans FROM z WHERE t <> ''
       UNION ALL SELECT doc_id, section_ordinal, n, 0, g, 0, 0, 0, total, false, text, spans FROM tg),
u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, section_ordinal ORDER BY n, part, j, m) AS i, CASE WHEN spans IS NOT NULL THEN 'table' WHEN {tok:size} > 400 THEN 'slice' ELSE 'text' END AS kind FROM u0),
-- the fold: what a unit does to the piece that is open, and the piece after it
f AS (
  SELECT doc_id, section_ordinal, i, CASE kind WHEN 'text' THEN 'begin' ELSE kind END AS act, 1::BIGINT AS grp, kind = 'text' AS opened, size::BIGINT AS total, true AS single, a AS first, e, 0::BIGINT AS overlap, [{'a': a, 'size': size}] AS sents FROM u WHERE i = 1
  UNION ALL
  SELECT doc_id, section_ordinal, i, act, CASE act WHEN 'append' THEN grp ELSE grp + 1 END, act NOT IN ('slice', 'table'), (CASE act WHEN 'append' THEN total + {gap} + size WHEN 'overlap' THEN joint ELSE size END)::BIGINT, act <> 'append',
    CASE act WHEN 'append' THEN first WHEN 'overlap' THEN tail[1].a ELSE a END, e, (CASE act WHEN 'append' THEN overlap WHEN 'overlap' THEN {tok:back} ELSE 0 END)::BIGINT, CASE act WHEN 'overlap' THEN list_append(tail, {'a': a, 'size': size}) ELSE [{'a': a, 'size': size}] END
  FROM (SELECT *, CASE WHEN kind <> 'text' THEN kind WHEN NOT opened THEN 'begin' WHEN exc AND {tok:total + {gap} + size} <= 400 THEN 'append' WHEN exc THEN 'cut' WHEN {tok:total + {gap} + size} <= 300 THEN 'append'
      WHEN single AND len(tail) > 0 AND {tok:joint} <= 400 THEN 'overlap' ELSE 'begin' END AS act
    FROM (SELECT *, {back} AS back, {both} AS joint FROM (SELECT u.doc_id, u.section_ordinal, u.i, u.a, u.e, u.size, u.exc, u.kind, f.grp, f.opened, f.total, f.single, f.first, f.overlap,
        list_filter(f.sents, lambda x, j: {tok:{tail}} <= 50) AS tail
      FROM f JOIN u ON u.doc_id = f.doc_id AND u.section_ordinal = f.section_ordinal AND u.i = f.i + 1)))),
{slices},
g AS (SELECT f.doc_id, f.section_ordinal, grp, 0 AS part, min(i) AS i, {tok:max(total)} AS token_count, max(overlap) AS overlap_tokens, bool_or(act = 'cut') AS cut_before,
    list({'a': CASE WHEN act IN ('begin', 'cut', 'overlap') THEN f.first ELSE u.a END, 'e': u.e} ORDER BY i) AS spans, NULL AS text FROM f JOIN u USING (doc_id, section_ordinal, i) WHERE kind = 'text' GROUP BY ALL),
tables AS (SELECT f.doc_id, f.section_ordinal, grp, 0 AS part, i, {tok:size} AS token_count, 0 AS overlap_tokens, false AS cut_before, spans, t AS text FROM f JOIN u USING (doc_id, section_ordinal, i) WHERE kind = 'table'),
sliced AS (SELECT f.doc_id, f.section_ordinal, grp, part, i, NULL AS token_count, 0 AS overlap_tokens, false AS cut_before, [{'a': sl.a, 'e': sl.e}] AS spans, NULL AS text FROM f JOIN sl USING (doc_id, section_ordinal, i)),
whole AS (SELECT doc_id, section_ordinal, 1 AS grp, 0 AS part, 1 AS i, tokens AS token_count, 0 AS overlap_tokens, false AS cut_before, [{'a': bs, 'e': be}] AS spans, NULL AS text FROM c WHERE tokens <= 400 AND NOT tab),
p AS (SELECT *, row_number() OVER v - 1 AS chunk_ordinal, coalesce(lead(cut_before) OVER v, false) AS cut FROM (SELECT * FROM g UNION ALL SELECT * FROM sliced UNION ALL SELECT * FROM tables UNION ALL SELECT * FROM whole) WINDOW v AS (PARTITION BY doc_id, section_ordinal ORDER BY grp, part)),
n AS (SELECT p.* EXCLUDE (text), heading, access_policy_id, sha256(p.doc_id || '|' || array_to_string(list_transform(spans, lambda x: x.a || ':' || x.e), ',') || '|' || part || '|' || {cfg}) AS chunk_id,
    coalesce(p.text, array_to_string(list_transform(spans, lambda x: substr(body, x.a - bs + 1, x.e - x.a)), chr(10))) AS text FROM p JOIN c USING (doc_id, section_ordinal))
SELECT chunk_id, doc_id::VARCHAR AS document_version_id, section_ordinal, chunk_ordinal, heading AS heading_path, access_policy_id, text, coalesce(token_count, {tok:size:text})::BIGINT AS token_count, overlap_tokens::BIGINT AS overlap_tokens, part AS part_index,
  '[' || array_to_string(list_transform(spans, lambda x: '{"start":' || x.a || ',"end":' || x.e || '}'), ',') || ']' AS spans, spans[1].a AS source_start, spans[-1].e AS source_end,
  CASE WHEN part > 0 THEN first_value(chunk_id) OVER (PARTITION BY doc_id, section_ordinal, grp ORDER BY part) END AS continuation_of,
  coalesce(CASE WHEN cut THEN lead(chunk_id) OVER (PARTITION BY doc_id, section_ordinal ORDER BY chunk_ordinal) END, '') AS exception_refs,
  array_to_string(list_filter(regexp_extract_all(text, '(?i)\b(?:refer to|see section|see the)\b[^.\n]{0,160}'), lambda x, j: list_position(regexp_extract_all(text, '(?i)\b(?:refer to|see section|see the)\b[^.\n]{0,160}'), x) = j), ' / ') AS reference_refs
FROM n"""
    m = _MEASURES[tokenizer]
    for name in ("slices", "back", "both", "tail", "gap"):
        out = out.replace(f"{{{name}}}", _SLICES[tokenizer] if name == "slices" else m[name])
    out = re.sub(r"\{tok:size:(\w+)\}", lambda x: m["tok"].replace("{x}", m["size"].replace("{x}", x[1])), out)
    out = re.sub(r"\{size:([^{}]+)\}", lambda x: m["size"].replace("{x}", x[1]), out)
    out = re.sub(r"\{tok:([^{}]+)\}", lambda x: m["tok"].replace("{x}", f"({x[1]})"), out)
    for usual, own in ((1600, 4 * limits.most), (400, limits.most), (300, limits.target), (50, limits.overlap)):  # the text has the usual limits
        out = re.sub(rf"\b{usual}\b", str(own), out)
    return out.replace("{rule}", _RULE_SQL).replace("{row}", _ROW_SQL).replace("{cfg}", config)


_CHUNKS = _chunks_sql("word-v1")


def _chunk_rows(out: DataFrame) -> DataFrame:
    numbers = [F.col(c).cast("long").alias(c) for c in ("section_ordinal", "chunk_ordinal", "token_count", "overlap_tokens", "part_index", "source_start", "source_end")]
    return out.select(
        "chunk_id", "document_version_id", "heading_path", "access_policy_id", "text", *numbers, F.to_json("spans").alias("spans"), "continuation_of",
        F.array_join("exception_refs", ",").alias("exception_refs"), F.array_join("reference_refs", " / ").alias("reference_refs"))


@query(_CHUNKS)
def chunk_documents(spark, sf):
    """The whole chunker: sections, tables, sentences, packing, overlap, slices, links, ids."""
    return _chunk_rows(chunking.chunk_documents(structured(spread(table(spark, sf, "documents")))))


@query(_chunks_sql("chars-4"))
def chunk_documents_by_characters(spark, sf):
    """The chunker under a counter whose counts don't add up: four characters a token, so that each candidate is counted as a whole."""
    return _chunk_rows(chunking.chunk_documents(structured(spread(table(spark, sf, "documents"))), tokenizer=QUADS))


_UNITS_SQL = r"""
WITH RECURSIVE y AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '(\n\s*\n)', '\1' || chr(2), 'g'), '([.!?]\s+)([A-Z0-9"“])', '\1' || chr(2) || '\2', 'g'), chr(2)) AS y FROM documents),
w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY m) AS i, len(regexp_extract_all(t, '\S+')) AS tok FROM (SELECT doc_id, m, regexp_replace(y[m], '\s+$', '') AS t FROM y, unnest(generate_series(1, len(y))) AS g(m)) WHERE t <> ''),
p AS (SELECT doc_id, i, 0 AS grp, tok AS total, tok FROM w WHERE i = 1
  UNION ALL SELECT w.doc_id, w.i, CASE WHEN p.total + w.tok <= 300 THEN p.grp ELSE p.grp + 1 END, CASE WHEN p.total + w.tok <= 300 THEN p.total + w.tok ELSE w.tok END, w.tok FROM p JOIN w ON w.doc_id = p.doc_id AND w.i = p.i + 1)
"""


@query(_UNITS_SQL + "SELECT doc_id, grp AS chunk, sum(tok)::BIGINT AS tokens, count(*) AS sentences FROM p GROUP BY 1, 2")
def pack_sentences(spark, sf):
    """The chunker's packing alone: a text as one section, sentences to 300 tokens, no overlap."""
    docs = spread(table(spark, sf, "documents")).withColumn("text", F.replace("text", F.lit("---"), F.lit("—")))
    limits = ids.Limits(300, 300, 0)
    packed = T.let(chunking.elements(F.col("text"), WORDS, 300), lambda units: F.transform(chunking.packed_ranges(units, F.lit(0), limits, WORDS), lambda r: F.struct(
        r["tok"].alias("tokens"), F.size(F.filter(F.slice(units, r["first"] + 1, r["last"] - r["first"] + 1), lambda u: u["t"] != "")).alias("sentences"))))
    rows = docs.select("doc_id", F.posexplode(packed).alias("chunk", "x"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("x.tokens").cast("long").alias("tokens"), F.col("x.sentences").cast("long").alias("sentences"))


_SMALL = ids.Limits(15, 60, 25)


@query(_chunks_sql("word-v1", _SMALL))
def overlap_tail(spark, sf):
    """The chunker under small limits, where most pieces are one sentence: the next one repeats whole sentences of it."""
    return _chunk_rows(chunking.chunk_documents(structured(spread(table(spark, sf, "documents"))), _SMALL))


@query(_chunks_sql("chars-4", _SMALL))
def overlap_by_characters(spark, sf):
    """The same where counts don't add up: long sentences give slices found by halving."""
    return _chunk_rows(chunking.chunk_documents(structured(spread(table(spark, sf, "documents"))), _SMALL, QUADS))


@query(f"WITH c AS MATERIALIZED ({_CHUNKS}) SELECT a.chunk_id, a.exception_refs AS exception_id, a.text, b.text AS exception_text FROM c a JOIN c b ON b.chunk_id = a.exception_refs")
def exception_links(spark, sf):
    """The chunks linked with the exception behind them, and its text: every link leads to a chunk."""
    out = staged(_chunk_rows(chunking.chunk_documents(structured(spread(table(spark, sf, "documents"))))).select("chunk_id", "exception_refs", "text"))
    behind = out.select(F.col("chunk_id").alias("exception_id"), F.col("text").alias("exception_text"))
    return out.where("exception_refs <> ''").withColumnRenamed("exception_refs", "exception_id").join(behind, "exception_id").select("chunk_id", "exception_id", "text", "exception_text")


@query(r"""SELECT doc_id, i AS window, array_to_string(w[i * 250 + 1:i * 250 + 300], ' ') AS text FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
  unnest(generate_series(0, greatest(len(w) - 51, 0) // 250)) AS g(i) WHERE len(w) > 0""")
def fixed_window_chunks(spark, sf):
    """The baseline chunker: windows of 300 words that overlap by 50."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(T.fixed_windows(F.col("text"), 300, 50)).alias("window", "text"))
    return docs.withColumn("window", F.col("window").cast("long"))


@query(r"""SELECT doc_id, i AS part, len(w[i * 400 + 1:i * 400 + 400]) AS tokens, array_to_string(w[i * 400 + 1:i * 400 + 400], ' ') AS text
  FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), unnest(generate_series(0, (len(w) - 1) // 400)) AS g(i) WHERE len(w) > 0""")
def subspan_slices(spark, sf):
    """A text as one over-long sentence: slices of exactly the maximum."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(T.fixed_windows(F.col("text"), 400, 0)).alias("part", "text"))
    return docs.select("doc_id", F.col("part").cast("long").alias("part"), T.word_count(F.col("text")).cast("long").alias("tokens"), "text")


@query(r"""SELECT doc_id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ' / ') AS refs
  FROM (SELECT doc_id, regexp_extract_all('Please refer to the ' || source || ' policy. ' || text || ' See section ' || (doc_id % 7) || ' now. Please refer to the ' || source || ' policy.', '(?i)\b(?:refer to|see section|see the)\b[^.\n]{0,160}') AS r FROM documents)""")
def reference_extract(spark, sf):
    text = F.concat(F.lit("Please refer to the "), F.col("source"), F.lit(" policy. "), F.col("text"), F.lit(" See section "), F.col("doc_id") % 7, F.lit(" now. Please refer to the "), F.col("source"), F.lit(" policy."))
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.references(text), " / ").alias("refs"))


@query(r"""SELECT n_nationkey::VARCHAR AS document_version_id, g AS chunk_ordinal, '| Item | Limit |' || chr(10) || '|---|---|' AS table_header,
  '| Item | Limit |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || replace(n_name, ' ', '-') || ' ' || i || ' | ' || i || ' kg |', chr(10) ORDER BY i) AS text
  FROM (SELECT *, (i - 1) // 2 AS g FROM nation, unnest(generate_series(1, 5)) AS x(i)) GROUP BY n_nationkey, g""")
def table_row_groups(spark, sf):
    """Tables split into row groups that repeat the header: two rows of seven tokens beside its six within 20."""
    rows = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("| "), F.replace("n_name", F.lit(" "), F.lit("-")), F.lit(" "), i, F.lit(" | "), i, F.lit(" kg |"))), "\n")
    docs = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("document_version_id"), F.lit("T").alias("document_title"), F.lit("p").alias("access_policy_id"),
        F.concat(F.lit("| Item | Limit |\n|---|---|\n"), rows).alias("text"))
    out = chunking.chunk_documents(docs, ids.Limits(16, 20, 0))
    return out.select("document_version_id", F.col("chunk_ordinal").cast("long").alias("chunk_ordinal"), "table_header", "text")


def _windows_sql(pairs: str) -> str:
    """Windows of ``pairs`` (question_id, item_id, text, b), a row each: question_id, item_id, w (from 0), a, e, in the text."""
    return rf"""pr AS MATERIALIZED (SELECT *, {_WORDS.replace("{x}", "text")} AS words FROM ({pairs})),
ws AS MATERIALIZED (SELECT question_id, item_id, b, row_number() OVER (PARTITION BY question_id, item_id ORDER BY m) AS i, a, a + length(t) AS e, t, {_WORDS.replace("{x}", "t")} AS tok FROM (
  SELECT *, regexp_replace(y[m], '\s+$', '') AS t, coalesce(sum(length(y[m])) OVER (PARTITION BY question_id, item_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM (SELECT *, unnest(generate_series(1, len(y))) AS m FROM (SELECT *, string_split(regexp_replace(text, '([.!?]\s+)([A-Z0-9"“])', '\1' || chr(2) || '\2', 'g'), chr(2)) AS y FROM pr WHERE words > b))) WHERE t <> ''),
wf AS (SELECT question_id, item_id, i, 1::BIGINT AS grp, tok <= b AS opened, tok AS total, tok > b AS cut FROM ws WHERE i = 1
  UNION ALL SELECT x.question_id, x.item_id, x.i, CASE WHEN x.tok <= x.b AND opened AND total + x.tok <= x.b THEN grp ELSE grp + 1 END, x.tok <= x.b, CASE WHEN x.tok <= x.b AND opened AND total + x.tok <= x.b THEN total + x.tok ELSE x.tok END, x.tok > x.b
  FROM wf JOIN ws x ON x.question_id = wf.question_id AND x.item_id = wf.item_id AND x.i = wf.i + 1),
wn AS (SELECT question_id, item_id, 1 AS grp, 0 AS part, 0 AS a, length(text) AS e FROM pr WHERE words <= b
  UNION ALL SELECT question_id, item_id, grp, 0, min(a), max(e) FROM wf JOIN ws USING (question_id, item_id, i) WHERE NOT cut GROUP BY ALL
  UNION ALL SELECT question_id, item_id, grp, part, a + length(array_to_string(v[1:part * b], '')), a + length(array_to_string(v[1:(part + 1) * b], '')) FROM (
    SELECT *, unnest(generate_series(0, (len(v) - 1) // b)) AS part FROM (SELECT question_id, item_id, grp, a, b, regexp_extract_all(t, '\s*\S+\s*') AS v FROM wf JOIN ws USING (question_id, item_id, i) WHERE cut))),
win AS (SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id, item_id ORDER BY grp, part) - 1 AS w, a::BIGINT AS a, e::BIGINT AS e FROM wn)"""


_ASKED, _TITLE_SHOWN, _HEADING_SHOWN = "What is the weight limit?", "Rules for the rooms", "Limits"
_ROOM = ids.PAIR - ids.SPECIAL - len(f"{_ASKED} {_TITLE_SHOWN} {_HEADING_SHOWN}".split())


@query("WITH RECURSIVE " + _windows_sql(f"SELECT 0 AS question_id, doc_id AS item_id, text, {_ROOM} AS b FROM documents") + """
SELECT item_id AS doc_id, w AS window, a AS start, e AS stop, substr(text, a + 1, e - a) AS text FROM win JOIN documents ON doc_id = item_id""")
def rerank_windows(spark, sf):
    """Windows of every document beside one question and title; they slice back to the text."""
    docs = spread(table(spark, sf, "documents"))
    pairs = docs.select(
        F.col("doc_id").alias("chunk_id"), F.lit(_ASKED).alias("question"), F.lit(_TITLE_SHOWN).alias("document_title"), F.lit(_HEADING_SHOWN).alias("heading_path"), "text",
        F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))).alias("spans"))
    out = chunking.rerank_windows(pairs)
    at = F.col("window_spans")[0]
    return out.select(
        F.col("chunk_id").alias("doc_id"), F.col("window_index").cast("long").alias("window"), at["start"].cast("long").alias("start"), at["end"].cast("long").alias("stop"),
        F.substring("text", at["start"] + 1, at["end"] - at["start"]).alias("text"))


@query("""SELECT doc_id, 'title: ' || source || ' / ' || lang || ' | text: ' || text AS embedding_input FROM documents""")
def embedding_input_format(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.embedding_input(F.col("source"), F.col("lang"), F.col("text")).alias("embedding_input"))


@query(r"""WITH r AS (SELECT doc_id, i, r[i] AS run, regexp_extract(r[i], '\S+$') AS word FROM (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS r FROM documents), unnest(generate_series(1, len(r))) AS g(i)),
o AS (SELECT doc_id, i, word, sum(length(word) + 1) OVER w - length(word) - 1 AS n, sum(length(run)) OVER w - length(word) AS o FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS normalized, coalesce(string_agg(n::BIGINT || ':' || o::BIGINT, ',' ORDER BY i), '') AS offsets FROM documents d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id""")
def whitespace_normalization(spark, sf):
    """White space normalized, and for each word its place before and after, so that every span maps back."""
    docs = table(spark, sf, "documents").select("doc_id", T.normalize_spaces(F.col("text")).alias("n"))
    places = F.transform("n.offsets", lambda o: F.concat_ws(":", o["normalized"].cast("string"), o["original"].cast("string")))
    return docs.select("doc_id", F.col("n.normalized").alias("normalized"), F.array_join(places, ",").alias("offsets"))


@query(r"""WITH d AS (SELECT source, lang, length(text) AS chars, len(regexp_extract_all(text, '\S+')) AS tokens FROM documents),
o AS (SELECT source, string_agg(tokens || 'x' || n, ',' ORDER BY tokens) AS over_max FROM (SELECT source, tokens, count(*) AS n FROM d WHERE tokens > 400 GROUP BY ALL) GROUP BY 1)
SELECT source AS corpus_id, sum(chars)::BIGINT AS characters, count(*) AS children, count(DISTINCT lang) AS sections, coalesce(max(tokens), 0) AS max_tokens,
  any_value(over_max) AS over_max, array_to_string(list_sort(list(DISTINCT lang)), ',') AS headings FROM d LEFT JOIN o USING (source) GROUP BY source""")
def corpus_summary(spark, sf):
    """A row a corpus; lengths beyond the limit as lengthxcount, counted before they are listed."""
    d = table(spark, sf, "documents").select("source", "lang", F.length("text").alias("chars"), T.word_count(F.col("text")).cast("long").alias("tokens"))
    over = d.where("tokens > 400").groupBy("source", "tokens").agg(F.count("*").alias("n")).groupBy("source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tokens", "n"))), lambda x: F.concat_ws("x", x["tokens"], x["n"])), ",").alias("over_max"))
    all_ = d.groupBy("source").agg(
        F.sum("chars").alias("characters"), F.count("*").alias("children"), F.count_distinct("lang").alias("sections"),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("max_tokens"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("headings"))
    return all_.join(over, "source", "left").withColumnRenamed("source", "corpus_id")


# ---------------------------------------------------------------- governance

#: A museum's staff: id, active, roles, department, corpora, grants.
PRINCIPALS = [
    ("ada", True, ["guide"], "rooms", ["core", "maps"], []),
    ("ben", True, ["guide", "curator"], "rooms", ["core", "maps"], []),
    ("cleo", True, ["curator"], "loans", ["core", "coins"], []),
    ("dov", True, ["registrar", "guide"], "vault", ["core"], []),
    ("eve", True, ["guide"], None, ["core", "coins"], []),
    ("fay", True, ["reviewer"], "board", ["core", "coins", "maps"], ["read_history:core"]),
    ("gil", True, ["curator"], "rooms", ["core"], []),
    ("hana", True, ["curator"], "rooms", ["maps"], ["read_history:maps"]),
    ("ivo", False, ["curator", "registrar"], "rooms", ["core"], ["read_history:core"]),
]
#: Its rules: id, classification, allowed roles, departments, allowed users, denied users.
POLICIES = [
    ("open", "public", None, None, None, None),
    ("staff", "internal", None, None, None, ["fay"]),
    ("store", "restricted", ["curator", "restorer"], ["rooms", "vault"], ["eve"], ["gil"]),
    ("ledger", "restricted", ["registrar"], [], None, None),
    ("sealed", "secret", ["curator"], None, ["ada"], None),
]


def _literal(rows: list[tuple], names: list[str], kinds: list[str], spark: SparkSession) -> DataFrame:
    def value(v, kind: str) -> Column:
        return (F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).cast(kind)

    structs = [F.struct(*[value(v, k).alias(n) for v, n, k in zip(r, names, kinds, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def principals(spark: SparkSession) -> DataFrame:
    lists = "array<string>"
    out = _literal(PRINCIPALS, ["user_id", "active", "roles", "department_id", "allowed_corpus_ids", "explicit_grants"], ["string", "boolean", lists, "string", lists, lists], spark)
    return out.withColumn("tenant_id", F.lit("museum"))


def policies(spark: SparkSession) -> DataFrame:
    lists = "array<string>"
    return _literal(POLICIES, ["id", "classification", "allowed_roles", "department_ids", "allowed_users", "denied_users"], ["string", "string", lists, lists, lists, lists], spark)


def _values(rows: list[tuple], kinds: list[str]) -> str:
    """The rows as SQL literals."""

    def value(v, kind: str) -> str:
        if v is None:
            return f"NULL::{kind}"
        return f"[{', '.join(map(repr, v))}]::{kind}" if isinstance(v, list) else repr(v) if isinstance(v, str) else str(v).lower()

    return ", ".join(f"({', '.join(value(v, k) for v, k in zip(r, kinds, strict=True))})" for r in rows)


_ACL_SQL = f"""WITH u(user_id, active, roles, dep, corpora, grants) AS (VALUES {_values(PRINCIPALS, ["VARCHAR", "BOOLEAN", "VARCHAR[]", "VARCHAR", "VARCHAR[]", "VARCHAR[]"])}),
p(policy_id, class, allowed, deps, named, denied) AS (VALUES {_values(POLICIES, ["VARCHAR", "VARCHAR", "VARCHAR[]", "VARCHAR[]", "VARCHAR[]", "VARCHAR[]"])}),
acl AS (SELECT user_id, policy_id, active AND list_contains(corpora, 'core') AND NOT list_contains(coalesce(denied, []), user_id) AND CASE class WHEN 'public' THEN true WHEN 'internal' THEN true
  WHEN 'restricted' THEN (len(list_intersect(roles, coalesce(allowed, []))) > 0 AND (len(coalesce(deps, [])) = 0 OR coalesce(list_contains(deps, dep), false))) OR list_contains(coalesce(named, []), user_id)
  ELSE false END AS allowed FROM u, p)
"""


@query(_ACL_SQL + "SELECT user_id, policy_id, allowed FROM acl")
def acl_matrix(spark, sf):
    """Every principal against every rule on one corpus."""
    pairs = principals(spark).select(F.struct("*").alias("u")).crossJoin(F.broadcast(policies(spark).select(F.struct("*").alias("p"))))
    return pairs.select("u.user_id", F.col("p.id").alias("policy_id"), access.allow("u", F.lit("core"), F.lit("museum"), "p").alias("allowed"))


def _labelled(spark, sf) -> DataFrame:
    """Documents with a rule by their label: toxic is the store's rule, none is no rule at all."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "store").otherwise("staff").alias("id"))
    return docs.join(labels, "doc_id", "left").join(F.broadcast(policies(spark)), "id", "left").select("doc_id", "source", "text", F.struct("id", "classification", "allowed_roles", "department_ids", "allowed_users", "denied_users").alias("p"))


_RULED = "SELECT doc_id, d.lang, CASE l.toxic WHEN 1 THEN 'store' WHEN 0 THEN 'staff' END AS policy_id FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(_ACL_SQL + f"""SELECT u.user_id, count(*) FILTER (WHERE acl.allowed) AS readable, count(*) AS documents FROM u CROSS JOIN ({_RULED}) d LEFT JOIN acl ON acl.user_id = u.user_id AND acl.policy_id = d.policy_id GROUP BY 1""")
def acl_filter_docs(spark, sf):
    """How many documents each principal may read; documents without a rule are denied."""
    pairs = _labelled(spark, sf).crossJoin(F.broadcast(principals(spark).select(F.struct("*").alias("u"))))
    pairs = pairs.withColumn("ok", access.allow("u", F.lit("core"), F.lit("museum"), "p"))
    return pairs.groupBy("u.user_id").agg(F.count_if("ok").alias("readable"), F.count("*").alias("documents"))


@query(_ACL_SQL + f"""SELECT d.doc_id, coalesce(a.allowed, false) AND b.allowed AS allowed FROM ({_RULED}) d LEFT JOIN acl a ON a.policy_id = d.policy_id AND a.user_id = 'ben'
  JOIN acl b ON b.user_id = 'ben' AND b.policy_id = CASE d.lang WHEN 'de' THEN 'ledger' WHEN 'fr' THEN 'sealed' ELSE 'open' END""")
def section_narrows_document(spark, sf):
    """Document rule and section rule must both allow; here sections in German and French have narrower rules."""
    docs = _labelled(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    rules = policies(spark).select(F.col("id").alias("sid"), F.struct("*").alias("s"))
    docs = docs.withColumn("sid", F.when(F.col("lang") == "de", "ledger").when(F.col("lang") == "fr", "sealed").otherwise("open")).join(F.broadcast(rules), "sid")
    docs = docs.crossJoin(F.broadcast(principals(spark).where("user_id = 'ben'").select(F.struct("*").alias("u"))))
    both = access.allow("u", F.lit("core"), F.lit("museum"), "p") & access.allow("u", F.lit("core"), F.lit("museum"), "s")
    return docs.select("doc_id", both.alias("allowed"))


@query(_ACL_SQL + "SELECT user_id, c AS corpus_id, list_contains(grants, 'read_history:' || c) AS may_read_history FROM u, (VALUES ('core'), ('maps')) AS x(c)")
def history_grants(spark, sf):
    corpora = _literal([("core",), ("maps",)], ["corpus_id"], ["string"], spark)
    return principals(spark).crossJoin(F.broadcast(corpora)).select("user_id", "corpus_id", access.may_read_history(F.col("explicit_grants"), F.col("corpus_id")).alias("may_read_history"))


@query("""WITH q AS (SELECT event_id AS request, user_id, ts AS started, ts + INTERVAL 6 HOUR AS returned FROM events WHERE event_type = 'view'),
c AS (SELECT user_id, ts, event_id, event_type <> 'error' AS allowed FROM events WHERE event_type IN ('error', 'signup', 'purchase')),
x AS (SELECT request, user_id, (SELECT count(*) FROM c WHERE c.user_id = q.user_id AND c.ts <= started) AS revision_before, (SELECT count(*) FROM c WHERE c.user_id = q.user_id AND c.ts <= returned) AS revision_after,
  coalesce((SELECT arg_max(allowed, (ts, event_id)) FROM c WHERE c.user_id = q.user_id AND c.ts <= started), false) AS allowed_before, coalesce((SELECT arg_max(allowed, (ts, event_id)) FROM c WHERE c.user_id = q.user_id AND c.ts <= returned), false) AS allowed_after FROM q)
SELECT *, CASE WHEN NOT allowed_before THEN 'refused' WHEN NOT allowed_after THEN 'withheld' WHEN revision_before <> revision_after THEN 'decided_again' ELSE 'answered' END AS status FROM x""")
def revocation_recheck(spark, sf):
    """Views as requests of six hours; errors take an entitlement away, signups and purchases give it: decided when a request starts and again when it returns."""
    e = table(spark, sf, "events")
    asked = e.where("event_type = 'view'").select(F.col("event_id").alias("request"), "user_id", F.col("ts").alias("started"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("returned"))
    changes = e.where("event_type in ('error', 'signup', 'purchase')").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("change"), (F.col("event_type") != "error").alias("allowed"))
    return requests.recheck(asked, changes)


@query(_ACL_SQL + f"""SELECT fact, user_id FROM (SELECT r.doc_id // 5 AS fact, a.user_id, count(*) AS n FROM ({_RULED}) r JOIN acl a ON a.policy_id = r.policy_id AND a.allowed GROUP BY ALL)
  JOIN (SELECT doc_id // 5 AS fact, count(*) AS every FROM documents GROUP BY 1) USING (fact) WHERE n = every""")
def permission_intersection(spark, sf):
    """A fact derived from several documents (here five in a row) may be read by those who may read each of them."""
    docs = _labelled(spark, sf).withColumn("fact", F.expr("doc_id div 5"))
    readers = docs.crossJoin(F.broadcast(principals(spark).select(F.struct("*").alias("u")))).where(access.allow("u", F.lit("core"), F.lit("museum"), "p"))
    return quality.common_to_all(docs.select("fact"), readers.select("fact", "u.user_id"), ["fact"], ["user_id"])


_REQUEST = """CASE doc_id % 10 WHEN 0 THEN text WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"question": 7, "top_k": "many"}' ELSE
  '{"question": ' || to_json(text) || CASE doc_id % 10 WHEN 3 THEN ', "role": "admin", "Tenant": 1' WHEN 4 THEN ', "mode": "fast"' WHEN 5 THEN ', "as_of": "2021-02-30"' WHEN 6 THEN ', "corpora": ["core", 3]'
  WHEN 7 THEN ', "corpora": ["core", "maps"], "mode": "hybrid", "as_of": "2021-02-28", "top_k": 5' WHEN 8 THEN ', "corpora": "core", "top_k": 2.5' ELSE '' END || '}' END"""


@query(rf"""WITH q AS (SELECT doc_id, {_REQUEST} AS r FROM documents), v AS (SELECT doc_id, CASE WHEN json_valid(r) THEN r::JSON END AS j FROM q),
k AS (SELECT doc_id, j, json_type(j) = 'OBJECT' AS ok, CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) ELSE [] END AS keys, json_type(j, '$.question') AS tq, json_type(j, '$.corpora') AS tc, json_type(j, '$.mode') AS tm, json_type(j, '$.as_of') AS ta, json_type(j, '$.top_k') AS tk FROM v),
n AS (SELECT *, CASE WHEN tc = 'ARRAY' THEN len(list_filter(json_extract(j, '$.corpora[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 ELSE false END AS strings FROM k)
SELECT doc_id, CASE WHEN NOT coalesce(ok, false) THEN 'not an object' ELSE array_to_string(list_concat(
    list_transform(list_sort(list_filter(keys, lambda x: x NOT IN ('question', 'corpora', 'mode', 'as_of', 'top_k'))), lambda x: 'unknown field: ' || x),
    list_filter([CASE WHEN tq <> 'VARCHAR' THEN 'type: question' END, CASE WHEN tc IS NOT NULL AND NOT strings THEN 'type: corpora' END, CASE WHEN tm <> 'VARCHAR' THEN 'type: mode' END, CASE WHEN ta <> 'VARCHAR' THEN 'type: as_of' END,
      CASE WHEN tk NOT IN ('UBIGINT', 'BIGINT') THEN 'type: top_k' END, CASE WHEN NOT list_contains(keys, 'question') THEN 'missing: question' END,
      CASE WHEN tq = 'VARCHAR' AND length(trim(json_extract_string(j, '$.question'))) NOT BETWEEN 1 AND 2000 THEN 'length: question' END,
      CASE WHEN tm = 'VARCHAR' AND json_extract_string(j, '$.mode') NOT IN ('vector', 'hybrid', 'hybrid_rerank', 'graph_rerank', 'agentic') THEN 'mode' END,
      CASE WHEN ta = 'VARCHAR' AND try_strptime(json_extract_string(j, '$.as_of'), '%Y-%m-%d') IS NULL THEN 'date: as_of' END], lambda x: x IS NOT NULL)), '; ') END AS reasons FROM n""")
def request_validation(spark, sf):
    """Requests as JSON, with whole texts as questions: unknown fields, wrong types, lengths, modes and dates are refused, with reasons."""
    kind, question = F.col("doc_id") % 10, F.get(F.split(F.to_json(F.struct("text")), '"text":', 2), F.lit(1))
    more = {3: ', "role": "admin", "Tenant": 1', 4: ', "mode": "fast"', 5: ', "as_of": "2021-02-30"', 6: ', "corpora": ["core", 3]',
            7: ', "corpora": ["core", "maps"], "mode": "hybrid", "as_of": "2021-02-28", "top_k": 5', 8: ', "corpora": "core", "top_k": 2.5'}
    rest = F.lit("")
    for k, v in more.items():
        rest = F.when(kind == k, v).otherwise(rest)
    body = F.concat(F.lit('{"question": '), F.regexp_replace(question, r"\}$", ""), rest, F.lit("}"))
    text = F.when(kind == 0, F.col("text")).when(kind == 1, "[1, 2]").when(kind == 2, '{"question": 7, "top_k": "many"}').otherwise(body)
    return table(spark, sf, "documents").select("doc_id", F.array_join(requests.refusals(text), "; ").alias("reasons"))


# ---------------------------------------------------------------- retrieval


def _question(spark, sf) -> DataFrame:
    """Every 50th vector is a question."""
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


_SIM = "round(list_sum(list_transform(generate_series(1, len(e.embedding)), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), 6)"
_VEC = f"SELECT q.vec_id AS question_id, e.vec_id AS item_id, {_SIM} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0"
_BEST = "row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id)"


@query(f"""SELECT question_id, item_id, score, {_BEST} AS rank FROM ({_VEC}) QUALIFY rank <= 10""")
def vector_topk(spark, sf):
    return retrieval.nearest(_vectors(spark, sf), _question(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


def _readable(spark, sf, user: str = "ada") -> DataFrame:
    who = principals(spark).where(F.col("user_id") == user).select(F.struct("*").alias("u"))
    docs = _labelled(spark, sf).crossJoin(F.broadcast(who))
    return docs.where(access.allow("u", F.lit("core"), F.lit("museum"), "p")).select(F.col("doc_id").alias("item_id"), "text", "source")


_OPEN = "SELECT doc_id FROM labels WHERE toxic = 0 AND doc_id IN (SELECT doc_id FROM documents)"


@query(f"""SELECT question_id, item_id, score, {_BEST} AS rank FROM ({_VEC}) WHERE item_id IN ({_OPEN}) QUALIFY rank <= 10""")
def vector_topk_authorized(spark, sf):
    """Authorize, then rank: the filter stands below the top-k."""
    open_vectors = _vectors(spark, sf).join(_readable(spark, sf).select("item_id"), "item_id", "left_semi")
    return retrieval.nearest(open_vectors, _question(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH v AS MATERIALIZED ({_VEC}), a AS (SELECT question_id, item_id FROM v WHERE item_id IN ({_OPEN}) QUALIFY {_BEST} <= 10), b AS (SELECT question_id, item_id FROM v QUALIFY {_BEST} <= 10)
SELECT question_id, (SELECT count(*) FROM a WHERE a.question_id = x.question_id) AS filtered_first, (SELECT count(*) FROM b WHERE b.question_id = x.question_id AND item_id IN ({_OPEN})) AS filtered_last,
  (SELECT count(*) FROM a WHERE a.question_id = x.question_id AND item_id IN (SELECT item_id FROM b WHERE b.question_id = x.question_id)) AS kept FROM (SELECT DISTINCT question_id FROM v) x""")
def forbidden_neighbor_recall(spark, sf):
    """For each question, what ranking before authorizing would lose to forbidden neighbours."""
    vectors_, q, ok = _vectors(spark, sf), _question(spark, sf), _readable(spark, sf).select("item_id")
    first = retrieval.nearest(vectors_.join(ok, "item_id", "left_semi"), q).select("question_id", "item_id", F.lit(True).alias("first"))
    plain = retrieval.nearest(vectors_, q).select("question_id", "item_id", F.lit(True).alias("plain"))
    both = first.join(plain, ["question_id", "item_id"], "full").join(ok.withColumn("open", F.lit(True)), "item_id", "left")
    return both.groupBy("question_id").agg(
        F.count("first").alias("filtered_first"), F.count_if(F.col("plain") & F.col("open")).alias("filtered_last"), F.count_if(F.col("first") & F.col("plain")).alias("kept"))


_TOKENS = r"'[\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*(?:[.\-/][\p{L}\p{N}]+)*|[\p{L}\p{N}]+'"
_KW = r"""
d AS (SELECT DISTINCT doc_id AS item_id, unnest(regexp_extract_all(lower(text), {tok})) AS token FROM documents {where}),
q AS (SELECT DISTINCT item_id AS question_id, unnest(regexp_extract_all(lower(text), {tok})) AS token FROM benchmark),
m AS (SELECT question_id, d.item_id, sum(CASE WHEN regexp_matches(token, '\p{N}') THEN 5 ELSE 1 END)::BIGINT AS shared FROM d JOIN q USING (token) GROUP BY ALL),
k AS (SELECT question_id, m.item_id, shared + CASE WHEN contains(lower(x.text), lower(b.text)) THEN 10 ELSE 0 END AS score FROM m JOIN documents x ON x.doc_id = m.item_id JOIN benchmark b ON b.item_id = question_id),
kw AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS rank FROM k QUALIFY rank <= 10)
""".replace("{tok}", _TOKENS)


def _questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query("WITH" + _KW.replace("{where}", "") + "SELECT question_id, item_id, score, rank FROM kw")
def keyword_topk(spark, sf):
    """Every benchmark passage as a question over all documents."""
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    out = retrieval.keyword_top(items, _questions(spark, sf))
    return out.withColumn("rank", F.col("rank").cast("long"))


_HYBRID = f"""WITH {_KW.replace("{where}", "WHERE doc_id IN (" + _OPEN + ")")},
vec AS (SELECT b.item_id AS question_id, e.vec_id AS item_id, row_number() OVER (PARTITION BY b.item_id ORDER BY {_SIM} DESC, e.vec_id) AS rank
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings e ON e.vec_id IN ({_OPEN}) QUALIFY rank <= 10),
f AS (SELECT question_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT question_id, item_id, rank FROM vec UNION ALL SELECT question_id, item_id, rank FROM kw) GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS rank FROM f)
"""


def _hybrid_lists(spark, sf, user: str = "ada") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vector list, keyword list and readable items; question i has benchmark text i and vector i."""
    items = _readable(spark, sf, user)
    vecs = _vectors(spark, sf).join(items.select("item_id"), "item_id", "left_semi")
    asked = _questions(spark, sf).select("question_id")
    q = table(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")).join(asked, "question_id", "left_semi")
    vec = retrieval.nearest(vecs, q)
    kw = retrieval.keyword_top(items, _questions(spark, sf))
    return vec, kw, items


@query(_HYBRID + "SELECT question_id, item_id, score, rank FROM h WHERE rank <= 5")
def hybrid_rrf(spark, sf):
    """The flagship: authorize, vector and keyword top-10, reciprocal rank fusion, top 5."""
    vec, kw, _ = _hybrid_lists(spark, sf)
    return retrieval.rrf([vec, kw], ["question_id"], "item_id").where("rank <= 5").withColumn("rank", F.col("rank").cast("long"))


_OVERLAP = r"""round(len(list_intersect(qt, dt)) / greatest(len(list_distinct(list_concat(qt, dt))), 1)::DOUBLE, 6)"""
_RERANK = _HYBRID + rf""", s AS (SELECT h.question_id, h.item_id, h.rank AS before, {_OVERLAP} AS rerank_score FROM h
  JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), {_TOKENS})) AS qt FROM benchmark) b ON b.item_id = h.question_id
  JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), {_TOKENS})) AS dt FROM documents) d ON d.doc_id = h.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, item_id) AS after FROM s)
"""


def _reranked(spark, sf, k: int) -> DataFrame:
    vec, kw, items = _hybrid_lists(spark, sf)
    fused = retrieval.rrf([vec, kw], ["question_id"], "item_id")
    full = fused.join(items.select("item_id", "text"), "item_id").join(_questions(spark, sf), "question_id")
    return retrieval.rerank(full, ["question_id"], "item_id", retrieval.overlap_score(F.col("question"), F.col("text")), k)


@query(_RERANK + "SELECT question_id, item_id, before, after, before - after AS moved, rerank_score FROM r WHERE after <= 5")
def rerank_movement(spark, sf):
    out = _reranked(spark, sf, 5)
    return out.select("question_id", "item_id", F.col("before").cast("long"), F.col("after").cast("long"), F.col("moved").cast("long"), "rerank_score")


_PAIRS = r"""SELECT h.question_id, h.item_id, h.rank AS before, d.text, 512 - 3 - len(regexp_extract_all(b.text, '\S+')) - len(regexp_extract_all(concat_ws(' ', d.source, d.lang), '\S+')) AS b
  FROM h JOIN documents d ON d.doc_id = h.item_id JOIN benchmark b ON b.item_id = h.question_id"""


@query(_HYBRID.replace("WITH", "WITH RECURSIVE", 1) + ", " + _windows_sql(_PAIRS) + rf""",
sc AS (SELECT win.*, pr.before, substr(pr.text, a + 1, e - a) AS shown, {_OVERLAP} AS score FROM (SELECT *, list_distinct(regexp_extract_all(lower(substr(pr.text, win.a + 1, win.e - win.a)), {_TOKENS})) AS dt FROM win JOIN pr USING (question_id, item_id)) AS win
  JOIN (SELECT item_id AS question_id, list_distinct(regexp_extract_all(lower(text), {_TOKENS})) AS qt FROM benchmark) b USING (question_id) JOIN pr USING (question_id, item_id)),
bw AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY question_id, item_id ORDER BY score DESC, w) = 1)
SELECT question_id, item_id, before, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS after, score AS rerank_score, w AS window, a AS start, e AS stop, shown AS text FROM bw QUALIFY after <= 5""")
def rerank_by_windows(spark, sf):
    """Hybrid candidates scored window by window: each has the score of its best window, whose span is kept and slices back to the source."""
    vec, kw, items = _hybrid_lists(spark, sf)
    fused = retrieval.rrf([vec, kw], ["question_id"], "item_id").select("question_id", "item_id", F.col("rank").alias("before"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("document_title"), F.col("lang").alias("heading_path"), "text")
    pairs = fused.join(docs, "item_id").join(_questions(spark, sf), "question_id").withColumn("chunk_id", F.col("item_id"))
    windows = chunking.rerank_windows(pairs.withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))))
    best = retrieval.best_windows(windows, ["question_id"], "item_id", retrieval.overlap_score(F.col("question"), F.col("window_text")), ["before"])
    out = retrieval.top_k(best, ["question_id"], "rerank_score", "item_id", 5)
    at = F.col("window_spans")[0]
    out = out.join(docs.select("item_id", "text"), "item_id")
    return out.select(
        "question_id", "item_id", F.col("before").cast("long"), F.col("rank").cast("long").alias("after"), "rerank_score", F.col("window_index").cast("long").alias("window"),
        at["start"].cast("long").alias("start"), at["end"].cast("long").alias("stop"), F.substring("text", at["start"] + 1, at["end"] - at["start"]).alias("text"))


@query(_HYBRID + """SELECT question_id, item_id, best, lists, position FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY best, item_id) AS position FROM
  (SELECT question_id, item_id, min(rank) AS best, count(*) AS lists FROM (SELECT question_id, item_id, rank FROM vec UNION ALL SELECT question_id, item_id, rank FROM kw) GROUP BY ALL)) WHERE position <= 15""")
def candidate_union_cap(spark, sf):
    vec, kw, _ = _hybrid_lists(spark, sf)
    out = retrieval.union_capped([vec, kw], ["question_id"], "item_id", 15)
    return out.select("question_id", "item_id", F.col("best").cast("long"), "lists", F.col("position").cast("long"))


@query(r"""WITH d AS (SELECT source, doc_id, len(regexp_extract_all(text, '\S+')) AS tokens FROM documents), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM d)
SELECT source, doc_id, tokens, used FROM r WHERE used <= 3500""")
def context_budget(spark, sf):
    """Evidence in rank order (here doc_id) while 3,500 tokens last, for each source."""
    d = table(spark, sf, "documents").select("source", "doc_id", T.word_count(F.col("text")).cast("long").alias("tokens"))
    return retrieval.within_budget(d, ["source"], ["doc_id"], "tokens")


@query(_RERANK + r""", c AS (SELECT question_id, item_id, after, len(regexp_extract_all(text, '\S+')) AS tokens FROM r JOIN documents ON doc_id = item_id WHERE after <= 30),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY question_id ORDER BY after)::BIGINT AS used FROM c)
SELECT question_id, count(*) FILTER (WHERE used <= 3500) AS evidence, coalesce(max(used) FILTER (WHERE used <= 3500), 0) AS tokens,
  CASE WHEN count(*) FILTER (WHERE used <= 3500) = 0 THEN 'insufficient_evidence' ELSE 'answered' END AS status FROM u GROUP BY question_id""")
def ask(spark, sf):
    """From question to evidence in one plan: authorize, rank, fuse, rerank, pack, status."""
    r = _reranked(spark, sf, 30).withColumn("tokens", T.word_count(F.col("text")).cast("long"))
    upto = Window.partitionBy("question_id").orderBy("after").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("used", F.sum("tokens").over(upto)).withColumn("fits", F.col("used") <= 3500)
    out = r.groupBy("question_id").agg(F.count_if("fits").alias("evidence"), F.coalesce(F.max(F.when(F.col("fits"), F.col("used"))), F.lit(0)).alias("tokens"))
    return out.withColumn("status", evaluation.status(F.col("evidence"), F.col("evidence"), F.lit(0), F.lit(True)))


@query(_RERANK + "SELECT question_id, item_id, rerank_score FROM r WHERE after <= 30")
def stand_in_cross_encoder(spark, sf):
    """Scores of all hybrid candidates by the stand-in scorer (no neural model is available here)."""
    return _reranked(spark, sf, 30).select("question_id", "item_id", "rerank_score")


@query("""SELECT doc_id, CASE WHEN length(text) < 40 THEN 'clarification' WHEN lang = 'en' THEN 'lookup' ELSE 'cross-policy' END AS route FROM documents""")
def triage(spark, sf):
    route = F.when(F.length("text") < 40, "clarification").when(F.col("lang") == "en", "lookup").otherwise("cross-policy")
    return table(spark, sf, "documents").select("doc_id", route.alias("route"))


# ---------------------------------------------------------------- retrieval over chunks


def _versions(spark, sf) -> DataFrame:
    """Documents as versions: three in a row are one policy's, a year apart from 2020 on; the source is the corpus."""
    docs = table(spark, sf, "documents")
    start = F.make_date(2020 + F.col("doc_id") % 3, F.lit(1), F.lit(1))
    return docs.select(F.col("doc_id").cast("string").alias("document_version_id"), "doc_id", F.expr("doc_id div 3").alias("policy"), start.alias("effective_from"), F.col("source").alias("corpus_id"))


def _chunked(spark, sf) -> DataFrame:
    """Chunks with corpus, tenant and both rules: those of documents in force on 2021-06-30, in the core corpora of even sources."""
    versions_ = _versions(spark, sf)
    current = versions.as_of(versions_, "policy", "effective_from", "doc_id", F.lit("2021-06-30").cast("date")).select("doc_id")
    meta = versions_.join(current, "doc_id", "left_semi").select("document_version_id", F.when(F.col("corpus_id").isin(*_EVEN), "core").otherwise("attic").alias("corpus_id"))
    chunks = staged(chunking.chunk_documents(structured(spread(table(spark, sf, "documents")).join(current, "doc_id", "left_semi")))).join(meta, "document_version_id")
    rule = F.when(F.col("access_policy_id") == "restricted", "store").otherwise("staff")
    return chunks.withColumn("tenant_id", F.lit("museum")).withColumn("document_policy_id", F.lit("staff")).withColumn("access_policy_id", rule)


_EVEN = [f"src{i}" for i in range(0, 20, 2)]
_IN_FORCE = "SELECT arg_max(doc_id, make_date((2020 + doc_id % 3)::INT, 1, 1)) AS doc_id FROM documents WHERE make_date((2020 + doc_id % 3)::INT, 1, 1) <= DATE '2021-06-30' GROUP BY doc_id // 3"
_CHUNK_ITEMS = f"""cx AS MATERIALIZED (SELECT c.*, d.doc_id, d.source IN ({", ".join(map(repr, _EVEN))}) AND c.access_policy_id = 'internal' AS readable FROM ({_CHUNKS}) c JOIN documents d ON d.doc_id::VARCHAR = c.document_version_id
  WHERE d.doc_id IN ({_IN_FORCE})),
ch AS MATERIALIZED (SELECT * FROM cx WHERE readable)"""


def _asked_chunks(spark, sf) -> tuple[DataFrame, DataFrame]:
    user = principals(spark).where("user_id = 'ada'")
    return retrieval.readable(_chunked(spark, sf), policies(spark), user, ["core"]), _questions(spark, sf)


_CHUNK_KW = _KW.replace("SELECT DISTINCT doc_id AS item_id", "SELECT DISTINCT chunk_id AS item_id").replace("FROM documents {where}", "FROM ch").replace("JOIN documents x ON x.doc_id = m.item_id", "JOIN ch x ON x.chunk_id = m.item_id")


@query("WITH " + _CHUNK_ITEMS + "," + _CHUNK_KW + "SELECT question_id, item_id AS chunk_id, heading_path, score, kw.rank FROM kw JOIN ch ON ch.chunk_id = kw.item_id")
def chunk_retrieval(spark, sf):
    """From documents to cited chunks in one plan: versions in force, chunks, corpus scope, both access rules, then the best ten."""
    chunks, asked = _asked_chunks(spark, sf)
    best = retrieval.keyword_top(chunks.select(F.col("chunk_id").alias("item_id"), "text"), asked)
    named = chunks.select(F.col("chunk_id").alias("item_id"), "heading_path")
    return best.join(named, "item_id").select("question_id", F.col("item_id").alias("chunk_id"), "heading_path", "score", F.col("rank").cast("long").alias("rank"))


_KEY_WORDS = r"regexp_extract_all(lower({x}), '[\p{L}\p{N}]+(?:\.\p{N}+)*')"
#: Phrases resolved to sections by their longest match; edges with their span; those that ada may see.
_EDGES = r"""
ph AS (SELECT chunk_id, doc_id, section_ordinal, text, spans, unnest(string_split(reference_refs, ' / ')) AS phrase FROM cx WHERE reference_refs <> ''),
gr AS (SELECT chunk_id, phrase, array_to_string(w[i:i + n - 1], ' ') AS key, n, i FROM (SELECT *, unnest(generate_series(1, least(14, len(w) - i + 1))) AS n FROM (SELECT chunk_id, phrase, {words:phrase} AS w, unnest(generate_series(1, len({words:phrase}))) AS i FROM ph))),
hs AS MATERIALIZED (SELECT doc_id, section_ordinal, heading FROM ({sections}) WHERE doc_id IN ({in_force}) AND (section_ordinal > 0 OR body_end > 0)),
nm AS (SELECT chunk_id, phrase, arg_min(doc_id, (-n, i, doc_id::VARCHAR)) AS named FROM gr JOIN (SELECT DISTINCT doc_id, 'manual ' || doc_id AS key FROM hs) USING (key) GROUP BY ALL),
ak AS (SELECT ph.*, named, coalesce(named, doc_id) AS dst_doc FROM ph LEFT JOIN nm USING (chunk_id, phrase)),
hk AS (SELECT DISTINCT doc_id, section_ordinal, unnest([array_to_string({words:heading}, ' '), CASE WHEN num <> '' THEN 'section ' || num END, array_to_string({words:title}, ' ')]) AS key
  FROM (SELECT *, regexp_extract(heading, '^(?:Section )?(\d+(?:\.\d+)*) ', 1) AS num, regexp_replace(heading, '^(?:Section )?\d+(?:\.\d+)* ', '') AS title FROM hs WHERE section_ordinal > 0)),
mt AS (SELECT chunk_id, phrase, arg_min(hk.section_ordinal, (-n, i, hk.section_ordinal)) AS dst_section FROM ak JOIN gr USING (chunk_id, phrase) JOIN hk ON hk.doc_id = dst_doc AND hk.key = gr.key GROUP BY ALL),
e0 AS (SELECT ak.*, coalesce(dst_section, CASE WHEN named IS NOT NULL THEN 0 END) AS sec FROM ak LEFT JOIN mt USING (chunk_id, phrase)),
ed AS MATERIALIZED (SELECT chunk_id, doc_id, section_ordinal, phrase, CASE WHEN good THEN dst_doc END AS dst_doc, CASE WHEN good THEN sec END AS dst_section, strpos(text, phrase) - 1 AS local, spans,
    CASE WHEN good THEN 'validated' WHEN sec IS NOT NULL THEN 'self' ELSE 'unresolved' END AS validation_status
  FROM (SELECT *, sec IS NOT NULL AND NOT (dst_doc = doc_id AND sec = section_ordinal) AS good FROM e0)),
ve AS MATERIALIZED (SELECT * FROM ed WHERE validation_status = 'validated' AND chunk_id IN (SELECT chunk_id FROM ch) AND (dst_doc, dst_section) IN (SELECT (doc_id, section_ordinal) FROM ch))"""
_EDGES = _EDGES.replace("{sections}", _BODIES + "SELECT doc_id, section_ordinal, heading, body_end FROM s").replace("{in_force}", _IN_FORCE)
_EDGES = re.sub(r"\{words:(\w+)\}", lambda x: _KEY_WORDS.replace("{x}", x[1]), _EDGES)


def _graph(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All chunks in force, those ada may read, all edges found in their texts, and the visible ones."""
    every = _chunked(spark, sf)
    chunks = retrieval.readable(every, policies(spark), principals(spark).where("user_id = 'ada'"), ["core"])
    current = every.select("document_version_id").distinct()
    parts = chunking.sections(structured(spread(table(spark, sf, "documents")))).join(current, "document_version_id", "left_semi")
    edges = staged(references.reference_edges(every, parts))
    return every, chunks, edges, references.visible_edges(edges, chunks)


@query("WITH " + _CHUNK_ITEMS + "," + _EDGES + """ SELECT chunk_id, doc_id::VARCHAR AS document_version_id, section_ordinal, phrase, dst_doc::VARCHAR AS dst_document, dst_section, validation_status,
  chunk_id IN (SELECT chunk_id FROM ch) AND coalesce((dst_doc, dst_section) IN (SELECT (doc_id, section_ordinal) FROM ch), false) AND validation_status = 'validated' AS visible FROM ed""")
def reference_graph(spark, sf):
    """References found in chunks, resolved to sections, and which of them the principal may see: both ends and the supporting chunk."""
    _, _, edges, visible = _graph(spark, sf)
    seen = visible.select("chunk_id", "phrase", F.lit(True).alias("visible"))
    out = edges.join(seen, ["chunk_id", "phrase"], "left")
    return out.select(
        "chunk_id", "document_version_id", F.col("section_ordinal").cast("long").alias("section_ordinal"), "phrase", "dst_document", F.col("dst_section").cast("long").alias("dst_section"),
        "validation_status", F.coalesce("visible", F.lit(False)).alias("visible"))


@query("WITH " + _CHUNK_ITEMS + "," + _EDGES + """ SELECT ed.chunk_id, phrase, ed.local + cx.source_start AS start, substr(t.text, (ed.local + cx.source_start + 1)::BIGINT, length(phrase)::BIGINT) AS text
  FROM ed JOIN cx USING (chunk_id) JOIN (""" + _LINES + """SELECT DISTINCT doc_id, text FROM h) t ON t.doc_id = cx.doc_id WHERE len(string_split(cx.spans, '},{')) = 1""")
def reference_spans(spark, sf):
    """Where each reference stands in its source: the span slices back to the phrase (chunks of one span)."""
    every, _, edges, _ = _graph(spark, sf)
    one = every.where("size(spans) = 1").select("chunk_id")
    texts = structured(spread(table(spark, sf, "documents"))).select("document_version_id", "text")
    out = edges.join(one, "chunk_id", "left_semi").join(texts, "document_version_id")
    return out.select("chunk_id", "phrase", F.col("start").cast("long").alias("start"), F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"))


@query("WITH " + _CHUNK_ITEMS + """, au AS (SELECT document_version_id, section_ordinal, min(source_start) AS start, max(source_end) AS stop, count(*) AS n, max(chunk_ordinal) - min(chunk_ordinal) + 1 AS room FROM ch GROUP BY ALL)
SELECT document_version_id, section_ordinal, start::BIGINT AS start, stop::BIGINT AS stop FROM au WHERE n = room""")
def parent_expansion_authorized(spark, sf):
    """What the principal may read of each parent: the intervals that readable chunks cover, never a restricted sibling's."""
    chunks = retrieval.readable(_chunked(spark, sf), policies(spark), principals(spark).where("user_id = 'ada'"), ["core"])
    return evidence.authorized_intervals(chunks).select("document_version_id", *[F.col(c).cast("long").alias(c) for c in ("section_ordinal", "start", "stop")])


@query("WITH " + _CHUNK_ITEMS + ", tx AS (SELECT DISTINCT doc_id, text FROM (" + _LINES + """SELECT doc_id, text FROM h))
SELECT chunk_id, CASE WHEN readable THEN 'found' ELSE 'not_found' END AS status, CASE WHEN readable THEN substr(t.text, source_start + 1, source_end - source_start) END AS excerpt FROM cx JOIN tx t USING (doc_id)""")
def source_excerpt(spark, sf):
    """The source behind each chunk, from its first span to its last; what may not be read looks as if it weren't there."""
    every = _chunked(spark, sf)
    chunks = retrieval.readable(every, policies(spark), principals(spark).where("user_id = 'ada'"), ["core"])
    texts = structured(spread(table(spark, sf, "documents"))).select("document_version_id", F.col("text").alias("source"))
    asked = every.select("chunk_id", "document_version_id", "source_start", "source_end").join(chunks.select("chunk_id", F.lit(True).alias("ok")), "chunk_id", "left").join(texts, "document_version_id")
    shown = F.when(F.col("ok"), F.substring("source", F.col("source_start") + 1, F.col("source_end") - F.col("source_start")))
    return asked.select("chunk_id", F.when(F.col("ok"), "found").otherwise("not_found").alias("status"), shown.alias("excerpt"))


_PACK_BUDGETS = (1700, 3500)


@query("WITH " + _CHUNK_ITEMS + "," + _CHUNK_KW + "," + _EDGES + r""",
tx AS (SELECT DISTINCT doc_id, text FROM (""" + _LINES + r"""SELECT doc_id, text FROM h)),
sp AS (SELECT *, unnest(from_json(spans, '[{"start":"BIGINT","end":"BIGINT"}]')) AS x FROM cx),
sel AS (SELECT question_id, item_id AS chunk_id, kw.rank, doc_id, section_ordinal, chunk_ordinal FROM kw JOIN ch ON ch.chunk_id = kw.item_id WHERE kw.rank <= 5),
runs AS (SELECT a.chunk_id, b.chunk_id AS linked, b.readable FROM cx a JOIN cx b ON b.doc_id = a.doc_id AND b.section_ordinal = a.section_ordinal AND b.chunk_ordinal > a.chunk_ordinal
  WHERE NOT EXISTS (SELECT 1 FROM cx c WHERE c.doc_id = a.doc_id AND c.section_ordinal = a.section_ordinal AND c.chunk_ordinal >= a.chunk_ordinal AND c.chunk_ordinal < b.chunk_ordinal AND c.exception_refs = '')),
au AS (SELECT doc_id, section_ordinal, min(source_start) AS start, max(source_end) AS stop FROM ch GROUP BY ALL),
nd AS (SELECT question_id, 2 * (sel.rank - 1) AS bit, sel.doc_id, x.start AS start, x.end AS stop FROM sel JOIN sp USING (chunk_id)
  UNION ALL SELECT question_id, 2 * sel.rank - 1, sel.doc_id, x.start, x.end FROM sel JOIN runs ON runs.chunk_id = sel.chunk_id JOIN sp ON sp.chunk_id = linked
  UNION ALL SELECT DISTINCT question_id, 10 + sel.rank - 1, au.doc_id, start, stop FROM sel JOIN (SELECT DISTINCT doc_id, section_ordinal, dst_doc, dst_section FROM ve) v ON v.doc_id = sel.doc_id AND v.section_ordinal = sel.section_ordinal JOIN au ON au.doc_id = dst_doc AND au.section_ordinal = dst_section
  UNION ALL SELECT question_id, 15 + sel.rank - 1, sel.doc_id, start, stop FROM sel JOIN au ON au.doc_id = sel.doc_id),
bd AS (SELECT question_id, doc_id, edge, lead(edge) OVER (PARTITION BY question_id, doc_id ORDER BY edge) AS nxt FROM (SELECT question_id, doc_id, start AS edge FROM nd UNION SELECT question_id, doc_id, stop FROM nd)),
ow AS (SELECT bd.question_id, bd.doc_id, edge AS start, nxt AS stop, min(bit) AS bit FROM bd JOIN nd ON nd.question_id = bd.question_id AND nd.doc_id = bd.doc_id AND nd.start <= edge AND nd.stop >= nxt GROUP BY ALL),
pt AS MATERIALIZED (SELECT ow.*, substr(text, start + 1, stop - start) AS text, len(regexp_extract_all(substr(text, start + 1, stop - start), '\S+')) AS tokens FROM ow JOIN tx USING (doc_id)),
co AS (SELECT n.question_id, n.bit, sum(coalesce(c.cost, 0)) OVER (PARTITION BY n.question_id ORDER BY n.bit)::BIGINT AS used FROM (SELECT DISTINCT question_id, bit FROM nd) n LEFT JOIN (SELECT question_id, bit, sum(tokens) AS cost FROM pt GROUP BY ALL) c USING (question_id, bit)),
st AS (SELECT question_id, budget, min(bit) FILTER (WHERE used > budget) AS stop_bit FROM co, (VALUES {budgets}) AS g(budget) GROUP BY ALL),
status AS (SELECT *, CASE WHEN coalesce(stop_bit = 0 OR (stop_bit < 10 AND stop_bit % 2 = 1), false) THEN 'insufficient_evidence' ELSE 'answered' END AS status FROM st)
SELECT budget, question_id, status, kind, document_version_id, count(*) AS words, sum(('0x' || substr(md5(word), 1, 8))::BIGINT)::BIGINT AS mark, max(used) AS used FROM (
  SELECT budget, s.question_id, status, CASE WHEN bit < 10 AND bit % 2 = 0 THEN 'evidence' WHEN bit < 10 THEN 'exception' WHEN bit < 15 THEN 'reference' ELSE 'parent' END AS kind, doc_id::VARCHAR AS document_version_id, used, unnest(regexp_extract_all(text, '\S+')) AS word
  FROM status s JOIN pt USING (question_id) JOIN co USING (question_id, bit) WHERE status = 'answered' AND (stop_bit IS NULL OR bit < stop_bit)) GROUP BY ALL
UNION ALL SELECT budget, question_id, status, NULL, NULL, 0, NULL, NULL FROM status WHERE status <> 'answered'
""".replace("{budgets}", ", ".join(f"({b})" for b in _PACK_BUDGETS)))
def context_pack(spark, sf):
    """Five chunks a question with their exceptions, the sections they refer to and their documents' readable rest, no word twice, within 1,700 and 3,500 tokens.

    The result tells for each kind and document how many words were packed, with a digest of them.
    """
    every, chunks, _, edges = _graph(spark, sf)
    best = retrieval.keyword_top(chunks.select(F.col("chunk_id").alias("item_id"), "text"), _questions(spark, sf)).withColumnRenamed("item_id", "chunk_id")
    texts = structured(spread(table(spark, sf, "documents"))).select("document_version_id", "text")
    best = staged(best.where("rank <= 5").select("question_id", "chunk_id", "rank"))
    packs = [evidence.pack(best, every, chunks, edges, texts, ["question_id"], b).withColumn("budget", F.lit(b)) for b in _PACK_BUDGETS]
    words = reduce(DataFrame.unionByName, packs).select("budget", "question_id", "status", "kind", "document_version_id", "used", F.explode_outer(T.words(F.col("text"))).alias("word"))
    mark = F.sum(F.conv(F.substring(F.md5(F.encode("word", "UTF-8")), 1, 8), 16, 10).cast("long")).alias("mark")
    return words.groupBy("budget", "question_id", "status", "kind", "document_version_id").agg(F.count("word").alias("words"), mark, F.max("used").alias("used"))


_GRAPH_RERANK = "WITH RECURSIVE " + _CHUNK_ITEMS + "," + _CHUNK_KW + "," + _EDGES + rf""",
vl AS (SELECT b.item_id AS question_id, ch.chunk_id AS item_id, row_number() OVER (PARTITION BY b.item_id ORDER BY {_SIM} DESC, ch.chunk_id) AS rank
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings e ON true JOIN ch ON ch.doc_id = e.vec_id AND ch.section_ordinal = 1 AND ch.chunk_ordinal = 0 QUALIFY rank <= 10),
hf AS (SELECT question_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT question_id, item_id, rank FROM vl UNION ALL SELECT question_id, item_id, rank FROM kw) GROUP BY ALL),
hr AS (SELECT question_id, item_id AS chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS rank FROM hf),
sd AS (SELECT question_id, doc_id, section_ordinal, min(hr.rank) AS seed FROM hr JOIN ch USING (chunk_id) GROUP BY ALL),
nr AS (SELECT question_id, dst_doc, dst_section, min(seed) AS seed FROM sd JOIN (SELECT DISTINCT doc_id, section_ordinal, dst_doc, dst_section FROM ve) v USING (doc_id, section_ordinal) GROUP BY ALL),
fc AS (SELECT chunk_id, doc_id, section_ordinal, row_number() OVER (PARTITION BY doc_id, section_ordinal ORDER BY chunk_ordinal, chunk_id) AS n FROM ch),
ad AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY seed, fc.doc_id::VARCHAR, fc.section_ordinal, n) AS place FROM nr JOIN fc ON fc.doc_id = dst_doc AND fc.section_ordinal = dst_section AND n <= 10
  WHERE (question_id, chunk_id) NOT IN (SELECT (question_id, chunk_id) FROM hr) QUALIFY place <= 10),
ev AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hop, place) AS before FROM (SELECT question_id, chunk_id, 0 AS hop, rank AS place FROM hr UNION ALL SELECT question_id, chunk_id, 1, place FROM ad) QUALIFY before <= 30),
""" + _windows_sql(r"""SELECT ev.question_id, ev.chunk_id AS item_id, hop, before, ch.text, 'Manual ' || doc_id || ' ' || heading_path AS title,
  512 - 3 - len(regexp_extract_all(b.text, '\S+')) - len(regexp_extract_all('Manual ' || doc_id || ' ' || heading_path, '\S+')) AS b FROM ev JOIN ch ON ch.chunk_id = ev.chunk_id JOIN benchmark b ON b.item_id = ev.question_id""") + rf""",
sc AS (SELECT x.*, {_OVERLAP} AS score FROM (SELECT win.question_id, win.item_id, w, hop, before, substr(text, a + 1, e - a) AS shown, list_distinct(regexp_extract_all(lower(title || ' ' || substr(text, a + 1, e - a)), {_TOKENS})) AS dt FROM win JOIN pr USING (question_id, item_id)) x
  JOIN (SELECT item_id AS question_id, list_distinct(regexp_extract_all(lower(text), {_TOKENS})) AS qt FROM benchmark) b USING (question_id)),
bw AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY question_id, item_id ORDER BY score DESC, w) = 1)
SELECT question_id, item_id AS chunk_id, hop, before, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS after, score AS rerank_score, w AS window, shown AS text FROM bw QUALIFY after <= 15"""


def _hybrid_chunks(spark, sf, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """question_id, chunk_id, rank: keyword and vector lists of chunks fused; a document's vector stands for its first chunk of text."""
    kw = retrieval.keyword_top(chunks.select(F.col("chunk_id").alias("item_id"), "text"), asked)
    first = chunks.where("section_ordinal = 1 and chunk_ordinal = 0").select(F.col("document_version_id").cast("long").alias("vec_id"), "chunk_id")
    e = table(spark, sf, "embeddings")
    vecs = e.join(first, "vec_id").select(F.col("chunk_id").alias("item_id"), "embedding")
    q = e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")).join(asked.select("question_id"), "question_id", "left_semi")
    return retrieval.rrf([retrieval.nearest(vecs, q), kw], ["question_id"], "item_id").select("question_id", F.col("item_id").alias("chunk_id"), "rank")


@query(_GRAPH_RERANK)
def graph_rerank(spark, sf):
    """Hybrid candidates, ten more at most along references found in text, thirty in all, reranked by their best windows; the first fifteen."""
    _, chunks, _, edges = _graph(spark, sf)
    asked = _questions(spark, sf)
    every = references.with_referenced(_hybrid_chunks(spark, sf, chunks, asked), edges, chunks, ["question_id"]).withColumnRenamed("rank", "before")
    pairs = every.join(chunks.select("chunk_id", "document_title", "heading_path", "text", "spans"), "chunk_id").join(asked, "question_id")
    windows = chunking.rerank_windows(pairs)
    shown = F.concat_ws(" ", "document_title", "heading_path", "window_text")
    best = retrieval.best_windows(windows, ["question_id"], "chunk_id", retrieval.overlap_score(F.col("question"), shown), ["hop", "before"])
    out = retrieval.top_k(best, ["question_id"], "rerank_score", "chunk_id", 15)
    return out.select(
        "question_id", "chunk_id", "hop", F.col("before").cast("long").alias("before"), F.col("rank").cast("long").alias("after"), "rerank_score",
        F.col("window_index").cast("long").alias("window"), F.col("window_text").alias("text"))


def _labelled_sections(spark, sf) -> DataFrame:
    """Sections with tenant, corpus and both rules."""
    parts = chunking.sections(structured(spread(table(spark, sf, "documents"))))
    rule = F.when(F.col("access_policy_id") == "restricted", "store").otherwise("staff")
    return parts.withColumn("tenant_id", F.lit("museum")).withColumn("corpus_id", F.lit("core")).withColumn("document_policy_id", F.lit("staff")).withColumn("access_policy_id", rule)


@query(_BODIES + """SELECT x.section_id, heading, CASE WHEN heading IS NULL THEN 'not_found' ELSE 'found' END AS status, length(body)::BIGINT AS chars
  FROM (SELECT doc_id || ':' || h AS section_id FROM documents, (VALUES ('1 Purpose'), ('2.1 Review Steps'), ('9 Nowhere')) AS v(h) WHERE doc_id % 50 = 0) x
  LEFT JOIN (SELECT doc_id || ':' || heading AS section_id, heading, substr(text, (body_start + 1)::BIGINT, (body_end - body_start)::BIGINT) AS body FROM s WHERE access_policy_id = 'internal') y USING (section_id)""")
def section_lookup(spark, sf):
    """Sections by id, for every 50th document; a forbidden section and one that doesn't exist look the same."""
    asked = table(spark, sf, "documents").where("doc_id % 50 = 0").select(F.explode(F.array(*[F.concat("doc_id", F.lit(f":{h}")) for h in ("1 Purpose", "2.1 Review Steps", "9 Nowhere")])).alias("section_id"))
    ok = retrieval.readable(_labelled_sections(spark, sf), policies(spark), principals(spark).where("user_id = 'ada'"))
    return retrieval.get_sections(asked, ok).select("section_id", "heading", "status", F.length("body").cast("long").alias("chars"))


@query(_BODIES + """, q AS (SELECT doc_id, heading, row_number() OVER (PARTITION BY doc_id, heading ORDER BY section_ordinal) AS place, sha256(substr(text, (body_start + 1)::BIGINT, (body_end - body_start)::BIGINT)) AS digest FROM s WHERE access_policy_id = 'internal'),
pairs AS (SELECT a.doc_id AS first, b.doc_id AS second FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 3 = 0),
o AS (SELECT first, second, heading, place, digest AS a FROM pairs JOIN q ON doc_id = first), w AS (SELECT first, second, heading, place, digest AS b FROM pairs JOIN q ON doc_id = second)
SELECT first::VARCHAR AS first, second::VARCHAR AS second, heading, place, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN w USING (first, second, heading, place)""")
def compare_versions(spark, sf):
    """Each policy's first version against its second, readable section by section."""
    parts = _labelled_sections(spark, sf)
    parts = retrieval.readable(parts, policies(spark), principals(spark).where("user_id = 'ada'"))
    ids_ = table(spark, sf, "documents").select("doc_id")
    pairs = ids_.where("doc_id % 3 = 0").join(ids_.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id", "left_semi")
    pairs = pairs.select(F.col("doc_id").cast("string").alias("first"), (F.col("doc_id") + 1).cast("string").alias("second"))
    return versions.compare(parts, pairs).withColumn("place", F.col("place").cast("long"))


# ---------------------------------------------------------------- graph, versions, quality


@query("""SELECT 'n' || n_nationkey AS seed, 'c' || c_custkey AS neighbour, 'HAS_CUSTOMER' AS type, position FROM (
  SELECT n_nationkey, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY 'c' || c_custkey) AS position FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal >= 0) WHERE position <= 10""")
def graph_one_hop(spark, sf):
    """From each nation along validated edges to customers in good standing, ten at most."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    nodes = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit(True).alias("open")).union(customer.select(F.concat(F.lit("c"), "c_custkey"), F.col("c_acctbal") >= 0))
    edges = customer.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("HAS_CUSTOMER").alias("type"), F.lit("validated").alias("validation_status"))
    edges = edges.union(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit("IN_REGION"), F.lit("schema-preview")))
    out = graph.one_hop(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("seed")), edges, nodes, ["HAS_CUSTOMER", "IN_REGION"], 10, F.col("open"))
    return out.withColumn("position", F.col("position").cast("long"))


def _people(spark, sf) -> DataFrame:
    """Customers as a binary tree of managers, a few of whom manage each other in a circle."""
    key = F.col("c_custkey")
    circle = F.when(key == 600, 1201).when(key > 1, F.floor(key / 2))
    return table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("user_id"), F.concat(F.lit("c"), circle).alias("manager_id"))


_TREE = "WITH RECURSIVE p AS (SELECT c_custkey AS k, CASE WHEN c_custkey = 600 THEN 1201 WHEN c_custkey > 1 THEN c_custkey // 2 END AS m FROM customer), "


@query(_TREE + """t(user_id, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT k, depth + 1 FROM p JOIN t ON m = t.user_id) SELECT 'c' || user_id AS user_id, depth::BIGINT AS depth FROM t""")
def reporting_subtree(spark, sf):
    """Everyone below the first customer: one range of the tree's labels."""
    return graph.below(graph.tree_labels(_people(spark, sf)), "c1").withColumn("depth", F.col("depth").cast("long"))


@query(_TREE + """r AS (SELECT k FROM p WHERE m IS NULL UNION ALL SELECT p.k FROM p JOIN r ON p.m = r.k), t(top, k) AS (SELECT k, k FROM r UNION ALL SELECT top, p.k FROM p JOIN t ON p.m = t.k),
o AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1)
SELECT 'c' || top AS user_id, count(*) - 1 AS people, coalesce(sum(orders) FILTER (WHERE t.k <> top), 0)::BIGINT AS orders FROM t LEFT JOIN o ON o.k = t.k GROUP BY top""")
def relationship_scope(spark, sf):
    """For everyone the people below and their orders, by intervals of labels; nobody's subtree is listed."""
    orders = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("user_id"), F.lit(1).cast("long").alias("orders"))
    return graph.sums_below(graph.tree_labels(_people(spark, sf)), orders, "orders")


@query(_TREE + """t(k) AS (SELECT 5::BIGINT UNION ALL SELECT p.k FROM p JOIN t ON p.m = t.k)
SELECT o_orderkey, 'c' || o_custkey AS owner, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_custkey IN (SELECT k FROM t) QUALIFY rank <= 10""")
def scope_topk(spark, sf):
    """The ten largest orders of those whose rule invokes the reporting subtree of one manager: the range stands below the top-k."""
    own = graph.below(graph.tree_labels(_people(spark, sf)), "c5").select(F.col("user_id").alias("owner"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("c"), "o_custkey").alias("owner"))
    best = orders.join(own, "owner", "left_semi").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)
    return best.select("o_orderkey", "owner", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("rank"))


@query("""SELECT 'customer' AS label, count(*) AS nodes, count(*) - count(DISTINCT c_custkey) AS repeated FROM customer UNION ALL SELECT 'nation', count(*), count(*) - count(DISTINCT n_nationkey) FROM nation""")
def node_uniqueness(spark, sf):
    nodes = table(spark, sf, "customer").select(F.lit("customer").alias("label"), F.col("c_custkey").cast("string").alias("id")).union(table(spark, sf, "nation").select(F.lit("nation"), F.col("n_nationkey").cast("string")))
    extra = graph.duplicate_ids(nodes).groupBy("label").agg(F.sum(F.col("n") - 1).alias("repeated"))
    return nodes.groupBy("label").agg(F.count("*").alias("nodes")).join(extra, "label", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def as_of_version(spark, sf):
    return versions.as_of(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", F.lit("1996-06-30").cast("timestamp"))


@query("""SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def version_chain(spark, sf):
    return versions.chain(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").drop("o_orderdate")


@query("""SELECT a.o_custkey, a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderpriority <> b.o_orderpriority WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'O'""")
def active_conflicts(spark, sf):
    active = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_orderpriority")
    return versions.conflicts(active, "o_custkey", "o_orderkey", "o_orderpriority")


_GROUPS = """WITH a AS (SELECT *, o_orderdate + INTERVAL 90 DAY AS until FROM orders WHERE o_orderstatus = 'O'),
n AS (SELECT *, CASE WHEN o_orderdate <= max(until) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM a),
r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM n)
SELECT o_custkey, min(o_orderdate) AS o_orderdate, max(until) AS until, count(*) AS versions, count(DISTINCT o_orderpriority) AS values FROM r GROUP BY o_custkey, run HAVING count(DISTINCT o_orderpriority) > 1"""


@query(_GROUPS)
def conflict_groups(spark, sf):
    """Open orders of a customer as versions in force for ninety days: runs that overlap and disagree in priority, by a sweep."""
    active = table(spark, sf, "orders").where("o_orderstatus = 'O'").withColumn("until", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return versions.conflict_groups(active, "o_custkey", "o_orderkey", "o_orderdate", "until", "o_orderpriority")


@query("""SELECT o_orderkey, o_orderdate <= TIMESTAMP '1996-06-30' AND (TIMESTAMP '1996-06-30' <= o_orderdate + INTERVAL 365 DAY) AS in_force FROM orders""")
def versions_in_force(spark, sf):
    date = F.lit("1996-06-30").cast("timestamp")
    return table(spark, sf, "orders").select("o_orderkey", versions.in_force(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"), date).alias("in_force"))


@query("""SELECT sha256(text) AS sha256, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_hashes(spark, sf):
    return quality.duplicates(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id", "sha256")


@query("""SELECT DISTINCT doc_id * 2 AS doc_id FROM documents WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)""")
def unresolved_references(spark, sf):
    """Each document refers to the one with twice its id; these are not there."""
    docs = table(spark, sf, "documents").select("doc_id")
    return quality.missing(docs.select((F.col("doc_id") * 2).alias("doc_id")).distinct(), docs, "doc_id")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_acl(spark, sf):
    return quality.missing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("""WITH w AS (SELECT doc_id, sha256('title: ' || source || ' / ' || lang || ' | text: ' || text) AS h FROM documents),
c AS (SELECT CASE vec_id % 10 WHEN 1 THEN sha256(h) ELSE h END AS h, CASE vec_id % 10 WHEN 2 THEN 'old' ELSE 'm1' END AS m, CASE vec_id % 10 WHEN 3 THEN 32 ELSE len(embedding) END AS d, CASE vec_id % 10 WHEN 4 THEN 'p0' ELSE 'p1' END AS p FROM embeddings JOIN w ON doc_id = vec_id)
SELECT doc_id FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.h = w.h AND m = 'm1' AND d = 64 AND p = 'p1')""")
def embedding_cache_missing(spark, sf):
    """Texts whose embedding must be made: the cache holds some of them, a tenth each of another input, model, dimension or preprocessing."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(T.embedding_input(F.col("source"), F.col("lang"), F.col("text")), 256).alias("input_sha256"))
    wanted = docs.select("*", F.lit("m1").alias("model_digest"), F.lit(64).alias("dimension"), F.lit("p1").alias("preprocessing"))
    last = F.col("vec_id") % 10
    cache = table(spark, sf, "embeddings").join(docs, F.col("doc_id") == F.col("vec_id")).select(
        F.when(last == 1, F.sha2("input_sha256", 256)).otherwise(F.col("input_sha256")).alias("input_sha256"), F.when(last == 2, "old").otherwise("m1").alias("model_digest"),
        F.when(last == 3, 32).otherwise(F.size("embedding")).alias("dimension"), F.when(last == 4, "p0").otherwise("p1").alias("preprocessing"))
    return generations.missing_embeddings(wanted, cache).select("doc_id")


@query("""SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')""")
def allowlist(spark, sf):
    """Only what the manifest lists is ever read."""
    listed = _literal([("src1",), ("src3",), ("src5",)], ["source"], ["string"], spark)
    return table(spark, sf, "documents").join(F.broadcast(listed), "source", "left_semi").select("doc_id", "source")


@query("""SELECT 'duplicate' AS finding, min(doc_id)::VARCHAR AS subject FROM documents GROUP BY text HAVING count(*) > 1 UNION ALL SELECT 'missing_acl', doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT DISTINCT 'unresolved_reference', (doc_id * 2)::VARCHAR FROM documents WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'conflict', o_custkey::VARCHAR FROM (""" + _GROUPS + ")")
def quality_findings(spark, sf):
    return quality.findings(conflict=conflict_groups(spark, sf).select("o_custkey"), duplicate=duplicate_hashes(spark, sf).select("first"), missing_acl=missing_acl(spark, sf), unresolved_reference=unresolved_references(spark, sf))


_SNAP = "SELECT o_orderkey, sha256(o_orderstatus || {x}) AS d FROM orders WHERE o_orderkey % 7 <> {r}"


@query(f"""SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.d IS NULL THEN 'added' WHEN a.d IS NULL THEN 'removed' WHEN a.d <> b.d THEN 'changed' ELSE 'same' END AS change
  FROM ({_SNAP.format(x="'x'", r=0)}) b FULL JOIN ({_SNAP.format(x="CASE WHEN o_orderkey % 5 = 0 THEN 'y' ELSE 'x' END", r=1)}) a USING (o_orderkey)""")
def snapshot_diff(spark, sf):
    """Two snapshots of orders: each lacks a seventh, a fifth has changed."""
    o = table(spark, sf, "orders")
    before = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.sha2(F.concat("o_orderstatus", F.lit("x")), 256).alias("d"))
    after = o.where("o_orderkey % 7 <> 1").select("o_orderkey", F.sha2(F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "y").otherwise("x")), 256).alias("d"))
    return versions.difference(before, after, "o_orderkey", "d")


@query("""SELECT vec_id, len(embedding) = 64 AND abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) - 1) < 0.001 AS valid FROM embeddings""")
def embedding_validity(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", vectors.is_valid(F.col("embedding"), 64).alias("valid"))


# ---------------------------------------------------------------- evaluation


_TOP = f"SELECT q.vec_id AS question_id, q.label AS wanted, e.vec_id AS item_id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 20"


def _top20(spark, sf) -> DataFrame:
    """The stated query set (every 50th vector) against all vectors."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    near = retrieval.nearest(_vectors(spark, sf), q, 21).where("item_id <> question_id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where("rank <= 20")
    near = near.join(v.select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    return near.join(v.select(F.col("vec_id").alias("question_id"), F.col("label").alias("wanted")), "question_id")


@query(f"""WITH t AS ({_TOP}) SELECT question_id, round(avg(CASE WHEN label = wanted THEN 1.0 ELSE 0 END), 6) AS precision_20, round(avg(CASE WHEN label = wanted THEN 1.0 ELSE 0 END) FILTER (WHERE rank <= 5), 6) AS precision_5 FROM t GROUP BY 1""")
def precision_at_k(spark, sf):
    t = _top20(spark, sf).withColumn("hit", F.when(F.col("label") == F.col("wanted"), 1.0).otherwise(0.0))
    return t.groupBy("question_id").agg(F.round(F.avg("hit"), 6).alias("precision_20"), F.round(F.avg(F.when(F.col("rank") <= 5, F.col("hit"))), 6).alias("precision_5"))


@query(f"""WITH t AS ({_TOP}), w AS (SELECT question_id, [question_id + 1, question_id + 2] AS a, [item] AS b FROM (SELECT question_id, min(item_id) FILTER (WHERE rank <= 3) AS item FROM t GROUP BY 1)),
g AS (SELECT question_id, list(item_id) AS got FROM t GROUP BY 1)
SELECT question_id, greatest(len(list_intersect(got, a)) / 2.0::DOUBLE, len(list_intersect(got, b)) / 1.0::DOUBLE) AS recall FROM g JOIN w USING (question_id)""")
def recall_at_k(spark, sf):
    """Candidate recall at 20 over two acceptable evidence sets, the better one counting."""
    t = _top20(spark, sf).groupBy("question_id").agg(F.collect_list("item_id").alias("got"), F.min(F.when(F.col("rank") <= 3, F.col("item_id"))).alias("near"))
    sets = F.array(F.array(F.col("question_id") + 1, F.col("question_id") + 2), F.array("near"))
    return t.select("question_id", evaluation.recall(F.col("got"), sets).alias("recall"))


@query("""SELECT doc_id, CASE WHEN len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['the', 'of'])) / 2.0 >= CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])le([^\\p{L}\\p{N}]|$)') THEN 1.0 ELSE 0.0 END
  THEN len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['the', 'of'])) / 2.0::DOUBLE ELSE 1.0::DOUBLE END AS best FROM documents""")
def best_evidence_set(spark, sf):
    """The covered share of the better of two sets of words."""
    return table(spark, sf, "documents").select("doc_id", evaluation.recall(retrieval.tokens_of(F.col("text")), F.array(F.array(F.lit("the"), F.lit("of")), F.array(F.lit("le")))).alias("best"))


_READERS = ("ada", "eve")
#: Lists of each reader by mode: lists(user_id, mode, question_id, item_id, rank).
_MODES = "WITH" + _KW.replace("{where}", "").replace("kw AS (SELECT *", "kw_all AS (SELECT *") + f""",
rd AS MATERIALIZED (SELECT a.user_id, r.doc_id AS item_id FROM ({_RULED}) r JOIN ({_ACL_SQL} SELECT * FROM acl) a ON a.policy_id = r.policy_id AND a.allowed AND a.user_id IN {{users}}),
kw AS (SELECT user_id, question_id, item_id, row_number() OVER (PARTITION BY user_id, question_id ORDER BY score DESC, item_id) AS rank FROM k JOIN rd USING (item_id) QUALIFY rank <= 10),
vec AS (SELECT user_id, b.item_id AS question_id, rd.item_id, row_number() OVER (PARTITION BY user_id, b.item_id ORDER BY {_SIM} DESC, rd.item_id) AS rank FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings e ON true JOIN rd ON rd.item_id = e.vec_id QUALIFY rank <= 10),
f AS (SELECT user_id, question_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT * FROM vec UNION ALL SELECT * FROM kw) GROUP BY ALL),
h AS (SELECT user_id, question_id, item_id, row_number() OVER (PARTITION BY user_id, question_id ORDER BY score DESC, item_id) AS rank FROM f),
s AS (SELECT h.user_id, h.question_id, h.item_id, {_OVERLAP} AS score FROM h JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), {_TOKENS})) AS qt FROM benchmark) b ON b.item_id = h.question_id
  JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), {_TOKENS})) AS dt FROM documents) d ON d.doc_id = h.item_id),
r AS (SELECT user_id, question_id, item_id, row_number() OVER (PARTITION BY user_id, question_id ORDER BY score DESC, item_id) AS rank FROM s),
lists AS MATERIALIZED (SELECT user_id, 'vector' AS mode, question_id, item_id, rank FROM vec UNION ALL SELECT user_id, 'keyword', question_id, item_id, rank FROM kw
  UNION ALL SELECT user_id, 'hybrid', question_id, item_id, rank FROM h UNION ALL SELECT user_id, 'hybrid_rerank', question_id, item_id, rank FROM r)"""


def _mode_lists(spark, sf, users: tuple[str, ...]) -> DataFrame:
    """user_id, mode, question_id, item_id, rank: what each mode returns to each of the principals."""
    asked, out = _questions(spark, sf), []
    for user in users:
        vec, kw, items = _hybrid_lists(spark, sf, user)
        vec, kw = staged(vec.select("question_id", "item_id", "rank")), staged(kw.select("question_id", "item_id", "rank"))
        fused = retrieval.rrf([vec, kw], ["question_id"], "item_id")
        full = fused.join(items.select("item_id", "text"), "item_id").join(asked, "question_id")
        again = retrieval.top_k(full.withColumn("again", retrieval.overlap_score(F.col("question"), F.col("text"))).drop("rank"), ["question_id"], "again", "item_id", 30)
        for mode, ranked in (("vector", vec), ("keyword", kw), ("hybrid", fused), ("hybrid_rerank", again)):
            out.append(ranked.select(F.lit(user).alias("user_id"), F.lit(mode).alias("mode"), "question_id", "item_id", "rank"))
    return reduce(DataFrame.unionByName, out)


@query(_MODES.replace("{users}", str(_READERS)) + r""",
w AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents), v AS (SELECT item_id, regexp_extract_all(lower(text), '\S+') AS w FROM benchmark),
ws AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM w, unnest(generate_series(1, len(w) - 7)) AS g(i)), vs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS s FROM v, unnest(generate_series(1, len(w) - 7)) AS g(i)),
cl AS MATERIALIZED (SELECT rd.user_id, vs.item_id AS question_id, ws.doc_id AS item_id, s FROM ws JOIN vs USING (s) JOIN rd ON rd.item_id = ws.doc_id),
ev AS (SELECT user_id, question_id, count(DISTINCT s) AS clauses FROM cl GROUP BY ALL),
mt AS (SELECT user_id, mode, question_id, count(DISTINCT s) FILTER (WHERE rank <= 5) AS a, count(DISTINCT s) FILTER (WHERE rank <= 20) AS b FROM lists JOIN cl USING (user_id, question_id, item_id) GROUP BY ALL),
cs AS (SELECT m.user_id, m.mode, question_id, clauses, coalesce(a, 0) / clauses AS a, coalesce(b, 0) / clauses AS b FROM (SELECT DISTINCT user_id, mode FROM lists) m JOIN ev USING (user_id) LEFT JOIN mt USING (user_id, mode, question_id))
SELECT user_id, mode, count(*) AS cases, sum(clauses)::BIGINT AS clauses, round(avg(a), 6) AS recall_5, round(avg(b), 6) AS recall_20 FROM cs GROUP BY ALL""")
def mode_comparison(spark, sf):
    """Modes on one question set, for two principals: the share of labelled clauses found, clauses being the runs of eight words that passages and readable documents share."""
    pairs = staged(quality.run_pairs(table(spark, sf, "documents"), "doc_id", table(spark, sf, "benchmark"), "item_id", 8))
    pairs = pairs.select(F.col("item_id").alias("question_id"), F.col("doc_id").alias("item_id"), F.col("run").alias("clause"))
    clauses = reduce(DataFrame.unionByName, [pairs.join(_readable(spark, sf, u).select("item_id"), "item_id", "left_semi").withColumn("user_id", F.lit(u)) for u in _READERS])
    cases = evaluation.clause_recall(_mode_lists(spark, sf, _READERS), clauses, ["user_id", "mode"])
    return cases.groupBy("user_id", "mode").agg(
        F.count("*").alias("cases"), F.sum("clauses").alias("clauses"), F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg("recall_20"), 6).alias("recall_20"))


@query("""SELECT event_type, count(value) AS runs, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def latency_percentiles(spark, sf):
    return evaluation.percentiles(table(spark, sf, "events"), ["event_type"], "value")


_PASS = "(lang IN ('en', 'fr')) AND contains(text, 'on') AND NOT contains(text, 'zq')"


@query(f"""SELECT source, count(*) AS cases, round(avg(CASE WHEN {_PASS} THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM documents GROUP BY 1""")
def case_pass_rate(spark, sf):
    ok = evaluation.case_passes(F.when(F.col("lang").isin("en", "fr"), "answered").otherwise("unavailable"), F.lit("answered"), F.array(F.lit("on")), F.array(F.lit("zq")), F.col("text"))
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("cases"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("pass_rate"))


@query("""SELECT doc_id, (CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'von') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'que') THEN 1 ELSE 0 END) / 3.0::DOUBLE AS covered,
  concat_ws(',', CASE WHEN NOT contains(text, 'the') THEN 'the' END, CASE WHEN NOT contains(text, 'von') THEN 'von' END, CASE WHEN NOT contains(text, 'que') THEN 'que' END) AS missing FROM documents""")
def fact_coverage(spark, sf):
    required = F.array(*[F.lit(x) for x in ("the", "von", "que")])
    present = F.filter(required, lambda f: F.contains(F.col("text"), f))
    return table(spark, sf, "documents").select("doc_id", (F.size(present) / 3.0).alias("covered"), F.array_join(F.array_except(required, present), ",").alias("missing"))


@query(f"""SELECT count(*) AS citations, count(*) FILTER (WHERE v.vec_id IN ({_OPEN})) AS valid, count(*) FILTER (WHERE v.vec_id NOT IN ({_OPEN})) AS undisclosed FROM embeddings v""")
def citation_validity(spark, sf):
    """Citations (every vector's document) that lie within the evidence the principal may read."""
    cited = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"))
    ok = cited.join(_readable(spark, sf).select("item_id", F.lit(True).alias("ok")), "item_id", "left")
    return ok.agg(F.count("*").alias("citations"), F.count("ok").alias("valid"), F.count_if(F.col("ok").isNull()).alias("undisclosed"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '\S+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(generate_series(1, len(w) - 7)) AS g(i)), bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS s FROM b, unnest(generate_series(1, len(w) - 7)) AS g(i))
SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY ALL""")
def benchmark_contamination(spark, sf):
    """Evaluation text must not be in the corpus: shared runs of eight words."""
    return quality.shared_runs(table(spark, sf, "documents"), "doc_id", table(spark, sf, "benchmark"), "item_id", 8)


@query("""WITH c AS (SELECT user_id AS run, event_id AS call, ts, CASE WHEN event_id % 5 > 1 THEN event_id % 5 END AS agent, CASE WHEN event_id % 5 <= 1 THEN 0 WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS depth FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, call) AS n, CASE WHEN agent IS NOT NULL AND row_number() OVER (PARTITION BY run, agent ORDER BY ts, call) = 1 THEN 1 ELSE 0 END AS new, min(ts) OVER (PARTITION BY run) AS begun FROM c),
s AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY ts, call) AS agents FROM w),
b AS (SELECT *, n > 6 AS a1, depth > 1 AS a2, agents > 2 AS a3, epoch(ts) - epoch(begun) > 120 AS a4 FROM s)
SELECT run, count(*) AS calls, arg_min(call, (ts, call)) FILTER (WHERE a1) AS over_calls, arg_min(call, (ts, call)) FILTER (WHERE a2) AS over_depth, arg_min(call, (ts, call)) FILTER (WHERE a3) AS over_subagents,
  arg_min(call, (ts, call)) FILTER (WHERE a4) AS over_seconds, coalesce(min(n) FILTER (WHERE a1 OR a2 OR a3 OR a4), count(*) + 1) - 1 AS allowed FROM b GROUP BY run""")
def tool_budget(spark, sf):
    """Events as calls of runs with subagents: the first call that breaks each of the four limits, and the calls before any does."""
    e, agent = table(spark, sf, "events"), F.col("event_id") % 5
    calls = e.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("call"), F.col("ts").alias("at"), F.when(agent > 1, agent).alias("agent"),
        F.when(agent <= 1, 0).when(F.col("event_id") % 11 == 0, 2).otherwise(1).alias("depth"))
    return requests.run_budgets(calls.withColumn("at", F.col("at").cast("timestamp")))


@query(f"""WITH m AS (SELECT d.source, count(*) AS matches, count(*) FILTER (WHERE d.doc_id IN ({_OPEN})) AS permitted, count(DISTINCT l.quality) FILTER (WHERE d.doc_id IN ({_OPEN})) - 1 AS conflicting FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
SELECT source, CASE WHEN source = 'src0' THEN 'needs_clarification' WHEN permitted = 0 THEN 'insufficient_evidence' WHEN conflicting > 0 THEN 'conflicting_sources' ELSE 'answered' END AS status FROM m""")
def response_status(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    d = d.join(_readable(spark, sf).select(F.col("item_id").alias("doc_id"), F.lit(True).alias("ok")), "doc_id", "left")
    m = d.groupBy("source").agg(F.count("*").alias("matches"), F.count("ok").alias("permitted"), (F.countDistinct(F.when(F.col("ok"), F.col("quality"))) - 1).alias("conflicting"))
    return m.select("source", evaluation.status(F.col("matches"), F.col("permitted"), F.col("conflicting"), F.col("source") != "src0").alias("status"))


@query("""SELECT CASE WHEN count(*) > 0 AND bool_and(ok) THEN 0 ELSE 1 END AS status, count(*) AS checks FROM (SELECT len(embedding) = 64 AS ok FROM embeddings)""")
def overall_status(spark, sf):
    """0 only if there are checks and all of them passed."""
    checks = table(spark, sf, "embeddings").select((F.size("embedding") == 64).alias("ok"))
    good = (F.count("*") > 0) & F.coalesce(F.bool_and("ok"), F.lit(False))
    return checks.agg(F.when(good, 0).otherwise(1).alias("status"), F.count("*").alias("checks"))


_STAGES = ["ingest", "chunk", "authorize", "rank", "fuse", "rerank", "pack"]
_FUSED_MOST, _PACKED = 10, 2500


def _trace_sql(x: str, docs: str, labels: str, vectors: str) -> str:
    """A run over one snapshot: each candidate of each question with the stages it passes; names end in ``x``."""
    return f"""
d{x} AS MATERIALIZED ({docs}), l{x} AS ({labels}), v{x} AS MATERIALIZED ({vectors}),
o{x} AS MATERIALIZED (SELECT d.doc_id, text FROM d{x} d JOIN l{x} l USING (doc_id) WHERE toxic = 0 AND regexp_matches(text, '\\S')),
t{x} AS MATERIALIZED (SELECT doc_id AS item_id, list_distinct(regexp_extract_all(lower(text), {_TOKENS})) AS dt, len(regexp_extract_all(text, '\\S+')) AS tokens FROM o{x}),
m{x} AS (SELECT question_id, item_id, sum(CASE WHEN regexp_matches(token, '\\p{{N}}') THEN 5 ELSE 1 END)::BIGINT AS shared FROM (SELECT item_id, unnest(dt) AS token FROM t{x}) JOIN qtok USING (token) GROUP BY ALL),
k{x} AS (SELECT question_id, m.item_id, row_number() OVER (PARTITION BY question_id ORDER BY shared + CASE WHEN contains(lower(o.text), lower(b.text)) THEN 10 ELSE 0 END DESC, m.item_id) AS rank
  FROM m{x} m JOIN o{x} o ON o.doc_id = m.item_id JOIN benchmark b ON b.item_id = question_id QUALIFY rank <= 10),
w{x} AS (SELECT b.item_id AS question_id, e.vec_id AS item_id, row_number() OVER (PARTITION BY b.item_id ORDER BY {_SIM} DESC, e.vec_id) AS rank
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN v{x} e ON e.vec_id IN (SELECT doc_id FROM o{x}) QUALIFY rank <= 10),
f{x} AS (SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS fused FROM (
  SELECT question_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT * FROM w{x} UNION ALL SELECT * FROM k{x}) GROUP BY ALL)),
r{x} AS (SELECT question_id, item_id, tokens, row_number() OVER (PARTITION BY question_id ORDER BY {_OVERLAP} DESC, item_id) AS after FROM f{x} JOIN t{x} USING (item_id) JOIN qset USING (question_id) WHERE fused <= {_FUSED_MOST}),
p{x} AS (SELECT question_id, item_id, sum(tokens) OVER (PARTITION BY question_id ORDER BY after) AS used FROM r{x} WHERE after <= 5)"""


_DIAGNOSE = "WITH " + f"""qset AS MATERIALIZED (SELECT item_id AS question_id, list_distinct(regexp_extract_all(lower(text), {_TOKENS})) AS qt FROM benchmark), qtok AS (SELECT question_id, unnest(qt) AS token FROM qset),""" + _trace_sql(
    "1", "SELECT doc_id, text FROM documents", "SELECT doc_id, toxic FROM labels", "SELECT vec_id, embedding FROM embeddings") + "," + _trace_sql(
    "2", "SELECT doc_id, CASE doc_id % 7 WHEN 2 THEN '  ' WHEN 4 THEN reverse(text) WHEN 6 THEN text || ' ' || repeat(text || ' ', 3) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 1",
    "SELECT doc_id, CASE doc_id % 7 WHEN 3 THEN 1 ELSE toxic END AS toxic FROM labels", "SELECT vec_id, CASE WHEN vec_id % 7 IN (4, 5) THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings") + f"""
SELECT question_id, item_id, CASE WHEN d.doc_id IS NULL THEN 'ingest' WHEN NOT regexp_matches(d.text, '\\S') THEN 'chunk' WHEN o.doc_id IS NULL THEN 'authorize' WHEN f.fused IS NULL THEN 'rank' WHEN f.fused > {_FUSED_MOST} THEN 'fuse'
  WHEN p.used IS NULL THEN 'rerank' WHEN p.used > {_PACKED} THEN 'pack' ELSE 'kept' END AS lost_at
FROM p1 LEFT JOIN d2 d ON d.doc_id = item_id LEFT JOIN o2 o ON o.doc_id = item_id LEFT JOIN f2 f USING (question_id, item_id) LEFT JOIN p2 p USING (question_id, item_id) WHERE p1.used <= {_PACKED}"""


def _trace(spark, sf, docs: DataFrame, labels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """question_id, item_id and a boolean a stage: how far each document comes for each question in one snapshot."""
    asked = _questions(spark, sf)
    rules = labels.select("doc_id", F.when(F.col("toxic") == 1, "store").otherwise("staff").alias("id"))
    full = docs.where(F.col("text").rlike(r"(?U)\S"))
    who = F.broadcast(principals(spark).where("user_id = 'ada'").select(F.struct("*").alias("u")))
    ruled = full.join(rules, "doc_id").join(F.broadcast(policies(spark)), "id").select("doc_id", "text", F.struct("id", "classification", "allowed_roles", "department_ids", "allowed_users", "denied_users").alias("p"))
    items = staged(ruled.crossJoin(who).where(access.allow("u", F.lit("core"), F.lit("museum"), "p")).select(F.col("doc_id").alias("item_id"), "text"))
    vecs = embeddings.select(F.col("vec_id").alias("item_id"), "embedding").join(items.select("item_id"), "item_id", "left_semi")
    q = table(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")).join(asked.select("question_id"), "question_id", "left_semi")
    fused = staged(retrieval.rrf([retrieval.nearest(vecs, q), retrieval.keyword_top(items, asked)], ["question_id"], "item_id").select("question_id", "item_id", "rank"))
    capped = fused.where(F.col("rank") <= _FUSED_MOST).join(items, "item_id").join(asked, "question_id").drop("rank")
    again = retrieval.top_k(capped.withColumn("again", retrieval.overlap_score(F.col("question"), F.col("text"))), ["question_id"], "again", "item_id", 5)
    used = F.sum(T.word_count(F.col("text"))).over(Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    packed = again.select("question_id", "item_id", used.alias("used"))
    # Every pair of a question and a document that has a rank; the earlier stages are a document's own.
    places = fused.join(packed, ["question_id", "item_id"], "left")
    yes = F.lit(True)
    return places.select("question_id", "item_id", yes.alias("ingest"), yes.alias("chunk"), yes.alias("authorize"), yes.alias("rank"), (F.col("rank") <= _FUSED_MOST).alias("fuse"), F.col("used").isNotNull().alias("rerank"),
                         F.coalesce(F.col("used") <= _PACKED, F.lit(False)).alias("pack")), items.select("item_id", yes.alias("_open"))


@query(_DIAGNOSE)
def diagnose(spark, sf):
    """The packed evidence of a clean snapshot, and the stage at which a damaged one loses it.

    Damaged are texts (missing, blank, reversed, four times as long), labels and vectors, a seventh of the documents each.
    """
    docs, labels, e = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"), table(spark, sf, "embeddings").select("vec_id", "embedding")
    part, turned = F.col("doc_id") % 7, F.transform("embedding", lambda x: -x)
    bad_docs = docs.where(part != 1).withColumn("text", F.when(part == 2, "  ").when(part == 4, F.reverse("text")).when(part == 6, F.concat("text", F.lit(" "), F.repeat(F.concat("text", F.lit(" ")), F.lit(3)))).otherwise(F.col("text")))
    bad_labels = labels.withColumn("toxic", F.when(part == 3, 1).otherwise(F.col("toxic")))
    clean, _ = _trace(spark, sf, docs, labels, e)
    damaged, open_ = _trace(spark, sf, bad_docs, bad_labels, e.withColumn("embedding", F.when((F.col("vec_id") % 7).isin(4, 5), turned).otherwise(F.col("embedding"))))
    evidence_ = staged(clean.where("pack"))
    own = bad_docs.select(F.col("doc_id").alias("item_id"), F.lit(True).alias("_in"), F.col("text").rlike(r"(?U)\S").alias("_full"))
    had = evidence_.select("question_id", "item_id").join(own, "item_id", "left").join(open_, "item_id", "left").join(damaged.select("question_id", "item_id", "rank", "fuse", "rerank", "pack"), ["question_id", "item_id"], "left")
    had = had.select("question_id", "item_id", F.col("_in").alias("ingest"), F.col("_full").alias("chunk"), F.col("_open").alias("authorize"), "rank", "fuse", "rerank", "pack")
    return evaluation.lost_at(evidence_, had, ["question_id", "item_id"], _STAGES)


@query("""SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def incremental_ingest_stream(spark, sf):
    """A stream over the event files, merged batch by batch into generations: each user's last event."""
    import uuid

    from vellum.streaming.ingest import latest_by_user, shared_folder

    work = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    return latest_by_user(spark, f"{sf}/event[s].parquet", table(spark, sf, "events").schema, work)


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def activity_by_day(spark, sf):
    from vellum.streaming.ingest import activity_windows

    return activity_windows(table(spark, sf, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


# ---------------------------------------------------------------- answers, sessions


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\S+')) BETWEEN 500 AND 800 AS accepted FROM documents""")
def word_count_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.within_words(F.col("text")).alias("accepted"))


_QTY = r"list_distinct(list_transform(regexp_extract_all(lower({x}), '\p{N}+(?:[.,]\p{N}+)*(?:\s*(?:%|kg|g|km|cm|mm|m|hours|hour|h|days|day|eur|usd)(?:[^\p{L}\p{N}]|$))?'), lambda q: regexp_replace(q, '[^\p{L}\p{N}%.,]|[.,]$', '', 'g')))"
_NOT = r"regexp_matches({x}, '(?i)(^|[^\p{L}])(not|no|never|none|without|neither|nor|cannot|\p{L}+n''t)([^\p{L}]|$)')"


@query(f"""WITH cl AS (SELECT b.item_id AS answer_id, k::BIGINT AS claim, b.text || CASE WHEN k % 2 = 0 THEN ' It is never more than ' ELSE ' It is ' END || k || ' kg.' AS text FROM benchmark b, generate_series(0, 5) AS g(k)),
ci AS (SELECT answer_id, claim, answer_id * 3 + claim % 4 AS chunk_id FROM cl WHERE claim < 5 UNION ALL SELECT answer_id, claim, answer_id * 3 + claim FROM cl WHERE claim BETWEEN 1 AND 3),
ev AS (SELECT b.item_id AS answer_id, d.doc_id AS chunk_id, d.text || CASE WHEN d.doc_id % 3 = 0 THEN ' No more than ' ELSE ' Always ' END || d.doc_id % 4 || ' kg' AS text FROM benchmark b JOIN documents d ON d.doc_id BETWEEN b.item_id * 3 AND b.item_id * 3 + 3 WHERE d.doc_id IN ({_OPEN})),
x AS (SELECT cl.answer_id, cl.claim, cl.text, ci.chunk_id, ev.chunk_id AS ours, ev.text AS got FROM cl LEFT JOIN (SELECT DISTINCT * FROM ci) ci USING (answer_id, claim) LEFT JOIN ev ON ev.answer_id = cl.answer_id AND ev.chunk_id = ci.chunk_id),
q AS (SELECT answer_id, claim, q, bool_or(coalesce(list_contains(has, q), false)) AS found FROM (SELECT *, unnest({_QTY.replace("{x}", "text")}) AS q, {_QTY.replace("{x}", "got")} AS has FROM x) GROUP BY ALL),
u AS (SELECT answer_id, claim, count(*) AS unfounded FROM q WHERE NOT found GROUP BY ALL),
p AS (SELECT answer_id, claim, count(chunk_id) AS citations, count(*) FILTER (WHERE chunk_id IS NOT NULL AND ours IS NULL) AS invented, coalesce(bool_or(ours IS NOT NULL AND {_NOT.replace("{x}", "got")} = {_NOT.replace("{x}", "text")}), false) AS agrees FROM x GROUP BY ALL)
SELECT answer_id, claim, citations, invented, coalesce(unfounded, 0) AS unfounded, citations > 0 AND invented = 0 AND coalesce(unfounded, 0) = 0 AND agrees AS supported FROM p LEFT JOIN u USING (answer_id, claim)""")
def claim_support(spark, sf):
    """Claims with citations against the readable evidence of their answer: invented citations, numbers, units, negation."""
    k = F.col("claim")
    claims = table(spark, sf, "benchmark").select(F.col("item_id").alias("answer_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("claim"), "text")
    claims = claims.withColumn("text", F.concat("text", F.when(k % 2 == 0, " It is never more than ").otherwise(" It is "), k, F.lit(" kg.")))
    cited = claims.where("claim < 5").select("answer_id", "claim", (F.col("answer_id") * 3 + k % 4).alias("chunk_id")).union(claims.where("claim between 1 and 3").select("answer_id", "claim", F.col("answer_id") * 3 + k))
    places = table(spark, sf, "benchmark").select(F.col("item_id").alias("answer_id"), F.explode(F.sequence(F.col("item_id") * 3, F.col("item_id") * 3 + 3)).alias("item_id"))
    said = F.concat("text", F.when(F.col("chunk_id") % 3 == 0, " No more than ").otherwise(" Always "), F.col("chunk_id") % 4, F.lit(" kg"))
    evidence = places.join(_readable(spark, sf), "item_id").withColumnRenamed("item_id", "chunk_id").select("answer_id", "chunk_id", said.alias("text"))
    return answers.supported(claims, cited, evidence)


@query("""WITH rules(o_orderpriority, free, rate, rule) AS (VALUES ('1-URGENT', 1000.0::DOUBLE, 0.05::DOUBLE, 'r1'), ('2-HIGH', 5000.0, 0.02, 'r2'), ('3-MEDIUM', 20000.0, NULL, 'r3'), ('4-NOT SPECIFIED', 50000.0, 0.01, NULL))
SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL AND free IS NOT NULL AND rate IS NOT NULL AND rule IS NOT NULL THEN 'calculated' ELSE 'abstained' END AS status,
  CASE WHEN rule IS NOT NULL THEN round(greatest(o_totalprice - free, 0.0) * rate, 6) END AS result, free, rate, rule AS citation FROM orders LEFT JOIN rules USING (o_orderpriority)""")
def calculator(spark, sf):
    """Charges by cited rules; where a rate or a rule is missing the calculator abstains."""
    rules = _literal([("1-URGENT", 1000.0, 0.05, "r1"), ("2-HIGH", 5000.0, 0.02, "r2"), ("3-MEDIUM", 20000.0, None, "r3"), ("4-NOT SPECIFIED", 50000.0, 0.01, None)],
                     ["o_orderpriority", "free", "rate", "rule"], ["string", "double", "double", "string"], spark)
    o = table(spark, sf, "orders").join(F.broadcast(rules), "o_orderpriority", "left")
    c = checks.charge(F.col("o_totalprice"), F.col("free"), F.col("rate"), F.col("rule")).alias("c")
    return o.select("o_orderkey", c).select("o_orderkey", "c.status", "c.result", "c.inputs.free", "c.inputs.rate", "c.citation")


_CHECKED = ("ben", "cleo", "eve", "ivo")


@query(_MODES.replace("{users}", str(_CHECKED)) + f""", md(mode) AS (VALUES ('vector'), ('keyword'), ('hybrid'), ('hybrid_rerank')), us AS (SELECT unnest({list(_CHECKED)}) AS user_id),
dec AS (SELECT a.user_id, r.doc_id AS item_id, a.allowed FROM ({_RULED}) r JOIN ({_ACL_SQL} SELECT * FROM acl) a ON a.policy_id = r.policy_id)
SELECT user_id, mode, count(lists.item_id) AS returned, count(lists.item_id) FILTER (WHERE NOT coalesce(allowed, false)) AS disclosed, coalesce(sum(lists.item_id * rank), 0)::BIGINT AS mark,
  (SELECT count(*) FROM dec x WHERE x.user_id = us.user_id AND x.allowed) AS permitted, count(lists.item_id) FILTER (WHERE NOT coalesce(allowed, false)) = 0 AND (count(lists.item_id) > 0) = ((SELECT count(*) FROM dec x WHERE x.user_id = us.user_id AND x.allowed) > 0) AS passed
FROM us CROSS JOIN md LEFT JOIN lists USING (user_id, mode) LEFT JOIN dec USING (user_id, item_id) GROUP BY user_id, mode""")
def security_counters(spark, sf):
    """What each mode really returned to each principal, against decisions made by other means: rules in plain SQL over the tables."""
    decided = spark.sql(
        """SELECT u.user_id, p.id AS rule, u.active AND array_contains(u.allowed_corpus_ids, 'core') AND NOT coalesce(array_contains(p.denied_users, u.user_id), false) AND CASE
             WHEN p.classification IN ('public', 'internal') THEN true
             WHEN p.classification = 'restricted' THEN coalesce(array_contains(p.allowed_users, u.user_id), false)
               OR (exists(u.roles, r -> coalesce(array_contains(p.allowed_roles, r), false)) AND (coalesce(size(p.department_ids), 0) <= 0 OR coalesce(array_contains(p.department_ids, u.department_id), false)))
             ELSE false END AS allowed FROM {people} u CROSS JOIN {rules} p""", people=principals(spark), rules=policies(spark))  # fmt: skip
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, "store").when(F.col("toxic") == 0, "staff").alias("rule"))
    ruled = marks.join(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi").join(F.broadcast(decided), "rule")
    ruled = ruled.where(F.col("user_id").isin(*_CHECKED)).select("user_id", "item_id", "allowed")
    return answers.security_counters(staged(_mode_lists(spark, sf, _CHECKED)), ruled, list(_CHECKED), ["vector", "keyword", "hybrid", "hybrid_rerank"])


@query("""WITH s AS (SELECT event_id, user_id, ts, ts + INTERVAL 12 HOUR AS expires_at, (SELECT min(e.ts) FROM events e WHERE e.user_id = v.user_id AND e.event_type = 'error' AND e.ts > v.ts) AS revoked_at FROM events v WHERE event_type = 'view')
SELECT event_id AS session_id, user_id, expires_at FROM s WHERE ts <= TIMESTAMP '2024-01-03 12:00:00' AND expires_at > TIMESTAMP '2024-01-03 12:00:00' AND NOT coalesce(revoked_at <= TIMESTAMP '2024-01-03 12:00:00', false)""")
def live_sessions(spark, sf):
    """A view begins a session of twelve hours; the user's next error revokes it."""
    e = table(spark, sf, "events")
    later = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    s = e.withColumn("revoked_at", F.min(F.when(F.col("event_type") == "error", F.col("ts"))).over(later)).where("event_type = 'view'")
    s = s.select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("expires_at"), "revoked_at")
    return answers.live_sessions(s, F.lit("2024-01-03 12:00:00").cast(e.schema["ts"].dataType)).select("session_id", "user_id", "expires_at")
