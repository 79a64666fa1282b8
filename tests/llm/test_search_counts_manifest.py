"""Lexical search, token counts and the Merkle manifest against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from test_llm import odd_docs

from vellum.llm import lexical, merkle, token_count
from vellum.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(lexical.UPPER, lexical.LOWER)


def odd_rows():
    """The odd documents, with ids and languages missing and rows repeated."""
    rows = odd_docs()
    return rows + rows[:9] + [(None, "one two one", None, None, None), (None, "one two one", None, "x", 3), (None, None, "a", "", -1), (7, "One", "zz", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], SCHEMA + ", rank int, level string").repartition(3)
    return rows, df


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def best(rows, question, k):
    counted = [(r[0], Counter(terms(r[1]))) for r in rows]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    scored = []
    asked = Counter(terms(question))
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t in asked if (df := sum(t in c for _, c in counted))}
    for d, c in counted:
        m = 75 + 25 * sum(c.values()) * n // total
        score = sum(r * w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in asked.items() if t in c)
        if score > 0:
            scored.append((-score, d is None, d or 0))
    return [(i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k], 1)]


@pytest.mark.parametrize("postings, window", [(1 << 20, 4096), (40, 4096), (1 << 20, 8)])
def test_lexical_search(spark, docs, monkeypatch, postings, window):
    rows, df = docs
    monkeypatch.setattr(lexical, "MOST_POSTINGS", postings)
    monkeypatch.setattr(lexical, "WINDOW", window)
    asked = [(1, rows[40][1]), (2, "one ONE two"), (2, "one"), (None, rows[60][1]), (4, None), (5, "..."), (6, "nowhere"), (7, "Ünïcode 😀 mots")]
    got = {}
    for r in lexical.ranked(df, spark.createDataFrame([(i, t, 1, 2) for i, t in asked], "item_id long, text string, rank int, score int"), 20).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    wanted = {}
    for i, text in asked:
        if one := best(rows, text, 20):
            wanted.setdefault(i, []).extend(one)
    key = lambda x: (x[0], x[2], x[1] is None, x[1] or 0)
    assert {i: sorted(x, key=key) for i, x in got.items()} == {i: sorted(x, key=key) for i, x in wanted.items()}


def test_lexical_blocks_of_questions(spark, docs):
    _, df = docs
    scratch = Scratch(spark)
    windows = scratch.write(lexical.index(df), "windows")
    asked = scratch.write(lexical.questions(spark.createDataFrame([(i, f"one word{i} mots abc") for i in range(30)], "item_id long, text string")), "asked")
    one, many = (sorted(tuple(r)[1:] for r in lexical.search(windows, asked, 5, most).collect()) for most in (1 << 20, 500))
    assert one == many and one


def test_lexical_empty(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.ranked(none, some).count() == 0
    assert lexical.ranked(spark.createDataFrame([(1, "one", "a", "b", 1)], SCHEMA), some.where("item_id > 1")).count() == 0


def test_long_documents_need_wide_products():
    import numpy as np

    assert lexical.lengths_term(np.array([10**9, 3]), 10**11, 10**13).tolist() == [75 + 25 * n * 10**11 // 10**13 for n in (10**9, 3)]


MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a  ", "\n\n", "a\nb c", "x▁y", "▁", " ▁ ", "<s>a</s> <unk><0x0A>", "a\0b", "tab\tand\rreturn\r\n", "1234 56,7", "日本語 テキスト",
       "é ﬁ Ａ　b ​", "😀😀 a", "ab" * 5000, " " * 300, "word " * 2000, "}\r {\r"]


@pytest.mark.parametrize("most", [token_count.MOST_BYTES, 300, 0])
def test_token_counts(spark, docs, most):
    rows, df = docs
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [(r[0], r[1]) for r in rows] + [(i, t) for i, t in enumerate(ODD)]
    df = df.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")).selectExpr("*", "1 as n", "'x' as piece")
    got = Counter(tuple(r) for r in token_count.counts(df, MODEL, most=most).collect())
    assert got == Counter((d, len((t or "").encode()), n := len(p.encode(t or "")), n > 4096) for d, t in texts)


def test_token_counts_of_an_empty_table(spark):
    assert token_count.counts(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_a_model_that_joins_across_spaces_is_not_cut(spark, monkeypatch):
    monkeypatch.setattr(token_count.Cutter, "_separable", lambda self: False)
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in token_count.counts(df, MODEL).collect()) == sorted(len(p.encode(t or "")) for t in ODD)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def climb(digests, at, acc):
    """The node that remains, the siblings of ``at``, and what ``acc`` in its place gives."""
    siblings = []
    while len(digests) > 1:
        run = digests[at // 8 * 8 : at // 8 * 8 + 8]
        siblings += run[: at % 8] + run[at % 8 + 1 :]
        acc = h(*run[: at % 8], acc, *run[at % 8 + 1 :])
        digests = [h(*digests[i : i + 8]) for i in range(0, len(digests), 8)]
        at //= 8
    return digests[0], siblings, acc


def manifest(rows):
    langs = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))):
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {x: [leaf(r, r[1]) for r in langs[x]] for x in order}
    roots = [climb(leaves[x], 0, "")[0] for x in order]
    out = []
    for s, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            tampered = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            sub, beside, acc = climb(leaves[x], i, leaf(r, r[1].translate(LOWER)) if tampered else leaves[x][i])
            root, above, acc = climb(roots, s, acc)
            out.append((r[0], leaves[x][i], sub, root, h(*beside, *above), acc, acc == root))
    return out


@pytest.mark.parametrize("most", [merkle.MOST_BYTES, 0])
def test_merkle_manifest(docs, monkeypatch, most):
    rows, df = docs
    monkeypatch.setattr(merkle, "MOST_BYTES", most)
    assert Counter(tuple(r) for r in merkle.report(df).collect()) == Counter(manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_merkle_sizes(spark, n):
    rows = [(i, f"Text {i}", "a", "s", i) for i in range(n)]
    got = sorted(tuple(r) for r in merkle.report(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(manifest(rows))


def test_merkle_many_groups(spark):
    rows = [(i, f"Text {i}", None if i % 40 == 0 else f"l{i % 40}", "s", i) for i in range(300)] + [(999, "é", "ü", None, None), (1000, "B", "", None, None)]
    assert Counter(tuple(r) for r in merkle.report(spark.createDataFrame(rows, SCHEMA)).collect()) == Counter(manifest(rows))
