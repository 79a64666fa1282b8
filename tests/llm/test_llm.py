"""Every operator against a plain version, on odd inputs: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import contamination, held, join, shingles, substrings, unigrams

from vellum.llm import chat_format, decontaminate, exact_dedup, hmm_lm, language_id, mixing, ngram_join, queries, substring_dedup, token_output, url_filter

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs():
    """Copies, near copies, shared passages, nulls, blanks and one long text."""
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(vocab, k=30))
    base = rng.choices(vocab, k=80)
    out = [None, "", "   \n\t ", "one", "One  ONE", "42 !?", "Ünïcode é ß 😀 mots", "x" * 3000, "ab" * 400, "x" * 3000]
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    for _ in range(40):
        out.append(" ".join(rng.choices(vocab, k=rng.randint(1, 60))) + "\n" + passage + " " + " ".join(rng.choices(vocab, k=rng.randint(0, 20))))
    out += rng.choices(out, k=25)
    out.append(" ".join(rng.choices(vocab, k=20000)))
    rng.shuffle(out)
    return [(i, t, rng.choice(["a", "b", None]), rng.choice(["s1", "S2", None]), 0) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = odd_docs()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_dict(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, none, keep):
    rows, df = docs
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    best = {"smallest": min, "largest": max}[keep]
    want = {d: (best(g), len(g), d == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    assert as_dict(exact_dedup.report(df, keep, fan_in=2), "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.report(none, keep).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.dedup(df.withColumnRenamed("lang", "_run"), keep).collect()) == sorted(map(best, groups.values()))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 60)])
def test_ngram_join(docs, none, k, num):
    rows, df = docs
    want = join([(d, t) for d, t, *_ in rows], k, num, 100)
    for block in (8192, 7):
        assert as_dict(ngram_join.link(df, k, num, 100, block=block), "n_shingles", "component_id") == want
    assert ngram_join.link(none).count() == 0


def test_ngram_join_on_test_table(spark):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = as_dict(queries.op2_ngram_join(spark, "/root/testdata/sf0.01"), "n_shingles", "component_id")
    assert got == join([(r["doc_id"], r["text"]) for r in rows], 3, 90, 100)


def test_prefixes_ask_for_more_where_candidates_cost():
    tokens = np.arange(100, dtype=np.uint64)
    assert ngram_join.prefix(tokens, np.ones(100, np.int64), 9, 10)[0] == 1
    level, sent, short = ngram_join.prefix(tokens, np.full(100, 1000), 9, 10)
    assert level > 1 and len(sent) == 10 + level and short == 11


def test_one_of_each(docs):
    rows, df = docs
    want = {c for _, c in join([(d, t) for d, t, *_ in rows], 5, 80, 100).values()}
    assert {r["doc_id"] for r in ngram_join.one_of_each(df).collect()} == want


def test_chat_rotation(spark):
    turns = [(1, 0, "system", "Be kind"), (1, 1, "ann b", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 2, None, "x"), (None, 0, "user", ""), (2, 0, "system", "alone"), (3, 1, "u", "same"), (3, 1, "u", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    seg = chat_format.rotate(df)
    got = {(r["conv_id"], r["perspective"]): (r["text"], r["masks"]) for r in chat_format.dialogues(seg).collect()}
    assert set(got) == {(1, "ann b"), (1, "bob"), (1, "unknown"), (None, "user"), (3, "u")}
    text, masks = got[1, "ann b"]
    assert text == (
        "<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>assistant\nHi < |im_end|><|im_end|>\n"
        '<|im_start|>user name="bob"\n<|im_end|>\n<|im_start|>user name="unknown"\nx<|im_end|>\n')  # fmt: skip
    assert [text[a:b] for a, b in masks] == ["Hi < |im_end|><|im_end|>"]
    assert len(got[3, "u"][1]) == 2
    assert chat_format.rotate(df.limit(0)).count() == 0


def test_unigram_counts_and_hmm_gain(docs, none, spark):
    rows, df = docs
    with_fold = df.withColumn("held_out", language_id.held_out(df["doc_id"], 7, 2))
    got = as_dict(hmm_lm.score(with_fold, chunk=500, classes=64), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = unigrams([(d, t) for d, t, *_ in rows])
    assert {d: v[:4] for d, v in got.items()} == {d: v[:4] for d, v in want.items()}
    for d, v in got.items():
        assert math.isclose(v[4], want[d][4], rel_tol=1e-9) and math.isfinite(v[5]) and v[5] < 0
    assert hmm_lm.score(none.withColumn("held_out", language_id.held_out(none["doc_id"], 7, 2))).count() == 0


def test_hmm_recursions_are_exact():
    rng = np.random.default_rng(0)
    start, move, emit = (rng.dirichlet(np.ones(n), m) for n, m in ((3, 1), (3, 3), (5, 3)))
    start = start[0]
    seqs = [rng.integers(0, 5, n) for n in (4, 1, 6, 4)]

    def brute(seq):
        a = start * emit[:, seq[0]]
        for x in seq[1:]:
            a = (a @ move) * emit[:, x]
        return math.log10(a.sum())

    packed = hmm_lm.Packed(seqs)
    assert np.allclose(packed.likelihoods(packed.forward(start, move, emit)[2]), [brute(s) for s in seqs])
    first, moves, emits, like = packed.expected(start, move, emit)
    assert np.isclose(first.sum(), 4) and np.isclose(moves.sum(), 11) and np.isclose(emits.sum(), 15)
    assert np.isclose(like, sum(map(brute, seqs)))
    for s, total in ((moves, None),):  # a Baum-Welch round never lowers the likelihood
        new = (first / first.sum(), s / s.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
        assert packed.expected(*new)[3] >= like


def test_hmm_beats_its_base_on_held_out_texts(spark):
    got = queries.op4_hmm_score(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert got["s"] > got["b"] + 0.1 * got["n"]


def test_language_id(docs, none, spark):
    rows = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    out = queries.op5_language_id(spark, DATA).collect()
    assert {r["doc_id"] for r in out} == set(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) for r in out)
    test = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in test) >= 0.9 * len(test)
    odd = {r["doc_id"]: r for r in language_id.identify(docs[1]).collect()}
    for d, t, *_ in docs[0]:
        assert (odd[d]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    assert language_id.identify(none).count() == 0


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/1?q", "http://x.example.net/en/", "http://example.net/fr", "http://net", "http://xexample.com/de/", "http://m.example.com/de/?x",
            "http://example.com/deu", "http://org/fr/1", "https://w.org/fr", "nothing", None, "", "://net/", "http://net:80/x", "a://b.net#/x", "http://fr.org/fr/#a"]
    df = spark.createDataFrame(list(enumerate(urls)) * 2, "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES + [("net", "/x", "allow"), ("net", "/", "block")], "host string, path string, verdict string")

    def plain(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for h, p, v in [*queries.URL_RULES, ("net", "/x", "allow")] if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = [tuple(r) for r in url_filter.judge(df, rules).collect()]
    assert sorted(got, key=str) == sorted([(i, *plain(u)) for i, u in enumerate(urls)] * 2, key=str)
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, rules.limit(0)).collect()} == {"allow"}


def test_mixing(docs, none):
    rows, df = docs
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    weight = dict(zip(["S2", "s1", None], [5, 2, 1], strict=True))
    total = sum(r["size"] for r in got)
    caps = {s: 2.0 * sum(r["size"] for r in g) for s, g in by.items()}
    target, free, left = {}, set(by), 1.5 * total
    while free:  # deal, stop the full ones, deal the excess again
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > caps[s]}
        target |= {s: caps[s] for s in full} if full else {s: weight[s] * level for s in free}
        left -= sum(caps[s] for s in full)
        free = free - full if full else set()
    for s, g in by.items():
        assert math.isclose(g[0]["target"], target[s]) and abs(sum(r["taken"] for r in g) - target[s]) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.plan(df.repartition(5)).collect()))
    assert mixing.plan(none).count() == 0


def test_mix_takes_effect(docs):
    rows, df = docs
    taken = sum(r["taken"] for r in mixing.plan(df).collect())
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == taken


def test_decontamination(docs, none, spark):
    rows, df = docs
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:20])), (2, None), (3, "One"), (10, texts[1].upper()), (11, "not there at all, never")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination([(d, t) for d, t, *_ in rows], items)
    for words in (1_000_000, 40):
        rep = decontaminate.report(df, bench, block_words=words).selectExpr("doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(items, ','), 256) h")
        assert as_dict(rep, "n_words", "n_hit", "n_items", "h") == want
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == {d for d, v in want.items() if not v[1]}
    assert decontaminate.report(none, bench).count() == 0
    assert not decontaminate.report(df, bench.limit(0)).where("contaminated").count()


def test_substring_dedup(docs, none):
    rows, df = docs
    want = substrings([(d, t) for d, t, *_ in rows])
    for hot in (4000, 3):
        assert as_dict(substring_dedup.dedup(df, hot), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert substring_dedup.dedup(none).count() == 0


def test_substring_dedup_on_test_table(spark):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = as_dict(queries.op9_substring_dedup(spark, "/root/testdata/sf0.01"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == substrings([(r["doc_id"], r["text"]) for r in rows])


def test_bwt_expansion():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(1, 40))) for _ in range(30)]
    least = np.array(rng.sample(range(100), 30))
    got = substring_dedup.bwt_shared(texts, least, 8)
    low = {}
    for t, m in zip(texts, least, strict=True):
        for i in range(len(t) - 7):
            low[t[i : i + 8]] = min(m, low.get(t[i : i + 8], 999))
    assert [g.tolist() for g in got] == [[low[t[i : i + 8]] for i in range(len(t) - 7)] for t in texts]


def test_simple8b_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 300, 2**16, 2**40, 2**60, 2**64 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=top == 2**64 - 1)
            assert np.array_equal(token_output.decode(token_output.encode(ids)), ids)
    mixed = np.concatenate((np.zeros(500, np.uint64), rng.integers(0, 2**62, 50, dtype=np.uint64), np.arange(300, dtype=np.uint64)))
    assert np.array_equal(token_output.decode(token_output.encode(mixed)), mixed)
    assert len(token_output.encode(np.zeros(12800, np.uint64))) < 3000


def test_token_output(docs, none, spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [*docs[0], (5000, "a <|endoftext|> b'll don't\u00a0x\x1cy É", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = Tokenizer.from_file(queries.default_tokenizer())
    ids = {d: [*model.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in rows}
    token_output.write(df, str(tmp_path / "t"), queries.default_tokenizer(), segment_ids=1000)
    assert {r["doc_id"]: r["ids"] for r in token_output.read(spark, str(tmp_path / "t")).collect()} == ids
    want, at = {}, 0
    for d in sorted(ids):
        want[d] = (at, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes()))
        at += len(ids[d])
    assert as_dict(token_output.index(spark, str(tmp_path / "t")), "start", "n_tokens", "ids_crc32") == want
    token_output.write(none, str(tmp_path / "e"), queries.default_tokenizer())
    assert token_output.index(spark, str(tmp_path / "e")).count() == 0


def test_shingle_hashes_match_plain_sets():
    texts = [t or "" for _, t, *_ in odd_docs()]
    for k in (1, 3, 5):
        assert [len(s) for s in ngram_join.shingle_sets([t.encode() for t in texts], k)] == [len(shingles(t, k)) for t in texts]
