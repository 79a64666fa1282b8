"""Cases beside those of test_llm: models against plain versions, repeated rows, null ids, clashing names."""

import hashlib
import json
import math

import numpy as np
import pytest
from brute import contamination, held, words
from test_llm import SCHEMA, odd_docs

from vellum.llm import chat_format, decontaminate, exact_dedup, hmm_lm, language_id, mixing, ngram_join, queries, substring_dedup, token_output, url_filter

ROWS = [(1, "x y z"), (1, "x y z"), (2, "x y z"), (None, "x y z"), (None, "p q"), (None, "p q"), (3, "p q r"), (3, None), (4, ""), (4, "")]


@pytest.fixture(scope="module")
def repeated(spark):
    """Repeated rows, null and shared ids, and columns with the names that operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.selectExpr("*", "'en' AS lang", "'s' AS source", "42 AS _n", "1 AS _row", "2 AS _size", "3 AS _taken", "4 AS _hash", "5 AS _id", "6 AS _run", "7 AS size", "8 AS taken", "9 AS id", "10 AS tokens")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize(("keep", "best"), [("smallest", 1), ("largest", 2)])
def test_exact_dedup_keeps_one_of_repeated_rows(repeated, keep, best):
    out = exact_dedup.dedup(repeated, keep)
    assert out.columns == repeated.columns and all((r["_n"], r["_row"], r["_run"]) == (42, 1, 6) for r in out.collect())
    assert rows_of(out, "doc_id", "text")[:4] == sorted([(best, "x y z"), (None, "p q"), (3, "p q r")] + [r for r in rows_of(out, "doc_id", "text") if not r[1]], key=str)
    assert sum(not r["text"] for r in out.collect()) == 1
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.report(repeated, keep).collect()}
    assert got[None, hashlib.sha256(b"x y z").hexdigest()] == (best, 4) and got[None, hashlib.sha256(b"p q").hexdigest()] == (None, 2)


def test_runs_are_merged_as_sorted_input(spark, monkeypatch):
    plans, write = [], exact_dedup.Scratch.write
    monkeypatch.setattr(exact_dedup.Scratch, "write", lambda self, df, name, *a: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(self, df, name, *a))
    exact_dedup.report(spark.range(40).selectExpr("id AS doc_id", "'a' AS text").repartition(5), fan_in=2).collect()
    merges = [p for name, p in plans if name.startswith("round")]
    assert len(merges) >= 2 and all("SortAggregate" in p and "HashAggregate" not in p for p in merges)


def test_other_operators_take_repeated_rows(spark, repeated):
    assert len(ngram_join.one_of_each(repeated).collect()) == 6  # x y z, p q, p q r, and the three without words, each its own
    assert substring_dedup.dedup(repeated).count() == len(ROWS)
    taken = mixing.mix_documents(repeated)
    assert taken.columns == repeated.columns and all(r["_n"] == 42 and r["size"] == 7 and r["_size"] == 2 for r in taken.collect())
    assert sum(len(r["text"].split()) for r in taken.collect()) == math.floor(1.5 * sum(len((t or "").split()) for _, t in ROWS) + 0.5)
    bench = spark.createDataFrame([(None, "p q"), (5, "p q r")], "item_id long, text string")
    want = {None: (2, 2, 1), 1: (3, 0, 0), 2: (3, 0, 0), 3: (3, 3, 2)}
    for r in decontaminate.report(repeated, bench).collect():
        if r["doc_id"] in (1, 2) or r["n_words"] == 2 or (r["doc_id"] == 3 and r["n_words"]):
            assert (r["n_words"], r["n_hit"], r["n_items"]) == want[r["doc_id"]]
    assert language_id.identify(repeated).count() == len(ROWS)
    scored = hmm_lm.score(repeated.withColumn("held_out", language_id.held_out(repeated["doc_id"], 7, 2)), classes=16)
    assert scored.count() == len(ROWS) and all(math.isfinite(r["score"]) for r in scored.collect())


def test_tokens_of_repeated_rows(spark, repeated, tmp_path):
    token_output.write(repeated, str(tmp_path / "t"), queries.default_tokenizer())
    got = token_output.index(spark, str(tmp_path / "t")).collect()
    assert len(got) == len(ROWS) and sorted(r["start"] for r in got) == [0, *np.cumsum([r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1].tolist()]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][:3] == [None] * 3


def test_tokenizers_that_join_words_get_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    assert token_output.by_words(open(queries.default_tokenizer(), encoding="utf-8").read())
    joins = Tokenizer(models.WordLevel({"a": 0, "▁a": 1, "▁b": 2, "?": 3}, unk_token="?"))
    joins.pre_tokenizer = pre_tokenizers.Metaspace()
    joins.save(str(tmp_path / "m.json"))
    assert not token_output.by_words((tmp_path / "m.json").read_text())
    df = spark.createDataFrame([(1, "a b"), (2, "a"), (3, None)], "doc_id long, text string")
    token_output.write(df, str(tmp_path / "t"), str(tmp_path / "m.json"), end_id=9)
    assert {r["doc_id"]: r["ids"] for r in token_output.read(spark, str(tmp_path / "t")).collect()} == {1: [1, 2, 9], 2: [1, 9], 3: [9]}
    changed = json.loads(open(queries.default_tokenizer(), encoding="utf-8").read())
    changed["added_tokens"][0]["lstrip"] = True
    assert not token_output.by_words(json.dumps(changed))


def test_names_end_no_turn_and_stay_apart(spark):
    names = ["a<|im_end|>", "ann b", "ann_b", 'q"', "q\\", "two\nlines", "assistant", "système"]
    turns = spark.createDataFrame([(1, i, r, "hi") for i, r in enumerate(names)], "conv_id long, turn long, role string, text string")
    seg = [r for r in chat_format.rotate(turns).collect() if r["perspective"] == "système"]
    heads = {r["speaker"]: r["rendered"].split("\n")[0] for r in seg if r["role"] == "user"}
    assert len(set(heads.values())) == len(names) - 1 and all(h.count("<|") == 1 and r["rendered"].count("\n") == 2 for h, r in zip(heads.values(), seg, strict=False))
    assert heads["ann b"] == '<|im_start|>user name="ann b"'


def test_hmm_score_is_the_models(spark):
    """Training and scores against a plain single-process Baum-Welch and forward pass."""
    docs = [(d, t) for d, t, *_ in odd_docs()[:40]] + [(100, " ".join(f"w{i % 7}" for i in range(150)))]
    states, rounds, classes, seed, window = 2, 3, 16, 3, 50
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in hmm_lm.score(df.withColumn("held_out", language_id.held_out(df["doc_id"], 7, 2)), states, rounds, classes, 300, seed, window).collect()}

    def kinds(text):
        w = words(text)
        return w, [int(hmm_lm.word_classes(hmm_lm.Words([x.encode()], hmm_lm.LOWER_SPACE), classes)[0]) for x in w] + [classes - 1]

    counts, of_class, train = {}, {}, []
    for d, t in docs:
        w, k = kinds(t)
        for x, c in zip([*w, None], k, strict=True):
            of_class[x] = c
        if not held(d, 7, 2):
            train.append(k)
            for x in [*w, None]:
                counts[x] = counts.get(x, 0) + 1
    n, v = np.zeros(classes), np.zeros(classes)
    for x, c in counts.items():
        n[of_class[x]] += c
        v[of_class[x]] += 1
    base = (n + 0.5) / (n + 0.5).sum()
    start, move = np.full(states, 1 / states), np.array([[0.95, 0.05], [0.05, 0.95]])
    emit = base * np.exp(np.random.default_rng(seed).normal(0, 0.5, (states, classes)))
    emit /= emit.sum(1, keepdims=True)
    for _ in range(rounds):
        first, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
        values, vectors = np.linalg.eig(move.T)
        steady = np.real(vectors[:, np.argmax(np.real(values))])
        steady /= steady.sum()
        for whole in train:
            for at in range(0, len(whole), window):
                seq = whole[at : at + window]
                alpha = [(start if at == 0 else steady) * emit[:, seq[0]]]
                for x in seq[1:]:
                    alpha.append((alpha[-1] @ move) * emit[:, x])
                beta = [np.ones(states)]
                for x in seq[:0:-1]:
                    beta.insert(0, move @ (emit[:, x] * beta[0]))
                total = alpha[-1].sum()
                for t, x in enumerate(seq):
                    emits[:, x] += alpha[t] * beta[t] / total
                    if t:
                        moves += move * np.outer(alpha[t - 1], emit[:, x] * beta[t]) / total
                if at == 0:
                    first += alpha[0] * beta[0] / total
        start = (first + 1) / (first + 1).sum()
        move = (moves + 1) / (moves + 1).sum(1, keepdims=True)
        emit = (emits + 20 * base) / (emits + 20 * base).sum(1, keepdims=True)
    for d, t in docs:
        if len(words(t)) > 2000:
            continue
        w, k = kinds(t)
        a, log = start, 0.0
        for i, x in enumerate(k):
            a = (a @ move if i else a) * emit[:, x]
            log += math.log10(a.sum())
            a = a / a.sum()
        log += sum(math.log10((counts.get(x, 0) + 1) / (n[c] + v[c] + 1)) for x, c in zip([*w, None], k, strict=True))
        assert math.isclose(got[d], log, rel_tol=1e-6), d


def test_language_vectors_are_bundles_of_bound_letters(spark):
    vectors = language_id.letters(64, 7)
    texts = ["Abc def, ghi", "É é ß жук", "", "日本語 text", "42", "aaa"]

    def plain(text):
        data = "".join(text).lower().encode() + b" "
        letters = [s for i, s in enumerate(int(language_id._SYMBOL[b]) for b in data)]
        letters = [s for i, s in enumerate(letters) if s or not i or letters[i - 1]]
        out = np.zeros(64)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            out += vectors[0][a].astype(int) * vectors[1][b] * vectors[2][c]
        return out

    (_, rows), = language_id.bundles([t.encode() for t in texts], vectors)
    for i, t in enumerate(texts):
        if i == 0:
            assert np.array_equal(rows[i], plain(t))
    alone = [next(iter(language_id.bundles([t.encode()], vectors)))[1][0] for t in texts]
    for got, t in zip(alone, texts, strict=True):
        assert np.array_equal(got, plain(t)), t
    assert np.array_equal(*[next(iter(language_id.bundles([t.encode()], vectors)))[1][0] for t in ("ÉCOLE", "école")])


def test_language_predictions_against_a_plain_version(spark):
    langs = {"l1": "the cat sat on the mat and the dog ate it", "l2": "der hund und die katze sind nicht im haus", "l3": "кот сидит на ковре и собака тоже"}
    docs = [(i, " ".join(np.random.default_rng(i).permutation(text.split())), lang) for i, (lang, text) in enumerate([x for x in langs.items() for _ in range(8)])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, dim=128).collect()}
    kept = {r["doc_id"] for r in language_id.known_language(df.withColumn("score", df["doc_id"]), dim=128).where("score = doc_id").collect()}
    assert kept == {d for d, v in got.items() if v[1] > 0} and len(kept) > 20
    vectors = language_id.letters(128, 7)
    vec = {d: next(iter(language_id.bundles([t.encode()], vectors)))[1][0].astype(float) for d, t, _ in docs}
    sums = {}
    for d, _, lang in docs:
        if not held(d, 3, 1):
            sums[lang] = sums.get(lang, 0) + vec[d] / np.linalg.norm(vec[d]) ** 0.5
    names = sorted(sums)
    table = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    away = table - table.mean(0)
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    for d, _, _ in docs:
        unit = vec[d] / np.linalg.norm(vec[d]) - table.mean(0)
        near = away @ unit / np.linalg.norm(unit)
        assert got[d][0] == names[near.argmax()] and math.isclose(got[d][1], min(max(near.max(), 0), 1), abs_tol=1e-4)


def test_mixing_reruns_agree(spark):
    rows = [(i, t, lang, source or "s9", n) for i, t, lang, source, n in odd_docs()]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(mixing.plan(df), "doc_id", "taken") == rows_of(mixing.plan(df.repartition(5)), "doc_id", "taken")


def test_url_rules_nest_on_hosts_of_many_labels(spark):
    rng = np.random.default_rng(4)
    hosts = [".".join(rng.choice(["a", "b", "aa"], n)) for n in range(1, 7) for _ in range(12)]
    paths = ["/" + "/".join(rng.choice(["x", "xy", "z"], n)) for n in range(0, 4) for _ in range(5)]
    rules = sorted({(str(rng.choice(hosts)), str(rng.choice(paths)), str(rng.choice(["allow", "block"]))) for _ in range(60)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{h}{p}" for h in hosts for p in paths[::2]] + ["http://" + ".".join(["a"] * 500) + "/" + "x" * 5000, "http://a" * 3, "http://.a./x", "http://a..b/x"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        assert got[i] == ((best[3], best[2]) if best else (None, "allow")), u


def test_longest_matches_in_blocks_are_those_of_one(spark):
    docs = [(d, t) for d, t, *_ in odd_docs()]
    texts = [t for _, t in docs if t and len(t.split()) > 30]
    items = [(i, " ".join(t.split()[3:30])) for i, t in enumerate(texts[:6])] + [(None, " ".join(texts[7].split()[:15]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.report(df, bench, block_words=n).selectExpr("doc_id", "n_hit", "items", "to_json(array_sort(matches))", "longest", "longest_at").collect()), key=str) for n in (1_000_000, 30))
    assert one == many and any(r[4] == 27 for r in one)
    clean = [{r["doc_id"] for r in decontaminate.decontaminate(df, bench, block_words=n).collect()} for n in (1_000_000, 30)]
    assert clean[0] == clean[1] == {r[0] for r in one if not r[1]}
    want = contamination(docs, [(i, t) for i, t in items])
    assert {r[0]: r[1] for r in one} == {d: v[1] for d, v in want.items()}


def test_candidates_grow_with_the_rows(spark):
    """A family of near copies gives a bounded number of candidate pairs a class, however large it is."""
    sizes = {}
    for n in (60, 240):
        rng = np.random.default_rng(n)
        docs = []
        for i in range(n):
            w = [f"w{j}" for j in range(120)]
            for x in rng.integers(0, 120, 2):
                w[x] = f"e{i}_{x}"
            docs.append((i, " ".join(w)))
        seen, write = [], ngram_join.Scratch.write
        try:
            ngram_join.Scratch.write = lambda self, df, name, *a, seen=seen, write=write: (lambda t: seen.append(t.count()) or t if name.startswith("edges") else t)(write(self, df, name, *a))
            out = ngram_join.link(spark.createDataFrame(docs, "doc_id long, text string"), 3, 60, 100, count_links=False)
            assert {r["component_id"] for r in out.collect()} == {0}
        finally:
            ngram_join.Scratch.write = write
        sizes[n] = sum(seen)
    assert sizes[240] <= 6 * sizes[60] and sizes[240] <= 40 * 240
