"""Language ID with hyperdimensional profiles.

A letter has a random +1/-1 vector; an n-gram vector binds (multiplies) its letters' vectors, each
permuted by its place; a text's vector bundles (adds) those of its n-grams; a language's prototype
bundles its training texts.  A text is given the language whose centred prototype has the largest
cosine with its own vector.

Letters are the bytes of the lower-cased text in UTF-8: a-z, and each byte of the characters beyond
ASCII; all else is a gap.  Vectors depend on a seed only, so tasks make the same
ones; what goes to the driver is one vector a language (``max_langs`` at most).  Every training text
counts, whole.  Each text adds its n-grams' shares, times the root of their number.

Defined cases: a null text or one without a letter is ``und`` with score 0; training ignores rows
without lang and ``und`` texts; ties go to the language first in order; without any training text all
are ``und``; repeated rows count as often; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import pieces, utf8

N = 3
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128)
SYMBOLS, BITS = 155, 8
#: Distinct n-grams whose vectors are made at a time, which bounds memory whatever the scripts.
GRAMS = 1 << 14


def letters(dim: int, seed: int) -> list[np.ndarray]:
    """For each place in an n-gram: all symbols' vectors, permuted for that place."""
    rng = np.random.default_rng(seed)
    base = rng.choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
    return [np.roll(base, N - 1 - i, axis=1) for i in range(N)]


def has_letter(text: bytes) -> bool:
    data = np.frombuffer(text, np.uint8)
    ascii_letter = (data | 32) - np.uint8(97) < 26
    return bool(ascii_letter.any()) or (bool((data > 127).any()) and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def bundles(texts: list[bytes], vectors: list[np.ndarray]):
    """The texts' vectors (float32 rows), some at a time, as (first index, rows)."""
    dim = vectors[0].shape[1]
    seen, column = np.zeros(1 << (BITS * N), bool), np.zeros(1 << (BITS * N), np.int32)
    texts = [t if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]
    for i, j in pieces(texts, 1 << 19):
        for a in range(i, j, 256):
            some = texts[a : min(a + 256, j)]
            data = _SYMBOL[np.frombuffer(b" ".join(some) + b" ", np.uint8)]
            size = np.fromiter((len(t) + 1 for t in some), np.int64, len(some))
            keep = np.ones(len(data), bool)
            keep[1:] = (data[1:] != 0) | (data[:-1] != 0)  # one gap is enough
            doc = np.repeat(np.arange(len(some)), size)[keep]
            data = data[keep]
            if len(data) < N:
                yield a, np.zeros((len(some), dim), np.float32)
                continue
            gram = (data[:-2] << (2 * BITS)) | (data[1:-1] << BITS) | data[2:]
            same = doc[:-2] == doc[2:]
            gram, doc = gram[same], doc[:-2][same]
            seen[gram] = True
            used = np.flatnonzero(seen)
            seen[used], column[used] = False, np.arange(len(used))
            at, rows, mask = column[gram], np.zeros((len(some), dim), np.float32), (1 << BITS) - 1
            for x in range(0, len(used), GRAMS):
                few = used[x : x + GRAMS]
                own = (at >= x) & (at < x + len(few))
                count = np.bincount(doc[own] * len(few) + at[own] - x, minlength=len(some) * len(few)).reshape(len(some), -1)
                bound = vectors[0][few >> (2 * BITS)] * vectors[1][(few >> BITS) & mask] * vectors[2][few & mask]
                rows += count.astype(np.float32) @ bound.astype(np.float32)
            yield a, rows


def train(docs: DataFrame, dim: int = 512, seed: int = 7, max_langs: int = 1000) -> dict[str, np.ndarray]:
    """Prototypes by language, from the rows of ``docs`` with text and lang."""

    def run(batches):
        vectors, sums = letters(dim, seed), {}
        for batch in batches:
            texts, langs = utf8(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
            for a, rows in bundles(texts, vectors):
                size = np.maximum(np.linalg.norm(rows, axis=1), 1e-9) ** 0.5
                rows = rows / size[:, None]
                own = langs[a : a + len(rows)]
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + rows[own == lang].sum(0, dtype=np.float64)
        for lang, v in sums.items():
            n = len(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(v)], names=["lang", "at", "v"])

    known = docs.where("text is not null and lang is not null").select("text", "lang")
    sums = known.mapInArrow(run, "lang string, at int, v double").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    profile = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("v"))
    rows = profile.limit(max_langs + 1).collect()
    if len(rows) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    return {r["lang"]: np.array(r["v"]) for r in sorted(rows, key=lambda r: r["lang"])}


class Judge:
    """Prototypes made ready to compare texts with."""

    def __init__(self, prototypes: dict[str, np.ndarray], dim: int, seed: int):
        self.names, self.dim, self.seed = list(prototypes), dim, seed
        table = np.array([v / max(np.linalg.norm(v), 1e-9) for v in prototypes.values()]).reshape(len(self.names), dim)
        centre = table.mean(0) if len(self.names) > 1 else np.zeros(dim)
        away = table - centre
        self.centre, self.away = centre.astype(np.float32), (away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def __call__(self, texts: list[bytes], vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's language and score."""
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if self.names:
            for a, rows in bundles(texts, vectors):
                unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9) - self.centre
                unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
                near = unit @ self.away.T
                best = near.argmax(1)
                score[a : a + len(rows)] = np.clip(near[np.arange(len(rows)), best], 0, 1)
                lang[a : a + len(rows)] = np.array(self.names, object)[best]
            none = [i for i, t in enumerate(texts) if not has_letter(t)]
            lang[none], score[none] = "und", 0.0
        return lang, score


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keys: list[str], dim: int = 512, seed: int = 7) -> DataFrame:
    """The columns ``keys``, lang_pred and score (the cosine, from 0 to 1) for every row."""
    judge = Judge(prototypes, dim, seed)
    schema = docs.select(*keys).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        vectors = letters(dim, seed)
        for batch in batches:
            lang, score = judge(utf8(batch.column("text")), vectors)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(lang, pa.string()), pa.array(score)], names=[*keys, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*keys, "text"])).mapInArrow(run, schema)


def known_language(docs: DataFrame, least: float = 0.0, dim: int = 512, seed: int = 7) -> DataFrame:
    """The documents in a learned language, with all their columns: those with a score above ``least``.

    ``und`` scores 0, as does a text on whose side no learned language is.  Scores of short texts are low, so a
    higher ``least`` would cost clean ones.
    """
    judge = Judge(train(docs.where(~held_out(F.col("doc_id"))), dim, seed), dim, seed)

    def run(batches):
        vectors = letters(dim, seed)
        for batch in batches:
            lang, score = judge(utf8(batch.column("text")), vectors)
            yield batch.filter(pa.array((lang != "und") & (score > least)))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, modulus: int = 3, remainder: int = 1) -> Column:
    """The fold: crc32 of the id as text, modulo ``modulus``, is ``remainder``.  A null id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, keys: list[str] | None = None, dim: int = 512, seed: int = 7) -> DataFrame:
    """Learns from the rows that aren't held out; predicts all: ``keys``, held_out, lang_pred, score."""
    out = held_out(F.col("doc_id"))
    model = train(docs.where(~out), dim, seed)
    return predict(docs.withColumn("held_out", out), model, [*(keys or ["doc_id"]), "held_out"], dim, seed)
