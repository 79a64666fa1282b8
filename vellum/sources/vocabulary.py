"""Subword vocabularies in GGUF files, and token counts with them.

The file is read on the driver (metadata only, a few megabytes) and broadcast; counting runs in Arrow
batches.  Distinct words can't be counted apart, as merges cross spaces here.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format: struct codes of scalar types by type number; 8 is a string, 9 an array.
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, float]
    bytes_: frozenset[str]


def read_metadata(data: bytes) -> dict:
    """The key-value section of a GGUF file."""
    at = 0

    def take(code: str):
        nonlocal at
        value = struct.unpack_from("<" + code, data, at)[0]
        at += struct.calcsize("<" + code)
        return value

    def value(kind: int):
        nonlocal at
        if kind in SCALARS:
            return take(SCALARS[kind])
        if kind == 8:
            n = take("Q")
            at += n
            return data[at - n : at].decode("utf-8")
        if kind == 9:
            inner, n = take("I"), take("Q")
            return [value(inner) for _ in range(n)]
        raise ValueError(f"unknown value type {kind}")

    if data[:4] != b"GGUF":
        raise ValueError("not a GGUF file")
    at = 8
    take("Q")
    return {value(8): value(take("I")) for _ in range(take("Q"))}


def vocabulary(metadata: dict) -> Vocabulary:
    """Normal, user-defined and byte tokens with their scores; all 256 bytes must be there."""
    kinds = metadata["tokenizer.ggml.token_type"]
    rows = list(zip(metadata["tokenizer.ggml.tokens"], metadata["tokenizer.ggml.scores"], kinds, strict=True))
    used = {t: float(s) for t, s, k in rows if k in (NORMAL, USER_DEFINED, BYTE)}
    single = frozenset(t for t, _, k in rows if k == BYTE)
    if len(single) != 256:
        raise ValueError("the vocabulary lacks byte tokens")
    return Vocabulary(used, single)


def encode(text: str, vocab: Vocabulary) -> list[str]:
    """Merges the adjacent pair of the highest score, leftmost first, until none is in the vocabulary."""
    if not text.strip():
        return []
    parts: list[str] = []
    for c in text.replace(" ", "▁"):
        parts += [c] if c in vocab.scores else [f"<0x{b:02X}>" for b in c.encode("utf-8")]
    # A heap of pairs, best score and leftmost first; a pair whose ends have since merged is passed over.
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < len(parts) and (both := parts[i] + parts[j]) in vocab.scores:
            heapq.heappush(heap, (-vocab.scores[both], i, j, both))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if not parts[i] or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, "", after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p]


def subword_count(spark: SparkSession, vocab: Vocabulary):
    """A function from a text column to its number of subword tokens."""
    held = spark.sparkContext.broadcast(vocab)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        sizes = {t: len(encode(t, held.value)) for t in texts.dropna().unique()}
        return texts.map(sizes).fillna(0).astype("int32")

    def of(text: Column) -> Column:
        return count(text)

    return of
