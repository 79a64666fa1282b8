"""Content-derived identifiers."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import WORD_TOKENIZER

# The default limits, the strategy's name, and the layout of what a fingerprint is the hash of.
TARGET, MOST, OVERLAP, PAIR, SPECIAL = 300, 400, 50, 512, 3
STRATEGY = "section-aware-parent-child"
FINGERPRINT = '{"max_tokens":%d,"overlap_tokens":%d,"strategy":"%s","target_tokens":%d,"tokenizer":"%s"}'


class Limits(NamedTuple):
    """Tokens a chunk aims at, may have and repeats; tokens of a scorer's pair, and of these the scorer's own marks."""

    target: int = TARGET
    most: int = MOST
    overlap: int = OVERLAP
    pair: int = PAIR
    special: int = SPECIAL


def fingerprint(limits: Limits, tokenizer: str = WORD_TOKENIZER) -> str:
    """What chunk boundaries depend on, hashed.  Limits that no chunk could keep are an error here, before any plan is made."""
    wrong = [name for name, holds in (
        ("target below 1", limits.target >= 1), ("target above most", limits.target <= limits.most), ("overlap below 0", limits.overlap >= 0)) if not holds]
    if wrong:
        raise ValueError("chunk limits: " + ", ".join(wrong))
    return hashlib.sha256((FINGERPRINT % (limits.most, limits.overlap, STRATEGY, limits.target, tokenizer)).encode()).hexdigest()


def document_version_id(corpus_id: Column, sha256: Column) -> Column:
    return F.concat_ws(":", corpus_id, F.substring(sha256, 1, 12))


def chunk_id(version: Column, spans: Column, part: Column, config_hash: str) -> Column:
    """SHA-256 of ``version|s:e,s:e|part|config``; ``spans`` is an array of (start, end)."""
    named = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return F.sha2(F.concat_ws("|", version, named, part, F.lit(config_hash)), 256)
