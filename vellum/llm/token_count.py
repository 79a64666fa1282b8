"""Token counts of texts from their pre-tokens, without ids.

A pre-token is a stretch of text that the tokenizer never joins with its neighbours.  Pieces are counted
once for each distinct pre-token of the corpus; a document's count is the sum over its pre-tokens of
frequency times pieces.

Where a text may be cut follows from the model's pieces (``Cutter``): before a run of spaces, if no piece
has a space behind another character, and around each ASCII character that is in no piece of several
characters (line ends, digits and the like).  A model whose normalizer changes texts, or that isn't byte
pair encoding, is not cut: a text is then one pre-token.

Three passes: (1) distinct pre-tokens with their frequencies, combined in each task before the shuffle;
(2) the pieces of each, in parallel; (3) texts again, as frequencies a document.  The most frequent
pre-tokens, as many as take ``MOST_BYTES``, are looked up where texts are read; (document, pre-token,
frequency) rows of the others are joined with the table of all.  None of these is frequent, so no key of
that join is hot.

Defined cases: a null text is empty, with no bytes and no tokens; rows are told apart by numbers of their
own, so null or repeated ids, repeated rows and other columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, pieces, utf8

#: Bytes of pre-tokens that every task holds.
MOST_BYTES = 24 << 20
SPACE = "▁"
_STEP = 1 << 22


class Cutter:
    """Cuts texts into pre-tokens of a model, and counts their pieces."""

    def __init__(self, model: str):
        self.model, self._held = model, None
        p = self._load()
        self.whole = not self._separable()
        joined = set()
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i)) and len(piece) > 1:
                joined.update(piece)
                self.whole |= SPACE in piece.lstrip(SPACE)
        lone = [c for c in range(128) if chr(c) not in joined and c != 32]
        self.whole |= not lone
        self.lone = np.zeros(256, bool)
        self.lone[lone] = True
        #: In front of a pre-token, this character keeps the model from taking it for a text's start.
        self.guard = chr(lone[0] if 10 not in lone else 10) if lone else ""

    def __getstate__(self):
        return self.__dict__ | {"_held": None}

    def _load(self):
        import sentencepiece

        if self._held is None:
            self._held = sentencepiece.SentencePieceProcessor(model_file=self.model)
        return self._held

    def _separable(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(self.model, "rb") as f:
            m.ParseFromString(f.read())
        n, t, kinds = m.normalizer_spec, m.trainer_spec, {x.type for x in m.pieces}
        plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap and not t.treat_whitespace_as_suffix
        return plain and t.model_type == 2 and kinds <= {1, 2, 3, 6}  # byte pairs; normal, unknown, control and byte pieces

    def cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All pre-tokens in turn, and the text each is of.  Spaces stand for the model's space mark."""
        if self.whole:
            held = [i for i, t in enumerate(texts) if t]
            return pa.array([texts[i] for i in held], pa.large_binary()), np.array(held, np.int64)
        marked = [b" " + t.replace(SPACE.encode(), b" ") if t else t for t in texts]  # a text begins with a mark
        data = np.frombuffer(b"".join(marked), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        space, lone = data == 32, self.lone[data]
        start = np.zeros(len(data) + 1, bool)
        start[:-1] = lone | space
        start[1:-1] &= ~(space[1:] & space[:-1])
        start[1:] |= lone
        start[np.concatenate(([0], ends))] = True
        at = np.flatnonzero(start)
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]), np.searchsorted(ends, at[:-1], side="right")

    def count(self, tokens: list[bytes]) -> list[int]:
        """How many pieces each pre-token is."""
        p = self._load()
        if self.whole:
            return [len(x) for x in p.encode([t.decode() for t in tokens], num_threads=1)]
        extra = len(p.encode(self.guard))
        return [len(x) - extra for x in p.encode([self.guard + t.decode() for t in tokens], num_threads=1)]


def _frequencies(cutter: Cutter, texts: list[bytes]):
    """For texts in turn: distinct pre-tokens, and (text, pre-token, frequency) as three arrays."""
    for i, j in pieces(texts, _STEP):
        tokens, of = cutter.cut(texts[i:j])
        if len(tokens):
            coded = tokens.dictionary_encode()
            code, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            pair, many = np.unique(of * n + code, return_counts=True)
            yield coded.dictionary, i + pair // n, pair % n, many


def distinct_pretokens(texts: DataFrame, cutter: Cutter) -> DataFrame:
    """piece (binary), n: the distinct pre-tokens of column ``text`` and how often each occurs."""

    def run(batches):
        for batch in batches:
            for known, _, code, many in _frequencies(cutter, utf8(batch.column("text"))):
                n = np.bincount(code, many, len(known)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([known.cast(pa.binary()), pa.array(n)], names=["piece", "n"])

    return texts.select("text").mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def with_tokens(found: DataFrame, cutter: Cutter) -> DataFrame:
    """Adds ``tokens``, the pieces of each pre-token."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cutter.count(batch.column("piece").to_pylist()), pa.int64())], names=[*batch.schema.names, "tokens"])

    return found.mapInArrow(run, "piece binary, n long, tokens long")


def frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows with the most frequent pre-tokens that take at most ``most`` bytes, by powers of two of the frequency."""
    level = F.floor(F.log2("n")).alias("level")
    sizes = {r["level"]: r["size"] for r in table.groupBy(level).agg(F.sum(F.octet_length("piece") + 24).alias("size")).collect()}  # a row a power of two
    held, least = 0, 64
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > most:
            break
        least = at
    return table.where(F.col("n") >= F.lit(1 << min(least, 62)))


def counts(docs: DataFrame, model: str, limit: int = 4096, most: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), a row for each of ``docs``."""
    spark, cutter = docs.sparkSession, Cutter(model)
    scratch = Scratch(spark)
    table = scratch.write(with_tokens(distinct_pretokens(docs, cutter), cutter), "pretokens")
    held = frequent(table, most).select("piece", "tokens").toArrow()
    known = spark.sparkContext.broadcast((held.column("piece").combine_chunks().cast(pa.large_binary()), held.column("tokens").to_numpy()))

    def run(batches):
        frequent_, tokens = known.value
        for batch in batches:
            total, rest = np.zeros(batch.num_rows, np.int64), []
            for words, doc, code, many in _frequencies(cutter, utf8(batch.column("text"))):
                place = pc.index_in(words, value_set=frequent_).fill_null(-1).to_numpy()[code]
                own = place >= 0
                np.add.at(total, doc[own], many[own] * tokens[place[own]])
                rest.append((doc[~own], words.take(pa.array(code[~own])), many[~own]))
            size = np.zeros(batch.num_rows + 1, np.int64)
            for doc, _, _ in rest:
                np.add.at(size, doc + 1, 1)
            one = pa.StructArray.from_arrays([
                pa.concat_arrays([w for _, w, _ in rest]).cast(pa.binary()) if rest else pa.array([], pa.binary()),
                pa.array(np.concatenate([m for *_, m in rest]) if rest else np.empty(0, np.int64))], names=["piece", "n"])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).cast(pa.int64()) for c in ("_row", "doc_id", "n_bytes")), pa.array(total),
                pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), one)], names=["_row", "doc_id", "n_bytes", "known", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    rows = scratch.write(rows.mapInArrow(run, "_row long, doc_id long, n_bytes long, known long, rest array<struct<piece:binary,n:long>>"), "rows")
    rest = rows.select("_row", F.explode("rest").alias("r")).select("_row", F.col("r.piece").alias("piece"), F.col("r.n").alias("_n"))
    more = rest.join(table.select("piece", "tokens"), "piece").groupBy("_row").agg(F.sum(F.col("_n") * F.col("tokens")).alias("n"))
    none = F.lit(None).cast("long")
    both = rows.select("_row", "doc_id", "n_bytes", F.col("known").alias("n")).unionByName(more.select("_row", none.alias("doc_id"), none.alias("n_bytes"), "n"))
    out = both.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
