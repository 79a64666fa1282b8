"""LM scoring with a hidden Markov language model.

A state emits a word class, a class emits a word: P(text) sums over state paths the product of
P(state | state before), P(class | state) and P(word | class).  A word's class is a hash of its last
letters, so unknown words have one too, and the states' tables have a fixed size whatever the
vocabulary; P(word | class) = (c + 1) / (N_class + V_class + 1) comes from counts of every training
word, a table that grows with the corpus and is never broadcast.

Training is Baum-Welch: every task runs scaled forward and backward recursions over its training
texts and adds up expected counts; the counts of all partitions are summed by slices of the tables
and only the tables' fixed size reaches the driver.  Training sequences longer than ``window`` tokens
are read as consecutive windows; all tokens count.  Only a text's first window counts for the start; the
others begin in the states' long-run shares.  Scoring is one exact scaled forward recursion over
the whole text.

Chunks: each task turns its texts into chunks of about ``chunk`` tokens (word ids within the chunk's
sorted vocabulary).  Counts are made by value ranges of 64-bit word hashes, and each range returns to
every chunk the counts of the words it has.  So no word is ever joined token by token, and a frequent
word is one entry a chunk.

Defined cases: a null text is empty: only the end token; a null doc_id is in training; words of
held-out texts only have c = 0; without training texts all counts are 0; repeated rows count each;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import LOWER_SPACE, MULT, Scratch, Words, mix, pack_ints, pack_sorted, pieces, shuffle_width, unpack_ints, unpack_sorted, utf8

SLOTS = 32


def word_classes(words: Words, classes: int) -> np.ndarray:
    """From the last three letters; shorter words are told apart from ends of longer ones."""
    code = np.zeros(len(words.hash), np.uint64)
    for back in range(1, 4):
        at = words.end - back
        code = (code << np.uint64(8)) | np.where(at >= words.start, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix(code * MULT[3] + np.uint64(1)) % np.uint64(classes - 1)).astype(np.uint16)


def chunks(docs: DataFrame, classes: int, chunk: int) -> DataFrame:
    """One row a chunk: its documents, token ids, vocabulary (hashes), classes, and counts in training texts."""
    schema = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary, words binary, classes binary, counts binary"

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        keys, held, sizes, hashes, kinds, total = [], [], [], [], [], 0

        def row():
            unique, first, ids = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            train = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(ids[train], minlength=len(unique))
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + number]), pa.array([keys], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([pack_ints(ids)], pa.binary()), pa.array([pack_sorted(unique)], pa.binary()),
                pa.array([np.concatenate(kinds)[first].tobytes()], pa.binary()), pa.array([pack_ints(counts)], pa.binary())],
                names=["chunk", "doc_ids", "held", "sizes", "ids", "words", "classes", "counts"])

        for batch in batches:
            texts, ids, out = utf8(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for i, j in pieces(texts):
                words = Words(texts[i:j], LOWER_SPACE)
                keys += ids[i:j]
                held += out[i:j]
                sizes += np.diff(words.first).tolist()
                hashes.append(words.hash)
                kinds.append(word_classes(words, classes))
                total += len(words.hash)
                if total >= chunk:
                    yield row()
                    number += 1
                    keys, held, sizes, hashes, kinds, total = [], [], [], [], [], 0
        if keys:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, schema)


def word_counts(table: DataFrame, classes: int) -> DataFrame:
    """For each chunk and value range: the words' counts in all training texts; and each range's sums by class (chunk -1)."""
    parts = shuffle_width(table.sparkSession)
    cuts = np.array([((p << 64) // parts) for p in range(1, parts)], np.uint64)

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, kinds, counts = unpack_sorted(row["words"]), np.frombuffer(row["classes"], np.uint16), unpack_ints(row["counts"])
                edge = [0, *np.searchsorted(words, cuts).tolist(), len(words)]
                some = [p for p in range(parts) if edge[p + 1] > edge[p]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()),
                    *(pa.array([f(a[edge[p] : edge[p + 1]]) for p in some], pa.binary()) for f, a in ((pack_sorted, words), (np.ndarray.tobytes, kinds), (pack_ints, counts)))],
                    names=["part", "chunk", "words", "classes", "counts"])

    def merge(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        words = [unpack_sorted(r["words"]) for r in rows]
        every, first, at = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack_ints(r["counts"]) for r in rows]), len(every)).astype(np.int64)
        kinds = np.concatenate([np.frombuffer(r["classes"], np.uint16) for r in rows])[first]
        sums = np.concatenate((np.bincount(kinds, total, classes), np.bincount(kinds[total > 0], minlength=classes)))
        edge = np.cumsum([0, *map(len, words)])
        got = [pack_ints(total[at[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        part = rows[0]["part"]
        yield pa.RecordBatch.from_arrays([
            pa.array([*(r["chunk"] for r in rows), -1], pa.int64()), pa.array([part] * (len(rows) + 1), pa.int32()),
            pa.array([*got, sums.astype(np.int64).tobytes()], pa.binary())], names=["chunk", "part", "counts"])

    dealt = table.select("chunk", "words", "classes", "counts").mapInArrow(deal, "part int, chunk long, words binary, classes binary, counts binary")
    return dealt.repartitionById(parts, "part").mapInArrow(merge, "chunk long, part int, counts binary")


def long_run(move: np.ndarray) -> np.ndarray:
    """The shares of the states that ``move`` leaves as they are."""
    n = len(move)
    return np.linalg.lstsq(np.vstack((move.T - np.eye(n), np.ones(n))), np.append(np.zeros(n), 1.0), rcond=None)[0]


class Packed:
    """Sequences of classes side by side, longest first, time step by time step, for recursions in lockstep."""

    def __init__(self, seqs: list[np.ndarray], begins: list[bool] | None = None):
        """``begins``: whether a sequence begins a text; all do if it isn't given."""
        self.order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        size = np.array([len(seqs[i]) for i in self.order], np.int64)
        self.size = size
        self.begins = np.array([begins is None or begins[i] for i in self.order])
        steps = int(size[0])
        self.alive = np.searchsorted(-size, -np.arange(steps), "left")  # sequences longer than t
        self.at = np.concatenate(([0], np.cumsum(self.alive)))
        row = np.repeat(np.arange(len(size)), size)
        time = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        place = self.at[time] + row
        self.obs = np.empty(len(row), np.int64)
        self.obs[place] = np.concatenate([seqs[i] for i in self.order])
        self.last = self.at[size - 1] + np.arange(len(size))
        self.time, self.row = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        self.time[place], self.row[place] = time, row

    def forward(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emission rows, scaled state probabilities, and the scales, whose logarithms add up to the likelihood."""
        b = emit[:, self.obs].T.copy()
        state, scale = np.empty_like(b), np.empty(len(b))
        if not self.begins.all():
            start = np.where(self.begins[:, None], start, long_run(move))
        for t, n in enumerate(self.alive.tolist()):
            a = self.at[t]
            now = (start if t == 0 else state[self.at[t - 1] : self.at[t - 1] + n] @ move) * b[a : a + n]
            s = now.sum(1)
            scale[a : a + n] = s
            np.divide(now, s[:, None], out=state[a : a + n])
        return b, state, scale

    def likelihoods(self, scale: np.ndarray) -> np.ndarray:
        """log10 of each sequence's probability, in the order given."""
        out = np.empty(len(self.size))
        out[self.order] = np.bincount(self.row, np.log10(scale), len(self.size))
        return out

    def expected(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts of first states, moves and emissions, and the log10 likelihood."""
        b, state, scale = self.forward(start, move, emit)
        back = np.ones_like(state)
        b /= scale[:, None]
        for t in range(len(self.alive) - 2, -1, -1):
            n, a, z = self.alive[t + 1], self.at[t], self.at[t + 1]
            back[a : a + n] = (b[z : z + n] * back[z : z + n]) @ move.T
        b *= back
        later = self.time > 0
        before = self.at[self.time[later] - 1] + self.row[later]
        moves = move * (state[before].T @ b[later])
        state *= back
        emits = np.array([np.bincount(self.obs, state[:, k], emit.shape[1]) for k in range(len(start))])
        return state[: len(self.size)][self.begins].sum(0), moves, emits, float(np.log10(scale).sum())


def sequences(row: dict, classes: int, ids: np.ndarray) -> list[np.ndarray]:
    """The documents' word classes, each with the end's class."""
    kinds = np.frombuffer(row["classes"], np.uint16)[ids]
    ends = np.cumsum(row["sizes"])
    return [np.append(x, np.uint16(classes - 1)) for x in np.split(kinds, ends[:-1])]


def train(table: DataFrame, by_class: np.ndarray, states: int, rounds: int, seed: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, move, emit after ``rounds`` of Baum-Welch over the training texts of all chunks."""
    classes, spark = len(by_class), table.sparkSession
    rng = np.random.default_rng(seed)
    base = (by_class + 0.5) / (by_class + 0.5).sum()
    start = np.full(states, 1 / states)
    move = np.full((states, states), 0.05 / max(states - 1, 1)) + np.eye(states) * (0.95 - 0.05 / max(states - 1, 1))
    emit = base * np.exp(rng.normal(0, 0.5, (states, classes)))
    emit /= emit.sum(1, keepdims=True)
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((start, move, emit))

        def run(batches, model=model):
            start, move, emit = model.value
            total = None
            for batch in batches:
                for row in batch.to_pylist():
                    seqs = [s for s, out in zip(sequences(row, classes, unpack_ints(row["ids"]).astype(np.int64)), row["held"], strict=True) if not out]
                    begins = [i == 0 for s in seqs for i in range(0, len(s), window)]
                    seqs = [s[i : i + window] for s in seqs for i in range(0, len(s), window)]
                    if seqs:
                        a, b, c, like = Packed(seqs, begins).expected(start, move, emit)
                        got = np.concatenate((a, b.ravel(), c.ravel(), [like]))
                        total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(SLOTS), pa.int32()), pa.array([x.tobytes() for x in np.array_split(total, SLOTS)], pa.binary())], names=["slot", "sums"])

        def add(batches):
            slot, total = None, 0
            for batch in batches:
                for s, x in zip(batch.column("slot").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    slot, total = s, total + np.frombuffer(x)
            if slot is not None:
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

        used = table.select("held", "sizes", "ids", "classes")
        sums = used.mapInArrow(run, "slot int, sums binary").repartitionById(SLOTS, "slot").mapInArrow(add, "slot int, sums binary")
        rows = sorted(sums.collect(), key=lambda r: r["slot"])  # the size of the tables, whatever the corpus
        if not rows:
            break
        total = np.concatenate([np.frombuffer(r["sums"]) for r in rows])
        a, b, c = np.split(total[:-1], [states, states + states * states])
        start = (a + 1) / (a + 1).sum()
        move = b.reshape(states, states) + 1
        move /= move.sum(1, keepdims=True)
        emit = c.reshape(states, classes) + 20 * base
        emit /= emit.sum(1, keepdims=True)
    return start, move, emit


def score(docs: DataFrame, states: int = 6, rounds: int = 5, classes: int = 4096, chunk: int = 1_000_000, seed: int = 3, window: int = 512) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for all ``docs`` (doc_id, text, held_out)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    table = scratch.write(chunks(docs, classes, chunk), "chunks", group_mb=16)
    counted = scratch.write(word_counts(table, classes), "counted", group_mb=16)
    n_class, v_class = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in counted.where("chunk = -1").select("counts").toLocalIterator():  # a row a range, of fixed size
        sums = np.frombuffer(r["counts"], np.int64)
        n_class, v_class = n_class + sums[:classes], v_class + sums[classes:]
    ends = table.select(F.expr("aggregate(held, 0L, (a, x) -> a + if(x, 0L, 1L))").alias("n")).agg(F.sum("n")).first()[0] or 0
    n_class[classes - 1], v_class[classes - 1] = ends, int(ends > 0)
    n_all, v_all = int(n_class.sum()), int(v_class.sum())
    model = spark.sparkContext.broadcast((*train(table, n_class, states, rounds, seed, window), np.log10(n_class + v_class + 1)))
    back = counted.where("chunk >= 0").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "counts"))).alias("all"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        start, move, emit, log_class = model.value
        below = np.log10(n_all + v_all + 1)
        for batch in batches:
            for row in batch.to_pylist():
                ids, kinds = unpack_ints(row["ids"]).astype(np.int64), np.frombuffer(row["classes"], np.uint16)
                count = np.concatenate([unpack_ints(x["counts"]) for x in row["all"]]) if row["all"] else np.empty(0, np.uint64)
                edge = np.concatenate(([0], np.cumsum(row["sizes"])))
                log_count = np.log10(count.astype(np.float64) + 1)

                def total(by_word):
                    return np.diff(np.concatenate(([0], np.cumsum(by_word[ids])))[edge]) if len(ids) else np.zeros(len(edge) - 1)

                end_log = np.log10(ends + 1)
                size = np.array(row["sizes"], np.int64) + 1
                base = total(log_count - below) + end_log - below
                in_class = total(log_count - log_class[kinds]) + end_log - log_class[-1]
                packed = Packed(sequences(row, len(log_class), ids))
                path = packed.likelihoods(packed.forward(start, move, emit)[2])
                known = total((count > 0).astype(np.int64)) + int(ends > 0)
                n = len(size)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(size), pa.array(known.astype(np.int64)),
                    pa.array([n_all] * n, pa.int64()), pa.array(base), pa.array(path + in_class)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    whole = table.select("chunk", "doc_ids", "held", "sizes", "ids", "classes").join(back, "chunk", "left")
    return whole.mapInArrow(run, schema)
