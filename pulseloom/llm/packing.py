"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A queue of share p has earned p*t tokens when t were
placed in all; it is served a quantum as soon as its deficit (earned less served) reaches half a quantum.
Every window so holds each source's share to within a quantum, and deficits carry over from window to
window. The moment of service (k + 1/2) * quantum / p of quantum k is known in advance, so the place of every
quantum is arithmetic on the queues' totals: tasks need nothing of each other but what came before them in
each queue, and the deficits carry over partitions as they do over windows.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseloom.llm.bpe import SIMPLE, Remembered, blank_split, byte_letters
from pulseloom.llm.common import byte_slices, small_batches, tidy, written

#: Queues of their own, besides those of named shares; the sources beyond (those with the fewest tokens) share one more.
QUEUES = 1024
SLICE, SCALE = 4 << 20, 1 << 20
NO_SOURCE = "\x00none"
_LETTERS = dict(enumerate(byte_letters()))


class LibraryTokens:
    """Ids of the tokenizers library, remembered for each text between two blanks (no rule reaches across one)."""

    def __init__(self, spec: str):
        self.coder = Tokenizer.from_str(spec)
        self.coder.no_padding()
        self.coder.no_truncation()
        self.model = self.coder.model
        self.words, self.chunks = Remembered(self._word), Remembered(self._chunk)

    def _ids(self, text: str) -> bytes:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _word(self, word: str) -> bytes:
        # a lower-case word or punctuation of Latin-1 is its own normal form and one pre-token: only the stand-ins of its bytes are missing
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():  # most parts are a word, or a word and a mark
            if chunk.isalpha():
                return self.words[chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in ",.;:!?":
                return self.words[chunk[:-1].lower()] + self.words[chunk[-1]]
        if m := SIMPLE.fullmatch(chunk):
            return self.words[m[1].lower()] + (self.words[m[2]] if m[2] else b"")
        return self._ids(chunk)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, blank_split(text)))


def _tokens(docs: DataFrame, spec: str, last_id: int) -> DataFrame:
    """(task, doc_id, queue, before, tokens, ids): a task's documents in order, with what it has of the queue before each."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        coder, task, so_far, end = LibraryTokens(sent.value), TaskContext.get().partitionId(), {}, np.array([last_id], np.uint32).tobytes()
        for batch in batches:
            text, queues = batch.column(1), batch.column(2).to_pylist()
            for a, b in byte_slices(pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist(), SLICE):
                ids = [coder.encode(t or "") + end for t in text.slice(a, b - a).to_pylist()]
                before = []
                for queue, x in zip(queues[a:b], ids):
                    before.append(so_far.get(queue, 0))
                    so_far[queue] = before[-1] + len(x) // 4
                yield pa.RecordBatch.from_arrays([pa.array([task] * (b - a), pa.int64()), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(before, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["task", "doc_id", "queue", "before", "tokens", "ids"])

    return docs.mapInArrow(tidy(run), "task long, doc_id long, queue string, before long, tokens long, ids binary")


class Schedule:
    """Places of the quanta of all queues. totals: tokens by queue; shares: weights by queue (default: in proportion to the tokens)."""

    def __init__(self, totals: list[int], quantum: int, shares: list[float] | None = None):
        self.totals, self.quantum = np.array(totals, np.int64), quantum
        weights = np.array(totals if shares is None else shares, np.float64)
        self.weights = np.maximum(1, np.rint(weights / max(weights.sum(), 1e-300) * SCALE)).astype(np.int64)

    def place(self, queue: np.ndarray, quantum: np.ndarray) -> np.ndarray:
        """Tokens placed before quantum ``quantum`` of queue ``queue``: of each other queue all quanta due earlier (ties: the lower queue)."""
        own = self.weights[queue]
        out = quantum * self.quantum
        for q, (total, weight) in enumerate(zip(self.totals, self.weights)):
            due = (2 * quantum + 1) * weight - own
            served = np.where(queue > q, due // (2 * own) + 1, -(-due // (2 * own)))
            out += np.where(queue == q, 0, np.minimum(total, np.maximum(served, 0) * self.quantum))
        return out

    def pieces(self, queue: np.ndarray, start: np.ndarray, tokens: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """(row, begin in the row, length, position): each row's tokens cut at quanta and windows, neighbours joined."""
        first, last = start // self.quantum, (start + tokens - 1) // self.quantum
        times = last - first + 1
        row = np.repeat(np.arange(len(queue)), times)
        k = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[row]
        head = np.maximum(start[row], k * self.quantum)
        tail = np.minimum(start[row] + tokens[row], (k + 1) * self.quantum)
        at = self.place(queue[row], k) + head - k * self.quantum
        begin, length = head - start[row], tail - head
        parts = (at + length - 1) // window - at // window + 1
        again = np.repeat(np.arange(len(row)), parts)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.maximum(at[again], (at[again] // window + nth) * window)
        right = np.minimum(at[again] + length[again], (at[again] // window + nth + 1) * window)
        row, begin, at, length = row[again], begin[again] + left - at[again], left, right - left
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + length[:-1]) | (at[1:] % window == 0)
        if not len(row):
            return row, begin, length, at
        heads = np.flatnonzero(new)
        return row[heads], begin[heads], np.add.reduceat(length, heads), at[heads]


def pack(docs: DataFrame, spec: str, window: int = 2048, quantum: int = 128, last_id: int = 1, shares: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens: (doc_id, start, length, ids, doc_tokens, queue, sequence_id, offset).

    A document's ids are those of the tokenizer file ``spec`` without special tokens, then ``last_id``; ``ids`` are
    a piece's ids as unsigned little-endian 32-bit numbers. Only the last sequence may be short. ``shares`` are target proportions by
    source; the others divide what is left of one (or one, if nothing is) by their tokens. While all queues last, each window holds
    the proportions to within a quantum.

    Null texts count as empty (one piece of one id), null sources are a queue of their own, repeated rows and
    null ids each are packed, other columns are not read, an empty table gives an empty result. Sources named in
    ``shares`` and the 1,024 with most tokens have queues of their own; the others share one more, in which they follow one
    another. No token is lost there, but only the share of all of them together is held.
    """
    tokens = written(_tokens(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("queue")), spec, last_id), "tokens")
    parts = written(tokens.groupBy("task", "queue").agg(F.sum("tokens").alias("tokens")), "queue-parts")
    sums = parts.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    named = [q for q in shares or {}]
    largest = sums.orderBy(F.col("queue").isin(named).desc(), F.desc("tokens"), "queue").limit(max(QUEUES, len(named))).collect()
    numbers = {r.queue: i for i, r in enumerate(sorted(largest, key=lambda r: r.queue))}
    totals = [r.tokens for r in sorted(largest, key=lambda r: r.queue)]
    totals.append((parts.agg(F.sum("tokens")).first()[0] or 0) - sum(totals))
    wanted = None
    if shares is not None:
        open_ = sum(t for q, t in zip([*numbers, None], totals) if q not in shares)
        left = max(0.0, 1.0 - sum(shares.get(q, 0.0) for q in numbers)) or 1.0
        wanted = [shares[q] if q in shares else left * t / max(1, open_) for q, t in zip([*numbers, None], totals)]
    plan = Schedule(totals, quantum, wanted)
    numbers_of = docs.sparkSession.createDataFrame(list(numbers.items()), "queue string, number int") if numbers else docs.sparkSession.createDataFrame([], "queue string, number int")
    numbered = parts.join(F.broadcast(numbers_of), "queue", "left").withColumn("number", F.coalesce("number", F.lit(len(numbers))))
    earlier = Window.partitionBy("number").orderBy("task", "queue").rowsBetween(Window.unboundedPreceding, -1)
    base = written(numbered.select("task", "queue", "number", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base")), "queue-bases")

    def run(batches):
        for batch in batches:
            ids, starts = batch.column("ids"), batch.column("start").to_numpy()
            queue, sizes, names = batch.column("number").to_numpy().astype(np.int64), batch.column("tokens").to_numpy(), batch.column("queue")
            for a, b in byte_slices((4 * sizes).tolist(), SLICE):
                row, begin, length, at = plan.pieces(queue[a:b], starts[a:b], sizes[a:b], window)
                raw = ids.slice(a, b - a).to_pylist()
                cut = [raw[r][4 * x : 4 * (x + n)] for r, x, n in zip(row.tolist(), begin.tolist(), length.tolist())]
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(of), pa.array(begin), pa.array(length), pa.array(cut, pa.binary()), pa.array(sizes[a:b][row]), names.slice(a, b - a).take(of), pa.array(at // window), pa.array(at % window)], ["doc_id", "start", "length", "ids", "doc_tokens", "queue", "sequence_id", "offset"])

    placed = tokens.join(base, ["task", "queue"]).select("doc_id", "queue", "number", "tokens", (F.col("before") + F.col("base")).alias("start"), "ids")
    return placed.mapInArrow(tidy(run), "doc_id long, start long, length long, ids binary, doc_tokens long, queue string, sequence_id long, offset long")
