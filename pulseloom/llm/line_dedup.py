"""Line dedup: documents probe a sharded minimal perfect hash over line hashes instead of joining their lines.

Tasks count the documents of each distinct line hash of theirs; the sums that reach the threshold are the keys
of the index. This departs from an index over all distinct lines: any other line is dropped from no document, and its
probe fails at the fingerprint, so that the results are the same and the index is a small part of the size. Each
shard is a minimal perfect hash with an array of fingerprints and one of counts. An index within a checked
size is broadcast; a larger one stays where it is and packed probes go to its shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.common import LOWER_BYTES, SPACE, byte_slices, small_batches, spare, tidy, written
from pulseloom.llm.perfect_hash import PerfectHash, U

#: Keys of a shard about; distinct lines a task counts at once; bytes of index to broadcast; bytes of text taken at once.
SHARD, COUNTED, BROADCAST, SLICE = 50_000, 200_000, 64 << 20, 4 << 20
#: Packed probe rows (one a slice of text and shard) that meet a copy of their shard in one group.
TOGETHER = 16
_SPACE = SPACE.encode()


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).translate(LOWER_BYTES)


def _digest(key: bytes) -> int:
    return xxhash.xxh3_128_intdigest(key)


def _halves(digests: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(d.to_bytes(16, "little") for d in digests), U).reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].copy()


def _count(docs: DataFrame, least: int) -> DataFrame:
    """(h, mark, documents): partial counts of each task."""

    def rows(counts):
        h, mark = _halves(list(counts))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(mark.view(np.int64)), pa.array(list(counts.values()), pa.int64())], ["h", "mark", "documents"])

    def run(batches):
        counts: dict[int, int] = {}
        for batch in batches:
            texts = batch.column(0)
            for a, b in byte_slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), SLICE):
                for text in texts.slice(a, b - a).cast(pa.large_binary()).to_pylist():
                    for key in {line_key(x) for x in (text or b"").split(b"\n")}:
                        if len(key) >= least and len(key.decode(errors="ignore")) >= least:
                            counts[d] = counts.get(d := _digest(key), 0) + 1
                if len(counts) > COUNTED:
                    yield rows(counts)
                    counts = {}
        if counts:
            yield rows(counts)

    return docs.mapInArrow(tidy(run), "h long, mark long, documents long")


def line_index(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """The index: (shard, shards, levels, bits, marks, counts) of the lines of at least min_docs documents.

    Keys are lines stripped of U+0020 and U+0009 to U+000D at both ends with A-Z lower-cased, of at least min_chars code points.
    """
    counts = _count(docs.select(F.col(text_col).cast("string").alias("text")), min_chars)
    common = written(counts.groupBy("h", "mark").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= min_docs), "lines")
    shards = max(1, -(-common.count() // SHARD))

    def build(rows: pa.Table) -> pa.Table:
        h, mark, times = (rows.column(c).to_numpy() for c in ("h", "mark", "documents"))
        if len(np.unique(h)) < len(h):
            raise ValueError("two lines share 64 hash bits of a shard; use another hash")
        parts = PerfectHash.build(h.view(U), mark.view(U), times).pack()
        return pa.table([pa.array([rows.column("shard")[0].as_py()], pa.int32()), pa.array([shards], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], ["shard", "shards", "levels", "bits", "marks", "counts"])

    placed = common.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int"))
    return written(placed.groupBy("shard").applyInArrow(build, "shard int, shards int, levels binary, bits binary, marks binary, counts binary"), "index")


class Probe:
    def __init__(self, rows):
        self.shards = {r[0]: PerfectHash.unpack(*r[2:6]) for r in rows}

    def __call__(self, shard: np.ndarray, h: np.ndarray, mark: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        for s, table in self.shards.items():
            at = np.flatnonzero(shard == s)
            out[at] = table.count(h[at], mark[at])
        return out


def _xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64 gives for a long column."""
    p1, p2, p3, p4, p5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << U(n)) | (v >> U(64 - n))
    with np.errstate(over="ignore"):
        acc = (U(seed) + p5 + U(8)) ^ (turn(x.view(U) * p2, 31) * p1)
        acc = turn(acc, 27) * p1 + p4
        acc = (acc ^ (acc >> U(33))) * p2
        acc = (acc ^ (acc >> U(29))) * p3
        return acc ^ (acc >> U(32))


def _shard_of(mark: np.ndarray, shards: int) -> np.ndarray:
    return _xxhash64_long(mark).view(np.int64) % shards


def _lines(texts: list[bytes]) -> tuple[list[list[bytes]], list[bytes]]:
    lines = [t.split(b"\n") for t in texts]
    return lines, [line_key(x) for own in lines for x in own]


def _kept(texts: list[bytes], drop_of) -> tuple[list[str], list[int], list[int]]:
    lines, keys = _lines(texts)
    drop, at, kept = drop_of(keys), 0, []
    for own in lines:
        kept.append(b"\n".join(x for x, d in zip(own, drop[at : at + len(own)]) if not d).decode())
        at += len(own)
    ends = np.cumsum([0, *map(len, lines)])
    dropped = np.concatenate([[0], np.cumsum(drop)])
    return kept, [len(x) for x in lines], (dropped[ends[1:]] - dropped[ends[:-1]]).tolist()


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", broadcast_bytes: int = BROADCAST) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` less its repeated lines, and n_lines (before) and n_dropped.

    A line is repeated if its key (see line_index) is in at least ``min_docs`` rows; all its lines go from
    every row, the others stay, joined by U+000A. Null and empty texts are one empty line and come back as
    empty texts; a text whose lines all go comes back empty. Repeated rows each count as a document. Other
    columns come through as they are, but columns named n_lines and n_dropped are replaced. An empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    index = line_index(docs, min_docs, min_chars, text_col)
    size = index.agg(F.sum(F.expr("length(levels) + length(bits) + length(marks) + length(counts)"))).first()[0] or 0
    text_at = docs.columns.index(text_col)
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in docs.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    least = min_chars

    def replaced(batch, columns, kept, lines, dropped):
        out = [c for c in columns[: len(schema) - 2]]
        out[text_at] = pa.array(kept, pa.string())
        return pa.RecordBatch.from_arrays([*out, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema.names)

    def slices(batches):
        for batch in batches:
            texts = batch.column(text_at).cast(pa.string())
            for a, b in byte_slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), SLICE):
                yield batch.slice(a, b - a), [t or b"" for t in texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()]

    if size <= broadcast_bytes:
        rows = [tuple(r) for r in index.collect()]
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def probe(batches):
            table, shards = Probe(sent.value), sent.value[0][1] if sent.value else 1
            seen: dict[bytes, bool] = {}

            def drop_of(keys):
                new = [k for k in dict.fromkeys(keys) if k not in seen and k]
                if len(seen) > COUNTED:
                    seen.clear()
                    new = [k for k in dict.fromkeys(keys) if k]
                if new:
                    h, mark = _halves([_digest(k) for k in new])
                    seen.update(zip(new, (table(_shard_of(mark, shards), h, mark) >= min_docs).tolist()))
                seen[b""] = least <= 0 and bool(table(*_empty(shards))[0] >= min_docs)
                return [seen[k] for k in keys]

            for batch, texts in slices(batches):
                yield replaced(batch, batch.columns, *_kept(texts, drop_of))

        return docs.mapInArrow(tidy(probe), schema)

    row_col, hit_col = spare("_row", docs.columns), spare("_hits", docs.columns)
    kept = written(docs.withColumn(row_col, F.monotonically_increasing_id()), "rows")
    shards = index.first()["shards"]

    def ask(batches):
        for batch, texts in slices(batches):
            lines, keys = _lines(texts)
            h, mark = _halves([_digest(k) for k in keys])
            row = np.repeat(batch.column(len(schema) - 2).to_numpy(), [len(x) for x in lines])
            number = np.concatenate([np.arange(len(x)) for x in lines])
            shard = _shard_of(mark, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            found = [(s, order[cuts[s] : cuts[s + 1]]) for s in range(shards) if cuts[s] < cuts[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), *(pa.array([x[o].tobytes() for _, o in found], pa.binary()) for x in (h, mark, row.astype(np.int64), number.astype(np.int64)))], ["shard", "h", "m", "row", "line"])

    def answer(asks: pa.Table, tables: pa.Table) -> pa.Table:
        got = []
        for part in tables.slice(0, 1).to_pylist():
            table = Probe([(part["shard"], shards, part["levels"], part["bits"], part["marks"], part["counts"])])
            for r in asks.to_pylist():
                h, mark = np.frombuffer(r["h"], U), np.frombuffer(r["m"], U)
                hit = table(np.full(len(h), r["shard"]), h, mark) >= min_docs
                got.append((np.frombuffer(r["row"], np.int64)[hit], np.frombuffer(r["line"], np.int64)[hit]))
        return pa.table([pa.array(np.concatenate([g[i] for g in got] or [np.zeros(0, np.int64)])) for i in (0, 1)], [row_col, "line"])

    # probes of a slice of text and a shard are one row; a few such rows meet one copy of the shard, so that a line that
    # very many documents hold is looked up in as many groups as there are slices, and a shard is unpacked once a group
    asked = written(kept.mapInArrow(tidy(ask), "shard int, h binary, m binary, row binary, line binary"), "probes")
    copies = max(1, -(-asked.count() // (shards * TOGETHER)))
    left = asked.withColumn("copy", F.pmod(F.xxhash64("row"), F.lit(copies)))
    right = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    met = left.groupBy("shard", "copy").cogroup(right.groupBy("shard", "copy")).applyInArrow(answer, f"`{row_col}` long, line long")
    hits = met.groupBy(row_col).agg(F.collect_list("line").alias(hit_col))
    joined = kept.join(hits, row_col, "left").select(*docs.columns, row_col, hit_col)

    def cut(batches):
        for batch, texts in slices(batches):
            hits = [set(x or ()) for x in batch.column(len(schema) - 1).to_pylist()]
            drop = [n in own for own, t in zip(hits, texts) for n in range(t.count(b"\n") + 1)]
            yield replaced(batch, batch.columns, *_kept(texts, lambda keys: drop))

    return joined.mapInArrow(tidy(cut), schema)


def _empty(shards: int):
    h, mark = _halves([_digest(b"")])
    return _shard_of(mark, shards), h, mark
