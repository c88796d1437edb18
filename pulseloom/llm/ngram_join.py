"""N-gram Jaccard join: exact similarity components over word shingles by T-occurrence search.

1. Every text becomes a set of shingle hashes; equal sets are one node (hot groups of copies end here).
2. Count filter: two linked sets share at least ``l`` of their ``n - ceil(t*n) + l`` least hashes, so a node
   with fewer than the bound's shared hashes has no link and leaves.  The hashes travel packed by bucket,
   one posting for each hash and task, however many documents hold it.
3. Candidate blocks: of those hashes the most frequent ``l - 1`` may be left out as well; nodes that share
   one of the others are in one block.  Blocks over a part's size are formed again from whole sets; what is still
   larger is cut into parts.
4. In each part a DivideSkip T-occurrence search over the full sets finds the links; links between sets already
   connected are not looked up again.  Of a block of several parts, one set stands for all that its part linked, and
   those are searched again among themselves.  A link that is still missing joins two of the block's groups, so one of
   its ends is outside the largest group: those sets alone are searched against the whole block.
5. Components of the links; every document takes its node's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import byte_slices, shuffle_partitions, small_batches, tidy, written
from pulseloom.llm.components import components
from pulseloom.llm.shingles import U, mix, shingle_sets, signature
from pulseloom.llm.toccurrence import roots, spanning_links

#: Bytes of text shingled at once; postings a task holds before it sends them; sets in a part of a block.
SLICE, FLUSH, PART = 2 << 20, 1_000_000, 512
#: Parts that a large block is cut into for the search of what is still apart, and bytes of a part's hashes; PART sets are a part in any case.
COPIES, PART_BYTES = 8, 16 << 20
#: Documents up to which the list of wanted ids is broadcast (8 bytes each); beyond, the texts are joined to it.
WANTED = 2_000_000


def _guaranteed(n: int) -> int:
    """l(n): non-decreasing, so two linked sets share at least l(ceil(t*n)) of their bounded prefixes."""
    return n // 7 + 1


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + _guaranteed(n) if n else 0


def _needed(n: int, percent: int) -> int:
    return _guaranteed(-(-percent * n // 100))


def _batches(batches, slice_bytes=SLICE):
    """(id column, texts as bytes) in slices of bounded size."""
    for batch in batches:
        text = batch.column(1).cast(pa.large_binary())
        ids, sizes = batch.column(0), pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False)
        for a, b in byte_slices(sizes.tolist(), slice_bytes):
            yield ids.slice(a, b - a), [t or b"" for t in text.slice(a, b - a).to_pylist()]


def _pack(x, dtype) -> bytes:
    return np.ascontiguousarray(x, dtype).tobytes()


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, s1, s2) for each row."""

    def run(batches):
        for ids, texts in _batches(batches):
            sets = shingle_sets(texts, words)
            signs = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(signs[:, 0]), pa.array(signs[:, 1])], ["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, s1 long, s2 long")


def _postings(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """Packed rows (bucket, keys, nodes, counts): least hashes that one node of the task has, with the node, or 0 for several
    nodes (which are counted here: rows with counts)."""

    def flush(keys, nodes):
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[new], nodes[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(np.append(first, len(keys)))
        shared = np.repeat(times > 1, times)
        own, counts = np.unique(nodes[shared], return_counts=True)
        keys, nodes = keys[first], np.where(times > 1, 0, nodes[first])
        place = (keys % U(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(buckets + 1))
        mine = own.view(U) % U(buckets)
        by = np.argsort(mine, kind="stable")
        ends = np.searchsorted(mine[by].astype(np.int64), np.arange(buckets + 1))
        rows = [(b, _pack(keys[order[cuts[b] : cuts[b + 1]]], U), _pack(nodes[order[cuts[b] : cuts[b + 1]]], np.int64), _pack(own[by[ends[b] : ends[b + 1]]], np.int64), _pack(counts[by[ends[b] : ends[b + 1]]], np.int64)) for b in range(buckets)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "keys", "nodes", "own", "counts"])

    def run(batches):
        keys, nodes, held, total = [], [], set(), 0
        for _, texts in _batches(batches):
            for s in shingle_sets(texts, words):
                if len(s) and (sign := signature(s)) not in held:
                    held.add(sign)
                    keys.append(s[: _prefix(len(s), percent)])
                    nodes.append(np.full(len(keys[-1]), sign[0], np.int64))
                    total += len(keys[-1])
            if total > FLUSH:
                yield flush(keys, nodes)
                keys, nodes, held, total = [], [], set(), 0
        if total:
            yield flush(keys, nodes)

    return docs.mapInArrow(tidy(run), "bucket int, keys binary, nodes binary, own binary, counts binary")


def _shared_counts(postings: DataFrame, buckets: int) -> DataFrame:
    """(node, shared): how many of its least hashes another node has too (at least)."""

    def count(batches):
        keys, nodes, own, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for name, to, kind in (("keys", keys, U), ("nodes", nodes, np.int64), ("own", own, np.int64), ("counts", counts, np.int64)):
                to.extend(np.frombuffer(x, kind) for x in batch.column(name).to_pylist())
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            least, most = np.minimum.reduceat(nodes, first), np.maximum.reduceat(nodes, first)
            marked = np.logical_or.reduceat(nodes == 0, first)
            several = np.repeat((least != most) | marked, np.diff(np.append(first, len(keys))))
            got, times = np.unique(nodes[several & (nodes != 0)], return_counts=True)
            own.append(got)
            counts.append(times)
        got, sums = _summed(own, counts)
        place = (mix(got.view(U)) % U(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(buckets + 1))
        parts = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([_pack(got[o], np.int64) for _, o in parts]), pa.array([_pack(sums[o], np.int64) for _, o in parts])], ["bucket", "own", "counts"])

    def add(batches):
        own, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            own.extend(np.frombuffer(x, np.int64) for x in batch.column("own").to_pylist())
            counts.extend(np.frombuffer(x, np.int64) for x in batch.column("counts").to_pylist())
        got, sums = _summed(own, counts)
        for a in range(0, len(got), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(got[a : a + 100_000]), pa.array(sums[a : a + 100_000])], ["node", "shared"])

    partial = postings.repartition(buckets, "bucket").mapInArrow(tidy(count), "bucket int, own binary, counts binary")
    return partial.repartition(buckets, "bucket").mapInArrow(tidy(add), "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    got, place = np.unique(np.concatenate(keys), return_inverse=True)
    return got, np.bincount(place, weights=np.concatenate(counts), minlength=len(got)).astype(np.int64)


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, n, hashes) of the documents that stand for the given nodes (node, doc_id, s1, s2): a node is known by all 128 bits of its set."""
    shape = "node long, n long, hashes binary"

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([len(x[1]) for x in found], pa.int64()), pa.array([x[1].tobytes() for x in found], pa.binary())], ["node", "n", "hashes"])

    if nodes.count() <= WANTED and nodes.where("doc_id is null").isEmpty():
        table = np.array([tuple(r) for r in nodes.select("doc_id", "s1", "s2", "node").toLocalIterator()], np.int64).reshape(-1, 4)
        sent = docs.sparkSession.sparkContext.broadcast(table[np.argsort(table[:, 0], kind="stable")])

        def few(batches):
            wanted = sent.value

            def picked():
                for batch in batches:
                    keep = pa.compute.is_in(batch.column(0), value_set=pa.array(wanted[:, 0]))
                    yield batch.filter(pa.compute.fill_null(keep, False))

            for ids, texts in _batches(picked()):
                found = []
                for own, s in zip(ids.to_pylist(), shingle_sets(texts, words)):
                    sign = signature(s)
                    for at in range(*np.searchsorted(wanted[:, 0], [own, own + 1])):
                        if sign == (int(wanted[at, 1]), int(wanted[at, 2])):
                            found.append((int(wanted[at, 3]), s))
                yield rows(found)

        return docs.mapInArrow(tidy(few), shape)
    met = docs.join(nodes.select(F.col("doc_id").alias("_want"), "s1", "s2", "node"), F.col("doc_id").eqNullSafe(F.col("_want")))

    def many(batches):
        for batch in batches:
            text = batch.column(0).cast(pa.large_binary())
            sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
            for a, b in byte_slices(sizes, SLICE):
                part = batch.slice(a, b - a)
                sets = shingle_sets([t or b"" for t in text.slice(a, b - a).to_pylist()], words)
                yield rows([(node, s) for s, one, two, node in zip(sets, *(part.column(c).to_pylist() for c in ("s1", "s2", "node"))) if signature(s) == (one, two)])

    return met.select("text", "s1", "s2", "node").mapInArrow(tidy(many), shape)


def _blocks(sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(node, component): which sets may be linked, directly or through others.

    Of each set's bounded prefix (or the whole set) all but the most frequent hashes that the guaranteed overlap allows to leave out.
    """

    def run(batches):
        for batch in batches:
            nodes, ranks, keys = [], [], []
            for node, n, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                s = np.frombuffer(h, np.int64)[: None if whole else _prefix(n, percent)]
                sure = -(-percent * n // 100) if whole else _needed(n, percent)
                nodes.append(np.full(len(s), node, np.int64))
                ranks.append(np.full(len(s), len(s) - sure + 1, np.int64))
                keys.append(s)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, ranks, keys)], ["node", "most", "key"])

    least = sets.mapInArrow(tidy(run), "node long, most long, key long")
    times = least.groupBy("key").agg(F.count("*").alias("times"), F.min("node").alias("centre")).where("times > 1")
    seen = least.join(times, "key").groupBy("node", "most").agg(F.sort_array(F.collect_list(F.struct("times", "key", "centre"))).alias("seen"))
    total = least.groupBy("node").agg(F.count("*").alias("held"))
    near = seen.join(total, "node").select("node", F.explode(F.slice("seen", F.lit(1), F.greatest(F.lit(0), F.col("most") - F.col("held") + F.size("seen")).cast("int"))).alias("s"))
    return components(near.select(F.col("node").alias("a"), F.col("s.centre").alias("b")))


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component, m): blocks and their sizes; blocks over the size of a part are looked at again with whole sets."""
    sized = lambda blocks: blocks.join(blocks.groupBy("component").agg(F.count("*").alias("m")), "component")
    first = written(sized(_blocks(sets, percent, False)), "blocks")
    large = first.where(F.col("m") > PART)
    if large.isEmpty():
        return first
    again = _blocks(sets.join(large.select("node"), "node", "left_semi"), percent, True)
    return first.where(F.col("m") <= PART).unionByName(sized(again))


def _searched(work: DataFrame, percent: int) -> DataFrame:
    """(a, b): links in each group ``work`` of rows (work, node, hashes, side, label), labels null or what is known to be connected."""

    def run(rows: pa.Table) -> pa.Table:
        nodes, side, labels = (rows.column(c).to_pylist() for c in ("node", "side", "label"))
        sets = [np.frombuffer(h, U) for h in rows.column("hashes").to_pylist()]
        order = sorted(range(len(nodes)), key=lambda i: (len(sets[i]), nodes[i]))
        got = spanning_links([sets[i] for i in order], [side[i] for i in order], percent, None if None in labels else [labels[i] for i in order])
        return pa.table([pa.array([nodes[order[i]] for i, _ in got], pa.int64()), pa.array([nodes[order[j]] for _, j in got], pa.int64())], ["a", "b"])

    return work.groupBy("work").applyInArrow(run, "a long, b long")


def _grouped(work: DataFrame, percent: int) -> DataFrame:
    """(node, component, root) of rows (work, node, hashes, component): the sets of a part with the one that stands for all it links."""

    def run(rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_pylist()
        sets = [np.frombuffer(h, U) for h in rows.column("hashes").to_pylist()]
        order = sorted(range(len(nodes)), key=lambda i: (len(sets[i]), nodes[i]))
        root = roots(len(nodes), spanning_links([sets[i] for i in order], [0] * len(order), percent))
        return pa.table([pa.array([nodes[i] for i in order], pa.int64()), rows.column("component").take(pa.array(order, pa.int64())), pa.array([nodes[order[r]] for r in root], pa.int64())], ["node", "component", "root"])

    return work.groupBy("work").applyInArrow(run, "node long, component long, root long")


def _part(node: str, size, salt: int, part=PART):
    """The part of a block of ``size`` sets that a set is in."""
    return F.pmod(F.xxhash64(node, F.lit(salt)), F.ceil(size / part)).cast("int")


def _wider(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(component, part): sets in a part where two parts meet. Every set is sent once for each part of the other side, so parts widen with
    the block, up to about COPIES of them, while a part's hashes take PART_BYTES at most."""
    sized = sets.select("node", "n").join(blocks, "node").groupBy("component").agg(F.count("*").alias("k"), F.avg("n").alias("n"))
    return sized.select("component", F.greatest(F.lit(PART), F.least(F.ceil(F.col("k") / COPIES), F.floor(F.lit(PART_BYTES) / (8 * F.col("n"))))).cast("long").alias("part"))


def _links(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what all links connect."""
    small, large = blocks.where(F.col("m") <= PART), blocks.where(F.col("m") > PART)
    bucket = F.pmod(F.xxhash64("component"), F.lit(shuffle_partitions(sets.sparkSession) * 4)).cast("string")
    found = _searched(sets.join(small.select("node", "component"), "node").select("node", "hashes", bucket.alias("work"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("label")), percent)
    if large.isEmpty():
        return found
    placed = sets.join(large, "node").withColumn("work", F.concat_ws(":", "component", _part("node", F.col("m"), 1)))
    first = written(_grouped(placed.select("work", "node", "hashes", "component"), percent), "first-groups")
    heads = first.where("node = root")
    sized = heads.join(heads.groupBy("component").agg(F.count("*").alias("heads")), "component")
    again = sets.join(sized.select("node", "component", "heads"), "node").withColumn("work", F.concat_ws(":", "component", _part("node", F.col("heads"), 2)))
    second = written(_grouped(again.select("work", "node", "hashes", "component"), percent), "second-groups")
    labels = written(first.join(second.select(F.col("node").alias("root"), F.col("root").alias("label")), "root").select("node", "component", "root", "label"), "labels")
    counts = labels.groupBy("component", "label").agg(F.count("*").alias("k"))
    main = counts.groupBy("component").agg(F.max(F.struct("k", "label"))["label"].alias("main"), F.sum("k").alias("m"), (F.sum("k") - F.max("k")).alias("minors"))
    open_ = written(main.where("minors > 0"), "open")
    known = first.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = found.unionByName(known)
    if open_.isEmpty():
        return found
    open_ = written(open_.join(_wider(sets, labels.select("node", "component").join(open_, "component", "left_semi")), "component"), "parts")
    rest = sets.join(labels.select("node", "component", "label").join(open_, "component"), "node")
    part = F.col("part")
    ask = rest.where("label <> main").withColumns({"side": F.lit(0), "own": _part("node", F.col("minors"), 3, part), "others": F.sequence(F.lit(0), F.ceil(F.col("m") / part).cast("int") - 1)})
    held = rest.withColumns({"side": F.lit(1), "own": _part("node", F.col("m"), 4, part), "others": F.sequence(F.lit(0), F.ceil(F.col("minors") / part).cast("int") - 1)})
    name = lambda asked, kept: F.concat_ws(":", "component", asked, kept)
    pairs = ask.withColumn("o", F.explode("others")).withColumn("work", name("own", "o")).unionByName(held.withColumn("o", F.explode("others")).withColumn("work", name("o", "own")))
    return found.unionByName(_searched(pairs.select("work", "node", "hashes", "side", "label"), percent))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (least id that links reach, itself included).

    Texts link when 100 * intersection >= percent * union of their sets of ``words``-word shingles (A-Z
    lower-cased, words between U+0020 and U+0009 to U+000D); a text of fewer words is one shingle.

    Null, empty and word-less texts have n_shingles 0 and their own id as component_id.  Null ids count in no
    minimum: a group of none but null ids has a null component_id.  Repeated rows each give a row.  Other
    columns are not read.  An empty table gives an empty result.  Hashes have 64 bits; sets are told apart by 128.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = shuffle_partitions(docs.sparkSession)
    every = written(document_sets(docs, words), "sets")
    nodes = every.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    counts = _shared_counts(_postings(docs, words, percent, buckets), buckets)
    need = F.floor(F.ceil(F.col("n") * percent / 100) / 7) + 1
    alive = nodes.join(counts, nodes.s1 == counts.node).where(F.col("shared") >= need).select("doc_id", "s1", "s2")
    # a number of its own for each node; hashed (one to one), so that ids say nothing of the order of documents
    alive = written(alive.withColumn("node", F.xxhash64(F.monotonically_increasing_id())), "alive")
    sets = written(_full_sets(docs, alive, words), "full")
    if sets.count() > alive.count():  # rows repeated with id and text
        sets = written(sets.dropDuplicates(["node"]), "full")
    linked = components(_links(sets, _candidates(sets, percent), percent))
    named = linked.join(alive, "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = written(named.join(least, "component").select("s1", "s2", "component_id"), "known")
    copies = nodes.select("s1", "s2", F.col("doc_id").alias("least"))
    # written, so that the last join has two plain shuffles, which can be split where one node stands for many copies
    grouped = written(copies.join(known, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component_id", "least").alias("component_id")), "grouped")
    out = every.join(grouped, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
