"""SimHash near-dedup: fingerprints, and links between those at a small Hamming distance by pivot tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, met, packed, plain_text, whole, written
from .components import components

#: Blocks of a fingerprint; two with at most DISTANCE differing bits agree in BLOCKS - DISTANCE of them.
DISTANCE, BLOCKS = 4, 6
#: Reference fingerprints, eight to a column of the pivot table.
PIVOTS, TABLE = 32, ["near_0", "near_1", "near_2", "near_3"]
#: A block value shared by more fingerprints than this is dealt out as pairs of chunks.
CHUNK = 8192

_ABC = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values (seed 42) of the text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_ABC).split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends, at = [], 0
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *ends]
        parts = [joined[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :])]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(p, 42) for p in parts), np.uint64, len(parts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns in keep, a row per row of docs; fp is the fingerprint as a signed 64-bit integer.

    Null and wordless texts have fp 0; texts shorter than a shingle are one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", *keep])

    slim = docs.select(whole(key).alias("doc_id"), F.col(text).alias("text"), *keep)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[2:])
    return slim.mapInArrow(run, "doc_id long, fp long" + more)


def _tables(fp: Column) -> list[Column]:
    """A key for each choice of blocks that must agree; the number of the choice is in its high bits."""
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [(F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1), b - a) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for number, chosen in enumerate(combinations(blocks, BLOCKS - DISTANCE)):
        value = F.lit(number).cast("long")
        for block, width in chosen:
            value = F.shiftleft(value, width).bitwiseOR(block)
        keys.append(value)
    return keys


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        new = new[new]
        new = new[new]
        if (new == low).all():
            break
        low = new
    keep = low != np.arange(len(nodes))
    return nodes[keep], nodes[low[keep]]


def pivots() -> list[int]:
    """The reference fingerprints, as signed 64-bit integers; the same in every run."""
    return [int(p) for p in np.random.default_rng(20).integers(-(2**63), 2**63, PIVOTS, dtype=np.int64)]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """nodes with TABLE: the Hamming distances of fp to all pivots, a byte each, eight to a long.

    By the triangle inequality two fingerprints differ in at least as many bits as any of these differ.
    """
    columns = {}
    for i, name in enumerate(TABLE):
        packed = F.lit(0).cast("long")
        for j, pivot in enumerate(pivots()[8 * i : 8 * i + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(pivot))).cast("long"), 8 * j))
        columns[name] = packed
    return nodes.withColumns(columns)


def near_in(group: np.ndarray, fp: np.ndarray, side: np.ndarray, table: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Edges that link all pairs of a group within distance, and the numbers of pairs seen and of those the table left.

    side: 0 and 1 pair with each other only, 2 with its like. table: a row of pivot distances for each
    fingerprint. Rows of a group stand in the order of the first coordinate, so partners whose first
    coordinates differ too much are never visited. Pairs are discarded by their largest coordinate
    difference, eight coordinates at a time; what survives all PIVOTS of them is verified.
    """
    order = np.lexsort((table[:, 0], group))
    group, fp, table, side = group[order], fp[order], table[order], side[order]
    found_u, found_v, held, seen, left = [], [], 0, 0, 0
    active, step = np.arange(len(fp)), 0
    while len(active):
        step += 1
        active = active[active + step < len(fp)]
        other = active + step
        near = (group[active] == group[other]) & (table[other, 0] - table[active, 0] <= distance)
        active = active[near]
        other = active + step
        pair = (side[active] == 2) | (side[active] != side[other])
        i, j = active[pair], other[pair]
        seen += len(i)
        for at in range(0, PIVOTS, 8):
            close = (np.abs(table[i, at : at + 8] - table[j, at : at + 8]) <= distance).all(axis=1)
            i, j = i[close], j[close]
        left += len(i)
        same = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        found_u.append(fp[i[same]])
        found_v.append(fp[j[same]])
        held += int(same.sum())
        if held > 1_000_000:
            u, v = _forest(np.concatenate(found_u), np.concatenate(found_v))
            found_u, found_v, held = [u], [v], len(u)
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), seen, left
    return *_forest(np.concatenate(found_u), np.concatenate(found_v)), seen, left


def compared(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v, seen, left): edges whose components are those of all pairs of distinct fp of nodes within distance; rows without u and v count
    the pairs that a piece of work saw and that the pivot table left to verify.

    Fingerprints meet where BLOCKS - DISTANCE of their blocks agree; there the pivot table decides which
    pairs are looked at. A block value that very many share is split into chunks whose pairs are dealt out,
    so no task holds such a group whole.
    """
    if distance > DISTANCE:
        raise ValueError(f"the tables find distances up to {DISTANCE}")
    keyed = pivot_table(nodes.select("fp")).select("fp", *TABLE, F.explode(F.array(*_tables(F.col("fp")))).alias("key"))
    full = keyed.groupBy("key").count().where(F.col("count") > CHUNK)
    full = written(full.select("key", "count", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "simhash-full")
    total = nodes.count() * len(_tables(F.col("fp")))
    dealt = met(keyed, full, "key", "count", total, F.xxhash64("fp")) if not full.isEmpty() else keyed.withColumn("chunks", F.lit(1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)
    spread = dealt.select("fp", *TABLE, "key", "own", F.explode(others).alias("other"))
    rows = spread.select(
        "fp",
        *TABLE,
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group: whole groups are worked on a few at a time."""

        def work(t: pa.Table) -> pa.RecordBatch:
            fp, group, side = (t.column(c).to_numpy() for c in ("fp", "group", "side"))
            table = np.stack([t.column(c).to_numpy() for c in TABLE], axis=1).astype("<i8").view(np.int8)
            u, v, seen, left = near_in(group, fp.view(np.uint64), side, table, distance)
            none = [None] * len(u)
            columns = [[*u.view(np.int64), None], [*v.view(np.int64), None], [*none, seen], [*none, left]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v", "seen", "left"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > 400_000:
                t = pa.Table.from_batches(held).combine_chunks()
                g = t.column("group").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield work(t.slice(0, cut).combine_chunks())
                    held = t.slice(cut).combine_chunks().to_batches()
                    rows = t.num_rows - cut
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "u long, v long, seen long, left long")


def links(found: DataFrame) -> DataFrame:
    """(u, v): the edges of compared()."""
    return found.where("u is not null").select("u", "v")


def report(found: DataFrame) -> DataFrame:
    """One row of compared(): pairs seen, pairs that the pivot table discarded, pairs verified."""
    return found.agg(F.sum("seen").alias("seen"), F.sum(F.col("seen") - F.col("left")).alias("discarded"), F.sum("left").alias("verified"))


def _grouped(docs: DataFrame, text: str, key: str, shingle: int, distance: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, root, component_id) and the columns in keep, a row per row of docs; root is one fp of the component and tells components apart."""
    fps = written(fingerprints(docs, text, key, shingle, keep), "simhash")
    rows = fps.count()
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "simhash-nodes", rows)
    total = nodes.count()
    found = components(links(compared(nodes, distance)), "simhash-stars", total * len(_tables(F.col("fp"))))
    placed = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "simhash-placed", total)
    firsts = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    named = written(met(placed.drop("first_id"), firsts, "root", "members", total, F.xxhash64("fp")), "simhash-named", total)
    found = met(fps, named, "fp", "copies", rows, F.xxhash64("doc_id")).select("doc_id", "fp", "root", "component_id", *keep)
    return packed(found, rows)


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id), a row per row of docs.

    component_id is the smallest doc_id among all documents reachable over links of at most distance
    differing bits, exact copies included. A null doc_id (or one that is no whole number) is never the smallest
    unless all are null. Null and wordless texts have fp 0 and are linked like any other. Empty input gives no rows.
    """
    return _grouped(docs, text, key, shingle, distance).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, distance: int = DISTANCE) -> DataFrame:
    """One row of docs for each component, with all its columns: of those with its smallest id, one with the least digest of the text.

    A row stands for its own component only, so different texts under one id, or under null ids, each keep
    theirs. Rows meet their winner by digest and id, so null ids spread over the reducers.
    """

    def name(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(""))

    d, k = fresh(docs, "digest", "key")
    marked = docs.withColumn(d, F.sha2(plain_text(F.col(text)), 256))
    slim = marked.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(d).alias("digest"))
    found = _grouped(slim, "text", "doc_id", shingle, distance, ("digest",))
    best = found.where("doc_id <=> component_id").groupBy("root", "doc_id").agg(F.min("digest").alias("digest"))
    best = best.select(F.col("digest").alias(d), name(F.col("doc_id")).alias(k))
    kept = marked.withColumn(k, name(whole(key))).join(best, [d, k], "left_semi")
    return kept.dropDuplicates([d, k]).drop(d, k)
