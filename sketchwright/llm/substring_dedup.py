"""Substring dedup: Rabin-Karp hashes of all token windows, repeats found in Spark, removal by maximal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .parts import BYTE_BASE, BYTE_VALUES, OTHER_BYTE_BASE, OTHER_VALUES, OTHER_WORD_BASE, WORD_BASE, Polynomial, buckets_for, dealt, in_order, is_pair_in

#: Words of a window.
WINDOW = 20
#: Bytes whose words are hashed at once.
AT_ONCE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _pieces(texts: list[bytes]) -> Iterator[bytes]:
    """The texts, a space after each, in pieces of about AT_ONCE bytes that end at a space."""
    held, size = [], 0
    for t in texts:
        at = 0
        while len(t) - at > AT_ONCE:  # a long text is cut behind a word
            cut = at + AT_ONCE
            while cut < len(t) and not _SPACE[t[cut]]:
                cut += 1
            yield b" ".join([*held, t[at:cut], b""])
            held, size, at = [], 0, cut
        held.append(t[at:])
        size += len(t) - at
        if size > AT_ONCE:
            yield b" ".join([*held, b""])
            held, size = [], 0
    if held:
        yield b" ".join([*held, b""])


#: What makes the two hashes of a window: values of bytes, base of bytes, base of words.
HASHES = [(BYTE_VALUES, BYTE_BASE, WORD_BASE), (OTHER_VALUES, OTHER_BYTE_BASE, OTHER_WORD_BASE)]


def word_hashes(texts: list[bytes], count: int) -> list[np.ndarray]:
    """The first `count` hashes of each word of the texts, one text after the other."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(count)]
    for piece in _pieces(texts):
        data = np.frombuffer(piece, np.uint8)
        inside = np.concatenate([[False], ~_SPACE[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        for out, (values, base, _) in zip(found, HASHES):
            out.append(Polynomial(values[data], base).slices(edges[::2], edges[1::2]))
    return [np.concatenate(out) for out in found]


def windows(texts: list[bytes], window: int, count: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The first `count` hashes of all windows of `window` words within a text, the words they start at, and the words' bounds by text."""
    bounds = np.concatenate([[0], np.cumsum([len(t.split()) for t in texts], dtype=np.int64)]) if texts else np.zeros(1, np.int64)
    hashes = word_hashes(texts, count)
    room = np.ones(bounds[-1] + 1, bool)
    for k in np.flatnonzero(np.diff(bounds) > 0):
        room[max(bounds[k], bounds[k + 1] - window + 1) : bounds[k + 1]] = False
    starts = np.flatnonzero(room[:-1])
    return [Polynomial(h, base).slices(starts, starts + window) for h, (_, _, base) in zip(hashes, HASHES)], starts, bounds


def removal(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, spans array<struct<start, end>> of removed words, kept string.

    A word goes if a window over it has a word sequence that also starts earlier, in a smaller id or
    before it in the same document. Null text has no words; null ids (and ids that are no whole numbers) come after all others; rows of
    one id stand in the order of their texts, and the later ones repeat the earlier ones. Empty input
    gives no rows.

    Ids are cut into parts. A part sends each distinct window hash once, dealt by ranges of the hash; a range
    answers with a bit each: another part has it too. For those windows the part sends a second hash to the
    same range, which answers which of them an earlier part has. So a passage in any number of documents costs
    a reducer one hash a part, never its documents. Windows are alike if the second, independent hash agrees in
    64 bits, and the first with that of another part's window in 64 and with this one's in those of its range.
    """
    rows, parts = dealt(docs, text, key)
    buckets = buckets_for(parts)
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def by_bucket(ranked: np.ndarray) -> np.ndarray:
        return np.searchsorted(ranked >> shift, np.arange(buckets + 1, dtype=np.uint64))

    def sent(table: pa.Table, full: np.ndarray, blobs: list[bytes]) -> pa.Table:
        part = table.column("part")[0].as_py()
        return pa.table({"bucket": pa.array(full, pa.int32()), "part": pa.array([part] * len(full), pa.int32()), "hashes": pa.array(blobs, pa.binary())})

    def send(table: pa.Table) -> pa.Table:
        _, texts = in_order(table)
        distinct = np.unique(windows(texts, window, 1)[0][0])
        ends = by_bucket(distinct)
        full = np.flatnonzero(np.diff(ends))
        return sent(table, full, [distinct[ends[k] : ends[k + 1]].astype("<u8").tobytes() for k in full])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        blobs = table.column("hashes").to_pylist()
        hashes = np.frombuffer(b"".join(blobs), "<u8")
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        shared = np.zeros(len(hashes), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        ends = np.cumsum([len(b) // 8 for b in blobs])
        masks = [np.packbits(m).tobytes() for m in np.split(shared, ends[:-1])]
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "shared": pa.array(masks, pa.binary())})

    def confirm(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "hashes": pa.array([], pa.binary())})
        _, texts = in_order(table)
        (first, second), _, _ = windows(texts, window, 2)
        distinct, place = np.unique(first, return_inverse=True)
        ends = by_bucket(distinct)
        shared = np.zeros(len(distinct), bool)
        for bucket, mask in zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist()):
            a, b = ends[bucket], ends[bucket + 1]
            shared[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a)
        pick = shared[place]
        pairs = np.stack([first[pick] >> shift, second[pick]], axis=1)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])[: len(pairs)]]
        ends = np.searchsorted(pairs[:, 0], np.arange(buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(ends))
        return sent(table, full, [pairs[ends[k] : ends[k + 1], 1].astype("<u8").tobytes() for k in full])

    def settle(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("part")
        blobs = table.column("hashes").to_pylist()
        hashes = np.frombuffer(b"".join(blobs), "<u8")
        order = np.argsort(hashes, kind="stable")  # equal hashes stay in the order of their parts
        again = np.zeros(len(hashes), bool)
        again[order[1:]] = hashes[order][1:] == hashes[order][:-1]
        ends = np.cumsum([len(b) // 8 for b in blobs])
        kept = [h[m].tobytes() for h, m in zip(np.split(hashes, ends[:-1]), np.split(again, ends[:-1]))]
        return table.drop_columns("hashes").append_column("again", pa.array(kept, pa.binary())).filter(pa.array([bool(k) for k in kept]))

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "spans": pa.array([], _SPANS), "kept": pa.array([], pa.string())})
        ids, texts = in_order(table)
        (first, second), starts, bounds = windows(texts, window, 2)
        order = np.lexsort((np.arange(len(first)), second, first))
        gone = np.zeros(len(first), bool)  # within the part, all but the first of equal windows
        gone[order[1:]] = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
        again = answers.column("again").to_pylist()
        of = np.repeat(np.array(answers.column("bucket").to_pylist(), np.uint64), [len(b) // 8 for b in again])
        gone |= is_pair_in(first >> shift, second, np.stack([of, np.frombuffer(b"".join(again), "<u8")], axis=1))
        change = np.zeros(bounds[-1] + 1, np.int64)
        np.add.at(change, starts[gone], 1)
        np.add.at(change, starts[gone] + window, -1)
        covered = np.cumsum(change[:-1]) > 0
        counts, removed, spans, kept = [], [], [], []
        for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
            words, off = t.split(), covered[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]])))
            if len(edges):
                stay, at = [], 0
                for x, y in zip(edges[::2], edges[1::2]):
                    stay += words[at:x]
                    at = y
                words = stay + words[at:]
            counts.append(b - a)
            removed.append(int(off.sum()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])])
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.table({"doc_id": ids, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.string())})

    hashes = "bucket int, part int, hashes binary"
    shared = rows.groupBy("part").applyInArrow(send, hashes).groupBy("bucket").applyInArrow(compare, "part int, bucket int, shared binary")
    pairs = rows.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(confirm, hashes)
    answers = pairs.groupBy("bucket").applyInArrow(settle, "bucket int, part int, again binary")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(remove, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
