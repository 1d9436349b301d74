"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Which suffixes are sorted: every 200-byte window names one of its positions, the leftmost smallest
hash of a GRAM-byte string in its first REACH positions. The choice depends on the window's content
only, so equal windows name equal positions, and the suffixes there share at least CORE bytes. The
windows that name a position start in one run of offsets before it. So it is enough to sort the
suffixes at named positions, about one in REACH / 2, and of these only the ones whose CORE bytes
occur again anywhere, which a count of hashes tells first.

How they are sorted: the order of all suffixes is cut into ranges at splitters taken from a sample of them. A
part sorts its suffixes and sends each range a front-coded run: each suffix as the length of the prefix it
shares with the one before and the rest. A range merges its runs with a loser tree whose nodes remember how
long a prefix the loser shares with the last output: two candidates are told apart by these lengths alone
unless they are equal, and then compared from that length on. Neighbours in the merged order that share CORE
bytes or more are repeats of a named position, and their common-prefix lengths say where such a group begins
and ends. Splitters are compared by CORE bytes, so no group is cut. Which windows over the position are
repeated, those that reach to its left included, is settled within its group by comparing their bytes.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import written
from .parts import BYTE_BASE, BYTE_VALUES, Polynomial, buckets_for, dealt, in_order, mixed

#: Bytes of a window; bytes of the strings whose hashes are compared; positions of a window that may be named.
WINDOW, GRAM, REACH = 200, 32, 120
#: Bytes that windows naming a position all hold from it on.
CORE = WINDOW - REACH + 1
#: Bytes hashed at once; positions within fit 22 bits.
AT_ONCE = 1 << 21
#: Ranges of the suffix order at most, so that their splitters (CORE bytes each) are 11 MB at most; and samples for each of them.
MOST_RANGES, SAMPLES = 1 << 17, 16

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks(lengths: list[int]) -> list[list[tuple[int, int]]]:
    """Byte ranges of the concatenated texts, in blocks of about AT_ONCE bytes; ranges of a long text overlap by a window less one."""
    blocks, held, size, at = [], [], 0, 0
    for n in lengths:
        a = 0
        while n - a >= WINDOW:
            b = min(n, a + AT_ONCE)
            held.append((at + a, at + b))
            size += b - a
            if size >= AT_ONCE:
                blocks.append(held)
                held, size = [], 0
            if b == n:
                break
            a = b - WINDOW + 1
        at += n
    return [*blocks, held] if held else blocks


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = width - size
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def named(buffer: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Named positions of the concatenated texts, the first and last start of the windows that name each, and the hash of its CORE bytes."""
    found = []
    for block in _blocks(lengths):
        data = np.concatenate([np.frombuffer(buffer, np.uint8, b - a, a) for a, b in block])
        gram, base, size = BYTE_VALUES[data], BYTE_BASE, 1
        while size < GRAM:
            gram = gram[:-size] * np.uint64(base) + gram[size:]
            base = base * base % 2**64
            size *= 2
        place = np.uint64((1 << 22) - 1)
        ranked = (mixed(gram) & ~place) | np.arange(len(gram), dtype=np.uint64)
        names = (_sliding_min(ranked, REACH) & place).astype(np.int64)
        starts = np.zeros(len(data) + 1, np.int64)
        ends = np.cumsum([b - a for a, b in block])
        begins = np.concatenate([[0], ends[:-1]])
        for x, y in zip(begins, ends):
            starts[x] += 1
            starts[y - WINDOW + 1] -= 1
        valid = np.flatnonzero(np.cumsum(starts[: len(data)]) > 0)
        names = names[valid]
        first = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (valid[1:] != valid[:-1] + 1)]))
        p, lo, hi = names[first], valid[first], valid[np.concatenate([first[1:] - 1, [len(valid) - 1]])]
        shift = np.repeat(np.array([a for a, _ in block]) - begins, np.diff(np.concatenate([begins, [len(data)]])))[lo]
        core = Polynomial(BYTE_VALUES[data], BYTE_BASE).slices(p, p + CORE)
        found.append((p + shift, lo + shift, hi + shift, core))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are known to agree and not read."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of a sorted run: lengths shared with the string before, lengths of the rests, and the rests."""
    shared = [0, *(common(a, b) for a, b in zip(strings, strings[1:]))] if strings else []
    rests = [s[k:] for s, k in zip(strings, shared)]
    return np.array(shared, "<u2"), np.array([len(r) for r in rests], "<u2"), b"".join(rests)


def decoded(shared: np.ndarray, rest: np.ndarray, tails: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for k, n in zip(shared.tolist(), rest.tolist()):
        before = before[:k] + tails[at : at + n]
        at += n
        out.append(before)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs (strings, lengths shared with the string before).

    Returns the run of each output, in order, and the length it shares with the output before. In the
    loser tree every candidate carries the length it shares with the last output; the longer one is the
    smaller string, so bytes are read only where lengths are equal, and from there on.
    """
    width = 1
    while width < max(1, len(runs)):
        width *= 2
    heads: list[bytes | None] = [s[0] if s else None for s, _ in runs] + [None] * (width - len(runs))
    at = [0] * width
    known = [0] * width
    loser = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two candidates."""
        if heads[a] is None:
            return b, a
        if heads[b] is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        k = common(heads[a], heads[b], known[a])
        win, lose = (a, b) if heads[a][k:] <= heads[b][k:] else (b, a)
        known[lose] = k
        return win, lose

    level = list(range(width))
    node = width // 2
    while node >= 1:
        level_next = []
        for i in range(node):
            win, lose = play(level[2 * i], level[2 * i + 1])
            loser[node + i] = lose
            level_next.append(win)
        level = level_next
        node //= 2
    winner = level[0]
    order: list[int] = []
    shared: list[int] = []
    for _ in range(sum(len(s) for s, _ in runs)):
        order.append(winner)
        shared.append(known[winner])
        strings, lengths = runs[winner]
        at[winner] += 1
        k = at[winner]
        if k < len(strings):
            heads[winner], known[winner] = strings[k], lengths[k]
        else:
            heads[winner], known[winner] = None, 0
        node = (winner + width) // 2
        while node >= 1:
            winner, loser[node] = play(winner, loser[node])
            node //= 2
    return order, shared


def _repeated(data: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which windows of data have an equal among the others: the keys bring likely ones together, the bytes decide."""
    repeated = np.zeros(len(key), bool)
    if len(key) < 2:
        return repeated
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    alike = np.flatnonzero(ranked[1:] == ranked[:-1])
    rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    for k in range(0, len(alike), 65_536):
        at = alike[k : k + 65_536]
        equal = (rows[start[order[at]]] == rows[start[order[at + 1]]]).all(axis=1)
        repeated[order[at[equal]]] = repeated[order[at[equal] + 1]] = True
        for value in np.unique(ranked[at[~equal]]):  # one key for different bytes: compare all that have it
            by_bytes: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(key == value):
                by_bytes.setdefault(rows[start[i]].tobytes(), []).append(i)
            for members in by_bytes.values():
                repeated[members] |= len(members) > 1
    return repeated


def _contexts(buffer: bytes, names: tuple[np.ndarray, ...], wanted: np.ndarray) -> dict[tuple[bytes, bytes, int], list[int]]:
    """The distinct contexts of the named positions whose core hash is wanted, and where each starts, ascending.

    A context is what the windows that name a position cover: the bytes from it on (the suffix, as far as windows reach),
    the bytes before it, and the offset of the last window's start to the position (at most 0 minus the least offset).
    """
    p, lo, hi, core = names
    pick = np.flatnonzero(np.isin(core, wanted))
    found: dict[tuple[bytes, bytes, int], list[int]] = {}
    for x, a, z in zip(p[pick].tolist(), lo[pick].tolist(), hi[pick].tolist()):
        found.setdefault((buffer[x : z + WINDOW], buffer[a:x], x - z), []).append(a)
    return found


def _settle(texts: list[bytes], marks: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray, group: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each context (text; position of the name in it; least and largest offset of its windows) the ranges that repeated windows cover.

    A window repeats if its context occurs more than once (many), or another context of its group holds it at the same offset.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else lengths
    prefix = Polynomial(BYTE_VALUES[np.frombuffer(b"".join(texts), np.uint8)], BYTE_BASE)
    count = high - low + 1
    owner = np.repeat(np.arange(len(texts)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # windows of a context by ascending start
    start = begin[owner] + marks[owner] - high[owner] + step
    offset = (high[owner] - step).astype(np.uint64)
    key = mixed(prefix.slices(start, start + WINDOW) ^ mixed(group[owner].astype(np.uint64) * np.uint64(512) + offset))
    repeated = _repeated(np.frombuffer(b"".join(texts), np.uint8), start, key) | many[owner]
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    hit = np.flatnonzero(repeated)
    if len(hit):
        first = np.concatenate([[True], (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])])
        a = hit[first]
        b = hit[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(hit) - 1]])]
        for x, y in zip(a, b):
            k = owner[x]
            found[k].append((int(start[x] - begin[k]), int(start[y] - begin[k] + WINDOW)))
    return found


def removal(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, spans array<struct<start, end>> of removed bytes, kept binary.

    A byte goes if a 200-byte string over it also starts anywhere else, in the same document too. Null
    text is empty; texts under 200 bytes lose nothing; of repeated rows all lose what they share. Ids that are
    no whole numbers count as null and stand last. Empty input gives no rows.

    Texts are exchanged once, dealt by ranges of the id. A part then sends hashes of its named cores;
    the answers say which occur again; for those it sends front-coded runs; the answers are the byte
    ranges to remove. A part sends equal contexts once, with their number, and applies the answer to all
    places it has them in; so a passage in any number of documents costs a range a few strings a part.
    """
    rows, parts = dealt(docs, text, key)
    buckets = buckets_for(parts)
    mask = np.uint64(buckets - 1)
    ranges_wanted = min(buckets, MOST_RANGES)
    sampled = max(1, SAMPLES * ranges_wanted // parts)

    def send_cores(table: pa.Table) -> pa.Table:
        """Hashes of the named cores by hash range; in bucket -1 the bytes of those with the smallest hashes, a sample."""
        _, texts = in_order(table)
        buffer = b"".join(texts)
        position, _, _, core = named(buffer, [len(t) for t in texts])
        distinct, first, counts = np.unique(core, return_index=True, return_counts=True)
        sample = [buffer[x : x + CORE] for x in position[first[:sampled]].tolist()]
        part = table.column("part")[0].as_py()
        bucket = (distinct & mask).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(ends))
        picks = [order[ends[k] : ends[k + 1]] for k in full]
        return pa.table(
            {
                "bucket": pa.array([*full.tolist(), *[-1] * len(sample)], pa.int32()),
                "part": pa.array([part] * (len(full) + len(sample)), pa.int32()),
                "cores": pa.array([*(distinct[i].astype("<u8").tobytes() for i in picks), *sample], pa.binary()),
                "many": pa.array([*(np.packbits(counts[i] > 1).tobytes() for i in picks), *[b""] * len(sample)], pa.binary()),
            }
        )

    def count_cores(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        blobs = table.column("cores").to_pylist()
        cores = np.frombuffer(b"".join(blobs), "<u8")
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(b) // 8) for m, b in zip(table.column("many").to_pylist(), blobs)]).astype(bool)
        _, place, counts = np.unique(cores, return_inverse=True, return_counts=True)
        again = (counts > 1)[place] | many
        ends = np.cumsum([len(b) // 8 for b in blobs])
        kept = [cores[a:b][again[a:b]].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
        return pa.table({"part": table.column("part"), "again": pa.array(kept, pa.binary())}).filter(pa.array([bool(k) for k in kept]))

    def send_runs(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = {"range": pa.int32(), "part": pa.int32(), "run": pa.binary()}
        if not table.num_rows or not answers.num_rows:
            return pa.table({k: pa.array([], t) for k, t in schema.items()})
        _, texts = in_order(table)
        buffer = b"".join(texts)
        wanted = np.frombuffer(b"".join(answers.column("again").to_pylist()), "<u8")
        contexts = _contexts(buffer, named(buffer, [len(t) for t in texts]), wanted)
        by_range: dict[int, list[tuple[bytes, bytes, int]]] = {}
        for context in sorted(contexts):
            by_range.setdefault(bisect_right(splitters.value, context[0][:CORE]), []).append(context)
        part = table.column("part")[0].as_py()
        out: dict[str, list] = {k: [] for k in schema}
        for number, order in by_range.items():
            shared, rest, tails = front_coded([c[0] for c in order])
            places = [contexts[c] for c in order]
            fields = [
                shared,
                rest,
                np.array([len(c[1]) for c in order], "<u2"),
                np.array([c[2] for c in order], "<u2"),
                np.array([len(m) for m in places], "<u4"),
                np.array([m[0] for m in places], "<u4"),
            ]
            head = np.array([len(order), len(tails)], "<u4")
            run = b"".join([head.tobytes(), *(f.tobytes() for f in fields), tails, *(c[1] for c in order)])
            for k, v in zip(out, (number, part, run)):
                out[k].append(v)
        return pa.table({k: pa.array(out[k], t) for k, t in schema.items()})

    def merge_runs(table: pa.Table) -> pa.Table:
        """Answers (first start of a context in its part, start and end of a range to remove, from the context's start) as numbers."""
        table = table.combine_chunks().sort_by("part")
        part_of = table.column("part").to_pylist()
        runs, lefts, lows, counts, firsts = [], [], [], [], []
        for blob in table.column("run").to_pylist():
            n, tail_bytes = np.frombuffer(blob, "<u4", 2).tolist()
            at = 8
            fields = []
            for kind in ("<u2", "<u2", "<u2", "<u2", "<u4", "<u4"):
                fields.append(np.frombuffer(blob, kind, n, at))
                at += fields[-1].nbytes
            shared, rest, left, low, count, first = fields
            runs.append((decoded(shared, rest, blob[at : at + tail_bytes]), shared.tolist()))
            at += tail_bytes
            ends = at + np.cumsum(left, dtype=np.int64)
            lefts.append([blob[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist())])
            for into, values in ((lows, low), (counts, count), (firsts, first)):
                into.append(values.tolist())
        order, lengths = merged(runs)
        at = [0] * len(runs)
        group, groups, size = -1, [], []
        items = []
        for run, k in zip(order, lengths):
            if k < CORE:
                group += 1
                size.append(0)
            i = at[run]
            at[run] += 1
            items.append((run, i))
            groups.append(group)
            size[group] += counts[run][i]
        pick = [j for j, g in enumerate(groups) if size[g] > 1]
        items = [items[j] for j in pick]
        spans: dict[int, list[tuple[int, int, int]]] = {}
        # A range's groups are settled a few hundred thousand windows at a time, whole groups together.
        at = 0
        while at < len(items):
            end, windows = at, 0
            while end < len(items) and (windows < 400_000 or groups[pick[end]] == groups[pick[end - 1]]):
                run, i = items[end]
                windows += len(lefts[run][i]) - lows[run][i] + 1
                end += 1
            some = items[at:end]
            texts = [lefts[r][i] + runs[r][0][i] for r, i in some]
            marks = np.array([len(lefts[r][i]) for r, i in some], np.int64)
            low = np.array([lows[r][i] for r, i in some], np.int64)
            many = np.array([counts[r][i] > 1 for r, i in some])
            for (r, i), ranges in zip(some, _settle(texts, marks, low, marks, many, np.array([groups[j] for j in pick[at:end]], np.int64))):
                spans.setdefault(part_of[r], []).extend((firsts[r][i], a, b) for a, b in ranges)
            at = end
        spans = {part: v for part, v in spans.items() if v}
        return pa.table({"part": pa.array(list(spans), pa.int32()), "ranges": pa.array([np.array(v, "<u4").tobytes() for v in spans.values()], pa.binary())})

    def to_remove(buffer: bytes, names: tuple[np.ndarray, ...], answers: np.ndarray) -> np.ndarray:
        """(start, end) in the part: the answered ranges at all places of their contexts."""
        by_first: dict[int, list[tuple[int, int]]] = {}
        for first, a, b in answers.tolist():
            by_first.setdefault(first, []).append((a, b))
        wanted = np.unique(names[3][np.isin(names[1], answers[:, 0])])
        found = [(s + a, s + b) for starts in _contexts(buffer, names, wanted).values() for a, b in by_first.get(starts[0], ()) for s in starts]
        return np.array(found, np.int64).reshape(-1, 2)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "spans": pa.array([], _SPANS), "kept": pa.array([], pa.binary())})
        ids, texts = in_order(table)
        answered = np.frombuffer(b"".join(answers.column("ranges").to_pylist()), "<u4").reshape(-1, 3).astype(np.int64)
        buffer = b"".join(texts)
        ranges = to_remove(buffer, named(buffer, [len(t) for t in texts]), answered) if len(answered) else np.zeros((0, 2), np.int64)
        change = np.zeros(len(buffer) + 1, np.int32)
        np.add.at(change, ranges[:, 0], 1)
        np.add.at(change, ranges[:, 1], -1)
        covered = np.cumsum(change[:-1], dtype=np.int32) > 0
        counts, removed, spans, kept, at = [], [], [], [], 0
        for t in texts:
            off = covered[at : at + len(t)]
            at += len(t)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]))).tolist() if off.any() else []
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
            kept.append(b"".join([t[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(t)])]))
            counts.append(len(t))
            removed.append(int(off.sum()))
        return pa.table({"doc_id": ids, "n_bytes": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary())})

    cores = written(rows.groupBy("part").applyInArrow(send_cores, "bucket int, part int, cores binary, many binary"), "suffix-cores")
    sample = sorted(bytes(r["cores"]) for r in cores.where("bucket < 0").select("cores").collect())  # about SAMPLES a range
    step = max(1, len(sample) // ranges_wanted)
    splitters = docs.sparkSession.sparkContext.broadcast(sorted(set(sample[step::step])))
    again = cores.where("bucket >= 0").groupBy("bucket").applyInArrow(count_cores, "part int, again binary")
    runs = rows.groupBy("part").cogroup(again.groupBy("part")).applyInArrow(send_runs, "range int, part int, run binary")
    ranges = runs.groupBy("range").applyInArrow(merge_runs, "part int, ranges binary")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return rows.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(remove, schema)
