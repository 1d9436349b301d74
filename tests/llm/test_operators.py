"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sketchwright.llm import bpe, exact_dedup, fingerprint, license_scan, mixing, pii, simhash, substring_dedup, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use themselves.
EXTRA = SCHEMA + ", part int, size int, key string, digest string, fp long, __key string, __digest string, __score double, __text string, score double, normal string"
MORE = (1, 2, "k", "d", 3, "a", "b", 0.5, "c", 0.25, "n")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def words(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, block = words(60), words(45)
    out = [None, "", "   \t\n ", "a", "word", "Word  word", passage, words(30) + " " + passage + " " + words(20), words(5) + "\t\n" + passage]
    out += [block + " " + block, "x " * 500, "ab" * 900, "é" * 300 + passage + "日本語" * 90, words(3000), passage.upper(), words(19), words(20)]
    near = words(400).split()
    for k in range(6):
        near[k * 7] = f"edit{k}"
        out.append(" ".join(near))
    out += [words(rng.randint(1, 120)) for _ in range(40)]
    return out + [out[7], out[13], out[20]]


@pytest.fixture(scope="module")
def rows():
    found = [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts())]
    found[5] = (None, "null id " * 12, None, None, None)
    return [*found, found[7], found[7]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *MORE) for r in rows], EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))


def test_substring_dedup(docs, rows, none):
    seen, expected = set(), Counter()
    for r in in_order(rows):
        w = split(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected[r[0], len(w), sum(gone), kept] += 1
    found = substring_dedup.removal(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == expected
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in found)
    assert substring_dedup.removal(none).count() == 0


def test_substring_dedup_across_parts_and_pieces(docs, rows, monkeypatch):
    from sketchwright.llm import parts

    whole = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.removal(docs).collect())
    monkeypatch.setattr(parts, "PART_UNITS", 5)
    monkeypatch.setattr(substring_dedup, "AT_ONCE", 64)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.removal(docs).collect()) == whole


def test_substring_dedup_tells_colliding_windows_apart(docs, monkeypatch):
    import numpy as np

    from sketchwright.llm import parts

    whole = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.removal(docs).collect())
    monkeypatch.setattr(parts, "PART_UNITS", 5)
    real = substring_dedup.windows

    def weak(texts, window, count):
        hashes, starts, bounds = real(texts, window, 2)
        return [hashes[0] >> np.uint64(50) << np.uint64(50), hashes[1]][:count], starts, bounds

    monkeypatch.setattr(substring_dedup, "windows", weak)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.removal(docs).collect()) == whole


@pytest.mark.parametrize("part_rows", [1000, 5])
def test_suffix_dedup(docs, rows, none, monkeypatch, part_rows):
    from sketchwright.llm import parts

    monkeypatch.setattr(parts, "PART_UNITS", part_rows)
    if part_rows == 5:
        monkeypatch.setattr(suffix_dedup, "AT_ONCE", 700)  # long texts are hashed in overlapping pieces
    where = defaultdict(list)
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for d, (_, t) in enumerate(data):
        for i in range(len(t) - 199):
            where[t[i : i + 200]].append((d, i))
    cover = [bytearray(len(t)) for _, t in data]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i : i + 200] = b"\1" * 200
    expected = Counter((doc, len(t), sum(c), bytes(x for x, g in zip(t, c) if not g)) for (doc, t), c in zip(data, cover))
    found = suffix_dedup.removal(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in found) == expected
    if part_rows == 5:
        assert suffix_dedup.removal(none).count() == 0


def test_suffix_windows_are_told_apart_by_bytes():
    import numpy as np

    rng = random.Random(2)
    windows = [bytes(rng.choice(b"ab") for _ in range(200)) for _ in range(5)]
    data = b"".join(windows[k] for k in (0, 1, 0, 2, 3, 1, 4, 0))
    start = np.arange(0, len(data), 200)
    for key in (np.zeros(8, np.uint64), np.array([0, 1, 0, 1, 1, 1, 0, 0], np.uint64)):  # keys that collide
        found = suffix_dedup._repeated(np.frombuffer(data, np.uint8), start, key)
        assert found.tolist() == [True, True, True, False, False, True, False, True]


def test_suffix_merge_is_a_sorted_merge():
    rng = random.Random(3)
    runs = []
    for _ in range(7):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 40)))
        shared, rest, tails = suffix_dedup.front_coded(strings)
        assert suffix_dedup.decoded(shared, rest, tails) == strings
        runs.append((strings, shared.tolist()))
    order, lengths = suffix_dedup.merged(runs)
    at, out = [0] * len(runs), []
    for r in order:
        out.append(runs[r][0][at[r]])
        at[r] += 1
    assert out == sorted(s for strings, _ in runs for s in strings)
    assert lengths[1:] == [suffix_dedup.common(a, b) for a, b in zip(out, out[1:])]


def test_mixing(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    found = mixing.plan(docs, labels).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len(split(r[1]))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1, 5]))
    level, open_ = None, set(order)
    total = 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        open_ -= full
    target = {s: level * weight[s] if s in open_ else 2 * sizes[s] for s in order}
    largest = max(len(split(r[1])) for r in rows)
    for s in order:
        mine = [r for r in found if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= largest / 2
    assert all(r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0) for r in found)
    assert sorted(map(str, mixing.plan(docs.repartition(7), labels).collect())) == sorted(map(str, found))
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_bpe(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    found = bpe.tokens(docs, path).collect()
    expected = Counter()
    for r in rows:
        ids = reference.encode(r[1] or "", add_special_tokens=False).ids
        expected[r[0], tuple(ids), sha(reference.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in found) == expected
    assert bpe.tokens(none, path).count() == 0


def test_bpe_on_odd_strings():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference, codec = Tokenizer.from_file(path), bpe.Codec(bpe.vocabulary(path))
    rng = random.Random(9)
    odd = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x\x1c\x85  y", "aaaa" * 100, "----====", " \n \t", "it's WE'LL 've", "é‍😀", "00000000 1234567"]
    odd += ["".join(rng.choice("ab \n'stéñ日0.-") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in odd:
        ids = reference.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_bpe_transducer_over_many_states(monkeypatch):
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference, codec = Tokenizer.from_file(path), bpe.Codec(bpe.vocabulary(path))
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    began = time.time()
    found = codec.encode(long)
    assert time.time() - began < 5 and found == reference.encode(long, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "KEPT_STATES", 50)  # the table starts anew in the middle of words
    assert bpe.Codec(bpe.vocabulary(path)).encode(long[:3000]) == reference.encode(long[:3000], add_special_tokens=False).ids


def test_bpe_words_and_states_are_bounded_and_can_be_dropped(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference, codec = Tokenizer.from_file(path), bpe.Codec(bpe.vocabulary(path))
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    rng = random.Random(4)
    for _ in range(3):
        text = " ".join(rng.choice(["the", "of", "".join(rng.choice("abcdé0") for _ in range(6))]) for _ in range(300))
        assert codec.encode(text) == reference.encode(text, add_special_tokens=False).ids
        assert len(codec.known) + len(codec.known.aside) <= 10
        codec.forget()
        states = codec.known.transducer
        assert not codec.known and not codec.known.aside and not states.table and len(states.pieces) == len(states.number) == 1


def test_toxicity_learns_the_same_from_small_buffers(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(["you idiot" if i % 4 == 0 else "fine", *("".join(rng.choice("abcd") for _ in range(4)) for _ in range(20))])) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 50)
    parts = toxicity.train(docs, labels)
    assert whole.patterns and (parts.patterns, parts.weights) == (whole.patterns, whole.weights)


def test_toxicity(spark, none):
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for k in (3, 17, 30):
                words[k] = rng.choice(["zorkling", "zorklers", "blegh"])
        rows.append((i, " ".join(words) + ".", None, None, None))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "zorkling blegh", None, None, None), (1003, "w " * 5000 + "blegh. zorklers", None, None, None)]
    labels += [(None, 1, 1), (5, None, None)]
    docs = spark.createDataFrame([(*r, *MORE) for r in rows], EXTRA)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, table).collect()}
    assert len(found) == len(rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items() if i is not None)
    held = [(found[i].predicted, y) for i, _, y in labels[:400] if found[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert found[1000].predicted == found[1001].predicted == 0 and found[1003].predicted == 1
    kept = toxicity.keep_clean(docs, table)
    assert kept.columns == docs.columns and 280 <= kept.count() <= 320
    assert toxicity.toxicity(none, table).count() == 0
    assert toxicity.toxicity(docs, table.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_reads_clauses():
    lexicon = toxicity.Lexicon({"moron": 4.0})
    plain = toxicity.clause_scores("he moron.", lexicon)
    assert plain[0] > toxicity.clause_scores("a moron.", lexicon)[0]
    assert toxicity.clause_scores("moron he.", lexicon) == plain  # the target may follow
    assert toxicity.clause_scores("a not moron.", lexicon)[0] < toxicity.clause_scores("a moron.", lexicon)[0]
    assert toxicity.clause_scores("text said moron.", lexicon)[0] < toxicity.clause_scores("text with moron.", lexicon)[0]
    assert toxicity.clause_scores("kill you.", lexicon) and not toxicity.clause_scores("kill it.", lexicon)
    assert toxicity.clause_scores("no match here.", lexicon) == []


def test_toxicity_grammar_is_its_parts_one_after_the_other():
    def paths(machine, read):
        """All paths: the classes written, the factors, the final factor."""
        found = [([], [], 0)]
        for kind in read:
            found = [([*out, wrote], [*factors, f], to) for out, factors, state in found for wrote, f, to in machine.arcs.get((state, kind), ())]
        return [(out, factors, machine.final[s]) for out, factors, s in found if s in machine.final]

    def brute(read, weights):
        chains = [(read, [1.0] * len(read), 1.0)]
        for machine in toxicity.parts():
            chains = [(out, [x * y for x, y in zip(before, factors)], last * final) for wrote, before, last in chains for out, factors, final in paths(machine, wrote)]
        return max((last * sum(w * f for w, f in zip(weights, factors)) for _, factors, last in chains), default=0.0)

    rng = random.Random(8)
    for _ in range(3000):
        read = [rng.choice(list(toxicity.CLASSES)[:6]) for _ in range(rng.randint(0, 8))]
        weights = [rng.random() for _ in read]
        assert toxicity.GRAMMAR.best(list(zip(read, weights))) == pytest.approx(brute(read, weights))


def test_fingerprints(docs, rows, none):
    found = fingerprint.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    edited = Counter()
    pairs = []
    for r, s in zip(order, [*order[1:], order[0]]):
        t, nxt = r[1] or "", s[1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        edited[r[0], len(t), sha(e)] += 1
        pairs.append((r[0], Counter(split(t)), Counter(split(e)), Counter(split(nxt))))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == edited

    def jaccard(a, b):
        keys = a.keys() | b.keys()
        return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0

    by_id = defaultdict(list)
    for d, a, b, c in pairs:
        by_id[d].append((jaccard(a, b), jaccard(a, c)))
    single = [r for r in found if len(by_id[r.doc_id]) == 1]
    gaps = [r.near_edited - by_id[r.doc_id][0][0] for r in single]
    assert abs(sum(gaps) / len(gaps)) < 0.06 and max(map(abs, gaps)) < 0.45
    assert all(r.near_next == 1.0 for r in single if by_id[r.doc_id][0][1] == 1.0)
    prints = defaultdict(set)
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in found:
        prints[tuple(sorted(split(text_of[r.doc_id])))].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprint.fingerprints(none).count() == 0


def test_fingerprints_follow_the_samples(spark):
    """Each sample drawn again in plain Python: likeness is the share of samples that chose the same word and quantised weight."""
    mask = (1 << 64) - 1

    def hashed(n, seed=42, size=8):
        return xxhash.xxh64_intdigest((n & (1 << 8 * size) - 1).to_bytes(size, "little"), seed)

    def gamma(bits):
        return -math.log((((bits >> 32) + 0.5) / 2**32) * (((bits & 0xFFFFFFFF) + 0.5) / 2**32))

    def drawn(text):
        counts, out = Counter(split(text)), []
        for number in range(fingerprint.SAMPLES):
            found = []
            for w, n in counts.items():
                term = xxhash.xxh64_intdigest(w.encode(), 42) << 1 & mask
                term = (term if term < 1 << 63 else term - (1 << 64)) >> 1
                first = hashed(number, hashed(term), 4)
                second = hashed(first)
                r, beta = gamma(first), (hashed(second) >> 11) / 2**53
                t = math.floor(math.log(n) / r + beta)
                found.append((math.log(gamma(second)) - r * (t - beta) - r, w, t))
            out.append(min(found)[1:])
        return out

    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefghijkl", k=rng.randint(30, 60))) for _ in range(12)]
    found = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        following = texts[i - 1]
        k = len(t) // 3
        own, edited, after = drawn(t), drawn(t[: len(t) - k] + following[:k]), drawn(following)
        assert found[i].near_edited == sum(a == b for a, b in zip(own, edited)) / fingerprint.SAMPLES
        assert found[i].near_next == sum(a == b for a, b in zip(own, after)) / fingerprint.SAMPLES
        assert len(found[i].fingerprint) == 8 * fingerprint.SAMPLES and found[i].fingerprint != found[i].edited_fingerprint


def test_fingerprints_do_not_hang_on_the_limit(docs, monkeypatch):
    """Low limits leave texts unsettled, which are sampled in full: the results are those without a bound."""
    whole = Counter(fingerprint.fingerprints(docs).collect())
    for limit in (0.5, 4.0):
        monkeypatch.setattr(fingerprint, "LIMIT", limit)
        assert Counter(fingerprint.fingerprints(docs).collect()) == whole
    rows = fingerprint.in_order(docs).select("part", "place", "text", F.col("next_text").alias("other"))
    bounded = fingerprint.signatures(rows, ["part", "place"], "text", "other", 4.0)
    assert 0 < bounded.where("settled").count() < rows.count()
    full = fingerprint.signatures(rows, ["part", "place"], "text", "other", None)
    assert bounded.where("settled").exceptAll(full).isEmpty()


def test_fingerprints_in_many_ranges(docs, monkeypatch):
    whole = Counter((r.doc_id, r.edited_sha256, r.fingerprint, r.near_next) for r in fingerprint.fingerprints(docs).collect())
    monkeypatch.setattr(fingerprint, "RANGE_UNITS", 4)
    assert Counter((r.doc_id, r.edited_sha256, r.fingerprint, r.near_next) for r in fingerprint.fingerprints(docs).collect()) == whole


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    expected = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), i == keep, sha(t)] += 1
    found = exact_dedup.groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == expected
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    # With digests that many texts share, whole texts tell them apart.
    weak = {"digest": lambda normal: F.substring(normal, 1, 2)}
    found = exact_dedup.groups(docs, **weak).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == expected
    assert sorted(map(str, exact_dedup.keep_first(docs, **weak).collect())) == sorted(map(str, kept.collect()))
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.keep_first(none).count() == 0


def test_pii(docs, rows, none):
    sample = "mail a.b@x.example.com, 10.0.0.1 999.1.1.1 4111 1111 1111 1111 +1 (555) 555-0199 x@y 1.2.3.4.5 @@ a@b.c@d.e"
    kinds = defaultdict(list)
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
    ):
        kinds[kind] = (re.compile(pattern), ok)

    def brute(t):
        return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in p.finditer(t) if ok(m[0])]

    rng = random.Random(2)
    for t in [sample, *("".join(rng.choice("a.@1 2-+()9%") for _ in range(60)) for _ in range(3000))]:
        assert pii.base_spans(t) == brute(t), t
    found = pii.spans(docs)
    assert Counter((r.doc_id, r.base) for r in found.collect()) == Counter((r[0], ",".join(f"{k}:{a}:{b}" for k, a, b in brute(r[1] or ""))) for r in rows)
    assert pii.spans(none).count() == 0


def planted(rng):
    """Texts with entities and look-alikes, written down apart from the operator's own examples: (text, set of (kind, string))."""

    def n(k):
        return str(rng.randint(10 ** (k - 1), 10**k - 1))

    def card(k, first):
        head = first + "".join(rng.choice("0123456789") for _ in range(k - 1 - len(first)))
        return next(head + c for c in "0123456789" if pii.luhn(head + c))

    who, site = rng.choice(["maria", "j.smith", "otto_k", "info", "sales22", "li.wei"]), rng.choice(["acme", "uni-bonn", "post", "web-shop"])
    amex, visa = card(15, "37"), card(16, "4")
    phones = [f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)} {n(7)}", f"1-{n(3)}-{n(3)}-{n(4)}", f"00{n(2)} {n(3)} {n(7)}"]
    cards = [amex, f"{amex[:4]} {amex[4:10]} {amex[10:]}", ".".join(visa[i : i + 4] for i in range(0, 16, 4))]
    octets = [str(rng.randint(1, 255)) for _ in range(4)]
    addresses = ["[.]".join(octets), " . ".join(octets), f"2001:db8:{rng.randint(1, 9)}a::{rng.randint(1, 9)}f", f"fe80::{rng.randint(1, 9)}c0:{n(2)}:1"]
    mails = [f"{who} at {site} dot org", f"{who}[at]{site}[dot]com", f"{who} (at) {site} (dot) de", f"{who}@{site} dot net"]
    for kind, strings, frames in (
        ("phone", phones, ["Please ring {} before noon.", "My number is {}", "Kontakt: {}, danke.", "({}) is open all day"]),
        ("card", cards, ["She paid with {} yesterday.", "visa {}", "Karte: {}."]),
        ("ip", addresses, ["The host {} went down.", "connect to {}", "seen from {} at night"]),
        ("email", mails, ["Write to {} soon.", "contact: {}", "ask {} or wait"]),
    ):
        string = rng.choice(strings)
        yield rng.choice(frames[:3]).format(string), {(kind, string)}
    for text in rng.sample(
        [f"In {n(4)} there were 3 of 17, then {n(2)}.{n(1)} in all.", f"On 2019-0{n(1)}-2{rng.randint(0, 9)} we met at noon. Es war gut", f"price {rng.randint(1, 9)} 000 000 000 euro", "1 2 3 4 5 6 7 8 9 10", f"ISBN 978-3-{n(4)}-{n(4)}-{n(1)}"]
        + [f"IBAN DE{n(2)} {n(4)} {n(4)} {n(4)} {n(4)} {n(2)}", f"SSN {n(3)}-{n(2)}-{n(4)}", f"version {n(1)}.{n(2)}.{n(1)} of the tool", f"at {n(1)}2:30:45 the clock", "mac 00:1a:2b:3c:4d:5e", f"order {n(9)} shipped", "th at thhablewh. Es ing", "we looked at them. Then", f"{n(3)} {n(3)} people", f"pages {n(3)}-{n(3)}"],
        4,
    ):
        yield text, set()


def test_pii_field_on_planted_texts():
    model, rng = pii.SemiMarkov(pii.trained()), random.Random(77)
    right, missed, wrong = Counter(), Counter(), Counter()
    for _ in range(150):
        for text, wanted in planted(rng):
            got = {(k, text[a:b]) for k, a, b in pii.added_spans(text, model, pii.base_spans(text))}
            for found, into in ((got & wanted, right), (wanted - got, missed), (got - wanted, wrong)):
                into.update(k for k, _ in found)
    for kind in pii.KINDS:
        recall, precision = right[kind] / (right[kind] + missed[kind]), right[kind] / max(1, right[kind] + wrong[kind])
        assert recall >= 0.9 and precision >= 0.9, (kind, recall, precision)


def test_pii_decodes_the_best_segmentation():
    """Against all segmentations of short pieces."""
    model = pii.SemiMarkov(pii.trained())

    def brute(piece, at):
        if at == 0:
            return 0.0
        found = [brute(piece, at - 1)]
        return max(found + [brute(piece, i) + model.score(f) for _, i, f in piece.candidates(at)])

    for text in ("555-123-4567 555-123-4568", "(212) 555-0100 4111.1111.1111.1111", "anna at b dot org 12 34 56 78"):
        for x, y in pii.regions(text):
            piece = pii.Piece(text, x, y)
            spans = [(k, i, j, f) for j in range(1, piece.size + 1) for k, i, f in piece.candidates(j)]
            place = {o: n for n, o in enumerate(piece.offsets)}
            best = sum(next(model.score(f) for k, i, j, f in spans if (k, i, j) == (kind, place[a], place[b])) for kind, a, b in model.decode(piece))
            assert best == pytest.approx(brute(piece, piece.size))


def test_pii_long_regions_are_decoded_whole():
    numbers = [f"555-123-{4000 + k}" for k in range(300)]
    t = "call " + " ".join(numbers)
    found = pii.added_spans(t, pii.SemiMarkov(pii.trained()), pii.base_spans(t))
    assert [(k, t[a:b]) for k, a, b in found] == [("phone", x) for x in numbers]


@pytest.mark.parametrize("unit", ["aB3+/x", "7", "a.", "1 ", "@", "at ", "(", "a@", "1:", "+1-", "x dot "])
def test_pii_is_linear(unit):
    import time

    model = pii.SemiMarkov(pii.trained())

    def seconds(n):
        t = (unit * n)[:n]
        began = time.process_time()
        pii.added_spans(t, model, pii.base_spans(t))
        return time.process_time() - began

    seconds(1000)
    assert seconds(400_000) <= 40 * max(seconds(20_000), 0.02)  # 20 times the text


def test_simhash(docs, rows, none):
    import xxhash

    def brute(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = split(low)
        if not w:
            return 0
        parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    found = simhash.near_groups(docs).collect()
    prints = {r[1]: brute(r[1]) for r in rows}
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[rows[i][1]] ^ prints[rows[j][1]]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    expected = Counter((r[0], prints[r[1]], min((x for x in least[root(i)] if x is not None), default=None)) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == expected
    assert simhash.keep_first(docs).count() == len(least)
    assert simhash.near_groups(none).count() == 0


def test_simhash_writes_files_as_its_rows_need(spark, docs):
    from pathlib import Path

    from sketchwright.llm.common import shared_dir

    def files():
        return len(list(Path(shared_dir(spark)).rglob("*.parquet")))

    expected = sorted(simhash.near_groups(docs).collect(), key=repr)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        first = files()
        found = simhash.near_groups(docs)
        assert sorted(found.collect(), key=repr) == expected and found.rdd.getNumPartitions() == 1
        assert files() - first <= 20  # a run with many partitions for few rows
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_simhash_keeps_each_component_of_shared_ids(spark):
    rng = random.Random(9)
    one, two, three, four, other = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)) for _ in range(5))
    near = one + " more"
    assert (simhash.fingerprint(one) ^ simhash.fingerprint(near)).bit_count() <= 4
    table = [(None, two), (None, two), (None, three), (3, one), (5, near), (5, four), (5, other), (5, other)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_first(docs).collect())
    assert kept == Counter([(None, two), (None, three), (3, one), (5, four), (5, other)])


def test_simhash_links_with_chunks(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(60)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")

    def groups(edges):
        parent = {f: f for f in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in edges:
            parent[root(u)] = root(v)
        return {frozenset(f for f in signed if root(f) == r) for r in {root(f) for f in signed}}

    brute = groups((a, b) for a in signed for b in signed if ((a ^ b) % 2**64).bit_count() <= 4)
    assert groups((r.u, r.v) for r in simhash.links(simhash.compared(nodes)).collect()) == brute
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert groups((r.u, r.v) for r in simhash.links(simhash.compared(nodes)).collect()) == brute


def test_simhash_pivot_table(spark, monkeypatch):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) - 2**63 for _ in range(50)]
    rows = simhash.pivot_table(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    for r in rows:
        near = [x >> 8 * j & 255 for x in r[1:] for j in range(8)]
        assert near == [((r.fp ^ p) % 2**64).bit_count() for p in simhash.pivots()]
    # All blocks alike in one group of unrelated fingerprints: the table leaves next to nothing to verify.
    monkeypatch.setattr(simhash, "_tables", lambda fp: [F.lit(1).cast("long")])
    nodes = spark.createDataFrame([(rng.getrandbits(64) - 2**63,) for _ in range(3000)], "fp long")
    counts = simhash.report(simhash.compared(nodes)).collect()[0]
    assert counts.seen > 10**6 and counts.verified < 100 and counts.seen == counts.discarded + counts.verified


def test_license_scan(spark, docs, rows, none):
    more = [
        (9001, "Released under the MIT License. Released under the MIT license", None, None, None),
        (9002, "Licensed under the Apache License, Version 2.0! (CC-BY-NC) cc by nc cc by nc", None, None, None),
        (9003, "w " * 400 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", None, None, None),
        (9004, "This work is licensed under the GNU General Public License, version 3.", None, None, None),
        (9005, "the license is not a license of this work and under the sun", None, None, None),
        (9006, "éMIT under the mit licenseé", None, None, None),
        (9007, "Released under the ISC license. Licensed under CC BY 4.0, or the Mozilla Public License version 2.0", None, None, None),
        *((9010 + i, "x y " * (37 * i) + t.upper() + " z" * 50, None, None, None) for i, (_, t) in enumerate(license_scan.TEMPLATES)),
    ]
    table = spark.createDataFrame([(*r, *MORE) for r in more], EXTRA).unionByName(docs)
    every = [*more, *rows]

    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places, names = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            names |= {label} if at else set()
        best, found, where = 0.0, set(names), []
        for label, template in license_scan.TEMPLATES:
            s, step = set(template.split()), 32
            while step < len(template.split()):
                step *= 2
            for at in range(0, max(1, len(w)), step):
                common = len(s & set(w[at : at + 2 * step]))
                if common >= (len(s) if len(s) <= 10 else 0.8 * len(s) - 1e-9):
                    found.add(label)
                    best = max(best, common / len(s))
                    where.append((label, at, common / len(s)))
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(found)), 1.0 if places else best, tuple(sorted(where))

    expected = Counter((r[0], *brute(r[1])) for r in every)
    found = license_scan.scan(table).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, tuple(sorted(map(tuple, r.blocks)))) for r in found) == expected
    by_id = {r.doc_id: r for r in found}
    assert all(label in by_id[9010 + i].labels.split(",") for i, (label, _) in enumerate(license_scan.TEMPLATES)) and by_id[9007].labels == ""
    assert license_scan.scan(none).count() == 0
