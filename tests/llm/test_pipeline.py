"""The pipeline against a plain version of its stages, and the thin queries' columns, on a small folder of tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sketchwright.llm import queries, simhash, toxicity

COLUMNS = {
    "op1_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op2_mixing": "doc_id size source_size target taken",
    "op3_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans n_spans",
    "op9_simhash": "doc_id fingerprint component_id",
    "op10_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        if i % 5 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zorkling", "blegh"])
        text = " ".join(words)
        rows.append([i, text, "en", f"s{i % 4}" if i % 9 else None, len(text)])
        labels.append((i, i % 2, int(i % 5 == 0)))
    for k, i in enumerate((3, 7, 11, 3)):
        rows.append([200 + k, rows[i][1].replace(" ", "  "), "en", "s1", 1])
    long_text = " ".join(rng.choice(vocabulary) for _ in range(900))
    rows += [[300, long_text, "en", "s2", 1], [301, long_text + " tail", "en", "s0", 1], [302, None, None, None, None], [303, "", "en", "s3", 0]]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, labels


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_pipeline(spark, folder):
    at, rows, labels = folder
    model = toxicity.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    lexicon = toxicity.Lexicon(model.patterns)
    rows = [r for r in rows if model.score(toxicity.features(r[1] or "", lexicon)) < 0.5]
    first = {}
    for r in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    rows = sorted(first.values())
    prints = {r[0]: simhash.fingerprint(r[1]) for r in rows}
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = [r for r in rows if find(r[0]) == r[0]]
    size = {r[0]: len(split(r[1])) for r in rows}
    sources = defaultdict(int)
    for r in rows:
        sources[r[3]] += size[r[0]]
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1] * 4))
    open_ = set(order)
    while True:
        level = (1.5 * sum(sources.values()) - sum(2 * sources[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sources[s]}
        if not full:
            break
        open_ -= full
    quality = {i: 2.0 if q == 1 else 0.5 for i, q, _ in labels}
    out = Counter()
    for s in order:
        target = level * weight[s] if s in open_ else 2 * sources[s]
        epochs = int(target // sources[s])
        budget, upto = target - epochs * sources[s], 0

        def key(r):
            u = (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / quality.get(r[0], 1.0)

        for r in sorted((r for r in rows if r[3] == s), key=key):
            upto += size[r[0]]
            times = epochs + (upto - size[r[0]] / 2 <= budget)
            if size[r[0]]:
                out[r[0]] += times
    return {r[0]: r[1] for r in rows}, +out


def test_pipeline_is_its_plain_version(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts, taken = plain_pipeline(spark, folder)
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = corpus_pipeline.run(spark, folder[0]).collect()
    assert Counter(r.doc_id for r in found) == taken and len(taken) > 50
    for r in found[::7]:
        assert list(r.ids) == reference.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder[0])
        assert kept.columns == docs.columns
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_return_a_row_per_document(spark, folder, name):
    found = entry.queries()[name](spark, folder[0])
    assert found.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = found.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in folder[1])
    if name == "op5_toxicity":
        labels = {i: y for i, _, y in folder[2]}
        held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_sql_is_given_for_registered_queries_only():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and "pipeline" in entry.queries()
