"""Toxicity by a weighted finite-state pattern grammar over clauses, its weights learned from labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, plain_text, written

#: At most so many labelled rows are used to learn: those of the smallest hashes.
TRAIN_ROWS = 20_000
#: Words that a lexicon keeps, and patterns counted before they are handed on.
KEPT_WORDS = 100_000
#: Lengths of the prefixes that insult patterns may be, besides whole words.
PREFIXES = range(4, 10)

# Small closed word classes of the grammar (English, German, French, Spanish).
TARGETS = "you your yours yourself u he she they them him her his their du dich dir dein deine ihr euch er sie tu toi te ton ta vous votre il elle ils tú ti usted ustedes él ella ellos".split()
NEGATIONS = "not no never neither nor nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say saying told tells claimed claims wrote writes quoted quotes sagte sagt schrieb dit disait écrit dijo dice escribió".split()
THREATS = "kill hurt beat destroy murder burn shoot stab töten tuer matar".split()
ENDS = ".!?;:\n"

#: Factors of the grammar's arcs.
AIMED, NEGATED, REPORTED = 1.25, 0.5, 0.75

#: The alphabet of the grammar's transducers: word classes, made by the lexicon. The target transducer turns THREAT to AIMED_THREAT.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED_THREAT = CLASSES = range(7)
END = -1
EVIDENCE = (INSULT, THREAT, AIMED_THREAT)

_tokens = re.compile(rf"[^\W\d_]+|[{re.escape(ENDS)}]").findall


@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer over word classes; state 0 is the start.

    arcs: (state, class read) to a list of (class written, factor, next state). A path through a clause scores
    the sum of its words' weights, each times the factor of the arc that read it, times the factor of the final
    state; a clause scores its best path.
    """

    arcs: dict[tuple[int, int], list[tuple[int, float, int]]]
    final: dict[int, float]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what self writes, other reads; factors multiply. States are those reachable."""
        number, arcs, final = {(0, 0): 0}, {}, {}
        open_ = [(0, 0)]
        while open_:
            p, q = pair = open_.pop()
            if p in self.final and q in other.final:
                final[number[pair]] = self.final[p] * other.final[q]
            for read in CLASSES:
                found = []
                for middle, f, p2 in self.arcs.get((p, read), ()):
                    for wrote, g, q2 in other.arcs.get((q, middle), ()):
                        if (p2, q2) not in number:
                            number[p2, q2] = len(number)
                            open_.append((p2, q2))
                        found.append((wrote, f * g, number[p2, q2]))
                if found:
                    arcs[number[pair], read] = found
        return Transducer(arcs, final)

    def best(self, read: list[tuple[int, float]]) -> float:
        """The score of a clause, given as (class, weight) of its words; 0 without a path."""
        alive, arcs = {0: 0.0}, self.arcs
        for kind, weight in read:
            following: dict[int, float] = {}
            for state, score in alive.items():
                for _, factor, to in arcs.get((state, kind), ()):
                    value = score + weight * factor
                    if value > following.get(to, -1.0):
                        following[to] = value
            alive = following
        return max((score * self.final[s] for s, score in alive.items() if s in self.final), default=0.0)


def target_transducer() -> Transducer:
    """Whether a clause is aimed at somebody, wherever in it the target stands: a path guesses at the start and must turn out right.

    States: 0 start, 1 no target, 2 target still to come, 3 target seen. In an aimed clause evidence weighs more, and threats are marked.
    """
    arcs: dict[tuple[int, int], list[tuple[int, float, int]]] = {}

    def aimed(kind: int) -> tuple[int, float]:
        return AIMED_THREAT if kind == THREAT else kind, AIMED if kind in EVIDENCE else 1.0

    for kind in CLASSES:
        for state in range(4):
            if kind == TARGET:
                to = [(kind, 1.0, 3)] if state != 1 else []
            else:
                to = [(kind, 1.0, 1)] if state < 2 else []
                to += [(*aimed(kind), 3 if state == 3 else 2)] if state != 1 else []
            arcs[state, kind] = to
    return Transducer(arcs, {0: 1.0, 1: 1.0, 3: 1.0})


def insult_transducer() -> Transducer:
    """Insults count; words of no class don't."""
    return Transducer({(0, k): [(k, 0.0 if k == OTHER else 1.0, 0)] for k in CLASSES}, {0: 1.0})


def threat_transducer() -> Transducer:
    """A threat counts when aimed."""
    return Transducer({(0, k): [(k, 0.0 if k == THREAT else 1.0, 0)] for k in CLASSES}, {0: 1.0})


def negation_transducer() -> Transducer:
    """Evidence weighs less within three words after a negation. The state is how many of them are still to come."""
    arcs = {(n, k): [(k, NEGATED if n and k in EVIDENCE else 1.0, 3 if k == NEGATION else max(0, n - 1))] for n in range(4) for k in CLASSES}
    return Transducer(arcs, dict.fromkeys(range(4), 1.0))


def report_transducer() -> Transducer:
    """Evidence weighs less after a verb of speech, up to the end of the clause."""
    arcs = {(n, k): [(k, REPORTED if n and k in EVIDENCE else 1.0, 1 if k == REPORT else n)] for n in range(2) for k in CLASSES}
    return Transducer(arcs, {0: 1.0, 1: 1.0})


def parts() -> list[Transducer]:
    return [target_transducer(), insult_transducer(), threat_transducer(), negation_transducer(), report_transducer()]


def grammar() -> Transducer:
    first, *others = parts()
    for other in others:
        first = first.then(other)
    return first


GRAMMAR = grammar()


class Lexicon(dict):
    """The word transducer: word -> (class, weight). Patterns are whole words or prefixes ending in '*'; the heaviest wins."""

    def __init__(self, patterns: dict[str, float]):
        super().__init__()
        self.patterns = patterns
        self.closed = {w: k for k, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(word) == 1 and word in ENDS:
            found = (END, 0.0)
        else:
            get = self.patterns.get
            weight = max([get(word, 0.0), *(get(word[:n] + "*", 0.0) for n in PREFIXES if n < len(word))])
            kind = self.closed.get(word, OTHER)
            found = (THREAT, max(1.0, weight)) if kind == THREAT else (kind, 0.0) if kind != OTHER else (INSULT, weight) if weight > 0 else (OTHER, 0.0)
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = found
        return found


def clause_scores(text: str, lexicon: Lexicon) -> list[float]:
    """The scores of the clauses that the grammar matches; a clause without a weighted word scores nothing and is not run."""
    read = list(map(lexicon.__getitem__, _tokens(text.lower())))
    if not any(w for _, w in read):
        return []
    scores, clause, weighted = [], [], False
    for kind, weight in [*read, (END, 0.0)]:
        if kind == END:
            score = GRAMMAR.best(clause) if weighted else 0.0
            if score > 0:
                scores.append(score)
            clause, weighted = [], False
        else:
            clause.append((kind, weight))
            weighted = weighted or weight > 0
    return scores


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The evidence of a text: sum and largest of its clause scores, damped, and the share of clauses that matched."""
    scores = clause_scores(text, lexicon)
    if not scores:
        return [0.0, 0.0, 0.0]
    clauses = 1 + sum(text.count(c) for c in ENDS)
    return [float(np.log1p(sum(scores))), max(scores) ** 0.5, float(np.log1p(100 * len(scores) / clauses))]


class Model:
    def __init__(self, patterns: dict[str, float], weights: list[float]):
        self.patterns, self.weights = patterns, weights

    def score(self, evidence: list[float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], evidence))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method with a small ridge."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return [float(np.clip(np.log((rate + 1e-3) / (1 - rate + 1e-3)), -7, 7)), *[0.0] * x.shape[1]]
    x = np.hstack([np.ones((len(y), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return [float(v) for v in w]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Learns from labelled rows whose crc32(id as text) mod 5 is not 0, at most TRAIN_ROWS of them.

    Pattern weights are log odds of documents with against without the label; the three features of a
    text are weighed by a logistic regression. Only the sample's ids, the patterns' counts with enough
    support and three numbers a sample row come to the driver; all are bounded by the sample. Of rows
    that repeat an id one stands for it (the one whose text sorts first); ids without a document teach nothing.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    sample = {r["doc_id"]: int(r["toxic"] > 0) for r in chosen.collect()}
    if not sample:
        return Model({}, [-7.0, 0.0, 0.0, 0.0])
    ids = spark.createDataFrame(list(sample.items()), "__id long, __toxic int")
    rows = docs.select(F.col(key).alias("__key"), plain_text(F.col(text)).alias("__text"))
    rows = rows.join(F.broadcast(ids), rows["__key"] == ids["__id"])  # at most TRAIN_ROWS rows
    rows = rows.groupBy("__key").agg(F.min("__text").alias("__text"), F.max("__toxic").alias("__toxic")).select("__text", "__toxic")
    rows = written(rows.coalesce(-(-len(sample) // 1000)), "toxicity-sample")  # a task for a thousand texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (seen[1], seen[0]))], ["pattern", "pos", "neg"])
            for c in seen:
                c.clear()
            return batch

        for b in batches:
            for t, y in zip(b.column(0), b.column(1)):
                words = set(_tokens(t.as_py().lower()))
                found = set(words)
                found.update(w[:n] + "*" for w in words for n in PREFIXES if n < len(w))
                seen[y.as_py()].update(found)
                seen[y.as_py()][""] += 1
                if len(seen[0]) + len(seen[1]) > KEPT_WORDS:
                    yield out()
        yield out()

    counted = rows.mapInArrow(count, "pattern string, pos long, neg long").groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    all_pos = sum(sample.values())
    support = max(3, -(-all_pos // 100))
    odds = (F.log((F.col("pos") + 0.5) / (all_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (len(sample) - all_pos + 1.0))).alias("odds")
    kept = counted.where((F.col("pattern") != "") & (F.col("pos") >= support)).select("pattern", odds).where("odds > 2.5")
    patterns = {r["pattern"]: float(r["odds"]) for r in kept.collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(patterns)
        for b in batches:
            found = np.array([features(t.as_py(), lexicon) for t in b.column(0)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(3)), b.column(1)], ["a", "b", "c", "y"])

    points = rows.mapInArrow(measure, "a double, b double, c double, y int").toPandas().sort_values(["a", "b", "c", "y"]).to_numpy()
    return Model(patterns, _fit(points[:, :3], points[:, 3]))


def scored(docs: DataFrame, model: Model, score: str, text: str = "text") -> DataFrame:
    """docs with a new column `score` double; null texts score as empty ones. Every clause of the whole text is read."""
    schema = docs.select("*", F.lit(0.0).alias(score)).schema
    source = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.patterns)
        for b in batches:
            scores = [model.score(features(t.as_py() or "", lexicon)) for t in b.column(source)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, score])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of docs, repeated rows included.

    Labels only teach; language, source and id are never inputs of a score. A null id counts as held
    out like its crc32 of the empty text (0). Empty docs give no rows; without usable labels all scores are low.
    """
    model = train(docs, labels, text, key)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = scored(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model, "score", "text")
    return found.select("doc_id", (crc % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, all their columns, whose text scores under 0.5."""
    (score,) = fresh(docs, "score")
    return scored(docs, train(docs, labels, text, key), score, text).where(F.col(score) < 0.5).drop(score)
