"""Document fingerprints by consistent weighted sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, plain_text, splitters, whole, with_range, written

#: Samples of a fingerprint, and how many of them one generated row computes (more would make methods that the JIT leaves alone).
SAMPLES, AT_ONCE = 64, 8
#: Units of a range in which the next document is looked up, at least and at most; a text has one for each UNIT bytes begun.
RANGE_UNITS, MOST_UNITS, UNIT = 1000, 32_000, 8192
#: A draw is worked out only if its ln a can be under ln(LIMIT / words of the text). The least of a text's draws has an
#: exponential distribution with the rate words, so it is above that with probability e^-24; then all its draws are worked out.
LIMIT = 24.0
#: Ranges up to which their heads are broadcast (20 MB); beyond, they are met by a shuffle.
BROADCAST_ROWS = 1_000_000


def hashed_words(text: Column, mark: int) -> Column:
    """array<long>: of each word the low 63 bits of its XXH64, and in the last bit the mark: 0 for a text, 1 for its edited form.

    Sorted together, the occurrences of a word in one text stand together, those in the other next to them.
    """
    words = F.array_remove(F.split(text, SPACES), "")
    return F.transform(words, lambda w: F.shiftleft(F.xxhash64(w), 1).bitwiseOR(F.lit(mark).cast("long")))


def _run_ends(terms: Column) -> Column:
    """The place of each distinct term's last occurrence."""
    places = F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: ~F.get(terms, i).eqNullSafe(F.get(terms, i + 1)))


def _weighed(terms: Column, ends: Column) -> Column:
    """array<struct<term, own, edited>>: each term of either text once, with its count in each; null where it has none."""

    def code(i: Column) -> Column:
        return F.get(terms, F.get(ends, i))

    def count(i: Column) -> Column:
        return F.get(ends, i) - F.coalesce(F.get(ends, i - 1), F.lit(-1))

    def entry(end: Column, i: Column) -> Column:
        here = code(i)
        is_own, both = here.bitwiseAND(1) == 0, code(i + 1) == here + 1
        own = F.struct(F.shiftright(here, 1).alias("term"), count(i).alias("own"), F.when(both, count(i + 1)).alias("edited"))
        other = F.struct(F.shiftright(here, 1).alias("term"), F.lit(None).cast("int").alias("own"), count(i).alias("edited"))
        taken = F.coalesce(code(i - 1) == here - 1, F.lit(False))  # stands with the term's own run
        return F.when(is_own, own).when(~taken, other)

    return F.filter(F.transform(ends, entry), lambda x: x.isNotNull())


def _uniforms(bits: Column) -> Column:
    """The product of two uniforms in (0, 1), from the halves of 64 bits."""
    scale = F.lit(float(2**-32))
    high = (F.shiftrightunsigned(bits, 32).cast("double") + 0.5) * scale
    low = (bits.bitwiseAND(0xFFFFFFFF).cast("double") + 0.5) * scale
    return high * low


def _hashes(term: Column, number: Column) -> tuple[Column, Column]:
    first = F.xxhash64(term, number)
    return first, F.xxhash64(first)


def draws(term: Column, number: Column) -> tuple[Column, Column, Column]:
    """r, ln c and beta of sample `number` for a term: r and c are Gamma(2, 1), beta is uniform."""
    first, second = _hashes(term, number)
    r = -F.log(_uniforms(first))
    ln_c = F.log(-F.log(_uniforms(second)))
    return r, ln_c, F.shiftrightunsigned(F.xxhash64(second), 11).cast("double") * F.lit(float(2**-53))


def possible(term: Column, number: Column, bound: Column) -> Column:
    """False only for draws with a > bound / weight: a >= c e^-r / weight, where e^-r = p and c = -ln q >= 2 (1 - q) / (1 + q) are had without logarithms."""
    p, q = map(_uniforms, _hashes(term, number))
    return (F.lit(1.0) - q) * (p + p) <= (F.lit(1.0) + q) * bound


def sample(drawn: Sequence[Column], ln_weight: Column) -> Column:
    """ln a of a term's draws: the smallest over a text's terms identifies the term and quantised weight drawn.

    t = floor(ln S / r + beta), ln y = r (t - beta), a = c / (y e^r). Texts draw the same (term, t), and so
    the same a, with a probability equal to their generalised Jaccard similarity.
    """
    r, ln_c, beta = drawn
    t = F.floor(ln_weight / r + beta).cast("double")
    return ln_c - r * (t - beta) - r


def in_order(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(part, place, doc_id, text, next_text, next_part, next_place): rows in descending id, each with its successor.

    The successor of the last is the first. Ids are cut into ranges; each range gets, as a last row, a copy
    of the first row of the range that follows. So one exchange of the texts by range serves all, and no
    window sees more than a range. The driver holds one id a range. Null ids come last; equal ids stand in
    the order of their texts.
    """
    spark = docs.sparkSession
    slim = docs.select(whole(key).alias("doc_id"), plain_text(F.col(text)).alias("text"))
    units = 1 + F.floor(F.octet_length("text") / UNIT)
    cuts = splitters(slim.where("doc_id is not null"), "doc_id", units, RANGE_UNITS, MOST_UNITS)
    slim = with_range(slim, "doc_id", cuts, "part")
    heads = {r["part"]: r["head"] for r in slim.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    if not heads:
        return slim.select("part", F.lit(1).alias("place"), "doc_id", "text", F.lit("").alias("next_text"), F.lit(0).alias("next_part"), F.lit(1).alias("next_place"))
    downwards = sorted(heads, reverse=True)
    after = spark.createDataFrame([(heads[n], n, p) for p, n in zip(downwards, [*downwards[1:], downwards[0]])], "head long, from_part int, part int")
    if len(downwards) <= BROADCAST_ROWS:
        after = F.broadcast(after)  # the ranges' heads, three numbers each
    firsts = slim.drop("part").join(after, F.col("doc_id").eqNullSafe(F.col("head")))
    copies = firsts.groupBy("doc_id", "part", "from_part").agg(F.min("text").alias("text"))
    rows = slim.select("part", F.lit(0).alias("late"), "doc_id", "text", F.lit(0).alias("from_part"))
    rows = rows.unionByName(copies.select("part", F.lit(1).alias("late"), "doc_id", "text", "from_part"))
    order = Window.partitionBy("part").orderBy("late", F.col("doc_id").desc_nulls_last(), "text")
    seen = rows.select(
        "part",
        F.row_number().over(order).alias("place"),
        "late",
        "doc_id",
        "text",
        F.lead("text").over(order).alias("next_text"),
        F.lead("late").over(order).alias("next_late"),
        F.lead("from_part").over(order).alias("from_part"),
    ).where("late = 0")
    ends = F.col("next_late") == 1
    return seen.select(
        "part",
        "place",
        "doc_id",
        "text",
        "next_text",
        F.when(ends, F.col("from_part")).otherwise(F.col("part")).alias("next_part"),
        F.when(ends, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
    )


def counted_terms(rows: DataFrame, keys: list[str], text: str, edited: str) -> DataFrame:
    """keys, __n_own, __n_edited (words of the two texts), __term, __own, __edited (its counts in them); a row a distinct term of either.

    Where neither has words, one row with null counts.
    """
    words = rows.select(*keys, hashed_words(F.col(text), 0).alias("__a"), hashed_words(F.col(edited), 1).alias("__b"))
    sizes = [F.size("__a").alias("__n_own"), F.size("__b").alias("__n_edited")]
    terms = words.select(*keys, *sizes, F.sort_array(F.concat("__a", "__b")).alias("__terms"))
    terms = terms.select(*keys, "__n_own", "__n_edited", "__terms", _run_ends(F.col("__terms")).alias("__ends"))
    each = terms.select(*keys, "__n_own", "__n_edited", F.explode_outer(_weighed(F.col("__terms"), F.col("__ends"))).alias("__t"))
    return each.select(*keys, "__n_own", "__n_edited", F.coalesce("__t.term", F.lit(0)).alias("__term"), F.col("__t.own").alias("__own"), F.col("__t.edited").alias("__edited"))


def signatures(rows: DataFrame, keys: list[str], text: str, edited: str, limit: float | None) -> DataFrame:
    """keys, own and edited array<int> (SAMPLES of them; null without terms), settled; a row per distinct keys; rows must be dealt by keys.

    A text and its edited form share most terms, so a term's hashes are computed once for both. With a limit, draws
    that cannot be the least are left out by a bound; where the least found is not under the limit, so that a draw
    left out might be smaller, settled is false and the arrays mean nothing. Without one, all draws are worked out.
    """
    each = counted_terms(rows, keys, text, edited)
    sides = ("own", "edited")
    columns = [F.log(F.col(f"__{n}").cast("double")).alias(f"__ln_{n}") for n in sides]
    shares = [F.col(f"__{n}") / F.greatest(F.col(f"__n_{n}"), F.lit(1)) for n in sides]
    bound = F.coalesce(F.greatest(*shares), F.lit(0.0)) * F.lit(limit or 0.0)
    each = each.select(*keys, "__n_own", "__n_edited", "__term", *columns, bound.alias("__bound"))
    each = each.select("*", F.explode(F.array(*[F.lit(k * AT_ONCE) for k in range(SAMPLES // AT_ONCE)])).alias("__first"))

    def drawn(k: int) -> list[Column]:
        term, number = F.col("__term"), F.col("__first") + k
        # the same three columns serve both texts, so they are worked out once
        return [d if limit is None else F.when(possible(term, number, F.col("__bound")), d) for d in draws(term, number)]

    def least(name: str, k: int) -> Column:
        return F.min(sample(drawn(k), F.col(f"__ln_{name}"))).alias(f"__{name}{k}")

    counts = [F.max(f"__n_{n}").alias(f"__n_{n}") for n in sides]
    found = each.groupBy(*keys, "__first").agg(*counts, *[least(n, k) for n in sides for k in range(AT_ONCE)])

    def under(name: str) -> Column:
        if limit is None:
            return F.lit(True)
        # a hair under the bound, whose arithmetic is rounded
        largest = F.greatest(*[F.coalesce(F.col(f"__{name}{k}"), F.lit(float("inf"))) for k in range(AT_ONCE)])
        return (F.col(f"__n_{name}") == 0) | (largest <= F.log(F.lit(limit * 0.999) / F.greatest(F.col(f"__n_{name}"), F.lit(1))))

    both = [F.array(*[F.hash(f"__{name}{k}") for k in range(AT_ONCE)]).alias(name) for name in sides]
    some = [(F.col(f"__n_{name}") > 0).alias(f"any_{name}") for name in sides]
    settled = (under("own") & under("edited")).alias("settled")
    all_of = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__first", *both, *some, settled))).alias("__all"))

    def joined(name: str) -> Column:
        return F.when(F.col("__all")[0][f"any_{name}"], F.flatten(F.transform("__all", lambda x: x[name]))).alias(name)

    return all_of.select(*keys, joined("own"), joined("edited"), F.forall("__all", lambda x: x["settled"]).alias("settled"))


def full_signatures(rows: DataFrame, keys: list[str], text: str, edited: str) -> DataFrame:
    """keys, own, edited as `signatures` without a limit gives them, as a written table: the few texts that a limit leaves unsettled are sampled again."""
    found = written(signatures(rows, keys, text, edited, LIMIT), "weighted-samples")
    left = found.where(~F.col("settled")).select("part", "place")
    done = found.where("settled").drop("settled")
    if left.isEmpty():
        return done
    again = signatures(rows.join(left, ["part", "place"], "left_semi"), keys, text, edited, None)
    return done.unionByName(written(again.drop("settled"), "weighted-samples-in-full"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; texts without terms are like each other and unlike all others."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(equal / float(SAMPLES))


def as_text(samples: Column) -> Column:
    """8 hexadecimal digits a sample; '-' for texts without terms."""
    digits = F.array_join(F.transform(samples, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")
    return F.coalesce(F.lower(digits), F.lit("-"))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The terms of a text are its words, weighed by their counts. Null texts count as empty; a text without
    words has the fingerprint '-'. Empty input gives no rows.
    """
    rows = in_order(docs, text, key)
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(length(text) / 3) as int))"))
    # every generated row hashes the keys, so they are few bytes: the digest's own, and the next range only in a range's last row
    keys = ["part", "place", "doc_id", "n_chars", "digest", "turn"]
    turn = F.when((F.col("next_part") != F.col("part")) | (F.col("next_place") != F.col("place") + 1), F.col("next_part"))
    rows = rows.select("part", "place", "doc_id", n.cast("long").alias("n_chars"), turn.alias("turn"), "text", edited.alias("edited_text"))
    rows = rows.select("*", F.unhex(F.sha2("edited_text", 256)).alias("digest"))
    found = full_signatures(rows, keys, "text", "edited_text")
    found = found.withColumns({
        "edited_sha256": F.lower(F.hex("digest")),
        "next_part": F.coalesce("turn", "part"),
        "next_place": F.when(F.col("turn").isNull(), F.col("place") + 1).otherwise(F.lit(1)),
    })
    following = found.select(F.col("part").alias("next_part"), F.col("place").alias("next_place"), F.col("own").alias("following"))
    joined = found.join(following, ["next_part", "next_place"])
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
