"""What the corpus operators share: reading, written tables, ranges of ids, and joins with hot keys."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition [^\x20\x09-\x0D]+, as a Java pattern.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has more than one in so many rows; so there are at most so many hot keys.
HOT = 1000
#: Rows of a few numbers that one task writes, at least, where the number of rows is known.
ROWS_A_FILE = 50_000

_own_dir: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The run's own folder in the one named in spark.checkpoint.dir: delete it once results are stored.

    Where that is unset and all runs in one process (tests), a temporary one that goes at exit; on a cluster
    a folder of one machine would lose data, so there it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/sketchwright-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="sketchwright-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of about `rows` narrow rows, in no more partitions than hold ROWS_A_FILE each: they grow with the table, not with the shuffle setting."""
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors.

    rows: about how many narrow rows it has, if known, for files that are not tiny. Each file costs its making, and
    where Hadoop has no native library a process is forked to set the rights of every single one.
    """
    spark = df.sparkSession
    df = df if rows is None else packed(df, rows)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def whole(key: str) -> Column:
    """An id as a long; what is no whole number counts as null."""
    return F.col(key).try_cast("long")


def splitters(df: DataFrame, key: str, units: Column, units_each: int, most: int) -> list[int]:
    """Ascending values that cut key into ranges of about units_each units (a row has at least one), or the square root of all units if that is more, but at most `most`.

    So ranges, and units of a range, both grow with the square root of the input until ranges are as large as a
    task may hold. The driver has one number a range. A row of more units than a range may have gets a range of its own.
    """
    weighed = df.select(F.explode(F.array_repeat(key, units.cast("int"))).alias(key))
    total = df.agg(F.sum(units)).collect()[0][0] or 0
    parts = math.ceil(total / min(most, max(units_each, math.isqrt(total)))) if total else 1
    if parts <= 1:
        return []
    cuts = weighed.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts)
    return sorted({int(x) for x in cuts})


def with_range(df: DataFrame, key: str, cuts: list[int], name: str) -> DataFrame:
    """df with `name`: the number of cuts at or below the column key; a null key counts as before all.

    The cuts are the one value of a subquery, not part of the plan, and are looked up in two steps of their square root each.
    """
    if not cuts:
        return df.withColumn(name, F.lit(0))
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    table = df.sparkSession.createDataFrame([(groups,)], "cuts array<array<bigint>>").scalar()
    held, first = fresh(df, "cuts", "first")

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda cut: cut <= F.col(key)))

    full = F.size(F.filter(F.col(held), lambda group: F.element_at(group, -1) <= F.col(key)))  # groups that lie below key altogether
    rest = F.coalesce(F.get(F.col(held), F.col(first)), F.array().cast("array<bigint>"))
    found = F.least(F.col(first) * width, F.lit(len(cuts))) + below(rest)
    out = df.withColumn(held, table).withColumn(first, full)
    return out.withColumn(name, F.when(F.col(key).isNull(), F.lit(0)).otherwise(found).cast("int")).drop(held, first)


def met(rows: DataFrame, table: DataFrame, key: str, copies: str, total: int, spread: Column) -> DataFrame:
    """rows with the columns of table, which has one row a key and in `copies` about how many of the rows have it; null where it has none.

    Keys with over a HOT-th of all rows, at most HOT of them, are broadcast, and their rows stay where they are.
    The others meet by a shuffle, in which hot rows are dealt by `spread` (a hash of something else, of the
    key's type). So no task gets all rows of a hot key.
    """
    is_hot, other, found = fresh(rows, "is_hot", "other_key", "found_key")
    more = [c for c in table.columns if c not in (key, copies)]
    names = dict(zip(more, fresh(rows, *[f"hot_{c}" for c in more])))
    hot = table.where(F.col(copies) * HOT > total).select(key, F.lit(True).alias(is_hot), *[F.col(c).alias(names[c]) for c in more])
    cold = table.where(F.col(copies) * HOT <= total).select(F.col(key).alias(found), *more)
    marked = rows.join(F.broadcast(hot), key, "left")  # at most HOT rows
    marked = marked.withColumn(other, F.when(F.col(is_hot), spread).otherwise(F.col(key)))
    joined = marked.join(cold, F.col(other) == F.col(found), "left")
    return joined.select(*rows.columns, *[F.when(F.col(is_hot), F.col(names[c])).otherwise(F.col(c)).alias(c) for c in more])
