"""Running sums and last values along an order, for keys that one task could not hold.

A key's rows are cut into segments of the order. Each segment is scanned by itself; one row a segment says what it hands
on, and a scan over these rows alone says what each segment starts with. So a key with all rows of the table fills as
many tasks as it has segments, and only its segments' totals meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tasks that texts are dealt out to at least. Spark joins slices by their compressed bytes, of which texts have few.
SLICES = 48


#: Characters of text in a slice, so that the memory of a task does not grow with the input.
SLICE = 2_000_000


def least(docs: DataFrame) -> int:
    """The session's number of slices, SLICES at least."""
    return max(SLICES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def slices(docs: DataFrame) -> int:
    """How many slices documents are dealt out to: the session's number, SLICES at least, doubled until their texts are cut
    into slices of SLICE characters. Documents are counted for it, and the first thousand measured."""
    n = least(docs)
    if docs.isStreaming or "text" not in docs.columns:
        return n
    mean = docs.limit(1000).agg(F.avg(F.length("text")).alias("mean")).first()["mean"] or 0
    size = docs.count() * mean
    while n * SLICE < size:
        n *= 2
    return n


def dealt(docs: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Documents dealt out by `keys` to `n` slices before anything is made of them."""
    return docs.repartition(n or slices(docs), *keys)


def unsent(df: DataFrame) -> DataFrame:
    """df, which no join sends whole to all tasks. Spark reckons sizes from files, and what is made of texts has many times
    the bytes of their files: rows for each document that seem to fit do not."""
    return df.hint("merge")


def scan(df: DataFrame, keys: list[str], place: str, size: int, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, n: int | None = None) -> DataFrame:
    """df with a column for each of `sums`, the sum over the rows before this one, and for each of `lasts`, the last value
    up to this row that isn't null; both within `keys`, in the order of the whole number `place`, which no two rows of a
    key share. A segment is `size` numbers long; segments are dealt out to `n` slices, or as the session says."""
    sums, lasts = sums or {}, lasts or {}
    begun = [F.floor(F.col(place) / size).alias("scan_segment"), *(c.alias(f"scan_{n}") for n, c in (sums | lasts).items())]
    rows = df.select("*", *begun)
    rows = rows.repartition(n, *keys, "scan_segment") if n else rows
    own = Window.partitionBy(*keys, "scan_segment").orderBy(place)
    before, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(place)))
    totals = rows.groupBy(*keys, "scan_segment").agg(*(F.sum(f"scan_{n}").alias(f"given_{n}") for n in sums), *(latest(F.col(f"scan_{n}")).alias(f"given_{n}") for n in lasts))
    handed = Window.partitionBy(*keys).orderBy("scan_segment").rowsBetween(Window.unboundedPreceding, -1)
    given = totals.select(*keys, "scan_segment", *(F.sum(f"given_{n}").over(handed).alias(f"given_{n}") for n in sums), *(F.last(f"given_{n}", ignorenulls=True).over(handed).alias(f"given_{n}") for n in lasts))
    for k in sums:
        rows = rows.withColumn(f"here_{k}", F.sum(f"scan_{k}").over(before))
    for k in lasts:
        rows = rows.withColumn(f"here_{k}", F.last(f"scan_{k}", ignorenulls=True).over(upto))
    joined = rows.join(unsent(given), [*keys, "scan_segment"])
    zero = F.lit(0).cast("long")
    out = {n: F.coalesce(f"here_{n}", zero) + F.coalesce(f"given_{n}", zero) for n in sums} | {n: F.coalesce(f"here_{n}", f"given_{n}") for n in lasts}
    return joined.select(*(F.col(c) for c in df.columns if c not in out), *(c.alias(n) for n, c in out.items()))
