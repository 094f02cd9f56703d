"""Running sums, places, as-of matches and range joins that hold for keys of any size.

A plain window puts a key into one task. Here rows are dealt by ranges of (key, order), so a key that holds a third of the
table spans a third of the tasks; what a range needs of the others is one row for each key in each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.sources.shared import written

PART = "__part"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df dealt by ranges of keys and order, with the range's number; written, so that all readers see the same ranges."""
    dealt = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(PART, F.spark_partition_id())
    return written(dealt, "ranges")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with running sums along each key's order, the row itself included."""
    steps = {f"__step_{n}": c for n, c in sums.items()}
    rows = ranged(df.withColumns(steps), keys, order)
    totals = rows.groupBy(*keys, PART).agg(*[F.sum(f"__step_{n}").alias(f"__all_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, PART, *[F.sum(f"__all_{n}").over(earlier).alias(f"__carried_{n}") for n in sums])
    own = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__own_{n}": F.sum(f"__step_{n}").over(own) for n in sums})
    out = _same_keys(rows, carried, [*keys, PART])
    return out.select(*df.columns, *[(F.coalesce(F.col(f"__carried_{n}"), F.lit(0)) + F.col(f"__own_{n}")).alias(n) for n in sums])


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on equal keys, null keys being equal."""
    renamed = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(renamed, [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys], "left").drop(*[f"__right_{k}" for k in keys])


def first_after(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], values: list[str], until: DataFrame | None = None) -> DataFrame:
    """left with the values of the first row of right strictly after it in its key's order, nulls if there is none or
    if a row of until lies between. Of equals in order the smallest values are taken; a row of until in the same place
    as one of right doesn't hide it."""
    nothing = F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType)
    own = F.struct(*[c for c in left.columns if c not in keys + order]) if set(left.columns) - set(keys + order) else F.struct(F.lit(1).alias("none"))
    of = lambda df, tag, value, row: df.select(*keys, *order, F.lit(tag).alias("__tag"), value.alias("__value"), row.alias("__row"))
    none = F.lit(None).cast(left.select(own.alias("r")).schema["r"].dataType)
    rows = of(left, 0, nothing, own).unionByName(of(right, 2, F.struct(*values), none))
    if until is not None:
        rows = rows.unionByName(of(until, 1, nothing, none))
    rows = ranged(rows, keys, order)
    # Read backwards: what a left row needs is the last other row that has been passed.
    seen = F.when(F.col("__tag") > 0, F.struct("__tag", "__value"))
    back = Window.partitionBy(*keys, PART).orderBy(*[F.desc(c) for c in order], "__tag", F.desc("__value")).rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*keys, PART).agg(F.min(F.when(F.col("__tag") > 0, F.struct(*order, (-F.col("__tag")).alias("t"), "__tag", "__value"))).alias("h"))
    later = Window.partitionBy(*keys).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*keys, PART, F.last(F.when(F.col("h").isNotNull(), F.struct("h.__tag", "h.__value")), ignorenulls=True).over(later).alias("__beyond"))
    found = _same_keys(rows.withColumn("__seen", F.last(seen, ignorenulls=True).over(back)).where("__tag = 0"), heads, [*keys, PART])
    hit = F.coalesce("__seen", "__beyond")
    taken = F.when(hit["__tag"] == 2, hit["__value"])
    rest = [F.col("__row")[c].alias(c) for c in left.columns if c not in keys + order]
    return found.select(*keys, *order, *rest, *[taken[v].alias(v) for v in values])


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs of a point and an interval of the same keys with low <= at <= high (whole numbers). An interval is
    copied to each bucket of a width that it meets, and the join is on keys and bucket, which also splits large keys;
    a pair meets in the point's bucket alone."""
    cell = lambda c: F.floor(F.col(c) / width)
    covered = intervals.where(F.col(low) <= F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("__cell", cell(at)).join(covered, [*keys, "__cell"]).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__cell")


def range_totals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, least: str) -> DataFrame:
    """keys, low, high, n, first of the distinct intervals that hold a point of the same keys (low <= at <= high, whole numbers): how many they
    hold and the least value of a column among them. No pair is made: points are added up by place, and places by dyadic cells (those of level k are
    2**k wide); an interval is the sum of two cells a level at most, so it meets as many as its width's logarithm."""
    spans = intervals.select(*keys, F.col(low).cast("bigint").alias(low), F.col(high).cast("bigint").alias(high)).where(F.col(low) <= F.col(high)).distinct()
    # one level more than the width's logarithm may round to: it has no cell in the interval
    levels = F.floor(F.log2(F.col(high).cast("double") - F.col(low) + 1)).cast("int") + 1
    inner = lambda k: (-F.call_function("shiftright", -F.col(low), k), F.call_function("shiftright", F.col(high) + 1, k))

    def taken(k: Column) -> Column:
        a, b = inner(k)
        left, right = (a < b) & (F.pmod(a, F.lit(2)) == 1), (a < b) & (F.pmod(b, F.lit(2)) == 1)
        return F.array(F.when(left, F.struct(k.alias("level"), a.alias("cell"))), F.when(right, F.struct(k.alias("level"), (b - 1).alias("cell"))))

    cells = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.least(levels, F.lit(62))), taken)), lambda c: c.isNotNull())
    cut = spans.select(*keys, low, high, F.explode(cells).alias("c")).select(*keys, low, high, "c.level", "c.cell")
    places = points.groupBy(*keys, F.col(at).cast("bigint").alias("__at")).agg(F.count("*").alias("n"), F.min(least).alias("first")).where("__at is not null")
    top = F.broadcast(spans.agg(F.least(F.max(levels), F.lit(62)).alias("__top")))
    placed = places.crossJoin(top).withColumn("level", F.explode(F.sequence(F.lit(0), "__top")))
    sums = placed.groupBy(*keys, "level", F.call_function("shiftright", F.col("__at"), F.col("level")).alias("cell")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return cut.join(sums, [*keys, "level", "cell"]).groupBy(*keys, low, high).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
