"""Joins and windows over event time: as-of and interval joins, sessions, sliding windows.

None of them compares all rows of a key with all others.  The as-of join is one ordered pass
over both sides together; the interval join is an equi-join on buckets of time whose width
follows each interval's length.  Keys and buckets that hold many rows are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Rows of a key that one task passes through in order, and rows of a bucket that one task joins.
PIECE, BUCKET = 1 << 20, 1 << 16


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, order: list[str], carry: list[str], piece: int = PIECE) -> DataFrame:
    """``left`` with, as column ``asof``, a struct (time, order and carry) of the last right row of the same key that is not later; null if there is none.

    Both sides have ``by`` and ``time``; of right rows of one time the greatest by ``order`` counts.  Both
    sides are laid together and passed through in order, with the last right row running
    along.  A key with more than ``piece`` rows is cut by time into slices, each passed on its own;
    what the last slice before it ended with is carried over from one row per slice.
    Rows with a null key or time match nothing.
    """
    last = F.struct(*(F.col(c) for c in dict.fromkeys([time, *order, *carry])))
    names = left.columns
    nothing = F.lit(None).cast(right.select(last.alias("r")).schema["r"].dataType)
    given = _all([F.col(c).isNotNull() for c in [*by, time]])
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in names), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col(time).alias("_t"), F.lit(1).alias("_side"), nothing.alias("_r"))
    b = right.where(given).select(*(F.lit(None).cast(left.schema[c].dataType).alias(f"l_{c}") for c in names), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col(time).alias("_t"), F.lit(0).alias("_side"), last.alias("_r"))
    keys = [f"_b{i}" for i in range(len(by))]
    both = a.where(_all([F.col(c).isNotNull() for c in [*keys, "_t"]])).unionByName(b)
    # how far apart the cuts of a large key are: as many slices of equal time as it has pieces
    sizes = both.groupBy(*keys).agg(F.ceil(F.count("*") / piece).alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).where("_n > 1")
    sized = both.join(sizes, keys, "left")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if dict(both.dtypes)["_t"].startswith("timestamp") else F.col(c).cast("double")
    share = (seconds("_t") - seconds("_lo")) / F.when(seconds("_hi") > seconds("_lo"), seconds("_hi") - seconds("_lo")).otherwise(1.0)
    cut = F.when(F.col("_n").isNull(), 0).otherwise(F.least(F.floor(share * F.col("_n")), F.col("_n") - 1)).cast("long")
    sliced = sized.withColumn("_s", cut).drop("_n", "_lo", "_hi")
    ahead = Window.partitionBy(*keys, "_s").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = sliced.withColumn("_last", F.last("_r", ignorenulls=True).over(ahead)).where("_side = 1")
    # one row per slice: the greatest right row of it, and then the last of the slices before
    ends = sliced.where("_side = 0").groupBy(*keys, "_s").agg(F.max("_r").alias("_end"))
    slices = sliced.select(*keys, "_s").where("_s > 0").distinct().unionByName(ends.select(*keys, "_s")).distinct().join(ends, [*keys, "_s"], "left")
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).where("_s > 0 AND _before IS NOT NULL").drop("_end")
    out = passed.join(carried, [*keys, "_s"], "left").select(*(F.col(f"l_{c}").alias(c) for c in names), F.coalesce("_last", "_before").alias("asof"))
    rest = left.where(~given).withColumn("asof", nothing)
    return out.unionByName(rest)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, most: int = BUCKET) -> DataFrame:
    """Every pair of a point and an interval of the same key with start <= at < end; columns of both (``by`` once).

    An interval of length L lies on the level whose buckets are the least power of two of
    microseconds above L wide, and so in one or two of them: those of its start and of its end.  A point looks up
    one bucket on each level that intervals use (at most 64).  Buckets with more than ``most`` intervals are split
    by a hash of the interval, whose parts a point visits all; buckets with more than ``most``
    points are split by a hash of the point, and their intervals go to every part.  Empty intervals and nulls match nothing.
    """
    micro = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = intervals.where(_all([F.col(c).isNotNull() for c in [*by, start, end]]) & (F.col(start) < F.col(end)))
    level = F.ceil(F.log2((micro(end) - micro(start)).cast("double"))).cast("int")
    held = held.withColumn("_level", level)
    wide = lambda m: F.floor(m / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    # its last moment, as the end is not part of it
    held = held.withColumn("_slot", F.explode(F.array_distinct(F.array(wide(micro(start)), wide(micro(end) - 1)))))
    levels = held.select(*by, "_level").distinct()
    seen = points.where(_all([F.col(c).isNotNull() for c in [*by, at]])).join(levels, by).withColumn("_slot", wide(micro(at)))
    cell = [*by, "_level", "_slot"]
    parts = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(f"{name} > 1")
    hot_intervals, hot_points = parts(held, "_i"), parts(seen, "_p")

    def dealt(df: DataFrame, own: DataFrame, other: DataFrame, mine: str, theirs: str) -> DataFrame:
        df = df.join(own, cell, "left").join(other, cell, "left")
        one = lambda c: F.coalesce(c, F.lit(1))
        picked = F.pmod(F.xxhash64(*[c for c in df.columns if c not in (*cell, mine, theirs) and not isinstance(df.schema[c].dataType, MapType)]), one(F.col(mine))).cast("int")
        return df.withColumn(f"{mine}n", picked).withColumn(f"{theirs}n", F.explode(F.sequence(F.lit(0), one(F.col(theirs)) - 1))).drop(mine, theirs)

    a, b = dealt(seen, hot_points, hot_intervals, "_p", "_i"), dealt(held, hot_intervals, hot_points, "_i", "_p")
    return a.join(b, [*cell, "_pn", "_in"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_slot", "_pn", "_in")


def sessions(events: DataFrame, by: list[str], time: str, gap: str, late: str | None = None, **aggregates: Column) -> DataFrame:
    """by, start, end, aggregates: stretches of a key's events with less than ``gap`` between them.  On a stream, rows later than ``late`` are dropped and a session is given once it can't grow."""
    rows = events if late is None else events.withWatermark(time, late)
    grouped = rows.groupBy(*by, F.session_window(time, gap).alias("_w")).agg(*(c.alias(n) for n, c in aggregates.items()))
    return grouped.select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggregates)


def sliding(events: DataFrame, by: list[str], time: str, width: str, step: str, late: str | None = None, **aggregates: Column) -> DataFrame:
    """by, start, end, aggregates of windows ``width`` long that begin every ``step``; on a stream as ``sessions``."""
    rows = events if late is None else events.withWatermark(time, late)
    grouped = rows.groupBy(*by, F.window(time, width, step).alias("_w")).agg(*(c.alias(n) for n, c in aggregates.items()))
    return grouped.select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggregates)
