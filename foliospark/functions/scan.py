"""Running aggregates, also of keys too large for one window partition.

Most keys take a plain window. Keys of more than `HOT_ROWS` rows are found by a count, and cut at quantiles of their first
order column, whatever its spread: into pieces of about as many rows each, which two_level_scan() puts together.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.scratch import stash

#: Rows of a key that one window partition takes; pieces of a key at most; keys of a table that is broadcast.
HOT_ROWS, MOST_PIECES, SMALL = 1 << 20, 4096, 100_000


def rising(df: DataFrame, name: str) -> Column:
    """A number that never falls where the column rises: times in microseconds, of text the first six bytes. NULL stays."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")
    return F.when(c.isNotNull(), F.lit(0).cast("long"))


def hot_keys(df: DataFrame, order: list[str], *keys: list[str], limit: int | None = None) -> list[DataFrame | None]:
    """For each of the keys (the first the finest, each next a part of the one before): key columns named `_h_<name>` and
    `_cuts`, the places to cut the key at, for keys of more than `limit` rows; None if there is none. The counts are one job
    over the key columns; only the rows of hot keys are read again."""
    limit = limit or HOT_ROWS
    level = df.groupBy(*keys[0]).agg(F.count("*").alias("_n")).withColumn("_m0", F.col("_n"))
    for k, key in enumerate(keys[1:], 1):
        level = level.groupBy(*key).agg(F.sum("_n").alias("_n"), *[F.max(f"_m{i}").alias(f"_m{i}") for i in range(k)]).withColumn(f"_m{k}", F.col("_n"))
    tops = level.agg(*[F.max(f"_m{k}") for k in range(len(keys))]).first()
    return [cut_points(df, order, key, limit, top) if (top or 0) > limit else None for key, top in zip(keys, tops)]


def same_key(df: DataFrame, hot: DataFrame, key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [df[c].eqNullSafe(hot[f"_h_{c}"]) for c in key])


def marked(hot: DataFrame) -> DataFrame:
    """For broadcast if few, as counted; there is at most one hot key for each `limit` rows."""
    return F.broadcast(hot) if hot.limit(SMALL + 1).count() <= SMALL else hot


def cut_points(df: DataFrame, order: list[str], key: list[str], limit: int, top: int) -> DataFrame:
    heavy = stash(df.groupBy(*[F.col(c).alias(f"_h_{c}") for c in key]).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).drop("_n"), "hot-keys")
    pieces = min(MOST_PIECES, ceil(2 * top / limit))
    places = [i / pieces for i in range(1, pieces)]
    rows = df.withColumn("_v", rising(df, order[0]))
    rows = rows.join(marked(heavy), same_key(rows, heavy, key))
    names = [f"_h_{c}" for c in key]
    cuts = F.array_distinct(F.percentile_approx("_v", places, F.lit(max(10_000, 8 * pieces))))
    return stash(rows.groupBy(*names).agg(F.coalesce(cuts, F.array().cast("array<double>")).alias("_cuts")), "hot-cuts")


def scan(df: DataFrame, key: list[str], order: list[str], hot: DataFrame | None, **parts) -> DataFrame:
    """The aggregates of two_level_scan(), by plain windows for all keys but the hot ones. Without hot keys df is read once."""
    if hot is None:
        return plain_scan(df, key, order, **parts)
    rows = in_pieces(df, key, order, hot)
    warm = two_level_scan(rows.where("_piece IS NOT NULL"), key, order, F.col("_piece"), **parts)
    return plain_scan(rows.where("_piece IS NULL"), key, order, **parts).unionByName(warm).drop("_piece")


def in_pieces(df: DataFrame, key: list[str], order: list[str], hot: DataFrame) -> DataFrame:
    """Adds _piece, which rises with the order, to the rows of hot keys; NULL for others. Rows of equal first order column are
    in one piece, NULLs in the first."""
    tagged = df.join(marked(hot), same_key(df, hot, key), "left").drop(*[f"_h_{c}" for c in key])
    value = rising(df, order[0])
    piece = F.size(F.filter("_cuts", lambda c: c <= value)).cast("long")
    return tagged.withColumn("_piece", F.when(F.col("_cuts").isNotNull(), piece)).drop("_cuts")


def plain_scan(
    df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, since: dict[str, Column] | None = None, step: Column | None = None, before: tuple[str, ...] = (),
) -> DataFrame:
    """two_level_scan() by one window over each key."""
    w = W.partitionBy(*key).orderBy(*order)
    now, prior = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True)
    out = {}
    for group, f in ((sums or {}, lambda c: F.sum(c)), (maxima or {}, F.max), (lasts or {}, last)):
        for n, c in group.items():
            whole = (lambda x: F.coalesce(x, F.lit(0))) if f not in (F.max, last) else (lambda x: x)
            out[n] = whole(f(c).over(now))
            if n in before:
                out[f"{n}_before"] = whole(f(c).over(prior))
    out |= {n: F.lag(c).over(w) for n, c in (lags or {}).items()}
    rows = df.withColumns(out)
    if since:
        rows = rows.withColumn("_step", F.sum(step if step is not None else F.lit(1)).over(now))
        rows = rows.withColumns({n: last(c - F.col("_step")).over(now) + F.col("_step") for n, c in since.items()}).drop("_step")
    return rows


def two_level_scan(
    df: DataFrame, key: list[str], order: list[str], bucket: Column, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, since: dict[str, Column] | None = None, step: Column | None = None, before: tuple[str, ...] = (),
) -> DataFrame:
    """Running sums, maxima and last non-null values per key, the values of the row before (lags), and the last non-null
    value plus the steps since (since, step: 1 a row by default): inside (key, bucket), then over one row per bucket, then
    put together. Sums, maxima and lasts named in `before` come with their value before the row too, as `<name>_before`.
    bucket has to rise with the order; a NULL in a key is a key. df is read twice, so write it before scans of scans."""
    sums, maxima, lasts, lags, since = sums or {}, maxima or {}, lasts or {}, lags or {}, since or {}
    inside = W.partitionBy(*key, "_b").orderBy(*order)
    running, prior = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True)
    parts = [(sums, F.sum), (maxima, F.max), (lasts, last)]
    rows = df.withColumn("_b", bucket)
    if since:
        rows = rows.withColumn("_step", F.sum(step if step is not None else F.lit(1)).over(running))
    bases = {n: c - F.col("_step") for n, c in since.items()}
    local = {f"_{n}": f(c).over(running) for group, f in [*parts, (bases, last)] for n, c in group.items()} | {f"_{n}": F.lag(c).over(inside) for n, c in lags.items()}
    local |= {f"_{n}_before": f(c).over(prior) for group, f in parts for n, c in group.items() if n in before}
    at = F.struct(*order)
    ends = rows.groupBy(*key, "_b").agg(
        *[F.sum(c).alias(f"_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_{n}") for n, c in maxima.items()],
        *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_{n}") for n, c in (lasts | bases).items()], *[F.max_by(c, at).alias(f"_{n}") for n, c in lags.items()],
        *[F.max("_step").alias("_steps")] * bool(since), F.count("*").alias("_all"),
    )
    earlier = W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    if since:
        ends = ends.withColumn("_c_steps", F.coalesce(F.sum("_steps").over(earlier), F.lit(0))).withColumns({f"_{n}": F.col(f"_{n}") - F.col("_c_steps") for n in since})
    of_bucket = [*key, "_b"]
    carry = [f(f"_{n}").over(earlier).alias(f"_c_{n}") for group, f in [*parts, (bases, last), (lags, F.last)] for n in group]
    carried = ends.select(*[F.col(c).alias(f"_k_{c}") for c in of_bucket], *["_c_steps"] * bool(since), *carry)
    joined = rows.withColumns(local | ({"_row": F.row_number().over(inside)} if lags else {}))
    out = joined.join(carried, reduce(lambda a, b: a & b, [joined[c].eqNullSafe(carried[f"_k_{c}"]) for c in of_bucket]))

    def put(n: str, own: str) -> Column:
        if n in sums:
            return F.coalesce(F.col(own), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
        return F.greatest(own, f"_c_{n}") if n in maxima else F.coalesce(own, f"_c_{n}")

    merged = {n: put(n, f"_{n}") for n in (*sums, *maxima, *lasts)} | {f"{n}_before": put(n, f"_{n}_before") for n in before}
    merged |= {n: F.when(F.col("_row") == 1, F.col(f"_c_{n}")).otherwise(F.col(f"_{n}")) for n in lags}
    merged |= {n: F.coalesce(F.col(f"_{n}"), F.col(f"_c_{n}") + F.col("_c_steps")) + F.col("_step") for n in since}
    names = [*sums, *maxima, *lasts, *lags, *since]
    return out.withColumns(merged).drop("_b", "_row", "_step", "_c_steps", *[f"_{n}" for n in names], *[f"_{n}_before" for n in before], *[f"_c_{n}" for n in names], *[f"_k_{c}" for c in of_bucket])
