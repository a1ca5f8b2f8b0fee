"""Hash-based randomness and exact ranks that never sort a whole group in one task.

Random choices are functions of a row key, so they do not depend on partitioning, retries or the
number of executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.frames import col, require_columns, small_or_same
from tabprofile.functions.stats import order_statistics
from tabprofile.session import materialise, shuffle_partitions

HASH_BUCKETS = 1 << 16
_HASH_RANGE = float(16**13)


def unit_hash(key: str | Column, salt: str = "") -> Column:
    """A uniform number in [0, 1) derived from the key's text and a salt (52 hash bits)."""
    text = (col(key) if isinstance(key, str) else key).cast("string")
    digest = F.md5(F.concat(F.lit(salt), text) if salt else text)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_HASH_RANGE)


def hash_cuts(
    df: DataFrame, group: Sequence[str], key: str, quotas: Sequence[Column], salt: str = "", unit: str | None = None
) -> DataFrame:
    """Per group, where hash order passes each quota: ``(group…, n, cuts)``.

    A quota is an expression over ``n`` (the group's size).  ``cuts[i]`` is the (hash, key) pair of
    the last row inside quota ``i``, or null when the quota is below one.  Bucket counts locate the
    bucket of each cut, so only that bucket's rows are ordered, whatever the size of the group.
    ``unit`` names a column that holds the hash already.
    """
    require_columns(df, [*group, key])
    names = [f"g{i}" for i in range(len(group))]
    data = df.select(
        *[col(g).alias(n) for g, n in zip(group, names)],
        (col(unit) if unit else unit_hash(key, salt)).alias("u"),
        col(key).alias("k"),
    ).withColumn("bucket", F.floor(F.col("u") * HASH_BUCKETS).cast("int"))
    everything = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    tally = data.groupBy(*names, "bucket").agg(F.count(F.lit(1)).alias("here"))
    tally = tally.select(
        *names,
        "bucket",
        "here",
        F.sum("here").over(everything).alias("n"),
        (F.sum("here").over(everything.orderBy("bucket")) - F.col("here")).alias("before"),
    )
    wanted = tally.select(
        *names, "bucket", "n", "before", "here",
        F.posexplode(F.array(*[F.least(q.cast("bigint"), F.col("n")) for q in quotas])).alias("slot", "quota"),
    )
    edge = small_or_same(
        wanted.where((F.col("quota") > F.col("before")) & (F.col("quota") <= F.col("before") + F.col("here"))))
    # null-safe on the group so that a null class is a class of its own
    d, e = data.alias("d"), edge.alias("e")
    same = [F.col(f"d.{n}").eqNullSafe(F.col(f"e.{n}")) for n in names] + [F.col("d.bucket") == F.col("e.bucket")]
    inside = d.join(e, same).select(*[f"e.{n}" for n in names], "slot", "quota", "before", "u", "k")
    at = Window.partitionBy(*names, "slot").orderBy("u", "k")
    picked = inside.withColumn("r", F.row_number().over(at) + F.col("before")).where(F.col("r") == F.col("quota"))
    sizes = tally.groupBy(*names).agg(F.max("n").alias("n"))
    cuts = picked.groupBy(*names).agg(F.map_from_entries(
        F.collect_list(F.struct("slot", F.struct("u", "k").alias("cut")))).alias("m"))
    s, c = sizes.alias("s"), cuts.alias("c")
    joined = (
        s.join(c, [F.col(f"s.{n}").eqNullSafe(F.col(f"c.{n}")) for n in names], "left")
        if names else s.join(c, F.lit(True), "left")
    )
    return joined.select(
        *[F.col(f"s.{n}").alias(g) for g, n in zip(group, names)],
        "n",
        F.array(*[F.col("m")[F.lit(i)] for i in range(len(quotas))]).alias("cuts"),
    )


def hash_segments(
    df: DataFrame, group: Sequence[str], key: str, quotas: Sequence[Column], salt: str = "", name: str = "segment", unit: str | None = None
) -> DataFrame:
    """Add the number of quotas each row lies beyond, in hash order within its group.

    With ascending quotas ``q0 <= q1 …`` segment 0 holds exactly the first ``q0`` rows of a group,
    segment 1 the rows up to ``q1``, and so on.
    """
    cuts = hash_cuts(df, group, key, quotas, salt, unit)
    renamed = small_or_same(
        cuts.select(*[col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("cuts").alias("_cuts")))
    match = [col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] or [F.lit(True)]
    here = F.struct((col(unit) if unit else unit_hash(key, salt)).alias("u"), col(key).alias("k"))
    beyond = F.size(F.filter("_cuts", lambda c: c.isNull() | (c < F.col("_here"))))
    return (
        df.withColumn("_here", here)
        .join(renamed, match)
        .withColumn(name, beyond.cast("int"))
        .drop("_here", "_cuts", *[f"_g{i}" for i in range(len(group))])
    )


def hash_sample(df: DataFrame, key: str, size: int, salt: str = "") -> DataFrame:
    """Exactly the ``size`` rows with the smallest hashes (all rows when there are fewer)."""
    total = df.count()
    share = min(1.0, (2.0 * size + 100.0) / max(total, 1))
    near = df.withColumn("_u", unit_hash(key, salt))
    # the pre-filter keeps the ordered set small; it is dropped in the odd case that it cut too deep
    some = near.where(F.col("_u") < share)
    if share < 1.0 and some.limit(size).count() < size:
        some = near
    return some.orderBy("_u", col(key)).limit(size).drop("_u")


def ordered_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: Column, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows that come before, per group, in ascending order.

    ``order`` must be unique within a group.  Rows are range-partitioned on group and order, so a
    dominant group spreads over many slices; slices are summed separately and shifted by the
    totals of the slices before them.
    """
    parts = shuffle_partitions(df.sparkSession)
    sliced = materialise(
        df.withColumn("_w", weight)
        .repartitionByRange(parts, *[col(c) for c in [*group, *order]])
        .withColumn("_slice", F.spark_partition_id())
    )
    keys = [*group, "_slice"]
    sums = sliced.groupBy(*[col(k) for k in keys]).agg(F.sum("_w").alias("_t"))
    earlier = Window.partitionBy(*[col(g) for g in group] or [F.lit(0)]).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = sums.select(*[col(k) for k in keys], F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[col(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        sliced.join(small_or_same(bases), keys)
        .withColumn(name, F.col("_base") + F.coalesce(F.sum("_w").over(within), F.lit(0)))
        .drop("_w", "_slice", "_base")
    )


def ordered_best(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str, lowest: bool = False
) -> DataFrame:
    """Add the best value so far, this row included, per group in ascending order.

    Sliced like :func:`ordered_totals`, so one long group is no single task's work.
    """
    best = F.min if lowest else F.max
    pick = F.least if lowest else F.greatest
    parts = shuffle_partitions(df.sparkSession)
    sliced = materialise(
        df.repartitionByRange(parts, *[col(c) for c in [*group, *order]]).withColumn("_slice", F.spark_partition_id()))
    keys = [*group, "_slice"]
    tops = sliced.groupBy(*[col(k) for k in keys]).agg(best(col(value)).alias("_t"))
    earlier = Window.partitionBy(*[col(g) for g in group] or [F.lit(0)]).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = tops.select(*[col(k) for k in keys], best("_t").over(earlier).alias("_base"))
    within = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[col(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, 0)
    return sliced.join(small_or_same(bases), keys).withColumn(name, pick(F.col("_base"), best(col(value)).over(within))).drop("_slice", "_base")


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "_row_index") -> DataFrame:
    """Add the 0-based position of each row in the given unique order."""
    return ordered_totals(df, [], order, F.lit(1).cast("bigint"), name)


def with_point_id(df: DataFrame, key: str | None, name: str = "id") -> DataFrame:
    """A unique bigint per row of an already grouped frame: its integer key, or a stored row number."""
    if key is not None and df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        return materialise(df.withColumn(name, col(key).cast("bigint")))
    return materialise(materialise(df).withColumn(name, F.monotonically_increasing_id()))


def time_segments(
    df: DataFrame, time_column: str, key: str, quotas: Sequence[int], name: str = "segment"
) -> DataFrame:
    """Like :func:`hash_segments` but in order of time; equal times are ordered by key hash.

    The time value at each quota is found by exact selection, so nothing is sorted.  Rows that share
    that value are divided by hash, however many there are.
    """
    moment = _micros(df, time_column)
    data = df.where(moment.isNotNull())
    picks = order_statistics(data, moment.cast("double"), [q - 1 for q in quotas if q > 0])
    beyond = F.lit(0)
    result = df.withColumn("_m", moment).withColumn("_here", F.struct(unit_hash(key).alias("u"), col(key).alias("k")))
    for i, quota in enumerate(quotas):
        if quota <= 0:
            beyond = beyond + 1
            continue
        edge = int(picks[quota - 1])
        earlier = data.where(moment < edge).count()
        tied = data.where(moment == edge)
        cut = hash_cuts(tied, [], key, [F.lit(quota - earlier)]).select(F.col("cuts")[0].alias("cut")).first()["cut"]
        limit = F.struct(F.lit(cut["u"]).alias("u"), F.lit(cut["k"]).alias("k"))
        past = (F.col("_m") > edge) | ((F.col("_m") == edge) & (F.col("_here") > limit)) | F.col("_m").isNull()
        beyond = beyond + F.when(past, 1).otherwise(0)
    return result.withColumn(name, beyond.cast("int")).drop("_m", "_here")


def _micros(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(col(name))
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_timestamp_ltz(col(name)))
    if kind == "date":
        return F.unix_date(col(name)).cast("bigint")
    if kind == "string":
        return F.unix_micros(F.try_to_timestamp(col(name)))
    return col(name).cast("bigint")
