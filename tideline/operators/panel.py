"""Nested panels with reasons, masks, splits and folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import all_of, finite, first_reason


def complete(columns: list[str]) -> Column:
    """Every column is known and finite."""
    return all_of(*[finite(F.col(c).cast("double")) for c in columns])


def nested(panel: DataFrame, sets: list[tuple[str, list[str]]]) -> DataFrame:
    """For nested information sets: ``complete_<set>`` needs the columns of the set and of all before it;
    ``reason`` is the first set that is incomplete."""
    so_far: list[str] = []
    gates = []
    for name, columns in sets:
        so_far = so_far + columns
        panel = panel.withColumn(f"complete_{name}", complete(so_far))
        gates.append((F.col(f"complete_{name}"), f"{name.upper()}_INCOMPLETE"))
    return panel.withColumn("reason", first_reason(*gates))


def common_mask(panel: DataFrame, flags: list[str]) -> DataFrame:
    """Rows usable in every design."""
    return panel.withColumn("usable", all_of(*[F.col(f) for f in flags]))


def coverage(panel: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Finite share of each column per group, all in one pass, as rows."""
    shares = panel.groupBy(*by).agg(*[F.avg(F.when(F.coalesce(finite(F.col(c).cast("double")), F.lit(False)), 1.0).otherwise(0.0)).alias(c) for c in columns])
    return shares.unpivot(by, columns, "feature", "coverage")


def assert_coverage(panel: DataFrame, columns: list[str], floor: float, by: list[str]) -> None:
    low = coverage(panel, columns, by).where(F.col("coverage") < floor).limit(5).collect()
    if low:
        raise ValueError("PANEL_COVERAGE_BELOW_FLOOR:" + ";".join(str(r.asDict()) for r in low))


def chronological(panel: DataFrame, session: str, share: float) -> DataFrame:
    """Role D for the first share of the distinct sessions, V for the rest."""
    ranked = panel.select(session).distinct().withColumn("_n", F.dense_rank().over(W.orderBy(session)))
    sessions = ranked.crossJoin(F.broadcast(ranked.agg(F.max("_n").alias("_all")))).select(session, F.when(F.col("_n") <= F.floor(F.col("_all") * share), "D").otherwise("V").alias("role"))
    return panel.join(sessions, session)


def expanding_folds(panel: DataFrame, session_no: str, folds: int, first: int, size: int, purge: int, embargo: int) -> DataFrame:
    """Rows once per fold and part: tests of ``size`` sessions from ``first`` on; training ends ``purge + embargo``
    sessions before its test. Rows multiply by the number of folds."""
    start = F.lit(first) + F.col("fold") * size
    part = F.when((F.col(session_no) >= start) & (F.col(session_no) < start + size), "test").when(F.col(session_no) < start - (purge + embargo), "train")
    return panel.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("part", part).where("part is not null")


def scaled(panel: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """Columns imputed with the training median and scaled by its mean and population deviation; a constant column
    stays centred. One aggregation over the training rows gives all numbers."""
    aggs = [x for c in columns for x in (F.median(c).alias(f"{c}_m"), F.avg(c).alias(f"{c}_a"), F.stddev_pop(c).alias(f"{c}_s"))]
    stats = panel.where(train).agg(*aggs)
    out = panel.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(f"{c}_missing", F.col(c).isNull()).withColumn(c, (F.coalesce(c, F.col(f"{c}_m")) - F.col(f"{c}_a")) / F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(F.lit(1.0)))
    return out.drop(*[f"{c}_{k}" for c in columns for k in "mas"])


def mask_digest(panel: DataFrame, keys: list[str], flag: str) -> str:
    """Order-free digest of the keys a mask keeps: equal masks have equal digests."""
    row = panel.where(F.col(flag)).agg(F.count("*"), F.bit_xor(F.xxhash64(*keys)), F.sum(F.xxhash64(F.lit(1), *keys).cast("decimal(38,0)"))).first()
    return ":".join(map(str, row))


def role_by_date(date: Column, discovery_end: str, validation_end: str) -> Column:
    return F.when(date <= F.lit(discovery_end).cast("date"), "D").when(date <= F.lit(validation_end).cast("date"), "V").otherwise("BURNED")


def in_scope(rows: DataFrame, role: str, allowed: list[str]) -> DataFrame:
    """The rows, where every one has an allowed role; any other role is an error."""
    wrong = rows.where(~F.coalesce(F.col(role).isin(*allowed), F.lit(False))).select(role).distinct().limit(5).collect()
    if wrong:
        raise ValueError("ROLE_OUT_OF_SCOPE:" + ",".join(str(r[0]) for r in wrong))
    return rows


def design_masks(panel: DataFrame, designs: dict[str, list[str]], target: str, keys: list[str]) -> DataFrame:
    """``keys, mask``: the designs that a row can be scored on, as bits in the stated order. A design is usable where
    the target and all its columns are finite."""
    usable = [F.when(complete([target, *columns]), F.lit(1 << i)).otherwise(F.lit(0)) for i, columns in enumerate(designs.values())]
    return panel.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), usable).alias("mask"))


def mask_counts(masked: DataFrame, keys: list[str]) -> DataFrame:
    """``mask, n, digest``: rows of each mask, counted once, and an order-free digest of their keys that adds up over masks."""
    words = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))
    own = F.conv(F.substring(words, 1, 12), 16, 10).cast("decimal(38,0)")
    return masked.groupBy("mask").agg(F.count("*").alias("n"), F.sum(own).alias("digest"))


def combinations(counts: DataFrame, designs: list[str]) -> DataFrame:
    """Every combination of designs with the rows on which all of them can be scored: a sum over the masks that hold it.
    ``lift`` is how much oftener that is than if the designs were usable independently of each other."""
    every = F.sequence(F.lit(0), F.lit((1 << len(designs)) - 1))
    held = counts.withColumn("combination", F.explode(F.filter(every, lambda c: F.col("mask").bitwiseAND(c) == c)))
    sums = held.groupBy("combination").agg(F.sum("n").alias("usable"), F.sum("digest").alias("digest"))
    alone = lambda i: F.max(F.when(F.col("combination") == (1 << i), F.col("usable")))
    single = sums.agg(F.max(F.when(F.col("combination") == 0, F.col("usable"))).alias("_all"), *[F.coalesce(alone(i), F.lit(0)).alias(f"_{i}") for i in range(len(designs))])
    grid = counts.sparkSession.range(1 << len(designs)).select(F.col("id").cast("int").alias("combination"))
    both = grid.join(sums, "combination", "left").crossJoin(F.broadcast(single))  # one row
    has = lambda i: F.col("combination").bitwiseAND(1 << i) > 0
    expected = reduce(lambda a, b: a * b, [F.when(has(i), F.col(f"_{i}") / F.col("_all")).otherwise(1.0) for i in range(len(designs))], F.lit(1.0))
    names = F.concat_ws("+", *[F.when(has(i), F.lit(d)) for i, d in enumerate(designs)])
    usable = F.coalesce("usable", F.lit(0))
    lift = F.when(expected > 0, usable / F.col("_all") / expected)
    return both.select("combination", names.alias("designs"), usable.alias("usable"), (usable / F.col("_all")).alias("share"), lift.alias("lift"), F.coalesce("digest", F.lit(0)).alias("digest"))


def lifted(panel: DataFrame, base: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """A mask over the rows that ``base`` kept, taken back to those of the panel: ``keys, in_base, selected``. A selected row that
    the base does not hold is an error."""
    stray = selected.select(*keys).join(base.select(*keys), keys, "left_anti").limit(1).count()
    if stray:
        raise ValueError("MASK_LIFT_OUTSIDE_BASE")
    marks = base.select(*keys, F.lit(True).alias("in_base")).join(selected.select(*keys, F.lit(True).alias("selected")), keys, "left")
    out = panel.select(*keys).join(marks, keys, "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_base", "selected")])


def eligibility(rows: DataFrame, cells: DataFrame, keys: list[str], executed: str, created: str, step: int, width: int, buffers: list[int]) -> DataFrame:
    """Accounting rows per cell (``keys``) and buffer in seconds: rows that happened in a window ``[origin - buffer - width, origin -
    buffer)`` of an origin (a multiple of ``step``, at least ``width``) and of these the eligible (known by its end), the late and those
    without a clock; ``windows`` counts the windows that hold any. Cells without a row are there, with zeros, and the parts
    sum to the whole. Each row has one window a buffer, which is computed, not joined."""
    each = rows.withColumn("buffer_s", F.explode(F.array(*map(F.lit, buffers))))
    buffer = F.col("buffer_s") * F.lit(1_000_000)
    end = (F.floor((F.col(executed) + buffer) / step) + 1) * step - buffer
    each = each.withColumn("_end", end).where((F.col(executed) >= F.col("_end") - width) & (F.col(executed) < F.col("_end")))
    kind = F.when(F.col(created).isNull(), "no_clock").when(F.col(created) <= F.col("_end"), "eligible").otherwise("late")
    sums = each.withColumn("_kind", kind).groupBy(*keys, "buffer_s").agg(
        F.count("*").alias("candidate"), *[F.count_if(F.col("_kind") == k).alias(k) for k in ("eligible", "late", "no_clock")], F.countDistinct("_end").alias("windows"),
    )
    grid = cells.select(*keys, F.explode(F.array(*map(F.lit, buffers))).alias("buffer_s"))
    out = grid.join(sums, [*keys, "buffer_s"], "left").fillna(0, ["candidate", "eligible", "late", "no_clock", "windows"])
    whole = F.col("candidate") == F.col("eligible") + F.col("late") + F.col("no_clock")
    return out.withColumn("whole", whole)
