"""Resampling of session series as joins: which session stands at which place of which draw is a table, made from hashes.

A draw's random numbers are hashes of a seed, the draw and a place, so every engine and every retry gets the same ones. Draws are
dealt over the tasks; the series they are taken from has one row a session and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import files

#: Hash numbers are below this.
WHOLE = 1 << 32
#: Webb's six-point weights are the signed roots of these.
WEBB_SQUARES = (1.5, 1.0, 0.5)


def number(*parts: str | Column) -> Column:
    """A whole number below ``WHOLE`` from text parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def number_sql(*parts: str) -> str:
    return f"('0x' || md5(concat_ws(':', {', '.join(parts)}))[1:8])::BIGINT"


def draws_of(spark: SparkSession, draws: int) -> DataFrame:
    return spark.range(draws).withColumnRenamed("id", "draw")


def blocks(spark: SparkSession, n: int, draws: int, block: int, seed: str, wraps: bool = True, length: int | None = None) -> DataFrame:
    """``draw, place, i``: whole blocks of sessions, on a circle or (``wraps`` false) from those starts only that fit. A draw has
    ``length`` places, as many as the series by default."""
    length = n if length is None else length
    block = block if wraps else min(block, n)
    starts = draws_of(spark, draws).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(-(-length // block) - 1))))
    starts = starts.withColumn("start", number(seed, F.col("draw"), F.col("k")) % (n if wraps else n - block + 1))
    places = starts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("place", F.col("k") * block + F.col("j"))
    return places.where(F.col("place") < length).select("draw", "place", ((F.col("start") + F.col("j")) % n).alias("i"))


def stationary(spark: SparkSession, n: int, draws: int, mean_block: int, seed: str) -> DataFrame:
    """``draw, place, i``: blocks of geometric length on a circle."""
    places = draws_of(spark, draws).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    fresh = (F.col("place") == 0) | (number(seed, F.lit("new"), F.col("draw"), F.col("place")) * mean_block < WHOLE)
    start = F.when(fresh, F.struct("place", (number(seed, F.lit("start"), F.col("draw"), F.col("place")) % n).alias("at")))
    so_far = W.partitionBy("draw").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    last = places.withColumn("s", F.last(start, ignorenulls=True).over(so_far))
    return last.select("draw", "place", ((F.col("s.at") + F.col("place") - F.col("s.place")) % n).alias("i"))


def taken(places: DataFrame, series: DataFrame) -> DataFrame:
    """The series' rows at the places of each draw."""
    return places.join(F.broadcast(series), "i")


def statistics(drawn: DataFrame, by: list[str], value: str, n: int, trim: float = 0.05) -> DataFrame:
    """``by, draw, statistic, x``: mean, median and trimmed mean of every draw; a draw is as long as the series."""
    cut = int(trim * n)
    place = F.row_number().over(W.partitionBy(*by, "draw").orderBy(value))
    ranked = drawn.withColumn("_r", place)
    kept = (F.col("_r") > cut) & (F.col("_r") <= n - cut)
    wide = ranked.groupBy(*by, "draw").agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.avg(F.when(kept, F.col(value))).alias("trimmed"))
    return wide.unpivot([*by, "draw"], ["mean", "median", "trimmed"], "statistic", "x")


def two_sided(x: str | Column, draws: int) -> Column:
    """Twice the smaller share of draws on either side of zero, each side counted with one draw more."""
    x = F.col(x) if isinstance(x, str) else x
    side = lambda test: (F.count_if(test) + 1) / F.lit(draws + 1.0)
    return F.least(F.lit(1.0), 2 * F.least(side(x <= 0), side(x >= 0)))


def two_sided_sql(x: str, draws: int) -> str:
    return f"least(1.0, 2 * least((count(*) FILTER (WHERE {x} <= 0) + 1) / {draws + 1}.0, (count(*) FILTER (WHERE {x} >= 0) + 1) / {draws + 1}.0))"


def intervals(stats: DataFrame, by: list[str], x: str, draws: int) -> DataFrame:
    """``by, se, low, high, p`` over the draws."""
    return stats.groupBy(*by).agg(
        F.stddev_samp(x).alias("se"), F.percentile(x, F.lit(0.025)).alias("low"), F.percentile(x, F.lit(0.975)).alias("high"), two_sided(x, draws).alias("p"),
    )


def weight(kind: str, h: Column) -> Column:
    """A random weight of mean 0 and variance 1 from a hash number: signs, or Webb's six points."""
    if kind == "signs":
        return F.when(h % 2 == 0, 1.0).otherwise(-1.0)
    size = reduce(lambda rest, i: F.when((h / 2).cast("long") % 3 == i, WEBB_SQUARES[i] ** 0.5).otherwise(rest), (1, 2), F.lit(WEBB_SQUARES[0] ** 0.5))
    return F.when(h % 2 == 0, size).otherwise(-size)


def weight_sql(kind: str, h: str) -> str:
    size = "1.0" if kind == "signs" else f"(CASE ({h} // 2) % 3 WHEN 0 THEN {WEBB_SQUARES[0] ** 0.5} WHEN 1 THEN {WEBB_SQUARES[1] ** 0.5} ELSE {WEBB_SQUARES[2] ** 0.5} END)"
    return f"(CASE WHEN {h} % 2 = 0 THEN 1.0 ELSE -1.0 END * {size})"


def wild(spark: SparkSession, series: DataFrame, value: str, kind: str, draws: int, seed: str) -> DataFrame:
    """One row: ``p`` of a zero mean, from the t statistics of the centred series under random weights. Fewer than three sessions,
    or one value in all of them, give 1."""
    whole = series.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    seen = whole.select("n", "s", F.abs(F.try_divide("m", "s") * F.sqrt("n")).alias("t"))
    centred = series.select("i", (F.col(value) - F.avg(value).over(W.partitionBy(F.lit(0)))).alias("e"))  # a row a session
    drawn = draws_of(spark, draws).crossJoin(F.broadcast(centred)).withColumn("x", weight(kind, number(seed, F.col("draw"), F.col("i"))) * F.col("e"))
    stats = drawn.groupBy("draw").agg((F.try_divide(F.abs(F.avg("x")), F.stddev_samp("x")) * F.sqrt(F.count("x"))).alias("t_drawn"))
    hits = stats.crossJoin(F.broadcast(seen)).agg(F.count_if(F.col("t_drawn") >= F.col("t")).alias("hits"), F.max("n").alias("n"), F.max("s").alias("s"))
    return hits.select(F.when((F.col("n") < 3) | (F.col("s") == 0), 1.0).otherwise((F.col("hits") + 1) / F.lit(draws + 1.0)).alias("p"))


def superior(means: DataFrame, drawn: DataFrame, n: int, draws: int) -> DataFrame:
    """Whether the best of several models beats a benchmark by more than luck. ``means``: model, mean gain; ``drawn``: draw, model,
    mean gain of the draw. One row: the best model, its gain, the p-values of the studentised test that is centred at models
    not clearly worse, and of the plain reality check. A model's spread is that of its drawn means."""
    spread = drawn.groupBy("model").agg(F.stddev_pop("x").alias("s"))
    about = means.join(spread, "model")
    # far below the benchmark, by the law of the iterated logarithm: such a model says nothing about the null
    from math import log, sqrt

    bound = sqrt(2 * log(log(max(n, 3))))
    about = about.withColumn("centre", F.when(F.col("mean") >= -bound * F.col("s"), F.col("mean")).otherwise(0.0))
    best = about.agg(F.max_by("model", F.struct("mean", "model")).alias("best"), F.max("mean").alias("gain"), F.greatest(F.max(F.try_divide("mean", "s")), F.lit(0.0)).alias("t"))
    tops = drawn.join(F.broadcast(about), "model").groupBy("draw").agg(F.greatest(F.max(F.try_divide(F.col("x") - F.col("centre"), "s")), F.lit(0.0)).alias("student"), F.max(F.col("x") - F.col("mean")).alias("plain"))
    met = tops.crossJoin(F.broadcast(best)).groupBy("best", "gain").agg(F.count_if(F.col("student") >= F.col("t")).alias("a"), F.count_if(F.col("plain") >= F.col("gain")).alias("b"))
    share = lambda c: (F.col(c) + 1) / F.lit(draws + 1.0)
    return met.select("best", "gain", share("a").alias("spa_p"), share("b").alias("reality_p"))


def confidence_set(means: DataFrame, drawn: DataFrame, models: int, draws: int, alpha: float) -> DataFrame:
    """``model, p, kept``: models go, worst first, while equal ability of those left is rejected; p-values never fall along
    the way, and those that stay share the last one. One round a model; ``means`` and ``drawn`` as for ``superior``, of losses."""
    left = means.select("model").withColumns({"p": F.lit(0.0), "out": F.lit(False), "stopped": F.lit(False)})
    for _ in range(models - 1):
        open_ = left.where("not out").select("model")
        all_means = means.join(open_, "model")
        gap = all_means.join(F.broadcast(all_means.agg(F.avg("mean").alias("level"))), F.lit(True)).select("model", (F.col("mean") - F.col("level")).alias("gap"))
        level = drawn.join(F.broadcast(open_), "model").groupBy("draw").agg(F.avg("x").alias("level"))
        off = drawn.join(level, "draw").join(F.broadcast(gap), "model").withColumn("d", F.col("x") - F.col("level") - F.col("gap"))
        se = off.groupBy("model").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("se"))
        t = gap.join(se, "model").withColumn("t", F.when(F.col("se") > 0, F.col("gap") / F.col("se")).otherwise(0.0))
        top = t.agg(F.max("t").alias("top"), F.max_by("model", F.struct("t", "model")).alias("worst"), F.count("*").alias("of"))
        tops = off.join(F.broadcast(se), "model").groupBy("draw").agg(F.max(F.when(F.col("se") > 0, F.col("d") / F.col("se")).otherwise(0.0)).alias("m"))
        test = tops.crossJoin(F.broadcast(top)).groupBy("worst", "of").agg(((F.count_if(F.col("m") >= F.col("top")) + 1) / F.lit(draws + 1.0)).alias("own"))
        met = left.crossJoin(F.broadcast(test))
        p = F.greatest("p", "own")
        going = ~F.col("stopped") & (F.col("of") > 1)
        left = files.stored(met.select(
            "model", F.when(F.col("out") | ~going, F.col("p")).otherwise(p).alias("p"), (F.col("out") | (going & (p < alpha) & (F.col("model") == F.col("worst")))).alias("out"),
            (F.col("stopped") | (going & (p >= alpha))).alias("stopped"),
        ))
    alone = left.where("not out").agg(F.count("*").alias("n"))
    out = left.crossJoin(F.broadcast(alone))
    return out.select("model", F.when(~F.col("out") & (F.col("n") == 1), 1.0).otherwise(F.col("p")).alias("p"), (~F.col("out")).alias("kept"))


def overfitting(sums: DataFrame, parts: int, models: int) -> DataFrame:
    """One row: over all splits of ``parts`` parts into halves, how often the model that is best in one half ranks at or below the
    median in the other. ``sums``: part, model, s, n. Splits are bit masks, dealt over the tasks."""
    spark = sums.sparkSession
    masks = spark.range(1 << parts).where(F.bit_count("id") == parts // 2).withColumnRenamed("id", "mask")
    inside = F.expr("shiftright(mask, part) & 1") == 1
    half = masks.crossJoin(F.broadcast(sums)).groupBy("mask", "model").agg(
        (F.sum(F.when(inside, F.col("s"))) / F.sum(F.when(inside, F.col("n")))).alias("own"), (F.sum(F.when(~inside, F.col("s"))) / F.sum(F.when(~inside, F.col("n")))).alias("other"),
    )
    best = half.groupBy("mask").agg(F.min_by("other", F.struct("own", "model")).alias("chosen"), F.collect_list("other").alias("others"))
    worse, same = F.size(F.filter("others", lambda x: x > F.col("chosen"))), F.size(F.filter("others", lambda x: x == F.col("chosen")))
    rank = worse + (same + 1) / 2
    return best.agg(F.avg(F.when(rank / (models + 1) <= 0.5, 1.0).otherwise(0.0)).alias("pbo"), F.count("*").alias("splits"))


def power(spark: SparkSession, centred: DataFrame, effect: str, n: int, sizes: list[int], draws: int, block: int, seed: str, z: float = 1.6448536269514722) -> DataFrame:
    """``sessions, power, size``: the share of draws of so many sessions, in blocks from a centred series, whose one-sided test
    rejects with and without the effect. ``effect`` is a column of the series, the same in every row."""
    out = []
    for size in sizes:
        drawn = taken(blocks(spark, n, draws, block, f"{seed}{size}", length=size), centred)
        t = drawn.groupBy("draw").agg(F.avg("e").alias("m"), (F.stddev_samp("e") / F.sqrt(F.count("e"))).alias("se"), F.max(F.abs(effect)).alias("effect"))
        out.append(t.agg(F.avg((F.col("m") + F.col("effect") > z * F.col("se")).cast("double")).alias("power"), F.avg((F.col("m") > z * F.col("se")).cast("double")).alias("size")).withColumn("sessions", F.lit(size)))
    return reduce(lambda a, b: a.unionByName(b), out)
