"""Learners that pass over the rows once a round: boosting on ratio losses, quantiles by consensus, jumps, a small network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import evaluate, learners
from .evaluation import forecasts
from .registry import query

_FEATURES = ["persist", "flat", "before"]


def featured(spark, sf):
    """Hourly totals with the hour's own level, the total before and the one before that; whole sessions are held out."""
    from pyspark.sql import Window as W

    from .windowed import KEYS

    rows = forecasts(spark, sf).withColumn("before", F.lag("actual", 2).over(W.partitionBy(*KEYS).orderBy("bar")))
    return rows.where("before is not null and actual > 0").withColumn("held", (F.dayofmonth("session_date") % 5 == 0).cast("int"))


@query("ratio_boosting")
def ratio_boosting(spark, sf):
    """Trees boosted on squared error, QLIKE and gamma deviance, each stopped by held-out sessions, and what they give there:
    forecasts are columns over the features."""
    from ..sources import files

    rows = files.stored(featured(spark, sf))
    out = []
    for loss in learners.LOSSES:
        model = learners.boost(rows, _FEATURES, "actual", loss, held_out="held", rounds=20)
        scored = rows.where("held = 1").withColumn("forecast", F.greatest(model.score(), F.lit(1e-3)))
        value = scored.agg(F.count("*").alias("n"), F.avg(evaluate.qlike(F.col("actual"), F.col("forecast"))).alias("qlike"), F.sqrt(F.avg((F.col("actual") - F.col("forecast")) ** 2)).alias("rmse"))
        out.append(value.withColumns({"loss": F.lit(loss), "trees": F.lit(len(model.trees))}))
    return reduce(lambda a, b: a.unionByName(b), out).select("loss", "trees", "n", "qlike", "rmse")


@query("pinball_consensus")
def pinball_consensus(spark, sf):
    """Linear quantiles of the hourly total at three levels, found by blocks that come to agree."""
    found = learners.pinball(featured(spark, sf), _FEATURES[:2], "actual", [0.1, 0.5, 0.9], l2=1.0)
    rows = [(c.quantile, name, float(w), c.rounds, c.converged) for c in found for name, w in zip(["intercept", *_FEATURES[:2]], c.weights, strict=True)]
    return spark.createDataFrame(rows, "quantile double, feature string, weight double, rounds int, converged boolean")


@query("jump_logistic")
def jump_logistic(spark, sf):
    """Whether a total doubles on the one before, by logistic regression; three weights and their rounds."""
    rows = featured(spark, sf).withColumn("jump", (F.col("actual") > 2 * F.col("persist")).cast("int")).withColumn("size", F.log("persist")).withColumn("hour", F.col("bar") / 24)
    weights, rounds = learners.logistic(rows, ["size", "hour"], "jump", l2=1.0)
    return spark.createDataFrame([(n, float(w), rounds) for n, w in zip(["intercept", "size", "hour"], weights, strict=True)], "feature string, weight double, rounds int")


@query("network_forecast")
def network_forecast(spark, sf):
    """A small network on the logarithm of the total, its forecasts as one column; loss before and after, by held-out session or not."""
    rows = featured(spark, sf).withColumns({"y": F.log("actual"), "p": F.log("persist"), "b": F.log("before")})
    model = learners.network(rows.where("held = 0"), ["p", "b", "flat"], "y", rounds=30)
    gap = F.col("y") - model.score()
    done = rows.groupBy("held").agg(F.count("*").alias("n"), F.avg(gap * gap).alias("mse"), F.var_pop("y").alias("variance"))
    return done.withColumns({"first_loss": F.lit(model.history[0]), "last_loss": F.lit(model.history[-1])})
