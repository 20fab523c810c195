"""Tests over session series and models by resampling, power, contrasts, and a recursion fitted by likelihood.

Series have one row a session; what is large are the draws, which are rows of tables too.
"""

from __future__ import annotations

from math import log, sqrt
from statistics import NormalDist

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf, normal_cdf_sql, normal_density
from ..operators import evaluate, models
from ..operators import resample as rs
from ..sources import files
from ..sources.tables import tape
from .choice import MODELS, candidates
from .evaluation import _LOSS, _PAIRED, paired
from .registry import TAPE, query, r6, s6
from .windowed import KEYS, returns

DRAWS, BLOCK = 399, 5
_Z = NormalDist()


def series(spark, sf):
    """The daily loss difference with its place, from 0; and how many sessions there are."""
    rows = paired(spark, sf).select("session_date", "difference").withColumn("i", F.row_number().over(W.orderBy("session_date")) - 1)
    rows = files.stored(rows.select("i", "difference"))
    return rows, rows.count()


def losses_by_session(spark, sf):
    """Mean loss by session and model over the hours that all five forecast: i, model, loss; and the sessions."""
    rows = candidates(spark, sf).na.drop(subset=MODELS).unpivot([*KEYS, "bar", "actual"], MODELS, "model", "forecast")
    rows = rows.groupBy("session_date", "model").agg(F.avg(evaluate.qlike(F.col("actual"), F.col("forecast"))).alias("loss"))
    rows = files.stored(rows.withColumn("i", F.dense_rank().over(W.orderBy("session_date")) - 1).select("i", "model", "loss"))
    return rows, rows.select("i").distinct().count()


_SERIES = f"{_PAIRED}, x AS (SELECT row_number() OVER (ORDER BY session_date) - 1 AS i, d FROM daily), size AS (SELECT count(*) AS n FROM x)"
_FIVE = ", ".join(f"('{m}', {m})" for m in MODELS)
_MATRIX = f"""{_LOSS}, c AS (SELECT *, (flat + persist) / 2 AS mixed, avg(actual) OVER (PARTITION BY asset, session_date ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far,
    lag(actual) OVER (PARTITION BY asset, bar ORDER BY session_date) AS yesterday FROM f),
  l AS (SELECT session_date, model, avg(actual / forecast - ln(actual / forecast) - 1) AS loss FROM (SELECT session_date, actual, unnest([{', '.join(f"'{m}'" for m in MODELS)}]) AS model, unnest([{', '.join(MODELS)}]) AS forecast
    FROM c WHERE {' AND '.join(f'{m} IS NOT NULL' for m in MODELS)}) GROUP BY 1, 2),
  m AS (SELECT dense_rank() OVER (ORDER BY session_date) - 1 AS i, model, loss FROM l), size AS (SELECT count(DISTINCT i) AS n FROM m)"""


def _blocks_sql(seed: str, block: int = BLOCK, wraps: bool = True, length: str = "n") -> str:
    start = f"{rs.number_sql(f"'{seed}'", 'draw', 'k')} % ({'n' if wraps else f'n - {block} + 1'})"
    return f"""(SELECT draw, place, (start + place - k * {block}) % n AS i FROM (SELECT draw, place, place // {block} AS k, n, {start} AS start FROM (SELECT draw, place, place // {block} AS k, n FROM size, range({DRAWS}) a(draw), range({length}) b(place))))"""


def _stationary_sql(seed: str) -> str:
    return f"""(SELECT draw, place, (arg_at + place - arg_place) % n AS i FROM (SELECT *, last_value(CASE WHEN fresh THEN begun END IGNORE NULLS) OVER w AS arg_at, last_value(CASE WHEN fresh THEN place END IGNORE NULLS) OVER w AS arg_place
    FROM (SELECT draw, place, n, place = 0 OR {rs.number_sql(f"'{seed}'", "'new'", 'draw', 'place')} * {BLOCK} < {rs.WHOLE} AS fresh, {rs.number_sql(f"'{seed}'", "'start'", 'draw', 'place')} % n AS begun FROM size, range({DRAWS}) a(draw), range(n) b(place))
    WINDOW w AS (PARTITION BY draw ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


_TRIMMED = "avg(d) FILTER (WHERE r > floor(0.05 * n) AND r <= n - floor(0.05 * n))"


def _boot_sql(name: str, places: str) -> str:
    return f"""{name} AS (SELECT '{name}' AS blocks, unnest(['mean', 'median', 'trimmed']) AS statistic, unnest([a, b, c]) AS x FROM (
    SELECT draw, avg(d) AS a, median(d) AS b, {_TRIMMED} AS c FROM (SELECT p.draw, d, row_number() OVER (PARTITION BY p.draw ORDER BY d) AS r, n FROM {places} p JOIN x USING (i), size) GROUP BY draw))"""


_KINDS = {"circular": _blocks_sql("circular"), "moving": _blocks_sql("moving", wraps=False), "stationary": _stationary_sql("stationary")}
_ESTIMATE = f"own AS (SELECT unnest(['mean', 'median', 'trimmed']) AS statistic, unnest([avg(d), median(d), {_TRIMMED}]) AS estimate FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, n FROM x, size))"


@query("bootstraps", f"""WITH {_SERIES}, {', '.join(_boot_sql(k, p) for k, p in _KINDS.items())}, {_ESTIMATE}
  SELECT blocks, statistic, {s6('any_value(estimate)')} AS estimate, {s6('stddev_samp(x)')} AS se, {s6('quantile_cont(x, 0.025)')} AS low, {s6('quantile_cont(x, 0.975)')} AS high, {s6(rs.two_sided_sql('x', DRAWS))} AS p
  FROM ({' UNION ALL '.join(f'SELECT * FROM {k}' for k in _KINDS)}) JOIN own USING (statistic) GROUP BY 1, 2""")
def bootstraps(spark, sf):
    """One series under circular, moving and stationary blocks, and three statistics."""
    x, n = series(spark, sf)
    kinds = {"circular": rs.blocks(spark, n, DRAWS, BLOCK, "circular"), "moving": rs.blocks(spark, n, DRAWS, BLOCK, "moving", wraps=False), "stationary": rs.stationary(spark, n, DRAWS, BLOCK, "stationary")}
    drawn = None
    for name, places in kinds.items():
        one = places.withColumn("blocks", F.lit(name))
        drawn = one if drawn is None else drawn.unionByName(one)
    found = rs.intervals(rs.statistics(rs.taken(drawn, x), ["blocks"], "difference", n), ["blocks", "statistic"], "x", DRAWS)
    own = rs.statistics(x.withColumn("draw", F.lit(0)), [], "difference", n).select("statistic", F.col("x").alias("estimate"))
    return found.join(F.broadcast(own), "statistic").select("blocks", "statistic", *[r6(c).alias(c) for c in ("estimate", "se", "low", "high", "p")])


def _wild_sql(kind: str) -> str:
    return f"""(SELECT '{kind}' AS weights, (count(*) FILTER (WHERE t >= seen) + 1) / {DRAWS + 1}.0 AS p FROM (SELECT draw, abs(avg(v)) / stddev_samp(v) * sqrt(count(*)) AS t FROM (
    SELECT draw, {rs.weight_sql(kind, rs.number_sql(f"'{kind}'", 'draw', 'i'))} * (d - avg(d) OVER (PARTITION BY draw)) AS v FROM x, range({DRAWS}) a(draw)) GROUP BY draw), (SELECT abs(avg(d) / stddev_samp(d) * sqrt(count(*))) AS seen FROM x))"""


@query("wild_bootstraps", f"WITH {_SERIES} SELECT weights, {s6('p')} AS p FROM ({_wild_sql('signs')} UNION ALL {_wild_sql('webb')})")
def wild_bootstraps(spark, sf):
    x, _ = series(spark, sf)
    one = lambda kind: rs.wild(spark, x, "difference", kind, DRAWS, kind).select(F.lit(kind).alias("weights"), r6("p").alias("p"))
    return one("signs").unionByName(one("webb"))


@query("paired_day_gain", f"""WITH {_MATRIX}, b AS (SELECT i, loss AS base FROM m WHERE model = 'flat'), g AS (SELECT draw, model, 1 - avg(loss) / avg(base) AS x FROM {_blocks_sql('days', 1)} p JOIN m USING (i) JOIN b USING (i) WHERE model <> 'flat' GROUP BY 1, 2),
  o AS (SELECT model, 1 - avg(loss) / avg(base) AS gain FROM m JOIN b USING (i) GROUP BY 1) SELECT model, {s6('any_value(gain)')} AS gain, {s6('quantile_cont(x, 0.025)')} AS low, {s6('quantile_cont(x, 0.975)')} AS high, {s6(rs.two_sided_sql('x', DRAWS))} AS p FROM g JOIN o USING (model) GROUP BY 1""")
def paired_day_gain(spark, sf):
    """Relative gain of each model on the flat line when whole days are drawn, both losses of a day together."""
    m, n = losses_by_session(spark, sf)
    both = m.where("model <> 'flat'").join(F.broadcast(m.where("model = 'flat'").select("i", F.col("loss").alias("base"))), "i")
    gain = 1 - F.avg("loss") / F.avg("base")
    found = rs.intervals(rs.taken(rs.blocks(spark, n, DRAWS, 1, "days"), both).groupBy("draw", "model").agg(gain.alias("x")), ["model"], "x", DRAWS)
    return found.join(F.broadcast(both.groupBy("model").agg(gain.alias("gain"))), "model").select("model", *[r6(c).alias(c) for c in ("gain", "low", "high", "p")])


_GAINS = f"{_MATRIX}, b AS (SELECT i, loss AS base FROM m WHERE model = 'flat'), g AS (SELECT i, model, base - loss AS gain FROM m JOIN b USING (i) WHERE model <> 'flat')"


@query("superior_ability", f"""WITH {_GAINS}, d AS (SELECT draw, model, avg(gain) AS x FROM {_stationary_sql('ability')} p JOIN g USING (i) GROUP BY 1, 2), k AS (SELECT model, avg(gain) AS mean FROM g GROUP BY 1), s AS (SELECT model, stddev_pop(x) AS s FROM d GROUP BY 1),
  a AS (SELECT model, mean, s, CASE WHEN mean >= -sqrt(2 * ln(ln(n))) * s THEN mean ELSE 0.0 END AS centre FROM k JOIN s USING (model), size), t AS (SELECT max_by(model, mean) AS best, max(mean) AS gain, greatest(max(mean / s), 0.0) AS t FROM a),
  v AS (SELECT draw, greatest(max((x - centre) / s), 0.0) AS student, max(x - mean) AS plain FROM d JOIN a USING (model) GROUP BY 1)
  SELECT best, {s6('gain')} AS gain, {s6(f'(count(*) FILTER (WHERE student >= t) + 1) / {DRAWS + 1}.0')} AS spa_p, {s6(f'(count(*) FILTER (WHERE plain >= gain) + 1) / {DRAWS + 1}.0')} AS reality_p FROM v, t GROUP BY best, gain""")
def superior_ability(spark, sf):
    """Each model against the flat line: loss of the benchmark less the model's, so that a gain is positive."""
    m, n = losses_by_session(spark, sf)
    base = m.where("model = 'flat'").select("i", F.col("loss").alias("base"))
    gains = m.where("model <> 'flat'").join(F.broadcast(base), "i").select("i", "model", (F.col("base") - F.col("loss")).alias("gain"))
    drawn = files.stored(rs.taken(rs.stationary(spark, n, DRAWS, BLOCK, "ability"), gains).groupBy("draw", "model").agg(F.avg("gain").alias("x")))
    means = gains.groupBy("model").agg(F.avg("gain").alias("mean"))
    return rs.superior(means, drawn, n, DRAWS).select("best", *[r6(c).alias(c) for c in ("gain", "spa_p", "reality_p")])


def _set_sql(alpha: float) -> str:
    steps = ["l0 AS (SELECT model, 0.0::DOUBLE AS p, false AS out, false AS stopped FROM k)"]
    for r in range(len(MODELS) - 1):
        steps.append(f"""o{r} AS (SELECT model, mean - avg(mean) OVER () AS gap FROM k JOIN l{r} USING (model) WHERE NOT out),
  e{r} AS (SELECT draw, model, x - avg(x) OVER (PARTITION BY draw) - gap AS d FROM d JOIN o{r} USING (model)), s{r} AS (SELECT model, sqrt(avg(d * d)) AS se FROM e{r} GROUP BY 1),
  t{r} AS (SELECT max(gap / se) AS top, max_by(model, gap / se) AS worst, count(*) AS n_open FROM o{r} JOIN s{r} USING (model)), h{r} AS (SELECT draw, max(d / se) AS m FROM e{r} JOIN s{r} USING (model) GROUP BY 1),
  q{r} AS (SELECT worst, n_open, (count(*) FILTER (WHERE m >= top) + 1) / {DRAWS + 1}.0 AS own FROM h{r}, t{r} GROUP BY 1, 2),
  l{r + 1} AS (SELECT model, CASE WHEN out OR stopped OR n_open = 1 THEN p ELSE greatest(p, own) END AS p, out OR (NOT stopped AND n_open > 1 AND greatest(p, own) < {alpha} AND model = worst) AS out,
    stopped OR (n_open > 1 AND greatest(p, own) >= {alpha}) AS stopped FROM l{r}, q{r})""")
    last = len(MODELS) - 1
    return f"""WITH {_MATRIX}, k AS (SELECT model, avg(loss) AS mean FROM m GROUP BY 1), d AS MATERIALIZED (SELECT draw, model, avg(loss) AS x FROM {_blocks_sql('set')} p JOIN m USING (i) GROUP BY 1, 2), {', '.join(steps)}
  SELECT model, {s6(f"CASE WHEN NOT out AND (SELECT count(*) FROM l{last} WHERE NOT out) = 1 THEN 1.0 ELSE p END")} AS p, NOT out AS kept FROM l{last}"""


@query("model_confidence_set", _set_sql(0.1))
def model_confidence_set(spark, sf):
    m, n = losses_by_session(spark, sf)
    drawn = files.stored(rs.taken(rs.blocks(spark, n, DRAWS, BLOCK, "set"), m).groupBy("draw", "model").agg(F.avg("loss").alias("x")))
    means = files.stored(m.groupBy("model").agg(F.avg("loss").alias("mean")))
    return rs.confidence_set(means, drawn, len(MODELS), DRAWS, 0.1).withColumn("p", r6("p"))


_PARTS = 12


@query("overfitting_probability", f"""WITH {_MATRIX}, q AS (SELECT i, ntile({_PARTS}) OVER (ORDER BY i) - 1 AS part FROM (SELECT DISTINCT i FROM m)), s AS (SELECT part, model, sum(loss) AS s, count(*) AS n FROM m JOIN q USING (i) GROUP BY 1, 2),
  h AS (SELECT mask, model, sum(s) FILTER (WHERE (mask >> part) & 1 = 1) / sum(n) FILTER (WHERE (mask >> part) & 1 = 1) AS own, sum(s) FILTER (WHERE (mask >> part) & 1 = 0) / sum(n) FILTER (WHERE (mask >> part) & 1 = 0) AS other
    FROM (SELECT mask FROM range({1 << _PARTS}) r(mask) WHERE bit_count(mask) = {_PARTS // 2}), s GROUP BY 1, 2),
  b AS (SELECT mask, min_by(other, own) AS chosen FROM h GROUP BY 1), r AS (SELECT mask, count(*) FILTER (WHERE other > chosen) + (count(*) FILTER (WHERE other = chosen) + 1) / 2.0 AS rank FROM h JOIN b USING (mask) GROUP BY 1)
  SELECT {s6(f'avg(CASE WHEN rank / {len(MODELS) + 1} <= 0.5 THEN 1.0 ELSE 0.0 END)')} AS pbo, count(*) AS splits FROM r""")
def overfitting_probability(spark, sf):
    """Probability of backtest overfitting over all balanced splits of the sessions into halves of twelve parts."""
    m, _ = losses_by_session(spark, sf)
    parts = m.select("i").distinct().withColumn("part", F.ntile(_PARTS).over(W.orderBy("i")) - 1)
    sums = files.stored(m.join(F.broadcast(parts), "i").groupBy("part", "model").agg(F.sum("loss").alias("s"), F.count("*").alias("n")))
    return rs.overfitting(sums, _PARTS, len(MODELS)).withColumn("pbo", r6("pbo"))


@query("conditional_ability", f"""WITH {_SERIES}, z AS (SELECT d, lag(d) OVER (ORDER BY i) AS h FROM x), k AS (SELECT * FROM z WHERE h IS NOT NULL), b AS (SELECT regr_slope(d, h) AS b, regr_intercept(d, h) AS a FROM k),
  e AS (SELECT d, h, (d - a - b * h) ** 2 AS e FROM k, b), s AS (SELECT count(*) AS sessions, sum(d) AS s0, sum(d * h) AS s1, sum(e) AS m00, sum(e * h) AS m01, sum(e * h * h) AS m11 FROM e),
  w AS (SELECT sessions, (s0 * s0 * m11 - 2 * s0 * s1 * m01 + s1 * s1 * m00) / (m00 * m11 - m01 * m01) AS wald FROM s) SELECT {s6('wald')} AS wald, {s6('exp(-wald / 2)')} AS p, sessions FROM w""")
def conditional_ability(spark, sf):
    """Whether the loss difference of a session can be told from that of the one before: a robust Wald statistic of both coefficients,
    from sums; the chi-square tail of two restrictions is exp(-w / 2)."""
    x, _ = series(spark, sf)
    return evaluate.conditional_wald(x.withColumn("h", F.lag("difference").over(W.orderBy("i"))).where("h is not null"), "difference", "h").select(r6("wald").alias("wald"), r6("p").alias("p"), "sessions")


_MDE = _Z.inv_cdf(0.975) + _Z.inv_cdf(0.8)
_NW = "v AS (SELECT count(*) AS n, avg(d) AS mean, greatest(sum(e * e) + " + " + ".join(f"2 * {1 - k / 6} * sum(e * e{k})" for k in range(1, 6)) + ", 0.0) AS v FROM (SELECT d, e, " + ", ".join(f"lag(e, {k}) OVER (ORDER BY i) AS e{k}" for k in range(1, 6)) + " FROM (SELECT i, d, d - avg(d) OVER () AS e FROM x)))"


@query("session_contrast", f"""WITH {_SERIES}, {_boot_sql('contrast', _blocks_sql('contrast'))}, {_NW}, base AS (SELECT 0.05 * avg(qlike) AS margin FROM loss WHERE model = 'flat'),
  q AS (SELECT quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high, {rs.two_sided_sql('x', DRAWS)} AS p FROM contrast WHERE statistic = 'mean'), w AS {_wild_sql('signs')}
  SELECT {s6('mean')} AS estimate, {s6('low')} AS low, {s6('high')} AS high, {s6('q.p')} AS p, {s6('w.p')} AS wild_p, {s6(f'{_MDE} * sqrt(v) / n')} AS mde, n AS sessions, {s6('margin')} AS margin, low > -margin AND high < margin AS equivalent FROM v, q, w, base""")
def session_contrast(spark, sf):
    """The record of one contrast: estimate, interval, two p-values, the smallest effect it could find, and whether the interval
    lies inside a margin of a twentieth of the base loss."""
    from .evaluation import losses

    x, n = series(spark, sf)
    drawn = rs.statistics(rs.taken(rs.blocks(spark, n, DRAWS, BLOCK, "contrast"), x), [], "difference", n).where("statistic = 'mean'")
    found = rs.intervals(drawn, [], "x", DRAWS)
    whole = evaluate.newey_west(x, "i", "difference", 5).select(F.col("mean").alias("estimate"), (F.lit(_MDE) * F.col("se")).alias("mde"), F.col("n").alias("sessions"))
    margin = losses(spark, sf).where("model = 'flat'").agg((0.05 * F.avg("qlike")).alias("margin"))
    wild = rs.wild(spark, x, "difference", "signs", DRAWS, "signs").withColumnRenamed("p", "wild_p")
    row = whole.crossJoin(found).crossJoin(margin).crossJoin(wild)  # one row each
    inside = (F.col("low") > -F.col("margin")) & (F.col("high") < F.col("margin"))
    return row.select(*[r6(c).alias(c) for c in ("estimate", "low", "high", "p", "wild_p", "mde")], "sessions", r6("margin").alias("margin"), inside.alias("equivalent"))


@query("fixed_sequence", f"""WITH {_GAINS}, d AS (SELECT draw, model, avg(gain) AS x FROM {_blocks_sql('sequence')} p JOIN g USING (i) GROUP BY 1, 2), e AS (SELECT model, avg(gain) AS estimate FROM g GROUP BY 1),
  p AS (SELECT model, {rs.two_sided_sql('x', DRAWS)} AS p FROM d GROUP BY 1), o AS (SELECT model, estimate, p, list_position([{', '.join(f"'{m}'" for m in MODELS)}], model) AS step FROM e JOIN p USING (model)),
  r AS (SELECT *, estimate > 0 AND p <= 0.05 AS rejected, row_number() OVER (ORDER BY p, model) AS i, count(*) OVER () AS n FROM o), v AS (SELECT *, coalesce(min(rejected::INTEGER) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS open FROM r)
  SELECT model, step::INTEGER AS step, {s6('estimate')} AS estimate, {s6('p')} AS p, CASE WHEN open = 0 THEN 'NOT_TESTED' WHEN rejected THEN 'REJECTED' ELSE 'NOT_REJECTED' END AS state, {s6('least(1.0, max((n - i + 1) * p) OVER (ORDER BY i))')} AS adjusted FROM v""")
def fixed_sequence(spark, sf):
    """Ordered hypotheses, each tested only while all before it were rejected in the expected direction; beside it Holm's adjustment."""
    m, n = losses_by_session(spark, sf)
    base = m.where("model = 'flat'").select("i", F.col("loss").alias("base"))
    gains = m.where("model <> 'flat'").join(F.broadcast(base), "i").select("i", "model", (F.col("base") - F.col("loss")).alias("gain"))
    drawn = rs.taken(rs.blocks(spark, n, DRAWS, BLOCK, "sequence"), gains).groupBy("draw", "model").agg(F.avg("gain").alias("x"))
    steps = rs.intervals(drawn, ["model"], "x", DRAWS).select("model", "p").join(gains.groupBy("model").agg(F.avg("gain").alias("estimate")), "model")
    steps = steps.withColumn("step", F.array_position(F.array(*map(F.lit, MODELS)), F.col("model")).cast("int"))
    rejected = (F.col("estimate") > 0) & (F.col("p") <= 0.05)
    before = F.min(rejected.cast("int")).over(W.orderBy("step").rowsBetween(W.unboundedPreceding, -1))  # a row a hypothesis
    steps = steps.withColumn("open", F.coalesce(before, F.lit(1))).withColumn("state", F.when(F.col("open") == 0, "NOT_TESTED").when(rejected, "REJECTED").otherwise("NOT_REJECTED"))
    steps = evaluate.holm(steps.withColumn("family", F.lit("all")), ["family"], "p")
    return steps.select("model", "step", r6("estimate").alias("estimate"), r6("p").alias("p"), "state", r6("adjusted").alias("adjusted"))


_SIZES = (30, 60, 120)
#: What the best of four trials leads by through luck, in standard errors, at most.
_LUCK = sqrt(2 * log(4))
_ERRORS = {"a": normal_cdf_sql("t - 1.959963984540054"), "b": normal_cdf_sql("-1.959963984540054 - t"), "m": "(exp(-((t - 1.959963984540054) ** 2) / 2) + exp(-((t + 1.959963984540054) ** 2) / 2)) / 2.5066282746310002"}


def _power_sql(size: int) -> str:
    return f"""SELECT {size} AS sessions, avg(CASE WHEN m + effect > 1.6448536269514722 * se THEN 1.0 ELSE 0.0 END) AS power, avg(CASE WHEN m > 1.6448536269514722 * se THEN 1.0 ELSE 0.0 END) AS size
    FROM (SELECT draw, avg(e) AS m, stddev_samp(e) / sqrt(count(*)) AS se, max(abs(effect)) AS effect FROM {_blocks_sql(f'power{size}', length=str(size))} p JOIN c USING (i) GROUP BY 1)"""


@query("power_study", f"""WITH {_SERIES}, w AS (SELECT avg(d) AS mean, stddev_samp(d) / sqrt(count(*)) AS se FROM x), fx AS (SELECT mean, se, abs(mean) / se AS t, sign(mean) * greatest(abs(mean) - {_LUCK} * se, 0.0) AS effect FROM w),
  c AS (SELECT i, d - mean AS e, mean AS effect FROM x, fx), g AS ({' UNION ALL '.join(_power_sql(k) for k in _SIZES)}), q AS (SELECT effect, t, {_ERRORS['a']} AS right_sign, {_ERRORS['b']} AS wrong, {_ERRORS['m']} AS bump FROM fx)
  SELECT sessions::INTEGER AS sessions, {s6('power')} AS power, {s6('size')} AS size, {s6('effect')} AS effect, {s6('right_sign + wrong')} AS power_now, {s6('wrong / (right_sign + wrong)')} AS wrong_sign, {s6('(right_sign - wrong + bump / t) / (right_sign + wrong)')} AS exaggeration FROM g, q""")
def power_study(spark, sf):
    """Power by the number of sessions, drawn in blocks from the centred series with its own mean for the effect; the effect less what
    the best of four trials leads by through luck; power now, the chance that a significant estimate has the wrong sign, and by how much one
    exaggerates on average."""
    x, n = series(spark, sf)
    se = F.stddev_samp("difference") / F.sqrt(F.count("difference"))
    whole = x.agg(F.avg("difference").alias("effect"), se.alias("se"))
    centred = x.crossJoin(F.broadcast(whole)).select("i", (F.col("difference") - F.col("effect")).alias("e"), "effect")
    t = F.abs("effect") / F.col("se")
    right, wrong = normal_cdf(t - 1.959963984540054), normal_cdf(-1.959963984540054 - t)
    bump = normal_density(t - 1.959963984540054) + normal_density(t + 1.959963984540054)
    errors = whole.select((F.signum("effect") * F.greatest(F.abs("effect") - _LUCK * F.col("se"), F.lit(0.0))).alias("shrunk"), (right + wrong).alias("power_now"), (wrong / (right + wrong)).alias("wrong_sign"), ((right - wrong + F.try_divide(bump, t)) / (right + wrong)).alias("exaggeration"))
    found = rs.power(spark, files.stored(centred), "effect", n, list(_SIZES), DRAWS, BLOCK, "power").crossJoin(F.broadcast(errors))
    return found.select("sessions", r6("power").alias("power"), r6("size").alias("size"), r6("shrunk").alias("effect"), r6("power_now").alias("power_now"), r6("wrong_sign").alias("wrong_sign"), r6("exaggeration").alias("exaggeration"))


@query("effect_posterior", f"""WITH {_SERIES}, w AS (SELECT avg(d) AS m, var_samp(d) / count(*) AS v FROM x), p AS (SELECT m * 0.25 / (0.25 + v) AS mean, sqrt(0.25 * v / (0.25 + v)) AS se FROM w) SELECT {s6('mean')} AS mean, {s6('se')} AS se, {s6(normal_cdf_sql('mean / se'))} AS positive FROM p""")
def effect_posterior(spark, sf):
    """Normal posterior of the mean difference under a prior of half a unit around zero, and its chance of being positive."""
    x, _ = series(spark, sf)
    v = x.agg(F.avg("difference").alias("m"), (F.var_samp("difference") / F.count("difference")).alias("v"))
    p = v.select((F.col("m") * 0.25 / (0.25 + F.col("v"))).alias("mean"), F.sqrt(0.25 * F.col("v") / (0.25 + F.col("v"))).alias("se"))
    return p.select(r6("mean").alias("mean"), r6("se").alias("se"), r6(normal_cdf(F.col("mean") / F.col("se"))).alias("positive"))


@query("alpha_spending", f"""WITH {_PAIRED}, k AS (SELECT session_date, sum(n) OVER (ORDER BY session_date) / sum(n) OVER () AS t, row_number() OVER (ORDER BY session_date) AS look FROM daily), s AS (SELECT *, 0.05 * ln(1 + (exp(1) - 1) * t) AS spent FROM k)
  SELECT look, {s6('t')} AS information, {s6('spent')} AS spent, {s6('spent - coalesce(lag(spent) OVER (ORDER BY look), 0.0)')} AS step FROM s""")
def alpha_spending(spark, sf):
    """Error spent by a test that looks after every session, by the share of origins seen so far."""
    order = W.orderBy("session_date")  # a row a session
    k = paired(spark, sf).withColumn("t", F.sum("origins").over(order) / F.sum("origins").over(W.partitionBy(F.lit(0)))).withColumn("look", F.row_number().over(order).cast("long"))
    k = k.withColumn("spent", evaluate.spending(F.col("t"), 0.05))
    return k.select("look", r6("t").alias("information"), r6("spent").alias("spent"), r6(F.col("spent") - F.coalesce(F.lag("spent").over(order), F.lit(0.0))).alias("step"))


@query("e_values", f"""WITH {_PAIRED}, sg AS (SELECT session_date, d, CASE WHEN d > 0 THEN 1 WHEN d < 0 THEN -1 ELSE 0 END AS s FROM daily), stake AS (SELECT unnest([0.1, 0.3, 0.5]) AS bet),
  e AS (SELECT session_date, avg(g) AS e FROM (SELECT session_date, exp(sum(ln(1 + bet * s)) OVER (PARTITION BY bet ORDER BY session_date)) AS g FROM sg, stake) GROUP BY 1) SELECT session_date, {s6('e')} AS e_value, {s6('least(1.0, 1 / max(e) OVER (ORDER BY session_date))')} AS p, max(e) OVER (ORDER BY session_date) >= 20 AS rejected FROM e""", dates=["session_date"])
def e_values(spark, sf):
    """Evidence against differences as often below zero as above: wealth of bets on the sign, a mixture of three stakes, session
    by session; it rejects at a twentieth once wealth has passed 20, whenever one looks."""
    return evaluate.sign_evidence(paired(spark, sf), "session_date", "difference", [0.1, 0.3, 0.5], 0.05).select("session_date", r6("e_value").alias("e_value"), r6("p").alias("p"), "rejected")


@query("trend_forecast", f"""WITH {TAPE}, d AS (SELECT asset, session_date, sum(premium) AS y, row_number() OVER (PARTITION BY asset ORDER BY session_date) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM tape GROUP BY 1, 2),
  c AS (SELECT asset, i, n, y, i - (n - 1) / 2.0 AS x, y - avg(y) OVER (PARTITION BY asset) AS e FROM d), b AS (SELECT asset, n, avg(y) AS level, sum(x * y) / sum(x * x) AS slope, sum(x * x) AS xx FROM c GROUP BY 1, 2),
  w AS (SELECT asset, draw, abs(sum((CASE WHEN {rs.number_sql("'trend'", 'draw', 'i')} % 2 = 0 THEN 1.0 ELSE -1.0 END) * e * x)) AS s FROM c, range({DRAWS}) r(draw) GROUP BY 1, 2),
  p AS (SELECT asset, (count(*) FILTER (WHERE s / xx >= abs(slope)) + 1) / {DRAWS + 1}.0 AS p FROM w JOIN b USING (asset) GROUP BY 1)
  SELECT asset, {s6('slope')} AS slope, {s6('p')} AS p, step::INTEGER AS step, {s6('level + slope * (n - 1 + step - (n - 1) / 2.0)')} AS forecast FROM b JOIN p USING (asset), range(1, 11) a(step)""")
def trend_forecast(spark, sf):
    """A trend over sessions by asset, its p-value under random signs of the centred series, and the next ten sessions."""
    d = files.stored(tape(spark, sf).groupBy(*KEYS).agg(F.sum("premium").alias("y")))
    return models.trend(d, "asset", "session_date", "y", DRAWS, 10).select("asset", r6("slope").alias("slope"), r6("p").alias("p"), "step", r6("forecast").alias("forecast"))


@query("garch_fit")
def garch_fit(spark, sf):
    """Parameters by asset from all its returns; the likelihood of all pairs of a grid is worked out session by session at once, and the
    grid drawn closer about the best."""
    rows = returns(spark, sf).where("r is not null").select(*KEYS, "bar", "r")
    return models.garch_fit(rows, "asset", "session_date", "bar", "r")
