"""Per-trade channels of an option tape, and the record of trailing windows over two clocks."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf_sql
from ..operators import prefix
from ..sources import files
from ..sources.tables import tape
from .registry import BARS, query
from .windowed import KEYS, bars

HOUR = 3_600_000_000
DELAY = 120_000_000
WIDTHS = {"short": HOUR, "long": 6 * HOUR}
#: Scale of the decaying activity: half an hour.
DECAY = 1_800_000_000
#: What the synthetic tape leaves out of an option print, as expressions that both engines read, each over those above it.
#: A contract is (asset, session, strike of ten, side); its running total of combined size rises at noon.
PRINT = {
    "size": "1.0 + seq % 10", "k": "50.0 + strike - strike % 10",
    "days": "CASE (strike - strike % 10) % 50 WHEN 0 THEN 0 WHEN 10 THEN 1 WHEN 20 THEN 7 WHEN 30 THEN 30 ELSE 60 END",
    "iv": "0.1 + (seq * 31 % 100) / 250.0", "mid": "premium / (1.0 + seq % 10)", "combined": "CASE WHEN created_us - session_us >= 43200000000 THEN 3.0 ELSE 0.0 END",
    "side": "CASE strike % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END", "sweep": "seq % 11 = 0", "spot": "90.0 + mark % 20.0",
}
_MORE = {
    "spread": "0.01 * (1 + seq % 7) / greatest(mid, 0.000000001)",
    "years": "(session_us + (days * 24 + 20) * 3600000000.0 - executed_us) / 31536000000000.0",
}
#: Against the print before of the same contract, 0 for its first.
_AGAINST = {
    "d_iv": "coalesce(iv - iv_before, 0.0)", "d_mid": "coalesce((mid - mid_before) / greatest(mid_before, 0.000000001), 0.0)", "d_spread": "coalesce(spread - spread_before, 0.0)",
    "has_previous": "CASE WHEN iv_before IS NULL THEN 0.0 ELSE 1.0 END", "legs": "least(greatest(coalesce(combined - combined_before, 0.0), 0.0), size)",
}
_GREEK = {
    "direction_of": "CASE WHEN legs > 0 THEN 0.0 ELSE 1.0 * side END", "d1": "(ln(spot / k) + 0.5 * iv * iv * years) / (iv * sqrt(years))",
}
_DENSITY = "exp(-d1 * d1 / 2) / 2.5066282746310002"
_RISK = {
    "vega": f"spot * {_DENSITY} * sqrt(years) * size * 100", "gamma": f"{_DENSITY} / (spot * iv * sqrt(years)) * size * 100 * spot * spot",
    "delta": f"({normal_cdf_sql('d1')} - CASE WHEN is_call THEN 0.0 ELSE 1.0 END) * size * 100 * spot",
}
#: The channels, and the parts of one that their whole numbers count: flows of risk in hundredths, all others in millionths.
CHANNELS = {
    "trades": "1.0", "size": "size", "premium": "premium", "vega_flow": "vega * direction_of", "gamma_flow": "gamma * direction_of", "delta_flow": "delta * direction_of", "vega_flow_abs": "vega",
    "vega_flow_call": "CASE WHEN is_call THEN vega * direction_of ELSE 0.0 END", "vega_flow_put": "CASE WHEN is_call THEN 0.0 ELSE vega * direction_of END",
    "vega_flow_short": "CASE WHEN years <= 7.0 / 365 THEN vega * direction_of ELSE 0.0 END", "vega_flow_long": "CASE WHEN years > 30.0 / 365 THEN vega * direction_of ELSE 0.0 END",
    "zero_day_premium": "CASE WHEN days = 0 THEN premium ELSE 0.0 END", "zero_day_signed": "CASE WHEN days = 0 THEN premium * direction_of ELSE 0.0 END", "zero_day_trades": "CASE WHEN days = 0 THEN 1.0 ELSE 0.0 END",
    "out_premium": "CASE WHEN (is_call AND ln(k / spot) > 0.05) OR (NOT is_call AND ln(k / spot) < -0.05) THEN premium ELSE 0.0 END",
    "buy_premium": "CASE WHEN direction_of > 0 THEN premium ELSE 0.0 END", "sell_premium": "CASE WHEN direction_of < 0 THEN premium ELSE 0.0 END", "passive_premium": "CASE WHEN direction_of = 0 THEN premium ELSE 0.0 END",
    "sweep_premium": "CASE WHEN sweep THEN premium ELSE 0.0 END", "leg_size": "legs", "leg_premium": "CASE WHEN legs > 0 THEN premium ELSE 0.0 END",
    "d_iv": "d_iv", "d_mid": "d_mid", "d_spread": "d_spread", "has_previous": "has_previous",
    "age": "(created_us - session_us) / 1000000.0", "lag": "(created_us - executed_us) / 1000000.0", "late": "CASE WHEN created_us - executed_us > 60000000 THEN 1.0 ELSE 0.0 END",
}
_SCALE = {c: 100 if c.startswith(("vega", "gamma", "delta")) else 1_000_000 for c in CHANNELS}


def _doubles(columns: dict[str, str]) -> dict[str, str]:
    """The expressions with their fractions as doubles: as decimals the engines would cut them differently."""
    return {n: re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", e) for n, e in columns.items()}


PRINT, _MORE, _AGAINST, _GREEK, _RISK, CHANNELS = map(_doubles, (PRINT, _MORE, _AGAINST, _GREEK, _RISK, CHANNELS))


def _whole(expression: str, scale: int) -> str:
    """The nearest whole number of parts; what lies half between goes up, and a hair below half too, so that the last bit
    of a quotient does not decide."""
    return f"CAST(floor(({expression}) * {scale} + 0.501e0) AS BIGINT)"


_ADDED = {c: _whole(e, _SCALE[c]) for c, e in CHANNELS.items()}
_BEFORE = ("iv", "mid", "spread", "combined")


def prints(spark, sf):
    """In-session trades with the marks of the bar before, what each changed in its contract, and ``ch_``, the channels in
    whole parts. The one shuffle of trades is by contract; marks are joined by bar."""
    b = bars(spark, sf).where("bar between 8 and 19")
    t = tape(spark, sf).withColumn("bar", F.hour("executed_at")).where("bar between 8 and 19")
    t = t.join(b.select(*KEYS, (F.col("bar") + 1).alias("bar"), F.col("close").alias("before")), [*KEYS, "bar"], "left").join(b.select(*KEYS, "bar", "open"), [*KEYS, "bar"])
    t = t.withColumn("mark", F.coalesce("before", "open")).where("mark > 0").withColumn("session_us", F.unix_micros(F.col("session_date").cast("timestamp")))
    for layer in (PRINT, _MORE):
        t = t.select("*", *[F.expr(e).alias(n) for n, e in layer.items()])
    of = W.partitionBy(*KEYS, "k", "is_call").orderBy("created_us", "seq")
    t = t.select("*", *[F.lag(c).over(of).alias(f"{c}_before") for c in _BEFORE])
    for layer in (_AGAINST, _GREEK, _RISK):
        t = t.select("*", *[F.expr(e).alias(n) for n, e in layer.items()])
    return t.select("seq", *KEYS, "session_us", "executed_us", "created_us", "k", "days", "is_call", *[F.expr(e).alias(f"ch_{c}") for c, e in _ADDED.items()])


def _layer(columns: dict[str, str], name: str, of: str) -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {of})"


_LAGS = ", ".join(f"lag({c}) OVER w AS {c}_before" for c in _BEFORE)
_PRINTS = f"""{BARS}, i AS (SELECT *, hour(executed_at) AS bar FROM tape WHERE hour(executed_at) BETWEEN 8 AND 19),
p0 AS (
  SELECT i.* EXCLUDE (bar), coalesce(b.close, o.open) AS mark, epoch_us(i.session_date::TIMESTAMP) AS session_us
  FROM i LEFT JOIN bars b ON b.asset = i.asset AND b.session_date = i.session_date AND b.bar = i.bar - 1 AND b.bar >= 8
    JOIN bars o ON o.asset = i.asset AND o.session_date = i.session_date AND o.bar = i.bar WHERE coalesce(b.close, o.open) > 0),
{_layer(PRINT, 'p1', 'p0')}, {_layer(_MORE, 'p2', 'p1')},
p3 AS (SELECT *, {_LAGS} FROM p2 WINDOW w AS (PARTITION BY asset, session_date, k, is_call ORDER BY created_us, seq)),
{_layer(_AGAINST, 'p4', 'p3')}, {_layer(_GREEK, 'p5', 'p4')}, {_layer(_RISK, 'p6', 'p5')},
print AS MATERIALIZED (SELECT seq, asset, session_date, session_us, executed_us, created_us, k, days, is_call, {', '.join(f'{e} AS ch_{c}' for c, e in _ADDED.items())} FROM p6)"""


@query("trade_channels", f"WITH {_PRINTS} SELECT seq, {', '.join(f'ch_{c} / {_SCALE[c]}.0 AS ch_{c}' for c in CHANNELS)} FROM print")
def trade_channels(spark, sf):
    """28 channels a trade: counts, flows of risk by direction and tenor, premium by kind, legs, changes within the contract, clocks."""
    return prints(spark, sf).select("seq", *[(F.col(f"ch_{c}") / F.lit(float(_SCALE[c]))).alias(f"ch_{c}") for c in CHANNELS])


#: The record, over the sums of the channels in their own units (``ch_``) and a window's further numbers.
_SHARE = "greatest(ch_premium, 0.000000001)"
RECORD = {
    "trades": "ch_trades", "contracts": "1.0 * contracts", "size": "ch_size", "premium": "ch_premium", **{c: f"ch_{c}" for c in ("vega_flow", "gamma_flow", "delta_flow", "vega_flow_abs")},
    **{c: f"ch_{c}" for c in ("vega_flow_call", "vega_flow_put", "vega_flow_short", "vega_flow_long")},
    **{f"{c}_share": f"ch_{c} / {_SHARE}" for c in ("out_premium", "buy_premium", "sell_premium", "passive_premium", "sweep_premium", "leg_premium", "zero_day_premium")},
    "leg_size_share": "ch_leg_size / greatest(ch_size, 0.000000001)", **{c: f"ch_{c} / greatest(ch_has_previous, 1.0)" for c in ("d_iv", "d_mid", "d_spread")},
    "rate_per_second": "ch_trades / seconds", "span_s": "span_us / 1000000.0", "is_empty": "CASE WHEN ch_trades = 0 THEN 1.0 ELSE 0.0 END",
    "mean_age_s": "CASE WHEN ch_trades > 0 THEN cutoff_s - ch_age / ch_trades ELSE 0.0 END", "mean_lag_s": "ch_lag / greatest(ch_trades, 1.0)", "late_share": "ch_late / greatest(ch_trades, 1.0)", "p95_lag_s": "p95_lag_s",
    "zero_day_signed": "ch_zero_day_signed", "zero_day_trade_share": "ch_zero_day_trades / greatest(ch_trades, 1.0)",
    "activity": "activity", "activity_rise": "activity - activity_before",
    "strike_concentration": "strike_concentration", "expiry_concentration": "expiry_concentration", "contract_entropy": "contract_entropy", "gap_cv": "gap_cv",
}
RECORD = _doubles(RECORD)
_FOUR = ("activity", "activity_rise")
_SHOWN = {n: f"round({e} + 0.0000000013e0, {4 if n in _FOUR else 6}) + 0e0" for n, e in RECORD.items()}
_DEFAULTS = ("contracts", "span_us", "p95_lag_s", "activity", "activity_before", "strike_concentration", "expiry_concentration", "contract_entropy", "gap_cv")
_HERFINDAHL = "sum(w * w) / (sum(w) * sum(w))"


def _member(o: str = "o", width: str = "o.us") -> str:
    return f"t.asset = {o}.asset AND t.session_date = {o}.session_date AND t.executed_us >= {o}.origin - {DELAY} - {width} AND t.created_us <= {o}.origin - {DELAY}"


def _sql_shares(name: str, by: str, measure: str) -> str:
    return f"""{name} AS (SELECT asset, session_date, origin, {measure} AS {name} FROM (
  SELECT o.asset, o.session_date, o.origin, {by}, sum(ch_premium)::DOUBLE AS w FROM o JOIN print t ON {_member()} WHERE o.width = 'short' GROUP BY ALL) GROUP BY ALL)"""


_ENTROPY = "CASE WHEN count(*) > 1 THEN (ln(sum(w)) - sum(w * ln(w)) / sum(w)) / ln(count(*)) ELSE 0.0 END"


@query("window_record", f"""WITH {_PRINTS},
  v(width, us) AS (VALUES {', '.join(f"('{label}', {width})" for label, width in WIDTHS.items())}),
  o AS MATERIALIZED (SELECT asset, session_date, session_us, session_us + h * {HOUR} AS origin, width, us FROM (SELECT DISTINCT asset, session_date, session_us FROM print), range(9, 25) r(h), v),
  s AS (SELECT o.width, o.asset, o.session_date, o.origin, {', '.join(f'sum(ch_{c}) AS s_{c}' for c in CHANNELS)}, count(DISTINCT (k, is_call)) AS contracts, max(executed_us) - min(executed_us) AS span_us,
    quantile_cont((created_us - executed_us) / 1e6, 0.95) AS p95_lag_s FROM o JOIN print t ON {_member()} GROUP BY ALL),
  {_sql_shares('strike_concentration', 'k', _HERFINDAHL)}, {_sql_shares('expiry_concentration', 'days', _HERFINDAHL)}, {_sql_shares('contract_entropy', 'k, is_call', _ENTROPY)},
  gap AS (SELECT o.asset, o.session_date, o.origin, executed_us - lag(executed_us) OVER (PARTITION BY o.asset, o.origin ORDER BY executed_us, seq) AS g FROM o JOIN print t ON {_member()} WHERE o.width = 'short'),
  gap_cv AS (SELECT asset, session_date, origin, CASE WHEN avg(g) > 0 THEN stddev_pop(g) / avg(g) ELSE 0.0 END AS gap_cv FROM gap GROUP BY ALL),
  e AS (SELECT DISTINCT asset, session_date, origin - us AS before, origin FROM o UNION SELECT DISTINCT asset, session_date, origin, origin FROM o),
  a AS (SELECT e.asset, e.session_date, before, sum(exp(-(before - {DELAY} - executed_us) / {DECAY}.0)) AS activity FROM (SELECT DISTINCT asset, session_date, before FROM e) e JOIN print t ON t.asset = e.asset AND t.session_date = e.session_date AND t.created_us <= before - {DELAY} GROUP BY ALL),
  r AS (SELECT o.width, o.asset, o.session_date, o.origin, us / 1e6 AS seconds, (o.origin - {DELAY} - session_us) / 1e6 AS cutoff_s, {', '.join(f'coalesce(s_{c}, 0) / {_SCALE[c]}.0 AS ch_{c}' for c in CHANNELS)},
    {', '.join(f"coalesce({c}, 0) AS {c}" for c in ('contracts', 'span_us', 'p95_lag_s'))}, coalesce(a.activity, 0.0) AS activity, coalesce(b.activity, 0.0) AS activity_before,
    {', '.join(f"CASE WHEN width = 'short' THEN coalesce({c}, 0.0) ELSE 0.0 END AS {c}" for c in _DEFAULTS[5:])}
    FROM o LEFT JOIN s USING (width, asset, session_date, origin) LEFT JOIN strike_concentration USING (asset, session_date, origin) LEFT JOIN expiry_concentration USING (asset, session_date, origin)
    LEFT JOIN contract_entropy USING (asset, session_date, origin) LEFT JOIN gap_cv USING (asset, session_date, origin)
    LEFT JOIN a ON a.asset = o.asset AND a.session_date = o.session_date AND a.before = o.origin LEFT JOIN a b ON b.asset = o.asset AND b.session_date = o.session_date AND b.before = o.origin - us)
  SELECT width, asset, session_date, origin, {', '.join(f'{e} AS {n}' for n, e in _SHOWN.items())} FROM r""", dates=["session_date"])
def window_record(spark, sf):
    """The record of two trailing windows at every origin: sums are differences of prefixes, an empty window is stated as
    zeros and a flag."""
    rows = files.stored(prints(spark, sf), "prints")
    sums = [f"ch_{c}" for c in CHANNELS]
    spanned = prefix.spans(rows, "executed_us", "created_us", HOUR, WIDTHS, DELAY)
    at = rows.select(*KEYS, "session_us").distinct().withColumn("h", F.explode(F.sequence(F.lit(9), F.lit(24))))
    at = at.select(*KEYS, "session_us", (F.col("session_us") + F.col("h") * HOUR).alias("origin"))
    widths = F.explode(F.array(*[F.struct(F.lit(label).alias("width"), F.lit(us).alias("us")) for label, us in WIDTHS.items()]))
    origins = at.withColumn("w", widths).select(*KEYS, "session_us", "origin", "w.*")
    key = [*KEYS, "width", "origin"]

    found = prefix.window_sums(spanned, origins, KEYS, sums)
    found = found.select(*key, *[(F.col(c) / F.lit(float(_SCALE[c[3:]]))).alias(c) for c in sums])
    found = found.join(prefix.window_distinct(spanned, origins, KEYS, ["k", "is_call"], "contracts"), key)
    ends = prefix.at_origins(prefix.cells(spanned, KEYS, [], F.min("executed_us").alias("a"), F.max("executed_us").alias("b")), HOUR)
    found = found.join(ends.groupBy(*key).agg((F.max("b") - F.min("a")).alias("span_us")), key, "left")
    lags = prefix.at_origins(prefix.cells(spanned, KEYS, ["ch_lag"], F.count("*").alias("n")), HOUR).groupBy(*key, "ch_lag").agg(F.sum("n").alias("n"))
    tail = prefix.weighted_quantile(lags.withColumn("lag_s", F.col("ch_lag") / 1e6), key, "lag_s", "n", 0.95, "p95_lag_s")
    found = found.join(tail, key, "left")

    before = at.withColumn("w", widths).select(*KEYS, "session_us", (F.col("origin") - F.col("w.us")).alias("origin"))
    decay = prefix.decayed(rows, at.unionByName(before).distinct(), KEYS, "executed_us", "created_us", "session_us", HOUR, DELAY, DECAY, "activity")
    then = decay.withColumnRenamed("activity", "activity_before").withColumnRenamed("origin", "since")
    found = found.join(origins, key).withColumn("since", F.col("origin") - F.col("us")).join(decay, [*KEYS, "origin"], "left").join(then, [*KEYS, "since"], "left")

    # the short windows tile: a row is in one of them at most
    short = spanned.withColumn("s", F.explode("spans")).where("s.width = 'short'").select("seq", *KEYS, "executed_us", "k", "days", "is_call", "ch_premium", F.col("s.enter").alias("origin"))
    by = lambda *items: short.groupBy(*KEYS, "origin", *items).agg(F.sum("ch_premium").cast("double").alias("w")).groupBy(*KEYS, "origin")
    herfindahl = F.expr(_HERFINDAHL)
    parts = [by("k").agg(herfindahl.alias("strike_concentration")), by("days").agg(herfindahl.alias("expiry_concentration")), by("k", "is_call").agg(F.expr(_ENTROPY).alias("contract_entropy"))]
    gap = F.col("executed_us") - F.lag("executed_us").over(W.partitionBy(*KEYS, "origin").orderBy("executed_us", "seq"))
    parts.append(short.withColumn("g", gap).groupBy(*KEYS, "origin").agg(F.when(F.avg("g") > 0, F.stddev_pop("g") / F.avg("g")).otherwise(0.0).alias("gap_cv")))
    for part in parts:
        found = found.join(part.withColumn("width", F.lit("short")), key, "left")
    found = found.withColumn("seconds", F.col("us") / 1e6).withColumn("cutoff_s", (F.col("origin") - DELAY - F.col("session_us")) / 1e6).fillna(0, list(_DEFAULTS))
    return found.select("width", *KEYS, "origin", *[F.expr(e).alias(n) for n, e in _SHOWN.items()])
