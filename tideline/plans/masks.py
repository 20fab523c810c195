"""Folds with purge bands, causal masks, their audit, combinations of designs, and what a window could see."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, panel
from ..sources.tables import tape
from .panels import _PANEL, merged
from .registry import TAPE, query, r6, s6
from .windowed import KEYS

HOUR = 3_600_000_000
#: A target lasts three hours, so that those of a session's last origins reach into the next; folds, gaps and validation sessions.
_LASTS, _GAP, _FOLDS, _VALID = 3 * HOUR, 6 * HOUR, 5, 4
_ORIGINS = f"""{TAPE}, org AS (
  SELECT asset, session_date, (executed_us // {HOUR}) * {HOUR} AS start_us, (executed_us // {HOUR} + 3) * {HOUR} AS end_us FROM tape GROUP BY ALL)"""
_DAYS = ["session_date"]


def origins(spark, sf):
    """Hourly origins with the end of their target."""
    rows = tape(spark, sf).select(*KEYS, (F.floor(F.col("executed_us") / HOUR) * HOUR).alias("start_us")).distinct()
    return rows.withColumn("end_us", F.col("start_us") + _LASTS)


_BLOCKS = f"""{_ORIGINS}, d AS (SELECT session_date, ntile({_FOLDS}) OVER (ORDER BY session_date) - 1 AS fold FROM (SELECT DISTINCT session_date FROM org)),
  t AS (SELECT org.*, fold FROM org JOIN d USING (session_date)), band AS (SELECT fold AS f, min(start_us) - {_GAP} AS low, max(end_us) + {_GAP} AS high FROM t GROUP BY 1)"""


@query("block_folds", f"""WITH {_BLOCKS} SELECT t.asset, t.session_date, t.start_us, t.fold::INTEGER AS fold, array_to_string(list_sort(list(f)), ',') AS purged
  FROM t JOIN band ON t.start_us <= high AND t.end_us >= low GROUP BY ALL""", dates=_DAYS)
def block_folds(spark, sf):
    """Origins with the block that tests them, and the folds that may not train on them: their own, and those whose purge band
    their target reaches, on either side."""
    rows = origins(spark, sf)
    rows = rows.join(F.broadcast(folds.blocks(rows, "session_date", _FOLDS)), "session_date")
    bands = folds.bands(rows, "fold", "start_us", "end_us", _GAP, _GAP)
    out = folds.purged(rows, bands, [*KEYS, "start_us"], "start_us", "end_us", 4 * HOUR)
    return out.select(*KEYS, "start_us", "fold", F.array_join(F.transform("purged", lambda f: f.cast("string")), ",").alias("purged"))


@query("session_masks", f"""WITH {_ORIGINS}, d AS (SELECT session_date, count(*) AS test_n, min(start_us) AS test_first FROM org GROUP BY 1),
  m AS (SELECT d.session_date, org.session_date AS of, start_us, end_us, dense_rank() OVER (PARTITION BY d.session_date ORDER BY org.session_date DESC) AS back, test_first FROM d JOIN org ON org.end_us <= test_first - {_GAP}),
  s AS (SELECT session_date, count(*) AS train_n, count(DISTINCT of) AS train_sessions, max(end_us) AS train_last, min(start_us) FILTER (WHERE back <= {_VALID}) AS valid_first, count(*) FILTER (WHERE back <= {_VALID}) AS valid_n FROM m GROUP BY 1),
  f AS (SELECT s.session_date, count(org.asset) AS fit_n FROM s LEFT JOIN org ON org.end_us <= valid_first - {_GAP} WHERE train_sessions > {_VALID} GROUP BY 1)
  SELECT d.session_date, test_n, coalesce(train_n, 0) AS train_n, coalesce(train_sessions, 0) AS train_sessions, train_last, CASE WHEN train_sessions > {_VALID} THEN valid_n ELSE 0 END AS valid_n, coalesce(fit_n, 0) AS fit_n, test_first,
    CASE WHEN coalesce(train_sessions, 0) <= {_VALID} THEN 'too_few_sessions' WHEN fit_n = 0 THEN 'nothing_to_fit' ELSE 'ok' END AS status
  FROM d LEFT JOIN s USING (session_date) LEFT JOIN f USING (session_date)""", dates=_DAYS)
def session_masks(spark, sf):
    return folds.session_masks(origins(spark, sf), "session_date", "start_us", "end_us", _GAP, _VALID)


@query("causal_audit", f"""WITH {_BLOCKS}, k AS (SELECT fold, count(*) AS test_n, min(start_us) AS test_first FROM t GROUP BY 1)
  SELECT k.fold::INTEGER AS fold, test_n, test_first, count(org.asset) FILTER (WHERE org.start_us < test_first) AS earlier_n, count(org.asset) FILTER (WHERE org.end_us <= test_first - {_GAP}) AS train_n,
    count(org.asset) FILTER (WHERE org.start_us < test_first AND org.end_us > test_first - {_GAP}) AS dropped_n, max(org.end_us) FILTER (WHERE org.end_us <= test_first - {_GAP}) AS train_last,
    count(org.asset) FILTER (WHERE org.end_us <= test_first - {_GAP}) > 0 AS causal FROM k, org GROUP BY ALL""")
def causal_audit(spark, sf):
    """Every fold, trained on what came before its block: what was kept, what the gap dropped, and whether training ended in time."""
    rows = origins(spark, sf)
    tests = rows.join(F.broadcast(folds.blocks(rows, "session_date", _FOLDS)), "session_date")
    return folds.causal_audit(rows, tests, "start_us", "end_us", _GAP)


_DESIGNS = {"b0": ["b0"], "b1": ["b0", "b1"], "b2": ["b0", "b2"]}


@query("design_combinations", f"""WITH {_PANEL}, m AS (SELECT (CASE WHEN b0 IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN b0 IS NOT NULL AND b1 IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN b0 IS NOT NULL AND b2 IS NOT NULL THEN 4 ELSE 0 END) AS mask,
    ('0x' || md5(asset || '|' || session_date)[1:12])::BIGINT AS h FROM panel), c AS (SELECT unnest(range(8)) AS c),
  s AS (SELECT c, count(mask) AS usable, coalesce(sum(h), 0) AS digest FROM c LEFT JOIN m ON mask & c = c GROUP BY 1),
  o AS (SELECT max(usable) FILTER (WHERE c = 0) AS n, max(usable) FILTER (WHERE c = 1) AS a, max(usable) FILTER (WHERE c = 2) AS b, max(usable) FILTER (WHERE c = 4) AS d FROM s)
  SELECT c::INTEGER AS combination, concat_ws('+', CASE WHEN c & 1 > 0 THEN 'b0' END, CASE WHEN c & 2 > 0 THEN 'b1' END, CASE WHEN c & 4 > 0 THEN 'b2' END) AS designs, usable, {s6('usable / n')} AS share,
    {s6('usable / n / ((CASE WHEN c & 1 > 0 THEN a / n ELSE 1.0 END) * (CASE WHEN c & 2 > 0 THEN b / n ELSE 1.0 END) * (CASE WHEN c & 4 > 0 THEN d / n ELSE 1.0 END))')} AS lift, digest::VARCHAR AS digest FROM s, o""")
def design_combinations(spark, sf):
    """Rows that each combination of three designs can be scored on, from one count a mask."""
    masked = panel.design_masks(merged(spark, sf), _DESIGNS, "b0", KEYS)
    out = panel.combinations(panel.mask_counts(masked, KEYS), list(_DESIGNS))
    return out.select("combination", "designs", "usable", r6("share").alias("share"), r6("lift").alias("lift"), F.col("digest").cast("string").alias("digest"))


@query("lifted_mask", f"""WITH {_PANEL} SELECT asset, session_date, b0 IS NOT NULL AND b1 IS NOT NULL AS in_base, b0 IS NOT NULL AND b1 IS NOT NULL AND day(session_date) > 10 AS selected FROM panel""", dates=_DAYS)
def lifted_mask(spark, sf):
    """An evaluation mask over the rows that a design kept, taken back to the rows of the panel."""
    rows = merged(spark, sf)
    base = panel.design_masks(rows, _DESIGNS, "b0", KEYS).where(F.col("mask").bitwiseAND(2) > 0)
    return panel.lifted(rows, base, base.where(F.dayofmonth("session_date") > 10), KEYS)


_BUFFERS = [60, 120, 300]


@query("eligibility_audit", f"""WITH {TAPE}, e AS (SELECT asset, session_date, executed_us, CASE WHEN seq % 40 <> 0 THEN created_us END AS created_us FROM tape), b AS (SELECT unnest({_BUFFERS}) AS buffer_s),
  w AS (SELECT *, ((executed_us + buffer_s * 1000000) // {HOUR} + 1) * {HOUR} - buffer_s * 1000000 AS window_end FROM e, b),
  k AS (SELECT asset, session_date, buffer_s, count(*) AS candidate, count(*) FILTER (WHERE created_us <= window_end) AS eligible, count(*) FILTER (WHERE created_us > window_end) AS late, count(*) FILTER (WHERE created_us IS NULL) AS no_clock,
    count(DISTINCT window_end) AS windows FROM w WHERE executed_us >= window_end - {HOUR // 4} GROUP BY 1, 2, 3),
  g AS (SELECT DISTINCT a.asset, d.session_date, buffer_s FROM tape a, (SELECT DISTINCT session_date FROM tape) d, b)
  SELECT asset, session_date, buffer_s::INTEGER AS buffer_s, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('candidate', 'eligible', 'late', 'no_clock', 'windows'))}, true AS whole FROM g LEFT JOIN k USING (asset, session_date, buffer_s)""", dates=_DAYS)
def eligibility_audit(spark, sf):
    """What the quarter hour before each hourly origin could see, by asset, session and buffer, empty cells included."""
    rows = tape(spark, sf).select(*KEYS, "executed_us", F.when(F.col("seq") % 40 != 0, F.col("created_us")).alias("created_us"))
    assets, days = rows.select("asset").distinct(), rows.select("session_date").distinct()
    cells = days.crossJoin(F.broadcast(assets))
    return panel.eligibility(rows, cells, KEYS, "executed_us", "created_us", HOUR, HOUR // 4, _BUFFERS)
