"""Queries over fitted curves: budget and step exponents, registered intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import anatomy, curves, metrics, registration
from ..operators.guards import convention_problems
from ..plans import protocols
from ..sources import tables as t
from . import sqlviews as v
from .registry import query

RUNGS = (1, 2, 5, 10, 15, 20)
BANDS = "0-25,26-51,52+,all"

_LADDER = f"""{v.judged_views()}, rs AS (SELECT q.run, q.query_id, q.size,
    min(j.pos) FILTER (j.fp_match) + 1 AS fp_rank
  FROM queries q LEFT JOIN judged j ON j.run = q.run AND j.query_id = q.query_id AND j.pos < 20
  WHERE q.fp_unseen GROUP BY q.run, q.query_id, q.size), {v.bands(BANDS)},
  ladder AS (SELECT run, band, count(*) AS n_queries, k,
    avg(coalesce(fp_rank <= k, false)::INT) AS recovery
  FROM rs JOIN bands ON size BETWEEN lo AND hi,
    (VALUES {', '.join(f'({k})' for k in RUNGS)}) rungs(k) GROUP BY run, band, k)"""


def _ladder(spark, path):
    slots = anatomy.raw_slots(t.queries(spark, path), t.judged(spark, path), 20)
    return anatomy.recovery_ladder(slots, 20, BANDS, RUNGS)


def _fit_cte(name: str, source: str, keys: str, x: str, y: str, where: str, tol: float) -> str:
    return f"""{name} AS (SELECT {keys},
      CASE WHEN count(*) >= 3 AND regr_sxx(ly, lx) >= {tol} AND regr_syy(ly, lx) >= {tol}
        THEN regr_slope(ly, lx) END AS s,
      CASE WHEN count(*) >= 3 AND regr_sxx(ly, lx) >= {tol} AND regr_syy(ly, lx) >= {tol}
        THEN regr_intercept(ly, lx) END AS i,
      CASE WHEN count(*) >= 3 AND regr_sxx(ly, lx) >= {tol} AND regr_syy(ly, lx) >= {tol}
        THEN corr(ly, lx) END AS r
      FROM (SELECT *, ln({x}) AS lx, ln(1 - {y}) AS ly FROM {source} WHERE {where}) GROUP BY {keys})"""


_BUDGET = f"""{_LADDER},
  {_fit_cte('ff', 'ladder', 'run, band', 'k', 'recovery', 'k >= 2 AND recovery < 1', 1e-9)},
  {_fit_cte('fe', 'ladder', 'run, band', 'k', 'recovery', 'k >= 2 AND k <= 10 AND recovery < 1', 1e-9)},
  tp AS (SELECT run, band, max(n_queries) AS n_queries, max(k) AS top_k,
    arg_max(recovery, k) AS rt FROM ladder GROUP BY run, band),
  bf AS (SELECT tp.*, ff.s, ff.i, ff.r, fe.s AS es, fe.i AS ei FROM tp
    LEFT JOIN ff USING (run, band) LEFT JOIN fe USING (run, band))"""


def _need(target: float) -> str:
    import math

    lk = f"(({math.log(1 - target)!r} - i) / s)"
    return f"CASE WHEN s >= -1e-9 OR {lk} > 709 THEN NULL ELSE exp({lk}) END"


def _over(target: float) -> str:
    import math

    lk = f"(({math.log(1 - target)!r} - i) / s)"
    return f"coalesce(s < -1e-9 AND {lk} > 709, false)"


@query(
    "budget_fit",
    f"""WITH {_BUDGET} SELECT run, band, n_queries, top_k, round(rt, 8) AS recovery_at_top,
      round(r, 6) AS correlation, round(-s, 6) AS exponent, round(-es, 6) AS early_exponent,
      round(1 - exp(ei + es * ln(top_k)), 6) AS predicted_at_top,
      round(100 * (rt - (1 - exp(ei + es * ln(top_k)))), 4) AS error_points,
      round(ln({_need(0.9)}), 4) AS log_budget_for_0_9, {_over(0.9)} AS overflow_0_9 FROM bf""",
)
def budget_fit(spark, path):
    rows = curves.budget_fit(
        _ladder(spark, path), min_k=2, extrapolate_from=10, targets=(0.9,)
    )
    return rows.select(
        "run", "band", "n_queries", "top_k", "recovery_at_top",
        F.round("correlation", 6).alias("correlation"),
        F.round("exponent", 6).alias("exponent"),
        F.round("early_exponent", 6).alias("early_exponent"),
        F.round("predicted_at_top", 6).alias("predicted_at_top"),
        F.round("error_points", 4).alias("error_points"),
        F.round(F.log("budget_for_0_9"), 4).alias("log_budget_for_0_9"),
        "overflow_0_9",
    )


@query(
    "pair_exponents",
    f"""WITH {_LADDER}, a AS (SELECT * FROM ladder WHERE run = 's1'),
    b AS (SELECT * FROM ladder WHERE run = 's2')
    SELECT band, k, b.n_queries, round(CASE WHEN a.recovery > 0 AND a.recovery < 1 AND b.recovery > 0
      AND b.recovery < 1 THEN ln((1 - a.recovery) / (1 - b.recovery)) / ln(3.0) END, 8) AS exponent
    FROM a JOIN b USING (band, k)""",
)
def pair_exponents(spark, path):
    ladder = _ladder(spark, path)
    return curves.pair_exponents(
        ladder.filter(F.col("run") == "s1"), ladder.filter(F.col("run") == "s2"), 1000, 3000
    )


@query(
    "break_even",
    f"""WITH {_BUDGET}, c AS (SELECT band, ln((1 - a.recovery) / (1 - b.recovery)) / ln(3.0) AS c
      FROM (SELECT * FROM ladder WHERE run = 's1' AND k = 20) a
      JOIN (SELECT * FROM ladder WHERE run = 's3' AND k = 20) b USING (band)),
    j AS (SELECT band, -s AS b, c FROM c JOIN (SELECT * FROM bf WHERE run = 's1') USING (band)
      WHERE c > 0 AND -s > 0)
    SELECT band, round(b, 6) AS b, round(c, 6) AS c, round(c / b, 6) AS ratio, cut,
      round(log10(1.5 * 5000 * (pow(cut, -1 / c) - 1) / (0.01 * 20 * (pow(cut, -1 / b) - 1))), 6) AS log10_queries,
      round(20 * pow(cut, -1 / b), 4) AS k_needed
    FROM j, (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) cuts(cut)""",
)
def break_even(spark, path):
    """Bands without a falling step curve have no break-even and no row."""
    ladder = _ladder(spark, path)
    steps = curves.pair_exponents(
        ladder.filter(F.col("run") == "s1"), ladder.filter(F.col("run") == "s3"), 1000, 3000
    )
    budget = curves.budget_fit(ladder, min_k=2, extrapolate_from=10, targets=(0.9,)).filter(
        F.col("run") == "s1"
    )
    rows = curves.break_even_table(
        steps, budget, (0.5, 0.8), steps=5000, k=20, sec_per_step=1.5, sec_per_slot=0.01
    )
    return rows.select(
        "band",
        *[F.round(c, 6).alias(c) for c in ("b", "c", "ratio")],
        "cut",
        F.round(F.log10("queries"), 6).alias("log10_queries"),
        F.round("k_needed", 4).alias("k_needed"),
    )


TRACE = f"""tr0 AS (SELECT event_type AS run,
    date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS step,
    avg((value >= 50)::INT) AS share, avg(value) AS mv FROM events GROUP BY ALL),
  trace AS (SELECT run, step, (step - 1) // 5 AS epoch,
    round(1 - (1 - share) * pow(step, -0.3), 6) AS recovery, round(mv / 100, 4) AS valid_loss
    FROM tr0)"""


@query(
    "trace_fit",
    f"""WITH {TRACE}, tu AS (SELECT * FROM trace WHERE recovery > 0 AND recovery < 1 AND step BETWEEN 2 AND 28),
    e AS (SELECT run, max(step) AS last_step, arg_max(recovery, step) AS rl, count(*) AS n,
      min(step) AS first_step FROM tu GROUP BY run),
    tx AS (SELECT tu.*, last_step FROM tu JOIN e USING (run)),
    {_fit_cte('f', 'tx', 'run', 'step', 'recovery', 'true', 1e-12)},
    {_fit_cte('g', 'tx', 'run', 'step', 'recovery', 'step <= last_step * 0.5', 1e-12)}
    SELECT run, last_step, rl AS rec_at_last, n AS n_points, first_step, round(-f.s, 6) AS exponent,
      round(f.r, 6) AS correlation, round(-g.s, 6) AS early_exponent,
      round(1 - exp(g.i) * pow(last_step, g.s), 6) AS predicted_at_last,
      round(100 * (1 - exp(g.i) * pow(last_step, g.s) - rl), 4) AS error_points
    FROM e JOIN f USING (run) LEFT JOIN g USING (run)""",
)
def trace_fit(spark, path):
    rows = curves.trace_fit(curves.usable_trace(t.trace(spark, path), window=(2, 28)))
    return rows.select(
        "run", "last_step", "rec_at_last", "n_points", "first_step",
        *[F.round(c, 6).alias(c) for c in ("exponent", "correlation", "early_exponent", "predicted_at_last")],
        F.round("error_points", 4).alias("error_points"),
    )


# ------------------------------------------------------------- registrations

_CELLS = f"""{v.summary_views()}, {v.bands(t.BANDS)}, rt AS (SELECT run, band, count(*) AS n,
    avg(coalesce(rank_gen_fp < 20, false)::INT) AS rate FROM summary JOIN bands ON size BETWEEN lo AND hi
    WHERE fp_unseen GROUP BY run, band),
  cl AS (SELECT m.band, b.n, m.rate AS matched, b.rate AS base, p.rate AS passes
    FROM rt m JOIN rt b ON b.band = m.band AND b.run = 's2' JOIN rt p ON p.band = m.band AND p.run = 's3'
    WHERE m.run = 's1')"""


def _rates(spark, path):
    summary = metrics.query_summary(t.queries(spark, path), t.judged(spark, path))
    rates, _ = protocols.band_analysis(summary, t.RUNS, t.BANDS, k=20)
    return rates


def _cells(spark, path):
    rates = _rates(spark, path)
    of = lambda r: rates.filter(F.col("run") == r)
    return rates, registration.three_cells(of("s1"), of("s2"), of("s3"))


import math as _m  # noqa: E402

_GD, _TD = _m.log2(3.0 / 1.2087), _m.log2(6.0 / 1.2087)
_EFF = min(_GD, _TD) + max(0.0, _TD - _GD) * stats.DECAY_BEYOND_MEASURED
_REG = f"""{_CELLS}, rg AS (SELECT *, -log2((1 - base) / (1 - matched)) / 1.0629 AS f_exponent,
    -log2((1 - passes) / (1 - matched)) / {_GD!r} AS g_exponent FROM cl),
  rx AS (SELECT *, 1 - (1 - base) * pow(2.0, -g_exponent * {_TD!r}) AS xhi,
    1 - (1 - base) * pow(2.0, -g_exponent * {_EFF!r}) AS xlo FROM rg),
  rr AS (SELECT *, sqrt(greatest(xlo * (1 - xlo), 0) / n) AS slo,
    sqrt(greatest(xhi * (1 - xhi), 0) / n) AS shi FROM rx)"""


@query(
    "register_intervals",
    f"""WITH {_REG} SELECT band, n, round(matched, 8) AS matched, round(base, 8) AS base,
      round(passes, 8) AS passes, round(f_exponent, 6) AS f_exponent, round(g_exponent, 6) AS g_exponent,
      round(xhi, 6) AS extrapolation_hi, round(xlo, 6) AS extrapolation_lo, round(slo, 6) AS se_at_lo,
      round(shi, 6) AS se_at_hi, round(xlo - slo, 6) AS registered_lo, round(xhi + shi, 6) AS registered_hi
    FROM rr""",
)
def register_intervals(spark, path):
    _, cells = _cells(spark, path)
    rows = registration.register_intervals(cells)
    exact = ("band", "n", "matched", "base", "passes")
    return rows.select(
        *exact, *[F.round(c, 6).alias(c) for c in rows.columns if c not in exact]
    )


@query(
    "registration_score",
    f"""WITH {_REG}, ms AS (SELECT band, n, rate FROM rt WHERE run = 's2' AND band <> '52+')
    SELECT rr.band, round(xlo - slo, 6) AS registered_lo, round(xhi + shi, 6) AS registered_hi,
      ms.n AS n_queries, round(ms.rate, 8) AS rate,
      CASE WHEN ms.rate IS NULL THEN 'absent' WHEN rr.band = 'all' THEN 'context'
        WHEN ms.rate < xlo - slo THEN 'MISS LOW' WHEN ms.rate > xhi + shi THEN 'MISS HIGH'
        ELSE 'HIT' END AS verdict,
      round(CASE WHEN ms.rate IS NOT NULL AND rr.band <> 'all'
        THEN 100 * sqrt(ms.rate * (1 - ms.rate) / ms.n) END, 6) AS se_points,
      round(CASE WHEN ms.rate IS NULL OR rr.band = 'all' THEN NULL
        WHEN ms.rate < xlo - slo THEN (ms.rate - (xlo - slo)) * 100
        WHEN ms.rate > xhi + shi THEN (ms.rate - (xhi + shi)) * 100 ELSE 0.0 END, 6) AS miss_points
    FROM rr LEFT JOIN ms ON ms.band = rr.band""",
)
def registration_score(spark, path):
    """Intervals scored against a measured run; one band is absent, one is context."""
    rates, cells = _cells(spark, path)
    measured = rates.filter((F.col("run") == "s2") & (F.col("band") != "52+"))
    bands = [b for b in t.BANDS.split(",") if b != "all"]
    rows = registration.score_registration(
        registration.register_intervals(cells), measured, scored_bands=bands
    )
    return rows.select(
        "band",
        F.round("registered_lo", 6).alias("registered_lo"),
        F.round("registered_hi", 6).alias("registered_hi"),
        "n_queries", "rate", "verdict",
        F.round("se_points", 6).alias("se_points"),
        F.round("miss_points", 6).alias("miss_points"),
    )


@query(
    "registration_refused",
    f"WITH {_REG} SELECT band, 'REFUSED' AS verdict FROM rr",
)
def registration_refused(spark, path):
    """A measurement under another convention is refused, not scored."""
    rates, cells = _cells(spark, path)
    labels = cells.limit(1)
    left = labels.select(F.lit("recovery").alias("metric"), F.lit(60).alias("k"))
    right = labels.select(F.lit("recovery").alias("metric"), F.lit(20).alias("k"))
    problems = convention_problems(left, right, ("metric", "k"))
    rows = registration.score_registration(
        registration.register_intervals(cells),
        rates.filter(F.col("run") == "s2"),
        problems=problems,
    )
    return rows.select("band", "verdict")


@query(
    "registration_totals",
    f"""WITH {_REG} SELECT count(*) FILTER (rate >= xlo - slo AND rate <= xhi + shi) AS hits,
      count(*) AS scored FROM rr JOIN rt ON rt.band = rr.band AND rt.run = 's2'""",
)
def registration_totals(spark, path):
    rates, cells = _cells(spark, path)
    return registration.score_totals(
        registration.score_registration(
            registration.register_intervals(cells), rates.filter(F.col("run") == "s2")
        )
    )


@query(
    "points_per_doubling",
    f"""WITH {_CELLS} SELECT band, n AS n_queries, round(matched, 8) AS old_rate, round(base, 8) AS rate,
      round(100 * (base - matched), 6) AS delta_points,
      round(100 * (base - matched) / 1.0629, 6) AS points_per_doubling,
      round(100 * sqrt(greatest(base * (1 - base), 1e-9) / n), 6) AS se_points FROM cl""",
)
def points_per_doubling(spark, path):
    rates = _rates(spark, path)
    rows = registration.points_per_doubling(
        rates.filter(F.col("run") == "s1"), rates.filter(F.col("run") == "s2"), 1.0629
    )
    return rows.select(
        "band", "n_queries", "old_rate", "rate",
        *[F.round(c, 6).alias(c) for c in ("delta_points", "points_per_doubling", "se_points")],
    )


@query(
    "deficit_cut",
    f"""WITH {_CELLS} SELECT band, n, round(matched, 8) AS matched, round(base, 8) AS base,
      round(passes, 8) AS passes, round((passes - matched) / (1 - matched), 8) AS deficit_cut,
      round(1 - (1 - base) * (1 - (passes - matched) / (1 - matched)), 8) AS predicted FROM cl""",
)
def deficit_cut(spark, path):
    return registration.deficit_cut_prediction(_cells(spark, path)[1])


@query(
    "exchange_rate",
    f"""WITH {_CELLS} SELECT band, round(matched, 8) AS short, round(passes, 8) AS long,
      round((passes - matched) * 100 / 2.3, 6) AS points_per_pass_doubling,
      round((passes - matched) * 100 / 2.3 / 13.0, 6) AS passes_over_corpus FROM cl""",
)
def exchange_rate(spark, path):
    rates = _rates(spark, path)
    rows = registration.exchange_rate(
        rates.filter(F.col("run") == "s1"), rates.filter(F.col("run") == "s3"), 2.3, 13.0
    )
    return rows.select(
        "band", "short", "long",
        F.round("points_per_pass_doubling", 6).alias("points_per_pass_doubling"),
        F.round("passes_over_corpus", 6).alias("passes_over_corpus"),
    )


@query(
    "score_exchange",
    f"""WITH {_CELLS}, e AS (SELECT band, (passes - matched) * 100 / 2.3 AS g FROM cl)
    SELECT band, round(g, 6) AS points_per_pass_doubling, round(g / 13.0, 6) AS passes_over_corpus,
      1.5::DOUBLE AS registered_gain, round(g - 1.5, 6) AS gain_minus_registered,
      round(g / 1.5, 6) AS gain_over_registered,
      CASE WHEN g / 13.0 < 0.03 THEN printf('below by %.3f', 0.03 - g / 13.0)
        WHEN g / 13.0 > 0.06 THEN printf('above by %.3f', g / 13.0 - 0.06) ELSE 'inside' END AS exchange_verdict
    FROM e""",
)
def score_exchange(spark, path):
    """The gain of a pass doubling against its registered value, its worth in corpus doublings against a range."""
    rates = _rates(spark, path)
    gains = registration.exchange_rate(
        rates.filter(F.col("run") == "s1"), rates.filter(F.col("run") == "s3"), 2.3, 13.0
    )
    rows = registration.score_exchange(gains, registered_gain=1.5, ratio_range=(0.03, 0.06)).drop("short", "long")
    return rows.select(
        *[F.round(c, 6).alias(c) if ty == "double" else F.col(c) for c, ty in rows.dtypes]
    )


_REGISTERED = {"0-25": 0.2, "26-51": 0.3, "52+": 0.4, "all": 0.25}
_MAP = " ".join(f"WHEN '{b}' THEN {x}" for b, x in _REGISTERED.items())


@query(
    "score_exponents",
    f"""WITH {_BUDGET}, c AS (SELECT band, ln((1 - a.recovery) / (1 - b.recovery)) / ln(3.0) AS c
      FROM (SELECT * FROM ladder WHERE run = 's1' AND k = 20) a
      JOIN (SELECT * FROM ladder WHERE run = 's2' AND k = 20) b USING (band)),
    j AS (SELECT band, c, -s AS b, rt AS rate, CASE band {_MAP} END::DOUBLE AS reg
      FROM c JOIN (SELECT * FROM bf WHERE run = 's1') USING (band))
    SELECT band, round(c, 6) AS c, round(b, 6) AS b, round(rate, 6) AS rate, reg AS registered_c,
      round(c / reg, 6) AS c_ratio, round(b / rate, 6) AS b_over_rate,
      CASE WHEN b < 0.2 THEN printf('below by %.3f', 0.2 - b)
        WHEN b > 0.25 THEN printf('above by %.3f', b - 0.25) ELSE 'inside' END AS b_verdict,
      CASE WHEN b / rate < 0.3 THEN printf('below by %.3f', 0.3 - b / rate)
        WHEN b / rate > 0.5 THEN printf('above by %.3f', b / rate - 0.5) ELSE 'inside' END
        AS ratio_verdict FROM j""",
)
def score_exponents(spark, path):
    ladder = _ladder(spark, path)
    steps = curves.pair_exponents(
        ladder.filter(F.col("run") == "s1"), ladder.filter(F.col("run") == "s2"), 1000, 3000
    ).filter(F.col("k") == 20)
    fit = curves.budget_fit(ladder, min_k=2, extrapolate_from=10, targets=(0.9,)).filter(
        F.col("run") == "s1"
    )
    rows = registration.score_exponents(
        steps,
        fit.select("band", F.col("exponent").alias("b")),
        fit.select("band", F.col("recovery_at_top").alias("rate")),
        registered=_REGISTERED,
        b_range=(0.2, 0.25),
        ratio_range=(0.3, 0.5),
    )
    return rows.select(
        *[F.round(c, 6).alias(c) if ty == "double" else F.col(c) for c, ty in rows.dtypes]
    )
