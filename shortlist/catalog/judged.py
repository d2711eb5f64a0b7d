"""Queries over judged candidates: metrics, bands, paired tests, ensembles, policies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.bands import parse_arm
from ..functions.hashing import hash_bucket
from ..operators import anatomy, arms, ensembles, judge, metrics, paired, policy
from ..operators.bandjoin import count_by_band
from ..operators.guards import same_queries
from ..plans import protocols
from ..session import materialize, shared_dir
from ..sources import tables as t
from . import sqlviews as v
from .registry import query

KS = (1, 5, 20)
BANDS = t.BANDS
R3, R5 = t.RUNS, t.ALL_RUNS


def _summary(spark, path, runs=R3, budget="molecules"):
    return metrics.query_summary(
        t.queries(spark, path, runs), t.judged(spark, path, runs), budget
    )


def _sql(body: str, runs=R3) -> str:
    return f"WITH {v.summary_views(runs)}{body}"


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- candidates


@query(
    "dedup_mark",
    _sql(""" SELECT run, query_id, pos, raw, canonical, valid, fp_match, exact_structure,
      tanimoto, duplicate, cand_size FROM judged"""),
)
def dedup_mark(spark, path):
    """Raw repeats dropped and positions closed up; repeats of an item flagged."""
    raw = t.raw_candidates(spark, path).withColumn(
        "pos", F.col("ord") * 128 + F.col("raw")
    )
    drawn = materialize(judge.raw_dedup(raw.select("run", "query_id", "raw", "pos")), "drawn")
    value = F.col("raw")
    q, item = F.col("query_id"), value % 40
    rows = (
        drawn.withColumn("valid", value % 11 != 0)
        .withColumn("size", t.query_size(q))
        .withColumn("m", hash_bucket(100, "m", q, item))
    )
    level = F.floor(F.col("size") / 13)
    match = F.col("valid") & (F.col("m") < 6 - level)
    return judge.mark_duplicates(
        rows.withColumn("canonical", F.when(F.col("valid"), item.cast("string")))
        .withColumn("fp_match", match)
        .withColumn("exact_structure", F.col("valid") & (F.col("m") < 5 - level))
        .withColumn(
            "tanimoto",
            F.when(match, F.lit(1.0))
            .when(F.col("valid"), hash_bucket(999, "t", q, item) / 1000.0)
            .otherwise(F.lit(0.0)),
        )
        .withColumn(
            "cand_size",
            F.when(
                F.col("valid"),
                F.greatest(F.col("size") - 4 + hash_bucket(9, "s", q, item), F.lit(1)),
            ).cast("int"),
        )
        .withColumn("raw", value.cast("string"))
    ).select(
        "run", "query_id", "pos", "raw", "canonical", "valid", "fp_match", "exact_structure",
        "tanimoto", "duplicate", "cand_size",
    )


def _slot_sql(order: str, budget: str) -> str:
    if budget == "molecules":
        place = "gen" if order == "generation" else "con"
        return _sql(
            f""" SELECT run, query_id, canonical, first_pos, votes, fp_match, {place} AS slot
            FROM ranked WHERE {place} < 20"""
        )
    sort = "pos" if order == "generation" else "votes DESC, pos"
    return _sql(
        f""", sp AS (SELECT j.run, j.query_id, j.pos, j.canonical, j.fp_match,
          coalesce(p.votes, 0) AS votes
        FROM judged j LEFT JOIN props p USING (run, query_id, canonical) WHERE NOT j.duplicate),
        rs AS (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY {sort}) - 1 AS slot
               FROM sp)
        SELECT run, query_id, coalesce(canonical, '#' || pos) AS canonical, pos AS first_pos,
               votes, fp_match, slot FROM rs WHERE slot < 20"""
    )


def _slots(order: str, budget: str):
    def run(spark, path):
        rows = judge.slots(t.judged(spark, path), 20, budget, order)
        return rows.select(
            "run", "query_id", "canonical", "first_pos", "votes",
            (F.col("fp_match") == 1).alias("fp_match"), "slot",
        )

    return run


for _order in judge.ORDERS:
    for _budget in judge.BUDGETS:
        query(f"slots_{_order}_{_budget}", _slot_sql(_order, _budget))(_slots(_order, _budget))


@query(
    "top_candidates",
    _sql(""", r AS (SELECT *, row_number() OVER (PARTITION BY run, query_id
        ORDER BY fp_match DESC, votes DESC, tanimoto DESC, first_pos) AS rank FROM props)
      SELECT run, query_id, canonical, votes, tanimoto, rank FROM r WHERE rank <= 10"""),
)
def top_candidates(spark, path):
    return judge.top_candidates(t.judged(spark, path), 10).select(
        "run", "query_id", "canonical", "votes", "tanimoto", "rank"
    )


@query(
    "verified_candidates",
    _sql(""", r AS (SELECT *, row_number() OVER (PARTITION BY run, query_id
        ORDER BY votes DESC, tanimoto DESC, first_pos) AS rank FROM props WHERE fp_match)
      SELECT run, query_id, canonical, votes, rank FROM r WHERE rank <= 10"""),
)
def verified_candidates(spark, path):
    return judge.top_candidates(t.judged(spark, path), 10, verified_only=True).select(
        "run", "query_id", "canonical", "votes", "rank"
    )


@query(
    "best_result",
    _sql(""", b AS (SELECT *, row_number() OVER (PARTITION BY run, query_id
        ORDER BY fp_match DESC, exact_structure DESC, tanimoto DESC, pos) AS rn FROM judged)
      SELECT q.run, q.query_id, b.pos, b.fp_match, b.exact_structure, b.tanimoto
      FROM queries q LEFT JOIN b ON b.run = q.run AND b.query_id = q.query_id AND b.rn = 1"""),
)
def best_result(spark, path):
    return judge.best_result(t.queries(spark, path), t.judged(spark, path))


_POOL_SQL = """, pool AS (
   SELECT query_id, raw, canonical, valid, fp_match,
     (CASE run WHEN 's1' THEN 0 ELSE 1 END) * 1000000 + pos AS p FROM judged
   WHERE run IN ('s1', 's2')),
  first_raw AS (SELECT * FROM pool
     QUALIFY row_number() OVER (PARTITION BY query_id, raw ORDER BY p) = 1),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS pos
     FROM first_raw)
  SELECT 'pooled' AS run, query_id, pos, raw, canonical, valid,
    valid AND pos > min(CASE WHEN valid THEN pos END)
      OVER (PARTITION BY query_id, canonical) AS duplicate FROM numbered"""


@query("pool_arms", _sql(_POOL_SQL))
def pool_arms(spark, path):
    pooled = judge.pool_arms(t.judged(spark, path, ("s1", "s2")), ("s1", "s2"))
    return pooled.select("run", "query_id", "pos", "raw", "canonical", "valid", "duplicate")


@query(
    "draws_to_fill",
    _sql(""", drawn AS (SELECT run, query_id, raw,
        row_number() OVER (PARTITION BY run, query_id ORDER BY ord, raw) - 1 AS pos FROM raw_c),
      firsts AS (SELECT run, query_id, raw % 40 AS canonical, min(pos) AS fp FROM drawn
        WHERE raw % 11 <> 0 GROUP BY ALL),
      ranked_f AS (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY fp) AS rn
        FROM firsts),
      kth AS (SELECT run, query_id, max(rn) AS held, max(fp) AS kth_pos FROM ranked_f
        WHERE rn <= 10 GROUP BY ALL),
      base AS (SELECT run, query_id FROM queries),
      n AS (SELECT b.run, b.query_id, k.held,
        greatest(ceil((k.kth_pos + 1 - 8) / 4.0), 0) AS need
        FROM base b LEFT JOIN kth k USING (run, query_id))
      SELECT run, query_id,
        CASE WHEN held >= 10 AND need <= 3 THEN need ELSE 3 END::INT AS topup_rounds,
        (8 + 4 * CASE WHEN held >= 10 AND need <= 3 THEN need ELSE 3 END)::INT AS drawn,
        CASE WHEN held >= 10 AND need <= 3 THEN 'filled' ELSE 'cap' END AS stopped FROM n"""),
)
def draws_to_fill(spark, path):
    """Eight draws first, four per top-up, at most twenty, for ten distinct items."""
    return judge.draws_to_fill(
        t.raw_draws(spark, path), 10, first_round=8, round_size=4, cap=20, queries=t.queries(spark, path)
    )


# ------------------------------------------------------------------- metrics


def _report_sql() -> str:
    cells = ["('n_queries', NULL, n)"]
    for suffix, order in (("", "gen"), ("_consensus", "con")):
        for name, m in (("recovery", "fp"), ("structure_accuracy", "ex")):
            for k in KS:
                cells.append(
                    f"('{name}_at_k{suffix}', {k}, {name}_{order}_{k})"
                )
    for c in (
        "validity duplicate_rate unique_valid_per_query mean_samples_per_query "
        "mean_candidates_per_query mean_scored_per_query budget_filled_rate "
        "mean_best_tanimoto mean_hit_rank"
    ).split():
        cells.append(f"('{c}', NULL, {c})")
    aggs = []
    for order in ("gen", "con"):
        for name, m in (("recovery", "fp"), ("structure_accuracy", "ex")):
            for k in KS:
                aggs.append(
                    f"avg(coalesce(rank_{order}_{m} < {k}, false)::INT) AS {name}_{order}_{k}"
                )
    body = f"""
    , sl AS (SELECT 'all' AS slice, * FROM summary
             UNION ALL SELECT 'fp_unseen', * FROM summary WHERE fp_unseen),
    w AS (SELECT run, slice, count(*)::DOUBLE AS n, {', '.join(aggs)},
      coalesce(sum(n_valid) / nullif(sum(n_candidates), 0), 0.0) AS validity,
      coalesce(sum(n_duplicate) / nullif(sum(n_candidates), 0), 0.0) AS duplicate_rate,
      avg(n_scored) AS unique_valid_per_query,
      CASE WHEN sum(n_samples) > 0 THEN sum(n_samples) / count(*) END AS mean_samples_per_query,
      avg(n_candidates) AS mean_candidates_per_query, avg(n_scored) AS mean_scored_per_query,
      avg((n_scored >= {max(KS)})::INT) AS budget_filled_rate,
      avg(best_tanimoto) AS mean_best_tanimoto, avg(rank_gen_fp) AS mean_hit_rank
      FROM sl GROUP BY run, slice)
    """
    selects = []
    for c in cells:
        metric, k, column = [p.strip() for p in c.strip("()").split(",")]
        k = "NULL::INT" if k == "NULL" else f"{k}::INT"
        selects.append(
            f"SELECT run, slice, {metric} AS metric, {k} AS k, "
            f"round({column}::DOUBLE, 8) AS value FROM w"
        )
    return _sql(body + _union(selects))


@query("slice_report", _report_sql())
def slice_report(spark, path):
    """Every metric over both slices for every run."""
    return metrics.recovery_report(_summary(spark, path), KS)


@query(
    "recovery_at_k",
    _sql(
        " SELECT run, k, round(avg(coalesce(rank_gen_fp < k, false)::INT), 8) AS recovery, "
        "round(avg(coalesce(rank_gen_ex < k, false)::INT), 8) AS structure, count(*) AS n_queries "
        "FROM summary, (VALUES (1), (5), (20)) ks(k) WHERE fp_unseen GROUP BY run, k"
    ),
)
def recovery_at_k(spark, path):
    wide = metrics.slice_metrics(_summary(spark, path), KS).filter(F.col("slice") == "fp_unseen")
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.col(f"recovery_at_{k}").alias("recovery"),
                F.col(f"structure_accuracy_at_{k}").alias("structure"),
            )
            for k in KS
        ]
    )
    return wide.select("run", F.explode(cells).alias("c"), "n_queries").select(
        "run", "c.*", "n_queries"
    )


@query(
    "strings_budget_recovery",
    _sql(""", sp AS (SELECT run, query_id, fp_match,
        row_number() OVER (PARTITION BY run, query_id ORDER BY pos) - 1 AS slot
        FROM judged WHERE NOT duplicate),
      h AS (SELECT run, query_id, min(slot) FILTER (fp_match) AS r FROM sp GROUP BY ALL)
      SELECT q.run, k, round(avg(coalesce(h.r < k, false)::INT), 8) AS recovery
      FROM queries q LEFT JOIN h USING (run, query_id), (VALUES (1), (5), (20)) ks(k)
      WHERE q.fp_unseen GROUP BY q.run, k"""),
)
def strings_budget_recovery(spark, path):
    """Recovery when invalid strings take slots as well."""
    rows = _summary(spark, path, budget="strings").filter("fp_unseen")
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.avg(metrics.hit_at(k).cast("double")).alias("recovery"))
            for k in KS
        ]
    )
    return rows.groupBy("run").agg(cells.alias("c")).select(
        "run", F.explode("c").alias("c")
    ).select("run", "c.*")


@query(
    "run_headline",
    _sql(""" SELECT run, round(avg(coalesce(rank_gen_fp < 20, false)::INT) FILTER (fp_unseen), 8)
        AS primary_metric, 'recovery@20 (fp_unseen)' AS primary_metric_name,
        round(count(*) FILTER (fp_unseen) / count(*), 8) AS fp_unseen_fraction,
        'molecules' AS budget, count(*) AS n_queries,
        sum(n_candidates)::BIGINT AS n_candidates FROM summary GROUP BY run"""),
)
def run_headline(spark, path):
    return metrics.run_headline(_summary(spark, path), KS)


@query(
    "baseline_delta",
    _sql(""", h AS (SELECT run, avg(coalesce(rank_gen_fp < 20, false)::INT) AS pm
        FROM summary WHERE fp_unseen GROUP BY run)
      SELECT run, round(pm, 8) AS primary_metric,
        round(pm - (SELECT pm FROM h WHERE run = 's1'), 8) AS delta FROM h WHERE run <> 's1'"""),
)
def baseline_delta(spark, path):
    return metrics.baseline_delta(metrics.run_headline(_summary(spark, path), KS), "s1")


@query(
    "consensus_rerank",
    _sql(
        " SELECT run, count(*) AS n_fp_unseen, "
        + ", ".join(
            f"round(avg(coalesce(rank_{o}_{m} < {k}, false)::INT), 8) AS {name}_{k}"
            for name, o, m in (
                ("generation", "gen", "fp"),
                ("consensus", "con", "fp"),
                ("structure_generation", "gen", "ex"),
                ("structure_consensus", "con", "ex"),
            )
            for k in KS
        )
        + ", round(sum(n_duplicate) / sum(n_candidates), 8) AS duplicate_rate, "
        "round(avg(n_scored), 8) AS unique_valid_per_query FROM summary WHERE fp_unseen GROUP BY run"
    ),
)
def consensus_rerank(spark, path):
    return protocols.rerank(_summary(spark, path), KS)


# ---------------------------------------------------------- bands and pairs

_RATES = ", ".join(f"avg(h_{r}::INT) AS r_{r}" for r in R3)


@query(
    "recovery_by_band",
    _sql(
        f", {v.wide_hits(R3, 20)}, {v.bands(BANDS)}, "
        f"g AS (SELECT band, count(*) AS n, {_RATES} FROM wide JOIN bands ON size BETWEEN lo AND hi "
        "GROUP BY band), l AS ("
        + _union([f"SELECT band, '{r}' AS run, n, r_{r} AS rate FROM g" for r in R3])
        + """) SELECT band, run, n AS n_queries,
          round(n / (SELECT count(*) FROM wide), 8) AS share_of_protocol, round(rate, 8) AS rate,
          round(avg(rate) OVER (PARTITION BY band), 8) AS between_run_mean,
          round(100 * stddev_samp(rate) OVER (PARTITION BY band), 8) AS between_run_sd_points
          FROM l"""
    ),
)
def recovery_by_band(spark, path):
    rates, _ = protocols.band_analysis(_summary(spark, path), R3, BANDS, k=20)
    return rates


_PAIRS = (("s1", "s2"), ("s1", "s3"), ("s2", "s3"))


def _pair_sql(with_band: bool, rank="rank_gen_fp") -> str:
    group = "band" if with_band else "'all' AS band"
    source = "wide JOIN bands ON size BETWEEN lo AND hi" if with_band else "wide"
    parts = [
        f"SELECT {group}, '{a}' AS a, '{b}' AS b, count(*) AS n_queries, "
        f"avg(h_{a}::INT) AS rate_a, avg(h_{b}::INT) AS rate_b, "
        f"count(*) FILTER (h_{b} AND NOT h_{a}) AS b_only, "
        f"count(*) FILTER (h_{a} AND NOT h_{b}) AS a_only FROM {source}"
        + (" GROUP BY band" if with_band else "")
        for a, b in _PAIRS
    ]
    seed = (
        ""
        if with_band
        else f", round(100 * (rate_b - rate_a) / {stats.SEED_SD_POINTS * 2 ** 0.5}, 8) AS gap_in_seed_sd"
    )
    band = "band, " if with_band else ""
    return _sql(
        f", {v.wide_hits(R3, 20, rank)}, {v.bands(BANDS)}, p AS ({_union(parts)}) "
        f"SELECT {band}a, b, n_queries, round(rate_a, 8) AS rate_a, round(rate_b, 8) AS rate_b, "
        "b_only, a_only, round(100 * (rate_b - rate_a), 8) AS gap_points, "
        "round(100 * sqrt(b_only + a_only) / n_queries, 8) AS paired_se_points, "
        "CASE WHEN b_only + a_only = 0 THEN 0.0 ELSE round((rate_b - rate_a) "
        "/ (sqrt(b_only + a_only) / n_queries), 8) END AS gap_in_paired_se, "
        f"round({v.mcnemar('b_only', 'a_only')}, 8) AS mcnemar_p{seed} FROM p"
    )


@query("band_pairs", _pair_sql(True))
def band_pairs(spark, path):
    _, pairs = protocols.band_analysis(_summary(spark, path), R3, BANDS, k=20)
    return pairs


@query("paired_mcnemar", _pair_sql(False))
def paired_mcnemar(spark, path):
    return paired.paired_tests(paired.hit_matrix(_summary(spark, path), R3, 20), R3)


@query("paired_mcnemar_consensus", _pair_sql(False, "rank_con_fp"))
def paired_mcnemar_consensus(spark, path):
    return paired.paired_tests(paired.hit_matrix(_summary(spark, path), R3, 20, "consensus"), R3)


@query(
    "seed_variance",
    _sql(
        f", {v.wide_hits(R3, 20)}, g AS (SELECT count(*) AS n, {_RATES}, "
        + ", ".join(
            f"sqrt(count(*) FILTER (h_{a} <> h_{b})) AS d_{a}_{b}" for a, b in _PAIRS
        )
        + """ FROM wide), m AS (SELECT *, list_value(r_s1, r_s2, r_s3) AS r FROM g)
        SELECT n AS n_queries, round(list_avg(r), 8) AS mean,
          round(100 * list_stddev_samp(r), 8) AS sd_points,
          round(100 * (list_max(r) - list_min(r)), 8) AS range_points,
          round(100 * list_stddev_samp(r) / sqrt(3), 8) AS se_of_mean_points,
          round(100 * sqrt(list_avg(r) * (1 - list_avg(r)) / n), 8) AS binomial_se_points,
          round(100 * (d_s1_s2 + d_s1_s3 + d_s2_s3) / 3 / n, 8) AS mean_mcnemar_se_points FROM m"""
    ),
)
def seed_variance(spark, path):
    return paired.seed_variance(paired.hit_matrix(_summary(spark, path), R3, 20), R3)


@query(
    "seed_pairs",
    _sql(
        f", {v.wide_hits(R3, 20)}, p AS ("
        + _union(
            [
                f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, avg(h_{a}::INT) - avg(h_{b}::INT) AS d, "
                f"count(*) FILTER (h_{a} <> h_{b}) AS discordant FROM wide"
                for a, b in _PAIRS
            ]
        )
        + """) SELECT a, b, round(100 * d, 8) AS difference_points, discordant,
          round(discordant / n, 8) AS discordant_rate,
          round(100 * sqrt(discordant) / n, 8) AS mcnemar_se_points FROM p"""
    ),
)
def seed_pairs(spark, path):
    return paired.seed_pairs(paired.hit_matrix(_summary(spark, path), R3, 20), R3)


@query(
    "seed_agreement",
    _sql(
        f", {v.wide_hits(R3, 20)}, s AS (SELECT size, h_s1::INT + h_s2::INT + h_s3::INT AS j FROM wide), "
        "tot2 AS (SELECT count(*) AS n, avg(j) / 3 AS p FROM s) "
        "SELECT js.j AS solved_by, count(s.j) AS observed, "
        "round((SELECT n * (factorial(3) / (factorial(js.j) * factorial(3 - js.j)))::DOUBLE "
        "* pow(p, js.j) * pow(1 - p, 3 - js.j) FROM tot2), 6) AS expected_if_independent, "
        "median(s.size)::DOUBLE AS median_size "
        "FROM (VALUES (0), (1), (2), (3)) js(j) LEFT JOIN s ON s.j = js.j GROUP BY js.j"
    ),
)
def seed_agreement(spark, path):
    rows = paired.seed_agreement(paired.hit_matrix(_summary(spark, path), R3, 20), R3)
    return rows.withColumn(
        "expected_if_independent", F.round("expected_if_independent", 6)
    )


@query(
    "run_signatures",
    _sql(" SELECT run, count(*) AS n, sum(query_id)::BIGINT AS id_sum FROM queries "
         "WHERE fp_unseen GROUP BY run"),
)
def run_signatures(spark, path):
    """Checks that all runs cover the same queries, then counts them."""
    rows = same_queries(t.queries(spark, path)).filter("fp_unseen")
    return rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.sum("query_id").alias("id_sum")
    )


# ------------------------------------------------------------------- anatomy

_RAW = """, rs AS (SELECT q.run, q.query_id, q.size, count(j.pos) AS n_slots,
    min(j.pos) FILTER (j.fp_match) + 1 AS fp_rank,
    min(j.pos) FILTER (j.exact_structure) + 1 AS st_rank,
    coalesce(max(j.tanimoto) FILTER (j.valid), 0.0) AS best
  FROM queries q LEFT JOIN judged j ON j.run = q.run AND j.query_id = q.query_id AND j.pos < 20
  WHERE q.fp_unseen GROUP BY q.run, q.query_id, q.size)"""


def _raw_slots(spark, path, runs=R3):
    return anatomy.raw_slots(t.queries(spark, path, runs), t.judged(spark, path, runs), 20)


@query(
    "miss_anatomy",
    _sql(
        _RAW
        + f", {v.bands(BANDS)} "
        + """SELECT run, band, count(*) AS n_queries,
      round(avg((fp_rank IS NOT NULL)::INT), 8) AS recovery,
      round(avg((st_rank IS NOT NULL)::INT), 8) AS structure,
      round(coalesce(avg((st_rank IS NULL)::INT) FILTER (fp_rank IS NOT NULL), 0), 8)
        AS collision_rate_among_hits,
      round(avg(best) FILTER (fp_rank IS NULL), 8) AS mean_best_tanimoto_among_misses,
      round(coalesce(avg((best >= 0.9)::INT) FILTER (fp_rank IS NULL), 0), 8)
        AS fraction_of_misses_above_0_9,
      round(avg((n_slots >= 20)::INT), 8) AS budget_filled_rate,
      round(avg(fp_rank), 8) AS mean_fp_hit_rank
      FROM rs JOIN bands ON size BETWEEN lo AND hi GROUP BY run, band"""
    ),
)
def miss_anatomy(spark, path):
    return anatomy.miss_anatomy(_raw_slots(spark, path), 20, BANDS)


_LADDER = (
    _RAW
    + f", {v.bands(BANDS)}, ladder AS (SELECT run, band, count(*) AS n_queries, k, "
    "avg(coalesce(fp_rank <= k, false)::INT) AS recovery FROM rs JOIN bands ON size BETWEEN lo AND hi, "
    "(VALUES (1), (2), (5), (10), (20)) rungs(k) GROUP BY run, band, k)"
)


@query(
    "recovery_ladder",
    _sql(_LADDER + " SELECT run, band, n_queries, k, round(recovery, 8) AS recovery FROM ladder"),
)
def recovery_ladder(spark, path):
    return anatomy.recovery_ladder(_raw_slots(spark, path), 20, BANDS)


@query(
    "ladder_gain",
    _sql(
        _LADDER
        + """ SELECT run, band,
        round(CASE WHEN b <> 0 THEN (b - a) / b END, 8) AS last_half_share,
        round(100 * (b - a), 8) AS gain_points FROM (
          SELECT run, band, max(recovery) FILTER (k = 10) AS a, max(recovery) FILTER (k = 20) AS b
          FROM ladder GROUP BY run, band)"""
    ),
)
def ladder_gain(spark, path):
    return anatomy.ladder_gain(anatomy.recovery_ladder(_raw_slots(spark, path), 20, BANDS))


@query(
    "validity_by_band",
    _sql(
        f", {v.bands(BANDS)} SELECT run, band, count(*) AS n_queries, "
        "round(sum(n_valid) / nullif(sum(n_candidates), 0), 8) AS validity, "
        "round(sum(n_valid) / count(*), 8) AS valid_per_query, "
        "round(sum(n_candidates) / count(*), 8) AS proposals_per_query, "
        "round(sum(n_duplicate) / nullif(sum(n_candidates), 0), 8) AS duplicate_rate "
        "FROM summary JOIN bands ON size BETWEEN lo AND hi WHERE fp_unseen GROUP BY run, band"
    ),
)
def validity_by_band(spark, path):
    return anatomy.validity_by_band(_summary(spark, path), BANDS)


_BIAS = f""", fk AS (SELECT r.run, r.query_id, q.size, r.first_pos, r.cand_size, r.fp_match
    FROM ranked r JOIN queries q USING (run, query_id)
    WHERE r.gen < 20 AND q.fp_unseen AND r.cand_size > 0),
  pq AS (SELECT run, query_id, size, bool_or(fp_match) AS hit, avg(cand_size) AS mp,
    count(*) AS n_prop, arg_min(cand_size, abs(cand_size - size) * 100000 + first_pos) AS closest,
    count(*) FILTER (cand_size = size) AS n_right,
    count(*) FILTER (cand_size = size AND fp_match) AS n_rm,
    count(*) FILTER (fp_match) AS n_match FROM fk GROUP BY run, query_id, size),
  {v.bands(BANDS)}"""


def _bias_rows(spark, path):
    return anatomy.size_bias_queries(t.queries(spark, path), t.judged(spark, path), 20)


@query(
    "size_bias",
    _sql(
        _BIAS
        + " SELECT run, band, count(*) AS n_queries, "
        + ", ".join(
            f"count(*) FILTER ({c}) AS n_{n}, round(avg(mp) FILTER ({c}), 8) AS {n}_mean_proposal, "
            f"round(avg(mp - size) FILTER ({c}), 8) AS {n}_mean_bias, "
            f"round(avg(closest - size) FILTER ({c}), 8) AS {n}_closest_bias"
            for n, c in (("miss", "NOT hit"), ("hit", "hit"))
        )
        + " FROM pq JOIN bands ON size BETWEEN lo AND hi GROUP BY run, band"
    ),
)
def size_bias(spark, path):
    return anatomy.size_bias(_bias_rows(spark, path), BANDS)


@query(
    "right_size",
    _sql(
        _BIAS
        + """ SELECT run, band, count(*) AS n_queries,
      round(sum(n_prop) / count(*), 8) AS valid_per_query,
      round(sum(n_right) / count(*), 8) AS right_size_per_query,
      round(sum(n_right) / sum(n_prop), 8) AS share_of_proposals,
      round(count(*) FILTER (n_right > 0) / count(*), 8) AS queries_with_any,
      round(sum(n_rm) / nullif(sum(n_right), 0), 8) AS match_rate_among_right_size
      FROM pq JOIN bands ON size BETWEEN lo AND hi GROUP BY run, band"""
    ),
)
def right_size(spark, path):
    return anatomy.right_size(_bias_rows(spark, path), BANDS)


@query(
    "preimage_poisson",
    _sql(
        _BIAS
        + """ SELECT run, band, count(*) AS n_queries,
      round(count(*) FILTER (n_match > 0) / count(*), 8) AS recovery,
      round(sum(n_match) / count(*), 8) AS preimages_per_query,
      round(1 - exp(-sum(n_match) / count(*)), 8) AS poisson_recovery,
      round(count(*) FILTER (n_match = 0) / count(*), 8) AS share_none,
      round(count(*) FILTER (n_match = 1) / count(*), 8) AS share_one,
      round(count(*) FILTER (n_match = 2) / count(*), 8) AS share_two,
      round(count(*) FILTER (n_match >= 3) / count(*), 8) AS share_three_plus,
      round(sum(n_match) / nullif(count(*) FILTER (n_match > 0), 0), 8) AS preimages_per_hit
      FROM pq JOIN bands ON size BETWEEN lo AND hi GROUP BY run, band"""
    ),
)
def preimage_poisson(spark, path):
    return anatomy.preimages(_bias_rows(spark, path), BANDS)


_SUPPLIER_BANDS = """bands AS (SELECT s_suppkey AS band, CASE WHEN s_nationkey % 9 <> 0 THEN s_suppkey % 53 END AS lo,
    CASE WHEN s_nationkey % 7 <> 0 THEN s_suppkey % 53 + s_nationkey END AS hi FROM supplier)"""


@query(
    "recovery_by_band_table",
    _sql(
        f""", {_SUPPLIER_BANDS}, u AS (SELECT size, coalesce(rank_gen_fp < 20, false)::INT AS hit FROM summary WHERE fp_unseen)
      SELECT band, lo, hi, count(size) AS n, coalesce(sum(hit), 0)::BIGINT AS hits FROM bands
      LEFT JOIN u ON (lo IS NULL OR size >= lo) AND (hi IS NULL OR size <= hi) GROUP BY band, lo, hi"""
    ),
)
def recovery_by_band_table(spark, path):
    """Recovery within a band of each supplier: bands from a table, overlapping, some open-ended."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    low = (key % 53).cast("long")
    bands = t.table(spark, path, "supplier").select(
        key.alias("band"), F.when(nation % 9 != 0, low).alias("lo"), F.when(nation % 7 != 0, low + nation).alias("hi")
    )
    rows = _summary(spark, path).filter("fp_unseen").select("size", metrics.hit_at(20).cast("long").alias("hits"))
    return count_by_band(rows, "size", bands, "hits")


_FAIL = f""", f AS (SELECT *, coalesce(rank_gen_fp < 10, false) AS hit,
    {v.hb("'w:' || query_id", 4)} AS twins, {v.hb("'l:' || query_id", 30)} AS n_tokens,
    {v.hb("'c:' || query_id", 3)} = 0 AS charged
  FROM summary WHERE fp_unseen)"""


def _failure_rows(spark, path):
    q = F.col("query_id")
    return (
        _summary(spark, path)
        .filter("fp_unseen")
        .withColumn("hit", metrics.hit_at(10))
        .withColumn("twins", hash_bucket(4, "w", q))
        .withColumn("n_tokens", hash_bucket(30, "l", q))
        .withColumn("charged", hash_bucket(3, "c", q) == 0)
    )


@query(
    "failure_taxonomy",
    _sql(
        _FAIL
        + """, b AS (SELECT run, CASE WHEN n_tokens > 27 THEN 'too_long'
        WHEN rank_gen_fp IS NOT NULL THEN 'beyond_budget' WHEN twins > 0 THEN 'collision'
        WHEN best_tanimoto >= 0.9 THEN 'near' WHEN best_tanimoto >= 0.7 THEN 'analogue'
        ELSE 'far' END AS bucket FROM f WHERE NOT hit)
      SELECT run, bucket, count(*) AS n,
        round(count(*) / sum(count(*)) OVER (PARTITION BY run), 8) AS share
      FROM b GROUP BY run, bucket"""
    ),
)
def failure_taxonomy(spark, path):
    rows = _failure_rows(spark, path).filter(~F.col("hit"))
    bucket = anatomy.failure_bucket(
        F.col("n_tokens") > 27,
        F.col("rank_gen_fp").isNotNull(),
        F.col("twins"),
        F.col("best_tanimoto"),
    )
    return anatomy.failure_taxonomy(rows.withColumn("bucket", bucket))


_EDGES = (0, 15, 20, 25, 30, 35, 40, 50, 70)


@query(
    "recovery_by_bins",
    _sql(
        _FAIL
        + ", edges(lo, hi) AS (VALUES "
        + ", ".join(f"({a}, {b})" for a, b in zip(_EDGES, _EDGES[1:]))
        + ") SELECT run, lo || '-' || (hi - 1) AS bin, count(*) AS n, "
        "round(avg(hit::INT), 8) AS recovery FROM f JOIN edges ON size >= lo AND size < hi "
        "GROUP BY run, lo, hi"
    ),
)
def recovery_by_bins(spark, path):
    return anatomy.recovery_by_bins(_failure_rows(spark, path), "size", _EDGES)


@query(
    "success_vs_failure",
    _sql(
        _FAIL
        + " "
        + _union(
            [
                f"SELECT run, '{a}' AS attribute, median({a}) FILTER (hit)::DOUBLE AS hit_median, "
                f"median({a}) FILTER (NOT hit)::DOUBLE AS fail_median FROM f GROUP BY run"
                for a in ("size", "n_tokens", "n_candidates")
            ]
        )
    ),
)
def success_vs_failure(spark, path):
    attributes = ("size", "n_tokens", "n_candidates")
    rows = materialize(_failure_rows(spark, path).select("run", "hit", *attributes), "failures")
    return anatomy.success_vs_failure(rows, attributes)


@query(
    "recovery_by_flag",
    _sql(
        _FAIL
        + " "
        + _union(
            [
                f"SELECT run, '{n}' AS flag, count(*) FILTER ({c}) AS n_with, "
                f"round(avg(hit::INT) FILTER ({c}), 8) AS recovery_with, "
                f"round(avg(hit::INT) FILTER (NOT ({c})), 8) AS recovery_without FROM f GROUP BY run"
                for n, c in (("charged", "charged"), ("with_twin", "twins > 0"))
            ]
        )
    ),
)
def recovery_by_flag(spark, path):
    return anatomy.recovery_by_flag(
        _failure_rows(spark, path), {"charged": F.col("charged"), "with_twin": F.col("twins") > 0}
    )


@query(
    "failure_report",
    _sql(""" SELECT run, count(*) AS n_queries,
      round(avg(coalesce(rank_gen_fp < 10, false)::INT), 8) AS recovery,
      round(avg((rank_gen_fp IS NOT NULL)::INT), 8) AS recovery_any_drawn,
      count(*) FILTER (NOT coalesce(rank_gen_fp < 10, false)) AS n_fail,
      count(*) FILTER (n_scored < 10) AS n_underfilled,
      round(avg(coalesce(rank_gen_fp < 10, false)::INT) FILTER (n_scored < 10), 8)
        AS recovery_underfilled,
      round(avg(best_tanimoto) FILTER (NOT coalesce(rank_gen_fp < 10, false)), 8)
        AS fail_best_tanimoto_mean
      FROM summary WHERE fp_unseen GROUP BY run"""),
)
def failure_report(spark, path):
    return anatomy.failure_report(_summary(spark, path), 10)


_SCORES = ("generation", "n_spellings", "similarity")


@query(
    "rerank_orders",
    _sql(
        # Materialized because DuckDB 2.0 turns the inlined bound into a limit of 9.
        """, f10 AS MATERIALIZED (SELECT * FROM ranked WHERE gen < 10), o AS ("""
        + _union(
            [
                f"SELECT run, query_id, '{n}' AS ord_name, fp_match, exact_structure, "
                f"row_number() OVER (PARTITION BY run, query_id ORDER BY {s} DESC, gen) AS rn FROM f10"
                for n, s in zip(_SCORES, ("0 * gen", "votes", "tanimoto"))
            ]
        )
        + """), p AS (SELECT run, query_id, ord_name,
          bool_or(fp_match AND rn <= 1) AS h1, bool_or(exact_structure AND rn <= 1) AS e1,
          bool_or(fp_match AND rn <= 5) AS h5, bool_or(exact_structure AND rn <= 5) AS e5
          FROM o GROUP BY ALL)
        SELECT q.run, n.ord_name AS "order", round(avg(coalesce(h1, false)::INT), 8) AS hit_1,
          round(avg(coalesce(e1, false)::INT), 8) AS exact_1,
          round(avg(coalesce(h5, false)::INT), 8) AS hit_5,
          round(avg(coalesce(e5, false)::INT), 8) AS exact_5
        FROM queries q CROSS JOIN (VALUES ('generation'), ('n_spellings'), ('similarity')) n(ord_name)
        LEFT JOIN p ON p.run = q.run AND p.query_id = q.query_id AND p.ord_name = n.ord_name
        WHERE q.fp_unseen GROUP BY q.run, n.ord_name"""
    ),
)
def rerank_orders(spark, path):
    first_k = judge.slots(t.judged(spark, path), 10)
    per_query = anatomy.rerank_orders(
        first_k,
        dict(zip(_SCORES, (F.lit(0.0), F.col("votes"), F.col("tanimoto")))),
    )
    return anatomy.rerank_rates(t.queries(spark, path), per_query, _SCORES)


# ---------------------------------------------------------------- arms, mixes

_ARMS = [parse_arm(a) for a in ("ref=s1,s2", "mix=s3,s4", "solo=s5")]


def _arm_rates_sql() -> str:
    rates = ", ".join(f"avg(h_{r}::INT) AS r_{r}" for r in R5)
    return (
        f", {v.wide_hits(R5, 20)}, {v.bands(BANDS)}, g AS (SELECT band, count(*) AS n, {rates} "
        "FROM wide JOIN bands ON size BETWEEN lo AND hi GROUP BY band)"
    )


def _arm_rows() -> str:
    rows = [
        "SELECT band, 'mix' AS arm, n, list_value(r_s1, r_s2) AS rf, list_value(r_s3, r_s4) AS vs FROM g",
        "SELECT band, 'solo' AS arm, n, list_value(r_s1, r_s2) AS rf, list_value(r_s5) AS vs FROM g",
    ]
    return f", a AS ({_union(rows)})"


@query(
    "arm_table",
    _sql(
        _arm_rates_sql()
        + _arm_rows()
        + """, b AS (SELECT *, list_avg(rf) AS rm, list_avg(vs) AS vm, list_stddev_samp(rf) AS rsd,
          CASE WHEN len(vs) > 1 THEN list_stddev_samp(vs) END AS vsd FROM a),
        c AS (SELECT *, sqrt(pow(rsd, 2) / 2 + pow(coalesce(vsd, rsd), 2) / len(vs)) AS se FROM b)
        SELECT band, arm, n AS n_queries, round(rm, 8) AS reference_mean, round(vm, 8) AS mean,
          round(vsd, 8) AS sd, round(100 * (vm - rm), 8) AS gap_points,
          round(100 * se, 8) AS se_points,
          round(CASE WHEN se > 0 THEN (vm - rm) / se END, 8) AS gap_in_se,
          list_sum(list_transform(rf, lambda r: len(list_filter(vs, lambda x: x > r))))::INT
            AS pairs_favouring,
          (len(rf) * len(vs))::INT AS pairs_total, vsd IS NULL AS sd_borrowed FROM c""",
        R5,
    ),
)
def arm_table(spark, path):
    rates, _ = protocols.band_analysis(_summary(spark, path, R5), R5, BANDS, k=20)
    return arms.arm_table(rates, _ARMS)


_QUANTITIES = (
    "recovery",
    "structure",
    "collision_rate_among_hits",
    "mean_best_tanimoto_among_misses",
    "fraction_of_misses_above_0_9",
)


def _cloud_sql(tail: str) -> str:
    body = (
        _RAW
        + f", {v.bands(BANDS)}, an AS (SELECT run, band, "
        "avg((fp_rank IS NOT NULL)::INT) AS recovery, avg((st_rank IS NOT NULL)::INT) AS structure, "
        "coalesce(avg((st_rank IS NULL)::INT) FILTER (fp_rank IS NOT NULL), 0) AS collision_rate_among_hits, "
        "avg(best) FILTER (fp_rank IS NULL) AS mean_best_tanimoto_among_misses, "
        "coalesce(avg((best >= 0.9)::INT) FILTER (fp_rank IS NULL), 0) AS fraction_of_misses_above_0_9 "
        "FROM rs JOIN bands ON size BETWEEN lo AND hi GROUP BY run, band), lg AS ("
        + _union([f"SELECT run, band, '{q}' AS quantity, {q} AS val FROM an" for q in _QUANTITIES])
        + """), am AS (SELECT quantity, band, CASE WHEN run IN ('s1','s2') THEN 'ref' ELSE 'mix' END
          AS arm, avg(val) AS mean FROM lg WHERE run IN ('s1','s2','s3','s4') GROUP BY ALL),
        cq AS (SELECT m.quantity, m.band, m.arm, r.mean AS reference_mean, m.mean,
          100 * (m.mean - r.mean) AS gap_points FROM am m JOIN am r
          ON r.quantity = m.quantity AND r.band = m.band AND r.arm = 'ref' WHERE m.arm = 'mix')"""
    )
    return _sql(body + tail, ("s1", "s2", "s3", "s4"))


def _cloud(spark, path):
    runs = ("s1", "s2", "s3", "s4")
    table = anatomy.miss_anatomy(_raw_slots(spark, path, runs), 20, BANDS)
    return arms.cloud_quality(table, _ARMS[:2], _QUANTITIES)


@query(
    "cloud_quality",
    _cloud_sql(
        " SELECT quantity, band, arm, round(reference_mean, 8) AS reference_mean, "
        "round(mean, 8) AS mean, round(gap_points, 8) AS gap_points FROM cq"
    ),
)
def cloud_quality(spark, path):
    return _cloud(spark, path)


@query(
    "cloud_conversion",
    _cloud_sql(
        """ SELECT band, arm, round(c, 8) AS cause_points, round(e, 8) AS effect_points,
        round(CASE WHEN abs(c) > 1e-9 THEN e / c END, 6) AS ratio FROM (SELECT band, arm,
          max(gap_points) FILTER (quantity = 'mean_best_tanimoto_among_misses') AS c,
          max(gap_points) FILTER (quantity = 'recovery') AS e FROM cq GROUP BY band, arm)"""
    ),
)
def cloud_conversion(spark, path):
    rows = arms.cloud_conversion(
        _cloud(spark, path), "mean_best_tanimoto_among_misses", "recovery"
    )
    return rows.withColumn("ratio", F.round("ratio", 6))


_MIXES = (("low", 26, 2.0, "s3"), ("high", 26, 4.0, "s4,s5"))


def _exposure_sql(tail: str) -> str:
    expo = _union(
        [
            f"SELECT '{name}' AS arm, band, "
            f"(sum(CASE WHEN size BETWEEN lo AND hi THEN CASE WHEN size >= {th} THEN {f} ELSE 1.0 END END) "
            f"/ sum(CASE WHEN size >= {th} THEN {f} ELSE 1.0 END)) "
            "/ (count(*) FILTER (size BETWEEN lo AND hi) / count(*)) AS ratio "
            "FROM qs, bands GROUP BY band"
            for name, th, f, _ in _MIXES
        ]
    )
    rates = ", ".join(f"avg(h_{r}::INT) AS r_{r}" for r in R5)
    body = f""", {v.wide_hits(R5, 20)}, {v.bands(t.ELEMENTARY)},
      qs AS (SELECT DISTINCT query_id, size FROM queries), expo AS ({expo}),
      g AS (SELECT band, count(*) AS n, {rates} FROM wide JOIN bands ON size BETWEEN lo AND hi
        GROUP BY band),
      m AS (SELECT band, 'low' AS arm, n, r_s3 AS mix, (r_s1 + r_s2) / 2 AS ref FROM g
        UNION ALL SELECT band, 'high', n, (r_s4 + r_s5) / 2, (r_s1 + r_s2) / 2 FROM g),
      er AS (SELECT m.*, e.ratio, log2(e.ratio) AS lx, 100 * (mix - ref) AS gap,
        n * (mix - ref) AS items FROM m JOIN expo e USING (arm, band)),
      es AS (SELECT arm, coalesce(sum(items) FILTER (items < 0), 0.0) AS lost,
        coalesce(sum(items) FILTER (items > 0), 0.0) AS gained, sum(n)::BIGINT AS n_total,
        CASE WHEN regr_sxx(gap, lx) >= 1e-9 AND regr_syy(gap, lx) >= 1e-9
          THEN regr_slope(gap, lx) END AS s,
        CASE WHEN regr_sxx(gap, lx) >= 1e-9 AND regr_syy(gap, lx) >= 1e-9
          THEN regr_intercept(gap, lx) END AS i,
        CASE WHEN regr_sxx(gap, lx) >= 1e-9 AND regr_syy(gap, lx) >= 1e-9
          THEN corr(gap, lx) END AS r,
        coalesce(avg(lx) FILTER (ratio > 1), max(lx)) AS dose FROM er GROUP BY arm)"""
    return _sql(body + tail, R5)


def _exposure(spark, path):
    rates, _ = protocols.band_analysis(_summary(spark, path, R5), R5, t.ELEMENTARY, k=20)
    sizes = t.table(spark, path, "customer").select(t.query_size(F.col("c_custkey")).alias("size"))
    exposure = None
    for name, threshold, factor, _ in _MIXES:
        mix = arms.mix_summary(sizes, "size", threshold, factor, t.ELEMENTARY)
        part = mix.filter(F.col("band") != "at_or_above_threshold").select(
            F.lit(name).alias("arm"), "band", stats.safe_ratio(F.col("weighted_share"), F.col("share")).alias("ratio")
        )
        exposure = part if exposure is None else exposure.unionByName(part)
    mixes = [parse_arm(f"{name}={runs}") for name, _, _, runs in _MIXES]
    return arms.exposure_rows(rates, _ARMS[0], mixes, exposure)


@query(
    "exposure_rows",
    _exposure_sql(
        """ SELECT arm, band, n AS n_queries, round(mix, 8) AS mix, round(ref, 8) AS reference,
        round(ratio, 8) AS ratio, round(lx, 8) AS log2_exposure, round(gap, 8) AS gap_points,
        round(items, 6) AS items,
        round(CASE WHEN lx <> 0 THEN gap / lx END, 6) AS points_per_doubling FROM er"""
    ),
)
def exposure_rows(spark, path):
    rows = _exposure(spark, path)
    return rows.withColumn("items", F.round("items", 6)).withColumn(
        "points_per_doubling", F.round("points_per_doubling", 6)
    )


@query(
    "exposure_summary",
    _exposure_sql(
        """ SELECT arm, round(lost, 6) AS items_lost, round(gained, 6) AS items_gained, n_total,
        round(s, 6) AS fit_points_per_doubling, round(i, 6) AS fit_intercept, round(r, 6) AS fit_r,
        round(dose, 6) AS dose, round(lost + gained, 6) AS items_net,
        round(100 * (lost + gained) / n_total, 6) AS net_points,
        round(CASE WHEN lost <> 0 AND gained <> 0 THEN -lost / gained END, 6) AS given_up_per_gain
        FROM es"""
    ),
)
def exposure_summary(spark, path):
    rows = arms.exposure_summary(_exposure(spark, path))
    return rows.select(
        *[F.round(c, 6).alias(c) if ty == "double" else F.col(c) for c, ty in rows.dtypes]
    )


@query(
    "exposure_marginal",
    _exposure_sql(
        """, w AS (SELECT lag(arm) OVER (ORDER BY dose, arm) AS from_arm, arm AS to_arm,
          gained - lag(gained) OVER (ORDER BY dose, arm) AS eg,
          lost - lag(lost) OVER (ORDER BY dose, arm) AS el FROM es)
        SELECT from_arm, to_arm, round(eg, 6) AS extra_gained, round(el, 6) AS extra_lost,
          round(CASE WHEN eg > 0 THEN -el / eg END, 6) AS given_up_per_gain
        FROM w WHERE from_arm IS NOT NULL"""
    ),
)
def exposure_marginal(spark, path):
    rows = arms.exposure_marginal(arms.exposure_summary(_exposure(spark, path)))
    return rows.select(
        *[F.round(c, 6).alias(c) if ty == "double" else F.col(c) for c, ty in rows.dtypes]
    )


# ----------------------------------------------------------------- ensembles


def _rank_wide(runs, rank="rank_gen_fp") -> str:
    cols = ", ".join(f"max({rank}) FILTER (run = '{r}') AS k_{r}" for r in runs)
    return f"rw AS (SELECT query_id, max(size) AS size, {cols} FROM summary WHERE fp_unseen GROUP BY query_id)"


def _h(r: str, k: int) -> str:
    return f"coalesce(k_{r} < {k}, false)"


@query(
    "seed_union",
    _sql(
        f", {_rank_wide(R3)}, {v.bands(BANDS)}, g AS (SELECT band, count(*) AS n, "
        + ", ".join(f"avg({_h(r, 20)}::INT) AS p_{r}, avg({_h(r, 10)}::INT) AS q_{r}" for r in R3)
        + f", avg(({' OR '.join(_h(r, 20) for r in R3)})::INT) AS u "
        "FROM rw JOIN bands ON size BETWEEN lo AND hi GROUP BY band), "
        "o AS (SELECT *, (p_s1 + p_s2 + p_s3) / 3 AS one, "
        "(p_s1 / q_s1 + p_s2 / q_s2 + p_s3 / q_s3) / 3 AS df FROM g) "
        """SELECT band, n AS n_queries, round(u, 8) AS "union", round(one, 8) AS one_run,
        round(1 - (1 - p_s1) * (1 - p_s2) * (1 - p_s3), 8) AS union_if_independent,
        round(1 - u, 8) AS all_miss, round((u - one) / (1 - one), 8) AS luck_share,
        round(df, 8) AS doubling_factor,
        round(least(one * pow(df, log2(3)), 1.0), 8) AS projected_same_spend FROM o"""
    ),
)
def seed_union(spark, path):
    return ensembles.seed_union(ensembles.rank_matrix(_summary(spark, path), R3), 3, 20, BANDS)


_SPEND = {
    1: "(" + " + ".join(f"avg({_h(r, 20)}::INT)" for r in R3) + ") / 3",
    2: f"(avg(({_h('s1', 10)} OR {_h('s2', 10)})::INT) + avg(({_h('s2', 10)} OR {_h('s3', 10)})::INT)) / 2",
    3: f"avg(({' OR '.join(_h(r, 6) for r in R3)})::INT)",
}


@query(
    "equal_spend",
    _sql(
        f", {_rank_wide(R3)}, {v.bands(BANDS)} "
        + _union(
            [
                f"SELECT band, count(*) AS n_queries, {j} AS n_runs, {20 // j} AS k_each, "
                f"round({e}, 8) AS recovery FROM rw JOIN bands ON size BETWEEN lo AND hi GROUP BY band"
                for j, e in _SPEND.items()
            ]
        )
    ),
)
def equal_spend(spark, path):
    return ensembles.equal_spend(ensembles.rank_matrix(_summary(spark, path), R3), 3, 20, BANDS)


_RR = """, rrc AS (SELECT query_id, canonical,
     min(con * 3 + CASE run WHEN 's1' THEN 0 WHEN 's2' THEN 1 ELSE 2 END) AS turn,
     arg_min(fp_match, con * 3 + CASE run WHEN 's1' THEN 0 WHEN 's2' THEN 1 ELSE 2 END) AS fp_match
   FROM ranked WHERE con < 10 GROUP BY query_id, canonical),
  rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn) AS rank FROM rrc),
  pvc AS (SELECT query_id, canonical, sum(votes)::BIGINT AS votes,
     min(CASE run WHEN 's1' THEN 0 WHEN 's2' THEN 1 ELSE 2 END * 1000000 + first_pos) AS app,
     arg_min(fp_match, CASE run WHEN 's1' THEN 0 WHEN 's2' THEN 1 ELSE 2 END * 1000000 + first_pos)
       AS fp_match
   FROM props GROUP BY query_id, canonical),
  pv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, app) AS rank
   FROM pvc)"""


@query(
    "round_robin",
    _sql(_RR + " SELECT query_id, canonical, fp_match, rank FROM rr WHERE rank <= 10"),
)
def round_robin(spark, path):
    rows = ensembles.round_robin(t.judged(spark, path), R3, 10)
    return rows.select("query_id", "canonical", (F.col("fp_match") == 1).alias("fp_match"), "rank")


@query(
    "pooled_votes",
    _sql(_RR + " SELECT query_id, canonical, votes, fp_match, rank FROM pv WHERE rank <= 10"),
)
def pooled_votes(spark, path):
    rows = ensembles.pooled_votes(t.judged(spark, path), R3, 10)
    return rows.select(
        "query_id", "canonical", "votes", (F.col("fp_match") == 1).alias("fp_match"), "rank"
    )


@query(
    "ensemble_report",
    _sql(
        _RR
        + f", {_rank_wide(R3, 'rank_con_fp')}, "
        "rh AS (SELECT DISTINCT query_id FROM rr WHERE rank <= 10 AND fp_match), "
        "ph AS (SELECT DISTINCT query_id FROM pv WHERE rank <= 10 AND fp_match), "
        "e AS (SELECT rw.*, rh.query_id IS NOT NULL AS r, ph.query_id IS NOT NULL AS p FROM rw "
        "LEFT JOIN rh USING (query_id) LEFT JOIN ph USING (query_id)), "
        "g AS (SELECT count(*) AS n, "
        + ", ".join(f"avg({_h(r, 10)}::INT) AS m{i}" for i, r in enumerate(R3))
        + ", avg(r::INT) AS rr, avg(p::INT) AS pv, "
        + f"avg(({' OR '.join(_h(r, 10) for r in R3)})::INT) AS u, "
        + ", ".join(
            f"count(*) FILTER (p AND NOT {_h(r, 10)}) AS b{i}, "
            f"count(*) FILTER (NOT p AND {_h(r, 10)}) AS a{i}"
            for i, r in enumerate(R3)
        )
        + " FROM e), x AS (SELECT *, (m0 + m1 + m2) / 3 AS mean, greatest(m0, m1, m2) AS best, "
        "CASE WHEN m0 >= m1 AND m0 >= m2 THEN b0 WHEN m1 >= m2 THEN b1 ELSE b2 END AS bo, "
        "CASE WHEN m0 >= m1 AND m0 >= m2 THEN a0 WHEN m1 >= m2 THEN a1 ELSE a2 END AS ao FROM g) "
        "SELECT 10 AS k, n AS n_queries, round(mean, 8) AS single_mean, round(best, 8) AS best_single, "
        "round(rr, 8) AS round_robin, round(pv, 8) AS pooled_votes, round(u, 8) AS union_ceiling, "
        "30 AS union_calls, round(100 * (rr - mean), 8) AS round_robin_gain_points, "
        "round(100 * (pv - mean), 8) AS pooled_gain_points, "
        "round(100 * (u - mean), 8) AS union_gain_points, "
        "round(100 * (pv - best), 8) AS pooled_vs_best_points, bo AS pooled_only, ao AS best_only, "
        "round(100 * sqrt(bo + ao) / n, 8) AS paired_se_points, "
        f"round({v.mcnemar('bo', 'ao')}, 8) AS mcnemar_p FROM x"
    ),
)
def ensemble_report(spark, path):
    return ensembles.ensemble_report(_summary(spark, path), t.judged(spark, path), R3, 10)


# ------------------------------------------------------------------ policies

_BITS = v.hb("'b:' || query_id", 60)
_POLICY = (
    f", {v.wide_hits(('s1', 's2'), 20, 'rank_con_fp')}, pw AS (SELECT *, size + {_BITS} AS bits, "
    f"CASE WHEN size + {_BITS} >= 62 THEN h_s1 ELSE h_s2 END AS ch FROM wide)"
)


def _policy_matrix(spark, path):
    matrix = paired.hit_matrix(
        _summary(spark, path, ("s1", "s2")), ("s1", "s2"), 20, "consensus"
    )
    return matrix.withColumn("bits", F.col("size") + hash_bucket(60, "b", F.col("query_id")))


@query(
    "policy_routing",
    _sql(
        _POLICY
        + """, a AS (SELECT count(*) AS n_queries, avg(h_s1::INT) AS cold, avg(h_s2::INT) AS hot,
        avg(ch::INT) AS policy, avg((h_s1 OR h_s2)::INT) AS per_query_bound,
        count(*) FILTER (bits >= 62) AS n_routed_cold,
        count(*) FILTER (bits >= 62 AND size >= 35) / greatest(count(*) FILTER (bits >= 62), 1)
          AS routing_precision,
        count(*) FILTER (bits >= 62 AND size >= 35) / greatest(count(*) FILTER (size >= 35), 1)
          AS routing_recall,
        count(*) FILTER (ch AND NOT h_s1) AS over_cold, count(*) FILTER (NOT ch AND h_s1) AS under_cold,
        count(*) FILTER (ch AND NOT h_s2) AS over_hot, count(*) FILTER (NOT ch AND h_s2) AS under_hot
        FROM pw)
      SELECT n_queries, round(cold, 8) AS cold, round(hot, 8) AS hot, round(policy, 8) AS policy,
        round(per_query_bound, 8) AS per_query_bound, n_routed_cold,
        round(routing_precision, 8) AS routing_precision, round(routing_recall, 8) AS routing_recall,
        over_cold, under_cold, over_hot, under_hot, """
        + ", ".join(
            f"round(100 * (policy - {a}), 8) AS gap_{a}_points, "
            f"round(100 * sqrt(over_{a} + under_{a}) / n_queries, 8) AS se_{a}_points, "
            f"round({v.mcnemar(f'over_{a}', f'under_{a}')}, 8) AS p_{a}"
            for a in ("cold", "hot")
        )
        + " FROM a",
        ("s1", "s2"),
    ),
)
def policy_routing(spark, path):
    return policy.routed_policy(_policy_matrix(spark, path))


@query(
    "policy_curve",
    _sql(
        _POLICY
        + """ SELECT th::INT AS threshold, count(*) FILTER (bits >= th) AS routed_cold,
        round(avg((CASE WHEN bits >= th THEN h_s1 ELSE h_s2 END)::INT), 8) AS recovery
        FROM pw, range(30, 101, 2) r(th) GROUP BY th""",
        ("s1", "s2"),
    ),
)
def policy_curve(spark, path):
    return policy.policy_curve(_policy_matrix(spark, path))


_CAPS = (5, 10, 20, None)
_COST = _union(
    [
        f"""SELECT {-1 if c is None else c} AS cap, run, query_id, bool_or(fp_match) AS hit FROM (
      SELECT run, query_id, canonical, bool_or(fp_match) AS fp_match,
        row_number() OVER (PARTITION BY run, query_id ORDER BY count(*) DESC, min(pos)) AS rn
      FROM judged WHERE valid {'' if c is None else f'AND pos < {c}'}
      GROUP BY run, query_id, canonical) WHERE rn <= 5 GROUP BY run, query_id"""
        for c in _CAPS
    ]
)


@query(
    "matched_cost",
    _sql(
        f""", ch AS ({_COST}), caps(cap) AS (VALUES (5), (10), (20), (-1)),
      w AS (SELECT caps.cap, q.query_id,
        bool_or(coalesce(ch.hit, false)) FILTER (q.run = 's1') AS c,
        bool_or(coalesce(ch.hit, false)) FILTER (q.run = 's2') AS w
        FROM queries q CROSS JOIN caps
        LEFT JOIN ch ON ch.cap = caps.cap AND ch.run = q.run AND ch.query_id = q.query_id
        WHERE q.fp_unseen GROUP BY caps.cap, q.query_id),
      a AS (SELECT cap, count(*) AS n_queries, avg(w::INT) AS warm, avg(c::INT) AS cold,
        count(*) FILTER (c AND NOT w) AS cold_only, count(*) FILTER (w AND NOT c) AS warm_only
        FROM w GROUP BY cap)
      SELECT cap, n_queries, round(warm, 8) AS warm, round(cold, 8) AS cold, cold_only, warm_only,
        round(100 * (cold - warm), 8) AS gap_points,
        round(100 * sqrt(cold_only + warm_only) / n_queries, 8) AS paired_se_points,
        round({v.mcnemar('cold_only', 'warm_only')}, 8) AS mcnemar_p FROM a""",
        ("s1", "s2"),
    ),
)
def matched_cost(spark, path):
    runs = ("s1", "s2")
    cost = policy.hits_at_cost(
        t.queries(spark, path, runs), t.judged(spark, path, runs), 5, _CAPS
    )
    return policy.matched_cost(cost, cold="s1", warm="s2")


@query(
    "mean_samples",
    _sql(" SELECT run, round(avg(n_samples), 8) AS samples_per_query FROM queries GROUP BY run"),
)
def mean_samples(spark, path):
    return policy.mean_samples(t.queries(spark, path))


@query(
    "grid_best",
    _sql(
        """, g AS (SELECT run, avg(coalesce(rank_con_fp < 20, false)::INT) AS s FROM summary
        WHERE fp_unseen GROUP BY run)
      SELECT run, round(s, 8) AS score,
        round(100 * (s - (SELECT s FROM g WHERE run = 's1')), 8) AS best_vs_default_points
      FROM g ORDER BY s DESC, run LIMIT 1""",
        R5,
    ),
)
def grid_best(spark, path):
    """Runs stand for grid cells; the best by consensus recovery."""
    wide = metrics.slice_metrics(_summary(spark, path, R5), KS).filter(
        F.col("slice") == "fp_unseen"
    )
    return policy.grid_best(wide, R5, "recovery_at_20_consensus", "s1")


_GRID = (
    "recovery_at_1 recovery_at_20 recovery_at_1_consensus recovery_at_20_consensus validity "
    "unique_valid_per_query budget_filled_rate mean_samples_per_query duplicate_rate"
).split()


@query(
    "grid_summary",
    _sql(
        """ SELECT run, round(avg(coalesce(rank_gen_fp < 1, false)::INT), 8) AS recovery_at_1,
      round(avg(coalesce(rank_gen_fp < 20, false)::INT), 8) AS recovery_at_20,
      round(avg(coalesce(rank_con_fp < 1, false)::INT), 8) AS recovery_at_1_consensus,
      round(avg(coalesce(rank_con_fp < 20, false)::INT), 8) AS recovery_at_20_consensus,
      round(sum(n_valid) / sum(n_candidates), 8) AS validity,
      round(avg(n_scored), 8) AS unique_valid_per_query,
      round(avg((n_scored >= 20)::INT), 8) AS budget_filled_rate,
      round(avg(n_samples), 8) AS mean_samples_per_query,
      round(sum(n_duplicate) / sum(n_candidates), 8) AS duplicate_rate
      FROM summary WHERE fp_unseen GROUP BY run""",
        R5,
    ),
)
def grid_summary(spark, path):
    wide = metrics.slice_metrics(_summary(spark, path, R5), KS)
    return wide.filter(F.col("slice") == "fp_unseen").select("run", *_GRID)


@query(
    "group_novelty_penalty",
    _sql(
        """, cs AS (SELECT c_custkey AS query_id, c_mktsegment AS g, c_nationkey < 13 AS train
        FROM customer),
      known AS (SELECT DISTINCT g || ':' || (query_id % 397) AS gk FROM cs WHERE train),
      p AS (SELECT query_id, (g || ':' || (query_id % 397)) IN (SELECT gk FROM known) AS seen
        FROM cs WHERE NOT train),
      s AS (SELECT run, seen, avg(coalesce(rank_gen_fp < 20, false)::INT) AS r, count(*) AS n
        FROM summary JOIN p USING (query_id) WHERE fp_unseen GROUP BY run, seen)
      SELECT run, coalesce(max(n) FILTER (seen), 0) AS n_seen, coalesce(max(n) FILTER (NOT seen), 0) AS n_novel,
        round(max(r) FILTER (seen), 8) AS recovery_seen,
        round(max(r) FILTER (NOT seen), 8) AS recovery_novel,
        round(max(r) FILTER (seen) - max(r) FILTER (NOT seen), 8) AS novelty_penalty
      FROM s GROUP BY run"""
    ),
)
def group_novelty_penalty(spark, path):
    """Recovery of queries whose group training knows, against the others."""
    from ..operators.retrieve import group_novelty

    people = t.table(spark, path, "customer").select(
        F.col("c_custkey").alias("query_id"),
        F.concat_ws(":", F.col("c_mktsegment"), (F.col("c_custkey") % 397).cast("string")).alias("g"),
        (F.col("c_nationkey") < 13).alias("train"),
    )
    flagged = group_novelty(
        people.filter(~F.col("train")), people.filter("train"), "g"
    )
    return protocols.novelty_penalty(
        _summary(spark, path).join(flagged.select("query_id", "group_seen"), "query_id"), 20
    )


@query(
    "evaluate_run",
    _sql(
        """, m AS (SELECT run, coalesce(avg(coalesce(rank_gen_fp < 20, false)::INT) FILTER (fp_unseen), 0) AS primary_metric,
        count(*) AS n_queries, sum(n_candidates)::BIGINT AS n_candidates FROM summary GROUP BY run)
      SELECT run, round(primary_metric, 8) AS primary_metric, round(primary_metric, 8) AS recorded_metric,
        round(CASE WHEN run <> 's1' THEN primary_metric - (SELECT primary_metric FROM m WHERE run = 's1') END, 8) AS delta,
        n_queries, n_candidates, (SELECT count(*) FROM judged) AS observed_candidates,
        (SELECT count(*) FILTER (valid) FROM judged) AS observed_valid, true AS timed FROM m"""
    ),
)
def evaluate_run(spark, path):
    """Dumps, report, deltas and ledger of every run; throughput is measured but not compared."""
    queries = t.queries(spark, path).withColumn("ref_canonical", F.concat(F.lit("query "), F.col("query_id").cast("string")))
    folder = f"{shared_dir(spark)}/shortlist-evaluated-{uuid.uuid4().hex}"
    out = protocols.evaluate_chain(queries, t.judged(spark, path), folder, baseline="s1", ks=KS)
    timed = (F.col("elapsed_seconds") > 0) & (F.col("queries_per_second") > 0) & (F.col("candidates_per_second") > 0)
    return out.select(
        "run", "primary_metric", "recorded_metric", "delta", "n_queries", "n_candidates", "observed_candidates",
        "observed_valid", timed.alias("timed"),
    )
