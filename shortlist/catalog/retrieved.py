"""Queries over real candidate runs: retrieved lists, judged, sliced, and their failures explained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anatomy, metrics, paired, policy
from ..operators.retrieve import group_novelty
from ..plans import protocols
from ..sources import retrieved as r
from . import sqlviews as v
from .registry import query

TOO_LONG = 400
LARGE = 200
ROUTED = 80
CURVE = tuple(range(20, 121, 10))
FLAGS = {"with_twin": "twins > 0", "large": f"size >= {LARGE}"}
ATTRIBUTES = ("size", "n_features", "n_valid")


def _grams(ngram: int) -> str:
    if ngram == 1:
        return "tokens"
    return "list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))"


def _run(name, cfg) -> str:
    return f"""b_{name} AS (SELECT item_id, held, {v.feature_bits(_grams(cfg.ngram), cfg.n_bits)} AS bits FROM pool),
e_{name} AS (SELECT item_id, held, unnest(bits) AS bit FROM b_{name}),
o_{name} AS (SELECT q.item_id AS query_id, i.item_id, count(*) AS o
  FROM e_{name} q JOIN e_{name} i USING (bit) WHERE q.held AND NOT i.held GROUP BY ALL),
l_{name} AS (
  SELECT '{name}' AS run, q.item_id AS query_id, i.item_id,
    row_number() OVER (PARTITION BY q.item_id ORDER BY CASE WHEN len(q.bits) + len(i.bits) = 0 THEN 1.0
      ELSE coalesce(o, 0) / (len(q.bits) + len(i.bits) - coalesce(o, 0)) END DESC, i.item_id) - 1 AS pos
  FROM b_{name} q JOIN b_{name} i ON q.held AND NOT i.held
  LEFT JOIN o_{name} x ON x.query_id = q.item_id AND x.item_id = i.item_id
  QUALIFY pos < {r.K})"""


_VIEWS = f"""
texts AS (
  SELECT doc_id AS item_id, md5(coalesce(text, '')) AS raw,
    trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS folded FROM documents),
pool AS (
  SELECT item_id, raw, md5(folded) AS digest, tokens, len(tokens) AS size,
    CASE WHEN len(tokens) >= {r.LEAST_WORDS} THEN md5(folded) END AS canonical,
    len(tokens) >= {r.LEAST_WORDS} AND {v.hb("'held:' || item_id", r.PARTS)} = 0
      AND item_id = min(item_id) OVER (PARTITION BY folded) AS held
  FROM (SELECT *, regexp_extract_all(folded, '[\\pL\\pN]+') AS tokens FROM texts)),
{", ".join(_run(n, c) for n, c in r.RUNS.items())},
lists AS ({" UNION ALL ".join(f"SELECT * FROM l_{n}" for n in r.RUNS)}),
bc AS (
  SELECT item_id, {v.hb("t", 128)} AS bit, count(*) AS cnt
  FROM (SELECT item_id, unnest(tokens) AS t FROM pool WHERE canonical IS NOT NULL) GROUP BY ALL),
fm AS (
  SELECT item_id, md5(string_agg(bit || ':' || cnt, ',' ORDER BY bit)) AS key, sum(cnt) AS mass,
    count(*) AS n_features
  FROM bc GROUP BY item_id),
met AS (SELECT DISTINCT query_id, item_id FROM lists),
mo AS (
  SELECT m.query_id, m.item_id, sum(least(a.cnt, b.cnt)) AS o
  FROM met m JOIN bc a ON a.item_id = m.query_id JOIN bc b ON b.item_id = m.item_id AND b.bit = a.bit GROUP BY ALL),
kept AS (
  SELECT l.*, p.raw, p.canonical, p.size AS cand_size FROM lists l JOIN pool p USING (item_id)
  QUALIFY row_number() OVER (PARTITION BY run, query_id, raw ORDER BY pos) = 1),
placed AS (SELECT * REPLACE (row_number() OVER (PARTITION BY run, query_id ORDER BY pos) - 1 AS pos) FROM kept),
judged AS (
  SELECT run, c.query_id, pos, c.raw, c.canonical, cand_size, c.canonical IS NOT NULL AS valid,
    coalesce(cf.key = qf.key, false) AS fp_match, coalesce(c.canonical = qp.canonical, false) AS exact_structure,
    CASE WHEN c.canonical IS NULL THEN 0.0 ELSE coalesce(o, 0) / (cf.mass + qf.mass - coalesce(o, 0)) END AS tanimoto,
    c.canonical IS NOT NULL AND pos > min(pos) OVER (PARTITION BY run, c.query_id, c.canonical) AS duplicate
  FROM placed c JOIN pool qp ON qp.item_id = c.query_id JOIN fm qf ON qf.item_id = c.query_id
  LEFT JOIN fm cf ON cf.item_id = c.item_id LEFT JOIN mo ON mo.query_id = c.query_id AND mo.item_id = c.item_id),
keyed AS (SELECT *, count(*) OVER (PARTITION BY key) - 1 AS twins FROM pool JOIN fm USING (item_id)),
queries AS (
  SELECT u.run, item_id AS query_id, size, n_features, twins, {r.K} AS n_samples,
    key NOT IN (SELECT key FROM keyed WHERE NOT held) AS fp_unseen
  FROM keyed, (VALUES {", ".join(f"('{n}')" for n in r.RUNS)}) u(run) WHERE held)"""


def _sql(tail: str) -> str:
    return f"WITH {_VIEWS},{v.SUMMARY_VIEWS}, f AS (SELECT *, coalesce(rank_gen_fp < 10, false) AS hit FROM summary) {tail}"


def _summary(spark, path):
    return metrics.query_summary(r.queries(spark, path), r.judged(spark, path))


def _outcomes(spark, path):
    return _summary(spark, path).withColumn("hit", metrics.hit_at(10))


@query(
    "judge_candidates",
    f"""WITH {_VIEWS} SELECT run, query_id, pos, raw, canonical, valid, fp_match, exact_structure,
      round(tanimoto, 8) AS tanimoto, duplicate, cand_size FROM judged""",
)
def judge_candidates(spark, path):
    """Three retrieval runs judged under count features: byte copies dropped, repeats marked."""
    return r.judged(spark, path).select(
        "run", "query_id", "pos", "raw", "canonical", "valid", "fp_match", "exact_structure", "tanimoto",
        "duplicate", "cand_size",
    )


@query(
    "retrieved_slices",
    _sql(
        "SELECT run, slice, count(*) AS n_queries, "
        + ", ".join(f"round(avg(coalesce(rank_gen_fp < {k}, false)::INT), 8) AS recovery_at_{k}" for k in (1, 10, 20))
        + """, round(avg(coalesce(rank_gen_ex < 20, false)::INT), 8) AS structure_accuracy_at_20,
      round(avg(best_tanimoto), 8) AS mean_best_tanimoto
      FROM f, (VALUES ('all'), ('fp_unseen')) s(slice) WHERE slice = 'all' OR fp_unseen GROUP BY run, slice"""
    ),
)
def retrieved_slices(spark, path):
    wide = metrics.slice_metrics(_summary(spark, path), (1, 10, 20))
    return wide.filter(F.col("n_queries") > 0).select(
        "run", "slice", "n_queries", "recovery_at_1", "recovery_at_10", "recovery_at_20",
        "structure_accuracy_at_20", "mean_best_tanimoto",
    )


@query(
    "retrieved_failures",
    _sql(
        f"""SELECT run, bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY run), 8) AS share
      FROM (SELECT run, CASE WHEN size > {TOO_LONG} THEN 'too_long' WHEN rank_gen_fp IS NOT NULL THEN 'beyond_budget'
        WHEN twins > 0 THEN 'collision' WHEN best_tanimoto >= 0.9 THEN 'near' WHEN best_tanimoto >= 0.7 THEN 'analogue'
        ELSE 'far' END AS bucket FROM f WHERE NOT hit) GROUP BY run, bucket"""
    ),
)
def retrieved_failures(spark, path):
    """Why held-out documents are not found: length, budget, shared features, closeness."""
    bucket = anatomy.failure_bucket(
        F.col("size") > TOO_LONG, F.col("rank_gen_fp").isNotNull(), F.col("twins"), F.col("best_tanimoto")
    )
    return anatomy.failure_taxonomy(_outcomes(spark, path).filter(~F.col("hit")).withColumn("bucket", bucket))


@query(
    "retrieved_success_vs_failure",
    _sql(
        " UNION ALL ".join(
            f"SELECT run, '{a}' AS attribute, median({a}) FILTER (hit)::DOUBLE AS hit_median, "
            f"median({a}) FILTER (NOT hit)::DOUBLE AS fail_median FROM f GROUP BY run"
            for a in ATTRIBUTES
        )
    ),
)
def retrieved_success_vs_failure(spark, path):
    return anatomy.success_vs_failure(_outcomes(spark, path), ATTRIBUTES)


@query(
    "retrieved_by_flag",
    _sql(
        " UNION ALL ".join(
            f"SELECT run, '{n}' AS flag, count(*) FILTER ({c}) AS n_with, "
            f"round(avg(hit::INT) FILTER ({c}), 8) AS recovery_with, "
            f"round(avg(hit::INT) FILTER (NOT ({c})), 8) AS recovery_without FROM f GROUP BY run"
            for n, c in FLAGS.items()
        )
    ),
)
def retrieved_by_flag(spark, path):
    return anatomy.recovery_by_flag(_outcomes(spark, path), {n: F.expr(c) for n, c in FLAGS.items()})


_ARMS = ("bits2048", "bits128")
_WIDE = f"""SELECT query_id, any_value(size) AS size, any_value(n_features) AS bits,
  bool_or(rank_gen_ex IS NOT NULL AND rank_gen_ex < 1) FILTER (run = '{_ARMS[0]}') AS cold,
  bool_or(rank_gen_ex IS NOT NULL AND rank_gen_ex < 1) FILTER (run = '{_ARMS[1]}') AS hot
  FROM f WHERE run IN {_ARMS} GROUP BY query_id"""


def _arms(spark, path):
    """Exact finds at rank 1 of the two folds, with each query's own number of features."""
    matrix = paired.hit_matrix(_summary(spark, path), _ARMS, 1, metric="structure", unseen_only=False)
    bits = r.queries(spark, path).filter(F.col("run") == _ARMS[0]).select("query_id", F.col("n_features").alias("bits"))
    return matrix.join(bits, "query_id")


@query(
    "retrieved_policy",
    _sql(
        f""", w AS ({_WIDE}), p AS (SELECT *, CASE WHEN bits >= {ROUTED} THEN cold ELSE hot END AS ch FROM w)
      SELECT count(*) AS n_queries, round(avg(cold::INT), 8) AS cold, round(avg(hot::INT), 8) AS hot,
        round(avg(ch::INT), 8) AS policy, round(avg((cold OR hot)::INT), 8) AS per_query_bound,
        count(*) FILTER (bits >= {ROUTED}) AS n_routed_cold,
        round(count(*) FILTER (bits >= {ROUTED} AND size >= {LARGE}) / greatest(count(*) FILTER (bits >= {ROUTED}), 1), 8)
          AS routing_precision,
        round(count(*) FILTER (bits >= {ROUTED} AND size >= {LARGE}) / greatest(count(*) FILTER (size >= {LARGE}), 1), 8)
          AS routing_recall FROM p"""
    ),
)
def retrieved_policy(spark, path):
    """Feature-rich queries to the fine fold, the rest to the coarse one."""
    out = policy.routed_policy(_arms(spark, path), threshold=ROUTED, large=LARGE)
    return out.select(
        "n_queries", "cold", "hot", "policy", "per_query_bound", "n_routed_cold", "routing_precision", "routing_recall"
    )


@query(
    "retrieved_policy_curve",
    _sql(
        f""", w AS ({_WIDE}) SELECT th::INT AS threshold, count(*) FILTER (bits >= th) AS routed_cold,
      round(avg((CASE WHEN bits >= th THEN cold ELSE hot END)::INT), 8) AS recovery
      FROM w, (SELECT unnest({list(CURVE)}) AS th) GROUP BY th"""
    ),
)
def retrieved_policy_curve(spark, path):
    return policy.policy_curve(_arms(spark, path), thresholds=CURVE)


_PER_GROUP = 40
_OPENING = 2


@query(
    "group_novelty_probe",
    _sql(
        f""", og AS (SELECT item_id, held, array_to_string(tokens[1:{_OPENING}], ' ') AS g FROM pool),
      fl AS (SELECT item_id AS query_id, g IN (SELECT g FROM og WHERE NOT held) AS group_seen FROM og WHERE held),
      dr AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY group_seen
        ORDER BY {v.okey("'np:' || query_id")}, query_id) <= {_PER_GROUP})
      SELECT run, group_seen, count(*) AS n_sampled, count(*) FILTER (fp_unseen) AS n_fp_unseen,
        {", ".join(f"round(avg(coalesce(rank_gen_fp < {k}, false)::INT) FILTER (fp_unseen), 8) AS recovery_at_{k}" for k in (1, 5, 20))},
        round(avg(coalesce(rank_gen_ex < 20, false)::INT) FILTER (fp_unseen), 8) AS structure_accuracy,
        round(avg(best_tanimoto) FILTER (fp_unseen), 8) AS mean_best_tanimoto
      FROM summary JOIN dr USING (query_id) GROUP BY run, group_seen"""
    ),
)
def group_novelty_probe(spark, path):
    """Held-out documents whose opening words the rest has, against those with a new opening."""
    opening = F.array_join(F.slice("tokens", 1, _OPENING), " ")
    rows = r.items(spark, path).select(F.col("item_id").alias("query_id"), "held", opening.alias("opening"))
    flags = group_novelty(rows.filter("held"), rows.filter(~F.col("held")), "opening")
    return protocols.group_novelty_probe(_summary(spark, path), flags, _PER_GROUP, "np", (1, 5, 20))
