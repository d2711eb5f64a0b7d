"""Queries over ledgers and evaluation histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket
from ..operators import ledger
from ..operators.guards import protocol, same_protocol
from ..sources import tables as t
from . import sqlviews as v
from .curves import TRACE
from .registry import query

_LEDGER = """ledger AS (SELECT event_id AS row, user_id % 50 AS run,
  CASE WHEN user_id % 2 = 0 THEN 'valid' ELSE 'test' END AS split,
  CASE WHEN event_type <> 'error' THEN round(value / 1000, 6) END AS primary_metric,
  json_extract_string(props, '$.k')::BIGINT AS n_parameters, ts FROM events)"""


@query(
    "leaderboard",
    f"""WITH {_LEDGER} SELECT "row", run, split, primary_metric, n_parameters FROM ledger
    WHERE split = 'valid' ORDER BY CASE WHEN coalesce(primary_metric, 0) = 0 THEN -1
      ELSE primary_metric END DESC, "row" LIMIT 20""",
)
def leaderboard(spark, path):
    return ledger.leaderboard(t.ledger(spark, path), split="valid").select(
        "row", "run", "split", "primary_metric", "n_parameters"
    )


@query(
    "leaderboard_newest",
    f"""WITH {_LEDGER} SELECT "row", run, split, primary_metric FROM ledger ORDER BY "row" DESC LIMIT 20""",
)
def leaderboard_newest(spark, path):
    return ledger.leaderboard(t.ledger(spark, path), newest_first=True).select(
        "row", "run", "split", "primary_metric"
    )


@query(
    "ledger_best_last",
    f"""WITH {_LEDGER} SELECT run, count(*) AS n, max(primary_metric) AS best,
      max("row") AS last_row, arg_max(n_parameters, "row") AS last_parameters FROM ledger GROUP BY run""",
)
def ledger_best_last(spark, path):
    """Current best and last record per run, the state the live ledger keeps."""
    return (
        t.ledger(spark, path)
        .groupBy("run")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("primary_metric").alias("best"),
            F.max("row").alias("last_row"),
            F.max_by("n_parameters", "row").alias("last_parameters"),
        )
    )


@query("trace", f"WITH {TRACE} SELECT run, step, epoch, recovery, valid_loss FROM trace")
def trace(spark, path):
    return t.trace(spark, path).drop("protocol")


@query(
    "trace_last",
    f"""WITH {TRACE} SELECT run, max(step) AS last_step, arg_max(epoch, step) AS epoch,
    arg_max(recovery, step) AS recovery FROM trace GROUP BY run""",
)
def trace_last(spark, path):
    return ledger.last_records(ledger.require_steps(t.trace(spark, path)))


@query(
    "trace_best",
    f"""WITH {TRACE} SELECT run, step AS best_step, recovery AS best FROM trace
    QUALIFY row_number() OVER (PARTITION BY run ORDER BY recovery DESC, step) = 1""",
)
def trace_best(spark, path):
    return ledger.best_records(t.trace(spark, path))


@query(
    "checkpoint_rule",
    f"""WITH RECURSIVE {TRACE}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS e
      FROM trace),
    w AS (SELECT run, e, step, recovery AS bm, valid_loss AS bl, true AS improved, 0 AS since
        FROM n WHERE e = 1
      UNION ALL SELECT n.run, n.e, n.step,
        CASE WHEN n.recovery > w.bm OR (n.recovery = w.bm AND n.valid_loss < w.bl)
          THEN n.recovery ELSE w.bm END,
        CASE WHEN n.recovery > w.bm OR (n.recovery = w.bm AND n.valid_loss < w.bl)
          THEN n.valid_loss ELSE w.bl END,
        n.recovery > w.bm OR (n.recovery = w.bm AND n.valid_loss < w.bl),
        CASE WHEN n.recovery > w.bm OR (n.recovery = w.bm AND n.valid_loss < w.bl)
          THEN 0 ELSE w.since + 1 END
        FROM w JOIN n ON n.run = w.run AND n.e = w.e + 1),
    st AS (SELECT run, min(e) FILTER (since >= 5) AS stop FROM w GROUP BY run)
    SELECT w.run, step, improved, since AS since_improved, coalesce(e = stop, false) AS stopped
    FROM w JOIN st USING (run) WHERE stop IS NULL OR e <= stop""",
)
def checkpoint_rule(spark, path):
    """Which evaluations improve, and where a patience of five ends the run."""
    return ledger.checkpoint_rule(t.trace(spark, path), patience=5).select(
        "run", "step", "improved", F.col("since_improved").cast("int").alias("since_improved"),
        "stopped",
    )


_RUNS = ("click", "purchase", "view")


@query(
    "matched_steps",
    f"""WITH {TRACE} SELECT step, {', '.join(f"max(recovery) FILTER (run = '{r}') AS {r}" for r in _RUNS)}
    FROM trace WHERE run IN {_RUNS} GROUP BY step HAVING count(DISTINCT run) = 3""",
)
def matched_steps(spark, path):
    """Recovery side by side at the steps every run was evaluated at, one protocol only."""
    return ledger.matched_steps(same_protocol(t.trace(spark, path)), _RUNS)


def _records(spark, path):
    """Schedule settings per run, derived from the run's record count."""
    return (
        t.table(spark, path, "events")
        .groupBy(F.col("event_type").alias("run"))
        .agg(F.count(F.lit(1)).alias("n_train"))
        .withColumn("batch_size", F.lit(32))
        .withColumn("epochs", 2 + hash_bucket(3, "ep", F.col("run")))
        .withColumn("max_steps", F.when(hash_bucket(2, "ms", F.col("run")) == 0, F.lit(200)))
    )


_HZ = f"""hz AS (SELECT event_type AS run, least((2 + {v.hb("'ep:' || event_type", 3)})
    * ceil(count(*) / 32)::BIGINT, CASE WHEN {v.hb("'ms:' || event_type", 2)} = 0 THEN 200 END) AS horizon
  FROM events GROUP BY event_type)"""


@query("schedule_horizons", f"WITH {_HZ} SELECT run, horizon FROM hz")
def schedule_horizons(spark, path):
    return ledger.horizons(_records(spark, path))


#: Schedules as recorded end apart; cut to so many steps they end together.
_CAP = 20
_GATES = f"""gates AS (SELECT 'as_recorded' AS schedule, count(DISTINCT horizon) <= 1 AS open FROM hz WHERE run IN {_RUNS}
  UNION ALL SELECT 'cut', count(DISTINCT least(horizon, {_CAP})) <= 1 FROM hz WHERE run IN {_RUNS})"""


@query(
    "matched_steps_gated",
    f"""WITH {TRACE}, {_HZ}, {_GATES}
    SELECT schedule, step, {', '.join(f"max(recovery) FILTER (run = '{r}') AS {r}" for r in _RUNS)}
    FROM trace, gates WHERE run IN {_RUNS} AND open
    GROUP BY schedule, step HAVING count(DISTINCT run) = 3""",
)
def matched_steps_gated(spark, path):
    """No rows when the schedules end at different steps; all of them once they end together."""
    recorded = ledger.horizons(_records(spark, path).filter(F.col("run").isin(*_RUNS)))
    cut = recorded.withColumn("horizon", F.least("horizon", F.lit(_CAP)))
    rows = [
        ledger.matched_steps(t.trace(spark, path), _RUNS, schedule).withColumn("schedule", F.lit(name))
        for name, schedule in (("as_recorded", recorded), ("cut", cut))
    ]
    return rows[0].unionByName(rows[1])


@query(
    "comparable_runs",
    f"""WITH {TRACE}, p AS (SELECT scope, run, CASE WHEN scope = 'mixed' AND run = 'error' THEN 'strings' ELSE 'molecules' END AS budget
      FROM trace, (VALUES ('same'), ('mixed')) s(scope) GROUP BY scope, run)
    SELECT scope, run, (SELECT count(DISTINCT budget) <= 1 FROM p o WHERE o.scope = p.scope) AS comparable FROM p""",
)
def comparable_runs(spark, path):
    """Under one protocol all runs compare; once one run counts slots differently, none do."""
    same = t.trace(spark, path)
    other = protocol(F.lit("strings"), F.array(F.lit(1), F.lit(5), F.lit(20)), F.lit(True))
    mixed = same.withColumn("protocol", F.when(F.col("run") == "error", other).otherwise(F.col("protocol")))
    rows = [
        ledger.comparable(rows).select(F.lit(scope).alias("scope"), "run", "comparable")
        for scope, rows in (("same", same), ("mixed", mixed))
    ]
    return rows[0].unionByName(rows[1])
