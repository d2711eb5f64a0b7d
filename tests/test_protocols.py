"""The evaluation chain against its parts, the novelty probe and the exchange score by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shortlist.operators import metrics, registration
from shortlist.plans import protocols
from shortlist.sources import dumps


def runs(make):
    table = {}
    for run, hits in (("a", {1: 0, 2: 3}), ("b", {1: 1, 2: None, 3: 0})):
        for q in range(1, 6):
            at = hits.get(q)
            cands = [(f"r{q}{i}", f"c{q}{i}" if i % 4 else None, at == i and i % 4, False) for i in range(1, 7)]
            if at == 0:
                cands = [("hit", "hit", True, True)] + cands
            table[run, q] = dict(size=10 * q, unseen=q != 5, cands=cands if q != 4 else [])
    return make(table)


@pytest.mark.parametrize("again", [1, 2])
def test_chain_records_what_it_stored(spark, make, tmp_path, again):
    queries, judged = runs(make)
    queries = queries.withColumn("ref_canonical", F.concat(F.lit("q"), "query_id"))
    folder = str(tmp_path / f"out{again}")
    got = {r.run: r for r in protocols.evaluate_chain(queries, judged, folder, baseline="a", ks=(1, 5)).collect()}
    summary = metrics.query_summary(queries, judged)
    want = {r.run: r for r in metrics.run_headline(summary, (1, 5)).collect()}
    for run, r in got.items():
        assert (r.primary_metric, r.n_queries, r.n_candidates) == (want[run].primary_metric, 5, want[run].n_candidates)
        assert r.recorded_metric == r.primary_metric and r.elapsed_seconds > 0
        assert r.queries_per_second == pytest.approx(5 / r.elapsed_seconds)
        assert (r.observed_candidates, r.observed_valid) == (judged.count(), judged.filter("valid").count())
    assert got["a"].delta is None and got["b"].delta == pytest.approx(want["b"].primary_metric - want["a"].primary_metric)
    assert dumps.read_ledger(spark, f"{folder}/ledger").count() == 2
    stored = spark.read.json(f"{folder}/report")
    report = metrics.recovery_report(summary, (1, 5))
    assert stored.count() == report.count()


def test_novelty_probe_draws_equal_shares(spark, make):
    queries, judged = runs(make)
    summary = metrics.query_summary(queries, judged)
    flags = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True), (5, False)], "query_id long, group_seen boolean")
    rows = {(r.run, r.group_seen): r for r in protocols.group_novelty_probe(summary, flags, 2, "s", (1, 5)).collect()}
    assert {(k, r.n_sampled) for k, r in rows.items()} == {((run, g), 2) for run in "ab" for g in (True, False)}
    assert rows["b", False].n_fp_unseen == 1 and rows["b", False].recovery_at_1 == 1.0 == rows["b", False].structure_accuracy
    assert rows["a", False].recovery_at_5 == 0.0


def test_exchange_verdicts(spark):
    rates = spark.createDataFrame(
        [("x", 2.0, 0.02), ("y", 3.0, 0.05), ("z", 9.0, 0.5)], "band string, points_per_pass_doubling double, passes_over_corpus double"
    )
    got = {r.band: r for r in registration.score_exchange(rates, registered_gain=3.0, ratio_range=(0.03, 0.06)).collect()}
    assert [got[b].exchange_verdict for b in "xyz"] == ["below by 0.010", "inside", "above by 0.440"]
    assert (got["x"].gain_minus_registered, got["z"].gain_over_registered) == (-1.0, 3.0)
