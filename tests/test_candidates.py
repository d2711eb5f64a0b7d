"""Planted candidate lists: slots, budgets, orders, denominators."""

from __future__ import annotations

import pytest

from shortlist.operators import ensembles, judge, metrics, paired

HIT, MISS = True, False


def report(make, table, ks=(1, 2, 3, 20), budget="molecules"):
    q, j = make(table)
    s = metrics.query_summary(q, j, budget)
    return {
        (r["run"], r["slice"], r["metric"], r["k"]): r["value"]
        for r in metrics.recovery_report(s, ks).collect()
    }


def test_recovery_by_slot(make):
    r = report(make, {("a", 1): dict(cands=[("x", "x"), ("y", "y"), ("z", "z", HIT)])})
    assert [r["a", "all", "recovery_at_k", k] for k in (1, 2, 3, 20)] == [0, 0, 1, 1]


def test_empty_query_stays_in_denominator(make):
    r = report(make, {("a", 1): dict(cands=[("x", "x", HIT)]), ("a", 2): dict(cands=[])})
    assert r["a", "all", "recovery_at_k", 20] == 0.5
    assert r["a", "all", "mean_best_tanimoto", None] == 0.5


def test_slices_and_empty_slice(make):
    r = report(
        make,
        {
            ("a", 1): dict(unseen=False, cands=[("x", "x", HIT)]),
            ("a", 2): dict(unseen=False, cands=[("x", "x", HIT)]),
            ("a", 3): dict(cands=[("x", "x")]),
            ("b", 1): dict(unseen=False, cands=[("x", "x", HIT)]),
        },
    )
    assert r["a", "all", "recovery_at_k", 1] == pytest.approx(2 / 3)
    assert r["a", "fp_unseen", "recovery_at_k", 1] == 0
    assert r["b", "fp_unseen", "n_queries", None] == 0
    assert ("b", "fp_unseen", "recovery_at_k", 1) not in r


def test_two_budgets(make):
    table = {("a", 1): dict(cands=[("p", None), ("q", None), ("x", "x", HIT)])}
    assert report(make, table)["a", "all", "recovery_at_k", 1] == 1
    strings = report(make, table, budget="strings")
    assert strings["a", "all", "recovery_at_k", 1] == 0
    assert strings["a", "all", "recovery_at_k", 3] == 1
    assert strings["a", "all", "unique_valid_per_query", None] == 1


def test_validity_and_hit_rank(make):
    table = {("a", 1): dict(cands=[("p", None), ("m", "m"), ("x", "x", HIT)])}
    r = report(make, table)
    assert r["a", "all", "validity", None] == pytest.approx(2 / 3)
    assert r["a", "all", "mean_candidates_per_query", None] == 3
    assert r["a", "all", "mean_scored_per_query", None] == 2
    assert r["a", "all", "mean_hit_rank", None] == 1


def test_consensus_order_and_ties(make):
    spelled = [("a", "A"), ("b1", "B", HIT), ("b2", "B", HIT), ("b3", "B", HIT)]
    r = report(make, {("a", 1): dict(cands=spelled)})
    assert r["a", "all", "recovery_at_k", 1] == 0
    assert r["a", "all", "recovery_at_k_consensus", 1] == 1
    tie = report(make, {("a", 1): dict(cands=[("a", "A"), ("b", "B"), ("c", "C", HIT)])})
    assert tie["a", "all", "recovery_at_k_consensus", 2] == 0
    assert tie["a", "all", "recovery_at_k_consensus", 3] == 1


def test_orders_agree_at_full_budget_and_structure_is_lower(make):
    cands = [("a", "A"), ("b", "B", HIT), ("c", "C", HIT, HIT), ("c2", "C", HIT, HIT)]
    r = report(make, {("a", 1): dict(cands=cands)})
    assert r["a", "all", "recovery_at_k", 20] == r["a", "all", "recovery_at_k_consensus", 20]
    for k in (1, 2, 3):
        assert r["a", "all", "structure_accuracy_at_k", k] <= r["a", "all", "recovery_at_k", k]


def test_raw_repeats_drop_and_spellings_are_marked(make):
    cands = [("x", "X"), ("x", "X"), ("x2", "X"), ("y", "Y"), ("p", None), ("p", None), ("q", None)]
    _, j = make({("a", 1): dict(cands=cands)})
    got = [(r["pos"], r["raw"], r["duplicate"]) for r in j.orderBy("pos").collect()]
    assert got == [
        (0, "x", False), (1, "x2", True), (2, "y", False), (3, "p", False), (4, "q", False)
    ]


@pytest.mark.parametrize("mode", ["raw", "none"])
def test_other_dedupe_modes_mark_nothing(make, mode):
    _, j = make({("a", 1): dict(cands=[("x", "X"), ("x2", "X")])})
    assert not judge.mark_duplicates(j.drop("duplicate"), mode=mode).filter("duplicate").count()


def test_unknown_names_are_errors(make):
    q, j = make({("a", 1): dict(cands=[("x", "X")])})
    with pytest.raises(ValueError):
        judge.mark_duplicates(j, mode="fuzzy")
    with pytest.raises(ValueError):
        metrics.query_summary(q, j, "atoms")
    with pytest.raises(ValueError):
        metrics.hit_at(1, order="best")
    with pytest.raises(ValueError):
        metrics.explode_slices(q, ["seen"])


def test_best_result_first_wins_and_empty_is_null(make):
    q, j = make(
        {
            ("a", 1): dict(cands=[("x", "X", MISS, MISS, 0.9), ("y", "Y", MISS, MISS, 0.9)]),
            ("a", 2): dict(cands=[]),
        }
    )
    got = {r["query_id"]: r["pos"] for r in judge.best_result(q, j).collect()}
    assert got == {1: 0, 2: None}


def test_pool_arms_counts_votes_over_the_union(make):
    _, j = make(
        {
            ("a", 1): dict(cands=[("x", "X"), ("y", "Y")]),
            ("b", 1): dict(cands=[("y2", "Y"), ("x", "X")]),
        }
    )
    pooled = judge.pool_arms(j, ["a", "b"]).orderBy("pos").collect()
    assert [(r["raw"], r["duplicate"]) for r in pooled] == [
        ("x", False), ("y", False), ("y2", True)
    ]


def test_one_query_with_most_rows(make):
    """A query far larger than the renumbering span keeps exact positions."""
    cands = [(f"r{i}", f"c{i % 4999}", i == 4990) for i in range(9000)]
    q, j = make({("a", 1): dict(cands=cands), ("a", 2): dict(cands=[("x", "X", HIT)])})
    s = metrics.query_summary(q, j)
    got = {r["query_id"]: (r["n_scored"], r["rank_gen_fp"]) for r in s.collect()}
    assert got == {1: (4999, 4990), 2: (1, 0)}
    assert j.filter("query_id = 1").selectExpr("max(pos)").first()[0] == 8999


def test_paired_runs_must_cover_the_same_queries(make):
    q, j = make(
        {("a", 1): dict(cands=[("x", "X")]), ("b", 1): dict(cands=[]), ("a", 2): dict(cands=[])}
    )
    matrix = paired.hit_matrix(metrics.query_summary(q, j), ["a", "b"], 1)
    with pytest.raises(Exception, match="different queries"):
        matrix.collect()


def test_union_of_disjoint_and_shared_hits(make):
    win, lose = [("x", "X", HIT)], [("x", "X")]
    q, j = make(
        {
            ("a", 1): dict(cands=win), ("a", 2): dict(cands=lose),
            ("b", 1): dict(cands=lose), ("b", 2): dict(cands=win),
        }
    )
    m = ensembles.rank_matrix(metrics.query_summary(q, j), ["a", "b"])
    r = ensembles.seed_union(m, 2, 20, "all").first()
    assert (r["one_run"], r["union"], r["luck_share"]) == (0.5, 1.0, 1.0)


def test_equal_spend(make):
    cands = [(f"r{i}", f"c{i}", i == 14) for i in range(20)]
    q, j = make({("a", 1): dict(cands=cands), ("b", 1): dict(cands=cands)})
    m = ensembles.rank_matrix(metrics.query_summary(q, j), ["a", "b"])
    got = {r["n_runs"]: r["recovery"] for r in ensembles.equal_spend(m, 2, 20, "all").collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_invalid_row_and_item_named_like_it_are_two_slots(make):
    from shortlist.operators.judge import proposals
    from shortlist.operators.metrics import query_summary

    queries, judged = make({("a", 1): dict(cands=[("x", "#1", False, False), ("bad", None, False, False)])})
    assert proposals(judged, "strings").count() == 2
    assert query_summary(queries, judged, "strings").first().n_scored == 2
