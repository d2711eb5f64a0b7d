"""Exact tests, fits, intervals, arms and band arithmetic on planted numbers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from shortlist.functions import stats
from shortlist.functions.bands import Band, parse_arm, parse_band
from shortlist.operators import anatomy, arms, curves, registration


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "b,c,p",
    [(0, 0, 1), (5, 5, 1), (5, 0, 2 * 2**-5), (0, 8, 2 * 2**-8), (5, 1, 14 / 64), (1, 5, 14 / 64)],
)
def test_mcnemar_small(spark, b, c, p):
    assert value(spark, stats.mcnemar_exact(F.lit(b), F.lit(c))) == pytest.approx(p, rel=1e-12)


def test_mcnemar_large_matches_exact_integers(spark):
    for b, c in ((155, 137), (4000, 3800), (60000, 59300)):
        n, lo = b + c, min(b, c)
        term = total = math.comb(n, lo) if n < 9000 else None
        if term is not None:
            total = sum(math.comb(n, i) for i in range(lo + 1))
            want = min(1.0, 2 * (total / 2**n if n < 1000 else float(total * 10**30 // 2**n) / 1e30))
        else:
            z = (n / 2 - lo - 0.5) / math.sqrt(n / 4)
            want = math.erfc(z / math.sqrt(2))
        got = value(spark, stats.mcnemar_exact(F.lit(b), F.lit(c)))
        assert got == pytest.approx(want, rel=1e-8 if n < 9000 else 1e-2)


def test_mcnemar_and_se_guards(spark):
    with pytest.raises(Exception, match="negative"):
        value(spark, stats.mcnemar_exact(F.lit(-1), F.lit(2)))
    with pytest.raises(Exception, match="positive"):
        value(spark, stats.paired_se(F.lit(1), F.lit(2), F.lit(0)))
    se = value(spark, 100 * stats.paired_se(F.lit(155), F.lit(137), F.lit(1956)))
    assert se == pytest.approx(0.8736, abs=1e-3)


def test_bands_and_arms():
    assert (parse_band("30-34").lo, parse_band("30-34").hi) == (30, 34)
    assert parse_band("35+") == Band("35+", 35) and parse_band("all") == Band("all")
    assert parse_arm("mix=a,b@rec.json") == parse_arm("mix=a,b@rec.json")
    assert parse_arm("mix=a,b@rec.json").record == "rec.json"
    with pytest.raises(ValueError):
        parse_band("big")
    with pytest.raises(ValueError):
        parse_arm("empty=")


def ladder(spark, rungs):
    return spark.createDataFrame(
        [("r", "all", 100, k, v) for k, v in rungs],
        "run string, band string, n_queries long, k int, recovery double",
    )


def test_power_law_is_recovered(spark):
    rungs = [(k, 1 - 0.8 * k**-0.3) for k in range(1, 61)]
    r = curves.budget_fit(ladder(spark, rungs), targets=(0.9,)).first()
    assert r["exponent"] == pytest.approx(0.3)
    assert r["correlation"] == pytest.approx(-1)
    assert r["error_points"] == pytest.approx(0, abs=1e-9)
    assert r["budget_for_0_9"] == pytest.approx((0.1 / 0.8) ** (-1 / 0.3))


def test_fit_guards(spark):
    assert curves.budget_fit(ladder(spark, [(5, 0.1), (10, 0.2)])).first()["exponent"] is None
    flat = [(k, 0.5) for k in (5, 10, 20, 40)]
    assert curves.budget_fit(ladder(spark, flat)).first()["exponent"] is None
    ceiling = [(5, 0.5), (10, 0.6), (20, 0.7), (40, 1.0)]
    assert curves.budget_fit(ladder(spark, ceiling)).first()["exponent"] is not None


def test_budget_inversion_edges(spark):
    assert value(spark, stats.budget_for(F.lit(0.1), F.lit(0.0), 0.9)) is None
    slow = value(spark, stats.budget_for(F.lit(-0.003), F.lit(-0.2), 0.99))
    assert math.isinf(slow)


def test_pair_exponent_and_break_even(spark):
    one = lambda *a: value(spark, stats.pair_exponent(*[F.lit(float(x)) for x in a]))
    assert one(1000, 0.2, 2000, 0.6) == pytest.approx(1.0)
    assert one(2000, 0.2, 1000, 0.6) is None
    assert one(1000, 0.0, 2000, 0.6) is None
    be = lambda f, b, c: value(
        spark, stats.break_even(F.lit(f), F.lit(b), F.lit(c), 1000, 10, 2.0, 0.5)
    )
    assert be(0.5, 0.5, 0.5) == pytest.approx(400)
    assert be(1.0, 0.5, 0.5) is None and be(0.5, -0.1, 0.5) is None


def test_interval_bounds_are_inclusive(spark):
    rows = spark.createDataFrame(
        [("a", 0.6310), ("b", 0.6912), ("c", 0.6289), ("d", 0.72)], "band string, rate double"
    ).withColumn("n_queries", F.lit(100))
    reg = rows.select(
        "band", F.lit(0.6310).alias("registered_lo"), F.lit(0.6912).alias("registered_hi")
    ).unionByName(
        spark.createDataFrame([("e", 0.1, 0.2)], "band string, registered_lo double, registered_hi double")
    )
    out = {r["band"]: r for r in registration.score_registration(reg, rows).collect()}
    assert [out[b]["verdict"] for b in "abcde"] == ["HIT", "HIT", "MISS LOW", "MISS HIGH", "absent"]
    assert out["c"]["miss_points"] == pytest.approx(-0.21)
    assert out["d"]["miss_points"] == pytest.approx(2.88)
    assert math.isnan(value(spark, stats.binomial_se(F.lit(0.5), F.lit(0))))


def rates(spark, **by_run):
    return spark.createDataFrame(
        [("all", 100, r, v) for r, v in by_run.items()],
        "band string, n_queries long, run string, rate double",
    )


def test_arm_table(spark):
    r = rates(spark, a=0.10, b=0.14, c=0.20, d=0.24, e=0.20)
    arms_ = [parse_arm(x) for x in ("ref=a,b", "mix=c,d", "solo=e")]
    out = {x["arm"]: x for x in arms.arm_table(r, arms_).collect()}
    sd = 0.04 / math.sqrt(2)
    assert out["mix"]["gap_points"] == pytest.approx(10)
    assert out["mix"]["se_points"] == pytest.approx(100 * 0.04 / math.sqrt(2))
    assert out["solo"]["sd_borrowed"] and out["solo"]["sd"] is None
    assert out["solo"]["se_points"] == pytest.approx(100 * math.sqrt(sd**2 / 2 + sd**2))
    cross = rates(spark, a=0.10, b=0.30, c=0.20, d=0.22)
    assert arms.arm_table(cross, arms_[:2]).first()["pairs_favouring"] == 2
    with pytest.raises(Exception, match="missing runs"):
        arms.arm_table(rates(spark, a=0.1, c=0.2), arms_[:2]).collect()


def test_exposure(spark):
    r = spark.createDataFrame(
        [("lo", 1000, "a", 0.80), ("lo", 1000, "m", 0.79), ("hi", 100, "a", 0.20), ("hi", 100, "m", 0.25)],
        "band string, n_queries long, run string, rate double",
    )
    ex = spark.createDataFrame([("mix", "lo", 0.5), ("mix", "hi", 2.0)], "arm string, band string, ratio double")
    rows = arms.exposure_rows(r, parse_arm("ref=a"), [parse_arm("mix=m")], ex)
    s = arms.exposure_summary(rows).first()
    assert s["items_lost"] == pytest.approx(-10) and s["items_gained"] == pytest.approx(5)
    assert s["given_up_per_gain"] == pytest.approx(2.0)
    assert s["net_points"] == pytest.approx(-500 / 1100)


def test_no_exposure_contrast_has_no_fit(spark):
    r = spark.createDataFrame(
        [(b, 100, x, v) for b, v in (("p", 0.1), ("q", 0.2)) for x, v in (("a", v), ("m", v + 0.05))],
        "band string, n_queries long, run string, rate double",
    )
    ex = spark.createDataFrame([("mix", b, 1.69) for b in "pq"], "arm string, band string, ratio double")
    rows = arms.exposure_rows(r, parse_arm("ref=a"), [parse_arm("mix=m")], ex)
    assert arms.exposure_summary(rows).first()["fit_points_per_doubling"] is None


def test_mix_summary(spark):
    df = spark.createDataFrame([(s,) for s in (2, 3, 7, 13, 14)], "size int")
    got = {r["band"]: r for r in arms.mix_summary(df, "size", 10, 3.0, "0-9,10+").collect()}
    assert got["10+"]["share"] == pytest.approx(2 / 5)
    assert got["10+"]["weighted_share"] == pytest.approx(6 / 9)
    with pytest.raises(ValueError):
        arms.mix_summary(df, "size", 10, 0.0, "0-9,10+")


def test_size_bias_and_right_size(make):
    q, j = make(
        {
            ("a", 1): dict(size=7, cands=[("x", "X", False, False, 0, 3), ("y", "Y", False, False, 0, 3), ("z", "Z", False, False, 0, 7)]),
            ("a", 2): dict(size=7, cands=[]),
        }
    )
    per_query = anatomy.size_bias_queries(q, j)
    r = anatomy.size_bias(per_query, "all").first()
    assert r["n_queries"] == 1
    assert r["miss_mean_bias"] == pytest.approx(13 / 3 - 7)
    assert r["miss_closest_bias"] == 0
    assert anatomy.right_size(per_query, "all").first()["share_of_proposals"] == pytest.approx(1 / 3)


def test_preimages(make):
    four = [(f"r{i}", f"c{i}", True) for i in range(4)]
    q, j = make({("a", 1): dict(cands=four), ("a", 2): dict(cands=[("x", "X")])})
    r = anatomy.preimages(anatomy.size_bias_queries(q, j), "all").first()
    assert (r["preimages_per_query"], r["recovery"]) == (2.0, 0.5)
    assert r["poisson_recovery"] == pytest.approx(1 - math.exp(-2))


def test_anatomy_uses_raw_slots(make):
    q, j = make({("a", 1): dict(cands=[("p", None), ("q", None), ("x", "X", True)])})
    slots = anatomy.raw_slots(q, j, 2)
    assert anatomy.miss_anatomy(slots, 2, "all").first()["recovery"] == 0
    assert anatomy.raw_slots(q, j, 3).first()["fp_rank"] == 3


def test_bands_have_no_hidden_bounds(spark):
    from shortlist.functions.bands import explode_bands
    from shortlist.operators.prep import size_between

    df = spark.createDataFrame([(1_500_000,), (None,), (-3,)], "size long")
    got = {(r.size, r.band) for r in explode_bands(df, "size", "50+,0-9,all").collect()}
    assert got == {(1_500_000, "50+"), (1_500_000, "all"), (None, "all"), (-3, "all")}
    assert size_between(df, "size", None, None).count() == 3
    assert size_between(df, "size", None, 10).count() == 1


def test_arm_grammar():
    import pytest

    assert parse_arm("a=r1,,r2@x").runs == ("r1", "r2") and parse_arm("a=r1@").record is None
    for bad in ("a", "a=", "a=,", "a=@x", "5-", "x+"):
        with pytest.raises(ValueError):
            (parse_band if bad[0] in "5x" else parse_arm)(bad)


@pytest.mark.parametrize("ranges", [4096, 3])
def test_medians_in_two_passes(spark, ranges, monkeypatch):
    """Against the sorted values, with weights, a null group, equal values and a hot group."""
    import random
    import statistics

    from shortlist.operators import quantiles

    monkeypatch.setattr(quantiles, "RANGES", ranges)
    rng = random.Random(ranges)
    groups = {
        "even": [(rng.randint(-50, 50) / 4, rng.randint(1, 4)) for _ in range(40)],
        "hot": [(rng.choice([7.5, rng.random() * 1e6]), 1) for _ in range(2001)],
        "one": [(3.0, 1)],
        "two": [(1.0, 1), (4.0, 1)],
        "equal": [(2.0, 5)] * 3,
        None: [(1.0, 1), (2.0, 1), (9.0, 2)],
    }
    rows = [(g, v, w) for g, values in groups.items() for v, w in values] + [("even", None, 9), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(4)
    got = {r.g: r["median"] for r in quantiles.medians(df, ["g"], "v", F.col("w")).collect()}
    assert got == {g: statistics.median([v for v, w in values for _ in range(w)]) for g, values in groups.items()}
    plain = {r.g: r["median"] for r in quantiles.medians(df, ["g"], "v").collect()}
    assert plain == {g: statistics.median([v for v, _ in values]) for g, values in groups.items()}


@pytest.mark.parametrize("most", ["10m", "-1"])
def test_medians_of_a_small_file_do_not_broadcast_its_rows(spark, tmp_path, most):
    """A file of well-compressed columns counts as small though it holds many rows."""
    rows = spark.range(20_000).selectExpr("'s1' AS run", "id % 3 = 0 AS hit", "id % 7 AS size", "id % 5 AS n_tokens")
    rows.write.parquet(f"{tmp_path}/rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        found = anatomy.success_vs_failure(spark.read.parquet(f"{tmp_path}/rows"), ("size", "n_tokens"))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    inner = [x for x in plan.splitlines() if "Join" in x and "Inner" in x]
    assert inner and all("BuildRight" in x for x in inner)
    assert {r.attribute: (r.hit_median, r.fail_median) for r in found.collect()} == {"size": (3.0, 3.0), "n_tokens": (2.0, 2.0)}
