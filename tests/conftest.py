from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from shortlist.session import local_session

    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Build ``(queries, judged)`` from ``{(run, query): spec}``.

    A spec is ``dict(size, unseen, cands)``; a candidate is
    ``(raw, canonical or None, fp_match, exact, tanimoto, size)``.
    """
    from pyspark.sql import functions as F

    from shortlist.operators.judge import mark_duplicates, raw_dedup

    def build(table):
        queries, rows = [], []
        for (run, q), spec in table.items():
            cands = spec.get("cands", [])
            queries.append((run, q, spec.get("unseen", True), len(cands), spec.get("size", 10)))
            for pos, c in enumerate(cands):
                raw, canonical, fp, ex, tan, size = (*c, *(None,) * (6 - len(c)))
                rows.append(
                    (run, q, pos, raw, canonical, canonical is not None, bool(fp), bool(ex),
                     float(tan if tan is not None else (1.0 if fp else 0.0)), size or 1)
                )
        qdf = spark.createDataFrame(
            queries, "run string, query_id long, fp_unseen boolean, n_samples int, size int"
        )
        jdf = spark.createDataFrame(
            rows,
            "run string, query_id long, pos long, raw string, canonical string, valid boolean, "
            "fp_match boolean, exact_structure boolean, tanimoto double, cand_size int",
        )
        return qdf, mark_duplicates(raw_dedup(jdf)).withColumn("x", F.lit(0)).drop("x")

    return build
