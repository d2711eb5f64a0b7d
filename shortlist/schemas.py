"""Explicit schemas of the central tables."""

from __future__ import annotations

from pyspark.sql import types as T

RESULT = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("fp_match", T.BooleanType()),
        T.StructField("exact_structure", T.BooleanType()),
        T.StructField("tanimoto", T.DoubleType()),
        T.StructField("canonical", T.StringType()),
        T.StructField("duplicate", T.BooleanType()),
    ]
)

#: One JSON line per query of one run.
DUMP = T.StructType(
    [
        T.StructField("reference", T.StringType()),
        T.StructField("fp_unseen", T.BooleanType()),
        T.StructField("n_samples", T.IntegerType()),
        T.StructField("results", T.ArrayType(RESULT)),
    ]
)

#: One row per (run, query, candidate).
JUDGED = T.StructType(
    [
        T.StructField("run", T.StringType(), False),
        T.StructField("query_id", T.LongType(), False),
        T.StructField("pos", T.LongType()),
        T.StructField("raw", T.StringType()),
        T.StructField("canonical", T.StringType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("fp_match", T.BooleanType()),
        T.StructField("exact_structure", T.BooleanType()),
        T.StructField("tanimoto", T.DoubleType()),
        T.StructField("duplicate", T.BooleanType()),
        T.StructField("cand_size", T.IntegerType()),
    ]
)

#: One row per (run, query); holds the queries that produced no candidate too.
QUERIES = T.StructType(
    [
        T.StructField("run", T.StringType(), False),
        T.StructField("query_id", T.LongType(), False),
        T.StructField("fp_unseen", T.BooleanType(), False),
        T.StructField("n_samples", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
    ]
)

#: One evaluation of one run during training.
TRACE_RECORD = T.StructType(
    [
        T.StructField("epoch", T.LongType()),
        T.StructField("step", T.LongType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("valid_loss", T.DoubleType()),
        T.StructField(
            "valid",
            T.StructType(
                [
                    T.StructField("budget", T.StringType()),
                    T.StructField("ks", T.ArrayType(T.IntegerType())),
                    T.StructField(
                        "slices",
                        T.MapType(
                            T.StringType(),
                            T.StructType(
                                [
                                    T.StructField("n_queries", T.LongType()),
                                    T.StructField(
                                        "recovery_at_k",
                                        T.MapType(T.StringType(), T.DoubleType()),
                                    ),
                                    T.StructField("budget_filled_rate", T.DoubleType()),
                                    T.StructField("validity", T.DoubleType()),
                                ]
                            ),
                        ),
                    ),
                ]
            ),
        ),
    ]
)

_REPORT = T.StructType(
    [
        T.StructField(
            "slices",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField(
                            "recovery_at_k", T.MapType(T.StringType(), T.DoubleType())
                        )
                    ]
                ),
            ),
        )
    ]
)

#: One appended experiment record.
LEDGER = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("n_parameters", T.LongType()),
        T.StructField("primary_metric", T.DoubleType()),
        T.StructField(
            "generation",
            T.StructType(
                [T.StructField("k", T.IntegerType()), T.StructField("budget", T.StringType())]
            ),
        ),
        T.StructField("model_report", _REPORT),
        T.StructField("baseline_report", _REPORT),
    ]
)

#: Band report: rates per run and pair tests per band.
BAND_REPORT = T.StructType(
    [
        T.StructField("k", T.IntegerType()),
        T.StructField("order", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("budget", T.StringType()),
        T.StructField("n_fp_unseen", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StringType())),
        T.StructField(
            "bands",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("n_queries", T.LongType()),
                        T.StructField("share_of_protocol", T.DoubleType()),
                        T.StructField("per_run", T.MapType(T.StringType(), T.DoubleType())),
                    ]
                ),
            ),
        ),
    ]
)

#: Miss-anatomy report: the recovery ladder per band.
ANATOMY_REPORT = T.StructType(
    [
        T.StructField("k", T.IntegerType()),
        T.StructField(
            "bands",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("n_queries", T.LongType()),
                        T.StructField(
                            "recovery_at_k", T.MapType(T.StringType(), T.DoubleType())
                        ),
                        T.StructField("recovery", T.DoubleType()),
                        T.StructField("structure", T.DoubleType()),
                        T.StructField("mean_best_tanimoto_among_misses", T.DoubleType()),
                        T.StructField("budget_filled_rate", T.DoubleType()),
                    ]
                ),
            ),
        ),
    ]
)

#: Training mix: band shares before and after weighting.
MIX_RECORD = T.StructType(
    [
        T.StructField(
            "size_weighted_mix",
            T.StructType(
                [
                    T.StructField("threshold", T.IntegerType()),
                    T.StructField("factor", T.DoubleType()),
                    T.StructField(
                        "bands",
                        T.MapType(
                            T.StringType(),
                            T.StructType(
                                [
                                    T.StructField("share", T.DoubleType()),
                                    T.StructField("weighted_share", T.DoubleType()),
                                ]
                            ),
                        ),
                    ),
                ]
            ),
        )
    ]
)

#: Registered intervals, written before the run they predict.
REGISTRATION = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("k", T.IntegerType()),
        T.StructField(
            "rows",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("band", T.StringType()),
                        T.StructField("n", T.LongType()),
                        T.StructField("registered_lo", T.DoubleType()),
                        T.StructField("registered_hi", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
