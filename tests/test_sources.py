"""Every reader beside the files it is for, and every writer beside its reader."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shortlist.sources import corpus, dumps


def put(path, document):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(document, indent=1))
    return str(path)


def test_lines_and_exclusions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \n")
    (tmp_path / "b.txt").write_text("two\nthree\n  \n")
    paths = [str(tmp_path / n) for n in ("a.txt", "b.txt")]
    assert [r.value for r in corpus.read_lines(spark, paths[0]).collect()] == ["one", " two "]
    assert corpus.read_lines(spark, paths).count() == 5
    assert {r.canonical for r in corpus.read_exclusions(spark, paths).collect()} == {"one", "two", "three"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.read_lines(spark, str(tmp_path / "none.txt"))


def test_written_lines_are_read_by_split(spark, tmp_path):
    items = spark.createDataFrame([("x y", "train"), ("z", "train"), ("w", "test")], "text string, split string")
    path = str(tmp_path / "lines")
    corpus.write_lines(items, "text", path)
    assert {r.value for r in corpus.read_lines(spark, f"{path}/split=train").collect()} == {"x y", "z"}
    assert {r.value for r in corpus.read_lines(spark, f"{path}/split=test").collect()} == {"w"}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        corpus.write_lines(items, "text", path)


def test_band_report(spark, tmp_path):
    report = {
        "k": 60, "order": "consensus", "metric": "recovery", "budget": "molecules", "runs": ["s1", "s2"],
        "bands": {"30-34": {"n_queries": 7, "share_of_protocol": 0.1, "per_run": {"s1": 0.5, "s2": 0.25}}},
    }
    rows = dumps.read_band_report(spark, put(tmp_path / "r.json", report)).collect()
    assert {(r.band, r.run, r.rate, r.n_queries, r.k, r.budget) for r in rows} == {
        ("30-34", "s1", 0.5, 7, 60, "molecules"), ("30-34", "s2", 0.25, 7, 60, "molecules"),
    }


def test_anatomy_report(spark, tmp_path):
    report = {"k": 3, "bands": {"all": {"n_queries": 4, "recovery_at_k": {"1": 0.25, "3": 0.5}}}}
    rows = dumps.read_anatomy_report(spark, put(tmp_path / "r.json", report), "s1").collect()
    assert {(r.run, r.band, r.n_queries, r.k, r.recovery) for r in rows} == {("s1", "all", 4, 1, 0.25), ("s1", "all", 4, 3, 0.5)}


def test_mix_record_divides_shares_and_leaves_empty_bands_null(spark, tmp_path):
    record = {"size_weighted_mix": {"bands": {"a": {"share": 0.2, "weighted_share": 0.4}, "b": {"share": 0.0, "weighted_share": 0.0}}}}
    rows = dumps.read_mix_record(spark, put(tmp_path / "m.json", record), "mix").collect()
    assert {(r.arm, r.band, r.ratio) for r in rows} == {("mix", "a", 2.0), ("mix", "b", None)}


def test_registration(spark, tmp_path):
    doc = {"metric": "recovery", "k": 20, "rows": [{"band": "all", "n": 5, "registered_lo": 0.1, "registered_hi": 0.4}]}
    row = dumps.read_registration(spark, put(tmp_path / "r.json", doc)).first()
    assert (row.metric, row.k, row.band, row.n, row.registered_lo, row.registered_hi) == ("recovery", 20, "all", 5, 0.1, 0.4)


def test_histories_take_the_run_from_the_folder_and_fall_back_to_all(spark, tmp_path):
    cell = lambda r: {"recovery_at_k": {"20": r}, "budget_filled_rate": 1.0}
    put(tmp_path / "s1" / "history.json", [
        {"epoch": 1, "step": 10, "train_loss": 2.0, "valid_loss": 2.5,
         "valid": {"budget": "molecules", "ks": [20], "slices": {"fp_unseen": cell(0.1), "all": cell(0.3)}}},
        {"epoch": 2, "train_loss": 1.5, "valid": {"budget": "molecules", "ks": [20], "slices": {"all": cell(0.4)}}},
    ])
    put(tmp_path / "s2" / "history.json", [{"epoch": 1, "step": 5, "train_loss": 1.0}])
    rows = dumps.read_histories(spark, f"{tmp_path}/*/history.json").collect()
    assert {(r.run, r.epoch, r.step, r.recovery) for r in rows} == {("s1", 1, 10, 0.1), ("s1", 2, None, 0.4), ("s2", 1, 5, None)}


def test_ledger_and_reports_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("t1", 0.5), ("t2", None)], "timestamp string, primary_metric double")
    path = str(tmp_path / "ledger")
    dumps.append_ledger(records.limit(1), path)
    dumps.append_ledger(records, path)
    assert sorted(r.timestamp for r in dumps.read_ledger(spark, path).collect()) == ["t1", "t1", "t2"]
    dumps.write_report(records, str(tmp_path / "report"), "parquet")
    assert spark.read.parquet(str(tmp_path / "report")).count() == 2
    with pytest.raises(ValueError, match="csv"):
        dumps.write_report(records, str(tmp_path / "other"), "csv")


def test_vocabulary_is_led_by_its_special_tokens(spark, tmp_path):
    vocab = spark.createDataFrame([("<pad>", 0), ("a", 1)], "token string, id long")
    path = str(tmp_path / "vocab")
    dumps.write_vocabulary(vocab, path)
    assert dumps.read_vocabulary(spark, path, ["<pad>"]).filter(F.col("id") > 0).first().token == "a"
    with pytest.raises(Exception, match="special tokens"):
        dumps.read_vocabulary(spark, path, ["<bos>"]).collect()
