"""Frames that once gave wrong rows, lost rows or failed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basisflow.operators import audit, episodes, metrics, recursion, report
from basisflow.sources import readers, sinks


def test_histogram_keeps_the_tails_when_the_cut_points_tie(spark):
    df = spark.createDataFrame([("a", 0.0)] * 2000 + [("a", -50.0), ("a", 50.0)], "k string, x double")
    assert metrics.histogram(df, ["k"], "x", 10, 0.005, 0.995).agg(F.sum("n")).first()[0] == 2002
    one = spark.createDataFrame([("a", 3.0)] * 5, "k string, x double")
    assert metrics.histogram(one, ["k"], "x", 10, 0.005, 0.995).select("lo", "hi", "n").first()[:] == (2.0, 4.0, 5)


def test_metadata_comes_from_the_first_row_in_order(spark):
    meta = spark.createDataFrame([(1, "Z", 1), (1, "A", 2), (2, None, 1), (2, "B", 2)], "id int, size string, row_no int")
    df = spark.createDataFrame([(1, None), (2, None), (2, "own"), (3, None)], "id int, size string")
    assert sorted(((r.id, r.size) for r in report.enrich(df, meta, "id", ["size"], ["row_no"]).collect()), key=str) == [(1, "Z"), (2, "own"), (2, None), (3, None)]


def test_the_last_label_and_the_rows_own_label_win(spark):
    labels = spark.createDataFrame([("E", "1", "FEASIBLE", 1), ("E", "1", "EXTREME", 2), ("E", "1", None, 3), ("E", "2", "EXTREME", 1)],
                                   "exposure_id string, scenario_id string, oracle_series string, entry int")
    df = spark.createDataFrame([("E", "1", "oracle_all", None), ("E", "2", "oracle_all", "FEASIBLE"), ("E", "3", "oracle_all", None), ("E", "1", "company", None)],
                               "exposure_id string, scenario_id string, scenario_kind string, oracle_series string")
    assert [r.scenario_kind for r in report.split_by_label(df, labels, ["entry"]).orderBy("scenario_id", F.desc("scenario_kind")).collect()] == \
        ["oracle_extreme", "company", "oracle_feasible", "oracle_all"]


def test_csv_copy_follows_the_csv_and_needs_a_finished_write(spark, tmp_path):
    src, out = tmp_path / "x.csv", str(tmp_path / "copy")
    src.write_text("a\n1\n")
    assert readers.csv_to_parquet(spark, str(src), out).count() == 1
    src.write_text("a\n1\n2\n")
    copy = readers.csv_to_parquet(spark, str(src), out)
    assert copy.count() == 2
    folder = copy.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    (tmp_path / "copy" / folder.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert readers.csv_to_parquet(spark, str(src), out).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.csv_to_parquet(spark, str(tmp_path / "none.csv"), out)


def test_valid_utf8_with_the_replacement_sign_stays(spark, tmp_path):
    good, old = tmp_path / "good.csv", tmp_path / "old.csv"
    good.write_text("Date,name\n2020-01-01,gr�n é\n")
    old.write_bytes("Date,name\n2020-01-01,é\n".encode("latin-1"))
    assert readers.read_table(spark, str(good)).first()["name"] == "gr�n é"
    assert readers.read_table(spark, str(old)).first()["name"] == "é"


def test_folder_names_stay_text_and_appends_align(spark, tmp_path):
    path = str(tmp_path / "results")
    df = spark.createDataFrame([("007", "baseline", "s1", 1.0), ("8", "baseline", "s2", 2.0)], "exposure_id string, scenario_kind string, scenario_id string, net double")
    sinks.write_results(df, path)
    sinks.append_results(df.drop("net").withColumn("extra", F.lit(1)), path)
    back = readers.read_results(spark, [path])
    assert sorted({r.exposure_id for r in back.collect()}) == ["007", "8"] and back.count() == 4 and "extra" not in back.columns


def test_scenario_root_takes_labels_and_rejects_damaged_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2020-01-01", "2020-02-01", 5.0, "EXTREME"), ("b", "2020-01-01", "2020-02-01", 5.0, None)],
                                 "scenario_id string, start_date string, end_date string, volume_bbl double, oracle_series string")
    rows.write.parquet(str(tmp_path / "E" / "oracle_all.parquet"))
    out = readers.read_scenario_root(spark, str(tmp_path), "E", ["baseline", "oracle_all"])
    assert sorted((r.scenario_id, r.scenario_kind) for r in out.collect()) == [("a", "oracle_extreme"), ("b", "oracle_all")]
    (tmp_path / "E" / "baseline.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        readers.read_scenario_root(spark, str(tmp_path), "E", ["baseline", "oracle_all"]).count()


def test_no_action_at_all_and_null_keys(spark):
    counts = spark.createDataFrame([("x", "a", 0), ("x", "b", 0), (None, "a", 3), (None, "b", 3)], "k string, action string, n long")
    out = {r.k: round(r.entropy, 6) for r in episodes.action_entropy(counts, ["k"]).collect()}
    assert out == {"x": 0.0, None: round(float(np.log(2)), 6)}


def test_zero_notional_is_floored(spark):
    log = spark.createDataFrame([("s", "n", 0, 1.0, 0.0, 0.0, 0.5), ("s", "n", 1, -2.0, 0.0, 0.0, 0.5)],
                                "scenario_id string, strategy string, pos int, pnl double, notional double, notional0 double, decision_cost double")
    assert [r.portfolio_return for r in episodes.risk_attribution(log).orderBy("pos").collect()] == [1.0, -2.0]


def test_all_outliers_come_back(spark):
    df = spark.range(20000).select(F.lit("s").alias("series_id"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
                                   F.when(F.col("id") % 80 == 0, 1000.0).otherwise(F.rand(1)).alias("x"))
    assert audit.outliers(df, "x").count() == 250
    assert audit.outliers(df, "x", limit=200).count() == 200


@pytest.mark.parametrize("n", [1, 2, 7, 19, 20, 21, 39, 40, 41, 100, 399])
def test_order_tail_is_the_mean_of_the_k_smallest(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 1)
    df = spark.createDataFrame([(None, float(v)) for v in x] + [("b", None)], "k string, x double")
    r = metrics.tail_metrics(df, ["k"], "x", "order").where("k is null").first()
    k = max(1, int(np.floor(n * 0.05)))
    assert r["var"] == np.sort(x)[k - 1] and abs(r["es"] - np.sort(x)[:k].mean()) < 1e-12


def test_scans_equal_plain_loops():
    rng = np.random.default_rng(0)
    r, f = rng.normal(size=300) * 0.02, rng.normal(size=300) * 0.02
    r[[0, 9, 77]] = np.nan
    f[[0, 50]] = np.inf
    v = recursion.garch(r)
    for t in range(1, 300):
        x = r[t - 1] if np.isfinite(r[t - 1]) else 0.0
        assert abs(v[t] - (1e-8 + 0.06 * x * x + 0.92 * v[t - 1])) < 1e-15
    e = np.log(recursion.egarch(r))
    for t in range(1, 300):
        z = r[t - 1] / np.exp(e[t - 1] / 2) if np.isfinite(r[t - 1]) else 0.0
        assert abs(e[t] - (-0.05 + 0.94 * e[t - 1] + 0.10 * (abs(z) - np.sqrt(2 / np.pi)) - 0.05 * z)) < 1e-9
    cov, corr = recursion.ewma_pair(r, f)
    for t in range(1, 300):
        p = r[t - 1] * f[t - 1] if np.isfinite(r[t - 1]) and np.isfinite(f[t - 1]) else 0.0
        assert abs(cov[t] - (0.97 * cov[t - 1] + 0.03 * p)) < 1e-15
    assert cov[0] == corr[0] == 0 and np.abs(corr).max() <= 0.999
    assert np.isnan(recursion.dcc_path(np.array([1.0, np.nan, 2.0]), np.ones(3))).all()
