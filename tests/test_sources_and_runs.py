"""Encodings per file, committed parts, threshold samples, run folders and rankings."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from basisflow.operators import episodes, report
from basisflow.plans.ordered import sub_buckets
from basisflow.sources import readers, sinks


# ---- CSV ----
def test_each_file_of_a_folder_has_its_own_encoding(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("Date,näme,x\n2020-01-01,Zürich,1\n2020-01-02,,\n".encode())
    (folder / "b.csv").write_bytes("Date,näme,x\n2020-01-03,Köln,2\n2020-01-04,plain,3\n".encode("latin-1"))
    (folder / "c.csv").write_bytes("Date,näme,x\n2020-01-05,日本 €,4\n".encode("utf-8-sig"))
    (folder / "d.csv").write_bytes(b"Date,n\xe4me,x\n")
    got = sorted((r["Date"], r["näme"], r["x"]) for r in readers.read_table(spark, str(folder)).collect())
    assert got == [("2020-01-01", "Zürich", "1"), ("2020-01-02", None, None), ("2020-01-03", "Köln", "2"), ("2020-01-04", "plain", "3"), ("2020-01-05", "日本 €", "4")]


def test_a_latin_file_is_latin_throughout(spark, tmp_path):
    """Bytes of one line that happen to be UTF-8 do not make it so."""
    path = tmp_path / "one.csv"
    path.write_bytes("Date,name\n2020-01-01,Ã¼\n2020-01-02,ü\n".encode("latin-1"))
    assert sorted(r["name"] for r in readers.read_table(spark, str(path)).collect()) == sorted(["Ã¼", "ü"])
    (tmp_path / "none.csv").write_bytes(b"\xef\xbb\xbfDate,name\n")
    empty = readers.read_table(spark, str(tmp_path / "none.csv"))
    assert empty.columns == ["Date", "name"] and empty.count() == 0


# ---- parts ----
def bucketed(spark, rows):
    return spark.createDataFrame(rows, "exposure_id string, scenario_kind string, x double")


def test_a_part_written_again_takes_the_place_of_the_first(spark, tmp_path):
    path = str(tmp_path / "parts")
    with pytest.raises(FileNotFoundError):
        readers.read_parts(spark, path)
    sinks.write_part(bucketed(spark, [("1", "a", 1.0), ("2", "b", 2.0)]), path, "w1")
    sinks.write_part(bucketed(spark, [("1", "a", 10.0)]), path, "w2")
    sinks.write_part(bucketed(spark, [("1", "a", 5.0)]), path, "w1")  # a bucket of the first run is gone
    bucketed(spark, [("9", "z", 99.0)]).write.parquet(f"{path}/part=w3/run=died")  # never committed
    assert sorted((r.part, r.exposure_id, r.scenario_kind, r.x) for r in readers.read_parts(spark, path).collect()) == [("w1", "1", "a", 5.0), ("w2", "1", "a", 10.0)]
    for bad in ("a/b", "", "_x", "a b"):
        with pytest.raises(ValueError):
            sinks.write_part(bucketed(spark, []), path, bad)


def test_a_failing_writer_leaves_the_part_as_it_was(spark, tmp_path):
    path = str(tmp_path / "parts")
    sinks.write_part(bucketed(spark, [("1", "a", 1.0)]), path, "w1")
    broken = bucketed(spark, [("1", "a", 1.0)]).withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_part(broken, path, "w1")
    assert [r.x for r in readers.read_parts(spark, path).collect()] == [1.0]


def test_report_csv_is_ordered_over_its_files(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for a table too large for one file
    try:
        sinks.write_report_csv(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), path, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "r.csv").glob("part-*.csv"))
    assert [int(x) for f in files for x in f.read_text().split()[1:]] == list(range(1000)) and len(files) > 1


# ---- samples ----
@pytest.mark.parametrize("n", [0, 1, 500, 2000, 4000, 9999])
def test_seeded_sample_is_the_bottom_of_the_hashes(spark, n):
    names = [f"s{i}" for i in range(3900)] + ["twin"] * 100
    df = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, i long").repartition(7)
    got = episodes.seeded_sample(df, n, "seed", "name")
    order = sorted(names, key=lambda x: (hashlib.md5(f"seed|{x}".encode()).hexdigest(), x))
    assert sorted(r.name for r in got.collect()) == sorted(order[:n])
    assert got.columns == df.columns


def test_half_of_a_table_meets_in_no_single_task(spark):
    got = episodes.seeded_sample(spark.range(20_000).select(F.col("id").cast("string").alias("name")), 10_000, "s", "name")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert got.count() == 10_000
    # the only windows without a key run over counts per range
    assert all("_upto" in line or "_w0" in line or "_m" in line for line in plan.splitlines() if "SinglePartition" in line and "_range" in line)


@pytest.mark.parametrize("least", [10, 0, 10 ** 6])
def test_sub_buckets_rise_with_the_order_and_spare_small_groups(spark, least):
    rows = [("big", float(i % 97)) for i in range(500)] + [("small", float(i)) for i in range(8)] + [(None, 3.0)] + [("big", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = sub_buckets(df, ["g"], "x", least=least).collect()
    assert len(out) == len(rows)
    for g in ("big", "small", None):
        mine = sorted((r.x if r.x is not None else float("-inf"), r._b) for r in out if r.g == g)
        assert [b for _, b in mine] == sorted(b for _, b in mine) and all(len({b for x, b in mine if x == v}) == 1 for v, _ in mine)
        buckets = len({b for _, b in mine})
        assert buckets == 1 if least == 10 ** 6 or (least == 10 and g != "big") else buckets >= 1
    assert least != 10 or len({r._b for r in out if r.g == "big"}) > 20


# ---- runs ----
def test_run_folder_settings(spark):
    rows = [("out/x_T200000_s3_hmin-0.5_hmax1.5_dh2.5e-1_wLPM1.0_wVOL0.5_wCOST1E-2_tau0.02", None), ("run_T5_x/", None), ("wLPM1_wVOL2_wCOST3", None),
            ("a_T7_hmin0_hmax1_dh0.1_wLPM+_wVOL1_wCOST2_tau3", None), ("plain", None), (None, None), ("x_T9_y", 42.0)]
    out = report.run_folder_settings(spark.createDataFrame(rows, "run_dir string, timesteps double"), "run_dir").collect()
    pick = lambda r: (r.timesteps, r.h_min, r.h_max, r.delta_h, r.w_lpm, r.w_volatility, r.w_cost, r.lpm_target, r.gamma)
    none = (None,) * 9
    assert [pick(r) for r in out] == [(200000, -0.5, 1.5, 0.25, 1.0, 0.5, 0.01, 0.02, None), (5, *none[1:]), none, (7, 0.0, 1.0, 0.1, None, 1.0, 2.0, 3.0, None), none, none, (42, *none[1:])]


def test_rank_runs_keeps_the_last_of_a_configuration(spark):
    cols = ["w_lpm", "w_volatility", "w_cost", "delta_h", "gamma", "timesteps", "lpm_target", "no", "flags_total", "diff_mean_pnl", "diff_es95", "diff_he", "turnover_h"]
    base = (0.5, 0.25, None, 100, 0.0)
    rows = [(1.0, *base[:2], None, None, 100, 0.0, 1, 3, 9.0, 9.0, 9.0, 0.0), (1.0 + 1e-13, *base[:2], None, None, 100, 0.0, 2, 0, 1.0, 1.0, 0.1, 5.0),
            (2.0, *base[:2], None, None, 100, 0.0, 3, 2, 5.0, 1.0, 0.2, 5.0), (3.0, *base[:2], None, None, 100, 0.0, 4, 2, 5.0, 0.0, 0.3, 1.0), (4.0, *base[:2], None, None, 200, 0.0, 5, 1, 0.0, None, 0.0, 7.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in ('no', 'flags_total', 'timesteps') else 'double'}" for c in cols))
    out = {r.no: r for r in report.rank_runs(df, ["no"]).collect()}
    assert set(out) == {2, 3, 4, 5}
    # ranks of 2, 3, 4, 5: mean 3, 1.5, 1.5, 4; es95 1.5, 1.5, 3, none; he 3, 2, 1, 4; turnover 2.5, 2.5, 1, 4
    assert [out[k].rank_score for k in (2, 3, 4, 5)] == [10.0, 7.5, 6.5, None]
    assert [out[k].position for k in (4, 3, 5, 2)] == [1, 2, 3, 4] and [out[k].flagged for k in (2, 5)] == [False, True]


def test_action_statistics(spark):
    log = spark.createDataFrame([("e", a) for a in (10, 2, 2, -1, 2, None)] + [("f", 0)], "episode string, action int")
    out = {r.episode: r for r in episodes.action_statistics(log, ["episode"], "action").collect()}
    assert out["e"].action_counts == json.dumps({-1: 1, 2: 3, 10: 1}) and (out["e"].n_actions, out["e"].top_share) == (3, 0.6)
    assert (out["f"].action_counts, out["f"].n_actions, out["f"].top_share) == ('{"0": 1}', 1, 1.0)
