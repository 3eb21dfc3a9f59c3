import datetime as dt
import gzip
import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fluxloom import schemas
from fluxloom.operators.isolate import isolated
from fluxloom.plans import common, runs
from fluxloom.session import clear_staged, shared_folder, staged
from fluxloom.sources import grid, tables
from fluxloom.streaming.ingest import ingest_new_files
from tests.helpers import month, seasonal

DAILY = schemas.TARGETS


@pytest.fixture(scope="module")
def daily(spark):
    values = [("p", s, month(i), "P1M", "flux", float(v), 1) for s, k in (("311", 1), ("321", 2)) for i, v in enumerate(seasonal(60, k))]
    return spark.createDataFrame(values, DAILY).cache()


def stored(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("site_id", "reference_datetime", "datetime", "variant", "mu").collect()))


def test_layouts_with_swapped_columns_do_not_mix(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a_final_CH4_fluxes.csv").write_text("Date,Plot,flux\n2020-01-01,313,1\n2020-01-02,NA,2\n")
    (tmp_path / "b_final_CH4_fluxes.csv").write_text("flux,Date,Plot,extra\n3,2020-01-03,321,e\n")
    (tmp_path / "other.csv").write_text("Date,Plot,flux\n2020-01-09,999,9\n")
    out = tables.scan_text_csv(spark, str(tmp_path), "*final_CH4_fluxes*").select("Date", "Plot", "flux", "extra")
    assert sorted(map(tuple, out.collect()), key=str) == [
        ("2020-01-01", "313", "1", None), ("2020-01-02", None, "2", None), ("2020-01-03", "321", "3", "e")
    ]


def test_empty_gzip_files_are_skipped(spark, tmp_path):
    header = ",".join(c.split()[0] for c in schemas.FORECASTS.split(", "))
    row = "p,ets,2020-02-01,2020-01-01,P1M,311,normal,mu,flux,1.5"
    with gzip.open(tmp_path / "monthly-2020-01-01-ets.csv.gz", "wt") as f:
        f.write(f"{header}\n{row}\n")
    with gzip.open(tmp_path / "empty.csv.gz", "wt"):
        pass
    out = tables.scan_forecasts(spark, str(tmp_path)).collect()
    assert len(out) == 1 and out[0].prediction == 1.5 and out[0].datetime == dt.date(2020, 2, 1)


def test_grid_unfolds_first_dimension_fastest(spark):
    df = spark.createDataFrame([([10, 20], ["x", "y", "z"], [float(i) for i in range(6)])], "lat array<int>, lon array<string>, v array<double>")
    out = [tuple(r) for r in grid.flatten_grid(df, ["lat", "lon"], ["v"]).orderBy("v").collect()]
    assert out == [(10, "x", 0.0), (20, "x", 1.0), (10, "y", 2.0), (20, "y", 3.0), (10, "z", 4.0), (20, "z", 5.0)]


def test_backfill_equals_single_issues_and_then_writes_nothing(spark, daily, tmp_path):
    path = str(tmp_path / "store")
    start, end = month(50), month(53).replace(day=20)
    assert runs.backfill(spark, "climatology", daily, None, path, start, end).isEmpty()
    single = sorted(
        (r.site_id, r.reference_datetime, r.datetime, r.variant, r.mu)
        for i in range(50, 54)
        for r in runs.issue_forecast("climatology", daily, None, runs.issue_dates(spark, [month(i)])).collect()
    )
    first = stored(spark, path)
    assert first == single
    before = tables.forecast_catalog(spark, path).collect()
    assert runs.backfill(spark, "climatology", daily, None, path, start, end).isEmpty()
    assert sorted(map(str, tables.forecast_catalog(spark, path).collect())) == sorted(map(str, before))
    # Replicate groups are another variant: they run although the plots are stored.
    assert runs.backfill(spark, "climatology", daily, None, path, start, end, variant=runs.REPLICATES).isEmpty()
    assert {r[3] for r in stored(spark, path)} == {runs.SEPARATE, runs.REPLICATES}


def test_old_output_is_replaced_not_doubled(spark, daily, tmp_path):
    path = str(tmp_path / "store")
    runs.backfill(spark, "climatology", daily, None, path, month(50), month(51))
    first = stored(spark, path)
    future = dt.datetime.now() + dt.timedelta(days=1)
    runs.backfill(spark, "climatology", daily, None, path, month(50), month(51), cutoff=future)
    assert stored(spark, path) == first


def test_a_failing_issue_date_costs_only_itself(spark, daily, tmp_path):
    bad = month(51)

    def fragile(monthly, drivers, issues):
        out = common.MODELS["climatology"](monthly, drivers, issues)
        broken = F.when(F.col("reference_datetime") == F.lit(bad), F.raise_error(F.lit("no fit")).cast("double"))
        return out.withColumn("mu", F.coalesce(broken, F.col("mu")))

    common.register_model("fragile", fragile)
    path = str(tmp_path / "store")
    errors = runs.backfill(spark, "fragile", daily, None, path, month(50), month(52)).collect()
    assert [e.issue for e in errors] == [bad], errors
    assert {r[1] for r in stored(spark, path)} == {month(50), month(52)}


def test_issue_dates_without_forecast_are_reported(spark, daily, tmp_path):
    errors = runs.backfill(spark, "climatology", daily, None, str(tmp_path / "s"), month(-3), month(-2)).collect()
    assert {e.issue for e in errors} == {month(-3), month(-2)}


def test_incremental_ingest_takes_new_files_once(spark, tmp_path):
    raw, store, check = tmp_path / "raw", str(tmp_path / "store"), str(tmp_path / "check")
    raw.mkdir()
    rules = spark.createDataFrame([(dt.date(2020, 1, 2), None)], "date date, plot string")
    header = "Date,Plot,Light,flux\n"
    (raw / "one.csv").write_text(header + "2020-01-01,313,Dark,1.5\n2020-01-02,313,Dark,2.5\n")
    ingest_new_files(spark, str(raw), rules, store, check)
    (raw / "two.csv").write_text(header + "1/3/2020,321,NA,3.5\n1/4/2020,321,Light,4.5\n")
    ingest_new_files(spark, str(raw), rules, store, check)
    ingest_new_files(spark, str(raw), rules, store, check)
    out = spark.read.parquet(store).select("site_id", "datetime", "observation").collect()
    assert sorted(map(tuple, out)) == [("313", dt.date(2020, 1, 1), 1.5), ("321", dt.date(2020, 1, 3), 3.5)]


class _Session:
    """A session as far as ``shared_folder`` looks at it."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = SimpleNamespace(master=master, getCheckpointDir=lambda: None)


def test_a_cluster_must_name_the_shared_folder():
    assert shared_folder(_Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_folder(_Session(master))


def test_functions_reach_workers_started_elsewhere(tmp_path):
    """Workers need no copy of the package: the session starts in another folder, without PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from fluxloom.session import build_session\n"
        "from fluxloom.operators import linalg\n"
        "from pyspark.sql import functions as F\n"
        "s = build_session('x', 'local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
        "df = s.range(9).select((F.col('id') % 2).alias('k'), F.col('id').cast('double').alias('x'))\n"
        "print('FITS', linalg.gram_fit(df, ['k'], [F.col('x')], F.col('x')).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "FITS 2" in done.stdout, done.stderr[-2000:]


def test_staged_tables_can_be_cleared(spark, tmp_path):
    import glob

    staged(spark.range(3), "clearing").count()
    folder = shared_folder(spark).removeprefix("file:")
    assert glob.glob(f"{folder}/fluxloom-clearing-*")
    clear_staged(spark)
    assert not glob.glob(f"{folder}/fluxloom-clearing-*")


def bytes_read_by_spark(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalInputBytes()


def test_headers_cost_a_block_per_file_whatever_its_size(spark, tmp_path):
    line = "2020-01-01,313,1.25\n"
    for k in range(3):
        (tmp_path / f"{k}_final_CH4_fluxes.csv").write_text("\n\nDate,Plot,flux\n" + line * (400_000 * k + 1))
    with gzip.open(tmp_path / "z_final_CH4_fluxes.csv.gz", "wt") as f:
        f.write("flux,Plot\r\n" + "1,2\r\n" * 100_000)
    (tmp_path / "long_final_CH4_fluxes.csv").write_text("Date," + "x" * (3 * tables.PROBE) + "\n1,2\n")
    (tmp_path / "blank_final_CH4_fluxes.csv").write_text("\n \n")
    before = bytes_read_by_spark(spark)
    got = {os.path.basename(r.path): r for r in tables.file_headers(spark, str(tmp_path), "*final_CH4*").collect()}
    assert bytes_read_by_spark(spark) - before < 1000
    assert [got[f"{k}_final_CH4_fluxes.csv"].header for k in range(3)] == ["Date,Plot,flux"] * 3
    assert max(got[f"{k}_final_CH4_fluxes.csv"].read for k in range(3)) <= tables.PROBE < (tmp_path / "1_final_CH4_fluxes.csv").stat().st_size
    assert got["z_final_CH4_fluxes.csv.gz"].header == "flux,Plot" and got["z_final_CH4_fluxes.csv.gz"].read <= tables.PROBE
    assert len(got["long_final_CH4_fluxes.csv"].header) == 3 * tables.PROBE + 5
    assert got["blank_final_CH4_fluxes.csv"].header is None and got["blank_final_CH4_fluxes.csv"].problem is None
    out = tables.scan_text_csv(spark, str(tmp_path), "[0-9z]_final_CH4*")
    assert out.count() == 1_200_003 + 100_000 and set(out.columns) == {"Date", "Plot", "flux"}


def test_files_that_only_spark_opens_are_scanned_for_headers(spark, tmp_path, monkeypatch):
    def unopened(path):
        raise OSError("no such store")

    monkeypatch.setattr(tables, "first_line", unopened)
    test_layouts_with_swapped_columns_do_not_mix(spark, tmp_path)
    assert tables.scan_text_csv(spark, str(tmp_path), "nothing*").columns == []


def test_one_bad_series_costs_only_itself(spark, daily, tmp_path, monkeypatch):
    from fluxloom.plans import ets

    solve = ets.fold_grid

    def fragile(series, grid):
        if any(y[0] == 0.0 for y in series):
            raise ValueError("bad series")
        return solve(series, grid)

    monkeypatch.setattr(ets, "fold_grid", fragile)
    zero = daily.where("site_id = '311'").withColumns({"site_id": F.lit("999"), "observation": F.lit(0.0)})
    path, whole = str(tmp_path / "store"), str(tmp_path / "whole")
    errors = runs.backfill(spark, "ets", daily.union(zero), None, path, month(50), month(52)).collect()
    assert sorted((e.issue, e.site_id, e.message) for e in errors) == [(month(i), "999", "ValueError: bad series") for i in (50, 51, 52)]
    assert runs.backfill(spark, "ets", daily, None, whole, month(50), month(52)).isEmpty()
    assert stored(spark, path) == stored(spark, whole)


def test_failing_dates_are_found_by_halves():
    calls = []

    def solve(places):
        calls.append(len(places))
        if {3, 17} & set(places):
            raise RuntimeError("no")
        return [p * p for p in places]

    found, errors = isolated(solve, 32)
    assert [i for i, e in enumerate(errors) if e] == [3, 17] and errors[3] == "RuntimeError: no"
    assert [f for i, f in enumerate(found) if i not in (3, 17)] == [i * i for i in range(32) if i not in (3, 17)]
    assert len(calls) <= 19
    assert isolated(solve, 0) == ([], [])
