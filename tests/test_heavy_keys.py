from tracewood.operators.heavy_keys import heavy_symbols, symbol_figures

SCHEMA = "occ_id long, repo string, relative_path string, symbol string, symbol_roles int"


def test_figures_and_shares(spark):
    rows = [(n, "r" if n % 2 else None, f"f{n % 3}", " hot\t", n % 2) for n in range(60)]
    rows += [(100 + n, "r", "g", None if n % 2 else "", 0) for n in range(38)]
    rows += [(200, "r", None, "cold", None), (201, "r", None, "local 1", 1), (200, "r", None, "cold", None), (None, "r", "f", "hot", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _uid", "'k' as key", "3 as _n", "4 as uses")
    figures = {r["symbol"]: (r["uses"], r["files"], r["definitions"]) for r in symbol_figures(df).collect()}
    assert figures == {"hot": (60, 6, 30), "cold": (1, 1, 0)}
    assert {r["symbol"]: (r["uses"], r["total"]) for r in heavy_symbols(df).collect()} == {"hot": (60, 100), "cold": (1, 100)}
    assert [r["symbol"] for r in heavy_symbols(df, (2, 100)).collect()] == ["hot"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert symbol_figures(df).collect() == [] and heavy_symbols(df).collect() == []


def test_each_plan_scans_and_shuffles_rows_once(spark, tmp_path):
    spark.createDataFrame([(n, "r", f"f{n}", "s", 0) for n in range(9)], SCHEMA).write.parquet(str(tmp_path / "o"))
    plan = symbol_figures(spark.read.parquet(str(tmp_path / "o")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 2  # rows by (key, group), states by key


def test_shared_folder_is_required_off_one_host():
    from types import SimpleNamespace

    import pytest

    from tracewood.session import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf={}, sparkContext=context))
