import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import recommend, scenarios
from ledgerlens.schema import CELLS, LEDGER_COLUMNS, SourceMissingError, SourceSchemaError
from ledgerlens.scratch import stored
from ledgerlens.sources import grid, ledger as sources, vendor
from ledgerlens.streaming import ingest


def cells(spark, rows):
    out = [("f", sheet, r, c, text) for sheet, lines in rows.items() for r, line in enumerate(lines)
           for c, text in enumerate(line) if text is not None]
    return spark.createDataFrame(out, CELLS)


SHEETS = {
    "FEBUARI 2025": [
        ["PEMAKAIAN  SOLAR rtgc"], ["UNIT", "1", "2", "21", "21", "30", "WEEKS"],
        ["R 1", "10", "12,5", "FULL", "99", "7", "500"], ["UNIT"], ["R 2", "odd", "", None, None, None],
        ["TOTAL", "10"], ["R 3", "77"],
        ["PEMAKAIAN SOLAR KENDARAAN BUS DAN ELF"], ["UNIT", "1"], ["B 1", "5"], ["TOTAL", "5"], ["UNIT"], ["E 1", "6"],
        ["TOTAL", "6"], ["X 1", "9"],
        ["TOTALISATOR"], ["", "1", "2"], ["RTGC", "10", "12,5"], ["TOTAL", "21"]],
    "REKAP": [["PEMAKAIAN SOLAR RTGC"], ["UNIT", "1"], ["R 1", "1"]],
    "MARET 2025": [["nothing here"]],
}


def test_grid(spark):
    found = grid.read_grid(cells(spark, SHEETS))
    rows = {(r.equipment_category, r.equipment_id, str(r.date) if r.date else None): (r.fuel_liter, r.status_text)
            for r in found.ledger.collect()}
    assert rows == {
        ("RTGC", "R 1", "2025-02-01"): (10.0, None), ("RTGC", "R 1", "2025-02-02"): (12.5, None),
        ("RTGC", "R 1", "2025-02-21"): (None, "FULL"), ("RTGC", "R 1", None): (7.0, None),
        ("RTGC", "R 2", "2025-02-01"): (None, "ODD"), ("BUS", "B 1", "2025-02-01"): (5.0, None),
        ("ELF", "E 1", "2025-02-01"): (6.0, None)}
    assert {(r.category_label, r.day, r.workbook_value) for r in found.totals.collect()} == {
        ("RTGC", 1, 10.0), ("GRAND_TOTAL", 1, 21.0)}
    assert [(r.day, r.dropped_col) for r in found.header_anomalies.collect()] == [(21, 4)]
    assert {(r.sheet, r.reason) for r in found.skipped_sheets.collect()} == {
        ("REKAP", "no month"), ("MARET 2025", "no section")}
    assert found.ledger.columns == LEDGER_COLUMNS


def test_vendor_report(spark):
    report = spark.createDataFrame([("HT 1", "2025-01-02", "1,234.5", "online"), ("9", "bad", "x", "online")],
                                   "Unit string, ` DATE` string, `Volume (L)` string, status string")
    rows = vendor.vendor_ledger(report).orderBy("source_row").collect()
    assert rows[0].fuel_liter == 1234.5 and rows[0].equipment_category == "HEAD_TRUCK" and rows[0].data_status == "VALID"
    assert rows[1].date is None and rows[1].issue_code == "MISSING_VOLUME"
    with pytest.raises(SourceSchemaError):
        vendor.vendor_ledger(report.drop("Unit"))


def test_vendor_rows_without_numbers_are_numbered(spark):
    report = spark.range(0, 1000, 1, 7).selectExpr("'2024-01-01' Date", "'FRK 01' Unit", "cast(id as string) Volume")
    rows = vendor.vendor_ledger(report).select("source_row", "fuel_liter").orderBy("source_row").collect()
    assert [(r.source_row, r.fuel_liter) for r in rows] == [(i + 1, float(i)) for i in range(1000)]


def test_vendor_csv_errors(spark, tmp_path):
    with pytest.raises(SourceMissingError):
        vendor.read_vendor_csv(spark, str(tmp_path / "none"))
    (tmp_path / "bad.csv").write_text("date,year\n2025-01-01,2025\n")
    with pytest.raises(SourceSchemaError):
        vendor.read_vendor_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "empty.csv").write_text(",".join(LEDGER_COLUMNS) + "\n")
    with pytest.raises(SourceMissingError):
        vendor.read_vendor_csv(spark, str(tmp_path / "empty.csv"))


def test_forecast_scan(spark, tmp_path):
    with pytest.raises(SourceMissingError):
        sources.read_forecasts(spark, str(tmp_path / "none"))
    (tmp_path / "f.csv").write_text("date,actual_fuel\n2025-01-01,3\n")
    with pytest.raises(SourceSchemaError):
        sources.read_forecasts(spark, str(tmp_path / "f.csv"))
    series = spark.sql("SELECT 'ALL' series_key, date_add(date'2025-01-01', cast(id as int)) date, cast(id as double) y FROM range(20)")
    assert sources.read_forecasts(spark, str(tmp_path / "none"), series).count() == 13


def test_source_modes(ledger):
    rows = ledger([("2025-01-01", "A", "u", 1)])
    assert sources.combine_sources("hybrid", rows, None).count() == 1
    assert sources.combine_sources("hybrid", rows, rows).count() == 2
    assert sources.combine_sources("vendor", rows, rows).count() == 1
    with pytest.raises(SourceMissingError):
        sources.combine_sources("vendor", rows, None)


def test_sinks(spark, daily, tmp_path):
    rows = daily({("A", "u"): range(40)}).withColumn("tags", F.array(F.lit("x")))
    paths = sources.save_tables({"rows": rows}, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(paths["rows"]).count() == 40
    path = sources.save_ledger(rows, str(tmp_path))
    plan = spark.read.parquet(path).where("year = 2024 AND month = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and spark.read.parquet(path).where("month = 2").count() == 9


def test_scenarios(spark):
    totals = spark.createDataFrame([(1_000_000.0,)], "baseline_total double")
    from ledgerlens.config import LedgerConfig
    cfg = LedgerConfig(saving_target_pct=10.0, price_per_unit=2.0)
    rows = {r.scenario: r for r in scenarios.saving_scenarios(totals, cfg=cfg).collect()}
    bau, target = rows["Business as Usual"], rows["Target Saving"]
    assert bau.saving_liter == 0 and bau.gap_to_target_liter == 100_000
    assert target.target_achievement_percentage == 100 and target.gap_to_target_liter == 0
    assert target.projected_cost == 1_800_000 and rows["Moderate Saving"].saving_liter == 50_000
    assert bau.required_monthly_reduction == 8333.3 and bau.required_daily_reduction == 273.97
    assert [r.priority for r in recommend.over_budget(scenarios.saving_scenarios(totals, cfg=cfg)).collect()] == ["HIGH"]


def test_efficiency(spark):
    totals = spark.createDataFrame([(1_000_000.0, 400_000.0), (1_000_000.0, None)], "baseline_total double, t double")
    rows = scenarios.efficiency(totals, F.col("t")).collect()
    assert rows[0].actual_l_per_teu == 2.5 and rows[0].meets_target
    assert rows[1].actual_l_per_teu is None and rows[1].throughput_missing


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("""SELECT timestamp'2025-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) ts, concat('c', id % 3)
        equipment_category, cast(id as double) fuel_liter, 's' source_sheet, 'f' source_file, id source_row FROM range(120)""")
    rows.write.parquet(f"{tmp_path}/in/a")

    def stream():
        return spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")

    ingest.ingest(stream().unionByName(stream()), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 120
    for _ in range(2):  # the second run finds nothing new
        ingest.maintain_totals(stream(), f"{tmp_path}/totals", f"{tmp_path}/c2").awaitTermination()
    got = ingest.current_totals(spark.read.parquet(f"{tmp_path}/totals"))
    want = rows.groupBy(F.to_date("ts").alias("date"), "equipment_category").agg(
        F.sum("fuel_liter").alias("fuel_liter"), F.count("*").alias("n_records"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_new_checkpoint_over_old_totals(spark, tmp_path):
    """Totals of a new checkpoint win over stored ones, compaction leaves one version, and batches after it win again."""
    def arrive(name, amount):
        spark.sql(f"""SELECT timestamp'2025-01-01' ts, 'c' equipment_category, {amount}D fuel_liter, 's' source_sheet, 'f' source_file,
            id source_row FROM range(3)""").write.parquet(f"{tmp_path}/in/{name}")

    arrive("a", 1)
    schema = spark.read.parquet(f"{tmp_path}/in/a").schema

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        ingest.maintain_totals(stream, f"{tmp_path}/totals", f"{tmp_path}/{checkpoint}").awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/totals")
        return ingest.current_totals(rows).first().fuel_liter, rows.select("version").distinct().count()

    assert run("c1")[0] == 3.0
    arrive("b", 10)
    assert run("c1")[0] == 33.0
    arrive("c", 100)
    before = run("c2")  # reads all from the start, in a checkpoint of its own
    assert before[0] == 333.0 and before[1] > 1
    ingest.compact_totals(spark, f"{tmp_path}/totals", f"{tmp_path}/c2")
    assert run("c2") == (333.0, 1)
    arrive("d", 1000)
    assert run("c2")[0] == 3333.0
    assert run("c3")[0] == 3333.0


def test_header_cells_meet_sections_by_row(spark):
    """The few header cells are written before their texts are read, and the small tables are known to be small."""
    cells = stored(spark.createDataFrame(
        [("f", "Mei 2024", r, c, t) for r, c, t in [
            (0, 0, "PEMAKAIAN SOLAR RTGC"), (1, 0, "UNIT"), (1, 1, "1"), (1, 2, "1"), (2, 0, "U1"), (2, 1, "5"), (3, 0, "TOTAL"),
            (4, 0, "PEMAKAIAN SOLAR HEADTRUCK"), (5, 0, "UNIT"), (5, 1, "7"), (6, 0, "U2"), (6, 1, "3"), (7, 0, "TOTAL")]],
        CELLS))
    sections = stored(grid.find_sections(cells))
    titles = cells.select(grid.section_label(F.col("text")).alias("label"))
    assert titles._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    days = grid.header_days(cells, sections)
    assert "Join" not in days._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.title_row, r.col, r.day, r.nth) for r in days.collect()) == [(0, 1, 1, 1), (0, 2, 1, 2), (4, 1, 7, 1)]
    monthly = grid.sheet_calendar(cells).where("is_monthly")
    assert "Aggregate" not in monthly._jdf.queryExecution().optimizedPlan().toString()
    found = grid.read_grid(cells)
    assert found.header_anomalies.count() == 1
    assert found.header_anomalies._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20
