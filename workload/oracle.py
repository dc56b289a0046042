"""The same results in DuckDB SQL, written independently of the Spark code."""

from __future__ import annotations

from ledgerlens import fixed_values as fv

K = "equipment_category, equipment_id"
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
RECURSIVE: set[str] = set()
ORACLE: dict[str, str] = {}


def cte(name: str, needs: str, text: str, recursive: bool = False) -> None:
    CTES[name] = (tuple(needs.split()), text)
    if recursive:
        RECURSIVE.add(name)


def _with(needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for name in needs.split():
        visit(name)
    return ("WITH RECURSIVE " if RECURSIVE & set(order) else "WITH ") + ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order) + "\n" if order else ""


def rounded(value: str, digits: int) -> str:
    """A double rounded half up in its shortest decimal form, as Spark rounds."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 17)), {digits}) AS DOUBLE)"


def oracle(name: str, needs: str, select: str, doubles: str = "", digits: int = 4) -> None:
    """Register a query; the named double columns are rounded for comparison."""
    if doubles:
        replaced = ", ".join(f"{rounded(c, digits)} + 0.0::DOUBLE AS {c}" for c in doubles.split())
        select = f"SELECT * REPLACE ({replaced}) FROM ({select}) AS result"
    ORACLE[name] = _with(needs) + select


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case(column: str, table: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {text(k) if isinstance(k, str) else k} THEN {text(v) if isinstance(v, str) else v}"
                     for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


# --- ledgers -------------------------------------------------------------------------------------

def ledger(date: str, category: str, unit: str, amount: str, file: str, row: str, source: str,
           status: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"""SELECT {date} AS date, CAST(year({date}) AS INTEGER) AS year, CAST(month({date}) AS INTEGER) AS month,
      {category} AS equipment_category, {unit} AS equipment_id, {amount} AS fuel_liter, {status} AS status_text,
      strftime({date}, '%Y-%m') AS source_sheet, '{file}' AS source_file, CAST({row} AS BIGINT) AS source_row
    FROM {source}"""


LINE_ROW = "l_orderkey * 10 + l_linenumber"
cte("lines", "", ledger("CAST(l_shipdate AS DATE)", "l_returnflag", "CAST(l_suppkey AS VARCHAR)", "l_quantity",
                        "lineitem", LINE_ROW, "lineitem"))
cte("supp", "", ledger("CAST(l_shipdate AS DATE)", "CAST(l_suppkey AS VARCHAR)", "l_returnflag", "l_quantity",
                       "lineitem", LINE_ROW, "lineitem"))
cte("ev", "", ledger("CAST(ts AS DATE)", "event_type", "CAST(user_id AS VARCHAR)", "value", "events", "event_id",
                     "events"))
cte("cells", "", """SELECT event_id, CASE WHEN k < 97 THEN CAST(ts AS DATE) END AS date,
      event_type AS equipment_category,
      CASE WHEN k < 30 THEN 'U ' || user_id WHEN k < 60 THEN ' U  ' || user_id || ' / old 1'
           WHEN k < 90 THEN 'u-' || user_id ELSE 'U' || user_id END AS equipment_id,
      CASE WHEN k < 8 THEN '' WHEN k < 16 THEN ' full' WHEN k < 20 THEN 'in  shop'
           WHEN k < 40 THEN replace(CAST(value AS VARCHAR), '.', ',') WHEN k < 45 THEN '-' || CAST(value AS VARCHAR)
           ELSE CAST(value AS VARCHAR) END AS text
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
KNOWN = ", ".join(text(t) for t in fv.STATUS_TOKENS)
cte("classed", "cells", f"""SELECT *,
      CASE WHEN word NOT IN ({KNOWN}) THEN TRY_CAST(replace(trim(text), ',', '.') AS DOUBLE) END AS amount
    FROM (SELECT *, upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS word FROM cells)""")
cte("mixed", "classed", ledger("date", "equipment_category", "equipment_id", "amount", "cells", "event_id", "classed",
                               "CASE WHEN word <> '' AND amount IS NULL THEN word END"))
cte("spiked", "lines", """SELECT * REPLACE (CASE WHEN source_row // 10 % 101 = 0 AND source_row % 10 = 1
    THEN fuel_liter * 40 ELSE fuel_liter END AS fuel_liter) FROM lines""")
cte("planted", "", ledger("month", "CAST(l_suppkey % 3 AS VARCHAR)", "CAST(l_suppkey AS VARCHAR)",
                          "CASE WHEN number >= 20 + l_suppkey % 40 THEN used * 10 ELSE used END", "planted",
                          "l_suppkey * 1000 + number", """(SELECT *, year(month) * 12 + month(month) - 1995 * 12 AS number FROM (
      SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_suppkey, sum(l_quantity) AS used FROM lineitem
      GROUP BY ALL))"""))
cte("sales", "", ledger("CAST(o_orderdate AS DATE)", "c_mktsegment", "CAST(l_suppkey AS VARCHAR)", "l_extendedprice",
                        "lineitem", LINE_ROW,
                        "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"))


def limits(source: str) -> str:
    return f"""SELECT equipment_category, q1, q3, n_values, q3 + 3.0 * (q3 - q1) AS high_limit FROM (
      SELECT equipment_category, quantile_cont(fuel_liter, 0.25) AS q1, quantile_cont(fuel_liter, 0.75) AS q3,
        count(fuel_liter) AS n_values
      FROM {source} WHERE date IS NOT NULL GROUP BY equipment_category) WHERE n_values >= 10"""


def cleaned(source: str) -> str:
    status = f"""CASE WHEN date IS NULL THEN 'INVALID_DATE' WHEN fuel_liter < 0 THEN 'NEGATIVE_VALUE'
        WHEN copies > 1 THEN 'DUPLICATE' WHEN fuel_liter > high_limit THEN 'UNUSUALLY_HIGH'
        WHEN status_text IS NOT NULL AND status_text NOT IN ({KNOWN}) THEN 'UNKNOWN_STATUS'
        WHEN fuel_liter IS NULL AND status_text IS NOT NULL THEN 'STATUS_ONLY'
        WHEN fuel_liter IS NULL THEN 'MISSING' ELSE 'VALID' END"""
    return f"""SELECT date, year, month, equipment_category, equipment_id, fuel_liter, status_text, source_sheet,
        source_file, source_row, data_status, {case('data_status', fv.ISSUE_CODES)} AS issue_code
      FROM (SELECT *, {status} AS data_status FROM (
        SELECT s.*, count(*) OVER (PARTITION BY date, s.equipment_category, equipment_id) AS copies, high_limit
        FROM {source}_std s LEFT JOIN {source}_lim l ON s.equipment_category = l.equipment_category))"""


for _source in ("lines", "supp", "ev", "mixed", "sales", "planted", "spiked"):
    cte(f"{_source}_std", _source, f"""SELECT * REPLACE (trim(regexp_replace(split_part(equipment_id, '/', 1),
        '\\s+', ' ', 'g')) AS equipment_id) FROM {_source}""")
    cte(f"{_source}_lim", f"{_source}_std", limits(f"{_source}_std"))
    cte(f"{_source}_clean", f"{_source}_std {_source}_lim", cleaned(_source))
    cte(f"{_source}_dated", f"{_source}_clean", f"SELECT * FROM {_source}_clean WHERE data_status <> 'INVALID_DATE'")
    cte(f"{_source}_used", f"{_source}_clean",
        f"SELECT * FROM {_source}_clean WHERE data_status IN ('VALID', 'UNUSUALLY_HIGH')")

# --- sources -------------------------------------------------------------------------------------

LEDGER = ("date, year, month, equipment_category, equipment_id, fuel_liter, status_text, source_sheet, source_file, "
          "source_row")
cte("vendor", "", f"""SELECT CAST(ts AS DATE) AS date, CAST(year(ts) AS INTEGER) AS year,
      CAST(month(ts) AS INTEGER) AS month,
      CASE event_type WHEN 'click' THEN 'HEAD_TRUCK' WHEN 'view' THEN 'BUS' WHEN 'error' THEN CAST(user_id AS VARCHAR)
        ELSE upper(event_type) END AS equipment_category,
      CAST(user_id AS VARCHAR) AS equipment_id, round(value * 1000, 2) AS fuel_liter, 'online' AS status_text,
      'N/A' AS source_sheet, 'vendor_report' AS source_file, event_id + 1 AS source_row, 'VALID' AS data_status,
      '' AS issue_code FROM events""")
oracle("i1_vendor_csv_scan", "vendor", f"SELECT {LEDGER} FROM vendor", "fuel_liter")
oracle("i2_vendor_report", "vendor", "SELECT * FROM vendor", "fuel_liter")
oracle("i3_unit_split", "vendor", "SELECT source_row - 1 AS event_id, equipment_category, equipment_id FROM vendor")
oracle("i4_sheet_names", "", """SELECT o_orderkey,
    CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(month(o_orderdate) AS INTEGER) END AS month,
    CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders""")

_months = {}
for _word, _at in fv.SHEET_MONTHS.items():
    _months.setdefault(_at, _word)
cte("used_days", "", f"""SELECT CAST(l_shipdate AS DATE) AS date, year(l_shipdate) AS y, month(l_shipdate) AS m,
      CASE WHEN l_returnflag = 'A' THEN 'RTGC' WHEN l_returnflag = 'N' THEN 'HEAD_TRUCK'
           WHEN s_nationkey < 13 THEN 'BUS' ELSE 'ELF' END AS equipment_category,
      'S ' || l_suppkey AS equipment_id, sum(l_quantity) AS fuel_liter,
      {case('month(l_shipdate)', _months)} || ' ' || year(l_shipdate) AS source_sheet,
      'report_' || year(l_shipdate) AS source_file
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
oracle("i4_skipped_sheets", "used_days",
       "SELECT DISTINCT source_file AS file, 'CATATAN' AS sheet, 'no month' AS reason FROM used_days")
_groups = ", ".join(f"""count(DISTINCT equipment_id) FILTER (equipment_category = '{c}') AS n{i},
      count(*) FILTER (equipment_category = '{c}') AS c{i}""" for i, c in enumerate(("RTGC", "HEAD_TRUCK", "BUS", "ELF"), start=1))
cte("laid_out", "used_days", f"""SELECT source_file AS file, source_sheet AS sheet, any_value(CAST(y AS INTEGER)) AS year,
      any_value(CAST(m AS INTEGER)) AS month, {_groups}, count(DISTINCT (date, equipment_category)) AS sums,
      count(DISTINCT date) AS days FROM used_days GROUP BY 1, 2""")
oracle("i5_sections", "laid_out", """SELECT file, sheet, CAST(title_row AS INTEGER) AS title_row, label, CAST(end_row AS INTEGER) AS end_row,
    year, month, CAST(end_row - title_row + 33 + filled AS BIGINT) AS n_cells FROM (
      SELECT file, sheet, year, month, 0 AS title_row, n1 + 4 AS end_row, 'RTGC' AS label, c1 AS filled FROM laid_out
      UNION ALL SELECT file, sheet, year, month, n1 + 4, n1 + n2 + 7, 'HEAD_TRUCK', c2 FROM laid_out
      UNION ALL SELECT file, sheet, year, month, n1 + n2 + 7, n1 + n2 + n3 + n4 + 12, 'BUS_ELF', c3 + c4 FROM laid_out
      UNION ALL SELECT file, sheet, year, month, n1 + n2 + n3 + n4 + 12, n1 + n2 + n3 + n4 + 19, '__TOTALS__', sums + days
      FROM laid_out)""")
oracle("i6_header_days", "used_days", """SELECT DISTINCT source_file AS file, source_sheet, 21 AS day, 33 AS dropped_col,
    CAST(4 AS BIGINT) AS n_headers FROM used_days""")
oracle("i7_cell_classes", "classed", """SELECT event_id, amount AS fuel_liter,
    CASE WHEN word <> '' AND amount IS NULL THEN word END AS status_text FROM classed""", "fuel_liter")
oracle("i8_grid_unpivot", "used_days", """SELECT date, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month,
    equipment_category, equipment_id, fuel_liter, CAST(NULL AS VARCHAR) AS status_text, source_sheet, source_file
    FROM used_days WHERE equipment_category IN ('RTGC', 'HEAD_TRUCK')""", "fuel_liter")
oracle("i9_stacked_blocks", "used_days", f"""SELECT date, {K}, fuel_liter FROM used_days
    WHERE equipment_category IN ('BUS', 'ELF')""", "fuel_liter")
oracle("i10_control_totals", "used_days", """SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month,
    CAST(day(date) AS INTEGER) AS day,
    coalesce(CASE equipment_category WHEN 'HEAD_TRUCK' THEN 'HEAD TRUCK' ELSE equipment_category END, 'GRAND_TOTAL')
      AS category_label, sum(fuel_liter) AS workbook_value, source_file, date
    FROM used_days GROUP BY GROUPING SETS ((y, m, date, source_file, equipment_category), (y, m, date, source_file))
    """, "workbook_value")
oracle("i11_grid_ledger", "used_days", """SELECT source_file, equipment_category,
      CASE WHEN fuel_liter > q3 + 3 * (q3 - q1) THEN 'UNUSUALLY_HIGH' ELSE 'VALID' END AS data_status,
      count(*) AS n, sum(fuel_liter) AS total
    FROM used_days JOIN (SELECT equipment_category, quantile_cont(fuel_liter, 0.25) AS q1,
      quantile_cont(fuel_liter, 0.75) AS q3 FROM used_days GROUP BY 1) USING (equipment_category)
    GROUP BY 1, 2, 3""", "total")
oracle("i12_hybrid_sources", "lines vendor", """SELECT source_file, equipment_category, count(*) AS n,
    sum(fuel_liter) AS total FROM (SELECT source_file, equipment_category, fuel_liter FROM lines
      UNION ALL SELECT source_file, equipment_category, fuel_liter FROM vendor) GROUP BY 1, 2""", "total")
oracle("i14_partitioned_sink", "lines", """SELECT year, month, count(*) AS n, sum(fuel_liter) AS total FROM lines
    GROUP BY 1, 2""", "total")

# --- cleaning ------------------------------------------------------------------------------------

oracle("c1_unit_names", "cells", """SELECT event_id, trim(regexp_replace(split_part(equipment_id, '/', 1), '\\s+', ' ',
    'g')) AS unit_name FROM cells""")
oracle("c2_match_keys", "cells", """SELECT event_id, upper(regexp_replace(split_part(equipment_id, '/', 1),
    '[^A-Za-z0-9]', '', 'g')) AS match_key FROM cells""")
oracle("c3_high_limits", "mixed_lim", "SELECT * FROM mixed_lim", "q1 q3 high_limit")
oracle("c4_repeated_keys", "mixed_std", f"""SELECT date, {K}, count(*) AS n_copies FROM mixed_std
    WHERE date IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
oracle("c5_flags", "mixed_clean", f"""SELECT data_status, count(*) FILTER (date IS NULL) AS n_no_date,
    count(*) FILTER (fuel_liter < 0) AS n_negative, count(*) FILTER (status_text NOT IN ({KNOWN})) AS n_unknown
    FROM mixed_clean GROUP BY 1""")
oracle("c6_row_status", "mixed_clean", "SELECT source_row, data_status, issue_code FROM mixed_clean")
oracle("c7_cleaned_ledger", "mixed_clean", "SELECT * FROM mixed_clean", "fuel_liter")
oracle("c7_cleaned_lines", "lines_clean", "SELECT * FROM lines_clean", "fuel_liter")
cte("keyed", "mixed_dated", f"""SELECT *, upper(regexp_replace(equipment_id, '[^A-Za-z0-9]', '', 'g')) AS match_key
    FROM (SELECT DISTINCT {K} FROM mixed_dated)""")
oracle("c8_unit_master", "mixed_dated keyed", f"""SELECT u.equipment_category, u.equipment_id, first_seen_date,
      last_seen_date, n_records, n_valid_liter_records,
      n_spellings - 1 AS n_variants, n_spellings > 1 AS has_possible_variant, month(first_seen_date) > 1 AS is_new_after_january
    FROM (SELECT *, count(*) OVER (PARTITION BY equipment_category, match_key) AS n_spellings FROM keyed) u
    JOIN (SELECT {K}, min(date) AS first_seen_date, max(date) AS last_seen_date, count(date) AS n_records,
            count(fuel_liter) AS n_valid_liter_records FROM mixed_dated GROUP BY ALL) r
      ON u.equipment_category = r.equipment_category AND u.equipment_id = r.equipment_id""")
oracle("c8_variant_members", "keyed", """SELECT equipment_category, match_key, equipment_id, n_spellings FROM
    (SELECT *, count(*) OVER (PARTITION BY equipment_category, match_key) AS n_spellings FROM keyed)
    WHERE n_spellings > 1""")
oracle("c9_issue_report", "mixed_clean", f"""SELECT issue_code, data_status, count(equipment_id) AS n_occurrences,
      count(DISTINCT equipment_id) AS n_equipment_affected,
      first(equipment_id ORDER BY {K}, date NULLS FIRST, source_file, source_row) AS example_equipment_id,
      first(source_sheet ORDER BY {K}, date NULLS FIRST, source_file, source_row) AS example_source_sheet,
      first(source_row ORDER BY {K}, date NULLS FIRST, source_file, source_row) AS example_source_row,
      {case('issue_code', fv.ISSUE_TEXTS)} AS description
    FROM mixed_clean WHERE issue_code IS NOT NULL GROUP BY issue_code, data_status""")

# --- quality and reconciliation ------------------------------------------------------------------

oracle("d1_missing_days", "lines_dated", f"""SELECT CAST(day AS DATE) AS date, '{fv.MISSING_DAY}' AS issue
    FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM lines_dated)
    WHERE CAST(day AS DATE) NOT IN (SELECT date FROM lines_dated)""")


# The first planted row, put at the end of 9999, leaves its own month to the other units.
oracle("d1_missing_runs", "planted_dated", """SELECT CAST(date + 1 AS DATE) AS first_day, CAST(following - 1 AS DATE) AS last_day,
    CAST(following - date - 1 AS INTEGER) AS n_days FROM (SELECT date, lead(date) OVER (ORDER BY date) AS following FROM
      (SELECT DISTINCT date FROM planted_dated UNION SELECT DATE '9999-12-31')) WHERE following - date > 1""")


def gaps(source: str) -> str:
    return f"""SELECT {K}, longest_gap_start, longest_gap_end, longest_gap_days, active_range_start, active_range_end
    FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY longest_gap_days DESC, longest_gap_start) AS rn
      FROM (SELECT *, CAST(before + 1 AS DATE) AS longest_gap_start, CAST(date - 1 AS DATE) AS longest_gap_end,
              CAST(date - before - 1 AS INTEGER) AS longest_gap_days
        FROM (SELECT *, lag(date) OVER (PARTITION BY {K} ORDER BY date) AS before,
                min(date) OVER (PARTITION BY {K}) AS active_range_start,
                max(date) OVER (PARTITION BY {K}) AS active_range_end
          FROM (SELECT DISTINCT {K}, date FROM {source}_dated))) WHERE longest_gap_days >= 14) WHERE rn = 1"""


cte("lines_gaps", "lines_dated", gaps("lines"))
cte("mixed_gaps", "mixed_dated", gaps("mixed"))
oracle("d2_longest_gaps", "lines_gaps", "SELECT * FROM lines_gaps")
oracle("u17_top_gaps", "lines_gaps", f"SELECT * FROM lines_gaps ORDER BY longest_gap_days DESC, {K} LIMIT 20")


def state(pct: str) -> str:
    return f"""CASE WHEN abs({pct}) < 0.5 THEN 'MATCH' WHEN abs({pct}) < 3 THEN 'MINOR DIFFERENCE'
      WHEN abs({pct}) < 10 THEN 'MAJOR DIFFERENCE' ELSE 'REQUIRES REVIEW' END"""


def compared(keys: str, recomputed: str, reported: str, how: str) -> str:
    return f"""SELECT *, {case('month', fv.MONTH_NAMES)} || ' ' || year AS month_name,
        recalculated_total - workbook_reported_total AS difference_liter,
        round_even((recalculated_total - workbook_reported_total) / nullif(workbook_reported_total, 0) * 100, 2)
          AS difference_percentage
      FROM ({recomputed}) {how} JOIN ({reported}) USING ({keys})"""


def monthly(clean: str, totals: str) -> str:
    both = compared("year, month", f"SELECT year, month, sum(fuel_liter) AS recalculated_total FROM {clean} GROUP BY 1, 2",
                    f"""SELECT year, month, sum(workbook_value) AS workbook_reported_total FROM {totals}
                    WHERE category_label = 'GRAND_TOTAL' GROUP BY 1, 2""", "FULL")
    return f"""SELECT year, month, month_name, workbook_reported_total, recalculated_total, difference_liter,
      difference_percentage, {state('difference_percentage')} AS validation_status FROM ({both})"""


def by_category(clean: str, totals: str, label: str) -> str:
    both = compared("year, month, equipment_category",
                    f"""SELECT year, month, equipment_category, sum(fuel_liter) AS recalculated_total FROM {clean}
                    GROUP BY 1, 2, 3""",
                    f"""SELECT year, month, {label} AS equipment_category, sum(workbook_value) AS workbook_reported_total
                    FROM {totals} WHERE {label} IS NOT NULL GROUP BY 1, 2, 3""", "LEFT")
    return f"""SELECT year, month, month_name, equipment_category, workbook_reported_total, recalculated_total,
      difference_liter, difference_percentage,
      CASE WHEN difference_percentage IS NULL THEN 'NO_WORKBOOK_VALUE' ELSE {state('difference_percentage')} END
        AS validation_status FROM ({both})"""


cte("sales_totals", "sales", """SELECT year, month, category_label, sum(workbook_value) AS workbook_value FROM (
      SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
        unnest([CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END,
                'GRAND_TOTAL']) AS category_label, o_totalprice AS workbook_value
      FROM orders JOIN customer ON o_custkey = c_custkey
      UNION ALL SELECT year, month, equipment_category, fuel_liter FROM sales WHERE equipment_category = 'MACHINERY')
    WHERE category_label IS NOT NULL GROUP BY 1, 2, 3""")
NOT_GRAND = "CASE WHEN category_label <> 'GRAND_TOTAL' THEN category_label END"
cte("sales_monthly", "sales sales_totals", monthly("sales", "sales_totals"))
cte("sales_cat", "sales sales_totals", by_category("sales", "sales_totals", NOT_GRAND))
MONEY = "workbook_reported_total recalculated_total difference_liter difference_percentage"
oracle("r1_difference_states", "", f"""SELECT {state('pct')} AS state, count(*) AS n
    FROM (SELECT round(l_tax * 100 + l_discount * 100 - 5, 2) AS pct FROM lineitem) GROUP BY 1""")
oracle("r2_monthly_reconciliation", "sales_monthly", "SELECT * FROM sales_monthly", MONEY, 2)
oracle("r3_category_reconciliation", "sales_cat", "SELECT * FROM sales_cat", MONEY, 2)
PROBLEM = "validation_status IN ('MAJOR DIFFERENCE', 'REQUIRES REVIEW')"
oracle("r4_reconciliation_summary", "sales_monthly sales_cat", f"""SELECT
      count(*) FILTER ({PROBLEM}) AS n_months_with_major_difference,
      string_agg(month_name, ', ' ORDER BY year, month) FILTER ({PROBLEM}) AS months_with_major_difference,
      max(abs(difference_percentage)) AS max_abs_difference_percentage,
      (SELECT count(*) FILTER ({PROBLEM}) FROM sales_cat) AS n_category_months_with_major_difference
    FROM sales_monthly""", "max_abs_difference_percentage", 2)
oracle("u16_by_severity", "sales_cat", """SELECT year, month, equipment_category, validation_status,
    CASE validation_status WHEN 'REQUIRES REVIEW' THEN 0 WHEN 'MAJOR DIFFERENCE' THEN 1 WHEN 'MINOR DIFFERENCE' THEN 2
      WHEN 'MATCH' THEN 3 ELSE 4 END AS severity_rank FROM sales_cat""")
cte("ev_totals", "", """SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
    'GRAND_TOTAL' AS category_label, sum(value) AS workbook_value FROM events GROUP BY 1, 2""")
cte("mixed_monthly", "mixed_dated ev_totals", monthly("mixed_dated", "ev_totals"))
oracle("d3_quality_kpis", "mixed_clean mixed_dated mixed_gaps mixed_monthly", f"""SELECT
      round(complete, 2) AS data_completeness_percentage, round(valid, 2) AS valid_transaction_percentage,
      duplicate_count, missing_equipment_count, invalid_value_count, unusually_high_count, invalid_date_count,
      round(difference, 1) AS monthly_difference_liter_max, n_major AS n_months_major_reconciliation_issue,
      reconciliation_status,
      CASE WHEN valid >= 97 AND complete >= 85 AND reconciliation_status = 'PASS' THEN 'PASS'
           WHEN valid >= 90 AND complete >= 65 AND reconciliation_status <> 'FAILED' THEN 'REVIEW' ELSE 'FAILED' END
        AS overall_status
    FROM (SELECT *, CASE WHEN n_review > 0 THEN 'FAILED' WHEN n_major > 0 THEN 'REVIEW' ELSE 'PASS' END
            AS reconciliation_status FROM
      (SELECT 100.0 * count(*) FILTER (data_status IN ('VALID', 'STATUS_ONLY')) / count(*) AS valid,
        count(*) FILTER (data_status = 'DUPLICATE') AS duplicate_count,
        count(*) FILTER (trim(equipment_id) = '') AS missing_equipment_count,
        count(*) FILTER (data_status IN ('NEGATIVE_VALUE', 'UNKNOWN_STATUS')) AS invalid_value_count,
        count(*) FILTER (data_status = 'UNUSUALLY_HIGH') AS unusually_high_count,
        count(*) FILTER (data_status = 'INVALID_DATE') AS invalid_date_count FROM mixed_clean),
      (SELECT 100.0 * (1 - (SELECT count(*) FROM mixed_gaps) / count(*)) AS complete
        FROM (SELECT DISTINCT {K} FROM mixed_dated)),
      (SELECT max(abs(difference_liter)) AS difference, count(*) FILTER ({PROBLEM}) AS n_major,
        count(*) FILTER (validation_status = 'REQUIRES REVIEW') AS n_review FROM mixed_monthly))""")

# --- features and anomalies ----------------------------------------------------------------------


def feature(source: str) -> str:
    w = f"PARTITION BY {K} ORDER BY date, source_file, source_row"

    def full(n: int, value: str) -> str:
        frame = f"({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        return f"CASE WHEN count(fuel_liter) OVER {frame} = {n} THEN {value} OVER {frame} END"

    return f"""SELECT *, fuel_liter - lag_1 AS difference_1, (fuel_liter - lag_1) / nullif(lag_1, 0) * 100 AS percentage_change,
        fuel_liter - equipment_mean AS deviation_from_equipment_mean,
        fuel_liter - category_median AS deviation_from_category_median, n_observations >= 14 AS sufficient
      FROM (SELECT *, lag(fuel_liter, 1) OVER ({w}) AS lag_1, lag(fuel_liter, 7) OVER ({w}) AS lag_7,
        {full(7, 'avg(fuel_liter)')} AS rolling_mean_7, {full(14, 'avg(fuel_liter)')} AS rolling_mean_14,
        {full(30, 'avg(fuel_liter)')} AS rolling_mean_30, {full(7, 'quantile_cont(fuel_liter, 0.5)')} AS rolling_median_7,
        {full(7, 'stddev_pop(fuel_liter)')} AS rolling_std_7, {full(7, 'mad(fuel_liter)')} AS rolling_mad_7,
        CASE WHEN count(*) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2
          THEN avg(fuel_liter) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS equipment_mean,
        count(*) OVER (PARTITION BY {K}) AS n_observations,
        CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month_num
      FROM {source}_used) JOIN (SELECT equipment_category, median(fuel_liter) AS category_median FROM {source}_used GROUP BY 1)
        USING (equipment_category)"""


def report(source: str) -> str:
    texts = fv.ANOMALY_TEXTS
    signs = {
        "UNUSUAL_ZERO_FILL": "fuel_liter = 0", "HIGH_VS_OWN_PATTERN": "z > 0", "LOW_VS_OWN_PATTERN": "z < 0",
        "SPIKE_VS_PREVIOUS": "abs(percentage_change) >= 100",
        "EXTREME_VS_CATEGORY_PEERS": "category_median > 0 AND abs(deviation_from_category_median) >= category_median",
    }

    def joined(separator: str, shown) -> str:
        parts = ", ".join(f"CASE WHEN {c} THEN {text(shown(n))} END" for n, c in signs.items())
        return f"""CASE WHEN severity = 'NORMAL' THEN {text(shown('NORMAL'))}
          WHEN concat_ws('{separator}', {parts}) = '' THEN {text(shown('STATISTICAL_DEVIATION'))}
          ELSE concat_ws('{separator}', {parts}) END"""

    few = text(fv.TOO_FEW_TEXT.replace("%d", "{}", 1).replace("%d", "14"))
    return f"""SELECT date, equipment_id, equipment_category, fuel_liter, expected_fuel,
        fuel_liter - expected_fuel AS deviation_liter,
        (fuel_liter - expected_fuel) / nullif(expected_fuel, 0) * 100 AS deviation_percentage, z AS robust_z_score,
        CASE WHEN sufficient THEN {joined('|', lambda n: n)} ELSE 'INSUFFICIENT_DATA' END AS anomaly_type, severity,
        CASE WHEN sufficient THEN {joined(' ', texts.get)} ELSE replace({few}, '{{}}', CAST(n_observations AS VARCHAR)) END
          AS anomaly_reason
      FROM (SELECT *, CASE WHEN NOT sufficient THEN 'INSUFFICIENT_DATA' WHEN abs(z) >= 6 THEN 'CRITICAL'
          WHEN abs(z) >= 4 THEN 'HIGH' WHEN abs(z) >= 3 THEN 'MEDIUM' WHEN abs(z) >= 2 THEN 'LOW' ELSE 'NORMAL' END
          AS severity
        FROM (SELECT *, coalesce(rolling_median_7, equipment_mean) AS expected_fuel,
            CASE WHEN sufficient THEN 0.6744897501960817 * (fuel_liter - rolling_median_7) /
              nullif(CASE WHEN rolling_mad_7 > abs(0.1 * rolling_mean_7) THEN rolling_mad_7
                ELSE abs(0.1 * rolling_mean_7) END, 0) END AS z
          FROM {source}_feat))"""


for _source in ("lines", "ev"):
    cte(f"{_source}_feat", f"{_source}_used", feature(_source))
    cte(f"{_source}_report", f"{_source}_feat", report(_source))

cte("spiked_feat", "spiked_used", feature("spiked"))
# 30 complete rows make a forest.
oracle("a2_planted_outliers", "spiked_feat", f"""SELECT {K}, date, fuel_liter, true AS found FROM
    (SELECT *, count(*) OVER (PARTITION BY equipment_category) AS n FROM spiked_feat
     WHERE sufficient AND deviation_from_category_median IS NOT NULL)
    WHERE n >= 30 AND source_row // 10 % 101 = 0 AND source_row % 10 = 1""")
oracle("a2_contamination_share", "lines_feat", """SELECT equipment_category, CASE WHEN n >= 30 THEN n ELSE 0 END AS n_scored,
    true AS at_share FROM (SELECT equipment_category, count(*) FILTER (sufficient AND deviation_from_category_median IS NOT NULL) AS n
    FROM lines_feat GROUP BY 1)""")

FEATURES = {
    "w1_lags": "lag_1 lag_7", "w2_changes": "difference_1 percentage_change",
    "w3_trailing_means": "rolling_mean_7 rolling_mean_14 rolling_mean_30", "w4_trailing_median": "rolling_median_7",
    "w5_trailing_std": "rolling_std_7", "w6_trailing_mad": "rolling_mad_7", "w7_expanding_mean": "equipment_mean",
    "w8_category_median": "category_median",
    "w9_deviations": "deviation_from_equipment_mean deviation_from_category_median",
}
for _name, _columns in FEATURES.items():
    oracle(_name, "lines_feat", f"SELECT {K}, date, {_columns.replace(' ', ', ')} FROM lines_feat", _columns, 8)
oracle("w10_calendar", "lines_feat", f"SELECT {K}, date, day_of_week, month_num FROM lines_feat")
oracle("w11_sufficiency", "lines_feat", f"SELECT {K}, date, n_observations, sufficient FROM lines_feat")
oracle("a1_robust_z", "lines_report", f"SELECT {K}, date, robust_z_score FROM lines_report", "robust_z_score")
oracle("a3_severity", "lines_report", f"SELECT {K}, date, severity FROM lines_report")
oracle("a4_types_and_reasons", "lines_report", f"SELECT {K}, date, anomaly_type, anomaly_reason FROM lines_report")
REPORT = "fuel_liter expected_fuel deviation_liter deviation_percentage robust_z_score"
oracle("a5_anomaly_report", "lines_report", "SELECT * FROM lines_report", REPORT)
oracle("a5_anomaly_report_events", "ev_report", "SELECT * FROM ev_report", REPORT)
oracle("a6_anomaly_summary", "lines_report",
       "SELECT equipment_category, severity, count(*) AS n_records FROM lines_report GROUP BY 1, 2")
oracle("a7_peer_comparison", "ev_dated", f"""SELECT {K}, fuel_liter, peer_mean, peer_std, upper_flag, lower_flag,
      CASE WHEN fuel_liter > upper_flag THEN '{fv.PEER_HIGH}' WHEN fuel_liter < lower_flag AND fuel_liter > 0
        THEN '{fv.PEER_LOW}' WHEN fuel_liter = 0 THEN '{fv.PEER_NONE}' ELSE '{fv.PEER_NORMAL}' END AS status
    FROM (SELECT *, peer_mean + 2 * peer_std AS upper_flag, greatest(0, peer_mean - 2 * peer_std) AS lower_flag
      FROM (SELECT *, avg(fuel_liter) OVER (PARTITION BY equipment_category) AS peer_mean,
          coalesce(stddev_samp(fuel_liter) OVER (PARTITION BY equipment_category), 0) AS peer_std,
          sum(fuel_liter) OVER (PARTITION BY equipment_category) AS everything
        FROM (SELECT {K}, coalesce(sum(fuel_liter) FILTER (date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'), 0)
            AS fuel_liter FROM ev_dated GROUP BY ALL)) WHERE everything <> 0)""",
       "fuel_liter peer_mean peer_std upper_flag lower_flag")

# --- change points -------------------------------------------------------------------------------

W = f"PARTITION BY {K} ORDER BY position ROWS BETWEEN"


def series(source: str) -> str:
    return f"""SELECT {K}, date, fuel_liter, CAST(row_number() OVER (PARTITION BY {K} ORDER BY date)
    - 1 AS INTEGER) AS position, count(*) OVER (PARTITION BY {K}) AS n_observations FROM {source}_used"""


def shift_ratio(source: str) -> str:
    return f"""SELECT *, CASE WHEN count(*) OVER ({W} 7 PRECEDING AND 1 PRECEDING) >= 2
            AND count(*) OVER ({W} CURRENT ROW AND 6 FOLLOWING) >= 2
          THEN abs(avg(fuel_liter) OVER ({W} CURRENT ROW AND 6 FOLLOWING)
                 - avg(fuel_liter) OVER ({W} 7 PRECEDING AND 1 PRECEDING))
            / nullif(stddev_pop(fuel_liter) OVER ({W} 7 PRECEDING AND 6 FOLLOWING), 0) END AS ratio
        FROM {source} WHERE n_observations >= 30"""


def change_rows(scan: str) -> str:
    return f"""SELECT {K}, change_date, {rounded('b_mean', 1)} AS before_mean,
      {rounded('a_mean', 1)} AS after_mean, {rounded('b_std', 1)} AS before_std, {rounded('a_std', 1)} AS after_std,
      {rounded('a_mean - b_mean', 1)} AS absolute_change, {rounded('pct', 1)} AS percentage_change, b_n AS n_obs_before, a_n AS n_obs_after,
      CASE WHEN pct >= 15 OR b_mean = 0 THEN CASE WHEN a_mean > b_mean THEN 'INCREASE' ELSE 'DECREASE' END
        WHEN abs(a_std - b_std) / nullif(b_std, 0) * 100 >= 30 OR b_std = 0
          THEN CASE WHEN a_std > b_std THEN 'VOLATILITY_INCREASE' ELSE 'VOLATILITY_DECREASE' END
        ELSE 'MINOR_SHIFT' END AS change_direction,
      CASE WHEN b_n < 5 OR a_n < 5 THEN 'LOW' WHEN coalesce(pct, 0) >= 40 AND confirmed THEN 'HIGH'
        WHEN coalesce(pct, 0) >= 15 OR confirmed THEN 'MEDIUM' ELSE 'LOW' END AS confidence
    FROM (SELECT *, abs(a_mean - b_mean) / nullif(b_mean, 0) * 100 AS pct FROM (
      SELECT *, lag(a_mean) OVER s AS b_mean, lag(a_std) OVER s AS b_std, lag(a_n) OVER s AS b_n FROM (
        SELECT {K}, segment, avg(fuel_liter) AS a_mean, stddev_pop(fuel_liter) AS a_std, count(*) AS a_n,
          min(date) AS change_date, arg_min(confirmed, position) AS confirmed
        FROM (SELECT *, sum(CAST(is_change AS INTEGER)) OVER ({W} UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM {scan})
        GROUP BY {K}, segment) WINDOW s AS (PARTITION BY {K} ORDER BY segment)))
    WHERE segment > 0 AND a_n >= 2 AND b_n >= 2"""


cte("series", "lines_used", series("lines"))
cte("scan", "series", f"""SELECT {K}, date, fuel_liter, position, coalesce(ratio >= 1, false) AS confirmed,
      coalesce(inner_ratio >= 1 AND inner_ratio > coalesce(max(inner_ratio) OVER ({W} 4 PRECEDING AND 1 PRECEDING), -1)
        AND inner_ratio >= coalesce(max(inner_ratio) OVER ({W} 1 FOLLOWING AND 4 FOLLOWING), -1), false) AS is_change
    FROM (SELECT *, CASE WHEN position BETWEEN 5 AND n_observations - 5 THEN ratio END AS inner_ratio
      FROM ({shift_ratio('series')}))""")
cte("changes", "scan", change_rows("scan"))
# The best segmentation by dynamic programming over all segments: cost of each from sums of the kernel over blocks of five.
cte("p_series", "planted_used", series("planted"))
cte("p_units", "p_series", f"SELECT {K}, max(n_observations) AS n FROM p_series WHERE n_observations >= 30 GROUP BY {K}")
cte("p_pairs", "p_series", f"""SELECT {K}, a.position AS i, b.position AS j, (a.fuel_liter - b.fuel_liter) ** 2 AS apart
    FROM p_series a JOIN p_series b USING ({K}) WHERE a.n_observations >= 30""")
cte("p_typical", "p_pairs", f"SELECT {K}, median(apart) AS typical FROM p_pairs WHERE i < j GROUP BY {K}")
cte("p_blocks", "p_pairs p_typical", f"""SELECT {K}, i // 5 AS one, j // 5 AS two, sum(CASE WHEN i = j THEN 1.0::DOUBLE ELSE
      exp(-least(greatest(CASE WHEN typical = 0 THEN apart ELSE apart / typical END, 0.01), 100)) END) AS alike
    FROM p_pairs JOIN p_typical USING ({K}) GROUP BY ALL""")
cte("p_grid", "p_units", f"""SELECT {K}, g, least(g * 5, n) AS pos
    FROM (SELECT *, unnest(range(0, (n + 4) // 5 + 1)) AS g FROM p_units)""")
cte("p_ends", "p_grid p_blocks", f"""SELECT {K}, upto, list(CASE WHEN size >= 5 THEN size - alike / size END ORDER BY start) AS costs
    FROM (SELECT a.equipment_category, a.equipment_id, a.g AS start, b.g AS upto, any_value(b.pos - a.pos) AS size, sum(alike) AS alike
      FROM p_grid a JOIN p_grid b USING ({K}) JOIN p_blocks x USING ({K})
      WHERE a.g < b.g AND one >= a.g AND one < b.g AND two >= a.g AND two < b.g GROUP BY ALL) GROUP BY {K}, upto""")
cte("p_search", "p_units p_ends", f"""SELECT {K}, 0::BIGINT AS upto, [0.0::DOUBLE] AS best, [0::BIGINT] AS came FROM p_units
    UNION ALL
    SELECT {K}, upto, list_append(best, list_min(prices)), list_append(came, list_position(prices, list_min(prices))::BIGINT - 1)
    FROM (SELECT {K}, e.upto, best, came,
        list_transform(costs, lambda c, i: coalesce(best[i] + c + 5, 1e300)) AS prices
      FROM p_search s JOIN p_ends e USING ({K}) WHERE e.upto = s.upto + 1)""", recursive=True)
cte("p_back", "p_search", f"""SELECT {K}, came, came[upto + 1] AS spot FROM
      (SELECT *, max(upto) OVER (PARTITION BY {K}) AS last FROM p_search) WHERE upto = last
    UNION ALL SELECT {K}, came, came[spot + 1] FROM p_back WHERE spot > 0""", recursive=True)
cte("p_scan", "p_series p_back", f"""SELECT s.*, coalesce(ratio >= 1, false) AS confirmed, spot IS NOT NULL AS is_change
    FROM ({shift_ratio('p_series')}) s LEFT JOIN (SELECT {K}, spot, spot * 5 AS position FROM p_back WHERE spot > 0)
    USING ({K}, position)""")
cte("p_changes", "p_scan", change_rows("p_scan"))
oracle("p1_planted_breaks", "p_changes", f"""SELECT {K}, change_date, before_mean, after_mean, absolute_change,
    percentage_change, change_direction, confidence, 'PENDING_REVIEW' AS review_status FROM p_changes""",
       "before_mean after_mean absolute_change percentage_change")
oracle("p2_segment_statistics", "changes", f"""SELECT {K}, change_date, before_mean, after_mean, before_std, after_std,
    absolute_change, percentage_change, n_obs_before, n_obs_after FROM changes""",
       "before_mean after_mean before_std after_std absolute_change percentage_change")
oracle("p3_shift_confirmation", "scan", f"SELECT {K}, date, confirmed FROM scan")
oracle("p4_change_direction", "changes", f"SELECT {K}, change_date, change_direction FROM changes")
oracle("p5_change_confidence", "changes", f"SELECT {K}, change_date, confidence FROM changes")
oracle("p6_change_report", "changes", f"""SELECT {K}, change_date, before_mean, after_mean, absolute_change,
    percentage_change, change_direction, confidence, 'PENDING_REVIEW' AS review_status FROM changes""",
       "before_mean after_mean absolute_change percentage_change")
oracle("p6_skipped_units", "ev_used", f"""SELECT count(*) FILTER (n < 30) AS n_skipped FROM
    (SELECT {K}, count(*) AS n FROM ev_used GROUP BY ALL)""")
oracle("p7_change_summary", "changes", """SELECT equipment_category, change_direction, count(*) AS n_change_points
    FROM changes GROUP BY 1, 2""")
oracle("p8_mean_shift_scan", "scan", f"SELECT {K}, date, position, is_change FROM scan")

# --- health --------------------------------------------------------------------------------------

cte("stats", "series", f"""SELECT {K}, average_daily_fuel, median_daily_fuel, n_observations,
      sd / nullif(average_daily_fuel, 0) AS fuel_volatility,
      CASE WHEN n_observations >= 6 THEN (late - early) / nullif(early, 0) * 100 END AS trend_percentage
    FROM (SELECT {K}, avg(fuel_liter) AS average_daily_fuel, median(fuel_liter) AS median_daily_fuel,
        count(*) AS n_observations, stddev_samp(fuel_liter) AS sd,
        avg(fuel_liter) FILTER (position < n_observations // 2) AS early,
        avg(fuel_liter) FILTER (position >= n_observations // 2) AS late FROM series GROUP BY {K})""")
WEIGHTS = {name: rank for rank, name in enumerate(fv.SEVERITIES)}
cte("h_anomaly", "lines_report", f"""SELECT {K}, count(*) FILTER (severity <> 'NORMAL') AS anomaly_count,
      count(*) FILTER (severity = 'CRITICAL') AS critical_anomaly_count,
      sum({case('severity', WEIGHTS, '0')}) / (count(*) * 4.0) * 100 AS anomaly_penalty,
      least(count(*) FILTER (severity = 'CRITICAL') / 3.0, 1) * 100.0::DOUBLE AS repeated_critical_penalty
    FROM lines_report WHERE severity <> 'INSUFFICIENT_DATA' GROUP BY {K}""")
cte("h_volatility", "stats", f"""SELECT {K}, CASE WHEN fuel_volatility IS NULL THEN 0.0::DOUBLE ELSE
      (rank() OVER (PARTITION BY equipment_category ORDER BY fuel_volatility NULLS LAST)
        + (count(*) OVER (PARTITION BY equipment_category, fuel_volatility) - 1) / 2.0)::DOUBLE
      / count(fuel_volatility) OVER (PARTITION BY equipment_category) * 100 END AS volatility_penalty FROM stats""")
SCORE = f"100.0 * {case('change_direction', fv.DIRECTION_WEIGHTS)} * {case('confidence', fv.CONFIDENCE_WEIGHTS)}"
cte("h_change", "changes", f"""SELECT {K}, least(sum({SCORE})::DOUBLE, 100.0) AS change_point_penalty,
    max(change_date) AS last_change_point FROM changes GROUP BY {K}""")
cte("line_totals", "", """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
    l_returnflag AS category_label, sum(l_quantity * (1 - l_tax)) AS workbook_value FROM lineitem GROUP BY 1, 2, 3""")
cte("line_grand", "", """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
    'GRAND_TOTAL' AS category_label, sum(l_quantity * (1 - l_discount)) AS workbook_value FROM lineitem GROUP BY 1, 2""")
cte("lines_cat", "lines line_totals", by_category("lines", "line_totals", "category_label"))
cte("h_recon", "lines_cat", f"""SELECT equipment_category,
    avg({case('validation_status', fv.RECONCILIATION_PENALTIES, '0')}) AS reconciliation_penalty FROM lines_cat GROUP BY 1""")


def daily(source: str, key: str) -> str:
    return f"""SELECT series_key, CAST(day AS DATE) AS date, y FROM (SELECT series_key,
        unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day
      FROM (SELECT {key} AS series_key, date FROM {source}) GROUP BY series_key)
    LEFT JOIN (SELECT {key} AS series_key, date, sum(fuel_liter) AS y FROM {source} GROUP BY 1, 2) t
      USING (series_key) WHERE t.date = CAST(day AS DATE)
    UNION ALL SELECT series_key, CAST(day AS DATE), NULL FROM (SELECT series_key,
        unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day
      FROM (SELECT {key} AS series_key, date FROM {source}) GROUP BY series_key) c
    WHERE NOT EXISTS (SELECT 1 FROM {source} s WHERE {key} = c.series_key AND s.date = CAST(c.day AS DATE))"""


def placeholder(series: str) -> str:
    return f"""SELECT series_key, date, y AS actual_fuel, f AS forecast_fuel, f + low AS lower_interval,
        f + high AS upper_interval, '{fv.PLACEHOLDER_MODEL}' AS model_name
      FROM (SELECT *, quantile_cont(y - f, 0.1) OVER (PARTITION BY series_key) AS low,
          quantile_cont(y - f, 0.9) OVER (PARTITION BY series_key) AS high
        FROM (SELECT *, lag(y, 7) OVER (PARTITION BY series_key ORDER BY date) AS f FROM {series}))
      WHERE f IS NOT NULL"""


def errors(source: str) -> str:
    return f"""SELECT *, actual_fuel - forecast_fuel AS residual, abs(actual_fuel - forecast_fuel) AS abs_error,
        (actual_fuel - forecast_fuel) / nullif(actual_fuel, 0) * 100 AS pct_error,
        coalesce(actual_fuel BETWEEN lower_interval AND upper_interval, false) AS within_interval FROM {source}"""


cte("flags", "lines", daily("lines", "equipment_category"))
cte("fleet", "lines", daily("lines", "'ALL'"))
cte("flags_ph", "flags", placeholder("flags"))
cte("flags_err", "flags_ph", errors("flags_ph"))
cte("fleet_ph", "fleet", placeholder("fleet"))
cte("fleet_err", "fleet_ph", errors("fleet_ph"))


def metrics(source: str, strict: bool) -> str:
    ok = "count(*) = count(residual)" if strict else "true"
    health = """CASE WHEN w IS NULL THEN 'INSUFFICIENT_DATA' WHEN w <= 10 THEN 'HEALTHY' WHEN w <= 15 THEN 'MONITOR'
      ELSE 'RETRAIN' END"""
    return f"""SELECT series_key, model_name, n_days_evaluated, round_even(m, 1) AS mae, round_even(r, 1) AS rmse,
        round_even(w, 2) AS wape, round_even(b, 1) AS bias, round_even(c, 1) AS interval_coverage_pct,
        {health} AS model_health_status
      FROM (SELECT series_key, model_name, count(*) AS n_days_evaluated, CASE WHEN {ok} THEN avg(abs_error) END AS m,
          CASE WHEN {ok} THEN sqrt(avg(residual * residual)) END AS r,
          CASE WHEN {ok} THEN sum(abs_error) / nullif(sum(abs(actual_fuel)), 0) * 100 END AS w,
          CASE WHEN {ok} THEN avg(residual) END AS b, avg(within_interval::INTEGER) * 100 AS c
        FROM {source} GROUP BY 1, 2)"""


cte("flags_strict", "flags_err", metrics("flags_err", True))
cte("fleet_strict", "fleet_err", metrics("fleet_err", True))
cte("joined", "stats h_anomaly h_volatility h_change lines_gaps h_recon fleet_strict", f"""SELECT s.*,
      coalesce(anomaly_count, 0) AS anomaly_count, coalesce(critical_anomaly_count, 0) AS critical_anomaly_count,
      last_change_point, coalesce(anomaly_penalty, 0) AS anomaly_penalty, volatility_penalty,
      least(greatest(coalesce(trend_percentage, 0), 0) / 50 * 100, 100) AS trend_penalty,
      coalesce(change_point_penalty, 0) AS change_point_penalty,
      least(coalesce(longest_gap_days, 0) / 42.0::DOUBLE * 100, 100) AS missing_data_penalty,
      coalesce(reconciliation_penalty, 0) AS reconciliation_penalty,
      coalesce(least((SELECT wape FROM fleet_strict) / 15 * 100, 100), 0) AS forecast_error_penalty,
      coalesce(repeated_critical_penalty, 0) AS repeated_critical_penalty
    FROM stats s LEFT JOIN h_anomaly USING ({K}) LEFT JOIN h_volatility USING ({K}) LEFT JOIN h_change USING ({K})
    LEFT JOIN lines_gaps USING ({K}) LEFT JOIN h_recon USING (equipment_category)""")
LOST = " + ".join(f"{name} * {weight}" for name, weight in fv.HEALTH_WEIGHTS.items())
cte("health", "joined", f"""SELECT *, CASE WHEN health_status = 'INSUFFICIENT_DATA' THEN '{fv.ACTION_COLLECT}'
      WHEN reconciliation_penalty >= 60 THEN '{fv.ACTION_RECONCILE}'
      WHEN critical_anomaly_count >= 3 THEN '{fv.ACTION_INSPECT}'
      WHEN change_point_penalty >= 50 THEN '{fv.ACTION_COMPARE}' WHEN anomaly_count >= 5 THEN '{fv.ACTION_LOGS}'
      WHEN missing_data_penalty >= 50 THEN '{fv.ACTION_GAPS}' WHEN health_status = 'MONITOR' THEN '{fv.ACTION_WATCH}'
      ELSE '{fv.ACTION_NONE}' END AS recommended_action
    FROM (SELECT *, round_even(100 - missing_data_penalty, 1) AS data_completeness,
        CASE WHEN n_observations < 10 THEN 'INSUFFICIENT_DATA' WHEN health_score BETWEEN 85 AND 100 THEN 'HEALTHY'
          WHEN health_score BETWEEN 70 AND 84 THEN 'MONITOR' WHEN health_score BETWEEN 50 AND 69 THEN 'REVIEW'
          WHEN health_score BETWEEN 0 AND 49 THEN 'CRITICAL' ELSE 'REVIEW' END AS health_status
      FROM (SELECT *, round_even(least(greatest(100 - ({LOST}), 0), 100), 1) AS health_score FROM joined))""")
oracle("h1_base_stats", "stats", "SELECT * FROM stats",
       "average_daily_fuel median_daily_fuel fuel_volatility trend_percentage")
oracle("h2_anomaly_component", "h_anomaly", "SELECT * FROM h_anomaly", "anomaly_penalty repeated_critical_penalty")
oracle("h3_volatility_rank", "h_volatility", "SELECT * FROM h_volatility", "volatility_penalty")
oracle("h4_trend_penalty", "joined", f"SELECT {K}, trend_penalty FROM joined", "trend_penalty")
oracle("h5_change_component", "h_change", "SELECT * FROM h_change", "change_point_penalty")
oracle("h6_gap_penalty", "lines_gaps", f"""SELECT {K}, least(longest_gap_days / 42.0::DOUBLE * 100, 100)
    AS missing_data_penalty FROM lines_gaps""", "missing_data_penalty")
oracle("h7_reconciliation_component", "h_recon", "SELECT * FROM h_recon", "reconciliation_penalty")
oracle("h8_forecast_penalty", "flags_strict", """SELECT series_key, coalesce(least(wape / 15 * 100, 100), 0)
    AS forecast_error_penalty FROM flags_strict""", "forecast_error_penalty")
HEALTH_DOUBLES = ("average_daily_fuel median_daily_fuel fuel_volatility trend_percentage data_completeness health_score "
                  + " ".join(fv.HEALTH_WEIGHTS))
oracle("h9_health_scores", "health", "SELECT * FROM health", HEALTH_DOUBLES)
oracle("h10_health_status", "health",
       "SELECT equipment_category, health_status, count(*) AS n FROM health GROUP BY 1, 2")
oracle("h11_recommended_action", "health", f"SELECT {K}, recommended_action FROM health")

# --- segments ------------------------------------------------------------------------------------


def growth(source: str) -> str:
    return f"""SELECT {K}, CASE WHEN count(*) >= 3 THEN regr_slope(used, pos) / nullif(avg(used), 0) * 100 END
        AS monthly_growth
      FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY m) AS pos
        FROM (SELECT {K}, date_trunc('month', date) AS m, sum(fuel_liter) AS used FROM {source}_used GROUP BY ALL))
      GROUP BY {K}"""


def profiles(source: str, ratio: str) -> str:
    return f"""SELECT {K}, avg(fuel_liter) AS mean_daily_fuel, median(fuel_liter) AS median_daily_fuel,
        stddev_samp(fuel_liter) AS standard_deviation, max(fuel_liter) AS maximum_daily_fuel,
        count(fuel_liter) AS n_observations, avg((fuel_liter = 0)::INTEGER) AS zero_day_ratio,
        stddev_samp(fuel_liter) / nullif(avg(fuel_liter), 0) AS coefficient_of_variation,
        least(count(*) / (max(date) - min(date) + 1), 1.0::DOUBLE) AS active_day_ratio,
        any_value(monthly_growth) AS monthly_growth, {ratio} AS anomaly_ratio
      FROM {source}_used JOIN {source}_growth USING ({K})"""


cte("lines_growth", "lines_used", growth("lines"))
cte("supp_growth", "supp_used", growth("supp"))
cte("ev_growth", "ev_used", growth("ev"))
cte("ratio", "lines_report", f"""SELECT {K}, avg((severity <> 'NORMAL')::INTEGER) AS r FROM lines_report
    WHERE severity <> 'INSUFFICIENT_DATA' GROUP BY {K}""")
cte("lines_prof", "lines_used lines_growth ratio", profiles("lines", "coalesce(any_value(r), 0)")
    + f" LEFT JOIN ratio USING ({K}) GROUP BY {K}")
cte("supp_prof", "supp_used supp_growth", profiles("supp", "0.0::DOUBLE") + f" GROUP BY {K}")
PROFILE = ("mean_daily_fuel median_daily_fuel standard_deviation coefficient_of_variation maximum_daily_fuel "
           "zero_day_ratio anomaly_ratio monthly_growth active_day_ratio")
oracle("g1_unit_profiles", "lines_prof", "SELECT * FROM lines_prof", PROFILE)
oracle("g2_monthly_growth", "lines_growth", "SELECT * FROM lines_growth", "monthly_growth")


def complete(source: str) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in PROFILE.split())
    return f"SELECT * FROM {source}_prof WHERE n_observations >= 14 AND {whole}"


cte("units", "lines_prof", complete("lines"))
cte("z", "units", f"SELECT {K}, " + ", ".join(
    f"({c} - avg({c}) OVER p) / CASE WHEN stddev_pop({c}) OVER p = 0 THEN 1 ELSE stddev_pop({c}) OVER p END AS z_{c}"
    for c in PROFILE.split()) + " FROM units WINDOW p AS (PARTITION BY equipment_category)")
oracle("g3_standardised_features", "z", "SELECT * FROM z", " ".join(f"z_{c}" for c in PROFILE.split()))
cte("quad", "units", f"""SELECT *, CAST((mean_daily_fuel >= mid_mean)::INTEGER * 2
      + (coefficient_of_variation >= mid_cv)::INTEGER AS INTEGER) AS cluster_id
    FROM units JOIN (SELECT equipment_category, median(mean_daily_fuel) AS mid_mean,
      median(coefficient_of_variation) AS mid_cv FROM units GROUP BY 1) USING (equipment_category)""")
SQUARE = " + ".join(f"(p.z_{c} - q.z_{c}) ^ 2" for c in PROFILE.split())


def silhouette(distance: str) -> str:
    return f"""SELECT equipment_category, 4 AS k, avg(CASE WHEN n > 1 THEN coalesce((o - i) / nullif(greatest(o, i), 0), 0)
        ELSE 0 END) AS silhouette
      FROM (SELECT equipment_category, equipment_id, max(n) FILTER (own) AS n,
          max(total / greatest(n - 1, 1)) FILTER (own) AS i, min(total / n) FILTER (NOT own) AS o
        FROM (SELECT p.equipment_category, p.equipment_id, p.cluster_id = q.cluster_id AS own, q.cluster_id,
            sum({distance}) AS total, count(*) AS n
          FROM labelled p JOIN labelled q USING (equipment_category) GROUP BY ALL) GROUP BY 1, 2) GROUP BY 1"""


cte("labelled", "z quad", f"SELECT z.*, cluster_id FROM z JOIN quad USING ({K})")
oracle("g5_silhouette", "labelled", silhouette(SQUARE), "silhouette")
oracle("g5_squared_silhouette", "labelled", silhouette(SQUARE), "silhouette")


def label(single: str) -> str:
    return f"""CASE WHEN active_day_ratio <= 0.15 THEN 'INTERMITTENT' WHEN monthly_growth >= 20 THEN 'INCREASING_TREND'
      WHEN {single} THEN 'HOMOGENEOUS'
      WHEN mean_daily_fuel >= mid_mean THEN CASE WHEN coefficient_of_variation >= mid_cv THEN 'HIGH_VOLATILE'
        ELSE 'HIGH_STABLE' END
      WHEN coefficient_of_variation >= mid_cv THEN 'LOW_VOLATILE' ELSE 'LOW_STABLE' END"""


CENTRE = ", ".join(f"avg({c}) AS {c}" for c in PROFILE.split())
cte("centres", "quad", f"""SELECT *, {label('n_clusters = 1')} AS cluster_label,
      printf('mean~%.0fL, CV~%.2f, active_ratio~%.2f, growth~%.1f%%/bulan', mean_daily_fuel, coefficient_of_variation,
        active_day_ratio, monthly_growth) AS cluster_characteristics
    FROM (SELECT *, count(*) OVER (PARTITION BY equipment_category) AS n_clusters FROM
      (SELECT equipment_category, cluster_id, any_value(mid_mean) AS mid_mean, any_value(mid_cv) AS mid_cv, {CENTRE}
       FROM quad GROUP BY 1, 2))""")
oracle("g6_cluster_labels", "quad centres", f"""SELECT q.equipment_category, q.equipment_id, q.cluster_id, cluster_label
    FROM quad q JOIN centres c ON q.equipment_category = c.equipment_category AND q.cluster_id = c.cluster_id""")
oracle("g7_cluster_descriptions", "centres",
       "SELECT equipment_category, cluster_id, cluster_characteristics FROM centres")
cte("supp_units", "supp_prof", complete("supp"))
oracle("g8_small_categories", "supp_units", f"""SELECT {K}, -1 AS cluster_id, {label('false')} AS cluster_label
    FROM supp_units JOIN (SELECT equipment_category, median(mean_daily_fuel) AS mid_mean,
      median(coefficient_of_variation) AS mid_cv FROM supp_units GROUP BY 1) USING (equipment_category)""")
# A run of k clusters needs more units than k; units here are all different.
oracle("g4_nearest_centres", "z", f"""SELECT {K}, k, k AS n_clusters, true AS nearest FROM
    (SELECT {K}, count(*) OVER (PARTITION BY equipment_category) AS n FROM z), (SELECT unnest([2, 3, 4, 5, 6])::INTEGER AS k) WHERE k < n""")
cte("segmented", "lines_prof units", f"""SELECT *, 0 AS kind FROM units
    UNION ALL SELECT *, -1 AS kind FROM lines_prof WHERE n_observations < 14""")
oracle("g9_segments", "segmented", f"SELECT {K}, kind, true AS labelled, {', '.join(PROFILE.split())} FROM segmented", PROFILE)
oracle("g8_sparse_units", "ev_used", f"""SELECT {K}, -1 AS cluster_id, 'INSUFFICIENT_DATA' AS cluster_label,
    '{fv.SEGMENT_TOO_FEW}' AS cluster_characteristics FROM ev_used GROUP BY {K} HAVING count(fuel_liter) < 14""")

# --- forecasts -----------------------------------------------------------------------------------

S = "PARTITION BY series_key ORDER BY date"
oracle("f1_daily_series", "flags", "SELECT * FROM flags", "y")
oracle("f2_training_part", "flags", "SELECT * FROM flags WHERE date <= DATE '2000-12-31'", "y")
_lags = ", ".join(f"lag(y, {n}) OVER ({S}) AS lag_{n}" for n in (1, 2, 3, 7, 14, 30))


def _prior(n: int, value: str, name: str) -> str:
    frame = f"({S} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(y) OVER {frame} = {n} THEN {value}(y) OVER {frame} END AS {name}_{n}"


_means = ", ".join(_prior(n, "avg", "rolling_mean") for n in (3, 7, 14, 30))
_stds = ", ".join(_prior(n, "stddev_samp", "rolling_std") for n in (7, 30))
oracle("f3_feature_matrix", "flags", f"""SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
    CAST(day(date) AS INTEGER) AS day_of_month, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
    CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, {_lags}, {_means}, {_stds}
    FROM flags""", "y lag_1 lag_2 lag_3 lag_7 lag_14 lag_30 rolling_mean_3 rolling_mean_7 rolling_mean_14 rolling_mean_30 "
                   "rolling_std_7 rolling_std_30")
cte("learnt", "flags", f"""SELECT * FROM (SELECT *, {_lags}, {_means}, {_stds} FROM flags) WHERE y IS NOT NULL AND lag_1 IS NOT NULL
    AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL AND lag_30 IS NOT NULL
    AND rolling_mean_30 IS NOT NULL AND rolling_std_30 IS NOT NULL""")
cte("asked", "flags", """SELECT series_key, date, y FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date) AS pos,
      count(*) OVER (PARTITION BY series_key) AS n FROM flags)
    WHERE pos > n - CASE WHEN n < 100 THEN greatest(10, n - 40) ELSE 60 END""")
oracle("f8_boosting_origins", "learnt asked", """SELECT a.series_key, a.date, any_value(a.y) AS y, count(l.date) AS n_learned,
    count(l.date) >= 40 AS forecast FROM asked a LEFT JOIN learnt l ON a.series_key = l.series_key AND l.date < a.date
    GROUP BY 1, 2""", "y")
for _name in ("f5_boosting_nodes", "f5_forest_nodes"):
    oracle(_name, "learnt", """SELECT series_key, date, y, true AS better_than_mean FROM
        (SELECT *, count(*) OVER (PARTITION BY series_key) AS n FROM learnt) WHERE n >= 40""", "y")
cte("ends", "flags", "SELECT series_key, max(date) AS last_date FROM flags GROUP BY 1")


def tail_path(name: str, horizon: int, series: str = "flags", ends: str = "ends") -> str:
    back = {"naive": "0", "seasonal_naive_7": "6 - (step - 1) % 7"}[name]
    return f"""SELECT series_key, CAST(last_date + step AS DATE) AS date, y AS forecast, step
      FROM (SELECT *, CAST(unnest(range(1, {horizon + 1})) AS INTEGER) AS step FROM {ends}) e
      LEFT JOIN {series} s USING (series_key) WHERE s.date = e.last_date - ({back})"""


def average_path(width: int, horizon: int) -> str:
    return f"""WITH RECURSIVE walk AS (
      SELECT series_key, last_date, 0 AS step, list(y ORDER BY date) AS known
      FROM flags JOIN ends USING (series_key) WHERE date > last_date - 30 GROUP BY 1, 2
      UNION ALL SELECT series_key, last_date, step + 1, list_append(known, list_avg(known[-{width}:]))
      FROM walk WHERE step < {horizon})
    SELECT series_key, CAST(last_date + step AS DATE) AS date, known[-1] AS forecast, step FROM walk WHERE step > 0"""


oracle("f6_state_rerun", "flags", """SELECT series_key, CAST(last + step AS DATE) AS date, step, true AS same
    FROM (SELECT series_key, max(date) AS last FROM flags WHERE y IS NOT NULL GROUP BY 1), (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS step)""")
oracle("f4_naive", "ends flags", tail_path("naive", 30), "forecast")
oracle("f4_seasonal_naive", "ends flags", tail_path("seasonal_naive_7", 30), "forecast")
oracle("f4_moving_average_7", "ends flags", f"SELECT * FROM ({average_path(7, 30)})", "forecast")
oracle("f4_moving_average_30", "ends flags", f"SELECT * FROM ({average_path(30, 30)})", "forecast")


def one_step(expression: str) -> str:
    return f"""SELECT series_key, date, y AS actual_fuel, f AS forecast_fuel FROM (SELECT *, {expression} AS f,
        row_number() OVER ({S}) AS pos, count(*) OVER (PARTITION BY series_key) AS n FROM flags)
      WHERE pos > n - CASE WHEN n < 100 THEN greatest(10, n - 40) ELSE 60 END"""


def tested(expression: str, model: str) -> str:
    return f"""SELECT series_key, date, actual_fuel, forecast_fuel, forecast_fuel + low AS lower_interval,
        forecast_fuel + high AS upper_interval, {text(fv.FORECAST_MODELS[model])} AS model_name
      FROM ({one_step(expression)}) JOIN ({band(expression)}) USING (series_key)"""


def band(expression: str) -> str:
    return f"""SELECT series_key, CASE WHEN count(*) = count(r) THEN quantile_cont(r, 0.1) END AS low,
        CASE WHEN count(*) = count(r) THEN quantile_cont(r, 0.9) END AS high
      FROM (SELECT *, actual_fuel - forecast_fuel AS r FROM ({one_step(expression)})) GROUP BY 1"""


FORECAST = "actual_fuel forecast_fuel lower_interval upper_interval"
MEAN_7 = f"avg(y) OVER ({S} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
WEEK = f"lag(y, 7) OVER ({S})"
oracle("f8_backtest", "flags", tested(MEAN_7, "moving_average_7"), FORECAST)
oracle("f8_backtest_seasonal", "flags", tested(WEEK, "seasonal_naive_7"), FORECAST)
oracle("f9_residual_quantiles", "flags", f"""SELECT series_key, low AS low_residual, high AS high_residual
    FROM ({band(f'lag(y, 1) OVER ({S})')})""", "low_residual high_residual")
cte("targets", "", """SELECT series_key, target_date FROM
    (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) + INTERVAL 24 MONTH AS DATE) AS target_date FROM orders)
    CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS t(series_key)""")


def climate(history: str, targets: str) -> str:
    """Means and quantiles of near days per target, counted per day of the year first."""
    away = "abs(dayofyear(target_date) - dayofyear(h.date))"
    return f"""SELECT t.series_key, t.target_date,
        CASE WHEN coalesce(n, 0) >= 3 THEN point ELSE whole_point END AS point,
        CASE WHEN coalesce(n, 0) >= 3 THEN low ELSE whole_low END AS lower,
        CASE WHEN coalesce(n, 0) >= 3 THEN high ELSE whole_high END AS upper,
        CASE WHEN coalesce(n, 0) >= 3 THEN n ELSE whole_n END AS n_reference_points
      FROM {targets} t
      LEFT JOIN (SELECT series_key, doy, avg(y) AS point, quantile_cont(y, 0.1) AS low, quantile_cont(y, 0.9) AS high,
            count(*) AS n
          FROM (SELECT d.doy, h.series_key, h.y FROM (SELECT unnest(range(1, 367)) AS doy) d JOIN {history} h
              ON least(abs(d.doy - dayofyear(h.date)), 365 - abs(d.doy - dayofyear(h.date))) <= 7 AND h.y IS NOT NULL)
          GROUP BY 1, 2) near ON near.series_key = t.series_key AND near.doy = dayofyear(t.target_date)
      JOIN (SELECT series_key, avg(y) AS whole_point, quantile_cont(y, 0.1) AS whole_low,
            quantile_cont(y, 0.9) AS whole_high, count(y) AS whole_n FROM {history} GROUP BY 1) whole
        ON whole.series_key = t.series_key"""


oracle("f10_climatology", "flags targets", climate("flags", "targets"), "point lower upper")
cte("far", "flags targets", climate("flags", "targets"))
oracle("f11_forecast_for_dates", "flags targets ends far", f"""
    SELECT *, CASE method WHEN 'historical_actual' THEN CASE WHEN point IS NULL THEN 'no_value' ELSE 'in_history' END
        WHEN 'climatology_fallback' THEN 'beyond_reliable_horizon'
        ELSE CASE WHEN horizon_days > 60 THEN 'long_horizon' END END AS warning
    FROM (SELECT t.series_key, t.target_date,
        CASE WHEN ahead <= 0 THEN 'historical_actual' WHEN ahead <= 180 THEN 'recursive_forecast'
          ELSE 'climatology_fallback' END AS method,
        CASE WHEN ahead <= 0 THEN s.y WHEN ahead <= 180 THEN p.forecast ELSE far.point END AS point,
        CASE WHEN ahead <= 0 THEN NULL WHEN ahead <= 180 THEN p.forecast + low ELSE far.lower END AS lower,
        CASE WHEN ahead <= 0 THEN NULL WHEN ahead <= 180 THEN p.forecast + high ELSE far.upper END AS upper,
        ahead AS horizon_days, CASE WHEN ahead > 180 THEN n_reference_points END AS n_reference_points,
        'seasonal_naive_7' AS model_name
      FROM (SELECT t.*, CAST(target_date - last_date AS INTEGER) AS ahead FROM targets t JOIN ends USING (series_key)) t
      LEFT JOIN flags s ON s.series_key = t.series_key AND s.date = t.target_date
      LEFT JOIN ({tail_path('seasonal_naive_7', 180)}) p ON p.series_key = t.series_key AND p.date = t.target_date
      LEFT JOIN far ON far.series_key = t.series_key AND far.target_date = t.target_date
      LEFT JOIN ({band(WEEK)}) b ON b.series_key = t.series_key)""", "point lower upper")
cte("past", "flags", "SELECT * FROM flags WHERE date <= DATE '2000-12-31' AND y IS NOT NULL")
cte("past_rows", "past", f"SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS back FROM past")
cte("past_ends", "past", "SELECT series_key, max(date) AS last_date FROM past GROUP BY 1")
cte("future", "flags past_ends", """SELECT series_key, date AS target_date, y, CAST(date - last_date AS INTEGER) AS ahead
    FROM flags JOIN past_ends USING (series_key) WHERE date > DATE '2000-12-31' AND y IS NOT NULL""")
cte("validation", "future past past_rows", f"""SELECT series_key, date, actual, forecast, method,
      actual - forecast AS residual, abs(actual - forecast) / nullif(actual, 0) * 100 AS abs_pct_error
    FROM (SELECT f.series_key, f.target_date AS date, f.y AS actual, p.y AS forecast, 'recursive_forecast' AS method
      FROM future f JOIN past_rows p ON p.series_key = f.series_key AND p.back = 7 - (f.ahead - 1) % 7
      WHERE f.ahead <= 180
      UNION ALL SELECT f.series_key, f.target_date, f.y, c.point, 'climatology_fallback'
      FROM future f JOIN ({climate('past', '(SELECT DISTINCT series_key, target_date FROM future)')}) c
        ON c.series_key = f.series_key AND c.target_date = f.target_date WHERE f.ahead > 180)""")
oracle("f12_cross_year_validation", "validation", "SELECT * FROM validation",
       "actual forecast residual abs_pct_error")
oracle("f13_validation_summary", "validation", """SELECT series_key,
    count(*) FILTER (method = 'recursive_forecast') AS n_recursive,
    count(*) FILTER (method = 'climatology_fallback') AS n_climatology, avg(abs(residual)) AS mae,
    sum(abs(residual)) / nullif(sum(abs(actual)), 0) * 100 AS wape FROM validation GROUP BY 1""", "mae wape")
oracle("f14_placeholder", "flags_ph", "SELECT * FROM flags_ph", FORECAST)
oracle("i15_forecast_scan", "fleet_ph", "SELECT * FROM fleet_ph", FORECAST)
oracle("f15_forecast_errors", "flags_err", "SELECT * FROM flags_err", FORECAST + " residual abs_error pct_error")
oracle("f16_overall_metrics", "flags_err", metrics("flags_err", False), "mae rmse wape bias interval_coverage_pct")


def rolling(source: str) -> str:
    rolled = " UNION ALL ".join(f"""SELECT series_key, date, {n} AS window_days,
      CASE WHEN count(abs_error) OVER w >= {max(2, n // 2)} THEN avg(abs_error) OVER w END AS rolling_mae,
      CASE WHEN count(abs_error) OVER w >= {max(2, n // 2)} AND count(actual_fuel) OVER w >= {max(2, n // 2)}
        THEN sum(abs_error) OVER w / nullif(sum(abs(actual_fuel)) OVER w, 0) * 100 END AS rolling_wape
      FROM {source} WINDOW w AS ({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""" for n in (7, 14, 30))
    return f"""SELECT *, CASE WHEN rolling_wape IS NULL THEN 'INSUFFICIENT_DATA'
      WHEN rolling_wape <= 10 THEN 'HEALTHY' WHEN rolling_wape <= 15 THEN 'MONITOR' ELSE 'RETRAIN' END
      AS model_health_status FROM ({rolled}) WHERE rolling_mae IS NOT NULL"""


cte("rolling", "flags_err", rolling("flags_err"))
oracle("f17_rolling_performance", "rolling", "SELECT * FROM rolling", "rolling_mae rolling_wape")
oracle("f18_drift", "rolling", """SELECT *, coalesce(latest_wape > previous_wape * 1.2 AND latest_wape > 10, false) AS drift
    FROM (SELECT series_key, max(rolling_wape) FILTER (late = 1) AS latest_wape,
        max(rolling_wape) FILTER (late = 2) AS previous_wape
      FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS late FROM rolling
        WHERE window_days = 30) GROUP BY 1)""", "latest_wape previous_wape")
oracle("f19_latest_performance", "rolling", """SELECT series_key, window_days, date, rolling_mae, rolling_wape,
    model_health_status FROM rolling QUALIFY row_number() OVER (PARTITION BY series_key, window_days ORDER BY date DESC) = 1
    """, "rolling_mae rolling_wape")
oracle("f20_available_years", "flags", "SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM flags")

# --- scenarios and recommendations ---------------------------------------------------------------


def scenarios(keys: str) -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}scenario, round_even(cut, 2) AS reduction_percentage_applied,
        round_even(projected, 1) AS projected_consumption, round_even(projected * 6800, 0) AS projected_cost,
        round_even(base - projected, 1) AS saving_liter, round_even((base - projected) * 6800, 0) AS saving_cost,
        round_even(goal - (base - projected), 1) AS gap_to_target_liter,
        round_even(projected / 2241000, 4) AS projected_liter_per_teu,
        round_even((base - projected) / nullif(goal, 0) * 100, 1) AS target_achievement_percentage,
        round_even(goal / 12, 1) AS required_monthly_reduction, round_even(goal / 365, 2) AS required_daily_reduction
      FROM (SELECT *, base * (1 - cut / 100) AS projected, base * 13.44::DOUBLE / 100 AS goal FROM
        (SELECT {lead}sum(fuel_liter) AS base FROM lines {group})
        CROSS JOIN (VALUES ('{fv.SCENARIO_BAU}', 0.0::DOUBLE), ('{fv.SCENARIO_MODERATE}', 6.72::DOUBLE),
          ('{fv.SCENARIO_TARGET}', 13.44::DOUBLE)) AS t(scenario, cut))"""


cte("saving", "lines", scenarios(""))
oracle("s1_saving_scenarios", "lines", scenarios("equipment_category"))
oracle("s2_efficiency", "lines", f"""SELECT {K}, 3.05::DOUBLE AS baseline_l_per_teu, 2.64::DOUBLE AS target_l_per_teu,
      2241000.0::DOUBLE AS target_throughput_teu, 5916240.0::DOUBLE AS max_liter_allowed_for_target,
      CASE WHEN t > 0 THEN base / t END AS actual_l_per_teu,
      CASE WHEN t > 0 THEN greatest(0, base - 5916240.0::DOUBLE) END AS savings_needed_liter,
      CASE WHEN t > 0 THEN coalesce(greatest(0, base - 5916240.0::DOUBLE) / nullif(base, 0) * 100, 0) END
        AS reduction_percentage_needed,
      CASE WHEN t > 0 THEN base / t <= 2.64 END AS meets_target, NOT coalesce(t > 0, false) AS throughput_missing
    FROM (SELECT {K}, coalesce(sum(fuel_liter), 0) AS base, any_value(s_acctbal) AS t
      FROM lines JOIN supplier ON CAST(s_suppkey AS VARCHAR) = equipment_id GROUP BY {K})""",
       "actual_l_per_teu savings_needed_liter reduction_percentage_needed max_liter_allowed_for_target")


def advice(priority: str, finding: str, evidence: str, action: str, role: str, source: str, unit: str = "equipment_id",
           category: str = "equipment_category") -> str:
    return f"""SELECT '{priority}' AS priority, {unit} AS equipment_id, {category} AS equipment_category,
      {finding} AS finding, {evidence} AS evidence, {action} AS recommended_action, '{role}' AS responsible_role
      FROM {source}"""


RULES = {
    "n1_critical_and_rising": advice(
        "HIGH", text(fv.FINDING_CRITICAL),
        f"printf({text(fv.EVIDENCE_CRITICAL)}, health_score, critical_anomaly_count, trend_percentage)",
        text(fv.DO_CRITICAL), fv.ROLE_MAINTENANCE,
        "scored WHERE health_score < 50 AND critical_anomaly_count >= 3 AND trend_percentage > 0"),
    "n2_anomalous_and_incomplete": advice(
        "MEDIUM", text(fv.FINDING_INCOMPLETE), f"printf({text(fv.EVIDENCE_INCOMPLETE)}, anomaly_count, data_completeness)",
        text(fv.DO_INCOMPLETE), fv.ROLE_DATA, "scored WHERE anomaly_count >= 5 AND data_completeness < 50"),
    "n3_over_budget": advice(
        "HIGH", text(fv.FINDING_BUDGET),
        "'gap_to_target=' || format('{:,.0f}', gap_to_target_liter) || ' L, required_daily_reduction=' || "
        "format('{:,.1f}', required_daily_reduction) || ' L/hari'",
        f"replace({text(fv.DO_BUDGET)}, '%s', format('{{:,.1f}}', required_daily_reduction))", fv.ROLE_SUPERVISOR,
        f"saving WHERE scenario = '{fv.SCENARIO_BAU}' AND gap_to_target_liter > 0",
        text(fv.FLEET_UNIT), text(fv.FLEET_CATEGORY)),
    "n4_above_peers": advice(
        "LOW", text(fv.FINDING_MEDIAN),
        f"printf({text(fv.EVIDENCE_MEDIAN)}, average_daily_fuel, peer_median, average_daily_fuel / peer_median)",
        text(fv.DO_MEDIAN), fv.ROLE_OPERATIONS,
        """scored JOIN (SELECT equipment_category, median(average_daily_fuel) AS peer_median FROM scored GROUP BY 1)
        USING (equipment_category) WHERE peer_median > 0 AND average_daily_fuel / peer_median >= 1.5"""),
    "n5_unreconciled": advice(
        "MEDIUM", f"printf({text(fv.FINDING_RECONCILE)}, equipment_category, months)",
        f"printf({text(fv.EVIDENCE_RECONCILE)}, n, largest)", text(fv.DO_RECONCILE), fv.ROLE_FUEL,
        f"""(SELECT equipment_category, string_agg(month_name, ', ' ORDER BY year, month) AS months, count(*) AS n,
        max(abs(difference_percentage)) AS largest FROM lines_cat WHERE {PROBLEM} GROUP BY 1)""",
        f"printf({text(fv.ALL_UNITS_FORMAT)}, equipment_category)"),
    "n6_changed_for_good": advice(
        "MEDIUM", text(fv.FINDING_CHANGE),
        f"printf({text(fv.EVIDENCE_CHANGE)}, change_point_penalty, CAST(last_change_point AS VARCHAR))",
        text(fv.DO_CHANGE), fv.ROLE_EQUIPMENT, "scored WHERE change_point_penalty >= 50"),
    "n7_long_gap": advice(
        "LOW", text(fv.FINDING_GAP), f"printf({text(fv.EVIDENCE_GAP)}, missing_data_penalty, data_completeness)",
        text(fv.DO_GAP), fv.ROLE_OPERATIONS, "scored WHERE missing_data_penalty >= 50"),
}
cte("scored", "health", "SELECT * FROM health WHERE health_status <> 'INSUFFICIENT_DATA'")
for _name, _rule in RULES.items():
    # alone, the rules run over the whole health table
    _alone = _rule.replace("scored", "health")
    oracle(_name, {"n3_over_budget": "saving", "n5_unreconciled": "lines_cat"}.get(_name, "health"), _alone)
_days = case("priority", fv.PRIORITY_DAYS, "14")
cte("advice", "scored saving lines_cat", f"""SELECT *, strftime(DATE '2026-01-15' + CAST({_days} AS INTEGER), '%Y-%m-%d')
    AS target_date, 'OPEN' AS status FROM ({' UNION ALL '.join(RULES.values())})""")
oracle("n8_recommendations", "advice", "SELECT * FROM advice")
oracle("n9_recommendation_summary", "advice", """SELECT priority, responsible_role, count(*) AS n_recommendations
    FROM advice GROUP BY 1, 2""")

# --- drill-down ----------------------------------------------------------------------------------

oracle("u1_scope", "lines_dated", f"""SELECT date, {K}, fuel_liter, data_status FROM lines_dated
    WHERE equipment_category IN ('A', 'R') AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""", "fuel_liter")
oracle("u2_scope_summary", "lines_dated", """SELECT sum(fuel_liter) AS total_liter,
    count(DISTINCT equipment_id) AS n_equipment, count(*) AS n_transaksi, avg(fuel_liter) AS avg_per_transaksi
    FROM lines_dated WHERE equipment_category IN ('A', 'R')""", "total_liter avg_per_transaksi")
for _name, _keys in (("u3_monthly_totals", "strftime(date, '%Y-%m') AS period_label"),
                     ("u3_monthly_by_category", "strftime(date, '%Y-%m') AS period_label, equipment_category"),
                     ("u4_daily_totals", "date"), ("u4_daily_by_unit", f"date, {K}")):
    oracle(_name, "lines_dated", f"SELECT {_keys}, sum(fuel_liter) AS fuel_liter FROM lines_dated GROUP BY ALL",
           "fuel_liter")
cte("cat_stats", "lines_dated", """SELECT *, round_even(total_liter / sum(total_liter) OVER () * 100, 1) AS share_pct,
    round_even(total_liter / n_equipment, 1) AS rata_rata_per_equipment FROM (SELECT equipment_category,
      sum(fuel_liter) AS total_liter, count(DISTINCT equipment_id) AS n_equipment, count(fuel_liter) AS n_transaksi
      FROM lines_dated GROUP BY 1)""")
oracle("u5_category_stats", "cat_stats", "SELECT * FROM cat_stats", "total_liter share_pct rata_rata_per_equipment")
_flag = ", ".join(f"round_even(coalesce(sum(fuel_liter) FILTER (equipment_category = '{f}'), 0), 0) AS {f}" for f in "AN")
oracle("u6_month_category_pivot", "lines_dated", f"""SELECT strftime(date, '%Y-%m') AS period_label, {_flag},
    round_even(sum(fuel_liter), 0) AS TOTAL FROM lines_dated GROUP BY 1""", "A N TOTAL")
oracle("u7_combined_share", "cat_stats", """SELECT sum(share_pct) AS combined_share_pct FROM cat_stats
    WHERE equipment_category IN ('A', 'N')""", "combined_share_pct")
oracle("u8_top_units", "lines_dated", f"""SELECT {K}, sum(fuel_liter) AS fuel_liter,
    equipment_category || ' - ' || equipment_id AS label FROM lines_dated GROUP BY {K}
    ORDER BY fuel_liter DESC, {K} LIMIT 10""", "fuel_liter")
oracle("u9_trailing_sums", "flags ends", """SELECT series_key,
    coalesce(sum(y) FILTER (date > last_date - 7), 0) AS trailing_7,
    coalesce(sum(y) FILTER (date > last_date - 30), 0) AS trailing_30
    FROM flags JOIN ends USING (series_key) GROUP BY 1""", "trailing_7 trailing_30")
oracle("u10_overview_kpis", "lines_report health", """SELECT
    count(*) FILTER (severity IN ('MEDIUM', 'HIGH', 'CRITICAL')) AS n_anomaly,
    (SELECT count(DISTINCT equipment_id) FROM health WHERE critical_anomaly_count > 0) AS n_critical_units
    FROM lines_report""")
SERIOUS = "severity IN ('MEDIUM', 'HIGH', 'CRITICAL')"
oracle("u11_anomaly_filter", "lines_report", f"""SELECT count(*) AS n_anomaly,
    count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'HIGH') AS n_high,
    count(DISTINCT equipment_id) AS n_equipment FROM lines_report WHERE {SERIOUS}
    AND equipment_category IN ('A', 'N') AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
oracle("u12_contribution", "lines_report",
       f"SELECT equipment_category, count(*) AS n_anomaly FROM lines_report WHERE {SERIOUS} GROUP BY 1")
oracle("u13_unit_timeline", "lines_report", """SELECT date, equipment_category, fuel_liter, severity,
    severity <> 'NORMAL' AS is_anomaly FROM lines_report WHERE equipment_id = '7' AND severity <> 'INSUFFICIENT_DATA'""",
       "fuel_liter")
oracle("u14_health_counters", "health", """SELECT avg(health_score) FILTER (health_status <> 'INSUFFICIENT_DATA')
    AS mean_score, count(*) FILTER (health_status = 'CRITICAL') AS n_critical,
    count(*) FILTER (health_status = 'REVIEW') AS n_review,
    count(*) FILTER (health_status = 'INSUFFICIENT_DATA') AS n_insufficient FROM health""", "mean_score")
oracle("u14_health_counts", "health", "SELECT health_status, count(*) AS n FROM health GROUP BY 1")
oracle("u14_five_numbers", "scored", """SELECT equipment_category, min(health_score) AS low,
    quantile_cont(health_score, 0.25) AS q1, median(health_score) AS median, quantile_cont(health_score, 0.75) AS q3,
    max(health_score) AS high FROM scored GROUP BY 1""", "low q1 median q3 high")
oracle("u15_unit_search", "health", f"""SELECT {K}, health_status FROM health WHERE equipment_id LIKE '1%'
    AND health_status IN ('MONITOR', 'REVIEW', 'HEALTHY') AND equipment_category IN ('A', 'N')""")
oracle("u18_advice_counters", "advice", """SELECT count(*) AS n_recommendations,
    count(*) FILTER (priority = 'HIGH') AS n_high, count(DISTINCT equipment_id) AS n_equipment FROM advice""")
oracle("u18_advice_by_role", "advice", "SELECT responsible_role, count(*) AS n FROM advice GROUP BY 1")

# --- streams -------------------------------------------------------------------------------------

oracle("st1_ingest", "ev", f"SELECT date, {K}, fuel_liter, source_row FROM ev", "fuel_liter")
oracle("st2_daily_totals", "ev", """SELECT date, equipment_category, sum(fuel_liter) AS fuel_liter, count(*) AS n_records
    FROM ev GROUP BY 1, 2""", "fuel_liter")
cte("ev_median", "ev", "SELECT equipment_category, median(fuel_liter) AS category_median FROM ev GROUP BY 1")
oracle("st3_score_arriving", "ev_std ev_lim ev_median", """SELECT source_row,
    CASE WHEN fuel_liter > high_limit THEN 'UNUSUALLY_HIGH' ELSE 'VALID' END AS data_status,
    fuel_liter - category_median AS deviation_from_category_median
    FROM ev_std JOIN ev_lim USING (equipment_category) JOIN ev_median USING (equipment_category)""",
       "deviation_from_category_median")


# --- the whole run -------------------------------------------------------------------------------

def _fingerprint(name: str, keys: str, source: str) -> str:
    row = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in keys.split()) + ")"
    return f"""SELECT '{name}' AS "table", count(*) AS n_rows,
      CAST(coalesce(sum(CAST('0x' || substr(md5({row}), 1, 8) AS BIGINT)), 0) AS BIGINT) AS checksum FROM ({source})"""


cte("run_monthly", "lines_dated line_grand", monthly("lines_dated", "line_grand"))
cte("fleet_rolling", "fleet_err", rolling("fleet_err"))
_RUN = [
    ("cleaned_ledger", "source_file source_row data_status", "SELECT * FROM lines_clean"),
    ("unit_master", "equipment_category equipment_id", f"SELECT DISTINCT {K} FROM lines_dated"),
    ("issue_report", "issue_code data_status n_occurrences", """SELECT issue_code, data_status, count(equipment_id) AS n_occurrences
        FROM lines_clean WHERE issue_code IS NOT NULL GROUP BY 1, 2"""),
    ("monthly_reconciliation", "year month validation_status", "SELECT * FROM run_monthly"),
    ("category_reconciliation", "year month equipment_category validation_status", "SELECT * FROM lines_cat"),
    ("missing_days", "date", """SELECT CAST(day AS DATE) AS date FROM
        (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM lines_dated)
        WHERE CAST(day AS DATE) NOT IN (SELECT date FROM lines_dated)"""),
    ("longest_gaps", "equipment_category equipment_id longest_gap_days", "SELECT * FROM lines_gaps"),
    ("quality_kpis", "duplicate_count unusually_high_count invalid_date_count", """SELECT
        count(*) FILTER (data_status = 'DUPLICATE') AS duplicate_count,
        count(*) FILTER (data_status = 'UNUSUALLY_HIGH') AS unusually_high_count,
        count(*) FILTER (data_status = 'INVALID_DATE') AS invalid_date_count FROM lines_clean"""),
    ("forecast_errors", "series_key date", "SELECT * FROM fleet_err"),
    ("forecast_metrics", "series_key", "SELECT DISTINCT series_key FROM fleet_err"),
    ("rolling_performance", "series_key window_days date", "SELECT * FROM fleet_rolling"),
    ("anomaly_report", "equipment_category equipment_id date severity", "SELECT * FROM lines_report"),
    ("anomaly_summary", "equipment_category severity n_records",
     "SELECT equipment_category, severity, count(*) AS n_records FROM lines_report GROUP BY 1, 2"),
    ("change_points", "equipment_category equipment_id change_date change_direction confidence", "SELECT * FROM changes"),
    ("change_summary", "equipment_category change_direction n_change_points",
     "SELECT equipment_category, change_direction, count(*) AS n_change_points FROM changes GROUP BY 1, 2"),
    ("health_scores", "equipment_category equipment_id health_status", "SELECT * FROM health"),
    ("segments", "equipment_category equipment_id", "SELECT * FROM segmented"),
    ("segment_summary", "equipment_category n_equipment",
     "SELECT equipment_category, count(*) AS n_equipment FROM segmented GROUP BY 1"),
    ("saving_scenarios", "scenario", "SELECT * FROM saving"),
    ("recommendations", "priority equipment_category equipment_id finding target_date", "SELECT * FROM advice"),
    ("recommendation_summary", "priority responsible_role n_recommendations",
     "SELECT priority, responsible_role, count(*) AS n_recommendations FROM advice GROUP BY 1, 2"),
]
oracle("o1_full_run", "lines_clean lines_dated run_monthly lines_cat lines_gaps fleet_err fleet_rolling lines_report changes health "
       "segmented saving advice", " UNION ALL ".join(_fingerprint(*row) for row in _RUN))
