"""The report inputs, derived from the given tables by SQL that both engines run.

Every line item plays exactly one part, by its ship date: it is a headcount row of the previous or the
current period, or, if it ships later, an open demand, a fulfilment, a release or an attrition. So the
inputs hold the whole table between them. FIXTURES.md says which cases are built in on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterline.session import fresh_path, path_exists, setting, size_reads, size_shuffles

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations",
)

# One row per line item, with its part in `role`.
BASE = """
SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, CAST(l.l_quantity AS INT) AS qty,
  o.o_orderstatus, o.o_orderpriority AS grade, c.c_custkey, c.c_name,
  n.n_name AS location, r.r_name AS region, r.r_regionkey, p.p_type AS practice,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE c.c_mktsegment END AS dept,
  CONCAT('PRJ-', CAST(CAST(FLOOR(c.c_custkey / 50) AS BIGINT) AS STRING)) AS project_id,
  CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'BU-X' ELSE CONCAT('BU-', CAST(c.c_custkey % 10 AS STRING)) END AS bu,
  CASE WHEN l.l_orderkey % 17 = 0 THEN 'n/a' WHEN l.l_orderkey % 19 = 0 THEN NULL
    ELSE CAST(CAST(l.l_quantity AS INT) AS STRING) END AS fte_txt,
  CASE WHEN CAST(l.l_shipdate AS DATE) < DATE '1998-01-01' THEN 'previous'
    WHEN CAST(l.l_shipdate AS DATE) < DATE '2000-07-01' THEN 'current'
    WHEN o.o_orderstatus = 'O' THEN 'demand'
    WHEN l.l_returnflag = 'A' THEN 'fulfilment'
    WHEN l.l_returnflag = 'R' THEN 'release'
    ELSE 'attrition' END AS role
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

_HEADCOUNT = """
SELECT project_id, practice, location AS utilization_location, grade AS grade_name, dept AS hcm_department_name,
  CASE WHEN dept IS NULL THEN NULL ELSE CONCAT('D-', SUBSTRING(dept, 1, 3)) END AS hcm_department_id,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL
    ELSE CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS associate_id,
  fte_txt AS billed_fte_internal, CAST(qty AS STRING) AS total_fte, bu,
  CAST(c_custkey AS STRING) AS customer_id, c_name AS customer_name,
  CONCAT('Project ', SUBSTRING(project_id, 5)) AS project_name, o_orderstatus AS project_type,
  CASE WHEN l_returnflag = 'N' THEN 'NBL' ELSE 'BL' END AS project_billability,
  CAST(c_custkey % 100 AS STRING) AS parent_customer_id,
  CONCAT('Parent ', CAST(c_custkey % 100 AS STRING)) AS parent_customer,
  CASE WHEN l_linenumber = 1 THEN 'Yes' ELSE 'No' END AS is_onsite
FROM base WHERE role = '{role}'
"""

# Tables that read `base`.
FACTS = {
    "util_cur": _HEADCOUNT.format(role="current"),
    "util_prev": _HEADCOUNT.format(role="previous"),
    "demand_base": """
SELECT project_id, practice, location, grade AS grade_hr, dept AS pool_name, bu, CAST(c_custkey AS STRING) AS account_id,
  CONCAT('Project ', SUBSTRING(project_id, 5)) AS project_description, o_orderstatus AS project_type,
  'BL' AS project_billability, c_name AS account_name, CAST(c_custkey % 100 AS STRING) AS parent_customer_id,
  CONCAT('Parent ', CAST(c_custkey % 100 AS STRING)) AS parent_customer
FROM base WHERE role = 'demand'
""",
    "fulfilment": """
SELECT project_id, practice, location, grade AS associate_hired_grade, dept AS pool_name, fte_txt AS fte_impact
FROM base WHERE role = 'fulfilment'
""",
    "releases": """
SELECT project_id, practice, location, grade, dept AS department_name, fte_txt AS impact_fte
FROM base WHERE role = 'release'
""",
    "attrition": """
SELECT project_id, practice, location, grade, dept AS department_name, fte_txt AS fte_impact
FROM base WHERE role = 'attrition'
""",
    "cost_file": """
SELECT DISTINCT practice, region AS country, grade AS grade_name,
  CAST(50 + 7 * r_regionkey + 3 * CAST(SUBSTRING(grade, 1, 1) AS INT) AS STRING) AS cost
FROM base WHERE practice <> 'PROMO'
""",
}

# Tables that read the given tables only.
LOOKUPS = {
    "map_location": """
SELECT n.n_name AS utilization_location, r.r_name AS country,
  CASE WHEN r.r_name = 'AMERICA' THEN 'West' ELSE 'East' END AS geo
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_name <> 'NATION_24'
""",
    "map_bu": """
SELECT DISTINCT CONCAT('BU-', CAST(c_custkey % 10 AS STRING)) AS bu,
  CONCAT('SBU-', CAST((c_custkey % 10) % 3 AS STRING)) AS sbu,
  CONCAT('Market-', CAST((c_custkey % 10) % 4 AS STRING)) AS market
FROM customer
""",
    "map_sbu": """
SELECT DISTINCT CONCAT('SBU-', CAST((c_custkey % 10) % 3 AS STRING)) AS sbu,
  CAST((c_custkey % 10) % 3 AS STRING) AS sbu_head_id,
  CONCAT('Head ', CAST((c_custkey % 10) % 3 AS STRING)) AS sbu_head_name
FROM customer
""",
    "map_account": """
SELECT CAST(c_custkey AS STRING) AS account_id, CAST(c_custkey % 9 AS STRING) AS pdl_id,
  CONCAT('PDL ', CAST(c_custkey % 9 AS STRING)) AS pdl_name FROM customer
UNION ALL
SELECT CAST(c_custkey AS STRING), CAST(c_custkey % 9 AS STRING), CONCAT('PDL ', CAST(c_custkey % 9 AS STRING))
FROM customer WHERE c_mktsegment = 'MACHINERY'
""",
    "map_tower": """
SELECT DISTINCT CONCAT('D-', SUBSTRING(c_mktsegment, 1, 3)) AS department_id,
  CONCAT('Tower ', SUBSTRING(c_mktsegment, 1, 1)) AS tower
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
""",
    "map_grade": """
SELECT DISTINCT o_orderpriority AS grade, CONCAT('CoD ', SUBSTRING(o_orderpriority, 1, 1)) AS cod_grade
FROM orders WHERE o_orderpriority <> '5-LOW'
""",
}

# Name of each input in the reports.
REPORT_TABLES = {
    "utilization_prediction_report": "util_cur",
    "previous_month_actual": "util_prev",
    "demand_base": "demand_base",
    "fulfilment": "fulfilment",
    "releases": "releases",
    "np_jan26": "releases",
    "attrition": "attrition",
    "cost_file": "cost_file",
    **{name: name for name in LOOKUPS},
}

# Columns whose values seldom repeat in a file: a dictionary of them takes time to fill and saves no space.
PLAIN = {f"parquet.enable.dictionary#{name}": "false" for name in ("l_orderkey", "c_custkey", "c_name")}

_staged: dict[tuple[str, str], tuple[str, dict[str, DataFrame]]] = {}


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _run(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run one of the texts above over the named frames."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"fixture_{name}")
    for name in tables:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {name}", f"{word} fixture_{name}")
    return spark.sql(text)


def _derive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    given = {name: raw(spark, sf_dir, name) for name in ("lineitem", "orders", "customer", "nation", "region", "part")}
    base = _run(spark, BASE, **given)
    return {"base": base} | {name: _run(spark, text, **given) for name, text in LOOKUPS.items()}


def _stage(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, DataFrame]]:
    """Write the derived tables once: the line items by role, so that each fact reads only its own."""
    folder = fresh_path(spark, "inputs")
    size_reads(spark, size_shuffles(spark, sf_dir))

    def stored(name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        # A file is open per role, so rows need no sort by it; small partitions of wide rows are not merged into large ones.
        writers, merged = "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        with setting(spark, writers, "16"), setting(spark, merged, "16m"):
            df.write.options(**PLAIN).partitionBy(*partition_by).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    derived = _derive(spark, sf_dir)
    base = stored("base", derived.pop("base"), "role")
    facts = {name: _run(spark, text, base=base) for name, text in FACTS.items()}
    derived["cost_file"] = facts.pop("cost_file")
    return folder, {"base": base, **facts, **{name: stored(name, df) for name, df in derived.items()}}


def inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables by fixture name.

    As users load their tables before they report on them, the first call in a session writes them to
    the shared folder and later calls read them.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _staged or not path_exists(spark, _staged[key][0]):
        _staged[key] = _stage(spark, sf_dir)
    return _staged[key][1]


def report_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables by the names the reports use."""
    ready = inputs(spark, sf_dir)
    return {name: ready[fixture] for name, fixture in REPORT_TABLES.items()}
