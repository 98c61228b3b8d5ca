"""One Spark query per operator, over the given tables or over inputs derived from them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterline.functions import (
    avg_text, contains_ci, ist_text, label_missing, per_unit, prediction_date, prediction_date_text, round5, sum_text,
    table_name_expr, to_number, whole, zero_fill,
)
from rosterline.operators import explore
from rosterline.operators.contract import check_contract
from rosterline.operators.grain import (
    DEPARTMENT, GRAIN_4, GRAIN_5, Source, attach, department_map, drop_null_key, spine, summarise, to_grain,
)
from rosterline.operators.headers import strip_headers
from rosterline.operators.history import append_if_absent, recent_distinct
from rosterline.operators.lookups import audit_duplicates, lookup, lookup_unique, unique_map
from rosterline.plans import parts, reports, standing
from rosterline.plans.consolidate import Layout, consolidate
from rosterline.plans.facts import (
    ATTRITION, COUNTED_RELEASES, CURRENT, DEMAND, FULFILMENT, PREVIOUS, RELEASES,
)
from rosterline.plans.rollup import pdl_rollup
from rosterline.session import fresh_path, workspace
from rosterline.sources import catalog, search_index
from rosterline.sources.export import export_rows
from rosterline.sources.ingest import as_text, ingest_batch, ingest_text, read_text, replace_validated, stamp_load_date
from rosterline.sources.log import append_to_history
from rosterline.sources.workbooks import to_workbooks, workbook_wide
from verification.fixtures import raw, report_tables
from verification.oracles import AS_OF, FILE_NAMES, ILIKE_TEXT, LOADED, NEW_FULFILMENT, NUMBER_TEXTS, SEARCH, TABLE_NAMES

Query = Callable[[SparkSession, str], DataFrame]

AS_OF_DATE = dt.date.fromisoformat(AS_OF)
LOADED_AT = dt.datetime.fromisoformat(LOADED)
SPINE_SOURCES = (CURRENT, PREVIOUS, DEMAND)
OTHER_WEIGHTS = reports.Weights(0.2, 0.5, 0.8, 0.4)


def _on_tables(build: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(report_tables(spark, sf_dir))


# Reports.


def _rollup(tables: dict[str, DataFrame]) -> DataFrame:
    return pdl_rollup(reports.report_grain4_d8(tables), LOADED_AT)


# Stored tables: standing views, and parts, before and after a new upload of one fact.


def _new_fulfilment(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    text = NEW_FULFILMENT.replace("FROM fulfilment", "FROM {fulfilment}").replace("FROM attrition", "FROM {attrition}")
    return spark.sql(text, fulfilment=tables[FULFILMENT.table], attrition=tables[ATTRITION.table])


def _standing(view: str) -> Query:
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables, database = report_tables(spark, sf_dir), workspace(spark)
        for name, df in tables.items():
            catalog.replace_table(spark, f"{database}.{name}", df)
        standing.create_report_views(spark, database, at=LOADED_AT)
        replace_validated(spark, f"{database}.{FULFILMENT.table}", _new_fulfilment(spark, tables), LOADED_AT)
        return catalog.read_table(spark, f"{database}.{view}")

    return read


def _from_parts(build: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables, database = report_tables(spark, sf_dir), workspace(spark)
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts.refresh_parts(spark, database, {name: tables[name] for name in parts.FACTS}, buckets)
        parts.refresh_parts(spark, database, {FULFILMENT.table: _new_fulfilment(spark, tables)}, buckets)
        return build({**tables, **parts.part_tables(spark, database)})

    return read


REPORTS: dict[str, Query] = {
    "report_v1": _on_tables(lambda t: reports.report_v1(t, AS_OF_DATE)),
    "report_v2": _on_tables(reports.report_v2),
    "report_v3": _on_tables(lambda t: reports.report_v3(t, AS_OF_DATE)),
    "report_v4": _on_tables(lambda t: reports.report_v4(t, AS_OF_DATE)),
    "report_grain4_d2": _on_tables(reports.report_grain4_d2),
    "report_grain4_d8": _on_tables(reports.report_grain4_d8),
    "report_grain5_d13": _on_tables(reports.report_grain5_d13),
    "report_grain5_d15": _on_tables(reports.report_grain5_d15),
    "report_grain5_d15_joined": _on_tables(lambda t: reports.report_grain5_d15(t, form="joined")),
    "report_weighted": _on_tables(lambda t: reports.report_grain5_d15(t, OTHER_WEIGHTS)),
    "pdl_rollup": _on_tables(_rollup),
    "report_view_refreshed": _standing("dashboard15"),
    "rollup_view_refreshed": _standing("pdl_summary"),
    "report_parts_refreshed": _from_parts(reports.report_grain5_d15),
    "rollup_parts_refreshed": _from_parts(_rollup),
    "chart_series": _on_tables(lambda t: explore.chart_series(_rollup(t), "parent_customer_name", "prev_cost_per_bfte")),
}


# Summaries, key spines and joins.


def _summary(tables: dict[str, DataFrame], source: Source, grain: tuple[str, ...], *measures: str) -> DataFrame:
    """Keys and the named measures, or everything the source has."""
    return summarise(tables[source.table], source, grain, measures or None, () if measures else None)


def _spine(tables: dict[str, DataFrame], grain: tuple[str, ...], *sources: Source) -> DataFrame:
    return spine([to_grain(tables[source.table], source, grain) for source in sources], grain)


def _spine_join(tables: dict[str, DataFrame], grain: tuple[str, ...], measures: dict[str, Source]) -> DataFrame:
    df = _spine(tables, grain, *SPINE_SOURCES)
    for measure, source in measures.items():
        df = attach(df, _summary(tables, source, grain, measure), grain)
    return df


THREE = {"billed_fte": CURRENT, "prev_mon_billed_fte": PREVIOUS, "dem_count": DEMAND}
SIX = {**THREE, "fulfil_count": FULFILMENT, "rel_count": RELEASES, "attr_count": ATTRITION}


def _coalesced(tables: dict[str, DataFrame], *attributes: str) -> DataFrame:
    layout = Layout(GRAIN_5, SPINE_SOURCES, {}, {name: reports.from_sources(name, SPINE_SOURCES) for name in attributes})
    return consolidate(tables, layout).select(*GRAIN_5, *attributes)


def _closed_label(tables: dict[str, DataFrame]) -> DataFrame:
    names = summarise(tables[CURRENT.table], CURRENT, GRAIN_4, (), ("project_name",))
    df = attach(_spine(tables, GRAIN_4, CURRENT, PREVIOUS), names, GRAIN_4)
    return df.withColumn("project_name", label_missing(F.col("project_name"), "Closed Project"))


def _lateral(tables: dict[str, DataFrame]) -> DataFrame:
    df = _summary(tables, CURRENT, GRAIN_4, "billed_fte", "total_fte")
    df = df.withColumn("unbilled_fte", F.col("total_fte") - zero_fill(F.col("billed_fte")))
    df = df.withColumn("unbilled_share", round5(F.col("unbilled_fte") / F.nullif("total_fte", F.lit(0.0))))
    df = df.withColumn("billed_share", 1 - F.col("unbilled_share"))
    return df.select(*GRAIN_4, "unbilled_fte", "unbilled_share", "billed_share")


def _guarded_ratio(tables: dict[str, DataFrame]) -> DataFrame:
    totals = tables[PREVIOUS.table].groupBy("project_id", F.col("grade_name").alias("grade")).agg(
        whole(sum_text(F.col("billed_fte_internal"))).alias("billed"), sum_text(F.col("total_fte")).alias("total")
    )
    return totals.select("project_id", "grade", "billed", per_unit(F.col("total"), F.col("billed")).alias("total_per_billed"))


def _prediction_date(tables: dict[str, DataFrame]) -> DataFrame:
    return _spine(tables, GRAIN_4, CURRENT).withColumns(
        {"prediction_date": prediction_date(AS_OF_DATE), "prediction_text": prediction_date_text(AS_OF_DATE)}
    )


SUMMARIES: dict[str, Query] = {
    "align_grain": _on_tables(lambda t: to_grain(t[FULFILMENT.table], FULFILMENT, GRAIN_5, "fulfil_count")),
    "coalesce_chain": _on_tables(lambda t: _coalesced(t, "project_name", "customer_name", "bu_id")),
    "closed_project_label": _on_tables(_closed_label),
    "lateral_alias": _on_tables(_lateral),
    "not_null_filter": _on_tables(
        lambda t: drop_null_key(t[CURRENT.table], "HCM Department Name").select(
            "project_id", "hcm_department_name", "associate_id"
        )
    ),
    "util_summary_grain4": _on_tables(lambda t: _summary(t, CURRENT, GRAIN_4)),
    "util_summary_grain5": _on_tables(lambda t: _summary(t, CURRENT, GRAIN_5)),
    "previous_summary": _on_tables(lambda t: _summary(t, PREVIOUS, GRAIN_5)),
    "demand_summary": _on_tables(lambda t: _summary(t, DEMAND, GRAIN_5)),
    "fulfilment_summary": _on_tables(lambda t: _summary(t, FULFILMENT, GRAIN_5)),
    "release_summary": _on_tables(lambda t: _summary(t, RELEASES, GRAIN_5)),
    "release_count_summary": _on_tables(lambda t: _summary(t, COUNTED_RELEASES, GRAIN_4)),
    "attrition_summary": _on_tables(lambda t: _summary(t, ATTRITION, GRAIN_5)),
    "department_map": _on_tables(
        lambda t: department_map(t[CURRENT.table], CURRENT.keys[DEPARTMENT], ("HCM Department ID",))
    ),
    "account_map_unique": _on_tables(lambda t: unique_map(t["map_account"], "Account ID", reports.LEAD)),
    "duplicate_audit": _on_tables(lambda t: audit_duplicates(t["map_account"], "Account ID")),
    "guarded_ratio": _on_tables(_guarded_ratio),
    "avg_text": _on_tables(
        lambda t: t[CURRENT.table].groupBy("practice").agg(avg_text(F.col("billed_fte_internal")).alias("avg_billed_fte"))
    ),
    "key_spine_2": _on_tables(lambda t: _spine(t, GRAIN_4, CURRENT, PREVIOUS)),
    "key_spine_3_grain4": _on_tables(lambda t: _spine(t, GRAIN_4, *SPINE_SOURCES)),
    "key_spine_3_grain5": _on_tables(lambda t: _spine(t, GRAIN_5, *SPINE_SOURCES)),
    "spine_join_grain4": _on_tables(lambda t: _spine_join(t, GRAIN_4, THREE)),
    "spine_join_grain5": _on_tables(lambda t: _spine_join(t, GRAIN_5, SIX)),
    "prediction_date": _on_tables(_prediction_date),
}


# Lookups on the current headcount.


def _cost(tables: dict[str, DataFrame]) -> DataFrame:
    people = tables[CURRENT.table].select("associate_id", "practice", "utilization_location", "grade_name")
    placed = reports.add_place(people, tables, F.col("utilization_location"))
    return reports.add_cost(placed, tables["cost_file"], F.col("practice"), F.col("grade_name")).drop("utilization_location")


def _chain(tables: dict[str, DataFrame]) -> DataFrame:
    people = tables[CURRENT.table].select("associate_id", "bu", "hcm_department_id")
    towered = lookup(people, tables["map_tower"], {"Department ID": F.col("hcm_department_id")}, {"Tower": "Tower"})
    return reports.add_unit(towered, tables, F.col("bu")).drop("hcm_department_id")


def _accounts(tables: dict[str, DataFrame]) -> DataFrame:
    return tables[CURRENT.table].select("associate_id", "customer_id")


LOOKUP_JOINS: dict[str, Query] = {
    "lookup_join": _on_tables(
        lambda t: reports.add_place(
            t[CURRENT.table].select("associate_id", "utilization_location"), t, F.col("utilization_location")
        )
    ),
    "lookup_coalesced_key": _on_tables(
        lambda t: lookup(_coalesced(t, "bu_id"), t["map_bu"], {"BU": F.col("bu_id")}, reports.UNIT)
    ),
    "lookup_chain": _on_tables(_chain),
    "cost_lookup": _on_tables(_cost),
    "lookup_dedup": _on_tables(
        lambda t: lookup_unique(_accounts(t), t["map_account"], "Account ID", F.col("customer_id"), reports.LEAD)
    ),
    "lookup_fanout": _on_tables(
        lambda t: lookup(_accounts(t), t["map_account"], {"Account ID": F.col("customer_id")}, reports.LEAD)
    ),
}


# Tables, files and workbooks. Each call works in a database of its own.


def _ingest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_text(spark, f"{sf_dir}/customer.parquet", f"{workspace(spark)}.customer", LOADED_AT)


def _on_part(text: str, spark: SparkSession, sf_dir: str, table: str = "part") -> DataFrame:
    return spark.sql(text.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: raw(spark, sf_dir, table)})


def _table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_part(FILE_NAMES, spark, sf_dir).withColumn("table_name", table_name_expr(F.col("file_name")))


def _ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "uploads")
    paths = [f"{folder}/{name.title()} List.csv" for name in ("nation", "customer", "supplier")]
    for path, name in zip(paths, ("nation", "customer", "supplier")):
        export_rows(raw(spark, sf_dir, name), path)
    status = ingest_batch(spark, [*paths, f"{folder}/Not There.csv"], workspace(spark), LOADED_AT)
    return status.select("table", "status", "rows")


def _strip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, pads = raw(spark, sf_dir, "customer"), (" {}", "{}  ", "\t{} ", "{}")
    return strip_headers(customer.toDF(*[pads[i % len(pads)].format(name) for i, name in enumerate(customer.columns)]))


def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = stamp_load_date(as_text(raw(spark, sf_dir, "customer")))
    new = raw(spark, sf_dir, "customer").withColumnRenamed("c_acctbal", "C_ACCTBAL").withColumn("region", F.col("c_nationkey"))
    return check_contract(live, stamp_load_date(as_text(new)))


def _replace_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{workspace(spark)}.customer"
    live = ingest_text(spark, f"{sf_dir}/customer.parquet", table, LOADED_AT)
    replace_validated(spark, table, live.withColumn(" segment ", F.upper("c_mktsegment")), LOADED_AT)
    return catalog.read_table(spark, table)


def _replace_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = workspace(spark)
    catalog.replace_table(spark, f"{database}.customer", raw(spark, sf_dir, "customer"))
    catalog.replace_view(spark, f"{database}.segments", f"SELECT DISTINCT c_mktsegment FROM {database}.customer")
    counts = f"SELECT c_mktsegment, COUNT(*) AS customers FROM {database}.customer GROUP BY c_mktsegment"
    return catalog.replace_view(spark, f"{database}.segments", counts)


def _full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{workspace(spark)}.part"
    catalog.replace_table(spark, table, raw(spark, sf_dir, "part"))
    return catalog.read_table(spark, table)


def _run_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog.replace_view(spark, "console_lineitem", raw(spark, sf_dir, "lineitem"))
    return explore.run_sql(
        spark,
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS line_items, SUM(l_quantity) AS quantity "
        "FROM console_lineitem GROUP BY l_returnflag, l_linestatus",
    )


def _with_relations(spark: SparkSession, sf_dir: str) -> str:
    database = workspace(spark)
    for name in ("customer", "nation"):
        catalog.replace_table(spark, f"{database}.{name}", raw(spark, sf_dir, name))
    catalog.replace_view(spark, f"{database}.customer_counts", f"SELECT COUNT(*) AS customers FROM {database}.customer")
    return database


def _listed(spark: SparkSession, database: str) -> DataFrame:
    return catalog.list_tables(spark, database)


def _list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, _with_relations(spark, sf_dir))


def _drop_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = _with_relations(spark, sf_dir)
    for name in ("customer_counts", "nation", "never_there"):
        catalog.drop_relation(spark, f"{database}.{name}")
    return _listed(spark, database)


def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = workspace(spark)
    ingest_text(spark, f"{sf_dir}/customer.parquet", f"{database}.customer", LOADED_AT)
    described = catalog.describe_tables(spark, [f"{database}.customer"])
    return described.withColumn("table", F.substring_index("table", ".", -1))


def _export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "export") + ".csv"
    export_rows(explore.search_any(raw(spark, sf_dir, "customer"), "build|99"), path)
    return read_text(spark, path)


def _read_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "workbooks")
    to_workbooks(raw(spark, sf_dir, "customer"), "customer").write.parquet(path)
    return workbook_wide(spark.read.parquet(path))


SOURCES: dict[str, Query] = {
    "ingest_text": _ingest_text,
    "table_name_normalise": _table_names,
    "ingest_batch": _ingest_batch,
    "load_date_stamp": lambda spark, sf_dir: stamp_load_date(raw(spark, sf_dir, "customer"), LOADED_AT).select("c_custkey", "load_date"),
    "strip_headers": _strip_headers,
    "contract_check": _contract,
    "replace_validated": _replace_validated,
    "replace_view": _replace_view,
    "full_scan": _full_scan,
    "run_sql": _run_sql,
    "list_tables": _list_tables,
    "classify_tables": lambda spark, sf_dir: catalog.classify_tables(_on_part(TABLE_NAMES, spark, sf_dir), "name"),
    "describe_tables": _describe,
    "drop_relation": _drop_relation,
    "export_rows": _export_rows,
    "read_workbooks": _read_workbooks,
}


# Search, preview, question log, scalar functions and free queries.


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "conversations").filter("role = 'user'")


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    return append_if_absent(users.filter("turn = 0").select("text"), users.select("text"), "text")


def _append_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three uploads to one stored history."""
    name, users = f"{workspace(spark)}.questions", _users(spark, sf_dir)
    for rows in (users.filter("turn = 0"), users.filter("turn > 0 and conv_id % 2 = 0"), users.filter("turn > 0")):
        append_to_history(spark, name, rows.select("text"), "text", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return catalog.read_table(spark, name)


def _search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{workspace(spark)}.documents"
    catalog.replace_table(spark, name, raw(spark, sf_dir, "documents").repartitionByRange(32, "lang", "source"))
    search_index.build_search_index(spark, name)
    return search_index.search_stored(spark, name, SEARCH)


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_distinct(_users(spark, sf_dir), "text", F.col("conv_id") * 1000 + F.col("turn"))


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = raw(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))
    return explore.preview_rows(counts, [F.desc("customers"), F.asc("c_mktsegment")])


def _unit_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = round5(F.col("l_extendedprice") / F.col("l_quantity"))
    return raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price.alias("unit_price"))


def _format_ist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").select("event_id", ist_text(F.col("ts"), source_zone=F.lit("UTC")).alias("ist"))


def _query_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog.replace_view(spark, "console_customer", raw(spark, sf_dir, "customer"))
    texts = {
        "by_segment": "SELECT c_mktsegment, COUNT(*) AS customers FROM console_customer GROUP BY c_mktsegment",
        "nothing": "SELECT * FROM console_customer WHERE c_mktsegment = 'NO SUCH SEGMENT'",
        "bad_column": "SELECT no_such_column FROM console_customer",
    }
    outcomes = {name: explore.query_status(spark, text) for name, text in texts.items()}
    rows = [
        (name, each.status, None if each.rows is None else each.rows.count(), each.text if each.status == "empty" else None)
        for name, each in outcomes.items()
    ]
    return spark.createDataFrame(rows, "query string, status string, rows long, message string")


EXPLORE: dict[str, Query] = {
    "ilike_filter": lambda spark, sf_dir: raw(spark, sf_dir, "documents")
    .filter(contains_ci(F.col("text"), ILIKE_TEXT))
    .select("doc_id", "lang", "source"),
    "search_any": lambda spark, sf_dir: explore.search_any(raw(spark, sf_dir, "documents"), SEARCH),
    "search_counts": lambda spark, sf_dir: explore.match_counts(raw(spark, sf_dir, "documents"), SEARCH),
    "search_stored": _search_stored,
    "append_if_absent": _append,
    "append_to_history": _append_stored,
    "recent_distinct": _recent,
    "preview_rows": _preview,
    "try_cast_double": lambda spark, sf_dir: _on_part(NUMBER_TEXTS, spark, sf_dir, "lineitem").withColumn(
        "number", to_number(F.col("number_text"))
    ),
    "round5": _unit_price,
    "format_ist": _format_ist,
    "query_status": _query_status,
}

QUERIES: dict[str, Query] = {**REPORTS, **SUMMARIES, **LOOKUP_JOINS, **SOURCES, **EXPLORE}
