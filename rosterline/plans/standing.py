"""Reports and the roll-up as lasting views, which show what their tables hold when they are read.

The text of a view is made from the same layouts as the reports: the facts are narrowed, united and grouped once,
in SQL over the tables' names, and the lookups joined. Headers are found in the tables as they are when the view
is made; an upload that passes the header contract keeps them all, so the view goes on.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from rosterline.functions.clock import CLOCK_FORMAT, REPORT_ZONE
from rosterline.operators.grain import DEPARTMENT, GRADE, GRAIN_4, GRAIN_5, LOCATION, PRACTICE, PROJECT, Measure, Source
from rosterline.operators.headers import find_header, quoted
from rosterline.plans import reports, rollup
from rosterline.plans.consolidate import KEY_HASH, Layout, carriers
from rosterline.plans.facts import CURRENT, PREVIOUS
from rosterline.sources.catalog import catalog_tables, replace_view

_RANKED = "STRUCT<rank: TINYINT, value: STRING>"
_BLANKS = r"' \t\n\r\u000B\u000C'"


def number_text(value: str) -> str:
    """``functions.to_number`` in SQL."""
    digits = f"CASE WHEN contains({value}, '_') THEN regexp_replace({value}, '(?<=[0-9])_(?=[0-9])', '') ELSE {value} END"
    last = f"right(TRIM(TRAILING {_BLANKS} FROM {digits}), 1)"
    suffixed = f"{last} IN ('d', 'D', 'f', 'F') AND NOT contains(lower({digits}), 'inf')"
    return f"CASE WHEN NOT ({suffixed}) THEN try_cast({digits} AS DOUBLE) END"


class Text:
    """SQL over the tables of one database."""

    def __init__(self, tables: Mapping[str, DataFrame], database: str):
        self.tables, self.database = tables, database

    def table(self, name: str) -> str:
        return f"{quoted(self.database)}.{quoted(name)}"

    def header(self, table: str, *headers: str) -> str:
        return quoted(find_header(self.tables[table], *headers))

    def _measure(self, source: Source, measure: Measure) -> str:
        if measure.kind == "rows":
            return "1"
        value = self.header(source.table, *measure.headers)
        return number_text(value) if measure.kind == "sum" else f"CAST({value} AS STRING)"

    def _narrowed(self, layout: Layout, carried: Sequence[str], source: Source) -> str:
        nothing = {"sum": "CAST(NULL AS DOUBLE)", "count": "CAST(NULL AS STRING)", "rows": "CAST(NULL AS INT)"}
        place = {spine.table: 1 << i for i, spine in enumerate(layout.spine)}
        fields = [f"{self.header(source.table, *source.keys[key])} AS {quoted(key)}" for key in layout.grain]
        fields.append(f"CAST({place.get(source.table, 'NULL')} AS INT) AS __present")
        for name, owner in layout.measures.items():
            measure = owner.measures[name]
            fields.append(f"{self._measure(source, measure) if owner == source else nothing[measure.kind]} AS {quoted(name)}")
        for name in carried:
            ranked = f"CAST(NULL AS {_RANKED})"
            for rank, (owner, attribute) in enumerate(layout.attributes[name]):
                if owner == source:
                    value = self.header(source.table, *source.attributes[attribute])
                    ranked = f"CASE WHEN {value} IS NOT NULL THEN named_struct('rank', CAST({rank} AS TINYINT), 'value', CAST({value} AS STRING)) END"
            fields.append(f"{ranked} AS {quoted(name)}")
        return f"SELECT {', '.join(fields)} FROM {self.table(source.table)}"

    def consolidated(self, layout: Layout) -> str:
        """Parts of a WITH clause; the last one, ``consolidated``, has what ``consolidate`` gives, without the marks of presence."""
        carrier = carriers(layout)
        carried = list(dict.fromkeys(carrier.values()))
        keys = ", ".join(quoted(key) for key in layout.grain)
        totals = [f"{'SUM' if owner.measures[name].kind == 'sum' else 'COUNT'}({quoted(name)}) AS {quoted(name)}" for name, owner in layout.measures.items()]
        least = [f"MIN({quoted(name)}) AS {quoted(name)}" for name in carried]
        matched = " AND ".join(f"{quoted(key)} IS NOT NULL" for key in layout.grain)

        def described(name: str) -> str:
            best, ranks = quoted(carrier[name]), len(layout.attributes[name])
            return f"CASE WHEN {matched} AND {best}.rank < {ranks} THEN {best}.value END AS {quoted(name)}"

        if len(layout.spine) == 1:
            raise ValueError("a spine of one source needs no match and has no lasting view")
        columns = [f"CASE WHEN {matched} THEN {quoted(name)} END AS {quoted(name)}" for name in layout.measures]
        columns += [described(name) for name in layout.attributes]
        union = "\nUNION ALL ".join(self._narrowed(layout, carried, source) for source in layout.sources)
        return f"""facts AS ({union}),
keyed AS (
  SELECT xxhash64({keys}) AS {KEY_HASH}, {keys}, {', '.join([*totals, *least])}
  FROM facts GROUP BY xxhash64({keys}), {keys} HAVING bit_or(__present) IS NOT NULL),
consolidated AS (SELECT {keys}, {', '.join(columns)} FROM keyed)"""

    def lookup(self, alias: str, table: str, on: Mapping[str, str], values: Mapping[str, str]) -> str:
        fields = [f"{self.header(table, header)} AS key{i}" for i, header in enumerate(on)]
        fields += [f"{self.header(table, header)} AS {quoted(name)}" for name, header in values.items()]
        matches = " AND ".join(f"{value} = {alias}.key{i}" for i, value in enumerate(on.values()))
        return f"LEFT JOIN (SELECT {', '.join(fields)} FROM {self.table(table)}) {alias} ON {matches}"

    def unique_lookup(self, alias: str, table: str, key: str, value: str, values: Mapping[str, str]) -> str:
        """The hash matches whenever the key does; with it, adaptive execution can split a hot key (see ``lookup_unique``)."""
        least = ", ".join(f"MIN({self.header(table, header)}) AS {quoted(name)}" for name, header in values.items())
        found = self.header(table, key)
        unique = f"SELECT {found} AS key0, {least} FROM {self.table(table)} GROUP BY {found}"
        return f"LEFT JOIN (SELECT *, xxhash64(key0) AS hash0 FROM ({unique})) {alias} ON {value} = {alias}.key0 AND xxhash64({value}) = {alias}.hash0"


def _round5(value: str) -> str:
    return f"round(({value}) * 100000.0D) / 100000.0D"


def _projection_text(text: Text, layout: Layout, departments: bool) -> str:
    """The WITH clause up to ``looked_up``: one row per key with all lookups and zero-filled flows."""
    c = "c.{}".format
    joins = [text.unique_lookup("lead", "map_account", "Account ID", c("lead_account"), reports.LEAD)]
    if departments:
        people = CURRENT.table
        name, identifier = text.header(people, *CURRENT.keys[DEPARTMENT]), text.header(people, *reports.DEPARTMENT_ID)
        ids = f"SELECT {name} AS key0, MIN({identifier}) AS department_id FROM {text.table(people)} WHERE {name} IS NOT NULL GROUP BY {name}"
        joins.append(f"LEFT JOIN ({ids}) department ON {c(quoted(DEPARTMENT))} = department.key0")
        joins.append(text.lookup("tower", "map_tower", {"Department ID": "department.department_id"}, {"Tower": "Tower"}))
    joins.append(text.lookup("place", "map_location", {"Utilization Location": c(quoted(LOCATION))}, reports.PLACE))
    price = {"Practice": c(quoted(PRACTICE)), "Country": "place.`Country`", "Grade name": c(quoted(GRADE))}
    joins.append(text.lookup("price", "cost_file", price, {"Cost": "Cost"}))
    joins.append(text.lookup("unit", "map_bu", {"BU": c("BU")}, reports.UNIT))
    joins.append(text.lookup("head", "map_sbu", {"SBU": "unit.`SBU`"}, reports.UNIT_HEAD))
    tail = [f"lead.{quoted(n)}" for n in reports.LEAD] + [f"place.{quoted(n)}" for n in reports.PLACE]
    tail += [f"unit.{quoted(n)}" for n in reports.UNIT] + [f"head.{quoted(n)}" for n in reports.UNIT_HEAD]
    extra = ["department.department_id", "tower.`Tower`"] if departments else []
    flows = "coalesce(c.rel_count, 0) AS release_count, coalesce(c.attr_count, 0) AS attr_total, coalesce(c.dem_count, 0) AS open_demands, coalesce(c.fulfil_count, 0) AS demands_fulfilled"
    costs = f"{_round5('CAST(price.`Cost` AS DOUBLE)')} AS std_cost"
    previous = ", ".join(f"coalesce(c.{name}, 0) AS {short}" for name, short in (("prev_mon_billed_fte", "billed"), ("prev_mon_total_fte", "total")) if name in layout.measures)
    newline = "\n"
    return f"""WITH {text.consolidated(layout)},
looked_up AS (
  SELECT c.* EXCEPT (attr_count), {flows}, {previous}, {costs}, {', '.join([*extra, *tail])}
  FROM consolidated c
  {newline.join(joins)})"""


def _projected(previous: str, fulfilled: float, opened: float) -> str:
    return _round5(f"{previous} + {fulfilled} * demands_fulfilled + {opened} * open_demands - attr_total - release_count")


_DESCRIBED = "project_name, project_type, project_billability"
_CUSTOMER = "customer_id, customer_name, parent_customer_id, parent_customer_name, BU"
_FLOWS = "release_count, attr_total AS attr_count, open_demands, demands_fulfilled"


def _tail() -> str:
    return ", ".join(quoted(name) for name in reports.TAIL)


def grain5_text(tables: Mapping[str, DataFrame], database: str, weights: reports.Weights = reports.Weights()) -> str:
    """The headline report, ``report_grain5_d15``, as SQL over the database's tables."""
    measures = {"prev_mon_billed_fte": PREVIOUS, "prev_mon_total_fte": PREVIOUS}
    layout = reports.projection_layout(GRAIN_5, measures, reports.HEADCOUNT_THEN_DEMAND)
    billed = _projected("billed", weights.billed_fulfilled, weights.billed_open)
    total = _projected("total", weights.total_fulfilled, weights.total_open)
    return f"""{_projection_text(Text(tables, database), layout, True)},
projected AS (SELECT *, {billed} AS eff_billed_fte, {total} AS eff_total_fte FROM looked_up)
SELECT {quoted(PROJECT)}, {_DESCRIBED}, {quoted(PRACTICE)}, {quoted(LOCATION)}, {quoted(GRADE)}, {_CUSTOMER},
  {quoted(DEPARTMENT)}, department_id, `Tower`, {_FLOWS}, std_cost,
  {_round5('billed')} AS prev_mon_billed_fte, {_round5('total')} AS prev_mon_total_fte, eff_billed_fte, eff_total_fte,
  {_round5('billed * std_cost')} AS prev_billed_cost, {_round5('total * std_cost')} AS prev_mon_total_cost,
  {_round5('eff_billed_fte * std_cost')} AS proj_billed_cost, {_round5('eff_total_fte * std_cost')} AS proj_total_cost, {_tail()}
FROM projected"""


def grain4_text(tables: Mapping[str, DataFrame], database: str) -> str:
    """``report_grain4_d8``, which the roll-up reads, as SQL over the database's tables."""
    layout = reports.projection_layout(GRAIN_4, {"prev_mon_billed_fte": PREVIOUS}, reports.HEADCOUNT)
    return f"""{_projection_text(Text(tables, database), layout, False)},
projected AS (SELECT *, {_projected('billed', 1.0, 0.5)} AS eff_billed_fte FROM looked_up)
SELECT {quoted(PROJECT)}, {_DESCRIBED}, {quoted(PRACTICE)}, {quoted(LOCATION)}, {quoted(GRADE)}, {_CUSTOMER}, {_FLOWS},
  {_round5('billed')} AS prev_mon_actual_billed_fte, eff_billed_fte, std_cost AS d_cost,
  {_round5('billed * std_cost')} AS prev_total_cost, {_round5('eff_billed_fte * std_cost')} AS proj_total_cost, {_tail()}
FROM projected"""


def rollup_text(report: str, at: dt.datetime | None = None) -> str:
    """``pdl_rollup`` as SQL over a view of ``report_grain4_d8``; its load time is the time it is read at, or ``at``, in UTC."""
    keys = ", ".join(quoted(key) for key in rollup.KEYS)
    now = "timestampadd(MICROSECOND, unix_micros(CAST(current_timestamp() AS TIMESTAMP_LTZ)), TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    instant = now if at is None else f"TIMESTAMP_NTZ '{at.isoformat(sep=' ')}'"
    per_unit = "round({} / nullif(last_bfte, 0.0D)) + 0.0D AS {}".format
    return f"""WITH totals AS (
  SELECT {keys}, MIN({quoted(PRACTICE)}) AS practice, MIN(project_type) AS project_type, MIN({quoted(GRADE)}) AS grade,
    round(SUM(prev_mon_actual_billed_fte)) + 0.0D AS last_bfte, SUM(prev_total_cost) AS previous, SUM(proj_total_cost) AS projected
  FROM {report} GROUP BY {keys}),
costs AS (SELECT *, {per_unit('previous', 'prev_cost_per_bfte')}, {per_unit('projected', 'projected_cost_per_bfte')} FROM totals)
SELECT {keys}, practice, project_type, grade, last_bfte, prev_cost_per_bfte, projected_cost_per_bfte,
  projected_cost_per_bfte - prev_cost_per_bfte AS diff,
  date_format(convert_timezone('UTC', '{REPORT_ZONE}', {instant}), '{CLOCK_FORMAT}') AS load_date
FROM costs ORDER BY {', '.join(f'{quoted(key)} ASC NULLS LAST' for key in rollup.KEYS)}"""


def create_report_views(
    spark: SparkSession, database: str, weights: reports.Weights = reports.Weights(), report: str = "dashboard15",
    rolled_up: str = "pdl_summary", rollup_input: str = "dashboard8", at: dt.datetime | None = None,
) -> None:
    """Create or replace the headline report, the report that the roll-up reads, and the roll-up, over the database's tables."""
    tables = catalog_tables(spark, database)
    name = f"{quoted(database)}.{{}}".format
    replace_view(spark, name(quoted(report)), grain5_text(tables, database, weights))
    replace_view(spark, name(quoted(rollup_input)), grain4_text(tables, database))
    replace_view(spark, name(quoted(rolled_up)), rollup_text(name(quoted(rollup_input)), at))
