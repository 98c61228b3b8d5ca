"""The master report in all its versions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from rosterline.functions import label_missing, prediction_date, prediction_date_text, round5, zero_fill
from rosterline.operators.grain import DEPARTMENT, GRADE, GRAIN_4, GRAIN_5, LOCATION, PRACTICE, PROJECT, Source, department_map
from rosterline.operators.lookups import lookup, lookup_unique
from rosterline.plans.consolidate import Layout, Tables, consolidate, has, is_part
from rosterline.plans.facts import (
    ATTRITION, COUNTED_RELEASES, CURRENT, DEMAND, FULFILMENT, PREVIOUS, RELEASES,
)

HEADCOUNT_THEN_DEMAND = (CURRENT, PREVIOUS, DEMAND)
HEADCOUNT = (CURRENT, PREVIOUS)

PLACE = {"Country": "Country", "Geo": "Geo"}
UNIT = {"SBU": "SBU", "Market": "Market"}
UNIT_HEAD = {"SBU Head ID": "SBU Head ID", "SBU Head Name": "SBU Head Name"}
LEAD = {"PDL ID": "PDL ID", "PDL Name": "PDL Name"}
TAIL = (*PLACE, *UNIT, *LEAD, *UNIT_HEAD)


@dataclass(frozen=True)
class Weights:
    """How much of a fulfilled and of an open demand counts towards projected FTE."""

    billed_fulfilled: float = 0.5
    billed_open: float = 0.2
    total_fulfilled: float = 1.0
    total_open: float = 0.5


def from_sources(attribute: str, sources: Sequence[Source]) -> list[tuple[Source, str]]:
    return [(source, attribute) for source in sources]


# Lookups, each adding its columns to the report. The account map may be too large to broadcast, so leads are
# looked up first, while the rows to exchange are narrow.


def add_place(df: DataFrame, tables: Tables, location: Column) -> DataFrame:
    return lookup(df, tables["map_location"], {"Utilization Location": location}, PLACE)


def add_cost(df: DataFrame, costs: DataFrame, practice: Column, grade: Column) -> DataFrame:
    """Needs ``Country``, which ``add_place`` looks up."""
    return lookup(df, costs, {"Practice": practice, "Country": F.col("Country"), "Grade name": grade}, {"Cost": "Cost"})


def add_unit(df: DataFrame, tables: Tables, bu: Column) -> DataFrame:
    df = lookup(df, tables["map_bu"], {"BU": bu}, UNIT)
    return lookup(df, tables["map_sbu"], {"SBU": F.col("SBU")}, UNIT_HEAD)


def add_lead(df: DataFrame, tables: Tables, account: Column) -> DataFrame:
    return lookup_unique(df, tables["map_account"], "Account ID", account, LEAD)


def add_grade(df: DataFrame, tables: Tables, grade: Column) -> DataFrame:
    return lookup(df, tables["map_grade"], {"Grade": grade}, {"CoD Grade": "CoD Grade"})


DEPARTMENT_ID = ("HCM Department ID",)


def add_department(df: DataFrame, tables: Tables) -> DataFrame:
    """Department ids and towers. The ids come from the current headcount, or were mined when its part was stored."""
    people = tables[CURRENT.table]
    headers = ((DEPARTMENT,), ("department_id",)) if is_part(people) else (CURRENT.keys[DEPARTMENT], DEPARTMENT_ID)
    departments = department_map(people, *headers)
    df = lookup(df, departments, {DEPARTMENT: F.col(DEPARTMENT)}, {"department_id": "department_id"})
    return lookup(df, tables["map_tower"], {"Department ID": F.col("department_id")}, {"Tower": "Tower"})


def _costs(tables: Tables) -> DataFrame:
    """The older reports read the cost table under the name of its month."""
    return tables["cost_dec_25"] if "cost_dec_25" in tables else tables["cost_file"]


# Versions 1 to 4: current headcount, counted releases.


def _early_layout(measures: dict[str, Source], attributes: Sequence[str], spine: Sequence[Source] = (CURRENT,)) -> Layout:
    counts = {"dem_count": DEMAND, "rel_count": COUNTED_RELEASES}
    return Layout(GRAIN_4, spine, {**measures, **counts}, {name: [(CURRENT, name)] for name in attributes})


_DESCRIPTIONS = (
    "project_name", "project_billability", "customer_name", "parent_customer_id", "parent_customer", "is_onsite",
    "bu_id", "account_id",
)


def report_v1(tables: Tables, as_of: dt.date | None = None, form: str = "one_shuffle") -> DataFrame:
    """Current headcount and FTE. Joins the account map as it is, so repeated accounts repeat rows."""
    layout = _early_layout({"headcount": CURRENT, "billed_fte": CURRENT, "total_fte": CURRENT}, _DESCRIPTIONS)
    df = consolidate(tables, layout, form)
    df = lookup(df, tables["map_account"], {"Account ID": F.col("account_id")}, LEAD)
    df = add_place(df, tables, F.col(LOCATION))
    df = add_unit(df, tables, F.col("bu_id"))
    return df.select(
        PROJECT, "project_name", PRACTICE, LOCATION, GRADE, "project_billability", "account_id", "customer_name",
        "parent_customer_id", "parent_customer", "is_onsite", prediction_date(as_of).alias("prediction_date"),
        "headcount", F.col("billed_fte").alias("total_billed_fte"), "total_fte",
        zero_fill(F.col("dem_count")).alias("open_demands"), zero_fill(F.col("rel_count")).alias("release_count"),
        *TAIL,
    )


def report_v2(tables: Tables, form: str = "one_shuffle") -> DataFrame:
    """Version 1 without the account map, which gives the right totals."""
    layout = _early_layout({"billed_fte": CURRENT}, ("project_name", "bu_id", "account_id"))
    df = consolidate(tables, layout, form)
    df = add_place(df, tables, F.col(LOCATION))
    df = add_unit(df, tables, F.col("bu_id"))
    return df.select(
        PROJECT, "project_name", "bu_id", "account_id", F.col("billed_fte").alias("total_billed_fte"),
        zero_fill(F.col("rel_count")).alias("release_count"), zero_fill(F.col("dem_count")).alias("open_demands"),
        *PLACE, *UNIT, *UNIT_HEAD,
    )


def report_v3(tables: Tables, as_of: dt.date | None = None, form: str = "one_shuffle") -> DataFrame:
    """Adds the previous month, cost, grade map and a unique account map."""
    layout = _early_layout({"billed_fte": CURRENT, "prev_mon_billed_fte": PREVIOUS}, _DESCRIPTIONS)
    df = consolidate(tables, layout, form)
    df = add_lead(df, tables, F.col("account_id"))
    df = add_place(df, tables, F.col(LOCATION))
    df = add_cost(df, _costs(tables), F.col(PRACTICE), F.col(GRADE))
    df = add_unit(df, tables, F.col("bu_id"))
    df = add_grade(df, tables, F.col(GRADE))
    df = df.withColumns({"release_count": zero_fill(F.col("rel_count")), "open_demands": zero_fill(F.col("dem_count"))})
    df = df.withColumns({
        "eff_billed_fte": F.col("billed_fte") + F.col("open_demands") - F.col("release_count"),
        "d_cost": F.col("Cost").cast("double"),
    })
    return df.select(
        PROJECT, "project_name", PRACTICE, LOCATION, GRADE, "CoD Grade", "project_billability", "customer_name",
        "parent_customer_id", "parent_customer", "is_onsite", "bu_id", "account_id", "billed_fte",
        prediction_date_text(as_of).alias("prediction_date"),
        F.col("prev_mon_billed_fte").alias("prev_mon_actual_billed_fte"),
        "release_count", "open_demands", "eff_billed_fte", "d_cost",
        (F.col("billed_fte") * F.col("d_cost")).alias("curr_total_cost"),
        (F.col("eff_billed_fte") * F.col("d_cost")).alias("pred_total_cost"),
        *TAIL,
    )


def report_v4(tables: Tables, as_of: dt.date | None = None, form: str = "one_shuffle") -> DataFrame:
    """Adds projects closed since last month. All but their keys and previous FTE stays empty."""
    layout = _early_layout({"billed_fte": CURRENT, "prev_mon_billed_fte": PREVIOUS}, _DESCRIPTIONS, HEADCOUNT)
    df = consolidate(tables, layout, form)
    df = add_lead(df, tables, F.col("account_id"))

    def if_open(col: Column) -> Column:
        return F.when(has(CURRENT), col)

    df = add_place(df, tables, if_open(F.col(LOCATION)))
    df = add_cost(df, _costs(tables), if_open(F.col(PRACTICE)), if_open(F.col(GRADE)))
    df = add_unit(df, tables, F.col("bu_id"))
    df = add_grade(df, tables, if_open(F.col(GRADE)))
    df = df.withColumns({
        "release_count": zero_fill(if_open(F.col("rel_count"))),
        "open_demands": zero_fill(if_open(F.col("dem_count"))),
        "d_cost": F.col("Cost").cast("double"),
    })
    df = df.withColumn("eff_billed_fte", F.col("billed_fte") + F.col("open_demands") - F.col("release_count"))
    return df.select(
        PROJECT, label_missing(F.col("project_name"), "Closed Project").alias("project_name"), PRACTICE, LOCATION, GRADE,
        zero_fill(F.col("billed_fte")).alias("billed_fte"),
        zero_fill(F.col("prev_mon_billed_fte")).alias("prev_mon_actual_billed_fte"),
        "CoD Grade", "project_billability", "customer_name", "parent_customer_id", "parent_customer", "is_onsite",
        "bu_id", "account_id", if_open(prediction_date_text(as_of)).alias("prediction_date"),
        "release_count", "open_demands", "eff_billed_fte", "d_cost",
        (F.col("billed_fte") * F.col("d_cost")).alias("curr_total_cost"),
        (F.col("prev_mon_billed_fte") * F.col("d_cost")).alias("prev_total_cost"),
        (F.col("eff_billed_fte") * F.col("d_cost")).alias("pred_total_cost"),
        *TAIL,
    )


# Later versions: descriptions fall back from current to previous headcount, and then to demand.


def report_grain4_d2(tables: Tables, form: str = "one_shuffle") -> DataFrame:
    """Version 4 with lookups for closed projects too, and with missing measures as 0."""
    attributes = ("project_name", "customer_name", "parent_customer", "bu_id", "account_id")
    layout = Layout(
        GRAIN_4, HEADCOUNT,
        {"billed_fte": CURRENT, "prev_mon_billed_fte": PREVIOUS, "dem_count": DEMAND, "rel_count": COUNTED_RELEASES},
        {name: from_sources(name, HEADCOUNT) for name in attributes},
    )
    df = consolidate(tables, layout, form)
    df = add_lead(df, tables, F.col("account_id"))
    df = add_place(df, tables, F.col(LOCATION))
    df = add_cost(df, _costs(tables), F.col(PRACTICE), F.col(GRADE))
    df = add_unit(df, tables, F.col("bu_id"))
    df = df.withColumns({
        "billed_fte": zero_fill(F.col("billed_fte")),
        "prev_mon_actual_billed_fte": zero_fill(F.col("prev_mon_billed_fte")),
        "release_count": zero_fill(F.col("rel_count")),
        "open_demands": zero_fill(F.col("dem_count")),
        "d_cost": F.col("Cost").cast("double"),
    })
    df = df.withColumn("eff_billed_fte", F.col("billed_fte") + F.col("open_demands") - F.col("release_count"))
    return df.select(
        *GRAIN_4, *attributes, "billed_fte", "prev_mon_actual_billed_fte", "release_count", "open_demands",
        "eff_billed_fte", "d_cost",
        (F.col("billed_fte") * F.col("d_cost")).alias("curr_total_cost"),
        (F.col("eff_billed_fte") * F.col("d_cost")).alias("proj_total_cost"),
        *PLACE, *UNIT, "SBU Head Name", "PDL Name",
    )


_FLOWS = {
    "dem_count": DEMAND, "fulfil_count": FULFILMENT, "rel_count": RELEASES, "attr_count": ATTRITION,
}
_FLOW_OUTPUTS = ("release_count", "attr_count", "open_demands", "demands_fulfilled")


def projection_layout(grain: Sequence[str], measures: dict[str, Source], bu_sources: Sequence[Source]) -> Layout:
    described = {
        "project_name": "project_name",
        "project_type": "project_type",
        "project_billability": "project_billability",
        "customer_id": "account_id",
        "customer_name": "customer_name",
        "parent_customer_id": "parent_customer_id",
        "parent_customer_name": "parent_customer",
    }
    attributes = {name: from_sources(own, HEADCOUNT_THEN_DEMAND) for name, own in described.items()}
    attributes["BU"] = from_sources("bu_id", bu_sources)
    # The lead is looked up for headcount accounts only, although demand accounts are shown.
    attributes["lead_account"] = from_sources("account_id", HEADCOUNT)
    return Layout(grain, HEADCOUNT_THEN_DEMAND, {**measures, **_FLOWS}, attributes)


def _add_flows(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "release_count": zero_fill(F.col("rel_count")),
        "attr_count": zero_fill(F.col("attr_count")),
        "open_demands": zero_fill(F.col("dem_count")),
        "demands_fulfilled": zero_fill(F.col("fulfil_count")),
    })


def _projected(previous: Column, fulfilled: float, opened: float) -> Column:
    """Previous FTE, plus weighted demand, less those who leave."""

    def weight(value: float) -> Column:
        return F.lit(Decimal(str(value)))  # exact where the count it multiplies is whole

    gained = previous + weight(fulfilled) * F.col("demands_fulfilled") + weight(opened) * F.col("open_demands")
    return gained - F.col("attr_count") - F.col("release_count")


def report_grain4_d8(tables: Tables, form: str = "one_shuffle") -> DataFrame:
    """Projects with demand only join the report; flows count FTE. The lead roll-up reads this one."""
    df = consolidate(tables, projection_layout(GRAIN_4, {"prev_mon_billed_fte": PREVIOUS}, HEADCOUNT), form)
    df = add_lead(df, tables, F.col("lead_account"))
    df = add_place(df, tables, F.col(LOCATION))
    df = add_cost(df, tables["cost_file"], F.col(PRACTICE), F.col(GRADE))
    df = add_unit(df, tables, F.col("BU"))
    df = _add_flows(df).withColumns({
        "previous": zero_fill(F.col("prev_mon_billed_fte")),
        "d_cost": round5(F.col("Cost").cast("double")),
    })
    df = df.withColumn("eff_billed_fte", round5(_projected(F.col("previous"), 1.0, 0.5)))
    return df.select(
        PROJECT, "project_name", "project_type", "project_billability", PRACTICE, LOCATION, GRADE,
        "customer_id", "customer_name", "parent_customer_id", "parent_customer_name", "BU", *_FLOW_OUTPUTS,
        round5(F.col("previous")).alias("prev_mon_actual_billed_fte"), "eff_billed_fte", "d_cost",
        round5(F.col("previous") * F.col("d_cost")).alias("prev_total_cost"),
        round5(F.col("eff_billed_fte") * F.col("d_cost")).alias("proj_total_cost"),
        *TAIL,
    )


def _report_grain5(tables: Tables, bu_sources: Sequence[Source], weights: Weights, form: str) -> DataFrame:
    measures = {"prev_mon_billed_fte": PREVIOUS, "prev_mon_total_fte": PREVIOUS}
    df = consolidate(tables, projection_layout(GRAIN_5, measures, bu_sources), form)
    df = add_lead(df, tables, F.col("lead_account"))
    df = add_department(df, tables)
    df = add_place(df, tables, F.col(LOCATION))
    df = add_cost(df, tables["cost_file"], F.col(PRACTICE), F.col(GRADE))
    df = add_unit(df, tables, F.col("BU"))
    df = _add_flows(df).withColumns({
        "billed": zero_fill(F.col("prev_mon_billed_fte")),
        "total": zero_fill(F.col("prev_mon_total_fte")),
        "std_cost": round5(F.col("Cost").cast("double")),
    })
    df = df.withColumns({
        "eff_billed_fte": round5(_projected(F.col("billed"), weights.billed_fulfilled, weights.billed_open)),
        "eff_total_fte": round5(_projected(F.col("total"), weights.total_fulfilled, weights.total_open)),
    })

    def cost_of(fte: str) -> Column:
        return round5(F.col(fte) * F.col("std_cost"))

    return df.select(
        PROJECT, "project_name", "project_type", "project_billability", PRACTICE, LOCATION, GRADE,
        "customer_id", "customer_name", "parent_customer_id", "parent_customer_name", "BU",
        DEPARTMENT, "department_id", "Tower", *_FLOW_OUTPUTS, "std_cost",
        round5(F.col("billed")).alias("prev_mon_billed_fte"), round5(F.col("total")).alias("prev_mon_total_fte"),
        "eff_billed_fte", "eff_total_fte",
        cost_of("billed").alias("prev_billed_cost"), cost_of("total").alias("prev_mon_total_cost"),
        cost_of("eff_billed_fte").alias("proj_billed_cost"), cost_of("eff_total_fte").alias("proj_total_cost"),
        *TAIL,
    )


def report_grain5_d13(tables: Tables, form: str = "one_shuffle") -> DataFrame:
    """Adds departments, towers and total FTE."""
    return _report_grain5(tables, HEADCOUNT, Weights(), form)


def report_grain5_d15(tables: Tables, weights: Weights = Weights(), form: str = "one_shuffle") -> DataFrame:
    """The headline report: the business unit falls back to demand too, and the weights can be set."""
    return _report_grain5(tables, HEADCOUNT_THEN_DEMAND, weights, form)
