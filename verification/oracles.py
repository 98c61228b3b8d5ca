"""SQL for DuckDB that gives the same rows as the registered queries.

Written from the report definitions, as summaries joined to a key spine, whatever form the Spark query
takes. Any value of a group is its least one. A rounded value has 0.0 added, as DuckDB may round to a
negative zero.
"""

from __future__ import annotations

from verification.fixtures import BASE, FACTS, LOOKUPS

AS_OF = "2025-01-31"
LOADED = "2025-01-31 17:30:00"

KEYS = {4: "project_id, practice, location, grade", 5: "project_id, practice, location, grade, dept"}
KEY_OUTPUT = {
    4: 'project_id AS "Project Id", practice AS "Practice", location AS "Location", grade AS "Grade"',
    5: 'project_id AS "Project Id", practice AS "Practice", location AS "Location", grade AS "Grade", dept AS department_name',
}
TAIL = (
    'country AS "Country", geo AS "Geo", sbu AS "SBU", market AS "Market", pdl_id AS "PDL ID", pdl_name AS "PDL Name", '
    'sbu_head_id AS "SBU Head ID", sbu_head_name AS "SBU Head Name"'
)


def query(ctes: dict[str, str], body: str) -> str:
    """A statement with the named parts, the inputs they read in front."""
    every = "\n".join([*ctes.values(), body])
    facts = {name: text for name, text in FACTS.items() if f" {name}" in every}
    lookups = {name: text for name, text in LOOKUPS.items() if f" {name}" in every}
    base = {"base": BASE} if facts else {}
    parts = {**base, **facts, **lookups, **ctes}
    return ("WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts.items()) + "\n" if parts else "") + body


def num(column: str) -> str:
    return f"TRY_CAST({column} AS DOUBLE)"


def _headcount(fixture: str, grain: int, measures: str, extra: str = "") -> str:
    dept = ", hcm_department_name AS dept" if grain == 5 else ""
    return f"""SELECT project_id, practice, utilization_location AS location, grade_name AS grade{dept}, {measures},
  MIN(bu) AS bu_id, MIN(customer_id) AS account_id, MIN(project_name) AS project_name, MIN(project_type) AS project_type,
  MIN(project_billability) AS project_billability, MIN(customer_name) AS customer_name,
  MIN(parent_customer_id) AS parent_customer_id, MIN(parent_customer) AS parent_customer{extra}
FROM {fixture} GROUP BY ALL"""


def current(grain: int) -> str:
    measures = (
        f"COUNT(associate_id) AS headcount, SUM({num('billed_fte_internal')}) AS billed_fte, SUM({num('total_fte')}) AS total_fte"
    )
    return _headcount("util_cur", grain, measures, ", MIN(is_onsite) AS is_onsite")


def previous(grain: int) -> str:
    measures = f"SUM({num('billed_fte_internal')}) AS prev_mon_billed_fte, SUM({num('total_fte')}) AS prev_mon_total_fte"
    return _headcount("util_prev", grain, measures)


def demand(grain: int) -> str:
    dept = ", pool_name AS dept" if grain == 5 else ""
    return f"""SELECT project_id, practice, location, grade_hr AS grade{dept}, COUNT(*) AS dem_count,
  MIN(bu) AS bu_id, MIN(account_id) AS account_id, MIN(project_description) AS project_name,
  MIN(project_type) AS project_type, MIN(project_billability) AS project_billability, MIN(account_name) AS customer_name,
  MIN(parent_customer_id) AS parent_customer_id, MIN(parent_customer) AS parent_customer
FROM demand_base GROUP BY ALL"""


def flow(fixture: str, grain: int, grade: str, dept: str, measure: str) -> str:
    dept = f", {dept} AS dept" if grain == 5 else ""
    return f"SELECT project_id, practice, location, {grade} AS grade{dept}, {measure} FROM {fixture} GROUP BY ALL"


# A new upload of one fact, made from two of the inputs; both engines run it.
NEW_FULFILMENT = """
SELECT project_id, practice, location, associate_hired_grade, pool_name,
  CASE WHEN fte_impact = '7' THEN '70' ELSE fte_impact END AS fte_impact FROM fulfilment
UNION ALL SELECT project_id, practice, location, grade, department_name, fte_impact FROM attrition
"""


def fulfilled(grain: int, fixture: str = "fulfilment") -> str:
    return flow(fixture, grain, "associate_hired_grade", "pool_name", f"SUM({num('fte_impact')}) AS fulfil_count")


def released(grain: int) -> str:
    return flow("releases", grain, "grade", "department_name", f"SUM({num('impact_fte')}) AS rel_count")


def released_rows(grain: int) -> str:
    return flow("releases", grain, "grade", "department_name", "COUNT(*) AS rel_count")


def left_by_attrition(grain: int) -> str:
    return flow("attrition", grain, "grade", "department_name", f"SUM({num('fte_impact')}) AS attr_count")


def key_spine(grain: int, *parts: str) -> str:
    return " UNION ".join(f"SELECT {KEYS[grain]} FROM {part}" for part in parts)


def on_spine(grain: int, *parts: str) -> str:
    return "spine " + " ".join(f"LEFT JOIN {part} USING ({KEYS[grain]})" for part in parts)


def first_of(column: str, *parts: str, name: str | None = None) -> str:
    return f"COALESCE({', '.join(f'{part}.{column}' for part in parts)}) AS {name or column}"


LEADS = "SELECT account_id, MIN(pdl_id) AS pdl_id, MIN(pdl_name) AS pdl_name FROM map_account GROUP BY account_id"
DEPARTMENTS = (
    "SELECT hcm_department_name AS dept, MIN(hcm_department_id) AS department_id FROM util_cur "
    "WHERE hcm_department_name IS NOT NULL GROUP BY 1"
)


def looked_up(facts: str, bu: str, account: str | None, leads: str = "leads", if_key: str = "TRUE", grade: bool = False) -> str:
    """``facts`` with all lookups. ``if_key`` is the condition under which keys are looked up at all."""
    columns, joins = "", ""
    if account:
        columns += ", pdl_id, pdl_name"
        joins += f"\nLEFT JOIN {leads} lead ON {account} = lead.account_id"
    if grade:
        columns += ", cod.cod_grade"
        joins += f"\nLEFT JOIN map_grade cod ON {if_key} AND x.grade = cod.grade"
    return f"""SELECT x.*, place.country, place.geo, unit.sbu, unit.market, head.sbu_head_id, head.sbu_head_name,
  CAST(price.cost AS DOUBLE) AS d_cost{columns}
FROM {facts} x
LEFT JOIN map_location place ON {if_key} AND x.location = place.utilization_location
LEFT JOIN cost_file price ON {if_key} AND x.practice = price.practice AND place.country = price.country
  AND x.grade = price.grade_name
LEFT JOIN map_bu unit ON {bu} = unit.bu
LEFT JOIN map_sbu head ON unit.sbu = head.sbu{joins}"""


_COUNTS = "COALESCE(rel_count, 0) AS release_count, COALESCE(dem_count, 0) AS open_demands"


def _reports() -> dict[str, str]:
    early = {"u": current(4), "d": demand(4), "r": released_rows(4)}
    of_current = f"u LEFT JOIN (SELECT {KEYS[4]}, dem_count FROM d) d USING ({KEYS[4]}) LEFT JOIN r USING ({KEYS[4]})"
    reports = {}

    facts = {**early, "m": f"SELECT u.*, {_COUNTS} FROM {of_current}"}
    reports["report_v1"] = query(
        {**facts, "x": looked_up("m", "x.bu_id", "x.account_id", leads="map_account")},
        f"""SELECT {KEY_OUTPUT[4]}, project_name, project_billability, account_id, customer_name, parent_customer_id,
  parent_customer, is_onsite, DATE '{AS_OF}' AS prediction_date, headcount, billed_fte AS total_billed_fte, total_fte,
  open_demands, release_count, {TAIL} FROM x""",
    )
    reports["report_v2"] = query(
        {**facts, "x": looked_up("m", "x.bu_id", None)},
        """SELECT project_id AS "Project Id", project_name, bu_id, account_id, billed_fte AS total_billed_fte, release_count,
  open_demands, country AS "Country", geo AS "Geo", sbu AS "SBU", market AS "Market", sbu_head_id AS "SBU Head ID",
  sbu_head_name AS "SBU Head Name" FROM x""",
    )
    with_previous = {**early, "p": previous(4), "leads": LEADS}
    reports["report_v3"] = query(
        {
            **with_previous,
            "m": f"SELECT u.*, prev_mon_billed_fte, {_COUNTS} FROM {of_current} "
            f"LEFT JOIN (SELECT {KEYS[4]}, prev_mon_billed_fte FROM p) p USING ({KEYS[4]})",
            "x": looked_up("m", "x.bu_id", "x.account_id", grade=True),
        },
        f"""SELECT {KEY_OUTPUT[4]}, project_name, cod_grade AS "CoD Grade", project_billability, customer_name,
  parent_customer_id, parent_customer, is_onsite, bu_id, account_id, billed_fte, '{AS_OF}' AS prediction_date,
  prev_mon_billed_fte AS prev_mon_actual_billed_fte, release_count, open_demands,
  billed_fte + open_demands - release_count AS eff_billed_fte, d_cost, billed_fte * d_cost AS curr_total_cost,
  (billed_fte + open_demands - release_count) * d_cost AS pred_total_cost, {TAIL} FROM x""",
    )
    seen = {"seen": f"SELECT {KEYS[4]}, TRUE AS is_open FROM u"}
    reports["report_v4"] = query(
        {
            **with_previous,
            **seen,
            "spine": key_spine(4, "u", "p"),
            "m": f"""SELECT {KEYS[4]}, COALESCE(is_open, FALSE) AS is_open, u.project_name, u.project_billability, u.customer_name,
  u.parent_customer_id, u.parent_customer, u.is_onsite, u.bu_id, u.account_id, u.billed_fte, p.prev_mon_billed_fte,
  CASE WHEN is_open THEN COALESCE(rel_count, 0) ELSE 0 END AS release_count,
  CASE WHEN is_open THEN COALESCE(dem_count, 0) ELSE 0 END AS open_demands
FROM {on_spine(4, 'u', 'p', 'd', 'r', 'seen')}""",
            "x": looked_up("m", "x.bu_id", "x.account_id", if_key="x.is_open", grade=True),
        },
        f"""SELECT {KEY_OUTPUT[4]}, COALESCE(project_name, 'Closed Project') AS project_name,
  COALESCE(billed_fte, 0) AS billed_fte, COALESCE(prev_mon_billed_fte, 0) AS prev_mon_actual_billed_fte,
  cod_grade AS "CoD Grade", project_billability, customer_name, parent_customer_id, parent_customer, is_onsite, bu_id,
  account_id, CASE WHEN is_open THEN '{AS_OF}' END AS prediction_date, release_count, open_demands,
  billed_fte + open_demands - release_count AS eff_billed_fte, d_cost, billed_fte * d_cost AS curr_total_cost,
  prev_mon_billed_fte * d_cost AS prev_total_cost,
  (billed_fte + open_demands - release_count) * d_cost AS pred_total_cost, {TAIL} FROM x""",
    )
    described = ("project_name", "customer_name", "parent_customer", "bu_id", "account_id")
    reports["report_grain4_d2"] = query(
        {
            **with_previous,
            "spine": key_spine(4, "u", "p"),
            "m": f"""SELECT {KEYS[4]}, {', '.join(first_of(name, 'u', 'p') for name in described)},
  COALESCE(billed_fte, 0) AS billed, COALESCE(prev_mon_billed_fte, 0) AS prev_billed, {_COUNTS}
FROM {on_spine(4, 'u', 'p', 'd', 'r')}""",
            "x": looked_up("m", "x.bu_id", "x.account_id"),
        },
        f"""SELECT {KEY_OUTPUT[4]}, {', '.join(described)}, billed AS billed_fte, prev_billed AS prev_mon_actual_billed_fte,
  release_count, open_demands, billed + open_demands - release_count AS eff_billed_fte, d_cost,
  billed * d_cost AS curr_total_cost, (billed + open_demands - release_count) * d_cost AS proj_total_cost,
  country AS "Country", geo AS "Geo", sbu AS "SBU", market AS "Market", sbu_head_name AS "SBU Head Name",
  pdl_name AS "PDL Name" FROM x""",
    )
    reports["report_grain4_d8"] = query(projected_ctes(4, ("u", "p")), D8_OUTPUT)
    reports["report_grain5_d13"] = query(projected_ctes(5, ("u", "p")), D15_OUTPUT)
    reports["report_grain5_d15"] = query(projected_ctes(5, ("u", "p", "d")), D15_OUTPUT)
    reports["report_grain5_d15_joined"] = reports["report_grain5_d15"]
    reports["report_weighted"] = query(projected_ctes(5, ("u", "p", "d"), ("0.2", "0.5", "0.8", "0.4")), D15_OUTPUT)
    reports["pdl_rollup"] = query({**projected_ctes(4, ("u", "p")), "report": D8_OUTPUT, "totals": TOTALS}, f"SELECT *, {LOAD_TIME} AS load_date FROM ({ROLLUP})")
    fresh = {"fulfilment_new": NEW_FULFILMENT}
    grain4 = {**fresh, **projected_ctes(4, ("u", "p")), "f": fulfilled(4, "fulfilment_new")}
    grain5 = {**fresh, **projected_ctes(5, ("u", "p", "d")), "f": fulfilled(5, "fulfilment_new")}
    rolled_up = f"SELECT *, {LOAD_TIME} AS load_date FROM ({ROLLUP})"
    for stored in ("view", "parts"):
        reports[f"report_{stored}_refreshed"] = query(grain5, D15_OUTPUT)
        reports[f"rollup_{stored}_refreshed"] = query({**grain4, "report": D8_OUTPUT, "totals": TOTALS}, rolled_up)
    reports["chart_series"] = query(
        {**projected_ctes(4, ("u", "p")), "report": D8_OUTPUT, "totals": TOTALS, "rollup": ROLLUP},
        "SELECT parent_customer_name AS x, prev_cost_per_bfte AS y FROM rollup "
        "WHERE parent_customer_name IS NOT NULL AND prev_cost_per_bfte IS NOT NULL AND (SELECT COUNT(*) FROM rollup) >= 3",
    )
    return reports


def projected_ctes(grain: int, bu_from: tuple[str, ...], weights: tuple[str, ...] = ("0.5", "0.2", "1.0", "0.5")) -> dict[str, str]:
    """Parts of the reports that project FTE; ends in ``y``, one row per key with all lookups."""
    upd = ("u", "p", "d")
    described = ", ".join([
        first_of("project_name", *upd), first_of("project_type", *upd), first_of("project_billability", *upd),
        first_of("account_id", *upd, name="customer_id"), first_of("customer_name", *upd),
        first_of("parent_customer_id", *upd), first_of("parent_customer", *upd, name="parent_customer_name"),
        first_of("bu_id", *bu_from, name="bu"), first_of("account_id", "u", "p", name="lead_account"),
    ])
    billed_fulfilled, billed_open, total_fulfilled, total_open = weights
    if grain == 4:
        billed_fulfilled, billed_open = "1.0", "0.5"
    parts = {
        "u": current(grain), "p": previous(grain), "d": demand(grain), "f": fulfilled(grain), "r": released(grain),
        "a": left_by_attrition(grain), "leads": LEADS, "spine": key_spine(grain, *upd),
        "m": f"""SELECT {KEYS[grain]}, {described},
  COALESCE(rel_count, 0) AS releases_fte, COALESCE(attr_count, 0) AS attrition_fte, COALESCE(dem_count, 0) AS opened,
  COALESCE(fulfil_count, 0) AS filled, COALESCE(prev_mon_billed_fte, 0) AS billed, COALESCE(prev_mon_total_fte, 0) AS total
FROM {on_spine(grain, 'u', 'p', 'd', 'f', 'r', 'a')}""",
        "x": looked_up("m", "x.bu", "x.lead_account"),
    }
    department = ""
    source = "x"
    if grain == 5:
        parts["departments"] = DEPARTMENTS
        department = ", dm.department_id, tw.tower"
        source = "x LEFT JOIN departments dm USING (dept) LEFT JOIN map_tower tw ON dm.department_id = tw.department_id"
    parts["y"] = f"""SELECT x.*{department}, ROUND(d_cost, 5) + 0.0 AS std_cost,
  ROUND(billed + {billed_fulfilled} * filled + {billed_open} * opened - attrition_fte - releases_fte, 5) + 0.0 AS eff_billed,
  ROUND(total + {total_fulfilled} * filled + {total_open} * opened - attrition_fte - releases_fte, 5) + 0.0 AS eff_total
FROM {source}"""
    return parts


_PROJECTED_HEAD = """project_name, project_type, project_billability, customer_id, customer_name, parent_customer_id,
  parent_customer_name, bu AS "BU", releases_fte AS release_count, attrition_fte AS attr_count, opened AS open_demands,
  filled AS demands_fulfilled"""
D8_OUTPUT = f"""SELECT {KEY_OUTPUT[4]}, {_PROJECTED_HEAD}, ROUND(billed, 5) + 0.0 AS prev_mon_actual_billed_fte,
  eff_billed AS eff_billed_fte, std_cost AS d_cost, ROUND(billed * std_cost, 5) + 0.0 AS prev_total_cost,
  ROUND(eff_billed * std_cost, 5) + 0.0 AS proj_total_cost, {TAIL} FROM y"""
D15_OUTPUT = f"""SELECT {KEY_OUTPUT[5]}, {_PROJECTED_HEAD}, department_id, tower AS "Tower", std_cost,
  ROUND(billed, 5) + 0.0 AS prev_mon_billed_fte, ROUND(total, 5) + 0.0 AS prev_mon_total_fte,
  eff_billed AS eff_billed_fte, eff_total AS eff_total_fte,
  ROUND(billed * std_cost, 5) + 0.0 AS prev_billed_cost, ROUND(total * std_cost, 5) + 0.0 AS prev_mon_total_cost,
  ROUND(eff_billed * std_cost, 5) + 0.0 AS proj_billed_cost, ROUND(eff_total * std_cost, 5) + 0.0 AS proj_total_cost,
  {TAIL} FROM y"""
TOTALS = """SELECT "PDL Name", parent_customer_name, MIN("Practice") AS practice, MIN(project_type) AS project_type,
  MIN("Grade") AS grade, ROUND(SUM(prev_mon_actual_billed_fte)) + 0.0 AS last_bfte, SUM(prev_total_cost) AS prev_cost,
  SUM(proj_total_cost) AS proj_cost FROM report GROUP BY 1, 2"""
ROLLUP = """SELECT "PDL Name", parent_customer_name, practice, project_type, grade, last_bfte,
  ROUND(prev_cost / NULLIF(last_bfte, 0)) + 0.0 AS prev_cost_per_bfte,
  ROUND(proj_cost / NULLIF(last_bfte, 0)) + 0.0 AS projected_cost_per_bfte,
  (ROUND(proj_cost / NULLIF(last_bfte, 0)) + 0.0) - (ROUND(prev_cost / NULLIF(last_bfte, 0)) + 0.0) AS diff
FROM totals ORDER BY "PDL Name", parent_customer_name"""


def _summaries() -> dict[str, str]:
    attributes = (
        "bu_id, account_id, project_name, project_type, project_billability, customer_name, parent_customer_id, parent_customer"
    )
    head = "headcount, billed_fte, total_fte, is_onsite"
    renamed_keys = {
        4: 'project_id AS "Project Id", practice AS "Practice", utilization_location AS "Location", grade_name AS "Grade"',
    }
    renamed_keys[5] = renamed_keys[4] + ", hcm_department_name AS department_name"
    three = {"u": current(5), "p": previous(5), "d": demand(5)}
    early = {"u": current(4), "p": previous(4), "d": demand(4)}
    return {
        "align_grain": query({}, f"""SELECT project_id AS "Project Id", practice AS "Practice", location AS "Location",
  associate_hired_grade AS "Grade", pool_name AS department_name, {num('fte_impact')} AS fulfil_count FROM fulfilment"""),
        "coalesce_chain": query(
            {**three, "spine": key_spine(5, "u", "p", "d")},
            f"SELECT {KEY_OUTPUT[5]}, {first_of('project_name', 'u', 'p', 'd')}, {first_of('customer_name', 'u', 'p', 'd')}, "
            f"{first_of('bu_id', 'u', 'p', 'd')} FROM {on_spine(5, 'u', 'p', 'd')}",
        ),
        "closed_project_label": query(
            {**early, "spine": key_spine(4, "u", "p")},
            f"SELECT {KEY_OUTPUT[4]}, COALESCE(u.project_name, 'Closed Project') AS project_name FROM {on_spine(4, 'u')}",
        ),
        "lateral_alias": query(
            {"u": current(4)},
            f"""SELECT {KEY_OUTPUT[4]}, total_fte - COALESCE(billed_fte, 0) AS unbilled_fte,
  ROUND(unbilled_fte / NULLIF(total_fte, 0), 5) + 0.0 AS unbilled_share, 1 - unbilled_share AS billed_share FROM u""",
        ),
        "not_null_filter": query(
            {}, "SELECT project_id, hcm_department_name, associate_id FROM util_cur WHERE hcm_department_name IS NOT NULL"
        ),
        "util_summary_grain4": query({"u": current(4)}, f"SELECT {KEY_OUTPUT[4]}, {head}, {attributes} FROM u"),
        "util_summary_grain5": query({"u": current(5)}, f"SELECT {KEY_OUTPUT[5]}, {head}, {attributes} FROM u"),
        "previous_summary": query(
            {"p": previous(5)}, f"SELECT {KEY_OUTPUT[5]}, prev_mon_billed_fte, prev_mon_total_fte, {attributes} FROM p"
        ),
        "demand_summary": query({"d": demand(5)}, f"SELECT {KEY_OUTPUT[5]}, dem_count, {attributes} FROM d"),
        "fulfilment_summary": query({"f": fulfilled(5)}, f"SELECT {KEY_OUTPUT[5]}, fulfil_count FROM f"),
        "release_summary": query({"r": released(5)}, f"SELECT {KEY_OUTPUT[5]}, rel_count FROM r"),
        "release_count_summary": query({"r": released_rows(4)}, f"SELECT {KEY_OUTPUT[4]}, rel_count FROM r"),
        "attrition_summary": query({"a": left_by_attrition(5)}, f"SELECT {KEY_OUTPUT[5]}, attr_count FROM a"),
        "department_map": query({"x": DEPARTMENTS}, "SELECT dept AS department_name, department_id FROM x"),
        "account_map_unique": query({"x": LEADS}, 'SELECT account_id AS "Account ID", pdl_id AS "PDL ID", pdl_name AS "PDL Name" FROM x'),
        "duplicate_audit": query(
            {}, 'SELECT account_id AS "Account ID", COUNT(*) AS mappings FROM map_account GROUP BY 1 HAVING COUNT(*) > 1 ORDER BY 2 DESC'
        ),
        "guarded_ratio": query(
            {"s": f"SELECT project_id, grade_name AS grade, ROUND(SUM({num('billed_fte_internal')})) + 0.0 AS billed, "
             f"SUM({num('total_fte')}) AS total FROM util_prev GROUP BY 1, 2"},
            "SELECT project_id, grade, billed, ROUND(total / NULLIF(billed, 0)) + 0.0 AS total_per_billed FROM s",
        ),
        "avg_text": query(
            {}, f"SELECT practice, AVG({num('billed_fte_internal')}) AS avg_billed_fte FROM util_cur GROUP BY 1"
        ),
        "key_spine_2": query({**early, "spine": key_spine(4, "u", "p")}, f"SELECT {KEY_OUTPUT[4]} FROM spine"),
        "key_spine_3_grain4": query({**early, "spine": key_spine(4, "u", "p", "d")}, f"SELECT {KEY_OUTPUT[4]} FROM spine"),
        "key_spine_3_grain5": query({**three, "spine": key_spine(5, "u", "p", "d")}, f"SELECT {KEY_OUTPUT[5]} FROM spine"),
        "spine_join_grain4": query(
            {**early, "spine": key_spine(4, "u", "p", "d")},
            f"SELECT {KEY_OUTPUT[4]}, billed_fte, prev_mon_billed_fte, dem_count FROM {on_spine(4, 'u', 'p', 'd')}",
        ),
        "spine_join_grain5": query(
            {**three, "f": fulfilled(5), "r": released(5), "a": left_by_attrition(5), "spine": key_spine(5, "u", "p", "d")},
            f"SELECT {KEY_OUTPUT[5]}, billed_fte, prev_mon_billed_fte, dem_count, fulfil_count, rel_count, attr_count "
            f"FROM {on_spine(5, 'u', 'p', 'd', 'f', 'r', 'a')}",
        ),
        "lookup_join": query(
            {}, 'SELECT x.associate_id, x.utilization_location, country AS "Country", geo AS "Geo" '
            "FROM util_cur x LEFT JOIN map_location place USING (utilization_location)",
        ),
        "lookup_coalesced_key": query(
            {**three, "spine": key_spine(5, "u", "p", "d"),
             "m": f"SELECT {KEYS[5]}, {first_of('bu_id', 'u', 'p', 'd')} FROM {on_spine(5, 'u', 'p', 'd')}"},
            f'SELECT {KEY_OUTPUT[5]}, bu_id, sbu AS "SBU", market AS "Market" FROM m LEFT JOIN map_bu b ON m.bu_id = b.bu',
        ),
        "lookup_chain": query(
            {},
            """SELECT x.associate_id, x.bu, b.sbu AS "SBU", b.market AS "Market", h.sbu_head_id AS "SBU Head ID",
  h.sbu_head_name AS "SBU Head Name", t.tower AS "Tower"
FROM util_cur x LEFT JOIN map_bu b ON x.bu = b.bu LEFT JOIN map_sbu h ON b.sbu = h.sbu
LEFT JOIN map_tower t ON x.hcm_department_id = t.department_id""",
        ),
        "cost_lookup": query(
            {},
            """SELECT x.associate_id, x.practice, place.country AS "Country", place.geo AS "Geo", x.grade_name, c.cost AS "Cost"
FROM util_cur x LEFT JOIN map_location place USING (utilization_location)
LEFT JOIN cost_file c ON x.practice = c.practice AND place.country = c.country AND x.grade_name = c.grade_name""",
        ),
        "lookup_dedup": query(
            {"leads": LEADS},
            'SELECT x.associate_id, x.customer_id, pdl_id AS "PDL ID", pdl_name AS "PDL Name" '
            "FROM util_cur x LEFT JOIN leads ON x.customer_id = leads.account_id",
        ),
        "lookup_fanout": query(
            {},
            'SELECT x.associate_id, x.customer_id, pdl_id AS "PDL ID", pdl_name AS "PDL Name" '
            "FROM util_cur x LEFT JOIN map_account mapped ON x.customer_id = mapped.account_id",
        ),
        "prediction_date": query(
            {"u": current(4)},
            f"SELECT {KEY_OUTPUT[4]}, DATE '{AS_OF}' AS prediction_date, strftime(DATE '{AS_OF}', '%Y-%m-%d') AS prediction_text FROM u",
        ),
    }


CUSTOMER_TEXT = (
    "CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
    "CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment"
)
CUSTOMER_COLUMNS = " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS position, '{name}' AS column_name"
    for i, name in enumerate(("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "load_date"), start=1)
)
LOAD_TIME = f"strftime(TIMESTAMP '{LOADED}' + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S')"
STAMP = f"{LOAD_TIME} || ' IST' AS load_date"

SEARCH = "(rely|hine?) th(at|e) [a-z]+tion"
ILIKE_TEXT = "of the or%tion"

# Texts that both engines run: file names, table names and number texts made from the given tables.
FILE_NAMES = """
SELECT p_partkey, CONCAT(CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 3 = 1 THEN CHR(9) ELSE '' END, UPPER(p_name), ' ', p_brand,
  CASE WHEN p_size % 5 = 0 THEN '.xlsx' WHEN p_size % 5 = 1 THEN '.XLSB' WHEN p_size % 5 = 2 THEN '.xlsx.xlsb'
    WHEN p_size % 5 = 3 THEN '.xls.xlsxx' ELSE CONCAT('.XLSX', CHR(10)) END) AS file_name
FROM part
"""
TABLE_NAMES = """
SELECT p_partkey, CONCAT(CASE WHEN p_size % 9 = 0 THEN 'map_' WHEN p_size % 9 = 1 THEN '_ref' WHEN p_size % 9 = 2 THEN 'v_'
    WHEN p_size % 9 = 3 THEN 'dashboard' WHEN p_size % 9 = 4 THEN 'archive' WHEN p_size % 9 = 5 THEN 'arv'
    WHEN p_size % 9 = 6 THEN 'pdl_summary' WHEN p_size % 9 = 7 THEN 'pdl' ELSE '' END, REPLACE(p_name, ' ', '_')) AS name
FROM part
"""
NUMBER_TEXTS = """
SELECT l_orderkey, l_linenumber, CASE
    WHEN l_orderkey % 8 = 0 THEN CAST(CAST(l_quantity AS INT) AS STRING)
    WHEN l_orderkey % 8 = 1 THEN CONCAT('  ', CAST(CAST(l_quantity AS INT) AS STRING), ' ')
    WHEN l_orderkey % 8 = 2 THEN CONCAT('1,', CAST(CAST(l_quantity AS INT) AS STRING))
    WHEN l_orderkey % 8 = 3 THEN CONCAT('-', CAST(CAST(l_quantity AS INT) AS STRING), '.25')
    WHEN l_orderkey % 8 = 4 THEN CONCAT(CAST(CAST(l_quantity AS INT) AS STRING), 'e2')
    WHEN l_orderkey % 8 = 5 THEN CONCAT(l_returnflag, CAST(CAST(l_quantity AS INT) AS STRING))
    WHEN l_orderkey % 8 = 6 THEN CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN CONCAT(CAST(CAST(l_quantity AS INT) AS STRING), 'f')
      WHEN 3 THEN CONCAT('1_', CAST(CAST(l_quantity AS INT) AS STRING)) WHEN 4 THEN CONCAT('1__', CAST(CAST(l_quantity AS INT) AS STRING))
      WHEN 5 THEN '-inf' WHEN 6 THEN '1.5D ' ELSE '.5' END
    ELSE NULL END AS number_text
FROM lineitem
"""


def _tables_and_text() -> dict[str, str]:
    customer_text = f"SELECT {CUSTOMER_TEXT} FROM customer"
    starts = lambda *prefixes: "(" + " OR ".join(f"starts_with(name, '{prefix}')" for prefix in prefixes) + ")"
    not_transactions = ("map_", "_ref", "v_", "dashboard", "archive", "arv", "pdl_summary")
    users = "(SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"
    search_columns = ("doc_id", "text", "lang", "source", "n_chars")
    hit = " OR ".join(f"COALESCE(regexp_matches(CAST({name} AS VARCHAR), '(?i){SEARCH}'), FALSE)" for name in search_columns)
    return {
        "ingest_text": f"SELECT {CUSTOMER_TEXT}, {STAMP} FROM customer",
        "table_name_normalise": f"""WITH files AS ({FILE_NAMES}) SELECT p_partkey, file_name,
  regexp_replace(replace(replace(replace(lower(file_name), '.xlsx', ''), '.xlsb', ''), ' ', '_'), '^\\s+|\\s+$', '', 'g') AS table_name
FROM files""",
        "ingest_batch": """SELECT 'nation_list' AS "table", 'complete' AS status, (SELECT COUNT(*) FROM nation) AS "rows"
UNION ALL SELECT 'customer_list', 'complete', (SELECT COUNT(*) FROM customer)
UNION ALL SELECT 'supplier_list', 'complete', (SELECT COUNT(*) FROM supplier)
UNION ALL SELECT 'not_there', 'failed', NULL""",
        "load_date_stamp": f"SELECT c_custkey, {STAMP} FROM customer",
        "strip_headers": "SELECT * FROM customer",
        "contract_check": f"""SELECT column_name AS "column", CASE WHEN column_name = 'c_acctbal' THEN 'missing' ELSE 'ok' END AS state
FROM ({CUSTOMER_COLUMNS}) UNION ALL SELECT 'C_ACCTBAL', 'extra' UNION ALL SELECT 'region', 'extra'""",
        "replace_validated": f"SELECT {CUSTOMER_TEXT}, UPPER(c_mktsegment) AS segment, {STAMP} FROM customer",
        "replace_view": "SELECT c_mktsegment, COUNT(*) AS customers FROM customer GROUP BY 1",
        "full_scan": "SELECT * FROM part",
        "run_sql": """SELECT l_returnflag, l_linestatus, COUNT(*) AS line_items, SUM(l_quantity) AS quantity
FROM lineitem GROUP BY 1, 2""",
        "list_tables": """SELECT 'customer' AS "table", 'table' AS kind UNION ALL SELECT 'nation', 'table'
UNION ALL SELECT 'customer_counts', 'view'""",
        "classify_tables": f"""WITH names AS ({TABLE_NAMES}) SELECT p_partkey, name, NOT {starts(*not_transactions)} AS is_transaction,
  {starts('map_')} AS is_lookup, {starts('pdl', 'dashboard')} AS is_view FROM names""",
        "describe_tables": f"""SELECT 'customer' AS "table", position, column_name AS "column", 'STRING' AS type
FROM ({CUSTOMER_COLUMNS})""",
        "drop_relation": """SELECT 'customer' AS "table", 'table' AS kind""",
        "export_rows": f"""SELECT * FROM ({customer_text})
WHERE regexp_matches(CONCAT_WS(chr(10), c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment), '(?i)build|99')""",
        "read_workbooks": customer_text,
        "ilike_filter": f"SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%{ILIKE_TEXT}%'",
        "search_any": f"SELECT * FROM documents WHERE {hit}",
        "search_counts": f"SELECT COUNT(*) FILTER (WHERE {hit}) AS shown, COUNT(*) AS total FROM documents",
        "search_stored": f"SELECT * FROM documents WHERE {hit}",
        "append_to_history": f"SELECT DISTINCT text FROM {users} WHERE text IS NOT NULL UNION ALL SELECT text FROM {users} WHERE text IS NULL",
        "append_if_absent": f"""WITH asked AS (SELECT text FROM {users} WHERE turn = 0)
SELECT text FROM asked UNION ALL
SELECT DISTINCT text FROM {users} WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM asked WHERE text IS NOT NULL)""",
        "recent_distinct": f"""SELECT text, MAX(conv_id * 1000 + turn) AS last_asked FROM {users} GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""",
        "preview_rows": """SELECT c_mktsegment, COUNT(*) AS customers FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
        "try_cast_double": f"WITH texts AS ({NUMBER_TEXTS}) SELECT *, {num('number_text')} AS number FROM texts",
        "round5": "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice / l_quantity, 5) AS unit_price FROM lineitem",
        "format_ist": "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS ist FROM events",
        "query_status": """SELECT 'by_segment' AS query, 'ok' AS status, COUNT(DISTINCT c_mktsegment) AS "rows", NULL AS message
FROM customer UNION ALL SELECT 'nothing', 'empty', 0, 'No data found.' UNION ALL SELECT 'bad_column', 'error', NULL, NULL""",
    }


def all_sql() -> dict[str, str]:
    return {**_reports(), **_summaries(), **_tables_and_text()}
