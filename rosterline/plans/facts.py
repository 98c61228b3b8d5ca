"""How each fact table names keys, measures and descriptions. Headers are the ones users upload."""

from __future__ import annotations

from rosterline.operators.grain import DEPARTMENT, GRADE, LOCATION, PRACTICE, PROJECT, Measure, Source

_SHARED = {PROJECT: ("Project Id",), PRACTICE: ("Practice",)}
_HEADCOUNT_KEYS = {
    **_SHARED,
    LOCATION: ("Utilization Location",),
    GRADE: ("Grade Name",),
    DEPARTMENT: ("HCM Department Name",),
}
_HEADCOUNT_ATTRIBUTES = {
    "bu_id": ("BU",),
    "account_id": ("Customer Id",),
    "project_name": ("Project Name",),
    "project_type": ("Project Type",),
    "project_billability": ("Project Billability",),
    "customer_name": ("Customer Name",),
    "parent_customer_id": ("ParentCustomerID",),
    "parent_customer": ("Parent Customer",),
}

CURRENT = Source(
    "utilization_prediction_report",
    _HEADCOUNT_KEYS,
    {
        "headcount": Measure("count", ("Associate ID",)),
        "billed_fte": Measure("sum", ("Billed FTE Internal",)),
        "total_fte": Measure("sum", ("Total FTE",)),
    },
    {**_HEADCOUNT_ATTRIBUTES, "is_onsite": ("Is Onsite",)},
)
PREVIOUS = Source(
    "previous_month_actual",
    _HEADCOUNT_KEYS,
    {
        "prev_mon_billed_fte": Measure("sum", ("Billed FTE Internal",)),
        "prev_mon_total_fte": Measure("sum", ("Total FTE",)),
    },
    _HEADCOUNT_ATTRIBUTES,
)
DEMAND = Source(
    "demand_base",
    {**_SHARED, LOCATION: ("Location",), GRADE: ("Grade HR",), DEPARTMENT: ("Pool Name",)},
    {"dem_count": Measure("rows")},
    {
        **_HEADCOUNT_ATTRIBUTES,
        "account_id": ("Account Id",),
        "project_name": ("Project Description",),
        "customer_name": ("Account Name",),
    },
)
FULFILMENT = Source(
    "fulfilment",
    {**_SHARED, LOCATION: ("Location",), GRADE: ("Associate Hired Grade", "Grade"), DEPARTMENT: ("Pool Name",)},
    {"fulfil_count": Measure("sum", ("FTE Impact", "FTE"))},
)
_LEAVERS_KEYS = {**_SHARED, LOCATION: ("Location",), GRADE: ("Grade",), DEPARTMENT: ("Department Name",)}
RELEASES = Source("releases", _LEAVERS_KEYS, {"rel_count": Measure("sum", ("Impact FTE",))})
ATTRITION = Source("attrition", _LEAVERS_KEYS, {"attr_count": Measure("sum", ("FTE Impact",))})
COUNTED_RELEASES = Source("np_jan26", _LEAVERS_KEYS, {"rel_count": Measure("rows")})
