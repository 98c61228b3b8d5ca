"""Column expressions shared by the operators and reports."""

from rosterline.functions.aggregates import any_non_null, avg_text, headcount, sum_text
from rosterline.functions.clock import ist_text, prediction_date, prediction_date_text
from rosterline.functions.numbers import per_unit, round5, to_number, whole, zero_fill
from rosterline.functions.text import any_matches, contains_ci, label_missing, table_name_expr

__all__ = [
    "any_matches", "any_non_null", "avg_text", "contains_ci", "headcount", "ist_text", "label_missing",
    "per_unit", "prediction_date", "prediction_date_text", "round5", "sum_text",
    "table_name_expr", "to_number", "whole", "zero_fill",
]
