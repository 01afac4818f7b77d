from .calendar import TIME_PARTS, whole_days_between, with_time_parts
from .columns import align_columns, column_label, drop_columns, melt, numeric_columns, plotted_columns, string_columns
from .credit import credit_score, loan_amount, loan_duration, loan_tier, probability_problem
from .hashing import hash60

__all__ = [
    "TIME_PARTS",
    "align_columns",
    "column_label",
    "credit_score",
    "drop_columns",
    "hash60",
    "loan_amount",
    "loan_duration",
    "loan_tier",
    "melt",
    "numeric_columns",
    "plotted_columns",
    "probability_problem",
    "string_columns",
    "whole_days_between",
    "with_time_parts",
]
