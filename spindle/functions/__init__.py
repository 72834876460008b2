"""Column functions for units, times and guarded aggregates."""

from spindle.operators.measures import amount, count_if, date_key, full_days, hours, percent, ratio, seconds, sum_if

__all__ = ["amount", "count_if", "date_key", "full_days", "hours", "percent", "ratio", "seconds", "sum_if"]
