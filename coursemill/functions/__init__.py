from coursemill.functions.dates import age_years, days_between, day_number, parse_date
from coursemill.functions.nulls import (
    drop_empty_columns,
    drop_incomplete,
    fill_zero,
    finite,
    lacks_text,
    nonblank,
    null_profile,
    strict,
)
from coursemill.functions.text import (
    blank_to,
    first_token,
    flag_rule,
    has_text,
    parse_number,
    recode_tokens,
    row_sum,
    strip_dots,
    with_flags,
)

__all__ = [
    "age_years", "blank_to", "day_number", "days_between", "drop_empty_columns", "drop_incomplete",
    "fill_zero", "finite", "first_token", "flag_rule", "has_text", "lacks_text", "nonblank",
    "null_profile", "parse_date", "parse_number", "recode_tokens", "row_sum", "strict",
    "strip_dots", "with_flags",
]
