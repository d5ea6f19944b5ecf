"""Text predicates, recodes and rule-driven flags."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_text(value: Column, needles: Iterable[str]) -> Column:
    """Any of the literal substrings, case-sensitive; null stays null."""
    return reduce(or_, [value.contains(n) for n in needles])


def flag_rule(value: Column, equals: Iterable[str] = (), contains: Iterable[str] = ()) -> Column:
    """1 when ``value`` is one of ``equals`` or holds one of ``contains``, otherwise 0."""
    equals, contains = list(equals), list(contains)
    tests = ([value.isin(equals)] if equals else []) + ([has_text(value, contains)] if contains else [])
    return F.when(reduce(or_, tests), 1).otherwise(0)


def with_flags(df: DataFrame, value: str, rules: Mapping[str, Mapping[str, Iterable[str]]]) -> DataFrame:
    """Add one 0/1 column per rule, all in a single projection."""
    return df.withColumns({name: flag_rule(F.col(value), **rule) for name, rule in rules.items()})


def recode_tokens(value: Column, tokens: Iterable[str], to: str) -> Column:
    """Null and the listed tokens become ``to``."""
    return F.when(value.isNull() | value.isin(list(tokens)), F.lit(to)).otherwise(value)


def blank_to(value: Column, label: str) -> Column:
    return F.when(value == "", F.lit(label)).otherwise(value)


def parse_number(value: Column) -> Column:
    """Number from text such as ``"20+"``; null when there is none."""
    return F.regexp_replace(F.trim(value), r"\+$", "").try_cast("double")


def strip_dots(code: Column) -> Column:
    return F.regexp_replace(code, r"\.", "")


def first_token(value: Column, separator: str) -> Column:
    return F.get(F.split(value, separator), F.lit(0))


def row_sum(columns: Iterable[str]) -> Column:
    return reduce(add, [F.col(c) for c in columns])
