"""Operators for large training-data pipelines, each with its query and, where SQL can say it, its twin."""

from coursemill.llm import op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12, op13  # noqa: F401
from coursemill.llm.registered import QUERIES, TWINS


def queries():
    return dict(QUERIES)


def sql_twins():
    return dict(TWINS)
