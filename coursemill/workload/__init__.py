"""Every operator as a query over the benchmark tables, with its SQL twin where there is one."""

from coursemill.workload import codes, cohort, course_run, evaluation, families, learners, preparation, whole  # noqa: F401
from coursemill.workload.registry import queries, sql_twins

__all__ = ["queries", "sql_twins"]
