from coursemill.operators.intervals import lookback_join, point_in_any_interval, point_in_interval
from coursemill.operators.joins import (
    attach_surrogate,
    backfill,
    drop_members,
    keep_members,
    map_values,
    remap_ids,
)
from coursemill.operators.ranking import cumulative_totals, hash_split, shuffled_rank, uniform_key
from coursemill.operators.reshape import (
    explode_codes,
    long_features,
    longest_list,
    pivot_indicators,
    prefixed,
)
from coursemill.operators.rollups import first_by_order, modal_value, rollup_plans, top_rows
from coursemill.operators.timeline import Measure, by_day, timeline_profile

__all__ = [
    "Measure", "attach_surrogate", "backfill", "by_day", "cumulative_totals", "drop_members",
    "explode_codes", "first_by_order", "hash_split", "keep_members", "long_features",
    "longest_list", "lookback_join", "map_values", "modal_value", "pivot_indicators",
    "point_in_any_interval", "point_in_interval", "prefixed", "remap_ids", "rollup_plans", "shuffled_rank",
    "timeline_profile", "top_rows", "uniform_key",
]
