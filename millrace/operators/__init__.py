"""Jobs (map and reduce as columns), reports over their results, and user functions."""

from .jobs import JOBS, emitted, run_job_columns
from .reports import bytes_per_reducer, group_values, node_totals, reducer_layout, sum_by_key, top_n, total_unique
from .user_jobs import map_lines, reduce_pairs, run_user_job

__all__ = [
    "JOBS", "bytes_per_reducer", "emitted", "group_values", "map_lines", "node_totals", "reduce_pairs", "reducer_layout", "run_job_columns",
    "run_user_job", "sum_by_key", "top_n", "total_unique",
]
