"""Readers of lines, pairs, results and logs; writers of results; the dataset catalog."""

from .catalog import Catalog, fold_log, replay_log
from .files import lines, pairs, parse_results, read_results, strip_return
from .results import delete_results, download_results, result_lines, write_results

__all__ = [
    "Catalog", "delete_results", "download_results", "fold_log", "lines", "pairs", "parse_results", "read_results", "replay_log", "result_lines",
    "strip_return", "write_results",
]
