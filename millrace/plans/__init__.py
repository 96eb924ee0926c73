"""Whole jobs, and the queries over the harness tables."""

from .job import Job, auto_reducers, progress, run_job

__all__ = ["Job", "auto_reducers", "progress", "run_job"]
