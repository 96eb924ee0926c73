"""A job from inputs to result files."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import run_job_columns, run_user_job
from ..sources import lines, write_results

MOST_REDUCERS = 100  # 0.95 * 21 nodes * 5 tasks, rounded
CHUNKS_A_REDUCER = 5


def auto_reducers(chunks: int) -> int:
    """Reducers of a job that asks for none: one for five chunks, 1 to 100."""
    return max(1, min(math.ceil(chunks / CHUNKS_A_REDUCER), MOST_REDUCERS))


@dataclass
class Job:
    """inputs: paths of lines. job: a built-in one, or map_fn and reduce_fn. reducers: 0 for as many as the input asks for."""

    inputs: list[str]
    job: str | None = None
    map_fn: Callable | None = None
    reduce_fn: Callable | None = None
    reducers: int = 0
    id: str = field(default_factory=lambda: str(time.time_ns()))

    def __post_init__(self) -> None:
        if (self.job is None) == (self.map_fn is None or self.reduce_fn is None):
            raise ValueError("a job is a built-in one or a pair of functions")
        if self.reducers < 0:
            raise ValueError("a job can't have fewer than no reducers")

    def plan(self, spark: SparkSession) -> DataFrame:
        rows = lines(spark, self.inputs)
        if self.job:
            return run_job_columns(self.job, rows)
        done = run_user_job(rows, self.map_fn, self.reduce_fn)
        return done.select(done.key.cast("string").alias("key"), done.result.cast("string").alias("result"))


def run_job(spark: SparkSession, job: Job, root: str) -> str:
    """Run a job and write root/res-<id>; its folder. A missing input, an existing result or a failing task is an error."""
    results = job.plan(spark)
    reducers = job.reducers or auto_reducers(lines(spark, job.inputs).rdd.getNumPartitions())
    spark.sparkContext.setJobGroup(job.id, f"{job.job or 'user functions'} over {', '.join(job.inputs)}")
    try:
        return write_results(results, root, job.id, reducers)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def progress(spark: SparkSession, job_id: str) -> tuple[int, int]:
    """Tasks of a job that are done, and all that its stages so far have; from any thread, while or after it runs."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [info for j in tracker.getJobIdsForGroup(job_id) if (info := tracker.getJobInfo(j))]
    stages = [info for s in {s for j in jobs for s in j.stageIds} if (info := tracker.getStageInfo(s))]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
