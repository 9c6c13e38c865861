"""Task batches on Spark's scheduler: ordered results, progress, cancelling; and the statistics of timings."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Canceled(RuntimeError):
    """The run was cancelled before all its tasks ended."""


class Tasks:
    """A queue of functions that run as tasks of Spark; results keep their order.

    Without workers all run as one job, as many at once as the cluster has
    cores. With workers at most that many run at once, a job each: a worker
    takes the next task when it has ended one.
    """

    def __init__(self, spark: SparkSession, workers: int | None = None):
        if workers is not None and workers < 1:
            raise ValueError("a pool has one worker at least")
        self.spark, self.sc, self.queue, self.workers = spark, spark.sparkContext, [], workers
        self.cancelled: set[str] = set()

    def add(self, task: Callable[[], object]) -> None:
        """Queues a task; nothing starts."""
        self.queue.append(task)

    def on_idle(self) -> list:
        """Runs what is queued."""
        tasks, self.queue = self.queue, []
        return self.run(tasks)

    def run(self, tasks: Sequence[Callable[[], object]], progress: Callable[[int, int], None] | None = None, tag: str | None = None) -> list:
        """All results in order. progress hears (done, all) as the stages report; a failing task fails the run."""
        if not tasks:
            return []
        tag, sc = tag or f"run-{uuid.uuid4().hex}", self.sc
        if self.workers:
            return self._pooled(tasks, progress, tag)
        done, heard = threading.Event(), [0]

        def watch() -> None:
            while not done.wait(0.05):
                jobs = sc.statusTracker().getJobIdsForGroup(tag)
                stages = [s for j in jobs if (i := sc.statusTracker().getJobInfo(j)) for s in i.stageIds]
                n = sum(i.numCompletedTasks for s in stages if (i := sc.statusTracker().getStageInfo(s)))
                if n > heard[0]:
                    heard[0] = n
                    progress(n, len(tasks))

        watcher = threading.Thread(target=watch, daemon=True) if progress else None
        if watcher:
            watcher.start()
        sc.addJobTag(tag)
        sc.setJobGroup(tag, f"{len(tasks)} tasks")
        try:
            out = sc.parallelize(list(enumerate(tasks)), len(tasks)).map(lambda x: (x[0], x[1]())).collect()
        except Exception as e:
            if "cancel" in str(e).lower():
                raise Canceled("Remaining tasks canceled") from e
            raise
        finally:
            sc.removeJobTag(tag)
            sc.setLocalProperty("spark.jobGroup.id", None)
            done.set()
            if watcher:
                watcher.join()
        if progress and heard[0] < len(tasks):
            progress(len(tasks), len(tasks))
        return [r for _, r in sorted(out, key=lambda x: x[0])]

    def _pooled(self, tasks: Sequence[Callable[[], object]], progress: Callable[[int, int], None] | None, tag: str) -> list:
        out, lock, left, failed, done = [None] * len(tasks), threading.Lock(), list(enumerate(tasks))[::-1], [], [0]

        def work() -> None:
            self.sc.addJobTag(tag)
            try:
                while True:
                    with lock:
                        if failed or tag in self.cancelled or not left:
                            return
                        i, task = left.pop()
                    found = self.sc.parallelize([task], 1).map(lambda t: t()).collect()[0]
                    with lock:
                        out[i] = found
                        done[0] += 1
                        if progress:
                            progress(done[0], len(tasks))
            except Exception as e:  # noqa: BLE001  told to the caller below
                with lock:
                    failed.append(e)
            finally:
                self.sc.removeJobTag(tag)

        threads = [threading.Thread(target=inheritable_thread_target(self.spark)(work), daemon=True) for _ in range(min(self.workers, len(tasks)))]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        if tag in self.cancelled:
            self.cancelled.discard(tag)
            raise Canceled("Remaining tasks canceled") from (failed[0] if failed else None)
        if failed:
            raise failed[0]
        return out

    def cancel(self, tag: str) -> None:
        """Stops a run: its tasks that haven't begun never begin."""
        if self.workers:
            self.cancelled.add(tag)
        self.sc.cancelJobsWithTag(tag)


def timing_stats(times: DataFrame, *by: str, value: str = "ms") -> DataFrame:
    """mean, median, min, max and population deviation of each group."""
    v = F.col(value)
    return times.groupBy(*by).agg(F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("stddev"))


def speedups(stats: DataFrame, base: str, by: str = "operation", variant: str = "variant") -> DataFrame:
    """Each variant's median against the base variant's, of the same operation."""
    plain = stats.where(F.col(variant) == base).select(F.col(by), F.col("median").alias("base"))
    return stats.join(plain, by).select(by, variant, (F.col("base") / F.col("median")).alias("speedup"))


def timed(work: Callable[[], object], warm_up: int = 2, runs: int = 5) -> list[float]:
    """Milliseconds of each run after the warm-up."""
    out = []
    for k in range(warm_up + runs):
        t = time.perf_counter()
        work()
        if k >= warm_up:
            out.append((time.perf_counter() - t) * 1000)
    return out
