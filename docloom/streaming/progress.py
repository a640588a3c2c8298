"""Progress of a long piece of work, and a way to stop it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from docloom.config import Config
from docloom.sources.tables import BUCKETS

from .jobs import store

#: A step's name and the share of the whole, in percent, at which it begins. Fixed values.
STEPS = (("pages", 0), ("chunks", 10), ("commit", 95))


class Cancelled(Exception):
    """The work was stopped before it took effect."""


class Watch:
    """Runs work whose Spark jobs have a tag of their own.

    report is called with a step's name and the percentage done, which never falls: of a step's
    share as much as of its tasks that Spark knows of are done, 100 at the end. ``cancel`` may be
    called from any thread, report itself included: running jobs are stopped by the tag, and the
    next step isn't begun.
    """

    def __init__(self, spark: SparkSession, report: Callable[[str, int], None] = lambda name, percent: None, steps=STEPS, every: float = 0.1):
        self.context, self.report, self.every = spark.sparkContext, report, every
        self.tag = f"docloom-{uuid.uuid4().hex}"
        self.spans = {name: (start, stop - start) for (name, start), stop in zip(steps, [*(s for _, s in steps[1:]), 100], strict=True)}
        self.stopped = threading.Event()
        self.name, self.percent, self.before = steps[0][0], -1, 0

    def cancel(self) -> None:
        self.stopped.set()
        self.context.cancelJobsWithTag(self.tag)

    def step(self, name: str) -> None:
        if self.stopped.is_set():
            raise Cancelled(name)
        self.before, self.name = self._tasks()[0], name
        self._tell(self.spans[name][0])
        if self.stopped.is_set():
            raise Cancelled(name)

    def _tasks(self) -> tuple[int, int]:
        """Tasks done and known of all jobs so far."""
        tracker, done, known = self.context.statusTracker(), 0, 0
        for job in self.context._jsc.sc().statusTracker().getJobIdsForTag(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    done, known = done + s.numCompletedTasks, known + s.numTasks
        return done, known

    def _tell(self, percent: int) -> None:
        if percent > self.percent:
            self.percent = percent
            self.report(self.name, percent)

    def run(self, work: Callable[[Callable[[str], None]], None]) -> None:
        """Does work(step), which calls step with each step's name as it begins; raises what it raises, Cancelled if it was stopped."""
        failed: list[BaseException] = []

        def body() -> None:
            self.context.addJobTag(self.tag)
            try:
                work(self.step)
            except BaseException as e:
                failed.append(e)
            finally:
                self.context.removeJobTag(self.tag)

        thread = InheritableThread(target=body)
        thread.start()
        while thread.is_alive():
            thread.join(self.every)
            start, span = self.spans[self.name]
            done, known = self._tasks()
            if thread.is_alive() and known > self.before:
                self._tell(start + span * (done - self.before) // (known - self.before + 1))
        if self.stopped.is_set():
            raise Cancelled(self.name) from (failed[0] if failed else None)
        if failed:
            raise failed[0]
        self._tell(100)


def ingest_watched(watch: Watch, spark: SparkSession, pages: DataFrame, number: int, out: str, config: Config = Config(), buckets: int = BUCKETS) -> None:
    """``jobs.store`` under a watch: stopped at any time before its commit, the store holds what it held."""
    watch.run(lambda step: store(spark, pages, number, out, config, buckets, step))
