"""Graphs and background jobs by number: the service surface as a Python API."""

from __future__ import annotations

import itertools
import logging
import threading
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphloom import __version__
from graphloom.graph import GraphError, PropertyGraph
from graphloom.operators import components as _components
from graphloom.operators import propagate as _propagate
from graphloom.operators import rank as _rank
from graphloom.operators.custom import custom as _custom
from graphloom.plans.superstep import Cancelled
from graphloom.runtime import Scratch
from graphloom.sources import readers, sinks

log = logging.getLogger("graphloom")
API_VERSION = (1, 1)


class LastLines(logging.Handler):
    """The last lines of the log, for ``Engine.logs``."""

    def __init__(self, lines: int = 1000):
        super().__init__()
        self.lines: deque[str] = deque(maxlen=lines)
        self.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))


@dataclass
class Job:
    """A computation in the background. ``progress`` reaches ``total`` when it ends well."""

    id: int
    kind: str
    total: int
    graph_id: int
    graph: PropertyGraph | None = None
    progress: int = 0
    error: str | None = None
    result: object = None
    frame: DataFrame | None = None
    steps: int | None = None
    started: float = field(default_factory=time.monotonic)
    runtime: float | None = None
    stop: threading.Event = field(default_factory=threading.Event)
    future: Future | None = None

    def info(self) -> dict:
        seconds = self.runtime if self.runtime is not None else time.monotonic() - self.started
        return {"job_id": self.id, "comp_type": self.kind, "graph_id": self.graph_id, "total": self.total, "progress": self.progress, "error": self.error is not None, "error_message": self.error or "", "runtime_in_microseconds": int(seconds * 1e6), "steps": self.steps}

    @property
    def done(self) -> bool:
        return self.future is not None and self.future.done()

    def report(self, steps: int, of: int | None = None) -> None:
        """Progress after some steps, of so many at most (if that is known); the last point is for the end."""
        self.progress = min(self.total - 1, steps if of is None else self.total * steps // max(of, 1))

    def wait(self, timeout: float | None = None) -> Job:
        self.future.exception(timeout)
        return self


class Engine:
    """A registry of graphs and jobs over one session. Numbers start at 1."""

    def __init__(self, spark: SparkSession, workers: int = 4):
        self.spark = spark
        self._graphs: dict[int, PropertyGraph] = {}
        self._jobs: dict[int, Job] = {}
        self._next_graph, self._next_job = itertools.count(1), itertools.count(1)
        self._lock = threading.Lock()
        self._pool = ThreadPoolExecutor(workers, thread_name_prefix="graphloom")
        self._counts = {"jobs_started": 0}
        self._log = LastLines()
        log.addHandler(self._log)
        if log.level == logging.NOTSET:
            log.setLevel(logging.INFO)

    # -- the service itself

    def version(self) -> dict:
        return {"version": __version__, "api_min_version": API_VERSION[0], "api_max_version": API_VERSION[1]}

    def statistics(self) -> dict:
        with self._lock:
            return {"graphs": len(self._graphs), "jobs": len(self._jobs), **self._counts}

    def logs(self) -> list[str]:
        return list(self._log.lines)

    def shutdown(self) -> None:
        for job in self.jobs():
            self.cancel(job["job_id"])
        self._pool.shutdown(wait=True, cancel_futures=True)
        log.removeHandler(self._log)

    # -- graphs

    def register(self, graph: PropertyGraph) -> int:
        with self._lock:
            number = next(self._next_graph)
            self._graphs[number] = graph
        return number

    def graph(self, graph_id: int) -> PropertyGraph:
        with self._lock:
            if graph_id not in self._graphs:
                raise KeyError(f"no graph {graph_id}")
            graph = self._graphs[graph_id]
        if graph is None:
            raise GraphError(f"graph {graph_id} is not loaded yet")
        return graph

    def graph_info(self, graph_id: int) -> dict:
        g = self.graph(graph_id)
        return {"graph_id": graph_id, "number_of_vertices": g.vertex_count, "number_of_edges": g.edge_count, "memory_usage": g.memory_bytes()}

    def graphs(self) -> list[dict]:
        with self._lock:
            ids = [i for i, g in self._graphs.items() if g is not None]
        return [self.graph_info(i) for i in ids]

    def drop_graph(self, graph_id: int) -> None:
        """Forget a graph; jobs on it keep their own reference."""
        self.graph(graph_id).unpersist()
        with self._lock:
            del self._graphs[graph_id]

    def dump_graph(self, graph_id: int) -> None:
        self.graph(graph_id).show()

    # -- jobs

    def job(self, job_id: int) -> Job:
        with self._lock:
            if job_id not in self._jobs:
                raise KeyError(f"no job {job_id}")
            return self._jobs[job_id]

    def jobs(self) -> list[dict]:
        with self._lock:
            jobs = list(self._jobs.values())
        return [j.info() for j in jobs]

    def cancel(self, job_id: int) -> None:
        """Stop a job: between supersteps, and its running Spark jobs at once."""
        job = self.job(job_id)
        job.stop.set()
        self.spark.sparkContext.cancelJobGroup(f"graphloom-{id(self)}-{job_id}")

    def drop_job(self, job_id: int) -> None:
        """Forget a job, stop it if it still runs, and delete its written tables."""
        self.cancel(job_id)
        with self._lock:
            job = self._jobs.pop(job_id)
        if job.done and hasattr(job.result, "scratch"):
            job.result.scratch.close()

    def wait(self, job_id: int) -> Job:
        """A job once it has ended; its error is raised."""
        job = self.job(job_id).wait()
        if job.error:
            raise GraphError(job.error)
        return job

    def results(self, job_id: int, ids: list | None = None) -> DataFrame:
        """A finished job's result, of some vertices or all."""
        job = self.wait(job_id)
        if job.frame is None:
            raise GraphError(f"job {job_id} has no results")
        return job.frame if ids is None else job.frame.where(job.frame["id"].isin(ids))

    def _start(self, kind: str, total: int, graph_id: int, graph: PropertyGraph | None, work: Callable[[Job], None]) -> Job:
        with self._lock:
            job = Job(next(self._next_job), kind, total, graph_id, graph)
            self._jobs[job.id] = job
            self._counts["jobs_started"] += 1

        def run() -> None:
            sc = self.spark.sparkContext
            sc.setJobGroup(f"graphloom-{id(self)}-{job.id}", kind, interruptOnCancel=True)
            job.started = time.monotonic()
            try:
                if job.stop.is_set():
                    raise Cancelled("cancelled")
                work(job)
                job.progress = job.total
                log.info("job %s (%s) finished", job.id, kind)
            except Exception as e:
                job.error = "cancelled" if job.stop.is_set() else f"{type(e).__name__}: {e}"
                log.warning("job %s (%s) failed: %s", job.id, kind, job.error[:300])
            finally:
                job.runtime = time.monotonic() - job.started

        job.future = self._pool.submit(run)
        return job

    def _compute(self, kind: str, total: int, graph_id: int, call: Callable[[PropertyGraph, Job], tuple[object, DataFrame, int | None]]) -> int:
        graph = self.graph(graph_id)

        def work(job: Job) -> None:
            job.result, job.frame, job.steps = call(graph, job)

        return self._start(kind, total, graph_id, graph, work).id

    def _load(self, make: Callable[[], PropertyGraph]) -> tuple[int, int]:
        graph_id = self.register(None)

        def work(job: Job) -> None:
            graph = make()
            job.report(1)
            if job.stop.is_set():
                raise Cancelled("cancelled")
            graph = graph.persist()
            with self._lock:
                self._graphs[graph_id] = graph
            job.graph = graph

        return self._start("", 2, graph_id, None, work).id, graph_id

    def load(self, **request) -> tuple[int, int]:
        """(job, graph) numbers; see ``readers.load``."""
        return self._load(lambda: readers.load(self.spark, **request))

    def load_sql(self, vertex_query: str, edge_query: str, **more) -> tuple[int, int]:
        return self._load(lambda: readers.from_sql(self.spark, vertex_query, edge_query, **more))

    def wcc(self, graph_id: int) -> int:
        def call(g, job):
            c = _components.weakly_connected_components(g, job.stop.is_set, job.report)
            return c, c.members, None

        return self._compute("WCC", 100, graph_id, call)

    def scc(self, graph_id: int) -> int:
        def call(g, job):
            c = _components.strongly_connected_components(g, cancelled=job.stop.is_set, report=job.report)
            return c, c.members, None

        return self._compute("SCC", 100, graph_id, call)

    def aggregate_components(self, graph_id: int, job_id: int, aggregation_attribute: str) -> int:
        before = self.job(job_id)
        if before.kind not in ("WCC", "SCC"):
            raise GraphError("aggregation needs a job that computed components")

        def call(g, job):
            before.wait()
            if before.error:
                raise GraphError(before.error)
            out = _components.aggregate_components(before.result, aggregation_attribute)
            return out, out.withColumnRenamed("representative", "id"), None

        return self._compute("ComponentsAggregation", 1, graph_id, call)

    def pagerank(self, graph_id: int, maximum_supersteps: int = 10, damping_factor: float = 0.85) -> int:
        def call(g, job):
            r = _rank.page_rank(g, maximum_supersteps, damping_factor, job.stop.is_set, lambda n: job.report(n, maximum_supersteps))
            return r, r.ranks, r.steps

        return self._compute("pagerank", 100, graph_id, call)

    def irank(self, graph_id: int, maximum_supersteps: int = 10, damping_factor: float = 0.85) -> int:
        def call(g, job):
            r = _rank.i_rank(g, maximum_supersteps, damping_factor, cancelled=job.stop.is_set, report=lambda n: job.report(n, maximum_supersteps))
            return r, r.ranks, r.steps

        return self._compute("irank", 100, graph_id, call)

    def linerank(self, graph_id: int, maximum_supersteps: int = 10, damping_factor: float = 0.85) -> int:
        def call(g, job):
            r = _rank.line_rank(g, maximum_supersteps, damping_factor, job.stop.is_set, lambda n: job.report(n, maximum_supersteps))
            return r, r.ranks, r.steps

        return self._compute("linerank", 100, graph_id, call)

    def labelpropagation(self, graph_id: int, start_label_attribute: str, synchronous: bool = False, random_tiebreak: bool = False, maximum_supersteps: int = 0, seed: int = 1) -> int:
        def call(g, job):
            most = maximum_supersteps or _propagate.DEFAULT_SUPERSTEPS
            r = _propagate.label_propagation(g, start_label_attribute, most, synchronous, random_tiebreak, seed, cancelled=job.stop.is_set, report=lambda n: job.report(n, most))
            return r, r.labels, r.steps

        return self._compute("Label Propagation", 100, graph_id, call)

    def attributepropagation(self, graph_id: int, start_label_attribute: str, synchronous: bool = False, backwards: bool = False, maximum_supersteps: int = 0) -> int:
        if not start_label_attribute:
            raise GraphError("a start label attribute is needed")

        def call(g, job):
            r = _propagate.attribute_propagation(g, start_label_attribute, maximum_supersteps or None, backwards, synchronous, job.stop.is_set, lambda n: job.report(n, maximum_supersteps or None))
            return r, r.labels, r.steps

        return self._compute("Attribute Propagation", 100, graph_id, call)

    def custom(self, graph_id: int, function: Callable, mode: str = "local", result_type: str = "double") -> int:
        def call(g, job):
            out = _custom(g, function, mode, result_type)
            job.report(1)
            out = Scratch(self.spark, "custom").table(out, "results")  # so that a failing function fails the job, and runs once
            return out, out, None

        return self._compute("Custom", 3, graph_id, call)

    def store(self, job_ids: list[int], attribute_names: list[str], target_collection: str = "targetCollection", fmt: str = "parquet", mode: str = "update") -> int:
        if len(job_ids) != len(attribute_names):
            raise GraphError("as many attribute names as jobs are needed")
        sources = [self.job(j) for j in job_ids]

        def work(job: Job) -> None:
            frames = [self.results(s.id) for s in sources]
            job.report(1)
            if job.stop.is_set():
                raise Cancelled("cancelled")
            sinks.store(frames, attribute_names, target_collection, fmt, mode)

        return self._start("Store Operation", 2, 0, None, work).id
