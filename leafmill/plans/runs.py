"""Records, progress and limits of runs on one cluster."""

from __future__ import annotations

import contextlib
import hashlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from leafmill.session import exists

#: Commands that change documents and so exclude each other.
CHANGING = frozenset({"convert", "scrub"})


@dataclass
class Run:
    """What is known of a run."""

    command: str
    key: str = ""
    group: str = field(default_factory=lambda: uuid.uuid4().hex)
    started: float = field(default_factory=time.monotonic)
    done: int = 0
    total: int | None = None
    stop: threading.Event = field(default_factory=threading.Event)

    def stopping(self) -> bool:
        """Whether the run was asked to end after the part it is at."""
        return self.stop.is_set()

    def eta(self) -> float | None:
        """Seconds that are left at the pace so far."""
        if not self.done or self.total is None:
            return None
        return (time.monotonic() - self.started) / self.done * (self.total - self.done)


def conflicts(a: Run, b: Run) -> bool:
    """Whether two runs must not go on at once: the same command on the same key, or both change documents."""
    return (a.command, a.key) == (b.command, b.key) or (a.command in CHANGING and b.command in CHANGING)


def reports(step: int, last_report: float, now: float, pause: float = 60.0) -> bool:
    """Whether to report a step: at Fibonacci numbers, or when the last report is older than the pause."""
    a, b = 1, 2
    while b < step:
        a, b = b, a + b
    return step in (1, a, b) or now - last_report >= pause


class Runs:
    """Runs of one application; a second one that conflicts is refused."""

    def __init__(self) -> None:
        self.active: list[Run] = []
        self.lock = threading.Lock()

    def begin(self, run: Run) -> Run:
        with self.lock:
            if any(conflicts(run, other) for other in self.active):
                raise RuntimeError(f"{run.command} {run.key} is running")
            self.active.append(run)
        return run

    def end(self, run: Run) -> None:
        with self.lock:
            self.active.remove(run)

    def cancel(self, spark: SparkSession, command: str, key: str = "", hard: bool = False) -> int:
        """Ask runs to end after the part they are at or, ``hard``, at once; returns how many there were."""
        with self.lock:
            chosen = [r for r in self.active if (r.command, r.key) == (command, key)]
        for run in chosen:
            run.stop.set()
            if hard:
                spark.sparkContext.cancelJobGroup(run.group)
        return len(chosen)

    def status(self, spark: SparkSession) -> DataFrame:
        """``command, key, seconds, done, total, eta, stopping`` of the active runs."""
        with self.lock:
            rows = [(r.command, r.key, time.monotonic() - r.started, r.done, r.total, r.eta(), r.stopping()) for r in self.active]
        return spark.createDataFrame(rows, "command string, key string, seconds double, done long, total long, eta double, stopping boolean")


@contextlib.contextmanager
def exclusive(spark: SparkSession, folder: str, run: Run, stale: float = 6 * 3600) -> Iterator[None]:
    """Hold the lock of a run among all applications that share ``folder``; where another holds it, raise.

    The lock is a file that the file system creates only once. One older than
    ``stale`` seconds was left by an application that died, and is taken over.
    """
    name = "changing" if run.command in CHANGING else f"{run.command}-{run.key}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{hashlib.sha256(name.encode()).hexdigest()}.lock")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path.getParent())
    if system.exists(path) and time.time() - system.getFileStatus(path).getModificationTime() / 1000 > stale:
        system.delete(path, False)
    if not system.createNewFile(path):
        raise RuntimeError(f"{run.command} {run.key} is running elsewhere")
    try:
        yield
    finally:
        system.delete(path, False)


def in_parts(spark: SparkSession, run: Run, parts: int, do: Callable[[int], object], mark: str) -> bool:
    """Do ``parts`` parts of a run one after the other, and remember each that is done at the path ``mark``.

    A run that was stopped or broke off goes on behind the last part that was
    done; one that ends takes the mark away.  Returns whether it ended.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(mark)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = "part int, parts int"
    # Another division into parts begins anew.
    last = spark.read.schema(schema).parquet(mark).where(F.col("parts") == parts).agg(F.max("part")).first()[0] if exists(spark, mark) else None
    run.total, run.done = parts, 0 if last is None else last + 1
    while run.done < parts:
        if run.stopping():
            return False
        do(run.done)
        spark.createDataFrame([(run.done, parts)], schema).coalesce(1).write.mode("append").parquet(mark)
        run.done += 1
    system.delete(path, True)
    return True


def guarded(spark: SparkSession, run: Run, action: Callable[[], object], limit: float) -> object:
    """Do an action as one job group that is cancelled when no task has ended for ``limit`` seconds."""
    context = spark.sparkContext
    stop = threading.Event()

    def watch() -> None:
        seen, since = -1, time.monotonic()
        tracker = context.statusTracker()
        while not stop.wait(min(1.0, limit / 4)):
            stages = [s for j in tracker.getJobIdsForGroup(run.group) if (job := tracker.getJobInfo(j)) for i in job.stageIds if (s := tracker.getStageInfo(i))]
            ended = sum(s.numCompletedTasks for s in stages)
            if ended != seen:
                seen, since = ended, time.monotonic()
            elif time.monotonic() - since > limit:
                context.cancelJobGroup(run.group)
                return

    watcher = threading.Thread(target=watch, daemon=True)
    context.setJobGroup(run.group, run.command, interruptOnCancel=True)
    watcher.start()
    try:
        return action()
    finally:
        stop.set()
        context.setLocalProperty("spark.jobGroup.id", None)


class ProgressListener(StreamingQueryListener):
    """Keeps the rows and duration of each streaming batch."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
