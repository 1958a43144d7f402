"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder that lineage cuts and streaming sinks write to."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "scrubline") -> SparkSession:
    """Local session for tests and the bench (a cluster passes its own session)."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or max(cpus * 2, 8)
    spark = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SCRUBLINE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The setting is read from the session. Only a local session may do without
    it and gets a folder of its own (tests); on a cluster a folder of one machine
    would lose files, so an unset option raises RuntimeError.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="scrubline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for Python workers that were started
    elsewhere: unless PYTHONPATH or the working folder hold it, it goes along as
    a zip file (what ``--py-files`` does)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and os.path.realpath(p) == os.path.realpath(root) for p in known) or getattr(spark.sparkContext, "_scrubline_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="scrubline-zip-"), "scrubline")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "scrubline"))
    spark.sparkContext._scrubline_shipped = True


_LEASE: ContextVar[list | None] = ContextVar("scrubline_lease", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local on a
    cluster). Within :func:`leased` it belongs to that lease."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/scrubline/{name}-{uuid.uuid4().hex[:12]}"
    held = _LEASE.get()
    if held is not None:
        held.append(path)
    return path


@contextmanager
def leased(spark: SparkSession) -> Iterator[list]:
    """Scratch folders taken inside are removed at the end, also after an error.
    Results that still read them must be written before. Leases nest: an inner one
    removes its own folders only."""
    held: list[str] = []
    token = _LEASE.set(held)
    try:
        yield held
    finally:
        _LEASE.reset(token)
        for path in held:
            remove(spark, path)


def _file_system(spark: SparkSession, path: str):
    """(Hadoop file system of a path, the path): the store that Spark itself reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder of the same store; the target must not be there yet."""
    fs, at = _file_system(spark, source)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if to.getParent() is not None:
        fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(at, to):
        raise FileExistsError(f"cannot move {source} to {target}")
