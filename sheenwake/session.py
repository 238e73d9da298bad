"""Session settings and lineage cutting shared by the multi-round operators."""
from __future__ import annotations

import functools
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "sheenwake", **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; extra settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may fall back to its own.

    On a cluster the setting is required: a machine-local folder dies with its executor.
    """
    global _own_folder
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="sheenwake-")
        folder = _own_folder
    return folder


_own_folder: str | None = None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table survives lost executors, keeps plans of multi-round jobs short, is read by
    column, and its known size lets small ones be broadcast. It also drops the derived
    constraints that a checkpointed frame carries along and that grow with every round.
    """
    path = os.path.join(_shared_folder(df.sparkSession), f"cut-{uuid.uuid4().hex}")
    if _scopes():
        _scopes()[-1].append(path)
    with _without_leftovers(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting by which the files of a query's shuffles go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the queries run inside are deleted as each ends: what it wrote stands in its table.

    They would otherwise stay on the executors' disks until the driver collects garbage, so a job of
    many rounds would keep the shuffles of all rounds.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: By thread; a plain dict, since code that reaches workers by value takes it along.
_open: dict[int, list[list[str]]] = {}


def _scopes() -> list[list[str]]:
    """Paths of the tables written by this thread, a list for each open ``written``."""
    return _open.setdefault(threading.get_ident(), [])


@contextmanager
def kept() -> Iterator[None]:
    """Tables written inside outlive a surrounding ``written``."""
    _scopes().append([])
    try:
        yield
    finally:
        _scopes().pop()


def written(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, written; the tables it wrote on the way are deleted.

    Nothing that reads one of those may be used afterwards. To a surrounding call the table is one written on the way.
    """
    scopes = _scopes()
    scopes.append([])
    out = None
    try:
        out = cut_lineage(make())
    finally:
        made = scopes.pop()
        for path in made if out is None else made[:-1]:
            _delete(path)
    if scopes:
        scopes[-1].append(made[-1])
    return out


def writes_once(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``step``, whose result is written and whose other tables are deleted."""
    return functools.wraps(step)(lambda *args, **options: written(lambda: step(*args, **options)))


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it, whatever the size of its files says.

    Pixels and rows exploded from small ones are thousands of times their files, by whose size
    Spark takes them for small tables.
    """
    return df.hint("merge")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Spread small rows with much work each over all tasks.

    The explicit number keeps the size-based coalescing from gathering them again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)
