"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "_lodestone_shipped"
MAX_BROADCAST_ROWS = 200_000
_SCOPES: list[list[Scratch]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each SparkContext.

    Python workers import functions by module name, and a worker on another
    machine doesn't have the driver's ``sys.path``.
    """
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"lodestone-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    setattr(sc, _SHIPPED, True)


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Only a local session without that
    setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    return "file:///tmp/checkpoints"


class Scratch:
    """Intermediate tables of one operator call, in the shared folder.

    A table written here cuts lineage: a lost executor costs the tasks that
    run, not the stages before. ``drop`` removes a table that nothing reads
    any more; what is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
        atexit.register(self._quiet_drop)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for n in names:
            self._delete(self.path(n))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _quiet_drop(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the JVM may have gone first; the folder is only scratch
            pass


@contextmanager
def dropped_after() -> Iterator[None]:
    """Drops the scratch tables that operators make inside, once their results are written."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for scratch in _SCOPES.pop():
            scratch.drop("")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def maybe_broadcast(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint if the table has at most ``max_rows`` (narrow) rows.

    Beyond the bound the join stays a shuffle join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bounded_broadcast(df: DataFrame, lists: str, max_rows: int = 300_000, max_elements: int = 1_000_000) -> DataFrame:
    """A broadcast hint if rows and the elements of a list column are few."""
    rows, elements = df.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and elements <= max_elements else df


def even_join(left: DataFrame, right: DataFrame, keys: str | list[str], weight: str, total: int, most: int = 5_000, how: str = "inner") -> DataFrame:
    """Inner or left join on keys that are unique in ``right``, without hot keys.

    ``right[weight]``: the rows of ``left`` with the key, ``total`` in all. Keys
    with at least ``total / most`` rows are at most ``most``, so they are
    broadcast at any size; the others are too rare to weigh on one task.
    """
    names = [keys] if isinstance(keys, str) else keys
    is_hot = F.col(weight) * most >= F.lit(max(total, 1))
    hot = F.broadcast(right.where(is_hot))
    rest = left.join(F.broadcast(right.where(is_hot).select(*names)), names, "left_anti").join(right.where(~is_hot), names, how)
    return left.join(hot, names).unionByName(rest)


def unique_join(left: DataFrame, right: DataFrame, keys: str | list[str], weight: str, total: int, n_right: int, how: str = "inner") -> DataFrame:
    """``left`` with ``right``, unique by key: broadcast while it is small, else ``even_join``."""
    if n_right <= MAX_BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    return even_join(left, right, keys, weight, total, how=how)


def slices(column, rows: int = 1000) -> Iterator:
    """A column in pieces of a few rows, so that Python copies stay small."""
    for k in range(0, len(column), rows):
        yield column.slice(k, rows)


def small_batches(batches: Iterator, rows: int = 500) -> Iterator:
    """Batches in pieces of a few rows, so that Python copies stay small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives freed memory back at the end of its task.

    Workers live on between tasks and stages; without this the pools keep
    what the largest stage took.
    """

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # no glibc
            pass

    return run


def byte_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
