"""Session helpers: table access, lineage cuts in shared storage, bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes up to which a small side may be broadcast, and the part of the driver's heap that it may take; larger sides are shuffled.
BROADCAST_BYTES = 64 * 2**20
_HEAP_SHARE = 16
#: Bytes that a broadcast row takes besides its fields: its header, its pointer, its places in a hash table that is at most half full.
_ROW_BYTES = 64
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[list[Kept]] = []
_roots: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        home = Path(__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='ledgerlark-')}/{home.name}", "zip", home.parent, home.name)
        atexit.register(shutil.rmtree, Path(made).parent, ignore_errors=True)
        spark.sparkContext.addPyFile(made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates, below the cluster's spark.checkpoint.dir.

    Where a local session names none (tests) a temporary folder is set once; a cluster must name a folder that all its machines share.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
            root = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
            spark.sparkContext.setCheckpointDir(root)
        _roots[app] = f"{root.rstrip('/')}/ledgerlark-{uuid.uuid4().hex[:12]}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:
        pass


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are deleted as each ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Kept:
    """A DataFrame written to shared storage, so that its lineage is cut and lost executors cost nothing."""

    def __init__(self, df: DataFrame, partition_by: tuple[str, ...] = ()):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex[:12]}"
        with _shuffles_removed(self.spark):
            df.write.partitionBy(*partition_by).parquet(self.path) if partition_by else df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _made:
            _made[-1].append(self)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage and read it back."""
    return Kept(df).df


def finished(build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build``, written to shared storage; what was written there on the way is dropped."""
    _made.append([])
    try:
        out = Kept(build())
    finally:
        made = _made.pop()
    for k in made:
        if k is not out:
            k.drop()
    if _made:
        _made[-1].append(out)
    return out.df


def _width(field: T.StructField) -> Column | int:
    """Bytes of a field, or an expression for them where they vary."""
    if isinstance(field.dataType, _FIXED):
        return 8
    c = F.col(f"`{field.name}`")
    return 16 + F.coalesce(F.octet_length(c if isinstance(field.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c))), F.lit(0))


def fits(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the fields of ``df`` measure no more than ``limit`` bytes, and a broadcast of it what the driver has room for. ``rows``: its number, if known."""
    room = min(BROADCAST_BYTES, df.sparkSession.sparkContext._jvm.Runtime.getRuntime().maxMemory() // _HEAP_SHARE)
    widths = [_width(f) for f in df.schema.fields]
    fixed, varying = sum(w for w in widths if isinstance(w, int)), [w for w in widths if not isinstance(w, int)]
    if rows is not None and not varying:
        size = rows * fixed
    else:
        row = sum(varying, F.lit(fixed))
        with _shuffles_removed(df.sparkSession):
            size, rows = df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0)), F.count("*")).first()
    return size <= limit and size + rows * _ROW_BYTES <= room


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if it ``fits``; otherwise leave it to a shuffle join."""
    return F.broadcast(df) if fits(df, rows, limit) else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name
