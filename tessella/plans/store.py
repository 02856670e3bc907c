"""Tables that cut lineage: written to the shared folder, then read again.

A written table survives the loss of any executor, and is a column store, so
that a later step reads only what it needs.  The folder is the one which the
session names in ``spark.checkpoint.dir``; only where that is unset and the
master is local (tests) a temporary folder of this machine is set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a writing task gathers before it writes a row group; these tables are read once or twice.
BLOCK = 16 << 20

_LIVE: dict[str, SparkSession] = {}
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration() if hasattr(spark, "_jsc") else spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The intermediate tables of one query, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str = "scratch"):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        _LIVE[self.root] = spark

    def keep(self, df: DataFrame, *partitions: str) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        writer = df.write.option("compression", "zstd").option("parquet.block.size", BLOCK)
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessella_path = path
        return out

    def bucketed(self, df: DataFrame, buckets: int, *keys: str, then: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> DataFrame:
        """Writes ``df`` as a table bucketed and sorted by ``keys``, one file a bucket, and returns it; a join by these keys moves only its other side.

        ``then`` may gather rows of equal keys, which lie together by then.
        """
        path, name = f"{self.root}/{self.made}", f"tessella_{uuid.uuid4().hex[:16]}"
        self.made += 1
        _TABLES.setdefault(self.root, []).append(name)
        dealt = then(df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).sortBy(*keys)
        dealt.option("compression", "zstd").option("parquet.block.size", BLOCK).option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that :meth:`keep` returned, once nothing reads it."""
        path = getattr(df, "_tessella_path", None)
        if path:
            _delete(self.spark, path)


def release(spark: SparkSession | None = None) -> None:
    """Deletes all intermediate tables; call it once the results are written."""
    for root, session in list(_LIVE.items()):
        if spark is None or session is spark:
            try:
                for name in _TABLES.pop(root, []):
                    session.sql(f"DROP TABLE IF EXISTS {name}")
                _delete(session, root)
            except Exception:  # the session may have ended already
                pass
            _LIVE.pop(root, None)


atexit.register(release)
