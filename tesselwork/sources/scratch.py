"""Tables that cut lineage: written once to the folder that driver and executors share, then read back.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where a session on a local master names none
(unit tests, a laptop) a folder of its own is made; a cluster without one is an error, not a folder that only the
driver sees. A written table survives the loss of any executor and is scanned
with column pruning. Later plans know it by the size of its files, which are compressed: sized() says which joins may
broadcast it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
MOST_BROADCAST = 250_000  # rows of a few columns: about 10 MB, Spark's own limit, at 40 bytes a hashed row
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session; a new temporary one only where the session names none."""
    root = spark.conf.get(_KEY, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tesselwork-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet below the shared folder and return the table read back with its declared schema."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tesselwork/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that written() returned and that nothing reads any more. What was made from them must be
    written itself: a plan that still reads one fails."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path and (t.sparkSession, path) in _made:
            _made.remove((t.sparkSession, path))
            _delete(t.sparkSession, path)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, as a side of joins: hinted to shuffle where a broadcast would hold too many. Spark
    goes by the size of compressed files, and a hashed row in the driver's memory takes several times its share of them."""
    return df.hint("merge") if rows > MOST_BROADCAST else df


def compacted(whole: DataFrame, parts: list[DataFrame], tag: str, most: int = 8) -> tuple[DataFrame, list[DataFrame]]:
    """A union that grows by a written table a round: after ``most`` parts it is written as one, and the parts go, so
    that neither a plan nor the number of files grows with the rounds."""
    if len(parts) < most:
        return whole, parts
    out = written(whole, tag)
    release(*parts)
    return out, [out]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(spark: SparkSession) -> None:
    """Delete the tables that this process wrote for the session. DataFrames that read them end here."""
    for one in [x for x in _made if x[0] is spark]:
        _made.remove(one)
        try:
            _delete(*one)
        except Exception:  # the session may be gone already; the cluster's own clean-up takes over
            return


@atexit.register
def _drop_all() -> None:
    for spark in {id(s): s for s, _ in _made}.values():
        drop(spark)
