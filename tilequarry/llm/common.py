"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of sessions without a configured one, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only in local mode, where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tilequarry-")
        found = _OWN[app]
    return found.rstrip("/")


#: While this is set, Spark drops a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While this is set, a task of one bucket does not sort its rows by bucket before it writes them.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Letters of a plan's description, of which the driver builds one for each change of a query and keeps the last.
_DESCRIBED = "spark.sql.maxPlanStringLength"


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, which also gives back memory that its heap has grown by: each query leaves plans, task
    results and events behind. In local mode the heap is the executors' as well and stays as it is."""
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        spark._jvm.System.gc()


def _plain(columns: Iterable[str]) -> dict[str, str]:
    """Options for columns that hardly ever repeat a value: dictionaries of them take time and are thrown away."""
    return {f"parquet.enable.dictionary#{c}": "false" for c in columns}


def materialise(df: DataFrame, name: str = "step", plain: Iterable[str] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives the loss of any executor. The
    shuffle files behind it go when it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilequarry-{name}-{uuid.uuid4().hex}"
    with _set(spark, _CLEANUP, "true"), _set(spark, _DESCRIBED, "8192"):
        df.write.options(**_plain(plain)).parquet(path)
    _tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, by: list[str], name: str = "step", plain: Iterable[str] = ()) -> tuple[DataFrame, Callable[[], None]]:
    """Like materialise(), in buckets by the columns that df is already partitioned by, so that joins on them move the
    other side only; and what to call to delete it."""
    spark = df.sparkSession
    unique = f"tilequarry_{name}_{uuid.uuid4().hex}"
    path, full = f"{shared_dir(spark)}/{unique}", f"spark_catalog.default.{unique}"
    with _set(spark, _CLEANUP, "true"), _set(spark, _DESCRIBED, "8192"), _set(spark, _WRITERS, "2"):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).option("path", path).option("parquet.dictionary.page.size", 1 << 24).options(**_plain(plain)).format("parquet").saveAsTable(full)
    _tidy(spark)

    def drop() -> None:
        spark.sql(f"DROP TABLE {full}")
        _delete(spark, path)

    return spark.table(full), drop


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise() wrote and that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def fold_key(c: str | Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the text 'null'."""
    col = F.col(c) if isinstance(c, str) else c
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("null"))), F.lit(parts))


def utf8_bytes(c: str) -> Column:
    return F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long")


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
