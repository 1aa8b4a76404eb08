"""What the corpus operators share: words, saved intermediate tables, bounded broadcasts."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from types import ModuleType
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkbi.session import checkpoint_dir

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Paths of the intermediate tables of this driver.
SAVED: list[str] = []
TABLES: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from its files.

    Cuts the lineage, so lost executors cost only re-reads, and fixes values that would
    depend on a sample or on task order. Meant for narrow rows; the folder is scratch space
    of the application, and ``clear_saved`` empties it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    SAVED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_in_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder as a table bucketed by ``key``; grouping it by ``key`` moves no row again.

    The rows are not shuffled to be written either: a task writes a file for each bucket that its rows fall
    into, so ``key`` should take few values in a task.
    """
    spark = df.sparkSession
    name = f"saved_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{name}"
    SAVED.append(path)
    TABLES.append(name)
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def clear_saved(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far and say how many; call it once their results are written."""
    cleared = 0
    while TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {TABLES.pop()}")
    while SAVED:
        path = spark._jvm.org.apache.hadoop.fs.Path(SAVED.pop())
        cleared += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return cleared


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column) -> Column:
    """Words of a text in order; none for null, empty or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def broadcast_if(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast ``df`` when its counted ``rows`` stay within ``bound``; join it by shuffle beyond."""
    return F.broadcast(df) if rows <= bound else df


RUN = 100_000


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Every row ``times`` times (0 drops it); no list of more than ``RUN`` entries is ever built."""
    numbered = df.withColumn("_times", times.cast("long"))
    runs = numbered.where("_times > 0").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_times") - 1), F.lit(RUN).cast("long"))))
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_times") - F.col("_run"), F.lit(RUN).cast("long"))))
    return runs.withColumn("_one", one).drop("_times", "_run", "_one")


def join_classes(rows: DataFrame, classes: DataFrame, key: str, share: float = 0.005) -> DataFrame:
    """Inner join on ``key`` where ``classes`` has one row per key and counts its rows in ``n``.

    A key with ``share`` of all rows or more would fill one task, so such keys, 1 / share at
    most, are joined by broadcast and only the others by shuffle.
    """
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") >= max(1, share * total)
    by_broadcast = F.broadcast(classes.where(heavy).drop("n"))
    many = rows.join(by_broadcast, key)
    few = rows.join(by_broadcast.select(key), key, "left_anti").join(classes.where(~heavy).drop("n"), key)
    return many.unionByName(few)


def per_worker(name: str, key: Any, make: Callable[[], Any]) -> Any:
    """Make a value once per Python worker process and reuse it in later tasks; one value per name is kept."""
    store = sys.modules.setdefault("_sparkbi_per_worker", ModuleType("_sparkbi_per_worker")).__dict__
    if store.get(name, (None,))[0] != key:
        store[name] = (key, make())
    return store[name][1]


def ship_by_value(module: str) -> None:
    """Send a module's task code with the job, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_by_value(__name__)
