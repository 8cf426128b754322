"""Where intermediate tables go: the folder every machine of the cluster sees."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, as in tests on one machine, a folder of its own. A cluster without the setting raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
    own = tempfile.mkdtemp(prefix="lw-shared-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    What was computed once is then fixed, and a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lw-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame, each: int = 4 << 20) -> int:
    """Tasks for a shuffle of what ``df`` reads: one per ``each`` bytes of its files, one per core at least.

    Given to ``repartition`` it keeps a task's memory the same while the input grows. Rows without files have no size and do not count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(b for b in sizes if b < 1 << 50) // each))
