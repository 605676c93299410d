"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


#: Bytes of compressed tables that one shuffle partition stands for: whole-number columns grow some thirtyfold as geometries.
TABLE_BYTES = 1 << 20
#: Bytes of a method that the virtual machine compiles at most: longer ones of generated code would be interpreted, row by row.
COMPILED = 8000
#: Shuffle partitions before adaptive execution packs them, at most.
MOST_PARTITIONS = 4000


def measured_joins(spark: SparkSession, sf_dir: str) -> SparkSession:
    """Joins broadcast by what a side was measured to have, never by an estimate from its files.

    A compressed file of small numbers is taken for a small table, however large its geometries and cells are in memory. Joins
    are planned as shuffles instead, and adaptive execution turns those into broadcasts whose side came out below the
    session's limit. Shuffles start with partitions in proportion to the tables, so that a task's share doesn't grow with
    them. Expressions over vertices make long methods, which run by parts instead. Joins are planned when a query runs, so that
    these settings outlive the call."""
    conf = spark.conf
    limit = conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit != "-1":
        conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", limit))
        conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    at = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED))
    # pairs of geometries take few bytes and much work: small partitions are packed by cores, not up to a megabyte each
    conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(min(MOST_PARTITIONS, max(int(conf.get("spark.sql.shuffle.partitions")), size // TABLE_BYTES))))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``. Unset, local mode gets a temporary folder; a cluster gets an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.gettempdir()
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: loops keep short plans and survive lost executors."""
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``cut`` wrote of tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "cut_path", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores: what follows costs far more than moving it.

    A scan of enough splits stays as it is. What comes out of exchanges is dealt out anew: adaptive execution would pack it by
    its bytes, and to ask it for its partitions would run all its stages while the plan is made. Rows that were dealt out and
    only had columns added since, stay."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter", "Generate"):
        plan = plan.children().head()
    if plan.nodeName() == "Repartition":
        return df
    n = spark.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
