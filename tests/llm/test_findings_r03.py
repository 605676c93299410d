"""What the findings of round 3 were about, in the training-data operators."""

import glob

import pyarrow.parquet as pq

from urbanlattice.llm import lexical


def test_blocks_are_read_in_small_groups(spark, tmp_path, monkeypatch):
    """A reader holds a row group whole: their size must not go with the task's file."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 2)
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('word', id) AS text").coalesce(1)
    lexical.index(docs, str(tmp_path / "blocks"))
    (path,) = glob.glob(str(tmp_path / "blocks" / "*.parquet"))
    meta = pq.ParquetFile(path).metadata
    assert meta.num_rows == 100
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= lexical.GROUP_BLOCKS


def test_strays_beside_a_large_component_cost_no_square_of_it(spark):
    """A bucket of 2,000 members of one component and 40 others: members of the large one aren't dealt to each other, yet every
    two of different components meet."""
    from pyspark.sql import functions as F

    from urbanlattice.llm import neardup as N

    n, strays = 2000, 40
    at = spark.range(n + strays).select(F.lit(7).cast("long").alias("key"), "id", F.when(F.col("id") < n, F.lit(0)).otherwise(F.col("id")).cast("long").alias("comp"), F.array(F.lit(0).cast("long")).alias("sketch"))
    at = at.select("*", F.lit(0).cast("long").alias("main"), F.lit(8).alias("first"), F.lit(1).alias("rest"))
    rows = N.blocked(at).collect()
    assert len(rows) <= n + strays * 9
    tasks = {}
    for r in rows:
        tasks.setdefault((r["lo"], r["hi"]), []).append(r)
    met = {(min(i["id"], j["id"]), max(i["id"], j["id"])) for (lo, hi), rs in tasks.items() for i in rs if i["mine"] == lo for j in rs if j["mine"] == hi and i["comp"] != j["comp"]}
    assert met == {(i, j) for j in range(n, n + strays) for i in range(j)}
