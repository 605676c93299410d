"""What the findings of round 4 were about, in the training-data operators."""

from urbanlattice.llm import url_lm


def test_grams_of_urls_are_never_broadcast_by_their_files_size(spark, monkeypatch):
    """URLs' file is small, their grams are some fifty times as many rows: an estimate from the file sent them all to the driver."""
    joined, join = [], url_lm.spread_join
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (limit, measured)}

    def spy(*args):
        joined.append(join(*args))
        return joined[-1]

    monkeypatch.setattr(url_lm, "spread_join", spy)
    pages = spark.range(40).selectExpr("id AS page_id", "concat('https://m.example.', if(id % 2 = 0, 'org/fr/', 'net/en/'), id) AS url")
    try:
        spark.conf.set(limit, "10m")
        spark.conf.unset(measured)
        assert url_lm.judge(pages).count() == 40
        assert "BroadcastHashJoin" not in joined[0]._jdf.queryExecution().sparkPlan().toString()
        assert spark.conf.get(measured) == "10m"  # what came out small is broadcast as before
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
