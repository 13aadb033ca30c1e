"""The narrow operators also run unchanged on a streaming DataFrame."""

from cootensor import operators as op


def test_lag_expand_and_sparsify_on_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(0, h, float(h)) for h in range(5)], "e int, h int, product double") \
        .write.parquet(str(src))
    stream = spark.readStream.schema("e int, h int, product double").parquet(str(src))
    out = op.sparsify(op.lag_expand(stream, "h", 2), 0.5)
    q = (out.writeStream.format("memory").queryName("lagged").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from lagged").collect()
    assert len(rows) == 8                            # h = 1..4, two lags each
    assert {r.lag for r in rows} == {0, 1}
