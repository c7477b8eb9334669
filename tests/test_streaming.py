from tessera.streaming import ingest


def test_each_request_is_written_once(spark, tmp_path):
    rows = [(1, "OWASP", "http://x", None, "<p>a</p>"), (2, "NIST", None, "text", None), (3, "NIST", None, None, None)]
    spark.createDataFrame(rows, ingest.SCHEMA).write.parquet(f"{tmp_path}/in")
    for more in ([], [(4, "BAD", None, "t", None)]):
        if more:
            spark.createDataFrame(more, ingest.SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = {r.page_id: (r.status, r.content) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (202, "a"), 2: (202, "text"), 3: (400, None), 4: (422, None)}
