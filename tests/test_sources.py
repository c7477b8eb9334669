import pytest
from pyspark.sql import functions as F

from tessera.functions import llmjson
from tessera.sources import plugins, sink


def test_plugins(spark):
    d = spark.createDataFrame([(1, "Use TLS: encrypt all traffic\nnothing here\nRotate: keys"), (2, None), (3, "")], "id int, text string")
    r = llmjson.requirements(plugins.extract(d)).orderBy("id", "ord").collect()
    assert [(x.id, x.title, x.actionable_rule) for x in r] == [(1, "Use TLS", "encrypt all traffic"), (1, "Rotate", "keys")]
    v = {x.id: x.embedding for x in plugins.embed(d).collect()}
    assert len(v[1]) == 768 and abs(sum(a * a for a in v[1]) - 1) < 1e-5 and v[2] is None and not any(v[3])
    assert plugins.summarise(d, "text").filter(F.col("summary").isNotNull()).count() == 2


def test_binary_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\ftwo")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    got = {(r.path.rpartition("/")[2], r.page_no, r.text, bool(r.error)) for r in plugins.binary_pages(spark, str(tmp_path), lambda b: b.decode().split("\f")).collect()}
    assert got == {("a.bin", 0, "one", False), ("a.bin", 1, "two", False), ("b.bin", None, None, True)}


def test_versions(spark, tmp_path):
    p = str(tmp_path / "t")
    assert sink.commit(spark.range(3), p) == 1 and sink.commit(spark.range(5), p) == 2
    assert sink.read(spark, p).count() == 5 and sink.read(spark, p, 1).count() == 3
    with pytest.raises(Exception):
        sink.commit(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")), p)
    assert sink.versions(spark, p) == [1, 2] and len(list((tmp_path / "t").iterdir())) == 2
