"""Keyed tables: upserts, deletes, and two writers at once."""

from concurrent.futures import ThreadPoolExecutor

from tessera.sources import sink


def test_upsert_and_delete(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda ids, v: spark.createDataFrame([(i, f"{v}{i}") for i in ids], "id long, v string").coalesce(1)
    assert sink.files(spark, path) == []
    assert [sink.upsert(make(range(10 * k, 10 * k + 10), "a"), path, ["id"]) for k in range(3)] == [1, 2, 3]
    before = sink.files(spark, path)
    assert len(before) == 3
    assert sink.upsert(make([5, 99], "b"), path, ["id"]) == 4
    after = sink.files(spark, path)
    assert set(before[1:]) < set(after) and before[0] not in after  # only the file with a touched key is another
    want = {i: f"a{i}" for i in range(30)} | {5: "b5", 99: "b99"}
    assert {r.id: r.v for r in sink.read_keyed(spark, path).collect()} == want and sink.read_keyed(spark, path).count() == 31
    assert sink.delete(make([7, 25, 1000], "x"), path, ["id"]) == 5
    assert {r.id for r in sink.read_keyed(spark, path).collect()} == set(want) - {7, 25}
    assert {r.id: r.v for r in sink.read_keyed(spark, path, 3).collect()} == {i: f"a{i}" for i in range(30)}  # earlier versions stay


def test_two_writers(spark, tmp_path):
    """Both want the next version; one begins again, and no row of either is lost."""
    path = str(tmp_path / "t")
    make = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v string").coalesce(1)
    sink.upsert(make(range(6), "old"), path, ["id"])
    with ThreadPoolExecutor(3) as pool:
        got = sorted(pool.map(lambda k: sink.upsert(make([k, 10 + k], f"w{k}"), path, ["id"]), range(3)))
    assert got == [2, 3, 4]
    assert {r.id: r.v for r in sink.read_keyed(spark, path).collect()} == {0: "w0", 1: "w1", 2: "w2", 3: "old", 4: "old", 5: "old", 10: "w0", 11: "w1", 12: "w2"}
    assert sink.read_keyed(spark, path).count() == 9
