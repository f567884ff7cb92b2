import pytest
from pyspark.sql import functions as F

from plumbline.sources.store import Conflict, Store, load_pair, refresh_inventory, upsert_day

KIND = "id string, price double, currency string, title string"


def test_two_days_are_applied_and_versions_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    day = lambda rows, now: upsert_day(store, spark.createDataFrame(rows, KIND), ["id"], ["price", "currency", "title"], now, [F.col("title")])
    one = [("a", 1.0, "USD", "x"), ("b", 2.0, "USD", "y"), ("c", 3.0, "USD", "z")]
    assert day(one, "2024-01-01") == {"insert": 3, "touch": 0, "update": 0, "keep": 0, "snapshots": 3}
    got = day([("a", 1.0, "USD", "x"), ("b", 5.0, "USD", "y"), ("d", 4.0, "USD", None)], "2024-01-02")
    assert (got["insert"], got["touch"], got["update"], got["snapshots"]) == (1, 1, 1, 2)
    rows = {r.id: (r.price, str(r.first_seen)[:10], str(r.last_seen)[:10], r.active) for r in store.read("listings").collect()}
    assert rows == {"a": (1.0, "2024-01-01", "2024-01-02", True), "b": (5.0, "2024-01-01", "2024-01-02", True), "c": (3.0, "2024-01-01", "2024-01-01", True), "d": (4.0, "2024-01-02", "2024-01-02", True)}
    assert sorted((r.id, r.price) for r in store.read("snapshots").collect()) == [("a", 1.0), ("b", 2.0), ("b", 5.0), ("c", 3.0), ("d", 4.0)]
    assert store.read("listings", 1).count() == 3
    with pytest.raises(Conflict):
        store.commit(1)
    assert store.version() == 2


def test_inventory_is_unpublished_only_by_full_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    kind = "id string, owner string, price double, published boolean"

    def send(rows, now, full, scope=None):
        return refresh_inventory(store, spark.createDataFrame(rows, kind), ["id"], ["owner", "price", "published"], now, [F.col("price")], full, scope)

    def held(version=None):
        return {r.id: (r.price, r.published, str(r.last_seen)[:10]) for r in store.read("inventory", version).collect()}

    first = [("a", "x", 1.0, True), ("a", "x", 2.0, True), ("b", "x", 1.0, True), ("c", "y", 1.0, True), ("d", "x", 1.0, False), ("e", "x", 1.0, None)]
    assert send(first, "2024-01-01", False) == {"created": 5, "updated": 0, "unchanged": 0, "unpublished": 0, "kept": 0}
    assert held()["a"] == (2.0, True, "2024-01-01")  # the last by order
    got = send([("a", "x", 2.0, True)], "2024-01-02", False)
    assert got["unchanged"] == 1 and got["unpublished"] == 0 and len(held()) == 5
    got = send([("a", "x", 3.0, True), ("f", "x", 1.0, True)], "2024-01-03", True, F.col("owner") == "x")
    assert got == {"created": 1, "updated": 1, "unchanged": 0, "unpublished": 2, "kept": 2}
    assert held() == {
        "a": (3.0, True, "2024-01-03"), "b": (1.0, False, "2024-01-03"), "c": (1.0, True, "2024-01-01"), "d": (1.0, False, "2024-01-01"),
        "e": (1.0, False, "2024-01-03"), "f": (1.0, True, "2024-01-03"),
    }
    assert held(1)["b"] == (1.0, True, "2024-01-01")
    # An empty full batch takes the rest of its scope off; nothing is deleted.
    assert send([], "2024-01-04", True, F.col("owner") == "x")["unpublished"] == 2 and len(held()) == 6


def test_a_repeated_load_adds_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    load = lambda ids: load_pair(store, spark.createDataFrame([(i, 1.0) for i in ids], "k string, price double"), spark.createDataFrame([(i, 2) for i in ids], "k string, rooms int"), ["k"])
    assert load(["a", "b", "b", None]) == 3
    assert load(["a", "b", None]) == 0 and store.version() == 1
    assert load(["b", "c"]) == 1 and store.version() == 2
    listings, features = store.read("historical"), store.read("historical_features")
    assert listings.count() == features.count() == listings.join(features, "listing_id").count() == 4


def test_a_dead_writer_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    day = lambda rows, now: upsert_day(store, spark.createDataFrame(rows, KIND), ["id"], ["price", "currency", "title"], now, [F.col("title")])
    for n in range(1, 4):
        day([("a", float(n), "USD", "x")], f"2024-01-0{n}")
    # Data folders and a manifest that was never renamed, as of a writer that died.
    store.stage(spark.createDataFrame([("z", 9.0, "USD", "x")], KIND), ["id"])
    (tmp_path / "s" / "versions" / ".half").write_text("{")
    assert store.version() == 3 and [r.price for r in store.read("listings").collect()] == [3.0]
    assert store.vacuum(keep=2) == 2  # the first day's listings and what the dead writer left
    assert [r.price for r in store.read("listings", 2).collect()] == [2.0]
    assert sorted(r.price for r in store.read("snapshots").collect()) == [1.0, 2.0, 3.0]
    assert day([("a", 3.0, "USD", "x")], "2024-01-05")["touch"] == 1 and store.version() == 4
