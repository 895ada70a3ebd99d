"""What runs keep and drop: the slot map from run to run, and the tables of one run alone."""

from __future__ import annotations

import threading

import pytest
from test_llm import as_dir, frame

from docloom.llm import common, sharding


def test_the_next_run_edits_the_kept_map(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    docs = frame(spark, ["x" * (i % 90) for i in range(3000)])
    placed, first = sharding.shard_by_bytes(docs, 8, map_path=path)
    before = {(r.doc_id, r.vslot): r.shard for r in placed.collect()}
    assert sharding.load_map(spark, path) == first and len(first.versions) == 2
    _, same = sharding.shard_by_bytes(docs, 8, map_path=path)
    assert same == first == sharding.load_map(spark, path)  # nothing to move, no version
    grown = docs.unionByName(frame(spark, ["y" * 500] * 400, list(range(3000, 3400))))
    placed, second = sharding.shard_by_bytes(grown, 8, map_path=path)
    assert second.versions[:2] == first.versions and len(second.versions) == 3 and sharding.load_map(spark, path) == second
    moved = sum(a != b for a, b in zip(first.current, second.current))
    assert 0 < moved < len(first.current) / 2
    after = {(r.doc_id, r.vslot): r.shard for r in placed.collect()}
    assert all(after[k] == second.current[k[1]] for k in after) and all(first.current[v] == s for (_, v), s in before.items())
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs, 9, map_path=path)


def test_the_query_keeps_its_map_where_told(spark, tmp_path):
    d = as_dir(tmp_path, documents=frame(spark, ["a" * i for i in range(200)]))
    spark.conf.set("spark.docloom.slotmap", f"file://{tmp_path}/slots")
    try:
        versions = [sharding.op10_fixed_slots(spark, d).select("map_version").first()[0] for _ in range(2)]
    finally:
        spark.conf.unset("spark.docloom.slotmap")
    assert versions == [len(sharding.load_map(spark, f"file://{tmp_path}/slots").versions) - 1] * 2


def test_a_run_drops_its_own_tables_alone(spark):
    rows, seen = spark.range(3), {}

    def other():
        common.made()
        seen["other"] = [common.stored(rows, "other") for _ in range(2)]

    run = common.made()
    where = common.stored(rows, "mine").inputFiles()[0]
    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    last = common.stored(rows, "mine")
    common.drop_all_but_last(spark, run)
    assert last.count() == 3 and all(t.count() == 3 for t in seen["other"]) and len(run) == 1
    assert not common.exists(spark, where)
