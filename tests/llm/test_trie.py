"""The prefix trie against brute force and its SQL, with few and many shards."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_llm import as_dir

from docloom.llm import trie
from rows import rows

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_paths(said):
    own = collections.defaultdict(list)
    for c, turn, role, text in said:
        if c is not None:
            pair = (role or "", text or "")
            key = hashlib.md5(f"{len(pair[0].encode())}:{pair[0]}{pair[1]}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, pair))
    own = {c: tuple(t[3] for t in sorted(v)) for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, ())[:h] + turns[h:]
    return out


def brute_nodes(paths):
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(own) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if paths[c] == path)
        above = min(members[path[:-1]]) if path else None
        out.append((min(own), len(path), above, len(own), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_turns(seed, n=150):
    r = random.Random(seed)
    said = [(c, t, r.choice(["user", "assistant"]), r.choice(["hi", "go on", "", "né"])) for c in range(n) for t in range(r.randint(1, 7))]
    said += [(c, t, "user", "the same") for c in range(1000, 1090) for t in range(12)]  # copies: more than a shard
    said += [(2000, t, "user", "t%d" % (t % 50)) for t in range(700)]  # one conversation of many turns
    said += [(3000 + i, 0, "system", "first") for i in range(60)] + [(3000 + i, 1, "user", f"x{i}") for i in range(60)]
    said += [(None, 0, "user", "nobody's")] * 3 + [(4, None, None, None), (4, None, "a", None), (4, 0, "b", "c"), (4, 0, "b", "c"), (4, 0, "b", "d"), (5, 1, "", "")]
    r.shuffle(said)
    return said


@pytest.mark.parametrize("shard_rows", [5, 40, trie.SHARD_ROWS])
def test_against_brute_force(spark, tmp_path, shard_rows, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    said = some_turns(shard_rows)
    paths = trie.rebuilt(trie.paths_of(spark.createDataFrame(said, SCHEMA).withColumn("path", F.lit(1)).repartition(3)))
    got = trie.prefix_trie(paths, shard_rows).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == brute_nodes(brute_paths(said))


def test_same_as_sql(spark, sf, duck):
    assert rows(trie.op13_prefix_trie(spark, sf).toPandas()) == rows(duck.sql(trie.OP13_SQL).df())


def test_odd_tables_same_as_sql(spark, tmp_path):
    import duckdb

    d = as_dir(tmp_path, conversations=spark.createDataFrame(some_turns(9, 60), SCHEMA).coalesce(1))
    con = duckdb.connect()
    import glob

    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{glob.glob(d + '/conversations.parquet/*.parquet')[0]}'")
    assert rows(trie.op13_prefix_trie(spark, d).toPandas()) == rows(con.sql(trie.OP13_SQL).df())


def test_skeleton():
    a, b, c = b"a" * 16, b"b" * 16, b"c" * 16
    cuts = trie.splitters([(a, 1), (a + b, 2), (a + b, 3), (a + b, 4), (a + b + a, 5), (c, 6)], 6)
    assert cuts == [(a + b, -(1 << 63)), (a + b, 3), (a + b, 4), (a + b + a, -(1 << 63)), (c, -(1 << 63))]
    kept = trie.Skeleton(cuts)
    assert kept.parents == [-1, 0, 1, 2, 0] and kept.nodes == [[0, 1, 2], [0, 1, 2], [0, 1, 2], [0, 1, 2, 3], [0, 4]]
    assert [kept.of_shard(*x) for x in ((b"", 9), (a + b, 2), (a + b, 3), (a + b, 9), (b, 0), (c + a, 0))] == [0, 1, 2, 3, 4, 5]


def test_nothing(spark):
    assert trie.prefix_trie(trie.rebuilt(trie.paths_of(spark.createDataFrame([], SCHEMA)))).collect() == []
