"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path: the 16-byte digests of its turns, (role, text) each, in order. Paths are sorted over shards.
The borders of the shards, the splitters, are cut from a sample of paths, each as short as tells it from the path before
it; where paths are equal the conv_id goes on, so that a group of copies of any size is spread over shards. A node whose
conversations lie in more than one shard is a prefix of a splitter. The trie of all splitters, the skeleton, is broadcast:
each shard finishes all other nodes in one pass over its sorted paths, and gives of each skeleton node what it adds to it.
These sums are reduced by node, and the skeleton, of as many nodes as the splitters have turns, is finished bottom-up.

The sample draws ``PER_SHARD`` paths a shard by hash, and a shard is at most about ``SHARD_ROWS`` paths, whatever the
table's size. A shard holds one path, the open nodes above it, and finished nodes until their parent is closed. Of a
conversation one task gathers the digests and byte counts of its turns, never their texts. The ids of the conversations
that end at a skeleton node travel as blocks of ``BLOCK`` ids, in order.

Nulls: a null role or text is an empty one, a null turn comes first; turns without a conv_id belong to no conversation
and are left out. Ties: turns of equal number stand by their digests. Repeated rows are repeated turns. Texts of any
length count whole. Further columns are not looked at, whatever their names. Empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARD_ROWS = 1 << 17
PER_SHARD = 16
BLOCK = 1 << 14
DIGEST = 16
NODES = (
    "skeleton int, above int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, size long, shard int, block int, ends binary"
)
_LEAST = -(1 << 63)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common at their beginning."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    x, y = (np.frombuffer(p, np.uint64, 2 * n) for p in (a, b))
    return int(np.argmax(x != y)) // 2


class Skeleton:
    """The trie of the splitters of sorted (path, conv_id), node 0 its root; parents have smaller numbers than children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.parents = [-1]
        self.nodes: list[list[int]] = []  # of each splitter: the nodes of its prefixes, the root first
        path, own = b"", [0]
        for cut, _ in splitters:
            own = own[: shared_turns(path, cut) + 1]
            while len(own) <= len(cut) // DIGEST:
                self.parents.append(own[-1])
                own = [*own, len(self.parents) - 1]
            self.nodes.append(own)
            path = cut

    def of_shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def borders(self, shard: int) -> list[tuple[bytes, list[int]]]:
        """The splitters on both sides of a shard: of the skeleton, only their prefixes occur in it."""
        return [(self.splitters[i][0], self.nodes[i]) for i in (shard - 1, shard) if 0 <= i < len(self.splitters)]


def splitters(sample: Iterable[tuple[bytes, int]], shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 borders that cut the sampled (path, conv_id) evenly."""
    rows, cuts = sorted(sample), []
    for k in range(1, shards):
        i = k * len(rows) // shards
        if i == 0:
            continue
        (before, _), (path, conv_id) = rows[i - 1], rows[i]
        cut = (path, conv_id) if path == before else (path[: DIGEST * (shared_turns(before, path) + 1)], _LEAST)
        if not cuts or cut > cuts[-1]:
            cuts.append(cut)
    return cuts


class _Open:
    """A node on the way to the path at hand; ``skeleton`` is its number there, or -1."""

    __slots__ = ("children", "ends", "held", "leaves", "least", "n", "saved", "size", "skeleton", "waiting")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.size = skeleton, size
        self.n = self.children = self.leaves = self.saved = self.held = 0
        self.least = 1 << 63
        self.ends = None  # a running digest, or of a skeleton node the ids of the block at hand
        self.waiting: list[list] = []  # finished children, until the smallest member is known


def shard_nodes(rows: Iterable[tuple[int, bytes, list[int]]], skeleton: Skeleton, shard: int) -> Iterator[list]:
    """Rows of ``NODES`` from one shard's (conv_id, path, sizes), sorted by path and conv_id: its own nodes whole, of
    skeleton nodes what the shard adds (``block`` null) and blocks of the ids that end there."""
    borders, stack, last = skeleton.borders(shard), [_Open(0, 0)], b""
    done: list[list] = []

    def give_ends(node: _Open) -> None:
        done.append([node.skeleton, None, None, None, None, None, None, None, None, None, None, shard, node.held, ",".join(map(str, node.ends)).encode()])
        node.held, node.ends = node.held + 1, None

    def close() -> None:
        node, depth = stack.pop(), len(stack) - 1
        above = stack[-1] if stack else None
        if node.skeleton >= 0:
            if node.ends:
                give_ends(node)
            done.append([node.skeleton, None, node.least, depth + 1, None, node.n, node.children, node.leaves, node.saved, None, node.size, shard, None, None])
        else:
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
            for child in node.waiting:
                child[4] = node.least
                done.append(child)
            ends = node.ends and node.ends.hexdigest()
            row = [None, None, node.least, depth + 1, None, node.n, node.children, leaves, saved, ends, node.size, shard, None, None]
            if above.skeleton >= 0:
                row[1] = above.skeleton
                done.append(row)
            else:
                above.waiting.append(row)
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        if above:
            above.n, above.least = above.n + node.n, min(above.least, node.least)

    for conv_id, path, sizes in rows:
        keep = shared_turns(last, path)
        while len(stack) - 1 > keep:
            close()
        if keep < len(sizes):
            tops = [(shared_turns(cut, path), nodes) for cut, nodes in borders]
            for d in range(keep + 1, len(sizes) + 1):
                stack.append(_Open(next((nodes[d] for n, nodes in tops if d <= n), -1), sizes[d - 1]))
        node = stack[-1]
        node.n, node.least = node.n + 1, min(node.least, conv_id)
        if node.skeleton < 0:
            if node.ends is None:
                node.ends = hashlib.sha256(str(conv_id).encode())
            else:
                node.ends.update(f",{conv_id}".encode())
        else:
            node.ends = node.ends or []
            node.ends.append(conv_id)
            if len(node.ends) == BLOCK:
                give_ends(node)
        last = path
        if done:
            yield from done
            done.clear()
    while stack:
        close()
    yield from done


def paths_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): the digests of each conversation's turns, joined, and the UTF-8 bytes of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("size")).alias("t")
    )
    said = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("said"))
    return said.select("conv_id", F.unhex(F.array_join("said.digest", "")).alias("path"), F.col("said.size").alias("sizes"))


def rebuilt(paths: DataFrame, group: int = 5, folds: int = 9) -> DataFrame:
    """Paths that begin with the first h turns of conversation c - c % ``group`` and go on with their own after their first
    h; h is crc32 of the decimal c modulo ``folds``."""
    paths = common.stored(paths, "paths")
    most = folds - 1  # turns taken from another conversation at most
    first = paths.filter(F.col("conv_id") % group == 0)
    heads = first.select(F.col("conv_id").alias("base"), F.substring("path", 1, DIGEST * most).alias("head"), F.slice("sizes", 1, most).alias("head_sizes"))
    own = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", common.fold_of("conv_id", folds).cast("int"))
    rows = own.join(heads, "base", "left")
    head = F.coalesce(F.substring("head", F.lit(1), F.col("h") * DIGEST), F.lit(b""))
    sizes = F.coalesce(F.slice("head_sizes", F.lit(1), F.col("h")), F.array().cast("array<int>"))
    tail = F.slice("sizes", F.col("h") + 1, F.greatest(F.size("sizes"), F.lit(1)))
    return rows.select("conv_id", F.concat(head, F.substring("path", F.col("h") * DIGEST + 1, F.octet_length("path"))).alias("path"), F.concat(sizes, tail).alias("sizes"))


def _digests(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(skeleton, ends_sha256) from blocks sorted by node: a running digest, whatever the number of ids."""
    node, running = None, None
    for batch in blocks:
        found = []
        for skeleton, ends in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if skeleton != node:
                if running:
                    found.append((node, running.hexdigest()))
                node, running = skeleton, hashlib.sha256(ends)
            else:
                running.update(b"," + ends)
        yield _pairs(found)
    if running:
        yield _pairs([(node, running.hexdigest())])


def _pairs(found: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"skeleton": pa.array([n for n, _ in found], pa.int32()), "ends_sha256": pa.array([h for _, h in found], pa.string())})


def finished(skeleton: Skeleton, sums: dict[int, tuple[int, ...]]) -> list[tuple]:
    """(skeleton, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, size) of all skeleton nodes from
    the sums (conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, size) over the shards: children come before parents."""
    added = {n: [0, 0, 0] for n in sums}
    rows = []
    for n in sorted(sums, reverse=True):
        conv_id, depth, convs, children, leaves, saved, size = sums[n]
        more = added[n]
        children, leaves, saved = children + more[0], leaves + more[1], saved + more[2] + (convs - 1) * size
        leaves += not children
        parent = skeleton.parents[n]
        if parent >= 0:
            above = added[parent]
            above[:] = above[0] + 1, above[1] + leaves, above[2] + saved
        rows.append((n, conv_id, depth, sums[parent][0] if parent >= 0 else None, convs, children, leaves, saved, size))
    return rows


def prefix_trie(paths: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of (conv_id, path, sizes): smallest member, depth, the parent's smallest member, members, children,
    leaves below, saved tokens, the digest of the members that end there, and the bytes of the last text (``size``)."""
    spark = paths.sparkSession
    paths = common.stored(paths, "trie_paths")
    n = paths.count()
    shards = max(common.partitions(spark), -(-n // shard_rows))
    part = min(1.0, PER_SHARD * shards / max(n, 1))
    sample = paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(part * (1 << 30))).select("path", "conv_id")
    skeleton = Skeleton(splitters(((bytes(r["path"]), r["conv_id"]) for r in sample.toLocalIterator()), shards))
    kept = spark.sparkContext.broadcast(skeleton)

    @F.pandas_udf("int")
    def shard_of(path: pd.Series, conv_id: pd.Series) -> pd.Series:
        return pd.Series([kept.value.of_shard(p, c) for p, c in zip(path, conv_id, strict=True)], dtype="int32")

    names = [f.name for f in spark.createDataFrame([], NODES).schema.fields]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "sizes")), strict=True)

        def nodes() -> Iterator[list]:
            source = rows()
            first = next(source, None)
            while first is not None:
                shard, rest = first[0], []

                def own(row=first, shard=shard, rest=rest) -> Iterator[tuple]:
                    while row is not None and row[0] == shard:
                        yield row[1:]
                        row = next(source, None)
                    rest.append(row)

                yield from shard_nodes(own(), kept.value, shard)
                first = rest[0]

        held: list[list] = []
        for node in nodes():
            held.append(node)
            if len(held) == 1 << 13:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    dealt = paths.withColumn("shard", shard_of("path", "conv_id")).repartitionById(len(skeleton.splitters) + 1, "shard")
    found = common.stored(dealt.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(each, NODES), "trie_nodes")
    partial = found.filter("skeleton is not null and block is null").groupBy("skeleton")
    total = lambda c: F.sum(c).alias(c)
    reduced = partial.agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"), F.max("size").alias("size"))
    sums = {r[0]: tuple(r[1:]) for r in reduced.toLocalIterator()}  # a row for each turn of a splitter at most
    top = spark.createDataFrame(
        finished(skeleton, sums), "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long"
    )
    blocks = found.filter("block is not null").select("skeleton", "shard", "block", "ends")
    digests = blocks.repartition(common.partitions(spark), "skeleton").sortWithinPartitions("skeleton", "shard", "block").mapInArrow(_digests, "skeleton int, ends_sha256 string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "size"]
    above = F.broadcast(top.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("top_conv")))
    local = found.filter("skeleton is null").join(above, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top_conv"))
    nodes = local.select(columns).unionByName(top.join(digests, "skeleton", "left").select(columns))
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first one of its group of five."""
    return prefix_trie(rebuilt(paths_of(common.table(spark, sf_dir, "conversations")))).drop("size")


OP13_SQL = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(b ORDER BY turn NULLS FIRST, k) AS bs FROM said GROUP BY conv_id),
crc AS (  -- eight steps for each decimal digit of the id
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS j, CAST(4294967295 AS BIGINT) AS c FROM own
  UNION ALL SELECT conv_id, s, j + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END
  FROM (SELECT conv_id, s, j, CASE WHEN j % 8 = 0 THEN xor(c, CAST(ascii(substr(s, j // 8 + 1, 1)) AS BIGINT)) ELSE c END AS v FROM crc WHERE j < 8 * length(s))),
fold AS (SELECT conv_id, CAST(xor(c, CAST(4294967295 AS BIGINT)) % 9 AS BIGINT) AS h FROM crc WHERE j = 8 * length(s)),
path AS (
  SELECT o.conv_id, list_concat(list_slice(coalesce(b.ks, []), 1, h), list_slice(o.ks, h + 1, len(o.ks))) AS ks,
    list_concat(list_slice(coalesce(b.bs, []), 1, h), list_slice(o.bs, h + 1, len(o.bs))) AS bs
  FROM own o JOIN fold f USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefix AS (SELECT conv_id, ks, bs, unnest(generate_series(0, len(ks))) AS d FROM path),
node AS (
  SELECT list_slice(ks, 1, d) AS k, d, min(conv_id) AS conv_id, count(*) AS n, max(CASE WHEN d = 0 THEN 0 ELSE bs[d] END) AS b,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len(ks)), '')) AS ends
  FROM prefix GROUP BY ALL),
kids AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT n.*, coalesce(c.n, 0) AS kids FROM node n LEFT JOIN kids c ON c.k = n.k),
lift AS (SELECT k, d, n, b, kids, unnest(generate_series(0, d)) AS e FROM full_node),
subtree AS (SELECT list_slice(k, 1, e) AS k, count(*) FILTER (WHERE kids = 0) AS leaves, sum((n - 1) * b) AS saved FROM lift GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.kids AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM full_node n JOIN subtree s ON s.k = n.k LEFT JOIN node p ON n.d > 0 AND p.k = list_slice(n.k, 1, n.d - 1)
"""
