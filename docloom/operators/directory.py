"""Directory slots with left, right and child pointers: references, cycles, reachability and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTERS = ("left", "right", "child")


def pointer_rows(slots: DataFrame) -> DataFrame:
    """(source, kind, target) of each pointer that is set."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("target")) for k in POINTERS))
    return slots.select(F.col("slot").alias("source"), F.inline(kinds)).filter("target is not null")


def incoming(slots: DataFrame) -> DataFrame:
    """Each slot with its number of incoming references, and of those from anomalous slots."""
    states = slots.select(F.col("slot").alias("source"), "state")
    refs = pointer_rows(slots).join(states, "source").groupBy(F.col("target").alias("slot")).agg(
        F.count("*").alias("refs"), F.count_if(F.col("state") != "normal").alias("bad_refs"))
    return slots.join(refs, "slot", "left").na.fill(0, ["refs", "bad_refs"])


def cycles_of_two(slots: DataFrame) -> DataFrame:
    """(a, b, bucket), a < b: slots that point at one another; by kinds sibling, child or mixed."""
    p = pointer_rows(slots)
    back = p.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("kind").alias("back"))
    both = p.join(back, ["source", "target"]).filter("source < target")
    siblings = F.col("kind").isin("left", "right").cast("int") + F.col("back").isin("left", "right").cast("int")
    bucket = F.when(siblings == 2, "sibling").when(siblings == 0, "child").otherwise("mixed")
    return both.select(F.col("source").alias("a"), F.col("target").alias("b"), bucket.alias("bucket")).distinct()


def cycles_of_three(slots: DataFrame) -> DataFrame:
    """(a, b, c) with a the smallest: a points at b, b at c and c at a."""
    p = pointer_rows(slots).select("source", "target").distinct()
    ab = p.select(F.col("source").alias("a"), F.col("target").alias("b"))
    bc = p.select(F.col("source").alias("b"), F.col("target").alias("c"))
    ca = p.select(F.col("source").alias("c"), F.col("target").alias("a"))
    return ab.join(bc, "b").join(ca, ["c", "a"]).filter("a < b and a < c and b <> c").select("a", "b", "c")


def reached(start: DataFrame, hops: DataFrame, store, stride: int = 4) -> DataFrame:
    """(slot) of all slots reached from ``start`` over ``hops`` (source, target).

    A round is a chain of ``stride`` joins; each joins the slots of the hop before alone, whose exchange it shares. ``store``
    writes what is new with the first hop that met it, and the next round begins with what only the last hop met.
    """
    seen = store(start.distinct())
    front = seen
    while True:
        steps = []
        for n in range(1, stride + 1):
            front = front.join(hops, F.col("slot") == F.col("source")).select(F.col("target").alias("slot")).distinct()
            steps.append(front.withColumn("hop", F.lit(n)))
        met = reduce(DataFrame.unionByName, steps).groupBy("slot").agg(F.min("hop").alias("hop"))
        new = store(met.join(seen, "slot", "left_anti"))
        seen = seen.unionByName(new.select("slot"))
        front = new.filter(F.col("hop") == stride).select("slot")
        if front.isEmpty():
            return seen


def cycle_tags(slots: DataFrame) -> DataFrame:
    """(slot, tag): ``sibling-``, ``child-`` or ``mixed-2-cycle`` and ``-3-cycle`` of each slot that lies on one.

    A cycle is of the first pointer's kind if a pointer that closes it is of that kind (any pointer closes a child's
    3-cycle), and mixed if kinds differ.
    """
    p = pointer_rows(slots).select("source", "target", F.when(F.col("kind") == "child", "child").otherwise("sibling").alias("bucket"), "kind")
    q = p.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("kind").alias("k2"), F.col("bucket").alias("b2"))
    two = p.join(q, "target").filter("next = source")
    r = q.select(F.col("target").alias("next"), F.col("next").alias("source"), F.col("k2").alias("k3"), F.col("b2").alias("b3"))
    three = p.join(q, "target").join(r, ["next", "source"])
    same = lambda rows, cond, n: rows.filter(cond).select(F.col("source").alias("slot"), F.concat("bucket", F.lit(f"-{n}-cycle")).alias("tag"))
    mixed = lambda rows, cond, n: rows.filter(cond).select(F.col("source").alias("slot"), F.lit(f"mixed-{n}-cycle").alias("tag"))
    found = [
        same(two, "bucket = b2", 2), mixed(two, "kind <> k2", 2),
        same(three, "bucket = 'child' or b3 = 'sibling'", 3), mixed(three, "kind <> k2 or kind <> k3", 3),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


# The tags of high and of low severity; all others are medium.
SEVERITY = {
    "high": (
        "sibling-2-cycle", "child-2-cycle", "sibling-3-cycle", "child-3-cycle", "mixed-2-cycle", "mixed-3-cycle", "incoming-from-anomalous-entry",
        "dangling-left-sibling", "dangling-right-sibling", "dangling-child", "self-left-sibling", "self-right-sibling", "self-child", "invalid-start-sector",
    ),
    "low": ("free-slot", "zero-name-length", "unreferenced-live-entry"),
}
NAMES = {"left": "left-sibling", "right": "right-sibling", "child": "child"}
NO_SECTOR, END_SECTOR = 0xFFFFFFFF, 0xFFFFFFFE


def tags(slots: DataFrame, reachable: DataFrame, sectors: int) -> DataFrame:
    """(slot, tag) of all entry, reference and cycle anomalies. ``slots`` has name_length, size and start too, and
    ``reachable`` (slot) are those that the root leads to; the number of slots is one more than the largest."""
    count = F.broadcast(slots.agg((F.max("slot") + 1).alias("slot_count")))  # one row
    rows = incoming(slots).join(reachable.select("slot", F.lit(True).alias("reached")), "slot", "left").crossJoin(count)
    when = lambda cond, tag: F.when(cond, F.lit(tag))
    live = (F.col("state") == "normal") & (F.col("entry_type") != "root-storage")
    known = (F.col("state") != "free") & (F.col("entry_type") != "unknown")
    found = F.array_compact(F.array(
        when(F.col("state") == "free", "free-slot"), when(F.col("state") == "orphaned", "orphaned-entry"), when(F.col("entry_type") == "unknown", "unknown-entry-type"),
        when((F.col("state") != "free") & (F.col("name_length") == 0), "zero-name-length"),
        when(known & (F.col("size") > 0) & ~F.col("start").isin(NO_SECTOR, END_SECTOR) & (F.col("start") >= sectors), "invalid-start-sector"),
        *(when(F.col(k) >= F.col("slot_count"), f"dangling-{NAMES[k]}") for k in POINTERS), *(when(F.col(k) == F.col("slot"), f"self-{NAMES[k]}") for k in POINTERS),
        when(live & (F.col("refs") == 0), "unreferenced-live-entry"), when(F.col("refs") > 1, "multi-referenced-entry"),
        when(live & F.col("reached").isNull(), "unreachable-live-entry"), when(F.col("bad_refs") > 0, "incoming-from-anomalous-entry"),
    ))
    return rows.select("slot", F.explode(found).alias("tag")).unionByName(cycle_tags(slots))


def tag_severity(tag):
    return F.when(tag.isin(*SEVERITY["high"]), "high").when(tag.isin(*SEVERITY["low"]), "low").otherwise("medium")
