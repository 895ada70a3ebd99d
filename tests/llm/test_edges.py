"""The training-data operators on null and repeated ids, long texts, ties, clashing columns and empty tables, and
against brute force where a fixture is small enough for it."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, as_dir, edit_distance_in, frame, some_texts

from docloom.llm import common, decontaminate, fingerprint, lm, packing, quotes, secrets, sharding, simhash, toxicity, warc, wordhash

CLASH = ("row", "picked", "parts", "uid", "weak", "key", "fp", "text_hash", "bucket", "ahead", "copies", "size", "slot", "copy", "word", "c", "score", "tail", "piece", "grp", "item", "__id", "__cuts", "held_out", "digest", "record")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, equal texts, one very long text, columns with clashing names."""
    long = "lorem ipsum dolor token=abcdef123 " * 40_000  # 1.4 million characters
    texts = [*some_texts(12), long, "same words here", "same words here", "same words here", None, "x" * 300_000]
    ids = [*range(len(texts) - 6), 100, 100, 100, 101, None, None]
    rows = frame(spark, texts, ids)
    return rows.select("*", *(F.lit(1).alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1), (100, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (None, "lorem ipsum dolor token=abcdef123 lorem ipsum"), (3, None), (4, "")], "item_id long, text string")
    return as_dir(tmp_path_factory.mktemp("odd"), documents=odd, labels=labels.withColumn("text", F.lit(1)), benchmark=bench.withColumn("key", F.lit(2)))


@pytest.mark.parametrize("run", [lm.op1_log_bilinear, fingerprint.op2_multiset_hash, simhash.op3_simhash_bitsliced, toxicity.op6_subsequence_svm, secrets.op7_secret_links, sharding.op10_fixed_slots])
def test_a_row_for_each_row(spark, odd, tables, run):
    ids = lambda rows: collections.Counter(r["doc_id"] for r in rows.select("doc_id").collect())
    assert ids(run(spark, tables)) == ids(odd)


def test_pieces_of_odd_rows(spark, odd, tables):
    got = packing.op4_pack_ffd(spark, tables).toPandas()
    want = collections.Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    first = got[got["start"] == 0]
    assert sum(want.values()) == len(first) and set(first["doc_id"].dropna()) == set(want) - {None}
    assert got["length"].sum() == first["doc_tokens"].sum()


def test_matches_of_odd_rows(spark, tables):
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontaminate.op9_pigeonhole_edits(spark, tables).collect())
    assert (got[100, 1], got[101, 1], got[100, None]) == (4, 2, 1)  # each row with each item


@pytest.mark.parametrize("stage", cp.STAGES[:-1], ids=lambda s: s[0])
def test_stages_on_odd_rows(spark, odd, tables, stage):
    kept = stage[1](spark, odd, tables)
    assert kept.dtypes == odd.dtypes
    n = kept.count()
    assert n == odd.count() if stage[0] == "secrets" else 0 < n < odd.count() + 1
    assert stage[1](spark, odd.filter("false"), tables).count() == 0


def test_pipeline_of_nothing(spark, none_dir):
    assert cp.run(spark, none_dir).count() == 0


@pytest.fixture(scope="module")
def none_dir(spark, tmp_path_factory):
    empty = lambda schema: spark.createDataFrame([], schema)
    return as_dir(tmp_path_factory.mktemp("none"), documents=empty(DOCS), labels=empty("doc_id long, quality int, toxic int"), benchmark=empty("item_id long, text string"),
                  conversations=empty("conv_id long, turn long, role string, text string"), pages=empty("page_id long, url string, html string"))


@pytest.mark.parametrize("run", [toxicity.op6_subsequence_svm, quotes.op8_quote_links, decontaminate.op9_pigeonhole_edits, packing.op4_pack_ffd, secrets.op7_secret_links])
def test_queries_of_nothing(spark, none_dir, run):
    assert run(spark, none_dir).count() == 0


# 1


def test_lm_scores_by_brute_force(spark):
    docs = frame(spark, [*some_texts(20), "never seen before"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 5 == 2).alias("held_out"))
    training = docs.filter("not held_out")
    table = lm.word_counts(training)
    counts = lm.head_of(table)
    p = lm.train(training, counts)
    c = collections.Counter(w for r in training.collect() for w in r["text"].encode().lower().split())
    assert (counts.tokens, counts.ends, dict(zip(counts.words, counts.counts.tolist()))) == (sum(c.values()) + training.count(), training.count(), dict(c))
    place = {w: lm.FIRST + i for i, w in enumerate(counts.words[: counts.known])}
    for r in lm.scored(docs, counts, table, p).collect():
        text = next(d["text"] for d in docs.filter(F.col("doc_id") == r["doc_id"]).collect())
        words, want, one, two = [*text.encode().lower().split(), None], 0.0, lm.END, lm.END
        for w in words:
            out = lm.END if w is None else place.get(w, lm.tail_of(w))
            logits = (p.q1[one] + p.q2[two]).astype(float) @ p.r.T.astype(float) + p.b
            want += (logits[out] - np.log(np.exp(logits).sum())) / np.log(10)
            if lm.END < out < lm.FIRST:
                want += np.log10(c[w] + 1) - np.log10(counts.tail_mass[out - 1])
            one, two = out, one
        assert r["score"] == pytest.approx(want, rel=1e-3)


def test_lm_head_of_equal_counts(spark):
    table = spark.createDataFrame([(f"w{i}", 1) for i in range(5000)] + [("often", 9), (None, 7)], "word string, c long")
    counts = lm.head_of(table, head=1000)
    assert counts.words[0] == b"often" and 850 < len(counts.words) < 1150
    assert counts.outputs == lm.FIRST + counts.known and counts.known == len(counts.words)
    outside = 5001 - counts.known
    assert counts.tail_kinds.sum() == counts.tail_tokens.sum() == outside and (counts.tail_kinds >= 0).all()
    assert all((lm.tail_of(w), 1) == (int(r["t"]) + 1, 1) for w in (b"a", b"ab", "né".encode(), b"station") for r in spark.createDataFrame([(w.decode(),)], "w string").select((F.crc32(F.substring(F.col("w").cast("binary"), -3, 3)) % lm.TAILS).alias("t")).collect())


# 2


def brute_sketch(text):
    out = np.zeros(fingerprint.SKETCH)
    for line in text.encode().split(b"\n"):
        words = line.split()
        for i in range(max(1, len(words) - 2) if words else 0):
            own = b" ".join(words[i : i + 3])
            h = int(wordhash.shingle_hashes(*wordhash.word_hashes([own]), 3)[0][0])
            out[h % fingerprint.SKETCH] += -1 if h >> 63 else 1
    return out


def test_likeness_by_brute_force(spark, tmp_path):
    texts = [t or "" for t in some_texts(15)]
    got = {r["doc_id"]: r for r in fingerprint.op2_multiset_hash(spark, as_dir(tmp_path, documents=frame(spark, texts))).collect()}

    def likeness(a, b):
        if sorted(a.split("\n")) == sorted(b.split("\n")):
            return 1.0
        x, y = brute_sketch(a), brute_sketch(b)
        both = x @ x + y @ y
        return min(1.0, max(0.0, 2 * (x @ y) / both)) if both else 0.0

    for i, t in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        assert got[i]["near_next"] == pytest.approx(likeness(t, after))
        assert got[i]["near_edited"] == pytest.approx(likeness(t, t[: len(t) - half] + after[:half]))


def test_repeated_rows_follow_one_another(spark):
    got = fingerprint.compare_next(frame(spark, ["a b c d"] * 3 + ["e f"], [1, 1, 1, 2])).collect()
    edited = sorted(r["edited_sha256"] for r in got if r["doc_id"] == 1)
    same, last = (hashlib.sha256(t.encode()).hexdigest() for t in ("a b a b", "a b e f"[:4] + "e f"))
    assert edited == sorted([same, same, last])


# 3 and the near-dedup stage


def test_cells_of_equal_members_are_one(spark):
    rows = spark.createDataFrame([(cell, i) for cell in range(5) for i in (1, 2, 3)] + [(9, 1), (9, 2), (10, 7)], "cell long, id long")
    assert sorted(simhash.dealt(rows).groupBy("cell").count().collect()) == [(0, 3), (9, 2)]


def test_repeated_rows_with_other_columns_leave_the_same_one(spark):
    rows = frame(spark, ["a b c d e f g"] * 4, [1, 1, 1, 2]).withColumn("source", F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string")))
    kept = {tuple(r) for _ in range(2) for r in simhash.deduplicated(rows.repartition(3)).collect()}
    assert len({k[0] for k in kept}) == 1


# 5


def test_small_runs_and_ranges_merge_whole(spark, tmp_path):
    r = random.Random(2)
    pages = [(r.choice([None, *range(40)]), f"http://h{r.randrange(6)}.org/{r.randrange(9)}", "y" * r.randrange(0, 900)) for _ in range(300)]
    pages += [(7, "http://same.org/", "z" * 500)] * 50
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("record", F.lit(1)), f"{tmp_path}/w", run_bytes=5000)
    index = warc.read_index(spark, f"{tmp_path}/w")
    got = warc.merged(index, range_rows=40).toPandas().sort_values(["range", "place"])
    assert len(got) == len(pages) and got["range"].nunique() > 4 and got["run"].nunique() > 20
    keys = [(u, t, -1 if i != i else i) for u, t, i in zip(got["urlkey"], got["ts"], got["page_id"])]
    assert keys == sorted(keys)
    for _, own in got.groupby("run"):
        assert own["payload_bytes"].sum() < 6000


# 6


def test_sentences_of_words():
    _, _, text, sentence = toxicity.words_of([b"One two. Three i.d.i.o.t four!\nFive", b"six? seven"])
    assert text.tolist() == [0] * 6 + [1, 1]
    assert [len(list(g)) for _, g in itertools.groupby(sentence.tolist())] == [2, 3, 1, 1, 1]


def test_the_sample_is_bounded_in_hash_order(spark, monkeypatch):
    docs = frame(spark, [f"text {i} " * 20 for i in range(60)] + ["twice"], [*range(60), 5])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 12)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    texts, toxic = toxicity.training_rows(docs, labels)
    again = toxicity.training_rows(docs.repartition(3), labels.repartition(2))
    assert texts == again[0] and len(texts) == len(set(texts)) <= 24
    assert all(sum(len(t) for t, y in zip(texts, toxic) if y == k) <= 2000 for k in (0, 1))


def test_ties_score_alike(spark, tmp_path):
    texts = ["calm river stone", "you vile toad vile toad"] * 40
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    got = toxicity.op6_subsequence_svm(spark, as_dir(tmp_path, documents=docs, labels=labels)).collect()
    assert all(len({r["score"] for r in got if r["doc_id"] % 2 == k}) == 1 for k in (0, 1))
    assert {r["doc_id"] % 2 for r in got if r["predicted"]} == {1}


# 7


def test_links_by_brute_force(spark):
    r = random.Random(11)
    some = lambda n: "".join(r.choices("aB3xQ9", k=n)) + "aB3"
    make = [lambda: f'token="{some(r.choice([8, 50, 5000]))}"', lambda: "AKIA" + "ABCD1234" * 2, lambda: "0a1b2c" * r.choice([4, 10, 800]), lambda: some(r.choice([32, 900, 4000])), lambda: f"client_id = u{r.randrange(10**6)}", lambda: f"https://db{r.randrange(99)}.example.org/x"]
    texts = []
    for _ in range(60):
        texts.append("".join(r.choice(make)() + " " + "é. " * r.choice([0, 10, 120, 134, 200]) for _ in range(r.randrange(1, 9))))
    got = {x["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in x["all"]] for x in secrets.spans(frame(spark, texts)).collect()}
    weak = 0
    for i, t in enumerate(texts):
        parts, want = secrets.find(t.encode()), []
        for s, k, e in parts:
            near = {secrets.ROLES[secrets.KINDS[k2]] for s2, k2, e2 in parts if s2 <= e + secrets.SCOPE and s <= e2 + secrets.SCOPE}
            if k < secrets.BASE or {3: {"id"}, 4: {"secret"}, 5: {"id", "secret"}}[k] <= near:
                want.append((s, k, e))
                weak += k >= secrets.BASE
        assert got[i] == want
    assert weak > 40


def test_masks():
    assert secrets.masked("abcdefgh", [(1, 3), (2, 5), (6, 7)], "#") == "a#f#h"
    assert secrets.masked("abc", [(0, 3)], "#") == "#"
    assert secrets.masked("abcd", [(0, 2), (2, 4)], "#") == "##"


# 9


def test_items_in_blocks_and_short_items(spark):
    r = random.Random(3)
    say = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(n))
    items = ["42", "a b", "short one", "just nineteen chars", "twenty letters, maybe", *(say(r.choice([8, 40, 120])) for _ in range(30))]
    edit = lambda t, n: "".join(r.choice("xyz") if i in set(r.sample(range(len(t)), n)) else c for i, c in enumerate(t))
    texts = [f"{say(5)} {edit(t, r.choice([0, 0, 1, 3]))} {say(5)}" for t in items] + ["the answer is 42.", "1042 no", say(500)]
    bench = spark.createDataFrame([*enumerate(items), (99, items[7].upper())], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontaminate.contaminated(frame(spark, texts), bench, block_bytes=1500).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in [*enumerate(items), (99, items[7].upper())]:
            p, q = decontaminate.normalised(item.encode()).decode(), decontaminate.normalised(t.encode()).decode()
            n = edit_distance_in(p, q)
            if n <= decontaminate.budget(len(p)):
                want[d, i] = n
    assert set(got) == set(want) and all(got[k] >= v for k, v in want.items())
    assert want[len(items), 0] == 0 and (len(items) + 1, 0) not in want


# 10


def test_a_hot_id_is_spread_over_the_shards(spark):
    rows = frame(spark, [f"{'x' * (i % 50)}{i}" for i in range(2000)] + ["y" * 40] * 9000, [7] * 2000 + [None] * 9000)
    placed = sharding.shard_by_bytes(rows, 8)[0].toPandas()
    assert len(placed) == 11000
    load = placed.groupby("shard")["size"].sum()
    assert load.max() - load.min() < 0.01 * load.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in placed.groupby("shard")["slot"])
    copies = placed[placed["doc_id"].isna()]["copy"]
    assert sorted(copies) == list(range(9000))


def test_text_crc(spark):
    got = sharding.slotted(frame(spark, ["é", None], [1, None])).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {1: (18, zlib.crc32("é".encode())), None: (16, 0)}


def test_unused_names(spark):
    rows = spark.range(1).select("id", F.lit(1).alias("Row"), F.lit(1).alias("_row"))
    assert common.unused(rows, "row") == "__row"
