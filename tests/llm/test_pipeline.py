"""The pipeline's stages on planted documents."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from docloom.llm import common


def test_stages_keep_and_drop(spark, tmp_path):
    r = random.Random(12)
    say = lambda n: " ".join(f"w{r.randrange(10**5)}" for _ in range(n))
    item = say(40)
    texts = [say(120) for _ in range(60)]
    texts[10], texts[20] = texts[9] + " end", texts[9]
    texts[30] = f"{say(20)} {item} {say(20)}"
    texts[40] += ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    toxic = set(range(45, 60))
    texts = [t + " you nasty moronic moron nasty" * (i in toxic) for i, t in enumerate(texts)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        seen[name] = {x["doc_id"]: x["text"] for x in kept.collect()}
    assert set(seen["toxicity"]) == set(range(45))
    assert set(seen["near_dedup"]) == set(range(45)) - {10, 20}
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {30}
    assert "04dbebab" not in seen["secrets"][40] and seen["secrets"][1] == texts[1]
    packed = cp.run(spark, str(tmp_path)).toPandas()
    assert set(packed["doc_id"]) == set(seen["secrets"])
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not on this machine")
def test_near_dedup_keeps_one_of_each_true_group(spark):
    """The stage over a whole table against the connected pairs of all texts at a Jaccard similarity of 0.8."""
    docs = common.table(spark, SF, "documents")
    sets, holders = {}, defaultdict(list)
    for i, text in docs.select("doc_id", "text").collect():
        words = (text or "").encode().lower().split()
        sets[i] = {b" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
        for shingle in sets[i]:
            holders[shingle].append(i)
    group = {i: i for i in sets}

    def first(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        shared = defaultdict(int)
        for shingle in sets[i]:
            for j in holders[shingle]:
                shared[j] += 1
        for j, n in shared.items():
            if j < i and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = first(i), first(j)
                group[max(a, b)] = min(a, b)
    expected = {first(i) for i in sets}
    kept = [x["doc_id"] for x in cp.near_dedup_stage(spark, docs, SF).select("doc_id").collect()]
    assert len(expected) < len(sets) and sorted(kept) == sorted(expected)
