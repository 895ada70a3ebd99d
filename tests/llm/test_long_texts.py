"""Texts so long, or so repetitive, that they are worked on in parts: same results as in one."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from test_llm import edit_distance_in

from docloom.llm import decontaminate, fingerprint, secrets, wordhash


@pytest.mark.parametrize("chunk", [1, 3, 8, 64])
def test_word_hashes_do_not_depend_on_the_cut(monkeypatch, chunk):
    r = random.Random(chunk)
    texts = ["".join(r.choices("ab \t\n\x0b\x0c\rxyzé", weights=[4, 4, 1, 1, 1, 1, 1, 1, 3, 3, 3, 3], k=r.randint(0, 200))).encode() for _ in range(40)] + [b"", b"x" * 500, b" " * 300, b"\t".join([b"w"] * 99)]
    whole = wordhash.word_hashes(texts)
    monkeypatch.setattr(wordhash, "CHUNK", chunk)
    parts = wordhash.word_hashes(texts)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert np.bincount(whole[1], minlength=len(texts)).tolist() == [len(t.split()) for t in texts]


def test_words_of_texts_over_a_chunk():
    tabs, long = b"\t".join(b"word%d" % (i % 7) for i in range(900_000)), b"y" * (9 << 20)
    hashes, units = wordhash.word_hashes([tabs, long, long + b" z"])
    assert np.bincount(units).tolist() == [900_000, 1, 2] and len(np.unique(hashes[:900_000])) == 7 and hashes[900_000] == hashes[900_001]
    a, b = fingerprint.fingerprints([tabs, tabs.replace(b"\t", b" ")])
    assert a.likeness(b) == 1


def test_windows_against_edit_distance(monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS", 50)
    r = random.Random(1)
    words = [b"aa", b"bb", b"the", b"cat", b"x"]
    for _ in range(60):
        items = list(dict.fromkeys(decontaminate.normalised(b" ".join(r.choices(words, k=r.randint(1, 40)))) for _ in range(6)))
        index, texts = decontaminate.Index.of(items, list(range(len(items)))), [b""]
        for _ in range(5):
            near = bytearray(r.choice(items))
            for _ in range(r.randint(0, 6)):
                j = r.randrange(len(near))
                near[j : j + 1] = r.choice([b"q", b"zz", b"e"])
            own = b" ".join(r.choices(words, k=r.randint(0, 60)))
            texts.append(decontaminate.normalised(own + b" " + bytes(near) + b" " + own))
        want = [{i: d for i, x in enumerate(items) if t and (d := edit_distance_in(x, t)) <= decontaminate.budget(len(x))} for t in texts]
        assert index.matches(texts) == want
        assert [bool(m) for m in index.matches(texts, one=True)] == [bool(w) for w in want]


def test_one_repetitive_text_takes_time_by_its_length():
    item = decontaminate.normalised(b"word " * 199 + b"worx")
    index, start = decontaminate.Index.of([item], [0]), time.perf_counter()
    assert index.matches([decontaminate.normalised(b"word " * 100_000)]) == [{0: 1}]
    finds = ("token=abcdef123456 " + "Ab1" * 12 + " ") * 40_000
    assert len(secrets.find(finds.encode())) == 80_000
    assert time.perf_counter() - start < 30


def test_weak_tokens_beside_base_finds():
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["password=", "Ab1" * 11, "0f" * 13, " ", "AKIA" + "Z" * 17, "x", ":", "/"]) for _ in range(12))
        found = secrets.find(text.encode())
        base = [(s, e) for s, k, e in found if k < secrets.BASE]
        tokens = [(m.start(), m.end()) for m in secrets.WEAK_SECRET.finditer(text) if any(c.isupper() for c in m[0]) and any(c.islower() for c in m[0]) and any(c.isdigit() for c in m[0])]
        assert [(s, e) for s, k, e in found if k == 3] == [(s, e) for s, e in tokens if not any(a < e and s < b for a, b in base)]
