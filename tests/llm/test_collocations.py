"""Phrases by dynamic itemset counting, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlens.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def texts(seed, n=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "a-b", "\xa0x"]
    fixed = ["alpha beta gamma delta", "Beta gamma DELTA epsilon zeta eta", "one one one one one one"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        rows.append((i, "".join(p + rng.choice([" ", " ", " ", " \t", ". ", "\n", ";"]) for p in parts), rng.choice(["en", "en", "en", "fr", None, "und"])))
    return rows + [(None, None, None), (500, "", "en"), (501, " ..\n\t", "xx"), rows[0], rows[0], (502, "one " * 3000, "en"), (503, "x\n" + "ab cd ef. " * 30_000, "en")]


def brute(rows, top, least, longest=5, share=100):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in candidates.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(inside[lang, w[i:j]], a)
    found = {}
    for (lang, w), a in candidates.items():
        if (lang, w) in inside and 100 * inside[lang, w] >= share * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(
        (lang, i, phrase.decode(), -a, left, right, n[lang], -score) for lang, some in found.items() for i, (score, a, phrase, left, right) in enumerate(sorted(some)[:top], 1)
    )


@pytest.mark.parametrize(("seed", "least", "shards", "longest", "top"), [(1, 4, 3, 5, 2000), (2, 20, 1, 5, 7), (3, 9, 5, 3, 50)])
def test_equals_brute_force(spark, seed, least, shards, longest, top, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 300)
    rows = texts(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("hash", "N", "block", "tokens", "rank")})
    found = collocations.collocations(docs, top, least, longest, shards)
    assert sorted(map(tuple, found.collect())) == brute(rows, top, least, longest)


def test_share(spark):
    rows = [(i, "a b c" if i % 4 else "a b", "en") for i in range(40)]
    found = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=5, share=70)
    assert sorted(map(tuple, found.collect())) == brute(rows, 2000, 5, share=70)
    assert [r.phrase for r in found.collect()] == ["a b c"]


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None)], SCHEMA)).collect() == []


def test_lengths_interleave():
    """Pairs of words that the first shard shows to be frequent are counted from the second scan on, their triples from the third."""
    keys = np.random.default_rng(1).integers(1, 1 << 62, 3).astype(np.uint64)
    tokens = np.tile(np.append(keys, np.uint64(0)), 10)
    cells = np.zeros(1 << 16, np.uint8)
    assert all(len(run) == 0 for _, run, _ in collocations._active(tokens, cells, 5))
    for place in collocations._places(keys, len(cells)):
        cells[place] = 1
    by_length = {length: (run, since) for length, run, since in collocations._active(tokens, cells, 5)}
    assert len(by_length[2][0]) == 20 and set(by_length[2][1]) == {1} and len(by_length[3][0]) == 0
    for place in collocations._places(np.unique(by_length[2][0]), len(cells)):
        cells[place] = np.where(cells[place] == 0, 2, cells[place])
    by_length = {length: (run, since) for length, run, since in collocations._active(tokens, cells, 5)}
    assert len(by_length[3][0]) == 10 and set(by_length[3][1]) == {2} and len(by_length[4][0]) == 0


def test_packing():
    for x in ([], [0], [1, 255, 256], [2**64 - 1, 0], list(range(1000))):
        assert collocations.unpacked(collocations.packed(np.array(x, np.uint64))).tolist() == x


def test_shared_cells_only_count_in_vain(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CELLS", (1 << 16, 1 << 16))
    monkeypatch.setattr(collocations, "_places", lambda phrases, cells: ((phrases & np.uint64(3)).astype(np.int64),) * 2)
    rows = texts(4, 40)
    found = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=6)
    assert sorted(map(tuple, found.collect())) == brute(rows, 2000, 6)
