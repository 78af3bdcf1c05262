"""The registered queries against their SQL, and the pipeline's stages against what they promise."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from catalog.check import connect, difference
from coverlens.llm import quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    known = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert {(r.doc_id, r.text) for r in out} <= known
    assert len(out) > 50
    sizes = [sum(r.shard == s for r in out) for s in range(corpus_pipeline.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in enumerate(sizes))


# --- the pipeline's stages against brute force, each on what its predecessor kept


def moments(n, k, toward):
    n, share = np.array(n, float), np.array(k) / np.array(n, float)
    toward = np.broadcast_to(toward, n.shape)
    within = toward * (1 - toward)
    between = np.sum(n * ((share - toward) ** 2 - within / n)) / n.sum()
    return min(max(np.sum(n * within) / n.sum() / max(between, 1e-9) - 1, 1.0), 1e6)


def accepted(rows, model):
    """Ids of the accepted documents, and the smallest distance of a score from the threshold."""
    evidence = model.evidence(pa.array([r.text for r in rows], pa.string()))
    good = 1 / (1 + np.exp(-(evidence + model.prior)))
    n, k = Counter(), Counter()
    for r, p in zip(rows, good):
        for site in ((r.source,), (r.source, r.lang)):
            n[site] += 1
            k[site] += p
    hosts, paths = [s for s in n if len(s) == 1], [s for s in n if len(s) == 2]
    whole = (sum(k[s] for s in hosts) + 1) / (len(rows) + 2)
    pull = moments([n[s] for s in hosts], [k[s] for s in hosts], whole)
    host = {s[0]: (k[s] + pull * whole) / (n[s] + pull) for s in hosts}
    pull = moments([n[s] for s in paths], [k[s] for s in paths], np.array([host[s[0]] for s in paths]))
    site = {s: (k[s] + pull * host[s[0]]) / (n[s] + pull) for s in paths}
    odds = [e + np.log(site[r.source, r.lang] / (1 - site[r.source, r.lang])) for r, e in zip(rows, evidence)]
    return {r.doc_id for r, z in zip(rows, odds) if z >= 0}, min(abs(z) for z in odds)


def one_of_each_group(rows):
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d for d in sets if find(d) == d}


def clean(rows, items):
    def plain(text):
        lower = (text or "").encode().lower().decode("latin-1")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    windows = set()
    for w in map(plain, items):
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    kept = set()
    for r in rows:
        w, hit = plain(r.text), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
        if not hit or 20 * len(hit) < len(w):
            kept.add(r.doc_id)
    return kept


def copies(rows):
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    source = Counter()
    for r in rows:
        source[r.source] += sizes[r.doc_id]
    ranked = sorted(source, key=lambda s: (s is None, (s or "").encode()))
    weight, above = {s: 1 + i % 3 for i, s in enumerate(ranked)}, set()
    while True:
        share = (sum(source.values()) - sum(3 * source[s] for s in above)) / max(sum(weight[s] for s in ranked if s not in above), 1)
        more = {s for s in ranked if s not in above and share * weight[s] > 3 * source[s]}
        if not more:
            break
        above |= more
    rate = {s: 0 if not source[s] else 3 if s in above else share * weight[s] / source[s] for s in ranked}
    out = Counter()
    for r in rows:
        fraction = int(hashlib.md5(f"{r.doc_id}:mix".encode()).hexdigest()[:13], 16) / 2**52
        out[r.doc_id] = int(rate[r.source]) + (fraction < rate[r.source] - int(rate[r.source]))
    return +out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SF).collect(), docs.schema)
        kept.append((before.collect(), after.collect()))
        before = after
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good, margin = accepted(kept[0][0], quality.fit(docs, labels))
    assert margin > 1e-4  # else the weights' rounding could decide
    assert Counter(r.doc_id for r in kept[0][1]) == Counter(good)
    assert Counter(r.doc_id for r in kept[1][1]) == Counter(one_of_each_group(kept[1][0]))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(r.doc_id for r in kept[2][1]) == Counter(clean(kept[2][0], items))
    assert Counter(r.doc_id for r in kept[3][1]) == copies(kept[3][0])
    assert any(len(a) < len(b) for b, a in kept[:3])


OWN = "size rate accepted evidence kept_id id n_words hit_mask copies site_host aside_size".split()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_takes_odd_rows(spark, tmp_path, empty):
    """Nulls in every column, empty and long texts, repeated rows, extra columns named like those of the operators."""
    long = "word " * 50_000
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, long, None, "a", 1), (3, "two words", "en", None, None), (3, "two words", "en", None, None)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(c) for c in OWN}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, *OWN, "shard", "slot"]
    found = out.collect()
    assert all(r[c] == c for r in found for c in OWN)
    assert {r.doc_id for r in found if r.text in (long, "two words")} == (set() if empty else {2, 3})
