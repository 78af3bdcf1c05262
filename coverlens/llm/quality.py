"""Quality classifier with hierarchical empirical Bayes: a document's evidence on top of what its site is like.

A logistic model over a document's distinct words and the make-up of its bytes gives the evidence. Sites are two
levels deep, host and path within the host. The share of good documents of a host is pulled to the global share, that
of a path to its host's, the more so the fewer documents there are; the strength of the pull is estimated from how
much hosts, and paths within hosts, really differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from coverlens.llm.common import fresh, small_batches, without
from coverlens.llm.text import chunks, layout, word_hashes
from coverlens.session import stored

# Labelled documents that the classifier is fitted on at most; they are fetched to the driver as word numbers.
SAMPLE = 8_000
BUCKETS = 1 << 18
# A word counts as evidence if so many sampled documents have it.
LEAST_DOCS = 4
OWN = ("evidence", "site_share", "quality_score", "accepted")

# Byte classes: every ASCII sign by itself, digits, capitals, small letters, white space, newline, non-ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 5, 6
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_SIGNS] = 7 + np.arange(len(_SIGNS))
_CLASSES = 7 + len(_SIGNS)
SHAPE = _CLASSES + 3
# Words here are runs of letters, digits and non-ASCII characters.
_GAPS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def featured(column: pa.Array):
    """Per chunk of texts: word numbers, distinct within a text; where each text's begin; a row of shape numbers per text."""
    offsets, data = layout(column)
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        words, begins = word_hashes(part, data, _GAPS)
        text = np.repeat(np.arange(hi - lo), np.diff(begins))
        keys = np.unique((text << 18) | (words & np.uint64(BUCKETS - 1)).astype(np.int64))
        starts = np.searchsorted(keys >> 18, np.arange(hi - lo + 1))
        sizes = np.diff(part)
        of = np.repeat(np.arange(hi - lo), sizes) * _CLASSES + _CLASS[data[part[0] : part[-1]]]
        shares = np.bincount(of, minlength=(hi - lo) * _CLASSES).reshape(hi - lo, _CLASSES) / np.maximum(sizes, 1)[:, None]
        counts = np.diff(begins)
        more = [np.log1p(counts) / 10, np.diff(starts) / np.maximum(counts, 1), sizes / np.maximum(counts, 1) / 50]
        yield lo, hi, keys & (BUCKETS - 1), starts, np.hstack([np.sqrt(shares), np.minimum(np.array(more).T, 1.0)])


class Model:
    """Weights per word number and shape number, and the log odds of the labelled sample."""

    def __init__(self, words: np.ndarray, shape: np.ndarray, bias: float, prior: float):
        self.words, self.shape, self.bias, self.prior = words, shape, bias, prior

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Log likelihood ratio of good to bad per text."""
        out = np.zeros(len(column))
        for lo, hi, words, starts, shape in featured(column):
            sums = np.concatenate([[0.0], np.cumsum(self.words[words])])
            out[lo:hi] = self.bias + sums[starts[1:]] - sums[starts[:-1]] + shape @ self.shape - self.prior
        return out


def train(good: np.ndarray, words: list[np.ndarray], shape: np.ndarray, rounds: int = 200) -> Model:
    """Logistic regression by gradient steps, with a penalty on the weights. Without both labels: no evidence either way."""
    n, hits = len(good), int(good.sum()) if len(good) else 0
    prior = float(np.log((hits + 1) / (n - hits + 1)))
    if hits in (0, n):
        return Model(np.zeros(BUCKETS), np.zeros(SHAPE), prior, prior)
    flat = np.concatenate(words)
    known = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) >= LEAST_DOCS)
    place = np.full(BUCKETS, -1)
    place[known] = np.arange(len(known))
    text = np.repeat(np.arange(n), [len(w) for w in words])
    text, flat = text[place[flat] >= 0], place[flat][place[flat] >= 0]
    w, v, b = np.zeros(len(known)), np.zeros(SHAPE), prior
    m = [0.0, 0.0, 0.0]
    s = [0.0, 0.0, 0.0]
    for t in range(1, rounds + 1):
        z = b + np.bincount(text, w[flat], minlength=n) + shape @ v
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - good
        steps = [np.bincount(flat, error[text], minlength=len(known)) / n + 1e-4 * w, shape.T @ error / n + 1e-5 * v, error.mean()]
        rates = [0.03, 0.2, 0.05]
        moves = []
        for i, g in enumerate(steps):
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
            moves.append(rates[i] * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8))
        w, v, b = w - moves[0], v - moves[1], b - moves[2]
    weights = np.zeros(BUCKETS)
    weights[known] = w
    return Model(weights, v, float(b), prior)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents, the ones whose ids hash lowest. Labels other than 0 and 1 are ignored;
    a document with several labels is good if all are 1. Of rows that share an id the smallest text counts."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "good")
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    # Of rows that share an id one text counts, so that no more rows come to the driver than were chosen.
    picked = picked.groupBy("id", "good").agg(F.min("text").alias("text")).select("good", "text")

    def collect(batches):
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False)
            for lo, hi, words, starts, shape in featured(batch.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(words, pa.int32()))
                numbers = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * SHAPE, pa.array(shape.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(good[lo:hi]), lists, numbers], ["good", "words", "shape"])

    rows = picked.mapInArrow(collect, "good double, words array<int>, shape array<double>").toArrow()
    good = rows.column("good").to_numpy()
    words = [np.asarray(x.values, np.int64) for x in rows.column("words")]
    shape = np.array(rows.column("shape").to_pylist()).reshape(len(good), SHAPE)
    order = np.lexsort((shape[:, -1], shape[:, -2], shape[:, 0], good)) if len(good) else np.zeros(0, int)  # whatever order rows came in
    return train(good[order], [words[i] for i in order], shape[order])


def _odds(share: Column) -> Column:
    return F.log(share / (1 - share))


def _strength(sites: DataFrame, n: str, k: str, toward: Column) -> float:
    """Pseudo-documents behind a prior: m (1 - m) / variance of the shares between sites, less 1, by moments."""
    share = F.col(k) / F.col(n)
    noise = toward * (1 - toward) / F.col(n)
    row = sites.agg(
        F.sum(F.col(n) * toward * (1 - toward)) / F.sum(n),
        F.sum(F.col(n) * ((share - toward) ** 2 - noise)) / F.sum(n),
    ).first()
    if row[0] is None:
        return 1.0
    return float(min(max(row[0] / max(row[1], 1e-9) - 1, 1.0), 1e6))


def judged(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """All rows and columns plus evidence (log likelihood ratio of the text), site_share (of good documents, after
    shrinking), quality_score (probability of good, both taken together) and accepted (the score reaches ``threshold``).

    The site's figures come from all documents. A missing host or path is a site like any other. A missing or empty
    text is judged as a text without words. Repeated rows get equal scores. Without usable labels every document has
    evidence 0. Input columns that have one of the added names are replaced. Needs doc_id, text and the two site columns.
    """
    docs = small_batches(without(docs, *OWN))
    model = fit(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast((model.words.astype(np.float32), model.shape, model.bias, model.prior))

    def score(batches):
        own = Model(*sent.value)
        for batch in batches:
            evidence = pa.array(own.evidence(batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, evidence], names=[*batch.schema.names, "evidence"])

    scored = docs.mapInArrow(score, _with_evidence(docs))
    prior = model.prior
    light = docs.select(host, path, "text").mapInArrow(score, _with_evidence(docs.select(host, path, "text")))
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior))))
    h, q = fresh(docs, "site_host", "site_path")
    paths = light.groupBy(F.col(host).alias(h), F.col(path).alias(q)).agg(F.count("*").alias("n"), F.sum(p).alias("k"))
    paths = stored(paths, "paths")
    hosts = paths.groupBy(h).agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    whole = hosts.agg(F.sum("hk"), F.sum("hn")).first()
    share = min(max((whole[0] + 1.0) / (whole[1] + 2.0), 1e-6), 1 - 1e-6) if whole[1] else 0.5
    pull = _strength(hosts, "hn", "hk", F.lit(share))
    hosts = hosts.select(F.col(h).alias("hh"), ((F.col("hk") + pull * share) / (F.col("hn") + pull)).alias("host_share"))
    sites = stored(paths.join(hosts, F.col(h).eqNullSafe(F.col("hh"))).drop("hh"), "sites")
    inner = _strength(sites, "n", "k", F.col("host_share"))
    site_share = (F.col("k") + inner * F.col("host_share")) / (F.col("n") + inner)
    sites = stored(sites.select(h, q, site_share.alias("site_share")), "site-shares")
    joined = scored.join(sites, scored[host].eqNullSafe(sites[h]) & scored[path].eqNullSafe(sites[q])).drop(h, q)
    score_column = 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("site_share")))))
    return joined.withColumn("quality_score", score_column).withColumn("accepted", F.col("quality_score") >= threshold)


def _with_evidence(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("evidence", DoubleType())])
