"""Language model scores by a probabilistic suffix tree over words.

The tree's states are contexts of words. A context is a candidate if it occurs twice, and it names the words that follow
it twice, whatever the corpus; it is retained if the distribution of the word after it diverges from that of the next
shorter retained context by more than its description costs. Every state mixes its counts with the shorter state's
distribution. A token is scored by the longest retained suffix of what precedes it. The tree grows by a word at a time,
to contexts of a given length or until a level retains none.

The tree is nowhere whole. Runs of words are dealt by their hashes to buckets, whose number follows the corpus. A block
of documents sends its distinct runs to their buckets and gets back, in the same order, what all blocks have of them. A
run of d + 1 words occurs twice only if the d words at either end do, so a block asks for such runs alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.llm.common import small_batches
from coverlens.llm.text import MULTIPLIERS, chunks, layout, mixed, word_hashes
from coverlens.session import shared_path, stored

# Words of the longest contexts.
DEPTH = 3
# Occurrences that make a context a candidate, and a word after it one that the context names.
LEAST = 2
# Bytes of text in a block, whose words are numbered together; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
END = np.uint64(1)
# Tokens for each bucket that runs of one length are dealt to.
BUCKET = 2_000_000
BLOCK = "doc_ids array<long>, held array<boolean>, lengths array<int>, kinds int, words binary, tokens binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
# Of runs of depth + 1 words: how often they occur in the block. Of contexts of depth words, under STATES + depth: what it
# adds to their sums.
ASKED = "depth int, bucket int, block long, n int, runs binary, sums binary"
# Of runs: their counts, doubled, plus 1 for the block that stands for the run. Of contexts: their weights.
ANSWERED = "block long, depth int, bucket int, n int, found binary, tokens long, kinds long"
STATES = 1 << 20


def _packed(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes before all second ones, compressed: small numbers take little."""
    return pa.compress(np.ascontiguousarray(values.reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind)


def _ascending(values: np.ndarray) -> bytes:
    """Sorted hashes, as the steps from one to the next."""
    return _packed(np.diff(values, prepend=np.uint64(0)))


def _hashes(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, n, np.uint64), dtype=np.uint64)


def _block(ids: list, held: list, parts: list, lengths: list) -> pa.RecordBatch:
    lengths = np.concatenate(lengths).astype(np.int32)
    words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
    values = [ids, held, lengths, len(words), _ascending(words), _packed(tokens.astype(np.int32))]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [x.split()[0] for x in BLOCK.split(", ")])


def _encoded(batches):
    """Documents in blocks: a row with their tokens as numbers of the block's own words, and the words' hashes."""
    ids, held, parts, lengths, size = [], [], [], [], 0
    for batch in batches:
        offsets, data = layout(batch.column("text"))
        all_ids, all_held = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
        for lo, hi in chunks(offsets):
            more = int(offsets[hi] - offsets[lo])
            if ids and size + more > BLOCK_BYTES:
                yield _block(ids, held, parts, lengths)
                ids, held, parts, lengths, size = [], [], [], [], 0
            words, begins = word_hashes(offsets[lo : hi + 1], data)
            parts.append(np.insert(words, begins[1:], END))
            lengths.append(np.diff(begins) + 1)
            ids += all_ids[lo:hi]
            held += all_held[lo:hi]
            size += more
    if ids:
        yield _block(ids, held, parts, lengths)


def weights(n: np.ndarray, kept: np.ndarray, kinds: np.ndarray, shorter: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much the shorter state's distribution weighs in contexts that occur ``n`` times, and the sum of weights; 0 if
    not retained. They name ``kinds`` words, which follow ``kept`` times in all, have the probability ``shorter`` in all
    after the shorter state, and add ``gain`` to the divergence times n. All other words are taken together."""
    n, gain = n.astype(float), gain.astype(float)
    rest, left = n - kept, np.maximum(1 - shorter, 1e-12)
    gain = gain + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / np.maximum(n, 1) / left), 0.0)
    retained = (kinds > 0) & (gain > 0.5 * (kinds + 1) * np.log(np.maximum(n, 2)))
    return np.where(retained, rest + kinds, 0.0), np.where(retained, n + kinds, 0.0)


class Tree:
    """A small tree in memory, to look at: its words, and per depth the sorted keys (context << 32 | word), their counts, and the states.

    A context of one word is the word's number; of more, the number of the key that ends with its last word.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(words)
        self.words, self.counts, self.total = words[order], counts[order], total
        self.keys: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        # Per depth and context: how much the shorter state's distribution weighs, and the sum of weights; 0 if not retained.
        self.backing: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []

    def grow(self, keys: np.ndarray, seen: np.ndarray) -> None:
        """Adds a depth from the counts of its keys: tests every context's divergence and weighs the retained ones."""
        order = np.argsort(keys)
        keys, seen = keys[order], seen[order]
        occurrences = self.counts if not self.keys else self.seen[-1]
        context, word = keys >> 32, keys & 0xFFFFFFFF
        shorter = self.probabilities(len(self.keys), context, word)
        n = occurrences.astype(float)
        size = len(n)
        kept, kinds = np.bincount(context, seen, size), np.bincount(context, minlength=size)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.bincount(context, seen * np.log(seen / n[context] / shorter), size)
        backing, sums = weights(n, kept, kinds, np.bincount(context, shorter, size), gain)
        self.backing.append(backing)
        self.sums.append(sums)
        self.keys.append(keys)
        self.seen.append(seen)

    def probabilities(self, depth: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of named words after the contexts of depth + 1 words, under the longest retained state of at most depth words."""
        p = self.counts[word] / max(self.total, 1)
        last = context
        # A context's suffixes: drop its first words. Their numbers follow from the words themselves.
        words = []
        for d in range(depth, 0, -1):
            words.append(self.keys[d - 1][last] & 0xFFFFFFFF)
            last = self.keys[d - 1][last] >> 32
        for d in range(depth):
            suffix = self._context(words[: d + 1][::-1])
            p = self.step(d, suffix, word, p)
        return p

    def step(self, d: int, context: np.ndarray, word: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities after contexts of d + 1 words, given those after the next shorter retained ones; where there is no
        retained state, these. A context or word of -1 is unknown to the tree."""
        if not len(self.keys[d]):
            return p
        at = np.maximum(context, 0)
        use = (context >= 0) & (self.sums[d][at] > 0)
        hit = _found(self.keys[d], np.where(use & (word >= 0), at << 32 | np.maximum(word, 0), -1))
        seen = np.where(hit >= 0, self.seen[d][hit], 0)
        return np.where(use, (seen + self.backing[d][at] * p) / np.maximum(self.sums[d][at], 1), p)

    def _context(self, words: list[np.ndarray]) -> np.ndarray:
        number = words[0]
        for d, w in enumerate(words[1:]):
            number = np.where(number >= 0, _found(self.keys[d], np.where(number >= 0, number << 32 | w, -1)), -1)
        return number


def _found(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of values in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _arrays(batch, row: int) -> dict:
    lengths, kinds = np.asarray(batch.column("lengths")[row].values), batch.column("kinds")[row].as_py()
    return {
        "doc_ids": batch.column("doc_ids")[row].values,
        "held": batch.column("held")[row].values.to_numpy(zero_copy_only=False).astype(bool),
        "lengths": lengths,
        "words": _hashes(batch.column("words")[row].as_py(), kinds),
        "tokens": _unpacked(batch.column("tokens")[row].as_py(), int(lengths.sum(dtype=np.int64)), np.int32),
    }


def _runs(block: dict, answers: dict, depth: int) -> list:
    """Per depth: the sorted distinct hashes of the runs of depth + 1 words that may occur twice, for each token the place
    of the run that ends with it, -1 for any other, and of each run a token that it ends with."""
    words, tokens, lengths = block["words"], block["tokens"], block["lengths"]
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = run = words[tokens]
    found = [(words, tokens, None)]
    for d in range(1, depth + 1):
        run = mixed(np.concatenate([run[:1], run[:-1]]) * MULTIPLIERS[0] + last * MULTIPLIERS[1])
        often = _often(found[-1][1], answers, d - 1)
        whole = 1 + np.flatnonzero((at[1:] >= d) & often[1:] & often[:-1])
        runs, ends, places = np.unique(run[whole], return_index=True, return_inverse=True)
        place = np.full(len(tokens), -1)
        place[whole] = places
        found.append((runs, place, whole[ends]))
    return found


def _often(place: np.ndarray, answers: dict, depth: int) -> np.ndarray:
    """Whether the run of depth + 1 words that ends with a token occurs LEAST times."""
    return np.append(answers[depth][0] >> 1 >= LEAST, False)[place]


def _dealt(rows: list, depth: int, block: int, runs: np.ndarray, sums: np.ndarray, bits: int) -> None:
    """Adds a row per bucket that has any of the sorted ``runs``; ``sums`` has a column for each run."""
    edges = np.searchsorted(runs, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(runs)]
    for bucket, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if lo < hi:
            rows.append((depth, bucket, block, hi - lo, _ascending(runs[lo:hi]), _packed(np.ascontiguousarray(sums[:, lo:hi]))))


def _table(rows: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _ask_counts(rows: list, number: int, block: dict, runs: list, depth: int, bits: int) -> None:
    distinct, place, _ = runs[depth]
    train = np.repeat(~block["held"], block["lengths"])
    n = np.bincount(place[train & (place >= 0)], minlength=len(distinct))
    _dealt(rows, depth, number, distinct, n[None], bits)


def _ask_states(rows: list, number: int, block: dict, runs: list, answers: dict, depth: int, total: int, bits: int) -> None:
    """What a block adds to the contexts of ``depth`` words that it has: the words after them that it stands for."""
    counts = answers[depth - 1][0] >> 1
    sums = np.zeros((5, len(counts)))
    sums[0] = counts
    p = _stepped((answers[0][0] >> 1)[block["tokens"]] / max(total, 1), runs, answers, depth - 1)
    n = answers[depth][0] >> 1
    own = np.flatnonzero((n >= LEAST) & (answers[depth][0] & 1 == 1))
    end, n = runs[depth][2][own], n[own]
    context, p = runs[depth - 1][1][end - 1], p[end]
    gain = n * np.log(n / counts[context] / p)
    for i, x in enumerate((n, None, p, gain), 1):
        sums[i] = np.bincount(context, x, len(counts))
    candidates = counts >= LEAST
    _dealt(rows, STATES + depth, number, runs[depth - 1][0][candidates], sums[:, candidates], bits)


def _first(bits: int):
    def ask(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block, rows = _arrays(batch, row), []
                _ask_counts(rows, batch.column("block")[row].as_py(), block, _runs(block, {}, 0), 0, bits)
                yield from _table(rows, ASKED).to_batches()

    return ask


def _next(states: int, counts: int | None, total: int, bits: int):
    """Asks for the states of contexts of ``states`` words, none if 0, and for counts of runs of ``counts`` + 1 words."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            number, block, answers = left.column("block")[0].as_py(), _arrays(left, 0), _answers(right)
            runs = _runs(block, answers, states if counts is None else counts)
            if states:
                _ask_states(rows, number, block, runs, answers, states, total, bits)
            if counts is not None:
                _ask_counts(rows, number, block, runs, counts, bits)
        return _table(rows, ASKED)

    return ask


def _answered(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What all blocks together have of a bucket's runs or contexts, for each block that asked."""
    depth, bucket = (x.as_py() for x in key)
    asked = sorted(table.select(["block", "n", "runs", "sums"]).to_pylist(), key=lambda r: r["block"])
    width, kind = (5, np.float64) if depth >= STATES else (1, np.int64)
    sums = np.concatenate([_unpacked(r["sums"], width * r["n"], kind).reshape(width, -1) for r in asked], axis=1)
    _, first, number = np.unique(np.concatenate([_hashes(r["runs"], r["n"]) for r in asked]), return_index=True, return_inverse=True)
    if depth >= STATES:
        kept, kinds, shorter, gain = (np.bincount(number, x) for x in sums[1:])
        found = np.stack(weights(sums[0][first], kept, kinds, shorter, gain)).astype(np.int64)
        own = [0, int((found[1] > 0).sum())]
        found = found[:, number]
    else:
        totals = np.zeros(len(first), np.int64)
        np.add.at(totals, number, sums[0])
        own = [int(totals.sum()), int((totals > 0).sum())]
        # Beyond single words, only what occurs LEAST times is told apart.
        found = np.where(totals >= (LEAST if depth else 0), totals, 0)[number] << 1
        found[first] += 1
        found = found[None]
    parts = np.split(found, np.cumsum([r["n"] for r in asked])[:-1], axis=1)
    rows = [(r["block"], depth, bucket, r["n"], _packed(x), *(own if i == 0 else (0, 0))) for i, (r, x) in enumerate(zip(asked, parts))]
    return _table(rows, ANSWERED)


class _Answers(dict):
    """Per depth, what a block's runs were answered, in the order of the runs; nothing where it had none."""

    def __missing__(self, depth: int) -> np.ndarray:
        return np.zeros((2 if depth >= STATES else 1, 0), np.int64)


def _answers(table: pa.Table) -> _Answers:
    by: dict = {}
    for row in table.select(["depth", "bucket", "n", "found"]).to_pylist():
        by.setdefault(row["depth"], []).append((row["bucket"], row["n"], row["found"]))
    out = _Answers()
    for depth, parts in by.items():
        width = 2 if depth >= STATES else 1
        out[depth] = np.concatenate([_unpacked(x, width * n, np.int64).reshape(width, -1) for _, n, x in sorted(parts)], axis=1)
    return out


def _stepped(p: np.ndarray, runs: list, answers: dict, upto: int) -> np.ndarray:
    """Every token's probability under the longest retained state of at most ``upto`` words, given that under none."""
    for d in range(1, upto + 1):
        candidates = answers[d - 1][0] >> 1 >= LEAST
        backing, sums = np.zeros((2, len(candidates) + 1), np.int64)
        backing[:-1][candidates], sums[:-1][candidates] = answers[STATES + d]
        context = runs[d - 1][1][:-1]
        at = 1 + np.flatnonzero(sums[context] > 0)
        context, place = context[at - 1], runs[d][1][at]
        seen = np.append(answers[d][0] >> 1, 0)[place]
        p = p.copy()
        p[at] = (np.where(seen >= LEAST, seen, 0) + backing[context] * p[at]) / sums[context]
    return p


def _scoring(depth: int, total: int, distinct: int):
    floor = total + 0.1 * (distinct + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block, answers = _arrays(left, 0), _answers(right)
        counts, lengths = (answers[0][0] >> 1)[block["tokens"]], block["lengths"]
        base = (counts + 0.1) / floor
        p = _stepped(base, _runs(block, answers, depth), answers, depth)
        starts = np.cumsum(lengths) - lengths
        columns = [
            block["doc_ids"],
            pa.array(block["held"]),
            pa.array(lengths.astype(np.int64)),
            pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
            pa.array(np.full(len(lengths), total)),
            pa.array(np.add.reduceat(np.log10(base), starts)),
            pa.array(np.add.reduceat(np.log10(p), starts)),
        ]
        return pa.table(columns, [x.split()[0] for x in SCORED.split(", ")])

    return score


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as what was made of them is written: every level is a table of its own."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def _by_block(blocks: DataFrame) -> Iterator[DataFrame]:
    """The blocks as a table in the shared folder, bucketed by block: only answers are shuffled to meet them."""
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    writer = blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    writer.option("path", shared_path(spark, "blocks")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def scored(docs: DataFrame, depth: int | None = DEPTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id as text is divisible by 10 are held out; all others train the model. Words are
    lower-cased runs without white space; every document ends with one more token. base_score is the log10 probability under
    smoothed word frequencies, score that under the tree. A null or empty text is its end alone. A null id trains.
    Repeated rows train and are scored each. Without training documents both scores follow from the smoothing alone.
    A long text is a block of its own, of about 100 bytes of memory a word in one task.

    The tree grows to contexts of ``depth`` words; with None, until a level retains no context, which can take many
    levels, each a pass over all blocks. Counts of words and runs and all
    states are exact and stay distributed: a block of documents asks for those of its own runs and contexts. Nothing of the
    tree is gathered or broadcast. Runs jobs when called, one a level; each is written to the shared folder.
    """
    small_batches(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    encoded = texts.mapInArrow(_encoded, BLOCK).withColumn("block", F.monotonically_increasing_id())
    with _shuffles_removed(docs.sparkSession), _by_block(encoded) as blocks:

        def answered(asked: DataFrame) -> DataFrame:
            return stored(asked.groupBy("depth", "bucket").applyInArrow(_answered, ANSWERED), "level")

        def summed(df: DataFrame, *columns):
            return df.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in columns]).first()

        def beside(answers: DataFrame):
            return blocks.groupBy("block").cogroup(answers.groupBy("block"))

        tokens = summed(blocks, F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))[0]
        bits = max(1, int(tokens // BUCKET).bit_length())
        answers = answered(blocks.mapInArrow(_first(bits), ASKED))
        total, distinct = summed(answers, "tokens", "kinds")
        grown, more = 0, depth is None or depth > 0
        while more:
            wanted = grown + 1 if depth is None or grown < depth else None
            level = answered(beside(answers).applyInArrow(_next(grown, wanted, total, bits), ASKED))
            retained = summed(level.where(F.col("depth") >= STATES), "kinds")[0]
            answers = answers.unionByName(level)
            more = wanted is not None and (grown == 0 or retained > 0)
            grown += more
        return stored(beside(answers).applyInArrow(_scoring(grown, total, distinct), SCORED), "scores")
