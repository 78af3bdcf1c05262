"""Phrase collocations by dynamic itemset counting.

The corpus is dealt to shards, which are scanned in a cycle. Words are counted from the first scan on. A longer phrase
becomes active at the end of the scan after which both of its subphrases, without its last and without its first word,
have been counted often enough; it is counted in the following scans, until it has been counted in every shard once. So
lengths interleave: the second shard already counts pairs of words that the first has shown to be frequent. All final counts
are exact, since a phrase that is frequent has frequent subphrases, and they become so before their own cycle ends.

What scans need to know, which phrases have been counted often enough and since when, is a table of cells of fixed size: a
phrase's cells hold the scan in which it got there. Phrases that share cells can only make others active too early; these are
counted in vain, but exactly. Running counts are dealt to buckets by hash and stay distributed.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlens.llm.common import small_batches
from coverlens.llm.text import _BYTE, CHUNK, LOWER, MULTIPLIERS, _powers, chunks, layout, mixed
from coverlens.session import stored

LONGEST = 5
LEAST = 100
TOP = 2000
SHARDS = 3
# Parts of a shard, in one of which phrases are first looked for when their texts are wanted.
PARTS = 8
# A phrase is part of a longer one if that has at least this share of its occurrences, in percent.
SHARE = 100
# Tokens that are counted together before they are sent to their buckets.
BLOCK = 2_500_000
# Tokens for each bucket of running counts.
BUCKET = 4_000_000
# Cells per so many tokens, and their least and greatest number; a cell is a byte.
TOKENS_PER_CELL, CELLS = 8, (1 << 16, 1 << 26)
# Bytes of bits that tell of newly used cells, sent together.
PART = 8192
BETWEEN = np.zeros(256, bool)
BETWEEN[[9, 32]] = True
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True

# kind: running counts, final counts, or phrases that have just been counted often enough.
RUNNING, FINAL, REACHED = 0, 1, 2
COUNTS = "kind int, bucket int, length int, since int, old boolean, phrases binary, counts binary"
PHRASE = "hash long, length int, lang string, phrase string, heads array<long>, tails array<long>"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs, and that number first."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    some = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(some), 8), np.uint8)
    wide[:, : data[0]] = some
    return wide.view("<u8").ravel()


def _gaps(phrases: np.ndarray) -> bytes:
    """Ascending hashes, as the steps between them."""
    return packed(np.diff(phrases, prepend=np.uint64(0)))


def _phrases(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def _cut(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with more places to cut texts that are longer than a chunk, after ends of pieces, and the row of each part."""
    places = [offsets]
    for row in np.flatnonzero(np.diff(offsets) > CHUNK):
        lo, hi = offsets[row], offsets[row + 1]
        ends = lo + 1 + np.flatnonzero(BREAK[data[lo:hi]])
        at = np.searchsorted(ends, np.arange(lo + CHUNK, hi, CHUNK), side="right") - 1
        places.append(ends[at[at >= 0]])
    # Empty texts have no part of their own.
    every = np.unique(np.concatenate(places))
    return every, np.searchsorted(offsets, every[:-1], side="right") - 1


def _words(data: np.ndarray, offsets: np.ndarray):
    """Of a chunk of texts: its lower-cased bytes, where words begin and end, and how many breaks precede each, text ends being such too."""
    buffer = LOWER[data[offsets[0] : offsets[-1]]]
    cut = np.zeros(len(buffer) + 1, bool)
    cut[offsets - offsets[0]] = True
    gap = BETWEEN[buffer] | BREAK[buffer]
    first = np.ones(len(buffer), bool)
    first[1:] = gap[:-1]
    last = np.ones(len(buffer), bool)
    last[:-1] = gap[1:]
    first |= cut[:-1]
    last |= cut[1:]
    starts, ends = np.flatnonzero(first & ~gap), np.flatnonzero(last & ~gap) + 1
    breaks = np.cumsum(BREAK[buffer].astype(np.int64) + cut[:-1])
    return buffer, starts, ends, breaks[starts] if len(starts) else np.zeros(0, np.int64)


def _hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers.upto(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * up[: len(buffer)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _texts(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between starts and ends as an array of texts."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buffer[places]))


class Chunk:
    """Words of a few texts: ``tokens`` has their hashes, which depend on the language too, with a 0 before every piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seeds: np.ndarray):
        """``langs`` has each text's place in ``seeds``."""
        self.buffer, self.starts, self.ends, breaks = _words(data, offsets)
        self.langs = langs[np.searchsorted(offsets - offsets[0], self.starts, side="right") - 1]
        keys = mixed(_hashes(self.buffer, self.starts, self.ends) + seeds[self.langs])
        places = np.flatnonzero(np.diff(breaks, prepend=-1))
        self.tokens = np.insert(keys, places, np.uint64(0))
        self.words = np.insert(np.arange(len(keys)), places, -1)


def _chunks(batches):
    """Chunks of the texts, with the names of their languages."""
    for batch in batches:
        offsets, data = layout(batch.column("text"))
        encoded = batch.column("lang").dictionary_encode()
        names, langs = encoded.dictionary, np.asarray(encoded.indices)
        seeds = np.array([int.from_bytes(blake2b(n.encode(), digest_size=8).digest(), "little") for n in names.to_pylist()], np.uint64)
        offsets, rows = _cut(offsets, data)
        for lo, hi in chunks(offsets):
            if offsets[hi] > offsets[lo]:
                yield Chunk(data, offsets[lo : hi + 1], langs[rows[lo:hi]], seeds), names


def _blocks(batches):
    """Tokens of many texts at once."""
    parts, size = [], 0
    for chunk, _ in _chunks(batches):
        parts.append(chunk.tokens)
        size += len(chunk.tokens)
        if size >= BLOCK:
            yield np.concatenate(parts)
            parts, size = [], 0
    if parts:
        yield np.concatenate(parts)


def _sizing(batches):
    """Words per language."""
    sizes: dict = {}
    for chunk, names in _chunks(batches):
        for name, n in zip(names.to_pylist(), np.bincount(chunk.langs, minlength=len(names)).tolist()):
            sizes[name] = sizes.get(name, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64())], ["lang", "n"])


def _places(phrases: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(cells - 1)
    return (phrases & mask).astype(np.int64), ((phrases >> np.uint64(32)) & mask).astype(np.int64)


def reached_in(cells: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """The scan after which each phrase has been counted often enough, as far as its cells tell; 0 if it has not."""
    a, b = (cells[p] for p in _places(phrases, len(cells)))
    return np.where((a > 0) & (b > 0), np.maximum(a, b), 0)


def _longer(run: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those without their last word, and that word's."""
    return mixed(run * MULTIPLIERS[0] + last * MULTIPLIERS[1])


def _active(tokens: np.ndarray, cells: np.ndarray, longest: int):
    """Per length from 2 on: the phrases whose subphrases have been counted often enough, as they occur, and since when."""
    ends = np.flatnonzero(tokens)
    run = tokens[ends]
    since = reached_in(cells, run)
    by_end, when = np.zeros(len(tokens), np.uint64), np.zeros(len(tokens), np.uint8)
    for length in range(2, longest + 1):
        by_end[ends], when[:] = run, 0
        when[ends] = since
        ends = 1 + np.flatnonzero((when[1:] > 0) & (when[:-1] > 0))
        since = np.maximum(when[ends], when[ends - 1])
        run = _longer(by_end[ends - 1], tokens[ends])
        yield length, run, since
        since = reached_in(cells, run)


def _dealt(rows: list, length: int, since: int, phrases: np.ndarray, bits: int) -> None:
    """Counts the phrases and adds a row per bucket that has any."""
    phrases, counts = np.unique(phrases, return_counts=True)
    edges = np.searchsorted(phrases, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(phrases)]
    for bucket, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if lo < hi:
            rows.append((RUNNING, bucket, length, since, False, _gaps(phrases[lo:hi]), packed(counts[lo:hi])))


def _table(rows: list) -> pa.Table:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in COUNTS.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _scanning(cells: np.ndarray, step: int, shards: int, longest: int, bits: int):
    """Counts what is active in scan number ``step``."""

    def scan(batches):
        for tokens in _blocks(batches):
            rows: list = []
            if step <= shards:
                _dealt(rows, 1, 0, tokens[tokens > 0], bits)
            for length, run, since in _active(tokens, cells, longest):
                for a in np.unique(since).tolist():
                    if a < step <= a + shards:
                        _dealt(rows, length, a, run[since == a], bits)
            yield from _table(rows).to_batches()

    return scan


def _merging(step: int, shards: int, least: int):
    """Adds a scan's counts to the running ones of a bucket; tells what is final, and what has now been counted often enough."""

    def merge(table: pa.Table) -> pa.Table:
        rows, groups = [], {}
        for row in table.to_pylist():
            groups.setdefault((row["length"], row["since"]), []).append(row)
        bucket = table.column("bucket")[0].as_py()
        for (length, since), parts in sorted(groups.items()):
            phrases = [_phrases(r["phrases"]) for r in parts]
            counts = np.concatenate([unpacked(r["counts"]).astype(np.int64) for r in parts])
            old = np.repeat([r["old"] for r in parts], [len(p) for p in phrases])
            every, number = np.unique(np.concatenate(phrases), return_inverse=True)
            had, total = np.zeros((2, len(every)), np.int64)
            np.add.at(had, number[old], counts[old])
            np.add.at(total, number, counts)
            new = (had < least) & (total >= least)
            if new.any():
                rows.append((REACHED, bucket, length, since, True, _gaps(every[new]), None))
            over = step >= since + shards
            keep = total >= least if over else np.ones(len(every), bool)
            if keep.any():
                rows.append((FINAL if over else RUNNING, bucket, length, since, True, _gaps(every[keep]), packed(total[keep])))
        return _table(rows)

    return merge


def _marking(cells: int):
    """The cells of phrases, as bits, in parts."""

    def mark(batches):
        bits = np.zeros(cells, bool)
        for batch in batches:
            for phrases in batch.column("phrases").to_pylist():
                for p in _places(_phrases(phrases), cells):
                    bits[p] = True
        packed = np.packbits(bits).reshape(-1, PART)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["part", "bits"])

    return mark


def _united(table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()], axis=0)
    return pa.table([table.column("part").slice(0, 1), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])


def marked(rows: DataFrame, cells: int) -> np.ndarray:
    """Which cells the phrases of rows (phrases) have. The driver receives a bit for each cell."""
    bits = np.zeros(cells, bool)
    parts = rows.mapInArrow(_marking(cells), "part int, bits binary").groupBy("part").applyInArrow(_united, "part int, bits binary")
    for r in parts.collect():
        bits[r.part * PART * 8 : (r.part + 1) * PART * 8] = np.unpackbits(np.frombuffer(r.bits, np.uint8))
    return bits


def _counted(batches):
    for batch in batches:
        for row in batch.select(["length", "phrases", "counts"]).to_pylist():
            phrases = _phrases(row["phrases"]).view(np.int64)
            counts = unpacked(row["counts"]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(phrases), pa.array(np.full(len(phrases), row["length"]), pa.int32()), pa.array(counts)], ["hash", "length", "n"])


def _spelling(cells: np.ndarray, longest: int):
    """Phrases that have their cells, each once per task: their text and the hashes of what cuts leave."""

    def spell(batches):
        known = np.zeros(0, np.uint64)
        for chunk, names in _chunks(batches):
            words, new = _texts(chunk.buffer, chunk.starts, chunk.ends), []
            runs, valid = [chunk.tokens], chunk.tokens > 0
            for length in range(2, longest + 1):
                run = np.zeros(len(chunk.tokens), np.uint64)
                run[1:] = _longer(runs[-1][:-1], chunk.tokens[1:])
                runs.append(run)
                valid = (chunk.tokens > 0) & np.concatenate([[False], valid[:-1]])
                ends = np.flatnonzero(valid)
                ends = ends[reached_in(cells, run[ends]) > 0]
                found, first = np.unique(run[ends], return_index=True)
                fresh = ~np.isin(found, known)
                found, ends = found[fresh], ends[first[fresh]]
                if not len(found):
                    continue
                new.append(found)
                text = pc.binary_join_element_wise(*[words.take(pa.array(chunk.words[ends - length + j])) for j in range(1, length + 1)], " ")
                # Cut after the first j words.
                heads = np.stack([runs[j - 1][ends - length + j] for j in range(1, length)], axis=1)
                tails = np.stack([runs[length - j - 1][ends] for j in range(1, length)], axis=1)
                offsets = pa.array(np.arange(len(ends) + 1) * (length - 1), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel().view(np.int64))) for x in (heads, tails)]
                lang = names.take(pa.array(chunk.langs[chunk.words[ends]]))
                columns = [pa.array(found.view(np.int64)), pa.array(np.full(len(ends), length), pa.int32()), lang, text, *lists]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PHRASE.split(", ")])
            if new:
                known = np.union1d(known, np.concatenate(new))

    return spell


def counted(texts: DataFrame, tokens: int, shards: int = SHARDS, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Rows (length, phrases, counts) of all phrases that occur ``least`` times in texts (text, lang, shard), in packed form.

    The driver holds the cells, a byte for 8 tokens and 64 MB at most, and per scan receives a bit for each. Scans follow each
    other until every active phrase has been counted in all shards: ``longest`` cycles at the most.
    """
    bits = max(5, int(tokens // BUCKET).bit_length())
    cells = np.zeros(cells_for(tokens), np.uint8)
    step = last = 0
    tables: list[DataFrame] = []
    while step < last + shards:
        step += 1
        rows = texts.where(F.col("shard") == (step - 1) % shards).select("text", "lang").mapInArrow(_scanning(cells, step, shards, longest, bits), COUNTS)
        if tables:
            rows = rows.unionByName(tables[-1].where(F.col("kind") == RUNNING))
        tables.append(stored(rows.groupBy("bucket").applyInArrow(_merging(step, shards, least), COUNTS), "phrase-counts"))
        new = marked(tables[-1].where((F.col("kind") == REACHED) & (F.col("length") < longest)).select("phrases"), len(cells))
        cells[new & (cells == 0)] = step
        last = step if new.any() else last
    return reduce(DataFrame.unionByName, tables).where(F.col("kind") == FINAL).select("length", "phrases", "counts")


def cells_for(tokens: int) -> int:
    return min(max(CELLS[0], 1 << int(tokens // TOKENS_PER_CELL).bit_length()), CELLS[1])


def spelled(texts: DataFrame, final: DataFrame, counts: DataFrame, cells: int, longest: int) -> DataFrame:
    """The texts of counted phrases of two words and more. Most stand in a part of the first shard; all else is scanned for the rest."""

    def found(where: DataFrame, marks: np.ndarray) -> DataFrame:
        return where.select("text", "lang").mapInArrow(_spelling(marks.astype(np.uint8), longest), PHRASE).dropDuplicates(["hash"])

    first = stored(found(texts.where("part = 0"), marked(final.where("length > 1").select("phrases"), cells)), "spelled")
    rest = counts.where("length > 1").join(first, "hash", "left_anti").select("hash").mapInArrow(_single, "phrases binary")
    second = found(texts.where("part > 0"), marked(rest, cells))
    return first.unionByName(second).dropDuplicates(["hash"])


def _single(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_gaps(np.sort(np.asarray(batch.column("hash")).view(np.uint64)))], pa.binary())], ["phrases"])


def collocations(
    docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, share: int = SHARE
) -> DataFrame:
    """The ``top`` phrases of each language in ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split into pieces at .,;:!? and line ends, and those into words at blanks and tabs. A null
    text is empty, a null lang is ``und``. Phrases of 2 to ``longest`` words that occur a >= ``least`` times within pieces are
    candidates, overlaps included. Cut in two, with l and r the occurrences of both parts and n all words of the language, a
    phrase scores floor(1000 a n / (l r)); its lowest-scoring cut counts, of equal ones that with the shorter first part. A
    candidate is dropped if it stands inside a longer one that has ``share`` percent of its occurrences. Order: score and a
    descending, then the phrase by its bytes, ascending. Repeated rows count each. Very long texts are cut at ends of pieces.

    Words and phrases are known by 64-bit hashes: a candidate is miscounted with a probability of the number of different
    phrases counted over 2**64. Shards are dealt by the hash of a text; nothing but counts is shuffled or written.
    """
    small_batches(docs)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    sizes = stored(texts.mapInArrow(_sizing, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    tokens = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts = texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(shards * PARTS))).withColumn("shard", F.col("part") % shards)
    final = stored(counted(texts, tokens, shards, longest, least), "final-counts")
    counts = stored(final.mapInArrow(_counted, "hash long, length int, n long"), "phrases")
    candidates = spelled(texts, final, counts, cells_for(tokens), longest).join(counts.select("hash", F.col("n").alias("a")), "hash")
    return _ranked(stored(candidates, "candidates"), counts.select("hash", "n"), sizes, top, share)


def _ranked(candidates: DataFrame, counts: DataFrame, sizes: DataFrame, top: int, share: int) -> DataFrame:
    """Drops what stands inside longer candidates, scores the rest and keeps the best of each language. A phrase one word
    longer is enough to look at: it occurs at least as often as any longer one that it is in."""
    inside = F.explode(F.array(F.element_at("heads", -1), F.col("tails")[0])).alias("hash")
    longer = candidates.where(F.col("length") > 2).select(inside, "a").groupBy("hash").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, "hash", "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    cuts = kept.select("hash", "lang", "phrase", "a", F.posexplode(F.arrays_zip("heads", "tails")).alias("cut", "of"))
    cuts = cuts.select("hash", "lang", "phrase", "a", "cut", F.col("of.heads").alias("head"), F.col("of.tails").alias("tail"))
    cuts = cuts.join(counts.select(F.col("hash").alias("head"), F.col("n").alias("l")), "head").join(counts.select(F.col("hash").alias("tail"), F.col("n").alias("r")), "tail")
    score = F.expr("(cast(a AS decimal(19,0)) * cast(n AS decimal(19,0)) * 1000) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("lowest")
    scored = cuts.join(sizes, "lang").groupBy("hash", "lang", "phrase", "a", "n").agg(lowest)
    best = Window.partitionBy("lang").orderBy(F.col("lowest.score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "lowest.l", "lowest.r", "n", "lowest.score")
