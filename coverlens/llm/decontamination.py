"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, one scan of each text.

The automaton's letters are whole words: every word of the benchmark gets a code point, any other word of a document
the code point 0, and the patterns are the items' windows in these letters. A document becomes a string with a letter
per word, so a match's place in it is a word's number, which maps back to the word's place in the original text.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coverlens.llm.common import fresh, small_batches, without
from coverlens.session import stored

WINDOW = 13
# Words of benchmark text that one automaton holds at most, about 100 bytes each in a worker. A larger benchmark is
# matched in several blocks, one pass over the documents after the other.
BLOCK_WORDS = 1_000_000
OWN = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "hit_spans")

# A-Z becomes a-z; what is no letter, digit or non-ASCII byte becomes a space.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def _blocks(benchmark: DataFrame, words: int, window: int):
    """Lists of (item_id, words) with at most so many words, fetched bit by bit. Wordless items are left out.

    A longer item is cut into pieces that overlap by a window less one word, so that together they have its windows.
    """
    block, held, size = [], 0, max(words, window)
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        found = normal_words(text)
        for start in range(0, max(len(found) - window, 0) + 1, size - window + 1):
            piece = found[start : start + size]
            if block and held + len(piece) > size:
                yield block
                block, held = [], 0
            if piece:
                block.append((item, piece))
                held += len(piece)
    if block:
        yield block


class Matcher:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.letters: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, set] = {}
        for item, words in items:
            for w in words:
                if w not in self.letters:
                    n = len(self.letters) + 1
                    self.letters[w] = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
            text = "".join(self.letters[w] for w in words)
            for i in range(max(1, len(text) - window + 1)):
                owners.setdefault(text[i : i + window], set()).add(item)
        for pattern, of in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(of)))
        self.automaton.make_automaton()

    def scan(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        text = "".join(map(self.letters.get, words, repeat("\0")))
        for end, (size, of) in self.automaton.iter(text):
            hit[end + 1 - size : end + 1] = True
            items.update(of)


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as places in the original text, in characters."""
    raw = text.encode()
    places = np.array([m.span() for m in _WORD.finditer(raw.translate(_NORMAL))])
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"begin": int(chars[places[a, 0]]), "end": int(chars[places[b - 1, 1]])} for a, b in zip(edges[::2], edges[1::2])]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns plus, for each document, what it has of the benchmark.

    n_words and n_hit (long) count its words and those inside any occurrence of a window of ``window`` consecutive
    item words (an item of fewer words is one window). items (array of long, sorted as text) are the items with such
    a window, n_items their number, items_sha256 the hash of their list. hit_spans (array of begin, end in characters
    of the original text) are the runs of hit words. contaminated: a twentieth of the words or more are hit.

    A missing or empty text has no words and is clean. An item with a missing id counts as a hit but is not listed;
    repeated items count once. With an empty benchmark every document is clean. Input columns that have one of the
    added names are replaced. The benchmark reaches the tasks in blocks of ``block_words`` words,
    or of a window if that is more, however long an item is, so their size is bounded.
    """
    docs = small_batches(without(docs, *OWN))
    mask, found = fresh(docs, "hit_mask", "found_items")
    marked = docs.withColumns({mask: F.lit(None).cast("binary"), found: F.array().cast("array<bigint>")})
    spark = docs.sparkSession

    def scanning(block):
        sent = spark.sparkContext.broadcast(block)

        def scan(batches):
            matcher = Matcher(sent.value, window)
            for batch in batches:
                masks, lists = [], []
                texts, old_masks, old_lists = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", mask, found))
                for text, old_mask, old_list in zip(texts, old_masks, old_lists):
                    words, items = normal_words(text), set(old_list)
                    hit = np.frombuffer(old_mask, bool).copy() if old_mask else np.zeros(len(words), bool)
                    matcher.scan(words, hit, items)
                    masks.append(hit.tobytes() if hit.any() else None)
                    lists.append([i for i in items if i is not None])
                columns = [
                    pa.array(masks, f.type) if f.name == mask else pa.array(lists, f.type) if f.name == found else batch.column(i)
                    for i, f in enumerate(batch.schema)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return scan

    for i, block in enumerate(_blocks(benchmark, block_words, window)):
        if i:  # written in between, so that no task holds two automata
            marked = stored(marked, "marked")
        marked = marked.mapInArrow(scanning(block), marked.schema)

    own = "n_words long, n_hit long, items array<bigint>, items_sha256 string, hit_spans array<struct<begin:int,end:int>>"
    output = docs.schema
    for field in StructType.fromDDL(own):
        output = output.add(field)

    def finish(batches):
        for batch in batches:
            texts, masks, lists = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", mask, found))
            n_words, n_hit, items, digests, spans = [], [], [], [], []
            for text, old_mask, old_list in zip(texts, masks, lists):
                hit = np.frombuffer(old_mask, bool) if old_mask else None
                listed = sorted(set(old_list), key=str)
                n_words.append(len(hit) if hit is not None else len(normal_words(text)))
                n_hit.append(int(hit.sum()) if hit is not None else 0)
                items.append(listed)
                digests.append(hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest())
                spans.append(_spans(text, hit) if hit is not None else [])
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] not in (mask, found)]
            added = [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(items, pa.list_(pa.int64())),
                pa.array(digests, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(kept + added, names=output.names)

    done = marked.mapInArrow(finish, output)
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return done.withColumns({"n_items": F.size("items").cast("long"), "contaminated": contaminated})


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    return contamination(docs, benchmark, **options).where("NOT contaminated").select(*[F.col(f"`{c}`") for c in without(docs, *OWN).columns])
