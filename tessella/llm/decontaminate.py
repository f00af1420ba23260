"""Benchmark decontamination by spaced-seed hashing.

Texts are sequences of words; in scripts without spaces each character is one. A seed is a fixed mask over a few neighbouring
words; the words at its open places are hashed, those between are ignored. The
masks are chosen so that every stretch of ``STRETCH`` words with up to a fifth
of them substituted still holds at least one hit of one mask. Test and training
hashes are joined; each hit fixes how the two texts lie against each other, and
the words around it are compared under that alignment: a document overlaps with
an item if in some stretch of ``STRETCH`` aligned words at most ``SUBSTITUTED`` differ.
Shorter items are looked for as a whole, with as many substitutions in proportion,
and the shortest ones where they fill whole lines, word for word. A stretch of
characters is twice as long as one of words.

Test sets are small beside a corpus. They are taken in blocks of bounded size;
a block's hashes and words are broadcast, and the corpus is joined with it
where it lies: no text is shuffled and no common passage meets in one task. A
larger test set takes more blocks, and the result is the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import rows_of, worker_memo

# Open places of the masks. Together they meet every 13 words with 2 of them substituted.
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 3, 6, 7))
STRETCH, SUBSTITUTED = 13, 2
#: Items of fewer words say nothing within a sentence: they must fill whole lines of a text.
LEAST_WORDS = 5
#: Hashes in a block of test items, about 30 MB.
BLOCK_HASHES = 1_000_000
_TABLE_BITS = 23
WORDS_KEPT = 300_000

# Letters, marks and digits of scripts written without spaces between words (Thai, Lao, Myanmar, Khmer, Tai, Javanese, kana, Han, Yi).
_UNSPACED = (r"\u0e01-\u0e3a\u0e40-\u0e4e\u0e50-\u0e59\u0e81-\u0eff\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17dc-\u17e9\u1950-\u19d9\u1a20-\u1a9f"
             r"\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48c"
             r"\ua980-\ua9c0\ua9cf-\ua9d9\ua9e0-\ua9fe\uaa60-\uaadd\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
_WORD = re.compile(r"[^\W_]+")
_CHARACTER = re.compile(f"[{_UNSPACED}]")
_EITHER = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")


def words(text: str) -> list[str]:
    text = text.lower()
    return (_WORD if text.isascii() or not _CHARACTER.search(text) else _EITHER).findall(text)


def _unit(found: list[str]) -> int:
    """Tokens that count as one word: two if most are characters of scripts without spaces."""
    return 1 + (2 * sum(map(bool, map(_CHARACTER.match, found))) > len(found))


def _substituted(n: int) -> int:
    """Words of ``n`` that may differ."""
    return SUBSTITUTED * n // STRETCH


def lines_of(text: str) -> tuple[set[int], set[int]]:
    """The numbers of the words that begin a line, and of those that follow a line's end."""
    starts, ends, at = set(), set(), 0
    for line in text.splitlines():
        n = len(words(line))
        if n:
            starts.add(at)
            at += n
            ends.add(at)
    return starts, ends


class _Hashes(dict):
    """Word hashes, filled as words come."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_hashes(text: str, known: dict) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def _masks_for(length: int) -> list[tuple[int, ...]]:
    """The masks for an item of so many words. Below a stretch: every other word, which meets any one substitution, or all words if none may differ."""
    if length >= STRETCH:
        return list(MASKS)
    return [tuple(range(0, length // 2 * 2, 2)) if _substituted(length) else tuple(range(length))]


def seed_hashes(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash of the open words at every place where the mask fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.array([], np.uint64)
    out = np.full(n, len(mask) * 1_000_003 + sum(p << (3 * k) for k, p in enumerate(mask)), np.uint64)
    for p in mask:
        out = (out ^ h[p:p + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


@dataclass(frozen=True)
class Block:
    """Test items: ids and texts."""

    items: tuple[tuple[int, str], ...]

    @property
    def key(self) -> str:
        return hashlib.sha256(repr(self.items).encode("utf-8", "surrogatepass")).hexdigest()


class Index:
    """A block's seed hashes, sorted, with the item and the place of each."""

    def __init__(self, block: Block) -> None:
        self.known = _Hashes()
        self.items = [(i, word_hashes(t, self.known)) for i, t in block.items]
        self.units = [_unit(words(t)) for _, t in block.items]
        self.lengths: set[tuple[int, ...]] = set()
        hashes, owners, places = [], [], []
        for k, (_, h) in enumerate(self.items):
            if not len(h):
                continue
            for mask in _masks_for(len(h)) if len(h) >= LEAST_WORDS * self.units[k] else [tuple(range(len(h)))]:
                self.lengths.add(mask)
                own = seed_hashes(h, mask)
                hashes.append(own)
                owners.append(np.full(len(own), k))
                places.append(np.arange(len(own)))
        h = np.concatenate(hashes or [np.array([], np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owners, self.places = (np.concatenate(x or [np.array([], np.int64)])[order] for x in (owners, places))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True

    def hits(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(item, shift of the text against it) of all seed hits, in order."""
        found = np.array([], np.int64)
        for mask in self.lengths:
            own = seed_hashes(h, mask)
            at = np.flatnonzero(self.table[own >> np.uint64(64 - _TABLE_BITS)])
            if len(at):
                first, last = np.searchsorted(self.hashes, own[at], "left"), np.searchsorted(self.hashes, own[at], "right")
                # Frequent seeds meet many times: shifts are packed and made distinct in slices.
                met = np.flatnonzero(first < last)
                ends = np.cumsum(last[met] - first[met])
                start = 0
                while start < len(met):
                    stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), "right")))
                    own_ = met[start:stop]
                    span = last[own_] - first[own_]
                    hit = np.repeat(first[own_] - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
                    shift = np.repeat(at[own_], span) - self.places[hit] + (1 << 30)
                    found = np.union1d(found, (self.owners[hit].astype(np.int64) << 32) + shift)
                    start = stop
        return list(zip((found >> 32).tolist(), ((found & ((1 << 32) - 1)) - (1 << 30)).tolist(), strict=True))

    def overlaps(self, text: str) -> list[tuple[int, int, int, float]]:
        """(item id, first word in the text, words, likeness) of each item that the text overlaps with, in its best alignment.

        The words reach from the first like stretch to the last; the likeness is that of the best stretch.
        """
        h = word_hashes(text, self.known)
        lines: tuple[set[int], set[int]] | None = None
        best: dict[int, tuple[int, int, int, float]] = {}
        for k, shift in self.hits(h):
            item_id, item = self.items[k]
            if k in best and best[k][2:] == (len(item), 1.0):
                continue  # the whole item, word for word: no later place is better
            start, end = max(0, shift), min(len(h), shift + len(item))
            need = min(STRETCH * self.units[k], len(item))
            if end - start < need:
                continue
            least = need - _substituted(need)
            if len(item) < LEAST_WORDS * self.units[k]:
                lines = lines or lines_of(text)
                if start not in lines[0] or end not in lines[1]:
                    continue
                least = need
            same = (h[start:end] == item[start - shift:end - shift]).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(same)))
            equal = total[need:] - total[:-need]
            enough = np.flatnonzero(equal >= least)
            if len(enough):
                a, b = int(enough[0]), int(enough[-1]) + need
                row = item_id, start + a, b - a, float(equal.max() / need)
                if k not in best or (row[2] * row[3], -row[1]) > (best[k][2] * best[k][3], -best[k][1]):
                    best[k] = row
        return [best[k] for k in sorted(best)]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text: str = "text") -> Iterator[Block]:
    """The distinct test items in blocks of at most about ``BLOCK_HASHES`` seed hashes."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).distinct()
    held, size = [], 0
    for r in rows.orderBy(F.col("i").asc_nulls_first(), "t").toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(MASKS) * (len(r["t"]) // (1 if _CHARACTER.search(r["t"]) else 2) + 1)
        if size >= BLOCK_HASHES:
            yield Block(tuple(held))
            held, size = [], 0
    if held:
        yield Block(tuple(held))


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """A row for each document and test item that overlap: the columns in ``keep``, item_id, first_word, n_words, likeness.

    Documents without an overlap have no row. Null and empty texts overlap
    with nothing, and neither do items without a word; items of fewer than
    ``LEAST_WORDS`` words are found where they fill whole lines. Repeated
    documents each get their rows, repeated items count once. Long texts are
    read whole. Empty tables on either side give an empty result.
    """
    source = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["item_id long, first_word int, n_words int, likeness double"])
    names = [*keep, "item_id", "first_word", "n_words", "likeness"]

    def of(block: Block) -> DataFrame:
        # Plain ids and texts travel: executors may lack this package's classes.
        key, shared = block.key, docs.sparkSession.sparkContext.broadcast(block.items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = worker_memo("decontaminate:" + key, lambda: Index(Block(shared.value)))
            for batch in rows_of(batches):
                rows, found = [], []
                for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    own = index.overlaps(t) if t else []
                    rows += [k] * len(own)
                    found += own
                if rows:
                    kept = batch.take(pa.array(rows))
                    made = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *made], names=names)

        return source.mapInArrow(run, schema)

    made = [of(b) for b in blocks(benchmark)]
    return reduce(DataFrame.unionByName, made) if made else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that overlap with no test item, all columns as they are."""
    for block in blocks(benchmark):
        key, shared = block.key, docs.sparkSession.sparkContext.broadcast(block.items)

        def clean(texts: pa.Array, key=key, shared=shared) -> pa.Array:
            index = worker_memo("decontaminate:" + key, lambda: Index(Block(shared.value)))
            return pa.array([not (t and index.overlaps(t)) for t in texts.to_pylist()], pa.bool_())

        docs = docs.where(_bool(clean)(F.col(f"`{text}`").cast("string")))
    return docs


def _bool(f):
    def of(texts: pa.Array) -> pa.Array:
        return f(texts)

    return F.arrow_udf(of, "boolean")
