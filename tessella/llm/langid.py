"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton holds the words of a bounded sample of
labelled text. A text is cut greedily into the longest pieces that occur in
that language's text (a character that occurs nowhere is a piece of its own);
the number of pieces per character, times the logarithm of the sample's size,
estimates the cross entropy of the text with respect to the language. The
language that needs the fewest normalised pieces wins.

A piece does not cross the end of a word, so a word is cut the same way
wherever it stands, and a worker keeps the counts of the words it has met.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.llm.common import rows_of, worker_memo

#: Sampled documents per language, and the length of the text that their distinct words make, drawn from all of them.
SAMPLE_ROWS = 200
SAMPLE_LETTERS = 60_000
#: A sample of fewer characters counts as one of so many, or each piece of any text would cost it next to nothing.
LEAST_LETTERS = 1024
#: Rows that are ranked for the sample, times those wanted.
CANDIDATES = 3
WORDS_KEPT = 400_000
_FIELD = 40

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, in lower case; numerals such as one half are none."""
    found = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


class WordAutomaton:
    """Suffix automaton of one text, its edges in one flat dictionary keyed by state and character."""

    def __init__(self, text: str) -> None:
        self.text_length = len(text)
        edges: list[dict[str, int]] = [{}]
        link, length = array("i", [-1]), array("i", [0])
        last = 0
        for c in text:
            new = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(edges)
                    edges.append(dict(edges[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[new] = twin
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = link[p]
            last = new
        self.edges = edges

    def pieces(self, word: str) -> int:
        """Longest matches, one after the other, that cover the word."""
        edges, root = self.edges, self.edges[0]
        state, n, fresh = root, 0, True
        for c in word:
            to = state.get(c)
            if to is None:
                n += 0 if fresh else 1
                to = root.get(c)
                if to is None:
                    n, state, fresh = n + 1, root, True
                    continue
            state, fresh = edges[to], False
        return n if fresh else n + 1


@dataclass(frozen=True)
class Sample:
    """Per language the text its automaton is built on, in the order of the names."""

    texts: tuple[tuple[str, str], ...]

    @property
    def key(self) -> str:
        return hashlib.sha256(repr(self.texts).encode()).hexdigest()


class Identifier:
    def __init__(self, sample: Sample) -> None:
        self.names = [name for name, _ in sample.texts]
        self.automata = [WordAutomaton(text) for _, text in sample.texts]
        self.weights = [math.log2(max(LEAST_LETTERS, a.text_length)) for a in self.automata]
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        """The piece counts of all languages, packed into one number."""
        marked, packed = f" {word} ", 0
        for k, a in enumerate(self.automata):
            packed |= a.pieces(marked) << (_FIELD * k)
        if len(word) <= 40:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            self.known[word] = packed
        return packed

    def predict(self, text: str) -> tuple[str, float]:
        """(language, score); ``und`` and 0 for a text without a letter, or if nothing was learned."""
        found = words(text)
        if not found or not self.names:
            return "und", 0.0
        known, make, total = self.known, self._word, 0
        for w in found:
            total += known.get(w) or make(w)
        mask = (1 << _FIELD) - 1
        costs = [((total >> (_FIELD * k)) & mask) * w for k, w in enumerate(self.weights)]
        order = sorted(range(len(costs)), key=lambda k: (costs[k], self.names[k]))
        best = order[0]
        if len(order) == 1:
            return self.names[best], 1.0
        # One half if the next language needs as little, towards one the more it needs.
        return self.names[best], 1.0 - 0.5 * math.exp(-8.0 * (costs[order[1]] / costs[best] - 1.0))


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Sample:
    """The labelled sample, from rows with a language for which ``train`` (over ``doc_id``) holds.

    At most ``SAMPLE_ROWS`` documents per language, those of the smallest hash of
    id and text among texts with a letter, of any length and read whole;
    repeated rows count once, null ids are ids. Their distinct words, by a hash
    of the word and so from all over the texts, make the language's text up to
    ``SAMPLE_LETTERS`` characters. Every language with a word is learned.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = own.where(F.col("lang").isNotNull() & train & F.regexp_like("text", F.lit(r"\p{L}"))).withColumn("h", F.xxhash64("doc_id", "text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    # Hashes below this bound are some CANDIDATES times the rows wanted, so those dealt out are few; the least of them are taken.
    bound = F.broadcast(counts.select("lang", (F.lit(float(CANDIDATES * SAMPLE_ROWS)) / F.greatest("n", F.lit(1))).alias("bound")))
    share = F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    few = rows.withColumn("share", share).join(bound, "lang").where(F.col("share") <= F.col("bound")).dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("share", "h"))
    picked = few.withColumn("place", place).where(F.col("place") <= SAMPLE_ROWS).select("lang", "text")
    met = picked.mapInArrow(_words_met, "lang string, word string").distinct()
    # The hash order is any order, the same in every run; a language has as many words as so many documents hold.
    size = F.sum(F.length("word") + 1).over(Window.partitionBy("lang").orderBy(F.xxhash64("word"), "word"))
    kept = met.withColumn("size", size).where(F.col("size") - F.length("word") <= SAMPLE_LETTERS)
    texts: dict[str, list[str]] = {}
    for r in sorted(kept.collect(), key=lambda r: (r["lang"], r["size"])):
        texts.setdefault(r["lang"], []).append(r["word"])
    return Sample(tuple((name, f" {' '.join(texts[name])} ") for name in sorted(texts)))


def _words_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word) of every distinct word of each text."""
    for batch in rows_of(batches):
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            met = list(dict.fromkeys(words(text)))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(met), pa.string()), "word": pa.array(met, pa.string())})


def predict(df: DataFrame, sample: Sample, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in ``keep``, then lang_pred and score (0 to 1).

    A null text, an empty one and one without letters give ``und`` with score
    0. Rows are independent; an empty table gives none.
    """
    # Plain strings travel: executors may lack this package's classes.
    key, shared = sample.key, df.sparkSession.sparkContext.broadcast(sample.texts)
    keep = keep or {}
    names = [*keep, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = worker_memo("langid:" + key, lambda: Identifier(Sample(shared.value)))
        for batch in rows_of(batches):
            made = [of.predict(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=names)

    source = df.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text}`").cast("string").alias("__text"))
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*head, "lang_pred string, score double"]))
