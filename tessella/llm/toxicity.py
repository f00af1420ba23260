"""Toxic passages by a maximum-scoring segment search.

* Each token has a score: the log-odds of its share of the documents labelled
  toxic against the others, under Dirichlet priors taken from all labelled
  documents, kept where it is significant; other tokens cost a little, so that
  the score of ordinary text falls. A token also has the scores of its
  beginnings, so that an inflected form counts that was never met; the highest
  is taken.
* One pass over a text finds all maximal scoring segments in linear time.
* Extreme-value calibration makes segment scores comparable: in ordinary text
  of n tokens a score beyond S is met about K n exp(-lambda S) times, lambda
  being the root of the mean of exp(lambda s) = 1. A segment is significant if
  that number is below ``SIGNIFICANT``.
* A document's statistic is the sum of its significant segments' normalised
  scores; a logistic curve fitted on the labelled documents turns it into a
  probability.

Labels are learned from a bounded sample (``MOST_LABELLED`` rows, those with
the least hash of the id); every document is scored from its whole text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import fold, materialize, rows_of, worker_memo

#: Labelled rows that the model is fitted on, at most.
MOST_LABELLED = 100_000
#: Forms counted by a task before it hands its counts on.
FORMS_HELD = 500_000
#: Lengths of a token's beginnings that are counted beside the token itself.
STEMS = (4, 5, 6)
#: Weight of the prior, in documents.
PRIOR = 50.0
#: Least z-score of a token that counts, and what any other token costs.
LEAST_Z = 3.0
COST = 0.3
#: Expected number of chance segments below which a segment is significant.
SIGNIFICANT = 0.05
#: Cells of the statistic, for fitting the curve.
CELLS = 64
TOKENS_KEPT = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def forms(token: str) -> list[str]:
    """The token and its beginnings: what an inflected word shares with its other forms."""
    return [token, *[f"{token[:n]}*" for n in STEMS if len(token) > n]]


@dataclass(frozen=True)
class Model:
    """Scores of the forms that count, the extreme-value parameters, and the curve: intercept, slope."""

    scores: dict[str, float]
    rate: float
    scale: float
    curve: tuple[float, float] = (0.0, 0.0)

    @property
    def key(self) -> str:
        return hashlib.sha256(repr((sorted(self.scores.items()), self.rate, self.scale, self.curve)).encode("utf-8", "surrogatepass")).hexdigest()

    @property
    def plain(self) -> tuple:
        """What is broadcast: executors may lack this package's classes."""
        return self.scores, self.rate, self.scale, self.curve


class _Scores(dict):
    """Scores of the tokens met, filled as they come."""

    def __init__(self, scores: dict[str, float]) -> None:
        super().__init__()
        self.scores = scores

    def __missing__(self, token: str) -> float:
        if len(self) >= TOKENS_KEPT:
            self.clear()
        self[token] = value = max(self.scores.get(f, -COST) for f in forms(token))
        return value


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Candidates lie on a stack with the running total before and after each.
    A new one is joined to the nearest earlier one that starts lower, unless
    that one already ends as high. The stack of lower starts is followed by
    links, so the whole scan is linear. Runs of equal sign count as one step.
    """
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], up, [False])).astype(np.int8)))
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # start, end, total before, total after, link to the nearest earlier lower start
    for start, end in edge.reshape(-1, 2).tolist():
        low, high = float(total[start]), float(total[end])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([start, end, low, high, j])
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, after - before) for s, e, before, after, _ in found]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.of = model, _Scores(model.scores)

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant segments: first token, token after the last, normalised score."""
        words = tokens(text)
        scores = np.fromiter(map(self.of.__getitem__, words), np.float64, len(words))
        cut = math.log(max(self.model.scale * len(words), 1e-12))
        found = [(s, e, self.model.rate * v - cut) for s, e, v in segments(scores)]
        return [x for x in found if x[2] > -math.log(SIGNIFICANT)]

    def statistic(self, text: str) -> float:
        """Logarithm of one and the significant segments' normalised scores."""
        return math.log1p(sum(x[2] for x in self.passages(text)))

    def score(self, statistic: float) -> float:
        a, b = self.model.curve
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * statistic))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, toxic, clean) document counts of a partition; the empty form counts the documents."""
    found: tuple[Counter, Counter] = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        names = list(found[0].keys() | found[1].keys())
        batch = pa.RecordBatch.from_pydict({
            "form": pa.array(names, pa.string()), "toxic": pa.array([found[1][f] for f in names], pa.int64()), "clean": pa.array([found[0][f] for f in names], pa.int64())})
        for c in found:
            c.clear()
        return batch

    for batch in rows_of(batches):
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {f for t in set(tokens(text or "")) for f in forms(t)}
            own.add("")
            found[label].update(own)
            if len(found[0]) + len(found[1]) > FORMS_HELD:
                yield flush()
    yield flush()


def _shares(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    return (toxic + clean + 0.5) / (n_toxic + n_clean + 1.0)


def background(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How often tokens are met in ordinary text: counts of the documents that are not toxic, and one document of the prior."""
    return np.where(toxic + clean > 0, clean + _shares(toxic, clean, n_toxic, n_clean), 0.0)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Token scores: the log-odds ratio where its z-score is beyond the least, less the cost of any token."""
    share = _shares(toxic, clean, n_toxic, n_clean)
    a, b = toxic + PRIOR * share, clean + PRIOR * share
    ratio = np.log(a / (n_toxic + PRIOR - a + 1.0)) - np.log(b / (n_clean + PRIOR - b + 1.0))
    z = ratio / np.sqrt(1.0 / a + 1.0 / b)
    return np.where(np.abs(z) >= LEAST_Z, ratio, 0.0) - COST


def _z(n_toxic: int, n_clean: int) -> Column:
    """The z-score of :func:`log_odds` over the columns ``toxic`` and ``clean``."""
    share = (F.col("toxic") + F.col("clean") + 0.5) / (n_toxic + n_clean + 1.0)
    a, b = F.col("toxic") + PRIOR * share, F.col("clean") + PRIOR * share
    ratio = F.ln(a / (n_toxic + PRIOR - a + 1.0)) - F.ln(b / (n_clean + PRIOR - b + 1.0))
    return ratio / F.sqrt(F.lit(1.0) / a + F.lit(1.0) / b)


def extreme_value(scores: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of maximal segments in text whose tokens come from ``weights``.

    Lambda is the positive root of the mean of exp(lambda s) = 1. K is the
    usual approximation by the mean step under the tilted distribution.
    """
    p = weights / weights.sum()
    mean = lambda x: float(p @ np.exp(np.minimum(x * scores, 600.0)))
    if not (scores[weights > 0] > 0).any():
        return 1.0, 1.0
    low, high = 1e-6, 1.0
    while mean(high) < 1.0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = 0.5 * (low + high)
        low, high = (middle, high) if mean(middle) < 1.0 else (low, middle)
    rate = 0.5 * (low + high)
    drift = float(p @ (scores * np.exp(np.minimum(rate * scores, 600.0))))
    return rate, max(1e-6, rate * float(p @ scores) ** 2 / max(drift, 1e-9))


def _curve(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    """A logistic curve through (statistic, rows, toxic rows), by Newton steps with a small ridge."""
    x = np.array([c[0] for c in cells])
    n, k = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (k - n * p) - 0.1 * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def labelled_sample(labels: DataFrame, train: Column, id_col: str = "doc_id", label: str = "toxic", most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, label): labelled ids to learn from, one row each, at most ``most``, those with the least hash."""
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    one = own.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & train).groupBy("doc_id").agg(F.max("label").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", train: Column | None = None) -> Model:
    """A model from the labelled documents for which ``train`` (over ``doc_id``) holds.

    Forms are counted exactly. A document labelled both ways counts as toxic.

    Without labelled rows of both kinds all scores are the share of toxic rows.
    """
    train = F.lit(True) if train is None else train
    chosen = F.broadcast(labelled_sample(labels, train, id_col, label))  # MOST_LABELLED rows of 12 bytes at most
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = own.join(chosen, "doc_id").select("label", "text")
    counted = materialize(rows.mapInArrow(_count, "form string, toxic long, clean long").groupBy("form").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    total = counted.where("form = ''").first()
    n_toxic, n_clean = (total["toxic"], total["clean"]) if total else (0, 0)
    if not (n_toxic and n_clean):
        odds = math.log((n_toxic + 0.5) / (n_clean + 0.5)) if n_toxic + n_clean else -40.0
        return Model({}, 1.0, 1.0, (odds, 0.0))
    forms_ = counted.where("form <> ''")
    # Only forms that count are gathered: few beside those met, and of documents whose number is bounded.
    beyond = forms_.where(F.abs(_z(n_toxic, n_clean)) >= LEAST_Z * (1 - 1e-9)).orderBy("form").toArrow()
    toxic, clean = beyond.column("toxic").to_numpy(), beyond.column("clean").to_numpy()
    scores = log_odds(toxic, clean, n_toxic, n_clean)
    weights = background(toxic, clean, n_toxic, n_clean)
    share = (F.col("toxic") + F.col("clean") + 0.5) / (n_toxic + n_clean + 1.0)
    rest = max(0.0, (forms_.agg(F.sum(F.col("clean") + share)).first()[0] or 0.0) - float(weights.sum()))
    rate, scale = extreme_value(np.append(scores, -COST), np.append(weights, rest))
    model = Model(dict(zip(beyond.column("form").to_pylist(), scores.tolist(), strict=True)), rate, scale)
    key, shared = model.key, docs.sparkSession.sparkContext.broadcast(model.plain)

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_memo("toxicity-fit:" + key, lambda: Scorer(Model(*shared.value)))
        for batch in rows_of(batches):
            x = [round(scorer.statistic(t or "") * CELLS / 8) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(x, pa.int64()), "label": batch.column(0)})

    cells = rows.mapInArrow(statistics, "cell long, label int").groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect()
    return Model(model.scores, rate, scale, _curve([(r["cell"] * 8 / CELLS, r["n"], r["k"]) for r in cells]))


def score(df: DataFrame, model: Model, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in ``keep``, then score (0 to 1), n_passages (long), passages (array of first token, token after the last, normalised score).

    A null or empty text has no passage and the score of such texts; long texts
    are read whole, in one linear scan. Rows are
    independent: repeated rows are all scored, an empty table gives none.
    """
    key, shared = model.key, df.sparkSession.sparkContext.broadcast(model.plain)
    keep = keep or {}
    names = [*keep, "score", "n_passages", "passages"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_memo("toxicity:" + key, lambda: Scorer(Model(*shared.value)))
        for batch in rows_of(batches):
            found = [scorer.passages(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            p = [scorer.score(math.log1p(sum(x[2] for x in own))) for own in found]
            spans = [[{"start": s, "end": e, "score": v} for s, e, v in own] for own in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array(map(len, found), pa.int64()), pa.array(spans, kind)], names=names)

    source = df.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text}`").cast("string").alias("__text"))
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*head, "score double, n_passages long, passages array<struct<start:long,end:long,score:double>>"]))


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below ``threshold``, all columns as they are."""
    key, shared = model.key, docs.sparkSession.sparkContext.broadcast(model.plain)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        scorer = worker_memo("toxicity:" + key, lambda: Scorer(Model(*shared.value)))
        return pa.array([scorer.score(scorer.statistic(t or "")) for t in texts.to_pylist()], pa.float64())

    return docs.where(of(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))) < threshold)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows never learned from: crc32 of the id modulo ``folds`` is 0; not so for a null id."""
    return F.coalesce(fold(F.col(f"`{doc_id}`"), folds) == 0, F.lit(False))
