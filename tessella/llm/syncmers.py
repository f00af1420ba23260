"""Document fingerprints from closed syncmers.

A run of ``K`` code points is an anchor if the least of its inner runs of ``S``
code points stands first or last in it. Whether it does depends on the run
alone, so equal passages have equal anchors whatever surrounds them, and their
places differ by one constant. A fingerprint keeps the anchors with the least
hashes, each with the place where it first stands, as text of bounded length.

Two fingerprints are alike as far as their anchors match in place: of the
least hashes of both, those that both have count, if another shared anchor is
shifted by about the same distance.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import rows_of

K, S = 16, 7
#: Anchors in a fingerprint, and how far (in code points) two shifts may differ and still agree.
ANCHORS = 64
SLACK = 16
#: Code points worked on at once; longer texts are cut with an overlap of K - 1.
CHUNK = 1 << 19
#: Documents are dealt out by ranges of ids, this many at least.
RANGES = 256

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of all closed syncmers of the code points."""
    n, c = len(codes), codes.astype(np.uint64) + np.uint64(1)
    if n < K:
        return np.array([], np.int64), np.array([], np.uint64)
    inner = c[: n - S + 1] * _BASE
    for j in range(1, S):
        inner = (inner + c[j: n - S + 1 + j]) * _BASE
    order = _mix(inner)
    width, least = K - S + 1, order
    have = 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have:])
    at = np.flatnonzero((order[: len(least)] == least) | (order[width - 1:] == least))
    # A run's hash from those of its inner runs, at the chosen places only.
    whole = inner[at] * _power(K - S) + inner[at + K - S]
    return at, _mix(whole ^ (inner[at + (K - S) // 2] << np.uint64(1)))


def _least(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least distinct hashes with the first place of each."""
    if len(h) > 4 * ANCHORS:
        bound = np.partition(h, 4 * ANCHORS)[4 * ANCHORS]
        held = h <= bound
        few_h, few_at = h[held], at[held]
        found, first = np.unique(few_h, return_index=True)
        if len(found) >= ANCHORS:
            return few_at[first][:ANCHORS], found[:ANCHORS]
    found, first = np.unique(h, return_index=True)
    return at[first][:ANCHORS], found[:ANCHORS]


def sketch(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text's fingerprint, by rising hash; texts without an anchor get one of the whole text."""
    codes = _code_points(text)
    at, h = _anchors(codes[:CHUNK])
    at, h = _least(at, h)
    for start in range(CHUNK - K + 1, len(codes) - K + 1, CHUNK - K + 1):
        more_at, more_h = _anchors(codes[start: start + CHUNK])
        at, h = _least(np.concatenate([at, more_at + start]), np.concatenate([h, more_h]))
    if not len(h) and len(codes):
        whole = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8]
        return np.array([0]), np.frombuffer(whole, np.uint64)
    return at, h


def to_text(at: np.ndarray, h: np.ndarray) -> str:
    """Six bytes of each hash and five of its place, as base64; the empty text has the empty fingerprint."""
    both = np.zeros((len(h), 11), np.uint8)
    both[:, :6] = h.astype(">u8").view(np.uint8).reshape(len(h), 8)[:, :6]
    both[:, 6:] = at.astype(">u8").view(np.uint8).reshape(len(h), 8)[:, 3:]
    return base64.b64encode(both.tobytes()).decode()


def from_text(fingerprint: str) -> tuple[list[int], list[int]]:
    """(places, hashes of six bytes)."""
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 11)
    number = lambda part: part.astype(np.int64) @ (1 << (8 * np.arange(part.shape[1] - 1, -1, -1)))
    return number(raw[:, 6:]).tolist(), number(raw[:, :6]).tolist()


def likeness(x: str, y: str) -> float:
    """How alike two fingerprints are, 0 to 1: twice the shared part over both, by anchors that match in place."""
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    (at_x, hash_x), (at_y, hash_y) = from_text(x), from_text(y)
    place_x, place_y = dict(zip(hash_x, at_x, strict=True)), dict(zip(hash_y, at_y, strict=True))
    # Beyond a full fingerprint's last hash nothing is known of its text.
    seen = sorted(place_x.keys() | place_y.keys())
    limit = min([h[-1] for h in (hash_x, hash_y) if len(h) >= ANCHORS], default=seen[-1])
    union = [h for h in seen if h <= limit]
    shifts = [place_y[h] - place_x[h] for h in union if h in place_x and h in place_y]
    near = Counter()
    for s in shifts:
        near.update((s // SLACK - 1, s // SLACK, s // SLACK + 1))
    shared = sum(1 for s in shifts if len(shifts) == 1 or near[s // SLACK] > 1)
    jaccard = shared / len(union)
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(ids: DataFrame, parts: int) -> list[int]:
    """Cuts between ranges of ids of about equal size."""
    cuts = ids.agg(F.percentile_approx("id", [(i + 1) / parts for i in range(parts - 1)], 100_000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text counts as empty; the empty text has the
    empty fingerprint. Documents follow each other by ascending id, null ids
    first, equal ids by text; the first follows the last, a single document
    follows itself. Repeated rows each get a row. An empty table gives none.

    Documents are dealt out by ranges of ids, so each text moves once; the
    first document of a range also goes to the range before it.
    """
    spark = df.sparkSession
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    parts = max(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _ranges(own.select("id"), parts)
    # The number of cuts up to the id, by binary search; null ids come first.
    if cuts:
        splits = sorted({-math.inf, *map(float, cuts), math.inf})
        placed = Bucketizer(splits=splits, inputCol="at", outputCol="place", handleInvalid="keep").transform(own.withColumn("at", F.coalesce(F.col("id").cast("double"), F.lit(-math.inf))))
        ranged = placed.select("id", "text", F.col("place").cast("int").alias("range"))
    else:
        ranged = own.withColumn("range", F.lit(0))
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id")).alias("x")).select("range", "x.id").orderBy("range").collect()
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # An entry per range, read by its number: its first id, and the range before it, around the end.
    before, lead = [0] * (firsts[-1]["range"] + 1), [None] * (firsts[-1]["range"] + 1)
    for k, r in enumerate(firsts):
        before[r["range"]], lead[r["range"]] = firsts[k - 1]["range"], r["id"]
    own_place = F.col("range") + 1
    is_first = F.col("id").eqNullSafe(F.element_at(F.lit(np.array([0 if x is None else x for x in lead], np.int64)), own_place)) & F.element_at(F.lit([x is not None for x in lead]), own_place)
    is_first = is_first | F.col("id").isNull()
    earlier = F.element_at(F.lit(before), own_place)
    targets = F.when(is_first, F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")), F.struct(earlier.alias("range"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))))
    dealt = ranged.withColumn("to", F.explode(targets)).select(F.col("to.range").alias("range"), F.col("to.guest").alias("guest"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # range, id, text, fingerprint
        done: list[tuple] = []
        for batch in rows_of(batches):
            for where, guest, i, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if waiting is None and guest:
                    continue
                if waiting is not None and (guest or where == waiting[0]):
                    mark = to_text(*sketch(t)) if t != waiting[2] else waiting[3]
                    done.append(_row(waiting, t, mark))
                else:
                    mark = to_text(*sketch(t))
                waiting = None if guest else (where, i, t, mark)
            if done:
                yield _batch(done)
                done = []

    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "guest", F.col("id").asc_nulls_first(), "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _row(own: tuple, following: str, next_mark: str) -> tuple:
    _, i, text, mark = own
    changed = edited(text, following)
    changed_mark = to_text(*sketch(changed)) if changed != text else mark
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return i, len(text), digest, mark, changed_mark, likeness(mark, changed_mark), likeness(mark, next_mark)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def fingerprints(df: DataFrame, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in ``keep`` and each text's fingerprint; a null text counts as empty."""
    keep = keep or {}
    names = [*keep, "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            made = [to_text(*sketch(t or "")) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=names)

    source = df.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text}`").cast("string").alias("__text"))
    return source.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["fingerprint string"]))
