"""Near-duplicates by MinHash: documents whose shingle sets are alike in 80 percent or more, and the groups they form.

A set's signature is the minima of ``BANDS * ROWS`` universal hash functions
a x + b mod 2^64 over its shingles. Sets that agree in all minima of one band
share a bucket; of two sets alike in 0.8, all 40 bands of 4 miss with a
probability below 1e-9. Buckets are searched in two steps, so that a bucket of
any size costs rows in proportion to its members:

* Star: every member is compared with its bucket's least member: signatures
  first, then the full sets. Links give components by alternating stars.
* Rest: only buckets that still hold several components go on. Members
  outside a bucket's largest component (in blocks, if there are many) are
  held while the bucket streams past: signatures drop rows without any likely
  partner in another component, then full sets are compared, and a link is
  returned where it joins two components.

Equal sets are one node from the start, and full sets are only made for
documents that share a bucket. Nothing is dropped or capped: a link is lost
only if no band agrees, or if the 160 minima of a pair alike in 0.8 agree in
fewer than 98 (below 1e-8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import materialize, rows_of
from tessella.llm.components import components
from tessella.llm.simhash import shingle_hashes

BANDS, ROWS = 40, 4
#: Minima of a signature that must agree before full sets are compared.
LEAST_AGREE = 98
#: Rows of a bucket held at once while the rest streams past.
HELD = 2048
#: Documents looked up by a broadcast of their keys; beyond, by a join.
BROADCAST_ROWS = 1_000_000
_RANDOM = np.random.Generator(np.random.PCG64(12))
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str, words: int = 4) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; without words none."""
    return np.unique(shingle_hashes(text, words))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of each hash function's minimum."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 256):
        np.minimum(least, (shingles[start:start + 256, None] * _A + _B).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketches(df: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(doc_id, row, n, sid, sig, low): one row per document; ``sid`` names its set, ``low`` is a byte per minimum."""
    names = ["doc_id", "row", "n", "sid", "sig", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            n, sid, sig, low = [], [], [], []
            for t in batch.column(2).to_pylist():
                found = shingle_set(t or "", words)
                n.append(len(found))
                made = signature(found) if len(found) else None
                sid.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                sig.append(None if made is None else made.tobytes())
                low.append(None if made is None else made.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sig, pa.binary()), pa.array(low, pa.binary())], names=names)

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(id_col, text).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, row long, n long, sid long, sig binary, low binary")


def row_key(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("string"))


def full_sets(df: DataFrame, wanted: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(sid, shingles): the full set of each of ``wanted`` (sid, row), made again from one document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            made = [shingle_set(t or "", words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["sid", "shingles"])

    source = df.select(row_key(id_col, text).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    known = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return source.join(known, "row").select("sid", "text").mapInArrow(run, "sid long, shingles binary").groupBy("sid").agg(F.first("shingles").alias("shingles"))


def _bytes(column: pa.Array, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype) for b in column.to_pylist()]


def _likely(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, low_a, low_b) whose signatures agree often enough, without the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= LEAST_AGREE)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long")


def _alike(shared: np.ndarray, n: np.ndarray, m: int, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n + m - shared)


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, set_a, set_b) whose full sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            keep = []
            for x, y in zip(_bytes(batch.column(2), np.uint64), _bytes(batch.column(3), np.uint64), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(_alike(np.int64(shared), np.int64(len(x)), len(y), percent)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch], Iterator[pa.RecordBatch]]]:
    """Pieces of (key, block): ``(name, held rows, one piece of the stream)``; the input is sorted by key, block, kind (0: held)."""
    name, held = None, []
    for batch in batches:
        key, block, kind = (batch.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if start == end:
                continue
            if (key[start], block[start]) != name:
                name, held = (key[start], block[start]), []
            if kind[start] == 0:
                held.append(batch.slice(start, end - start))
            else:
                yield name, held, batch.slice(start, end - start)


def _with_partner(rows: DataFrame) -> DataFrame:
    """(key, block, kind, sid, comp) of the rows (key, block, kind, sid, comp, low) that have a likely partner in another component."""
    schema = "key long, block int, kind int, sid long, comp long"
    columns = ["key", "block", "kind", "sid", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own, comp, low, hit = None, None, None, None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if own is not None and hit.any():
                yield own.filter(pa.array(hit))

        for now, held, piece in _buckets(batches):
            if not held:
                continue
            if now != name:
                yield from ended()
                name, table = now, pa.Table.from_batches(held).combine_chunks()
                own = table.select(columns).to_batches()[0]
                comp = table["comp"].to_numpy()
                low = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(len(comp), -1)
                hit = np.zeros(len(comp), bool)
            other = piece.column(4).to_numpy()
            theirs = np.frombuffer(b"".join(piece.column(5).to_pylist()), np.uint8).reshape(len(other), -1)
            keep = np.zeros(len(other), bool)
            step = max(1, (1 << 22) // max(1, low.size))
            for start in range(0, len(other), step):
                part = slice(start, start + step)
                near = ((low[:, None, :] == theirs[None, part, :]).sum(axis=2) >= LEAST_AGREE) & (comp[:, None] != other[None, part])
                hit |= near.any(axis=1)
                keep[part] = near.any(axis=0)
            if keep.any():
                yield piece.select(columns).filter(pa.array(keep))
        yield from ended()

    return rows.select(*columns, "low").mapInArrow(run, schema)


def _joining(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between components, among the rows (key, block, kind, sid, comp, shingles); enough to connect what full sets connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = None
        for now, held, piece in _buckets(batches):
            if not held:
                continue
            if now != name:
                name, table = now, pa.Table.from_batches(held)
                sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
                sid, comp, size = table["sid"].to_numpy(), table["comp"].to_numpy(), np.array([len(s) for s in sets])
                values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                order = np.argsort(values, kind="stable")
                values, owner = values[order], owner[order]
                joined: dict[int, int] = {}
            a, b = [], []

            def root(c: int) -> int:
                while (up := joined.get(c, c)) != c:
                    c = up
                return c

            for s, c, data in zip(piece.column(3).to_pylist(), piece.column(4).to_pylist(), piece.column(5).to_pylist(), strict=True):
                own = np.frombuffer(data, np.uint64)
                first, last = np.searchsorted(values, own), np.searchsorted(values, own, "right")
                span = last - first
                at = np.repeat(first - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
                shared = np.bincount(owner[at], minlength=len(sid))
                for k in np.flatnonzero(_alike(shared, size, len(own), percent) & (comp != c)).tolist():
                    x, y = root(int(comp[k])), root(c)
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        a.append(int(sid[k]))
                        b.append(s)
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("key", "block", "kind", "sid", "comp", "shingles").mapInArrow(run, "a long, b long")


def _placed(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "kind")


def _both(pairs: DataFrame, table: DataFrame, value: str, name: str) -> DataFrame:
    """Pairs with ``value`` of both sides as ``name``_a and ``name``_b."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("sid").alias(side), F.col(value).alias(f"{name}_{side}")), side)
    return pairs


def groups(df: DataFrame, sets: DataFrame, id_col: str, text: str, words: int, percent: int) -> DataFrame:
    """(fp, group) of every set in ``sets`` (sid, n, row, sig, low) that links to another."""
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    placed = sets.select("sid", F.explode(bands).alias("key"))
    several = placed.groupBy("key").agg(F.count("*").alias("c"), F.min("sid").alias("first")).where("c > 1").drop("c")
    members = materialize(placed.join(several, "key"))
    active = materialize(sets.join(members.select("sid").distinct(), "sid").select("sid", "n", "row", "low"))
    full = materialize(full_sets(df, active.select("sid", "row"), id_col, text, words))

    star = members.where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b")).distinct()
    sized = _both(star, active, "n", "n").where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")).select("a", "b")
    first = components(_confirmed(_both(_likely(_both(sized, active, "low", "low")), full, "shingles", "set"), percent))

    named = materialize(members.select("key", "sid").join(first, F.col("sid") == F.col("fp"), "left").select("key", "sid", F.coalesce("group", "sid").alias("comp")))
    shares = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_ = shares.groupBy("key").agg(F.count("*").alias("k"), F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("rest")).where("k > 1")
    rows = named.join(open_.select("key", "main", F.ceil(F.col("rest") / HELD).cast("int").alias("blocks")), "key")
    held = rows.where("comp <> main").select("key", F.pmod(F.xxhash64("sid"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "sid", "comp")
    passing = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "sid", "comp")
    both = held.unionByName(passing).join(active.select("sid", "low"), "sid")
    near = materialize(_with_partner(_placed(both)))
    more = _joining(_placed(near.join(full, "sid")), percent)
    return components(first.select(F.col("fp").alias("a"), F.col("group").alias("b")).unionByName(more))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable), kept.

    Two documents link if 100 times the number of shingles they share reaches
    ``percent`` times the number of shingles of either. Words are runs of
    anything but ASCII white space, A-Z in lower case; a text of fewer words
    than a shingle is one shingle. A null, empty or blank text has no shingles,
    links with nothing and is its own component. Equal sets always link. Rows
    with a null id take part, but name a component only if it has no other id
    (then null, and not kept). Repeated rows are all returned. Shingles and
    sets are told apart by 64-bit hashes. An empty table gives an empty
    result; other columns are not looked at.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the bands are laid out for likenesses from 80 percent")
    docs = materialize(sketches(df, id_col, text, words))
    some = docs.where("n > 0")
    sets = materialize(some.groupBy("sid").agg(F.max("n").alias("n"), F.min("row").alias("row"), F.first("sig").alias("sig"), F.first("low").alias("low")))
    linked = groups(df, sets, id_col, text, words, percent)
    least = some.groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = least.join(linked, F.col("sid") == F.col("fp"), "left").select("sid", "least", F.coalesce("group", "sid").alias("group"))
    smallest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of_set = named.select("sid", "group").join(smallest, "group").select("sid", "component_id")
    ids = docs.select("doc_id", "n", "sid")
    found = ids.where("n > 0").join(of_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = ids.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
