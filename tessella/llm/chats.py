"""Logged conversations: cumulative snapshots collapse to maximal ones, which are rendered.

A log holds a conversation's state again and again, each snapshot with some
more turns. A rolling hash of every turn prefix names what has been said so
far; a conversation whose whole hash is the hash of a proper prefix of another
one is a snapshot of it, and goes. Of equal conversations the one with the
least id stays. What remains is rendered in parts of bounded length.

The rolling hash is a polynomial in the turns' digests modulo a prime, so a
conversation may be spread over partitions: turns are range-partitioned in
order, each partition hashes its own stretch, and the stretches are put
together from one small row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm.common import materialize

#: A Mersenne prime and the base of the polynomial.
PRIME = (1 << 127) - 1
BASE = 0x1F83D9ABFB41BD6B5BE0CD19137E2179
#: Turns in a rendered part.
PART_TURNS = 32


def _extend(h: int, more: int, turns: int) -> int:
    return (h * pow(BASE, turns, PRIME) + more) % PRIME


def turns(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, digest) of each logged row; the digest is of role and text."""
    own = log.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                     F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    # With its length before it, a role that holds any text cannot pass for another role and text.
    said = F.concat(F.coalesce(F.concat(F.length("role").cast("string"), F.lit("r"), "role"), F.lit("-")), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-")))
    return own.withColumn("digest", F.md5(said))


_ROLLED = "conv long, turn long, digest string, place long, hash binary, first boolean, stretch_end boolean, range_end boolean"


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and prefix hash of each turn within its partition's stretch of the conversation.

    Marks rows of the partition's first stretch, each stretch's last row and
    the partition's last row; for that a batch waits until the next is seen.
    """
    now, place, h, stretches = (), 0, 0, 0
    waiting: list[list] | None = None
    names = ["conv", "turn", "digest", "place", "hash", "first", "stretch_end", "range_end"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_()]

    def out(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        made: list[list] = [c.to_pylist() for c in batch.columns] + [[], [], [], [], []]
        _, _, digests, places, hashes, first, ends, range_ends = made
        for k, (conv, digest) in enumerate(zip(made[0], digests, strict=True)):
            if (conv,) != now:
                if k:
                    ends[k - 1] = True
                elif waiting is not None:
                    waiting[6][-1] = True
                now, place, h, stretches = (conv,), 0, 0, stretches + 1
            place, h = place + 1, (h * BASE + int(digest, 16) + 1) % PRIME
            places.append(place)
            hashes.append(h.to_bytes(16, "big"))
            first.append(stretches == 1)
            ends.append(False)
            range_ends.append(False)
        if made[0]:
            if waiting is not None:
                yield out(waiting)
            waiting = made
    if waiting is not None:
        waiting[6][-1] = waiting[7][-1] = True
        yield out(waiting)


def _carries(edges: list) -> tuple[dict[int, tuple[int, int]], set[int]]:
    """Per range the turns and the hash that its first stretch goes on from; ranges whose last stretch goes on.

    ``edges`` has the last rows of each range's first and last stretch.
    """
    before: dict[int, tuple[int, int]] = {}
    onward: set[int] = set()
    open_ = None  # range, conversation, turns and hash of the last stretch so far
    for r in sorted(edges, key=lambda r: (r["range"], r["range_end"])):
        n, h = r["place"], int.from_bytes(r["hash"], "big")
        if r["first"] and open_ is not None and open_[1] == r["conv"]:
            before[r["range"]] = open_[2:]
            onward.add(open_[0])
            n, h = open_[2] + n, _extend(open_[3], h, n)
        open_ = (r["range"], r["conv"], n, h)
    return before, onward


def prefixes(said: DataFrame) -> DataFrame:
    """(conv, turn, digest, place, hash, last): place from 1, hash of all turns up to this one, whether it is the last.

    Repeated rows are one turn. Turns follow each other by number (nulls
    first), equal numbers by their digest.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "digest")]
    placed = said.select("conv", "turn", "digest").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    # Ranges are drawn from a sample, so what they give is written before it is read twice.
    rolled = materialize(placed.mapInArrow(_roll, _ROLLED).withColumn("range", F.spark_partition_id()))
    # Two rows per partition at most.
    edges = rolled.where(F.col("range_end") | (F.col("first") & F.col("stretch_end"))).select("range", "conv", "place", "hash", "first", "range_end").collect()
    before, onward = _carries(edges)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, hashes = batch.column("place").to_pylist(), batch.column("hash").to_pylist()
            ranges, last = batch.column("range").to_pylist(), batch.column("stretch_end").to_pylist()
            for k, first in enumerate(batch.column("first").to_pylist()):
                if first and ranges[k] in before:
                    turns_before, h = before[ranges[k]]
                    hashes[k] = _extend(h, int.from_bytes(hashes[k], "big"), place[k]).to_bytes(16, "big")
                    place[k] += turns_before
            for k in [k for k, end in enumerate(batch.column("range_end").to_pylist()) if end and ranges[k] in onward]:
                last[k] = False
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(place, pa.int64()), pa.array(hashes, pa.binary()), pa.array(last, pa.bool_())],
                                             names=["conv", "turn", "digest", "place", "hash", "last"])

    return rolled.mapInArrow(whole, "conv long, turn long, digest string, place long, hash binary, last boolean")


def maximal(told: DataFrame) -> DataFrame:
    """(conv, conv_turns) of the conversations that are no proper prefix of another one, one of each set of equals."""
    whole = told.where("last").groupBy("place", "hash").agg(F.min(F.struct(F.col("conv").isNull().alias("none"), "conv")).alias("kept"))
    inner = told.where(~F.col("last")).select("place", "hash").distinct()
    return whole.join(inner, ["place", "hash"], "left_anti").select(F.col("kept.conv").alias("conv"), F.col("place").alias("conv_turns"))


def render(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations in parts of ``PART_TURNS`` turns: conv_id, conv_turns, part (from 0), n_turns, text.

    A turn is rendered as a start mark with its role, its text and an end
    mark; null roles and texts as empty ones. Rows with a null conversation id
    are one conversation; repeated rows are one turn; an empty log gives none.
    """
    said = turns(log, conv, turn, role, text)
    told = prefixes(said)
    kept = maximal(told)
    same = F.col("conv").eqNullSafe(F.col("kept_conv"))
    places = told.join(kept.withColumnRenamed("conv", "kept_conv"), same).select(
        F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("d"), "place", "conv_turns")
    once = said.groupBy("conv", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    own = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("digest") == F.col("d"))
    shown = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    part = F.floor((F.col("place") - 1) / PART_TURNS).cast("long")
    lines = once.join(places, own).select("conv", "conv_turns", part.alias("part"), F.struct("place", shown.alias("shown")).alias("line"))
    return lines.groupBy("conv", "conv_turns", "part").agg(F.array_sort(F.collect_list("line")).alias("lines")).select(
        F.col("conv").alias("conv_id"), "conv_turns", "part", F.size("lines").cast("long").alias("n_turns"), F.array_join("lines.shown", "").alias("text"))
