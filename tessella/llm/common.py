"""Small helpers shared by the operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.session import materialize

__all__ = ["fold", "free_name", "materialize", "rows_of", "table", "upper_to_lower", "worker_memo"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id is in no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def upper_to_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def worker_memo(key: str, build: Callable[[], object]) -> object:
    """A value kept by this Python worker between tasks: the last one only, so stages do not pile up in it.

    Functions pickled by value get new globals in every task, so the store
    hangs on a module of its own. ``key`` must name the content.
    """
    store = sys.modules.setdefault("_tessella_worker_memo", types.ModuleType("_tessella_worker_memo")).__dict__
    if store.get("key") != key:
        store["key"] = store["value"] = None
        store["value"], store["key"] = build(), key
    return store["value"]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 512, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded size: at most ``rows`` rows and about ``chars`` bytes.

    A single row over ``chars`` comes alone.
    """
    for batch in batches:
        start, n = 0, batch.num_rows
        each = max(1, batch.nbytes // max(n, 1))
        step = max(1, min(rows, chars // each))
        while start < n:
            yield batch.slice(start, step)
            start += step
