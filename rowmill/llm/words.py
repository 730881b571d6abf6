"""Words of whole texts, as bytes.

``bytes.split`` without an argument splits at exactly the six characters
space and U+0009 to U+000D, and ``bytes.lower`` changes A-Z only, so no text
has to be decoded. UTF-8 never uses those bytes inside another character.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

BLANKS = b" \t\n\r\x0b\x0c"


def as_bytes(column: Column) -> Column:
    """UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def select_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``id`` and ``text`` bytes, under names that cannot clash with columns of the table."""
    return docs.select(
        F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("text"), *[F.col(c) for c in more]
    )


def labelled_sample(labels: DataFrame, id_col: str, *values: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids, one row each, picked by the hash of the id.

    Rows without an id are left out; of repeated ids the smallest labels count,
    a null label being the largest.
    """
    folded = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(*[F.min(F.col(c)).alias(c) for c in values])
    )
    return folded.orderBy(F.xxhash64("id"), "id").limit(most)


def keep_rows(docs: DataFrame, text_col: str, verdict: Callable[[bytes], bool], most_bytes: int = 4_000_000) -> DataFrame:
    """The rows whose text the verdict keeps, with the columns of ``docs``; one pass, no shuffle.

    The text travels once, in its own column, and rows are judged about ``most_bytes`` of text at a time.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).cast(pa.binary())
            upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most_bytes, "right")))
                wanted = [bool(verdict(text.as_py() or b"")) for text in texts.slice(start, end - start)]
                yield batch.slice(start, end - start).filter(pa.array(wanted, pa.bool_()))
                start = end

    return docs.mapInArrow(keep, docs.schema)


def in_slices(batches, column: str = "text", most_bytes: int = 4_000_000):
    """The batches in runs of rows whose ``column`` has about ``most_bytes`` bytes at most, one row at least."""
    import numpy as np

    for batch in batches:
        sizes = np.cumsum([len(value.as_buffer()) for value in batch.column(column)] if batch.num_rows else [0])
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def fresh_worker(keep: str | None = None) -> None:
    """Give back what earlier tasks left in this Python worker: remembered values but for ``keep``, and freed memory.

    Spark keeps idle workers, so a stage that needs memory starts with this.
    """
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    kept = sys.modules.get("rowmill_worker_memo")
    for name in [n for n in vars(kept) if not n.startswith("__") and n != keep] if kept else []:
        delattr(kept, name)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def fresh_driver(spark: SparkSession) -> None:
    """Give back what earlier steps left in the driver: Python's freed memory, plans, and code made for them."""
    fresh_worker()
    spark._jvm.System.gc()


def list_cells(column: pa.ChunkedArray) -> list:
    """Numpy arrays of the cells of a list column, null cells being empty; no value becomes a Python number."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    ends = np.cumsum(sizes).tolist()
    flat = pc.list_flatten(column).to_numpy()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def in_order(ids: list, cells: list) -> list[int]:
    """Row numbers by id, rows of equal id by the numbers of their cells."""
    counts = Counter(ids)
    return sorted(range(len(ids)), key=lambda i: (ids[i], cells[i].tolist() if counts[ids[i]] > 1 else []))


def worker_memo(name: str, make):
    """A value that one Python worker keeps over its tasks, made on first use.

    Functions travel by value, so their own globals last for one task only.
    """
    import sys
    import types

    kept = sys.modules.setdefault("rowmill_worker_memo", types.ModuleType("rowmill_worker_memo")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
