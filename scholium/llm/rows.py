"""Row-wise operators over whole texts: one Arrow pass, no shuffle, memory bounded by the block."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scholium.llm import text as X

TEXT = "__scholium_text"


def remainder(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id written in decimal, modulo ``m``: the fold of a document; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % m


def map_rows(docs: DataFrame, start: Callable[[], Callable], fields: list[T.StructField], text: str, keep: Iterable[str]) -> DataFrame:
    """Columns ``keep`` and one result row per input row.

    ``start()`` is called once a task and gives ``f(data, offsets, valid)``, which maps a block's bytes to one
    array per field. A kept column that has the name of a result gives way to it.
    """
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(TEXT))
    out = T.StructType([chosen.schema[c] for c in keep] + fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for rows, data, offs in X.blocks(batches, TEXT):
            found = f(data, offs, rows.column(TEXT).is_valid().to_numpy(zero_copy_only=False))
            kept = [rows.column(c).cast(arrow.field(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(v, arrow.field(x.name).type) for v, x in zip(found, fields, strict=True)], schema=arrow)

    return chosen.mapInArrow(run, out)
