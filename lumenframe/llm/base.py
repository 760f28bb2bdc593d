"""Shared plumbing: scratch tables, texts, word pattern."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..plans.scratch import saved

__all__ = ["WORD", "documents", "lean", "saved", "text_of", "with_columns"]

#: Fixed by the contracts: white space is space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(df: DataFrame, text_col: str):
    """The text as a string column, null read as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of a batch that goes to Python.
BATCH = 4 << 20


def lean(spark: SparkSession) -> None:
    """Let batches for Python hold BATCH bytes at most, if the session has no bound of its own.

    A batch is held in Arrow buffers by the JVM and again by the worker, so its bound is that of both.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.conf().contains(key):
        spark.conf.set(key, str(BATCH))


#: Rows and bytes of text handed to a row-wise operator at once; a single text may be longer.
STEP, BYTES = 1000, 16_000_000


def _cuts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of at most STEP rows and BYTES bytes, or of one row."""
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and (i - at == STEP or held + size > BYTES):
            yield at, i
            at, held = i, 0
        held += size
    if sizes:
        yield at, len(sizes)


def with_columns(df: DataFrame, text_col: str, added: dict[str, str], make, extra: dict | None = None) -> DataFrame:
    """Append the columns ``added`` (name to type) that ``make(texts, extras)`` gives for lists of texts.

    Other columns pass through as Arrow buffers, untouched; only some texts at a time become Python strings. Null texts
    come as empty ones. ``extra`` names further column expressions whose values come as the list ``extras``. Columns of ``df`` named like an added one are replaced.
    """
    lean(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in {a.lower() for a in added}]
    same = text_col in kept and dict(df.dtypes)[text_col] == "string"
    more = [*([] if same else [text_of(df, text_col)]), *(extra or {}).values()]
    rows = df.select(*[df[c] for c in kept], *more).toDF(*[f"c{i}" for i in range(len(kept) + len(more))])
    at = kept.index(text_col) if same else len(kept)
    first = len(kept) + (not same)
    schema = rows.select(*rows.columns[: len(kept)]).schema
    for name, kind in added.items():
        schema = schema.add(f"new_{name}", DataType.fromDDL(kind))
    names = [f.name for f in schema.fields]
    types = [to_arrow_type(schema[f"new_{name}"].dataType) for name in added]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for start, stop in _cuts(sizes):
                part = batch.slice(start, stop - start)
                texts = ["" if t is None else t for t in part.column(at).to_pylist()]
                extras = [part.column(i).to_pylist() for i in range(first, part.num_columns)]
                made = [pa.array(m, type=t) for m, t in zip(make(texts, extras), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=names)

    return rows.mapInArrow(run, schema).toDF(*kept, *added)
