"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The upper and lower case letters that contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id's decimal text, the source of all deterministic splits."""
    return F.crc32(F.col(column).cast("string"))


def map_rows(
    df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: pa.Schema, rows: int = 2000
) -> DataFrame:
    """Apply ``fn(*columns)`` to Arrow batches; ``columns`` are Python lists.

    ``fn`` returns output rows as tuples, as many as it likes per input row. They are
    passed on in batches of ``rows``, so a long output is never held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            # small slices: one batch may hold many long texts
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for row in fn(*(c.to_pylist() for c in part.columns)):
                    out.append(row)
                    if len(out) >= rows:
                        yield _batch(out, schema)
                        out = []
            if out:
                yield _batch(out, schema)

    return df.mapInArrow(run, _spark_schema(schema))


def edit_texts(docs: DataFrame, edit: Callable[..., tuple[list[bool], list]]) -> DataFrame:
    """Rows of ``docs`` that ``edit(texts)`` keeps, with the texts it gives and all other columns as they are."""
    return edit_structs(docs.select(F.struct("*").alias("doc")), docs, edit)


def edit_structs(rows: DataFrame, docs: DataFrame, edit: Callable[..., tuple[list[bool], list]]) -> DataFrame:
    """As :func:`edit_texts`, for ``rows`` with a struct of all columns of ``docs`` and further columns for ``edit``.

    In a struct, the columns of documents may have any name. ``n_chars``, where there is one, follows a changed text.
    """
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                columns = part.column(0).flatten()
                texts = columns[at_text].to_pylist()
                kept, edited = edit(texts, *(c.to_pylist() for c in part.columns[1:]))
                columns[at_text] = pa.array(edited, columns[at_text].type)
                if at_chars is not None:
                    counts = columns[at_chars].to_pylist()
                    counts = [n if a == b else len(b) for n, a, b in zip(counts, texts, edited, strict=True)]
                    columns[at_chars] = pa.array(counts, columns[at_chars].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)
