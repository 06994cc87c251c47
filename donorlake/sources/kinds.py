"""One log with documents of several kinds, read in one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

Reader = Callable[[DataFrame, str], DataFrame]


def read_by_kind(log: DataFrame, readers: Mapping[str, Reader], kind: str = "kind", document: str = "document") -> DataFrame:
    """All rows of a log with the columns that the reader of their kind gives; columns another reader gives are null.

    Each reader takes (rows, name of the text column) and sees the text of its own kind only, so a document is read
    once and the log is scanned once, however many kinds it has. A kind without a reader has nulls throughout. Readers
    that name a column alike give it the same type; the log's own columns must have other names.
    """
    kept, out = log.columns, log
    found: dict[str, tuple[str, list[str]]] = {}
    for number, (name, reader) in enumerate(readers.items()):
        before, text = out.columns, f"_text{number}"
        read = reader(out.withColumn(text, F.when(F.col(kind) == name, F.col(document))), text)
        columns = [c for c in read.columns if c not in before and c != text]
        found[name] = (f"_read{number}", columns)
        out = read.select(*before, F.struct(*columns).alias(f"_read{number}"))

    def value(column: str) -> Column:
        given = [F.when(F.col(kind) == name, F.col(read)[column]) for name, (read, columns) in found.items() if column in columns]
        return F.coalesce(*given).alias(column)

    columns = dict.fromkeys(c for _, columns in found.values() for c in columns)
    return out.select(*kept, *map(value, columns))
