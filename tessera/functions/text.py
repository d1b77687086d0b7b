"""Rows to text, blank tests and the recursive character splitter."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", " ", "")


def _plain(value):
    """A value as plain Python has it: rows are dicts, at any depth."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {_plain(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(x) for x in value]
    return bytes(value) if isinstance(value, bytearray) else value


@F.udf(T.StringType())
def _python_text(value):
    plain = _plain(value)
    return str(plain) if plain else None


@F.udf(T.StringType())
def _decimal_text(text):
    """Of a decimal with all digits of its scale, which Spark does not hand over as they are."""
    return None if text is None else str(Decimal(text))


def truthy_text(name: str, kind: T.DataType, within: str | None = None) -> Column:
    """The column (or field of the struct ``within``) as Python's text of its value where it is truthy, else null: 0, False, empty and null values fall out, blanks stay.

    Strings, booleans and integers stay in the JVM; fractions, decimals, dates, times, bytes, arrays, maps and structs go
    through Python, whose text Spark's casts do not give. Other types are refused by name.
    """
    c = F.col(f"`{name}`") if within is None else F.col(f"`{within}`.`{name}`")
    if isinstance(kind, T.StringType):
        return F.when(c != "", c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("True"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.when(c != 0, c.cast("string"))
    if isinstance(kind, T.FloatType):
        return F.when(c != 0, _python_text(c.cast("double")))
    if isinstance(kind, T.DoubleType):
        return F.when(c != 0, _python_text(c))
    if isinstance(kind, T.DecimalType):
        return F.when(c != 0, _decimal_text(c.cast("string")))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        return _python_text(c)
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    raise TypeError(f"column {name}: no text for {kind.simpleString()}")


def row_text(df: DataFrame, within: str | None = None) -> Column:
    """All columns of a row in order, joined by spaces; ``within`` names the struct that holds them, if one does."""
    return F.concat_ws(" ", *[truthy_text(f.name, f.dataType, within) for f in df.schema.fields])


def not_blank(text: Column) -> Column:
    """Whether anything is left after stripping Unicode white space and the separators U+001C to U+001F."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def split_text(text: str, size: int = 800, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that serves; neighbours share up to ``overlap``.

    Separators stay at the start of the piece behind them; chunks are stripped, empty ones dropped.
    """
    mark, rest = next((s, separators[k + 1 :]) for k, s in enumerate(separators) if s in text)
    pieces = list(text) if not mark else [x for x in _with_marks(text, mark) if x]
    chunks: list[str] = []
    short: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        chunks += _merged(short, size, overlap)
        short = []
        chunks += split_text(piece, size, overlap, rest) if rest else [piece]
    return chunks + _merged(short, size, overlap)


def _with_marks(text: str, mark: str) -> Iterator[str]:
    first, *others = text.split(mark)
    yield first
    yield from (mark + x for x in others)


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    start = total = 0
    for end, piece in enumerate(pieces):
        if total + len(piece) > size and end > start:
            out.append("".join(pieces[start:end]).strip())
            while total > overlap or (total > 0 and total + len(piece) > size):
                total -= len(pieces[start])
                start += 1
        total += len(piece)
    out.append("".join(pieces[start:]).strip())
    return [x for x in out if x]


#: Texts of a batch are cut so many characters at a time (a text at least), and no more chunks are held.
CUT_AT_ONCE = 1 << 20


def chunk_udf(size: int = 800, overlap: int = 150):
    @F.pandas_udf("array<string>")
    def chunks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            made, held = [], 0
            for text in batch:
                made.append(split_text(text, size, overlap) if text else [])
                held += len(text or "")
                if held >= CUT_AT_ONCE:
                    yield pd.Series(made, dtype="object")
                    made, held = [], 0
            if made:
                yield pd.Series(made, dtype="object")

    return chunks
