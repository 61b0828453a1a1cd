"""Columns computed in Python while rows stream through in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: White space of this package becomes a space; a vertical tab, which is none
#: here but one to ``bytes.split``, a byte that UTF-8 never has.
_SPACES = bytes.maketrans(b"\t\n\r\f\v", b"    \xff")
_NOT_SCORED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_MARKS = [bytes([c]) for c in b'.,;:!?()"']


def with_columns(df: DataFrame, taken: list[str], fields: str, compute: Callable[[list[pa.Array]], list[pa.Array]]) -> DataFrame:
    """``df`` without the columns ``taken``, plus ``fields`` (DDL) that
    ``compute`` makes of their arrays, batch by batch.

    A Python UDF keeps every row it is evaluated for in a queue beside the
    Python process, with all columns of the row; once the queue finds no
    memory it is one file per task that goes only when the task ends. Here
    the other columns go through Python and come back: nothing is kept."""
    kept = [c for c in df.columns if c not in taken]
    new = T._parse_datatype_string(fields)
    names = [*kept, *new.names]
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in kept], *new.fields])

    def run(batches):
        for b in batches:
            of = lambda c: b.column(b.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays([*map(of, kept), *compute([of(c) for c in taken])], names)

    return df.mapInArrow(run, schema)


def utf8(col: pa.Array) -> list[bytes | None]:
    return col.cast(pa.binary()).to_pylist()


def lists(col: pa.Array) -> list[list | None]:
    """Rows of an array column."""
    flat, ends = col.values.to_numpy(zero_copy_only=False).tolist(), col.offsets.to_pylist()
    return [flat[s:e] if ok else None for s, e, ok in zip(ends, ends[1:], col.is_valid().to_pylist())]


def once(f: Callable) -> Callable:
    """``f`` that keeps its last result: rows of one reference come together."""
    last: list = [None, None]

    def g(x):
        if last[0] is None or last[0] != x:
            last[:] = x, f(x)
        return last[1]
    return g


# Tokens of one text as bytes: equal tokens are equal bytes, and the same
# lists as those of the column forms in ``parley.functions.text``.

def sentences(text: bytes) -> list[list[bytes]]:
    """Words of the pieces between dots; a piece of white space is one empty word."""
    return [p.split() or [b""] for p in text.translate(_SPACES).split(b".") if p]


def rouge_words(text: bytes) -> list[bytes]:
    return [w for s in sentences(text) for w in s]


def score_tokens(lower: bytes) -> list[bytes]:
    """Of a text in lower case."""
    return lower.translate(_NOT_SCORED).split()


def meteor_tokens(lower: bytes) -> list[bytes]:
    """Of a text in lower case."""
    text = lower.translate(_SPACES)
    for m in _MARKS:
        text = text.replace(m, b" " + m + b" ")
    return text.split()


def as_word(token: bytes) -> str:
    return token.replace(b"\xff", b"\v").decode()
