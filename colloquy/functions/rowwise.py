"""Python steps on each row's own values, in Arrow batches, of which only a part is Python objects at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Characters of rows whose results are Python objects at a time, about; a longer row is a part by itself.
PART = 1 << 18


def _length(x: object) -> int:
    """How long a value is: a text's characters, a list's texts' and one for each of them."""
    return len(x) if isinstance(x, str) else sum(map(_length, x)) + len(x) if isinstance(x, list) else 1


def in_parts(step: Callable[..., object], to: pa.DataType, *arrays: pa.Array) -> pa.Array:
    """What step makes of each row's values, of which those of about PART characters are Python objects at a time."""
    done, part, held = [], [], 0
    for i in range(len(arrays[0])):
        values = [a[i].as_py() for a in arrays]
        part.append(step(*values))
        held += sum(map(_length, values))
        if held > PART:
            done.append(pa.array(part, to))
            part, held = [], 0
    return pa.concat_arrays([*done, pa.array(part, to)])


def by_row(kind: str, step: Callable[..., object], *columns: Column) -> Column:
    """What step makes of each row's values, of a type given as in DDL.

    A batch holds thousands of rows, and a text's words as Python objects take fifty times its own size: so results become
    Arrow arrays part by part. Not deterministic for the optimizer, though it is: else what lies below is copied into each use.
    """
    to = to_arrow_type(DataType.fromDDL(kind))

    def run(*arrays: pa.Array) -> pa.Array:
        return in_parts(step, to, *arrays)

    return F.arrow_udf(run, kind).asNondeterministic()(*columns)
