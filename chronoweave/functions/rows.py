"""Several output rows per input row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_array(names: list[str], *rows: tuple[Column, ...]) -> Column:
    """Array of structs with the same field names in every row, for ``inline``."""
    return F.array(*[F.struct(*[col.alias(name) for name, col in zip(names, row, strict=True)]) for row in rows])
