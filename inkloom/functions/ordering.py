"""Sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import fold

DIGITS = 20


def natural_key(path: Column) -> Column:
    """Key under which ``p2`` sorts before ``p10``; letters compare without case and accents.

    Digit runs are left-padded, so plain string order of the key is natural order.
    Ties between equal keys are broken by the raw text at the call site.
    """
    pieces = F.regexp_extract_all(fold(path), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def padded(piece: Column) -> Column:
        bare = F.regexp_replace(piece, r"^0+(?=[0-9])", "")
        width = F.greatest(F.length(bare), F.lit(DIGITS))
        return F.when(piece.rlike("^[0-9]"), F.lpad(bare, width, "0")).otherwise(piece)

    return F.array_join(F.transform(pieces, padded), "")
