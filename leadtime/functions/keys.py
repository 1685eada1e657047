"""Keys made of several columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def composite_key(*parts: Column, separator: str = "|", missing: str = "\\N") -> Column:
    """Parts as text, joined by a separator, so ("1", "23") and ("12", "3") stay apart.

    A missing part becomes ``missing``; it does not make the whole key null. Within a part a
    backslash goes before backslashes and separators, so different parts never give one key and a
    missing part differs from any text.
    """
    def escaped(part: Column) -> Column:
        text = F.replace(part.cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.replace(text, F.lit(separator), F.lit("\\" + separator))

    return F.concat_ws(separator, *[F.coalesce(escaped(p), F.lit(missing)) for p in parts])
