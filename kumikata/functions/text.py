"""Text columns that stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unaccented() -> tuple[str, str]:
    """Letters of the Latin blocks with marks, and the plain letters under them."""
    marked = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) > 1]
    plain = [unicodedata.normalize("NFKD", c)[0] for c in marked]
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _unaccented()


def fold(col: Column) -> Column:
    """Lower case without accents, for Latin script, composed or not; null stays null."""
    return F.lower(F.translate(F.regexp_replace(col, r"\p{M}+", ""), MARKED, PLAIN))


def blanks(col: Column) -> Column:
    """Trimmed, with single blanks in place of any run of white space."""
    return F.trim(F.regexp_replace(col, r"[\s\p{Z}]+", " "))
