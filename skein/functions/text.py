"""Column expressions for names, ids and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as Unicode has them; Java's \\s alone knows ASCII only.
BLANKS = r"[\s\u0085   -     　]+"


def last_segment(name: Column) -> Column:
    """What follows the last '.', then the last ':', trimmed."""
    return F.trim(F.substring_index(F.substring_index(name, ".", -1), ":", -1))


def without_position(ref: Column) -> Column:
    """A name without its trailing '@line_column'."""
    return F.regexp_replace(ref, r"@\d+_\d+$", "")


def escaped(symbol: Column) -> Column:
    """A symbol as part of an id: trimmed, blanks and other runs of odd characters as '_'; an empty one is 'unknown'."""
    plain = F.regexp_replace(F.regexp_replace(symbol, f"^{BLANKS}|{BLANKS}$", ""), BLANKS, "_")
    return F.when(F.length(plain) == 0, "unknown").otherwise(F.regexp_replace(plain, r"[^A-Za-z0-9_.:@$-]+", "_"))


def identifier(text: Column) -> Column:
    """Letters, digits and '_' only, not beginning with a digit."""
    plain = F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")
    return F.when(plain.rlike("^[0-9]"), F.concat(F.lit("n_"), plain)).otherwise(plain)


def digest(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def line_span(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), end - start + 1)
