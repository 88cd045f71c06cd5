"""Column helpers built only from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, controls and zero-width characters (Java regex): nothing visible.
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}]"


def visible(c: Column) -> Column:
    """True where the text has a visible character; null counts as blank."""
    return F.coalesce(F.length(F.regexp_replace(c, INVISIBLE, "")) > 0, F.lit(False))


def strip(c: Column) -> Column:
    """c without outer invisible characters."""
    return F.regexp_replace(c, rf"^{INVISIBLE}+|{INVISIBLE}+$", "")


def key(c: Column) -> Column:
    """A reference key: outer blanks and letter case do not matter; blank is null."""
    k = F.lower(strip(c))
    return F.when(F.length(k) > 0, k)


def moment(c: Column) -> Column:
    """UTC microseconds of a text in ISO 8601 (Z, an offset, or none = UTC) or
    epoch milliseconds; null where it is neither."""
    t = strip(c)
    has_zone = t.rlike(r"[Tt ]\d{2}:\d{2}.*([Zz]|[+-]\d{2}:?\d{2})$")
    iso = F.when(has_zone, t).otherwise(F.concat(t, F.lit("Z")))
    epoch = t.rlike(r"^-?\d{9,16}$")
    return F.when(epoch, t.try_cast("bigint") * F.lit(1000)).otherwise(F.unix_micros(iso.try_cast("timestamp")))


def micros(c: Column) -> Column:
    """UTC microseconds of a TIMESTAMP_NTZ column under a UTC session."""
    return F.unix_micros(c.cast("timestamp"))
