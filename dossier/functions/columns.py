"""Column builders shared by operators: guarded ratios, intervals, ladders and text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
#: White space of every script, and the separators that count as such.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def ratio(n: Column, d: Column) -> Column:
    """n / d, or null if d is 0 or null: an undefined rate is no zero."""
    return n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))


def rounded(c: Column, places: int = 4) -> Column:
    """Rounded as the exact value of a double asks for, ties to even: 2.675 holds a little less and becomes 2.67.

    Only where the shortest decimal is a tie does the exact value decide, by the rounding error of its product with 2 * 10**places.
    """
    x, unit = c.cast("double"), 10**places
    t = c.cast("double").cast("string").cast("decimal(38,18)")
    product = x * (2.0 * unit)
    split = x * 134217729.0
    high = split - (split - x)
    error = (product - (t * (2 * unit)).cast("double")) + ((high * (2.0 * unit) - product) + (x - high) * (2.0 * unit))
    low = F.floor(t * unit)
    tie = F.pmod(t * (2 * unit), F.lit(2)) == 1
    return F.when(tie & (error > 0), ((low + 1) / unit).cast("double")).when(tie & (error < 0), (low / unit).cast("double")).otherwise(F.bround(t, places).cast("double"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of k successes in n, within 0 and 1; null for n = 0."""
    size = F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = k / size, z * z
    mid = (p + zz / (2 * size)) / (1 + zz / size)
    half = z * F.sqrt(p * (1 - p) / size + zz / (4 * size * size)) / (1 + zz / size)
    low, high = F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))
    return F.when(size.isNotNull(), low), F.when(size.isNotNull(), high)


def ladder(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def blank_to_null(c: Column) -> Column:
    """Null for null, empty or white space only, as a truth test of a text would say."""
    return F.nullif(strip(c), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(c, F.lit(SPACES))


def joined_set(c: Column, by: str = ";") -> Column:
    """Distinct values in order, in one text."""
    return F.array_join(F.array_sort(F.collect_set(c)), by)


def hash_rank(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of sha256(seed:key)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
