"""Column expressions with the engine's null rules: missing is NULL, NaN and infinities never survive a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12
EARTH_KM = 6371.0088
#: Letters with the marks that normalisation strips.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """NULL for NaN and infinities."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def num(c: Column | str) -> Column:
    """Numeric or NULL: text that is no number does not raise."""
    return clean(col(c).try_cast("double"))


def ratio(n: Column | str, d: Column | str, eps: float = EPSILON) -> Column:
    """n / d, NULL where |d| <= eps."""
    return F.when(F.abs(col(d)) > eps, col(n) / col(d))


def symmetric_change(a: Column | str, b: Column | str, eps: float = EPSILON) -> Column:
    """2 (a - b) / (|a| + |b|), NULL where the denominator is at most eps."""
    return ratio(F.lit(2.0) * (col(a) - col(b)), F.abs(col(a)) + F.abs(col(b)), eps)


def pair_expressions(a: str, b: str, eps: float = 1e-6) -> dict[str, Column]:
    """The seven expressions over a pair of columns; the ratios here add eps to the size of the denominator, keeping its sign."""
    x, y = F.col(a), F.col(b)

    def padded(n: Column, d: Column) -> Column:
        return n / (d + F.when(d < 0, F.lit(-eps)).otherwise(F.lit(eps)))

    return {
        "product": x * y,
        "sum": x + y,
        "difference": x - y,
        "reverse_difference": y - x,
        "safe_ratio": padded(x, y),
        "reverse_safe_ratio": padded(y, x),
        "symmetric_change": F.lit(2.0) * (x - y) / (F.abs(x) + F.abs(y) + F.lit(eps)),
    }


def signed_log(c: Column | str) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def signed_square(c: Column | str) -> Column:
    return F.signum(col(c)) * col(c) * col(c)


def log1p_basis(c: Column | str) -> Column:
    """log(1 + x) for x >= 0, else NULL."""
    return F.when(col(c) >= 0, F.log1p(col(c)))


def clip(c: Column | str, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(c))))


def normalized_difference(a: Column | str, b: Column | str, eps: float = 1e-6) -> Column:
    return ratio(col(a) - col(b), col(a) + col(b), eps)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def local_plane(lat: Column, lon: Column, lat0: float) -> tuple[Column, Column]:
    """(x, y) in km on the plane that touches the sphere at lat0."""
    import math

    k = math.pi * EARTH_KM / 180
    return lon * F.lit(k * math.cos(math.radians(lat0))), lat * F.lit(k)


def unaccent(c: Column | str) -> Column:
    return F.translate(col(c), ACCENTED, PLAIN)


def slug(c: Column | str) -> Column:
    """ASCII, lower case, runs of anything else one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stable_hash(*parts) -> Column:
    """A number of 60 bits from the parts' text, by MD5: the same in any engine and run."""
    text = F.concat_ws(":", *((F.lit(p) if isinstance(p, int) else col(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def label(c: Column | str) -> Column:
    """No accents, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(unaccent(c)), r"\s+", " "))


def zero_pad(c: Column | str, width: int) -> Column:
    """Zeros in front up to the width; longer values stay whole."""
    c = col(c).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def total(columns: Sequence[Column | str]) -> Column:
    """Sum that is NULL if any part is."""
    out = col(columns[0])
    for c in columns[1:]:
        out = out + col(c)
    return out


def total_some(columns: Sequence[Column | str]) -> Column:
    """Sum of the parts that are there, NULL if none is."""
    parts = [col(c) for c in columns]
    return F.when(F.coalesce(*parts).isNotNull(), total([F.coalesce(c, F.lit(0.0)) for c in parts]))


def weighted_mean(columns: Sequence[Column | str], weights: Sequence[float]) -> Column:
    """Complete-case weighted mean."""
    return total([col(c) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)]) / F.lit(float(sum(weights)))


def softmax(columns: Sequence[Column | str]) -> list[Column]:
    """Convex weights from scores, shifted by the largest for range."""
    top = F.greatest(*(col(c) for c in columns)) if len(columns) > 1 else col(columns[0])
    parts = [F.exp(col(c) - top) for c in columns]
    return [p / total(parts) for p in parts]


def tails(value: Column | str, low: Column | str, high: Column | str, strict: bool = False) -> Column:
    """low / center / high; the bounds belong to the tails unless strict."""
    v, a, b = col(value), col(low), col(high)
    under, over = (v < a, v > b) if strict else (v <= a, v >= b)
    return F.when(under, "low").when(over, "high").when(v.isNotNull(), "center")


def bits_clear(c: Column | str, mask: int) -> Column:
    """Whether all bits of the mask are 0; NULL counts as not."""
    return F.coalesce(col(c).bitwiseAND(F.lit(mask)) == 0, F.lit(False))


def in_range(c: Column | str, low: float, high: float, not_value: float | None = None) -> Column:
    """Open interval, optionally without a fill value."""
    ok = (col(c) > low) & (col(c) < high)
    return ok if not_value is None else ok & (col(c) != not_value)


def decode(c: Column | str, fill: float, scale: float, offset: float) -> Column:
    """Physical value of a packed one, NULL for the fill value."""
    return F.when(col(c) != fill, col(c) * F.lit(scale) + F.lit(offset))
