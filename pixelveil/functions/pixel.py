"""Column expressions of the signal model: weights, masks, strength, the signal itself, names and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luma weights of red, green and blue (fixed values).
RED, GREEN, BLUE = 0.299, 0.587, 0.114
#: Seed of the deterministic signal (fixed value).
SEED = 28390211


def gray(red: Column, green: Column, blue: Column) -> Column:
    return red * RED + green * GREEN + blue * BLUE


def visible(value: Column, alpha: Column) -> Column:
    """A channel's value, 0 where alpha is 0."""
    return F.when(alpha == 0, F.lit(0)).otherwise(value)


def nvf(total: Column, squares: Column, p: int) -> Column:
    """Noise visibility mask var / (1 + var) from a window's sum and sum of squares."""
    n = p * p
    var = F.greatest((squares * n - total * total).cast("double") / float(n * n), F.lit(0.0))
    return var / (var + 1.0)


def target_rms(psnr: float) -> float:
    """Root mean square change that gives ``psnr`` dB on a scale to 255."""
    if not psnr > 0:
        raise ValueError("psnr must be positive")
    return 255.0 / (10.0 ** (psnr / 10.0)) ** 0.5


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))


def to_byte(value: Column) -> Column:
    """Clamped and truncated to 0..255."""
    return F.floor(clamp(value)).cast("bigint")


def signal_value(r: Column, c: Column, seed: int = SEED) -> Column:
    """A standard normal value for each place, by Box-Muller from counters: the same on any cluster."""
    prime = F.lit(2147483647).cast("bigint")
    a = F.pmod(F.pmod(r * 7919 + c * 104729 + seed, prime) * 48271, prime)  # the remainder first, or products of far places leave 64 bits
    b = F.pmod(F.pmod(r * 15485863 + c * 32452843 + 17, prime) * 16807, prime)
    return F.sqrt(F.ln((a + 1) / F.lit(2147483648.0)) * -2.0) * F.cos(b * 6.283185307179586 / F.lit(2147483647.0))


#: Scales of the parts of an exact sum: whole 1024ths, and two remainders of 30 bits each.
_WHOLE, _BITS = 1024.0, float(1 << 30)


def exact_sum(value: Column) -> Column:
    """An aggregate: the sum of doubles below 2^53 in size, the same to the last bit in any order and partitioning.

    Each value is cut into three whole numbers (1/2^10, then 1/2^40 and 1/2^70), whose sums are exact; what is below 1/2^70 is
    dropped. The sum of sizes may reach 2^53, of up to 2^33 values.
    """
    scaled = value.cast("double") * _WHOLE
    first = F.floor(scaled)
    rest = (scaled - first) * _BITS
    second = F.floor(rest)
    third = F.floor((rest - second) * _BITS)
    return (F.sum(first) + F.sum(second) / _BITS + F.sum(third) / (_BITS * _BITS)) / _WHOLE


def with_suffix(path: Column, suffix: str) -> Column:
    """A file name with ``suffix`` before its extension; fails without an extension."""
    ok = path.rlike(r"\.[^./\\]+$")
    return F.when(ok, F.regexp_replace(path, r"(\.[^.]+)$", suffix + "$1")).otherwise(F.raise_error(F.concat(F.lit("no extension: "), path)))


def frame_rate(num: Column, den: Column) -> Column:
    """Frames a second to three places; null for a zero denominator."""
    return F.round(num / F.nullif(den, F.lit(0)), 3)


def duration_text(seconds: Column, as_rate: bool) -> Column:
    """Frames a second with two places, or seconds with six; exact halves are rounded up."""
    return F.format_string("%.2f", 1.0 / F.nullif(seconds, F.lit(0.0))) if as_rate else F.format_string("%.6f", seconds)
