"""Colour arithmetic as column expressions: Column -> Column, no UDF, no shuffle.

Channels are separate integer columns, 0 to 255.  All integer formulas are exact; rounding is half up, floor(x + 0.5).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def clamp(x: Column, lo: int = 0, hi: int = 255) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 luminance in 8 bits."""
    return F.shiftright(r * 54 + g * 183 + b * 19 + 128, 8)


def rgb_to_gray(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 luminance from 0 to 1; black and white are exactly 0 and 1."""
    exact = (r * 0.2126 + g * 0.7152 + b * 0.0722) / 255.0
    return F.when((r == 0) & (g == 0) & (b == 0), F.lit(0.0)).when((r == 255) & (g == 255) & (b == 255), F.lit(1.0)).otherwise(exact)


def on_white(a: Column, r: Column, g: Column, b: Column) -> Column:
    """Luminance over a white ground; the blend shifts by 8 rather than dividing by 255."""
    lum = luminance(r, g, b)
    return F.when(a == 255, lum).otherwise(F.lit(255) - F.shiftright((F.lit(255) - lum) * a, 8))


def luma(r: Column, g: Column, b: Column) -> Column:
    """The measures' own luma, which is not luminance(): Rec. 601 in thousandths, cut to an integer; alpha is ignored."""
    return F.floor((r * 299 + g * 587 + b * 114) / F.lit(1000)).cast("int")


def premultiplied(c: Column, a: Column) -> Column:
    return c * a / F.lit(255.0)


def exact_key(a: Column, r: Column, g: Column, b: Column) -> Column:
    """ARGB as a non-negative long; all clear pixels share key 0."""
    wide = a.cast("long")
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(((wide * 256 + r) * 256 + g) * 256 + b)


def coarse_key_opaque(a: Column, r: Column, g: Column, b: Column) -> Column:
    """Six bits of each colour channel, for wholly opaque images."""
    return F.when(a == 0, F.lit(0).cast("long")).otherwise((F.shiftright(r, 2).cast("long") * 64 + F.shiftright(g, 2)) * 64 + F.shiftright(b, 2))


def coarse_key_alpha(a: Column, r: Column, g: Column, b: Column) -> Column:
    """Five bits of each of four channels, plus one, so that clear stays apart from nearly clear black."""
    five = lambda c: F.shiftright(c, 3)
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(((five(a).cast("long") * 32 + five(r)) * 32 + five(g)) * 32 + five(b) + 1)


def coarse_key(bits: Column, a: Column, r: Column, g: Column, b: Column) -> Column:
    """The key at the given precision: 0 exact, 6 opaque colour, 5 with alpha."""
    return F.when(bits == 0, exact_key(a, r, g, b)).when(bits == 6, coarse_key_opaque(a, r, g, b)).otherwise(coarse_key_alpha(a, r, g, b))


def srgb_to_linear(c: Column) -> Column:
    x = c / F.lit(255.0)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


#: The published Oklab matrices (linear sRGB to LMS, cube-rooted LMS to Lab).
OKLAB_LMS = [(0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)]
OKLAB_LAB = [(0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660)]


def oklab(a: Column, r: Column, g: Column, b: Column, ground: Column) -> tuple[Column, Column, Column]:
    """Oklab coordinates after compositing in linear light over a grey ground of 0 to 1."""
    alpha = a / F.lit(255.0)
    linear = [srgb_to_linear(c) * alpha + ground * (F.lit(1.0) - alpha) for c in (r, g, b)]
    root = [F.cbrt(sum((m * c for m, c in zip(row[1:], linear[1:])), row[0] * linear[0])) for row in OKLAB_LMS]
    return tuple(sum((m * c for m, c in zip(row[1:], root[1:])), row[0] * root[0]) for row in OKLAB_LAB)


def blend(c: Column, a: Column, ground) -> Column:
    """A channel of alpha a over an opaque ground level."""
    return half_up((c * a + ground * (F.lit(255) - a)) / F.lit(255.0))


def unpremultiply(c: Column, a: Column) -> Column:
    """A channel from its premultiplied value and the rounded alpha, as resampling ends."""
    return F.when(a == 0, F.lit(0)).otherwise(clamp(half_up(c * F.lit(255.0) / a)))


def bin_of(value: Column, least: Column, scale: Column) -> Column:
    """Which of 256 bins a value falls in, cut at both ends."""
    return clamp(F.floor((value - least) * scale)).cast("int")


def compose(base: tuple[int, int, int, int], over: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """One colour over another over black, both as (a, r, g, b); the alpha of `over` counts twice."""
    rounded = lambda x: int(x + 0.5)
    under = [rounded(c * base[0] / 255) for c in base[1:]]
    share = (over[0] / 255) ** 2
    return tuple(rounded(c * share + u * (1 - share)) for c, u in zip(over[1:], under))


def compose_columns(base: tuple[Column, Column, Column, Column], over: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column]:
    """compose() of columns."""
    share = (over[0] / F.lit(255.0)) * (over[0] / F.lit(255.0))
    under = [half_up(c * base[0] / F.lit(255.0)) for c in base[1:]]
    return tuple(half_up(c * share + u * (F.lit(1.0) - share)) for c, u in zip(over[1:], under))
