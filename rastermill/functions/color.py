"""Colour and tone of single samples, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..layout import clip, col


def finite(v, nan: float = 0.0, high: float = 255.0, low: float = 0.0) -> Column:
    """NaN and null, plus and minus infinity replaced."""
    v = col(v)
    return F.when(v.isNull() | F.isnan(v), nan).when(v == float("inf"), high).when(v == float("-inf"), low).otherwise(v)


#: Weights of blue, green and red for each way to gray (fixed values).
GRAY = {
    "average_rgb": (1 / 3, 1 / 3, 1 / 3),
    "luminance": (0.0722, 0.7152, 0.2126),
    "video": (0.114, 0.587, 0.299),
    "blue": (1.0, 0.0, 0.0),
    "green": (0.0, 1.0, 0.0),
    "red": (0.0, 0.0, 1.0),
}


def gray(b: Column, g: Column, r: Column, source: str = "average_rgb", alpha: Column | None = None) -> Column:
    """Height of a pixel by source; ``alpha_channel`` falls back to the average where there is none, unknown sources too."""
    if source == "max_rgb":
        return F.greatest(b, g, r)
    if source == "average_rgb" or source not in GRAY:
        mean = (b + g + r) / 3
        return F.coalesce(alpha, mean) if source == "alpha_channel" and alpha is not None else mean
    kb, kg, kr = GRAY[source]
    return b * kb + g * kg + r * kr


def contrast(v: Column, mode: str = "balanced") -> Column:
    """soft and sharp pull to and push from the middle of 0..1; balanced only clips (auto needs ``quality.percentile_stretch``)."""
    factor = {"soft": 0.65, "sharp": 1.65}.get(mode)
    return clip(v if factor is None else 0.5 + (v - 0.5) * factor, 0, 1)


def roughness(gray: Column, intensity: float = 0.5, contrast: float = 0.0, invert: bool = False) -> Column:
    g = 1 - gray if invert else gray
    return clip(clip(0.5 + (g - 0.5) * (1 + contrast * 2), 0, 1) * (intensity * 2), 0, 1)


def opacity(gray: Column, threshold: float = 1.0, softness: float = 0.0) -> Column:
    edge = 1 - threshold
    if softness > 0:
        width = max(0.01, softness * 0.45)
        return clip((gray - edge + width * 0.5) / width, 0, 1)
    return F.when(gray > edge, 1.0).otherwise(0.0)


def to_u8(v: Column) -> Column:
    """0..1 to whole 0..255, truncated."""
    return F.floor(clip(v * 255, 0, 255)).cast("double")


def to_u16(v: Column) -> Column:
    return F.floor(clip(v * 65535, 0, 65535)).cast("double")


def half_even(v: Column) -> Column:
    return F.rint(v)


def srgb_to_linear(v: Column) -> Column:
    v = clip(v, 0, 1)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    v = clip(v, 0, 1)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


#: sRGB to XYZ (D65), rows X, Y, Z, columns red, green, blue; the inverse; the white point (fixed values).
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.950456, 1.0, 1.088754)


def bgr_to_lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """8-bit LAB (L times 255/100, a and b plus 128) of samples from 0 to 255, not rounded."""
    lr, lg, lb = (srgb_to_linear(x / 255) for x in (r, g, b))
    t = [(row[0] * lr + row[1] * lg + row[2] * lb) / white for row, white in zip(XYZ, WHITE)]
    fx, fy, fz = (F.when(x > 0.008856, F.cbrt(x)).otherwise(7.787 * x + 16 / 116) for x in t)
    return (116 * fy - 16) * 255 / 100, 500 * (fx - fy) + 128, 200 * (fy - fz) + 128


def lab_to_bgr(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Back from 8-bit LAB to samples from 0 to 255, not rounded."""
    fy = (l * 100 / 255 + 16) / 116
    fx, fz = fy + (a - 128) / 500, fy - (b - 128) / 200
    x, y, z = (F.when(f * f * f > 0.008856, f * f * f).otherwise((f - 16 / 116) / 7.787) * white for f, white in zip((fx, fy, fz), WHITE))
    red, green, blue = (linear_to_srgb(row[0] * x + row[1] * y + row[2] * z) * 255 for row in RGB)
    return blue, green, red
