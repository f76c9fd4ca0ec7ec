"""Colours as columns: channels from 0 to 255, hue in degrees, saturation and value from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors of saturation and value of each shade (fixed values), on a light and on a dark theme.
SHADES = {
    "light": {"DARK_1": (1.0, 0.75), "DARK_2": (1.05, 0.5), "DARK_3": (1.1, 0.4), "LIGHT_1": (1.0, 1.05), "LIGHT_2": (0.75, 1.05), "LIGHT_3": (0.65, 1.05)},
    "dark": {"DARK_1": (1.0, 0.9), "DARK_2": (0.977, 0.82), "DARK_3": (0.95, 0.7), "LIGHT_1": (0.92, 1.0), "LIGHT_2": (0.78, 1.0), "LIGHT_3": (0.65, 1.0)},
}
DARK_SATURATION = 0.84


def to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Struct h, s, v; grey has hue 0 and black saturation 0."""
    r, g, b = (c / 255.0 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = F.nullif(top - low, F.lit(0.0))
    hue = F.when(top == r, (g - b) / spread * 60).when(top == g, (b - r) / spread * 60 + 120).otherwise((r - g) / spread * 60 + 240)
    s = F.coalesce((top - low) / F.nullif(top, F.lit(0.0)), F.when(top.isNotNull(), 0.0))
    return F.struct(F.coalesce(F.pmod(hue, F.lit(360.0)), F.when(top.isNotNull(), 0.0)).alias("h"), s.alias("s"), top.alias("v"))


def to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Struct r, g, b, cut to integers: each channel falls from v by s times its distance from the hue."""

    def channel(n: int) -> Column:
        k = F.pmod(h / 60 + n, F.lit(6.0))
        return ((v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255).cast("int")

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


def shade(hsv: Column, name: str, theme: str = "light") -> Column:
    """The h, s, v of a shade of a colour, saturation and value at most 1; any other name is the primary colour."""
    by_s, by_v = SHADES[theme].get(name, (1.0, 1.0))
    s, v = (hsv["s"] * DARK_SATURATION, F.lit(1.0)) if theme == "dark" else (hsv["s"], hsv["v"])
    return F.struct(hsv["h"].alias("h"), F.least(s * by_s, F.lit(1.0)).alias("s"), F.least(v * by_v, F.lit(1.0)).alias("v"))


def colourfulness(c: Column) -> Column:
    """How far r, g and b of a struct lie apart: between red and green, and between yellow and blue."""
    rg, yb = c["r"] - c["g"], 0.5 * (c["r"] + c["g"]) - c["b"]
    return 0.3 * F.sqrt(rg * rg + yb * yb)


def dominant(palette: Column) -> Column:
    """Of a palette (array of struct r, g, b) the most colourful colour, the first of equals; null of an empty one.

    Bright colours are dimmed first. Reds of no hue and greys go, as long as two others stay, but the first always; of
    the rest the first five count.
    """

    def dimmed(c: Column) -> Column:
        hsv = to_hsv(c["r"], c["g"], c["b"])
        v = hsv["v"]
        return to_rgb(hsv["h"], hsv["s"], v * F.when(v > 0.9, 0.8).when(v > 0.8, 0.9).when(v > 0.7, 0.95).otherwise(1.0))

    flat = lambda c: to_hsv(c["r"], c["g"], c["b"])["h"] < 0.02
    told = F.transform(F.transform(palette, dimmed), lambda c: F.struct(c.alias("c"), flat(c).alias("flat")))

    def chosen(told: Column) -> Column:
        most = F.greatest(F.lit(1), F.size(told) - 2)
        kept = F.filter(told, lambda x, i: ~x["flat"] | (F.size(F.filter(F.slice(told, 1, i + 1), lambda y: y["flat"])) > most))
        ranked = F.transform(F.slice(kept, 1, 5), lambda x, i: F.struct(colourfulness(x["c"]).alias("score"), (-i).alias("minus"), x["c"].alias("c")))
        return F.array_max(ranked)["c"]

    return F.element_at(F.transform(F.array(told), chosen), 1)
