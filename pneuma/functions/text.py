"""Column functions for noisy report text."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_key(c: Column) -> Column:
    """Lower case, only letters, digits, % and /."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9%/]+", "")


def case_id(stem: Column) -> Column:
    """A stem as a case id: trimmed, white space runs to one underscore."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(stem, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "_")


def clean_cell(c: Column) -> Column:
    """Dashes and quotes to ASCII, white space collapsed, and gaps inside numbers closed. The patterns are fixed values."""
    s = F.translate(F.coalesce(c, F.lit("")), "−–—‘’“”\n", "---''\"\" ")
    for pattern, put in ((r"(?U)\s+", " "), (r"(?U)(?<=\d)\s+(?=[.,%])", ""), (r"(?U)(?<=[.,%])\s+(?=\d)", ""), (r"(?U)(?<=-)\s+(?=\d)", "")):
        s = F.regexp_replace(s, pattern, put)
    return F.trim(s)


def has_digit(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)\d"), F.lit(False))


def read(number: Column) -> Column:
    """A text as a number, or null. An empty one, which is common, is not tried: a failed cast is slow."""
    return F.when(number != "", number.try_cast("double"))


def parse_float(c: Column) -> Column:
    """The first number, a comma read as a point; null if there is none."""
    return read(F.regexp_extract(F.translate(F.coalesce(c, F.lit("")), ",", "."), r"[-+]?\d+(\.\d+)?", 0))


def parse_grade(c: Column) -> Column:
    """The first letter from A to F that stands alone."""
    return F.nullif(F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), r"(?U)\b([A-F])\b", 1), F.lit(""))


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/\\]+$", 0)


def first_line(c: Column) -> Column:
    return F.split(c, "\n")[0]


def tail(c: Column, n: int) -> Column:
    """The last n characters of the trimmed text."""
    return F.substring(F.trim(c), -n, n) if n else F.lit("")


def fixed(c: Column, decimals: int) -> Column:
    """A number with so many decimals, halves to even on the binary value."""
    return F.call_function("format_number", c, F.lit("0." + "0" * decimals if decimals else "0"))


def or_missing(c: Column, put: str = "N/A") -> Column:
    """An empty text counts as missing."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(put))


def template(c: Column, values: dict[str, Column]) -> Column:
    """Replace --Name variables, longest name first; unknown ones stay."""
    for name in sorted(values, key=len, reverse=True):
        c = F.replace(c, F.lit(f"--{name}"), values[name].cast("string"))
    return c


@functools.cache
def wide_ranges() -> tuple[tuple[int, int], ...]:
    """First and last code point of each run of characters that take two columns (East Asian wide or full width)."""
    wide = [unicodedata.east_asian_width(chr(c)) in "WF" for c in range(0x110000)]
    edges = [c for c in range(0x110000) if wide[c] != (wide[c - 1] if c else False)] + ([0x110000] if wide[-1] else [])
    return tuple((a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True))


def _in_ranges(point: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    """Whether a number lies in one of the sorted ranges, by binary search."""
    if len(ranges) == 1:
        return (point >= ranges[0][0]) & (point <= ranges[0][1])
    half = len(ranges) // 2
    return F.when(point < ranges[half][0], _in_ranges(point, ranges[:half])).otherwise(_in_ranges(point, ranges[half:]))


def display_width(c: Column) -> Column:
    """Columns that a text takes: 2 for each wide character, 1 for any other, combining ones included; 0 for null.

    Only texts with a character beyond ASCII are looked at one by one.
    """
    text = F.coalesce(c, F.lit(""))
    wide = lambda ch: F.when(_in_ranges(F.ascii(ch), wide_ranges()), 2).otherwise(1)
    each = F.reduce(F.filter(F.split(text, ""), lambda ch: ch != ""), F.lit(0), lambda n, ch: n + wide(ch))
    return F.when(F.octet_length(text) == F.char_length(text), F.char_length(text)).otherwise(each)


def line_chars(max_width: float, font_size: float = 11) -> int:
    """How many characters a line of a width holds, where a character is taken as 0.55 of the font size wide."""
    n = int(max_width / (font_size * 0.55))
    return next(k for k in (n + 1, n, n - 1) if k * font_size * 0.55 <= max_width)


def wrapped(c: Column, width: int, measure=F.char_length) -> Column:
    """The lines of a text, filled word by word up to width; a longer word is cut on lines of its own.

    measure tells how wide a text is: its characters, or display_width. A character wider than a line has a line of its
    own. A text that fits is one line as it is; a null or blank one is one empty line.
    """
    whole = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    words = F.split(whole, r"(?U)\s+")
    joined = lambda s, w: F.concat_ws(" ", s["line"], w)
    none = F.array().cast("array<string>")
    filling = lambda first: F.struct(none.alias("done"), first.alias("line"))
    full = lambda s, w: F.struct(F.concat(s["done"], F.array(s["line"])).alias("done"), w.alias("line"))
    step = lambda put: lambda s, w: F.when(measure(put(s, w)) <= width, F.struct(s["done"].alias("done"), put(s, w).alias("line"))).otherwise(full(s, w))
    end = lambda s: F.concat(s["done"], F.array(s["line"]))
    filled = F.reduce(F.slice(words, 2, F.size(words)), filling(words[0]), step(joined), end)
    if measure is F.char_length:
        cut = lambda line: F.regexp_extract_all(line, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    else:
        letters = lambda line: F.filter(F.split(line, ""), lambda ch: ch != "")
        grown = step(lambda s, ch: F.concat(s["line"], ch))
        cut = lambda line: F.when(measure(line) <= width, F.array(line)).otherwise(F.reduce(F.slice(letters(line), 2, F.char_length(line)), filling(letters(line)[0]), grown, end))
    return F.when(measure(whole) <= width, F.array(whole)).otherwise(F.flatten(F.transform(filled, cut)))
