"""Small functions behind dates, pickers, settings and progress, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of(c: Column, options: list) -> Column:
    """A setting that is one of the options, or else the first of them."""
    return F.when(c.isin(options), c).otherwise(F.lit(options[0]))


def existing(folders: Column, present: Column) -> Column:
    """Of an array of folders those that are present, in order."""
    return F.filter(folders, lambda f: F.array_contains(present, f))


def slider_place(value: Column, low: int, high: int, length: int) -> Column:
    """Where a value lies on a slider, cut to a whole pixel; an empty range counts as 1."""
    return ((value - low) / F.lit(float(max(high - low, 1))) * length).cast("int")


def slider_value(place: Column, low: int, high: int, length: int) -> Column:
    """The value at a place of a slider, cut to a whole number."""
    return (place / F.lit(float(max(length, 1))) * (high - low)).cast("int") + low


def progress_text(form: str, value: Column, low: int, high: int) -> Column:
    """%p, %v and %m of a form: percent done (cut), value, and number of steps. An empty range is done."""
    percent = ((value - low) * 100 / F.lit(high - low)).cast("int") if high != low else F.lit(100)
    out = F.replace(F.lit(form), F.lit("%p"), percent.cast("string"))
    return F.replace(F.replace(out, F.lit("%v"), value.cast("string")), F.lit("%m"), F.lit(str(high - low)))


def scroll_step(delta: Column, left: Column, total: int, mode: str) -> Column:
    """How far a scroll of delta moves in the step that has `left` of `total` steps before it."""
    m = total / 2
    x = F.abs(F.lit(total) - left - m)
    return {
        "none": F.lit(0.0), "constant": delta / total, "linear": 2 * delta / total * (m - x) / m,
        "quadratic": F.lit(3 / 4 / m) * (1 - x * x / m / m) * delta, "cosine": (F.cos(x * math.pi / m) + 1) / (2 * m) * delta,
    }[mode]


def hour12(hour: Column) -> Column:
    return F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("int")


def half_of_day(hour: Column) -> Column:
    return F.when(hour < 12, "AM").otherwise("PM")


def hour24(hour: Column, half: Column) -> Column:
    """The hour of a 12-hour clock and its half; 12 AM is 0, 12 PM is 12."""
    return (hour % 12 + F.when(half == "PM", 12).otherwise(0)).cast("int")


def two_digits(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def year_page(year: Column, first: int) -> Column:
    """Which page of twelve years holds a year."""
    return F.floor((year - first) / 12).cast("int")


def month_page(date: Column, first: int) -> Column:
    return ((F.year(date) - first) * 12 + F.month(date) - 1).cast("int")


def decade_of(year: Column, shown: int = 16) -> Column:
    """The decade that most of the years from this one on belong to; of equals the earlier."""
    decades = F.transform(F.sequence(F.lit(0), F.lit(shown - 1)), lambda k: F.floor((year + k) / 10) * 10)
    kinds = F.array_distinct(decades)
    counted = F.transform(kinds, lambda d: F.struct((-F.size(F.filter(decades, lambda x: x == d))).alias("minus"), d.alias("decade")))
    return F.array_min(counted)["decade"].cast("int")


def with_suffix(c: Column, suffix: str) -> Column:
    return F.concat(c, F.lit(suffix))


def without_suffix(c: Column) -> Column:
    """The text without its last character."""
    return F.substring(c, F.lit(1), F.char_length(c) - 1)


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two_digits(month), two_digits(day)), "yyyy-MM-dd")


def valid_time(hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since midnight of a time of day, or null if there is none."""
    whole = lambda c, n: (c >= 0) & (c < n)
    return F.when(whole(hour, 24) & whole(minute, 60) & whole(second, 60), hour * 3600 + minute * 60 + second).cast("int")


def merged_settings(own: Column, general: Column) -> Column:
    """A map of settings over one of defaults."""
    return F.map_concat(F.map_filter(general, lambda k, v: ~F.map_contains_key(own, k)), own)


def repeated(items: Column, times: int) -> Column:
    """A list for a cyclic wheel: the items several times over."""
    return F.flatten(F.array_repeat(items, times))


def padded(items: Column, n: int) -> Column:
    """A list with n blanks before and after."""
    blanks = F.array_repeat(F.lit(""), n)
    return F.concat(blanks, items, blanks)


def without_prefix(settings: Column, prefix: str) -> Column:
    """A map whose keys have lost a prefix."""
    return F.transform_keys(settings, lambda k, v: F.when(F.startswith(k, F.lit(prefix)), F.substring(k, F.lit(len(prefix) + 1), F.char_length(k))).otherwise(k))


def distinct_joined(parts: Column, by: str = "\n") -> Column:
    """Texts joined, each once, in order."""
    return F.array_join(F.array_distinct(parts), by)


def same_bag(a: Column, b: Column) -> Column:
    """Whether two lists hold the same items as often, in any order."""
    return F.array_sort(a) == F.array_sort(b)


def first_place(items: Column, item: Column) -> Column:
    """The place of an item in a list from 0, or -1."""
    return (F.coalesce(F.array_position(items, item), F.lit(0)) - 1).cast("int")


def kept_to(items: Column, place: Column) -> Column:
    """A trail cut after a place (from 0)."""
    return F.slice(items, 1, place + 1)


def marked_json(output: Column, marker: str, schema: str) -> Column:
    """The JSON after a marker at the start of a line; of several such lines the last counts."""
    lines = F.filter(F.split(output, "\n"), lambda x: F.startswith(x, F.lit(marker)))
    return F.from_json(F.substring(F.try_element_at(lines, F.lit(-1)), F.lit(len(marker) + 1), F.lit(1 << 30)), schema)
