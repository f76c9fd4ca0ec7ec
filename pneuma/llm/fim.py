"""Fill-in-the-middle: documents cut twice and told as prefix, suffix and middle, with an exact way back."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_column

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints of a text.
EVERY = 256
# A unit, over UTF-8 bytes: a run of ASCII letters, or any other code point (its first byte and those that go on).
_UNIT = rb"(?:[A-Za-z]++|[^A-Za-z][\x80-\xbf]*+)"
_GOES_ON = bytes(range(0x80, 0xC0))


class Checkpoints:
    """Where every `every`-th unit of a text begins, in bytes and in code points.

    One pass counts the units and notes a checkpoint after each full stretch; the index has one entry for `every`
    units, so it stays small beside a very long text. A cut is found by binary search among the checkpoints and a
    rescan of fewer than `every` units.
    """

    def __init__(self, text: bytes, every: int = EVERY):
        self.text = text
        self.unit = re.compile(_UNIT)
        stretch = re.compile(_UNIT + b"{%d}+" % every)
        self.units, self.bytes, self.points = [0], [0], [0]
        at = points = 0
        while m := stretch.match(text, at):
            points += self._points(at, m.end())
            at = m.end()
            self.units.append(self.units[-1] + every), self.bytes.append(at), self.points.append(points)
        self.n = self.units[-1] + sum(1 for _ in self.unit.finditer(text, at))

    def _points(self, start: int, end: int) -> int:
        return len(self.text[start:end].translate(None, _GOES_ON))

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which a unit (from 0) begins; those of the end for n."""
        k = bisect.bisect_right(self.units, unit) - 1
        at = self.bytes[k]
        for _ in range(unit - self.units[k]):
            at = self.unit.match(self.text, at).end()
        return at, self.points[k] + self._points(self.bytes[k], at)


def transform(text: bytes, draws: tuple[int, int, int, int], every: int = EVERY, plain_percent: int = 10, spm_percent: int = 20):
    """n, form, code points of prefix and middle (None if plain), output, for one text and its four draws."""
    marks = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    index = Checkpoints(text, every)
    if not text or any(m in text for m in marks) or draws[2] % 100 >= 100 - plain_percent:
        return index.n, "plain", None, None, text
    first, second = sorted(d % (index.n + 1) for d in draws[:2])
    (a, a_points), (b, b_points) = index.cut(first), index.cut(second)
    p, s, m = marks
    if draws[3] % 100 < spm_percent:
        form, output = "spm", b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    else:
        form, output = "psm", b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return index.n, form, a_points, b_points - a_points, output


def _run(every: int, plain_percent: int, spm_percent: int):
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):  # a step's outputs, and not a batch's, are in memory at once
                part = batch.slice(at, 500)
                draws = part.column("draws").to_pylist()
                rows = [transform(t.as_py(), d, every, plain_percent, spm_percent) for t, d in zip(part.column("text"), draws, strict=True)]
                yield pa.record_batch([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", *names])

    return run


def draws(id_col: str, seed: int = 1) -> Column:
    """Four numbers from 0 to 2^32 - 1: the first groups of eight digits of the sha256 of "<seed>:<id>"; a null id is empty."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(told, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(
    docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each text cut at two of its unit borders, drawn by its id, and put in another order.

    Units are runs of ASCII letters and all other code points. Form "psm" is prefix, suffix, middle, each after its
    mark, "spm" is suffix, prefix, middle; "plain" is the text as it was: drawn for plain_percent of the documents, and
    for every text that is empty or holds a mark. spm_percent of the others are spm.

    Null text: empty. Rows are independent: repeated rows have repeated results, a null id draws as an empty one. Equal
    cuts leave an empty middle; a prefix or suffix may be empty too. No shuffle; a task holds one whole text and its
    sparse index at a time. Returns doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    own = f"`{id_col}`"
    rows = docs.select(F.col(own).alias("doc_id"), bytes_column(f"`{text_col}`").alias("text"), draws(own, seed).alias("draws"))
    done = rows.mapInArrow(_run(every, plain_percent, spm_percent), f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return done.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A cut text holds no mark, so the first of each mark is the one put in."""
    between = lambda whole, mark: F.substring_index(whole, mark, 1)
    after = lambda whole, part: F.substring(whole, F.char_length(part) + 4, F.char_length(whole))
    body = F.substring(output, F.lit(4), F.char_length(output))

    def joined(mark: str, prefix_first: bool) -> Column:
        one = between(body, mark)
        rest = after(body, one)
        two = between(rest, MIDDLE)
        middle = after(rest, two)
        return F.concat(one, middle, two) if prefix_first else F.concat(two, middle, one)

    return F.when(form == "psm", joined(SUFFIX, True)).when(form == "spm", joined(PREFIX, False)).otherwise(output)
