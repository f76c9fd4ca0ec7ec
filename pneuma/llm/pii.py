"""Personal data: base patterns, and an offset-preserving pass over deobfuscated text."""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always begins at the first digit of a run, so the look-behind only saves vain attempts.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

# Letters that look like Latin ones (fixed values, by script).
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναικρ", "ABEZHIKMNOPTYXovaikp", strict=True))
_CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁ", "ABEKMHOPCTYXSIJaeopcyxsijhd", strict=True))
_SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " "}
_GONE = "­​‌‍⁠﻿"
_OTHER_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal())
_ODD = re.compile(f"[Ͱ-ԯ{_OTHER_DIGITS}‐-–․−。﹫！-～  {_GONE}]")
_DIGITS = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789", strict=True))
_WORD = "|".join(_DIGITS)
# Runs of spelled digits, and of figures between or beside them.
_TIMES = {"double": 2, "triple": 3}
_SAID = rf"(?:(?:(?:double|triple)[\x20-]+)?(?:{_WORD})\b|[0-9]++\b)"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9_])(?=[0-9defnopstz])(?:plus[\x20-]+)?{_SAID}(?:[\x20-]+{_SAID})++", re.I)
_SPELLED_PART = re.compile(rf"plus|double|triple|{_WORD}|[0-9]+|[\x20-]+", re.I)
_DOTTED = re.compile(rf"\b(?:{_WORD})(?:\x20+(?:{_WORD})){{0,2}}(?:\x20+dot\x20+(?:{_WORD})(?:\x20+(?:{_WORD})){{0,2}}){{3}}\b", re.I)
_BRACKET = re.compile(r"\x20*[(\[{<]\x20*(at|dot)\x20*[)\]}>]\x20*|[(\[{<](@|\.)[)\]}>]", re.I)
# A sign or a spelled one between spaces, and at and dot between underscores or hyphens.
_SPACED = re.compile(r"(?<=[A-Za-z0-9_%+-])(\x20+@\x20+)([A-Za-z0-9-]+(?:(?:\x20\.\x20|\.)[A-Za-z0-9-]+)+)")
_SPACED_DOT = re.compile(r"\x20\.\x20")
_JOINED = re.compile(r"(?<=[A-Za-z0-9])(([_-])at\2)([A-Za-z0-9]+(?:\2dot\2[A-Za-z0-9]+)+)(?![A-Za-z0-9])", re.I)
# Last labels that make plain words an address where only the at is spelled, as in "ann at example.com"; a sentence
# that ends without a space looks the same otherwise (fixed values).
_LAST = set(
    "com|org|net|edu|gov|mil|int|info|biz|name|io|dev|app|co|me|tv|xyz|online|site|shop|tech|cloud|email|ai|uk|us|de|fr|es|it|nl|eu|ch|at|be|ca|au|nz|jp|cn|kr|tw|hk|sg|in|br|ar|cl|ru|ua|by|kz"
    "|pl|cz|sk|hu|ro|bg|hr|si|gr|tr|il|ir|sa|ae|eg|za|ng|ke|th|vn|id|ph|se|no|dk|fi|ie|pt|mx|lu|lt|lv|ee|cy".split("|")
)
_PLAIN_AT = re.compile(r"(?<!\x20)\x20+at\x20+", re.I)
_PLAIN_DOT = re.compile(r"(?<!\x20)\x20+dot\x20+", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_LAST_WORD = re.compile(r"[A-Za-z]{2,}")
# Words of prose around "dot", as in "look at the dot on top" (fixed values); as labels they need a last one in _LAST.
_PROSE = set("a an the this that these those my your his her its our their each every any some no one and or but if is are was were be of on in to for from with by as than then at".split())
_GROUP = rf"(?:[0-9]++|\b(?:{_WORD})\b)"
_PLAIN_IP = re.compile(rf"(?<![0-9]){_GROUP}(?:(?:\.|\x20+dot\x20+){_GROUP})++", re.I)
_GROUP_WORD = re.compile(rf"\b(?:{_WORD})\b", re.I)
_HINT = re.compile(r"[(\[{<]\x20*(?:at|dot|@|\.)\x20*[)\]}>]", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        # The run of local characters before the sign, as far as the last match.
        low = at
        while low > last and not _NOT_LOCAL.match(text, low - 1):
            low -= 1
        m = _DOMAIN.match(text, at + 1) if low < at else None
        if m:
            yield low, m.end()
            last = m.end()
        at = text.find("@", max(last, at + 1))


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted: kind counts in KINDS, offsets in code points."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _plain(c: str) -> str:
    if c in _GONE:
        return ""
    if c in _SIGNS:
        return _SIGNS[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    return _GREEK.get(c) or _CYRILLIC.get(c) or c


def normalise(text: str) -> tuple[str, list[int], list[int]] | None:
    """The text with its disguises undone, and for each of its characters the source span; None if there are none.

    Transducers in turn, each a list of (start, end, replacement): characters (homoglyphs, digits of other scripts,
    invisible ones), at, dot and their signs in brackets, signs between spaces, at and dot between underscores or
    hyphens, words (spelled digits in runs of three or more, alone or among figures),
    and at and dot between words.
    """
    begin: list[int] | range = range(len(text))
    end: list[int] | range = range(1, len(text) + 1)
    changed = False
    for stage in (_characters, _brackets, _signs, _words, _between):
        edits = stage(text)
        if not edits:
            continue
        changed = True
        out, b2, e2, at = [], [], [], 0
        for a, z, put in edits:
            out.append(text[at:a])
            b2.extend(begin[at:a]), e2.extend(end[at:a])
            out.append(put)
            b2.extend([begin[a]] * len(put)), e2.extend([end[z - 1]] * len(put))
            at = z
        out.append(text[at:])
        b2.extend(begin[at:]), e2.extend(end[at:])
        text, begin, end = "".join(out), b2, e2
    return (text, list(begin), list(end)) if changed else None


def _characters(text: str):
    if text.isascii() or not any(map(_ODD.match, set(text))):
        return []
    return [(m.start(), m.end(), p) for m in _ODD.finditer(text) if (p := _plain(m[0])) != m[0]]


def _brackets(text: str):
    """at in brackets is a sign, dot in brackets a spelled one, and a sign in brackets itself."""
    if not _HINT.search(text):
        return []
    return [(m.start(), m.end(), m[2] or ("@" if m[1].lower() == "at" else " dot ")) for m in _BRACKET.finditer(text)]


def _signs(text: str):
    """@ between spaces before labels that dots, with or without spaces, join and whose last is in _LAST; and at between
    underscores or hyphens before labels that dot joins in the same way."""
    edits = []
    for m in _SPACED.finditer(text) if " @ " in text else ():
        if m[2].rsplit(".", 1)[-1].strip().lower() in _LAST:
            edits += [(*m.span(1), "@"), *((d.start(), d.end(), ".") for d in _SPACED_DOT.finditer(text, *m.span(2)))]
    for m in _JOINED.finditer(text) if "at" in text.lower() else ():
        if _LAST_WORD.fullmatch(m[3].rsplit(m[2], 1)[-1]):
            dot = re.compile(f"{m[2]}dot{m[2]}", re.I)
            edits += [(*m.span(1), "@"), *((*d.span(), ".") for d in dot.finditer(text, *m.span(3)))]
    return _apart(edits)


def _figures(spelled: str) -> str | None:
    """A run of spelled digits in figures, double and triple ones as often; the gaps between two groups of figures stay. None
    for a run that holds fewer than two spelled digits, or than three in all."""
    parts = _SPELLED_PART.findall(spelled)
    words = [p for p in parts if p.lower() in _DIGITS]
    extra = sum(_TIMES.get(p.lower(), 1) - 1 for p in parts)
    if len(words) + extra < 2 or len(words) + extra + sum(len(p) for p in parts if p.isdigit()) < 3:
        return None
    out, times = [], 1
    for k, p in enumerate(parts):
        if p[0] in " -":
            if parts[k - 1].isdigit() and k + 1 < len(parts) and parts[k + 1].isdigit():
                out.append(p)
        elif p.lower() in _TIMES:
            times = _TIMES[p.lower()]
        else:
            out.append("+" if p.lower() == "plus" else _DIGITS.get(p.lower(), p) * (times if p.lower() in _DIGITS else 1))
            times = 1
    return "".join(out)


def _octets(text: str):
    """Edits of four groups of up to three spelled digits with spelled dots between them: an address, digit by digit."""
    for m in _DOTTED.finditer(text) if "dot" in text.lower() else ():
        groups = re.split(r"\x20+dot\x20+", m[0], flags=re.I)
        yield m.start(), m.end(), ".".join("".join(_DIGITS[w.lower()] for w in g.split()) for g in groups)


def _words(text: str):
    edits = list(_octets(text))
    starts, ends = [a for a, _, _ in edits], [b for _, b, _ in edits]
    for m in _SPELLED.finditer(text):
        k = bisect.bisect_right(ends, m.start())  # the first address that ends beyond its start
        if (k == len(starts) or starts[k] >= m.end()) and (put := _figures(m[0])):
            edits.append((m.start(), m.end(), put))
    return _apart(edits)


def _apart(edits):
    """Sorted; of edits that overlap the first stays."""
    kept, at = [], 0
    for e in sorted(edits):
        if e[0] >= at:
            kept.append(e)
            at = e[1]
    return kept


def _between(text: str):
    """at and dot as words of their own, each undone by itself.

    dot: between the labels before and after an @ or at, of any number and length, and between four or more groups of
    digits (single digits may be spelled). at: before labels with a spelled dot between them, whose last has two letters
    or more and none of which is in _PROSE, or else before labels whose last is in _LAST. A first label www makes it a
    site.
    """
    low = text.lower()
    if "dot" not in low and " at " not in low:
        return []
    dots = {m.start(): m.end() for m in _PLAIN_DOT.finditer(text)} if "dot" in low else {}
    before = {b: a for a, b in dots.items()}
    edits = set()

    def labels(at: int):
        """(end, the dot before it if spelled, label) of the labels from at on."""
        out, gap = [], None
        while m := _LABEL.match(text, at):
            out.append((m.end(), gap, m[0]))
            at = m.end()
            if text.startswith(".", at):
                gap, at = None, at + 1
            elif at in dots:
                gap, at = (at, dots[at], "."), dots[at]
            else:
                break
        return out

    def local(at: int):
        """Spelled dots of the local part that ends at at; None if there is no local part."""
        out, begin = [], at
        while begin and not _NOT_LOCAL.match(text, begin - 1):
            begin -= 1
            if (a := before.get(begin)) and not _NOT_LOCAL.match(text, a - 1):
                out.append((a, begin, "."))
                begin = a
        return out if begin < at else None

    for m in _PLAIN_AT.finditer(text):
        found = labels(m.end())
        while found and found[-1][2].lower() not in _LAST and not (any(g for _, g, _ in found) and _LAST_WORD.fullmatch(found[-1][2]) and not {x[2].lower() for x in found} & _PROSE):
            found.pop()
        if len(found) > 1 and found[0][2].lower() != "www" and (own := local(m.start())) is not None:
            edits.update([(*m.span(), "@"), *own, *(g for _, g, _ in found if g)])
    if dots:
        at = text.find("@")
        while at >= 0:
            if (own := local(at)) is not None:
                edits.update([*own, *(g for _, g, _ in labels(at + 1) if g)])
            at = text.find("@", at + 1)
        for m in _PLAIN_IP.finditer(text):
            gaps = [d.span() for d in _PLAIN_DOT.finditer(text, *m.span())]
            if gaps and len(gaps) + m[0].count(".") >= 3:
                edits.update((*g, ".") for g in gaps)
                edits.update((*d.span(), _DIGITS[d[0].lower()]) for d in _GROUP_WORD.finditer(text, *m.span()))
    return _apart(edits)


def detect(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones and those that only the normalised text shows.

    A span of the normalised text is added unless it lies within a base span of its kind.
    """
    base = find(text)
    undone = normalise(text)
    if undone is None:
        return base, base
    plain, begin, end = undone
    more = [(begin[a], k, end[b - 1]) for a, k, b in find(plain)]
    own = {k: [(a, b) for a, kind, b in base if kind == k] for k in range(len(KINDS))}
    added = [x for x in more if not any(a <= x[0] and x[2] <= b for a, b in own[x[1]])]
    return base, sorted(set(base + added))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        elif b <= at:
            continue
        at = max(at, b)
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _run(redacted: bool):
    def run(batches):
        shape = lambda xs: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in xs]
        for batch in batches:
            base, spans, clean = [], [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                x, y = detect(text)
                base.append(shape(x)), spans.append(shape(y))
                if redacted:
                    clean.append(redact(text, y) if y else t.as_py())
            columns = {"base": pa.array(base, pa.list_(_SPAN)), "spans": pa.array(spans, pa.list_(_SPAN))}
            names = [n for n in batch.schema.names if n != "text" or not redacted]
            yield pa.record_batch(
                [*(batch.column(n) for n in names), *([pa.array(clean, pa.string())] if redacted else []), *columns.values()],
                [*names, *(["text"] if redacted else []), *columns],
            )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans and all spans of every whole text, ordered by start, then kind as in KINDS.

    Null text: empty. Ids may be null or repeated: rows are independent. No shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_run(False), f"doc_id {id_type}, text string, base {_SPANS}, spans {_SPANS}").drop("text")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span in text_col replaced by <KIND>; other columns, and texts without spans, as they are."""
    names = docs.columns
    rest = F.struct(*[F.col(f"`{n}`") for n in names if n != text_col])
    rows = docs.select(rest.alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    told = T.StructType([*rows.schema.fields, T.StructField("base", spans), T.StructField("spans", spans)])  # names may hold any characters
    done = rows.mapInArrow(_run(True), told)
    return done.select(*[F.col("text").alias(n) if n == text_col else F.col(f"rest.`{n}`").alias(n) for n in names])
