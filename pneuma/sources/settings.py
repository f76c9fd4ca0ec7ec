"""Settings: two-level JSON documents against a table of items with kinds, bounds and defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Item:
    """What a setting may hold. Kinds: range (low to high), options, bool, colour, text."""

    key: str
    kind: str = "text"
    default: str | None = None
    low: float | None = None
    high: float | None = None
    options: tuple[str, ...] = ()

    def column(self) -> Column:
        double = lambda x: F.lit(x).cast("double")
        options = F.array(*[F.lit(o) for o in self.options]).cast("array<string>")
        return F.struct(F.lit(self.key).alias("key"), F.lit(self.kind).alias("kind"), double(self.low).alias("low"), double(self.high).alias("high"), options.alias("options"), F.lit(self.default).cast("string").alias("default"))


def given(docs: DataFrame, doc: str, keep: list[str]) -> DataFrame:
    """Each setting of a document as a row: the columns to keep, key and value (as text; a JSON null is null).

    A value at the top has its own name as key, one in a group is group.name. Anything but an object gives no rows.
    """
    top = F.from_json(F.col(doc), "map<string,string>")
    rows = docs.select(*keep, F.explode(top).alias("_name", "_value"))
    inner = F.when(F.ltrim("_value").startswith("{"), F.from_json("_value", "map<string,string>"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    flat = F.when(inner.isNotNull(), F.map_entries(F.transform_keys(inner, lambda k, v: F.concat(F.col("_name"), F.lit("."), k)))).when(F.ltrim("_value").startswith("{"), none).otherwise(F.array(F.struct(F.col("_name").alias("key"), F.col("_value").alias("value"))))
    return rows.select(*keep, F.inline(flat))


def known(settings: DataFrame, items: DataFrame) -> DataFrame:
    """Settings with their items, by key; those of unknown keys are dropped."""
    return settings.join(items, "key")


def checked(value: Column, kind: Column, low: Column, high: Column, options: Column, default: Column) -> Column:
    """A value as its item takes it.

    range: a number, moved to the nearest bound, whole if written so, else the default; options: one of them, else the
    first; bool: true or false, else the default; colour: #rrggbb or #aarrggbb, else the default; other kinds: as it is. A
    missing value is the default.
    """
    number = value.try_cast("double")
    inside = F.greatest(low, F.least(high, number))
    # A bound shows as a whole number where it is one, as does a number that is written so.
    shown = F.when(number == inside, value).when(inside == F.floor(inside), inside.cast("long").cast("string")).otherwise(inside.cast("string"))
    return (
        F.when(value.isNull(), default)
        .when(kind == "range", F.when(number.isNull() | F.isnan(number), default).otherwise(shown))
        .when(kind == "options", F.when(F.array_contains(options, value), value).otherwise(F.try_element_at(options, F.lit(1))))
        .when(kind == "bool", F.when(value.isin("true", "false"), value).otherwise(default))
        .when(kind == "colour", F.when(value.rlike("^#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"), value).otherwise(default))
        .otherwise(value)
    )


def loaded(docs: DataFrame, doc: str, keep: list[str], items: list[Item]) -> DataFrame:
    """For each document every item, with the document's value where it gives a valid one, else as checked() says.

    keep must tell documents apart. A document that can't be read has all defaults; of a key that it gives twice the
    greatest text counts.
    """
    own = given(docs, doc, keep).groupBy(*keep, "key").agg(F.max("value").alias("value"))
    every = docs.select(*keep, F.explode(F.array(*[i.column() for i in items])).alias("item")).select(*keep, "item.*")
    value = checked(*[F.col(c) for c in ("value", "kind", "low", "high", "options", "default")])
    return every.join(own, [*keep, "key"], "left").select(*keep, "key", "kind", value.alias("value"))


def saved(settings: DataFrame, keep: list[str]) -> DataFrame:
    """The documents of loaded() again: groups and names in order of letters, numbers and booleans as such."""
    raw = F.col("kind").isin("range", "bool")
    told = F.when(F.col("value").isNull(), "null").when(raw, F.col("value")).otherwise(F.regexp_replace(F.to_json(F.array("value")), r"^\[|\]$", ""))
    parts = F.split("key", r"\.", 2)
    rows = settings.select(*keep, parts[0].alias("_g"), F.try_element_at(parts, F.lit(2)).alias("_n"), told.alias("_v"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    pairs = F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct(F.col("_n").alias("n"), F.concat(quoted(F.col("_n")), F.lit(": "), F.col("_v")).alias("t")))))
    groups = rows.groupBy(*keep, "_g").agg(F.max(F.when(F.col("_n").isNull(), F.col("_v"))).alias("_alone"), F.array_join(F.transform(pairs, lambda p: p["t"]), ", ").alias("_in"))
    body = F.coalesce(F.when(F.col("_in") != "", F.concat(F.lit("{"), F.col("_in"), F.lit("}"))), F.col("_alone"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("_g").alias("g"), F.concat(quoted(F.col("_g")), F.lit(": "), body).alias("t"))))
    docs = groups.groupBy(*keep).agg(listed.alias("_l"))
    return docs.select(*keep, F.concat(F.lit("{"), F.array_join(F.transform("_l", lambda p: p["t"]), ", "), F.lit("}")).alias("doc"))


def shown_cards(cards: DataFrame, hits: DataFrame, index: str = "idx") -> DataFrame:
    """The cards whose index is among the hits, in their own order."""
    return cards.join(hits.select(index).distinct(), index, "left_semi").select(*cards.columns).orderBy(index)
