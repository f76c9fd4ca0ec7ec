"""Row and column labels to canonical names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key


def match_labels(df: DataFrame, names: list[str], aliases: dict[str, str] | None = None, column: str = "label", least: float = 0.55) -> DataFrame:
    """df with name and score: by alias (score 1), else the name most alike by matching blocks, if alike enough.

    Each distinct normalised label is compared once with the names, a short list. The first of equally alike names
    wins. Null and empty labels, and those like no name, have null in both.
    """
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    keyed = df.withColumn("_key", normalize_key(F.col(f"`{column}`")))
    blank = F.col("_key") == ""  # it may be the key of most rows, and it is like no name
    none = keyed.where(blank).withColumns({"name": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    keyed = keyed.where(~blank)
    listed = keyed.select("_key").distinct().withColumn("_alias", F.element_at(pairs, F.col("_key")) if pairs is not None else F.lit(None).cast("string"))
    plain = [re.sub("[^a-z0-9%/]+", "", n.lower()) for n in names]

    @F.pandas_udf("struct<name string, score double>")
    def closest(keys):
        import difflib

        import pandas as pd

        found = []
        for k in keys:
            scores = [difflib.SequenceMatcher(None, k, n).ratio() for n in plain]
            top = max(range(len(names)), key=lambda i: (scores[i], -i))
            found.append((names[top], scores[top]) if k and scores[top] >= least else (None, None))
        return pd.DataFrame(found, columns=["name", "score"])

    closest_of = listed.where("_alias is null").select("_key", closest("_key").alias("m")).select("_key", "m.name", "m.score")
    of_alias = listed.where("_alias is not null").select("_key", F.col("_alias").alias("name"), F.lit(1.0).alias("score"))
    return keyed.join(closest_of.unionByName(of_alias), "_key", "left").unionByName(none).drop("_key")
