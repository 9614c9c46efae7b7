"""Rules as rows: the first of many entries of a black list that covers a folder, found by joins on what an entry and a folder share.

An entry without "/" names a segment anywhere in a folder, one with "/" a folder and all below it; "*" and "?" stand for any
characters and for one, in segments and in the folder or any folder above it. Any case. Literal entries meet folders by an
equi-join on the segment or the ancestor. Patterns are keyed by the first ``GRAM`` characters of their longest literal part, which a
folder that they cover must hold somewhere, and tested after the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import names

GRAM = 6


def _pattern(entry: Column) -> Column:
    """The entry as a regular expression for a whole segment or path."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(entry, r"([\\.\[\]{}()+^$|])", r"\\$1"), r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("(?s)^"), body, F.lit("$"))


def keyed(rules: DataFrame) -> DataFrame:
    """rules (place, entry, ...) with kind, key and pattern (null: a literal)."""
    entry = F.lower("entry")
    wild, path = entry.rlike(r"[*?]"), F.contains(entry, F.lit("/"))
    parts = F.split(entry, r"[*?]")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    kind = F.when(wild & path, "pattern of a path").when(wild, "pattern of a name").when(path, "path").otherwise("name")
    key = F.when(wild, F.substring(longest, 1, GRAM)).when(path, F.rtrim(entry, F.lit("/"))).otherwise(entry)
    return rules.where(F.col("entry").isNotNull()).select("*", kind.alias("_kind"), key.alias("_key"), F.when(wild, _pattern(entry)).alias("_pattern"))


def first_rule(rows: DataFrame, folder: str, rules: DataFrame) -> DataFrame:
    """The rows with ``rule``: of the rules (place, entry, any other columns) the one of the least place that covers the folder, null if none.

    Each folder is judged once, however many rows are in it; of a folder's matching rules the least is combined before the
    shuffle. Rows with a null folder and rules with a null entry match nothing; of rules with one place any may be told. Patterns
    without a literal character meet every folder: few can be needed.
    """
    own = keyed(rules)
    lengths = [r[0] for r in own.where("_pattern is not null").select(F.length("_key")).distinct().collect()]  # GRAM + 1 at most
    folders = rows.where(F.col(folder).isNotNull()).select(F.lower(folder).alias("_folder")).distinct()
    segments, chain = F.array_distinct(names.segments(F.col("_folder"))), F.array_append(names.ancestors(F.col("_folder")), F.col("_folder"))
    tag = lambda values, kind: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))

    def grams(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        places = F.when(F.length("_folder") >= n, F.sequence(F.lit(1), F.length("_folder") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.substring(F.col("_folder"), i, F.lit(n))))

    parts = F.flatten(F.array(*[grams(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    keys = F.concat(tag(segments, "name"), tag(chain, "path"), tag(parts, "pattern of a name"), tag(parts, "pattern of a path"))
    asked = folders.select("_folder", F.inline(keys).alias("_kind", "_key"))
    met = asked.join(own, ["_kind", "_key"])
    subjects = F.when(F.col("_kind") == "pattern of a name", segments).otherwise(chain)
    covers = F.col("_pattern").isNull() | F.exists(subjects, lambda s: F.rlike(s, F.col("_pattern")))
    first = met.where(covers).groupBy("_folder").agg(F.min_by(F.struct(*rules.columns), "place").alias("rule"))
    return rows.join(first, F.lower(rows[folder]) == F.col("_folder"), "left").drop("_folder")
