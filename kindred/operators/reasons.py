"""Ordered rules: the first that holds gives the reason."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is true; null if none is. An unknown condition counts as false."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules])


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def reason_examples(rows: DataFrame, reason: str, key: str, k: int = 5) -> DataFrame:
    """Of each reason the first ``k`` keys and how many there are."""
    found = rows.where(F.col(reason).isNotNull())
    first = found.withColumn("place", F.row_number().over(Window.partitionBy(reason).orderBy(key))).where(F.col("place") <= k)
    return first.join(reason_counts(rows, reason), reason).select(reason, "n", "place", key)


def has_any(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) > 0


def has_all(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == mask


def with_flag(flags: Column, mask: int, on: bool = True) -> Column:
    return flags.bitwiseOR(F.lit(mask)) if on else flags.bitwiseAND(F.lit(~mask))


def due(first_seen: Column, since: Column, days: int) -> Column:
    """When an item may be cleaned up: so many days after it was seen and the rule was switched on."""
    return F.greatest(first_seen, since) + F.make_interval(days=F.lit(days))


#: What a user's row condition may hold besides literals and column names.
_WORDS = frozenset("and or not in is null like ilike rlike between true false case when then else end div date timestamp interval distinct from escape".split())
_CALLS = frozenset("abs ceil ceiling floor round lower upper trim ltrim rtrim length contains startswith endswith substring substr concat coalesce ifnull nullif greatest least year month day hour minute second datediff size array_contains exists_in if in isnull isnotnull isnan replace regexp_like split_part bit_count mod pow power sqrt date timestamp and or not when then else case between".split())
_TOKEN = re.compile(r"\s+|'(?:[^'\\]|''|\\.)*'|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+|[A-Za-z_][A-Za-z0-9_]*|`[^`]+`|<=>|<>|<=|>=|==|!=|\|\||[-+*/%<>=!&|^~(),.\[\]]", re.S)


def user_condition(text: str, columns: list[str] | None = None) -> Column:
    """A user's condition on a row, as SQL: column names, literals, operators and a list of functions; else ValueError.

    ``columns`` are the names that may be used; without it any name may, but none may be called that is not listed.
    """
    at, tokens = 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m[0] in ("/", "-") and text[at : at + 2] in ("/*", "--", "->"):
            raise ValueError(f"not a row condition at {at}: {text!r}")
        if not m[0].isspace():
            tokens.append(m[0])
        at = m.end()
    known = None if columns is None else {c.lower() for c in columns}
    for i, token in enumerate(tokens):
        word = token.lower()
        if not (word[0].isalpha() or word[0] in "_`"):
            continue
        called = i + 1 < len(tokens) and tokens[i + 1] == "("
        if called and word not in _CALLS and word not in _WORDS:
            raise ValueError(f"{token!r} may not be called in a row condition")
        if word in ("select", "exists", "table", "values", "with"):
            raise ValueError(f"not a row condition: {text!r}")
        if not called and known is not None and word not in _WORDS and word.strip("`") not in known:
            raise ValueError(f"no such column: {token!r}")
    if not tokens:
        raise ValueError("an empty row condition")
    return F.expr(text)
