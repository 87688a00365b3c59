"""Column helpers: entity ids, token lists, set similarities, number shapes; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import LEET, LEET_LETTERS, STEM_KEEPS, STEM_LENGTH

SOURCE_UNIT = 100_000_000_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def eid(entity_id: Column | str) -> Column:
    """'S2-123' -> 2 * 10^11 + 123."""
    x = _c(entity_id)
    return F.substring(x, 2, 1).cast("long") * SOURCE_UNIT + F.split_part(x, F.lit("-"), F.lit(2)).cast("long")


def src_of(number: Column | str) -> Column:
    return F.floor(_c(number) / F.lit(SOURCE_UNIT)).cast("long")


def tokens(text: Column | str) -> Column:
    """Distinct non-empty tokens; null for null."""
    return F.filter(F.array_distinct(F.split(_c(text), " ")), lambda t: t != "")


def key_tokens(text: Column | str) -> Column:
    """Distinct tokens of two characters or more, or digits only."""
    return F.filter(F.array_distinct(F.split(_c(text), " ")), lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$"))


def tagged(name: str, value: str, items: Column) -> Column:
    """An array of tokens as structs (name: value, tok), for inline()."""
    return F.transform(items, lambda x: F.struct(F.lit(value).alias(name), x.alias("tok")))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of tokens(); null if either side has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def raw_jaccard(a: Column | str, b: Column | str) -> Column:
    """Of plain splits, where a missing text is one empty token, so that two missing texts give 1."""
    x, y = F.split(F.coalesce(_c(a), F.lit("")), " "), F.split(F.coalesce(_c(b), F.lit("")), " ")
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def all_numbers(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit("([0-9]+)"), F.lit(1))


def numbers(text: Column | str) -> Column:
    return F.array_distinct(all_numbers(text))


def first_number(text: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_c(text), F.lit("")), "([0-9]+)", 1)


def compact(text: Column | str) -> Column:
    return F.replace(_c(text), F.lit(" "), F.lit(""))


def compare3(a: Column, b: Column) -> Column:
    """Sets as arrays: -1 if one is empty, 1 if they overlap, else 0."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), -1).when(F.arrays_overlap(a, b), 1).otherwise(0)


def postcode(address: Column | str) -> Column:
    """Last run of five digits, or six in threes, of a normalized address."""
    found = F.regexp_extract_all(_c(address), F.lit(r"(?<![0-9])([0-9]{3}\s?[0-9]{3}|[0-9]{5})(?![0-9])"), F.lit(1))
    return F.when(F.size(found) > 0, compact(F.element_at(found, -1)))


def unleet(token: Column | str) -> Column:
    """Digits typed for letters, in tokens of three letters or more whose digits are all of that kind; as text.unleet()."""
    t = _c(token)
    shape = rf"^(?=[^0-9]*[0-9])(?={'[^a-z]*[a-z]' * LEET_LETTERS})[a-z{''.join(LEET)}&/]+$"
    return F.when(t.rlike(shape), F.translate(t, "".join(LEET), "".join(LEET.values()))).otherwise(t)


def stem(token: Column | str) -> Column:
    """Without a plural's s; as text.stem()."""
    return F.regexp_replace(_c(token), rf"^(.{{{STEM_LENGTH - 2},}}[^{STEM_KEEPS}])s$", "$1")


def plain_numbers(address: Column | str) -> Column:
    """Numbers without leading zeros."""
    return F.regexp_replace(_c(address), r"\b0+(?=[0-9]+\b)", "")


#: The helpers as SQL functions, inlined by Catalyst.
SQL_FUNCTIONS = {
    "eid(x STRING) RETURNS BIGINT": f"bigint(substr(x, 2, 1)) * {SOURCE_UNIT} + bigint(split_part(x, '-', 2))",
    "tl(x STRING) RETURNS ARRAY<STRING>": "filter(array_distinct(split(coalesce(x, ''), ' ')), t -> t <> '')",
    "toks(x STRING) RETURNS ARRAY<STRING>": "filter(array_distinct(split(coalesce(x, ''), ' ')), t -> length(t) >= 2 or t rlike '^[0-9]+$')",
    "nums(x STRING) RETURNS ARRAY<STRING>": "array_distinct(regexp_extract_all(x, '([0-9]+)', 1))",
    "jac(x STRING, y STRING) RETURNS DOUBLE": "case when size(tl(x)) > 0 and size(tl(y)) > 0 then size(array_intersect(tl(x), tl(y))) / size(array_union(tl(x), tl(y))) end",
}


def register_sql(spark: SparkSession) -> None:
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
