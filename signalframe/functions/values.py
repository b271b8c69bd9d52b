"""Scalar cleaning and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from signalframe.schemas import FEATURE_ALIASES, LEAD_SPELLING


def clean(value: Column) -> Column:
    """A finite double, or NULL for NULL, NaN, infinities and text that is not a number."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def clean_samples(x: Column) -> Column:
    """Missing samples spelt NaN or infinity become NULL, once, at ingest."""
    return F.transform(x, lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v))


def sex_code(value: Column) -> Column:
    """1.0 male, 0.0 female, NULL otherwise."""
    word = F.lower(F.trim(value))
    return F.when(word.isin("male", "m", "1"), 1.0).when(word.isin("female", "f", "0"), 0.0)


def canonical_lead(name: Column) -> Column:
    """Canonical spelling of a lead whatever its case; unknown names stay as they are."""
    table = F.create_map(*[F.lit(part) for pair in LEAD_SPELLING.items() for part in pair])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(name))), F.trim(name))


def first_alias(df: DataFrame, feature: str) -> Column:
    """First non-missing column among the names a feature may have."""
    names = [a for a in FEATURE_ALIASES.get(feature, [feature]) if a in df.columns]
    return F.coalesce(*[clean(F.col(a)) for a in names]) if names else F.lit(None).cast("double")


_OUTSIDE_QUOTES = r"""(?=(?:[^'"]|'[^']*'|"[^"]*")*$)"""


def code_map(text: Column) -> Column:
    """Codes and likelihoods from a Python dictionary literal; an empty map for anything else.

    ``None`` is a missing likelihood, and keys may be numbers or constants; both keep their spelling
    inside quotes.
    """
    plain = text
    for word, spelt in (("None", "null"), ("True", "true"), ("False", "false")):
        plain = F.regexp_replace(plain, rf"\b{word}\b(?=\s*[,}}]){_OUTSIDE_QUOTES}", spelt)
    parsed = F.from_json(
        plain, T.MapType(T.StringType(), T.StringType()), {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    )
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def has_code(codes: Column, wanted: list[str]) -> Column:
    """1 when any key is in the set, whatever its likelihood."""
    return F.coalesce(F.arrays_overlap(F.map_keys(codes), F.array(*[F.lit(c) for c in wanted])), F.lit(False)).cast("int")


def demographic(comments: Column, prefix: str) -> Column:
    """Texts after the first colon of the comments that start with ``prefix``, in order."""
    texts = F.transform(F.coalesce(comments, F.array().cast("array<string>")), lambda t: F.trim(t))
    chosen = F.filter(texts, lambda t: F.startswith(F.lower(t), F.lit(prefix)) & t.contains(":"))
    return F.transform(chosen, lambda t: F.trim(F.get(F.split(t, ":", 2), F.lit(1))))


def comment_age(comments: Column) -> Column:
    """The last age that is a number."""
    ages = F.filter(F.transform(demographic(comments, "age"), lambda t: t.try_cast("double")), lambda v: v.isNotNull())
    return F.get(ages, F.size(ages) - 1)


def comment_sex(comments: Column) -> Column:
    """The last sex, in lower case."""
    sexes = demographic(comments, "sex")
    return F.lower(F.get(sexes, F.size(sexes) - 1))
