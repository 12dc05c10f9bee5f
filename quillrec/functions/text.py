"""Column helpers for titles, pipe lists, list text, tokens and labels. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NO_GENRES = "(no genres listed)"
EMPTY_GENRES_LABEL = "recipe"
UNTITLED = "Untitled recipe"
NUTRITION_FIELDS = (
    "calories",
    "total_fat_pct",
    "sugar_pct",
    "sodium_pct",
    "protein_pct",
    "saturated_fat_pct",
    "carbohydrates_pct",
)
YEAR_SUFFIX = r"\((\d{4})\)\s*$"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def blank_to_null(col: Column) -> Column:
    """Blank text counts as missing."""
    return F.nullif(F.trim(col), F.lit(""))


def epoch_seconds(col: Column) -> Column:
    """Epoch seconds of a TIMESTAMP_NTZ, whatever the session time zone is."""
    days = F.datediff(col.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)


def title_year(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, YEAR_SUFFIX, 1), F.lit("")).cast("int")


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s*\(\d{4}\)\s*$", ""))


def split_genres(genres: Column) -> Column:
    """Pipe text to array; null, blank and the placeholder give an empty array."""
    missing = genres.isNull() | (genres == "") | (genres == NO_GENRES)
    return F.when(missing, empty_strings()).otherwise(F.split(genres, r"\|"))


def pipe_terms(text: Column) -> Column:
    """Pipe text to lower-cased, trimmed, non-blank terms without the placeholder."""
    parts = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\|"), lambda part: F.trim(part))
    return F.filter(parts, lambda part: (part != "") & (part != NO_GENRES))


def pipe_join(values: Column) -> Column:
    return F.array_join(values, "|")


def literal_list(text: Column) -> Column:
    """Python or JSON list text to array<string>; anything malformed gives an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), empty_strings())


def clean_token(token: Column) -> Column:
    spaced = F.regexp_replace(F.lower(token), r"[|,]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def clean_tokens(values: Column, limit: int) -> Column:
    """First `limit` distinct non-blank tokens, in order of first use."""
    tokens = F.filter(F.transform(values, clean_token), lambda token: token != "")
    return F.slice(F.array_distinct(tokens), 1, limit)


def nutrition_struct(text: Column) -> Column:
    """Seven named doubles from list text; missing or bad entries become 0."""
    values = literal_list(text)
    fields = [
        F.coalesce(F.try_element_at(values, F.lit(i + 1)).try_cast("double"), F.lit(0.0)).alias(name)
        for i, name in enumerate(NUTRITION_FIELDS)
    ]
    return F.struct(*fields)


def list_json(text: Column) -> Column:
    """List text to JSON text of its trimmed, non-blank entries."""
    return F.to_json(F.filter(F.transform(literal_list(text), lambda item: F.trim(item)), lambda item: item != ""))


def nutrition_json(text: Column) -> Column:
    """JSON object of the seven values; a missing or bad entry is kept as null."""
    values = literal_list(text)
    fields = [
        F.try_element_at(values, F.lit(i + 1)).try_cast("double").alias(name) for i, name in enumerate(NUTRITION_FIELDS)
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-")
    stripped = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.coalesce(F.nullif(stripped, F.lit("")), F.lit("recipe"))


def decade_label(year: Column) -> Column:
    """1994 -> '1990s'; '' when the year is missing."""
    start = (F.floor(year / 10) * 10).cast("int").cast("string")
    return F.when(year.isNotNull(), F.concat(start, F.lit("s"))).otherwise(F.lit(""))


def decade_code(decade: Column, year: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(decade, F.lit("")), r"(\d{4})", 1)
    return (
        F.when(digits != "", digits.try_cast("double"))
        .when(year > 0, (F.floor(year / 10) * 10).cast("double"))
        .otherwise(F.lit(-1.0))
    )


def activity_level(count: Column) -> Column:
    """Three bands: under 20, under 80, and above."""
    return F.when(count < 20, "low").when(count < 80, "medium").otherwise("high")


def activity_band(count: Column) -> Column:
    """Five right-closed bands; null outside (0, 10000]."""
    return (
        F.when(count <= 0, F.lit(None).cast("string"))
        .when(count <= 20, "cold")
        .when(count <= 50, "low")
        .when(count <= 100, "medium")
        .when(count <= 500, "high")
        .when(count <= 10000, "power")
    )


def activity_code(level: Column) -> Column:
    name = F.lower(F.trim(level))
    return F.when(name == "low", 0.0).when(name == "medium", 1.0).when(name == "high", 2.0).otherwise(-1.0)


def content_text(*parts: Column) -> Column:
    """One lower-case text of the cleaned, non-blank parts."""

    def clean(part: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(part, r"[|_]", " "), r"\s+", " ")
        return F.nullif(F.lower(F.trim(spaced)), F.lit(""))

    return F.concat_ws(" ", *[clean(part) for part in parts])


def tokens(text: Column) -> Column:
    """Unicode word tokens of two or more characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def unigrams_and_bigrams(words: Column) -> Column:
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda left, right: F.concat_ws(" ", left, right),
    )
    return F.concat(words, pairs)


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens split on pipes, commas, semicolons, slashes and spaces."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[|,;/\s]+")
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def preference_terms(*lists: Column) -> Column:
    """Sorted distinct terms of several string arrays, each entry split on | , ; /."""
    joined = F.concat(*[F.coalesce(values, empty_strings()) for values in lists])
    parts = F.flatten(F.transform(joined, lambda v: F.split(F.lower(F.coalesce(v, F.lit(""))), r"[|,;/]+")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda part: F.trim(part)), lambda part: part != "")))
