"""Text columns: keys that gather or tell apart descriptions, references, patterns, vectors."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The shapes of dates that statements stamp into text.
DATE_SHAPES = r"(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})"
MONTH_YEAR = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s\-]*\d{2,4}\b"


def _squeeze(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def comparison_key(text: Column) -> Column:
    """For "is it the same event": dates go, reference numbers stay."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), DATE_SHAPES, " "), MONTH_YEAR, " ")
    return _squeeze(F.regexp_replace(bare, r"[^a-zA-Z0-9\s]", " "))


def grouping_key(text: Column) -> Column:
    """For "is it the same habit": digits go."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\d+", "")
    return _squeeze(F.regexp_replace(bare, r"[^a-zA-Z\s]", " "))


def reference_numbers(text: Column) -> Column:
    """Distinct runs of four or more digits, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d{4,})"), 1)))


def source_hash(account: Column, raw: Column, repeat: Column) -> Column:
    """SHA-256 over account, raw row and repeat index; null without a raw row."""
    return F.sha2(F.concat(account.cast("string"), F.lit("\u001f"), raw, F.lit("\u001f"), repeat.cast("string")), 256)


def canonical_row(raw: Column) -> Column:
    """A JSON object as its stripped ``key=value`` pairs in order, so that the order in the file makes no difference; null for anything else."""
    entries = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(F.trim(e["key"]).alias("k"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("v")))
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["k"], F.lit("="), e["v"])), "\u001e")


def normalised(text: Column) -> Column:
    """Lower case, blanks squeezed."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")


# What a rule's pattern leaves out of a description, in this order, and its greatest length.
PATTERN_NOISE = (r"\d{2,4}[/-]\d{2}[/-]\d{2,4}", r"\$[\d,.]+", r"#\d+", r"\b\d{4,}\b", r"\b[a-z0-9]*\d{5,}[a-z0-9]*\b")
PATTERN_LENGTH = 60


def extract_pattern(text: Column) -> Column:
    """The stable part of a description: no dates, money, references or long codes, cut at a word."""
    out = normalised(text)
    for noise in PATTERN_NOISE:
        out = F.regexp_replace(out, noise, "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.length(out) > PATTERN_LENGTH, F.regexp_replace(F.substring(out, 1, PATTERN_LENGTH), r" [^ ]*$", "")).otherwise(out)


def words_of(text: Column, least: int = 3) -> Column:
    """Words of so many letters or more, repeats kept."""
    return F.filter(F.split(text, " "), lambda w: F.length(w) >= least)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching blocks over both lengths; few pairs are distinct, so each is compared once a batch."""
    ratio = cache(lambda x, y: SequenceMatcher(None, x, y).ratio())
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_similarity(a: Column, b: Column) -> Column:
    """The greater of the sequence ratios of the lower-case texts and of their comparison keys.  For blocked pairs only."""
    return F.greatest(sequence_ratio(F.lower(_blank(a)), F.lower(_blank(b))), sequence_ratio(comparison_key(a), comparison_key(b)))


def edit_similarity(a: Column, b: Column) -> Column:
    """``text_similarity`` by edit distances, which SQL has as well."""
    return F.greatest(ratio_by_edits(F.lower(_blank(a)), F.lower(_blank(b))), ratio_by_edits(comparison_key(a), comparison_key(b)))


def wording_matches(a: Column, b: Column, ratio=sequence_ratio) -> Column:
    """Whether two comparison keys word one event: references decide, then a cut-off or contained wording, then likeness."""
    ref_a, ref_b = reference_numbers(a), reference_numbers(b)
    apart = (F.size(ref_a) > 0) & (F.size(ref_b) > 0) & (ref_a != ref_b)
    a_first = F.length(a) <= F.length(b)
    short, long = F.when(a_first, a).otherwise(b), F.when(a_first, b).otherwise(a)
    bare = F.replace(short, F.lit(" "), F.lit(""))
    cut = (F.length(short) >= 12) & F.startswith(long, short)
    inside = (F.length(bare) >= 8) & F.contains(F.replace(long, F.lit(" "), F.lit("")), bare)
    return (a != "") & ~apart & (cut | inside | (ratio(a, b) >= 0.85))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine within [0, 1]; 0 if lengths differ or a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def ratio_by_edits(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)
