"""Categories from learned rules and keywords, one decision for each distinct description."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliver.functions.text import extract_pattern, normalised, words_of


def learn_patterns(corrections: DataFrame) -> DataFrame:
    """(pattern, user_id, category_id, hits): one rule per pattern and user, with the latest category; blank patterns are refused."""
    rows = corrections.withColumn("pattern", extract_pattern(F.col("description"))).filter("pattern <> ''")
    return rows.groupBy("pattern", "user_id").agg(F.max_by("category_id", F.struct("ts", "txn_id")).alias("category_id"), F.count("*").alias("hits"))


def plain_rules(rules: DataFrame) -> DataFrame:
    """Rules with their patterns in lower case and stripped; blank ones go."""
    return rules.withColumn("pattern", F.trim(F.lower("pattern"))).filter("pattern <> ''")


def _grams(text: str, size: int):
    """Distinct parts of ``size`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(size))))


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(norm, pattern): the patterns that stand in a text, by an equi-join on each pattern's rarest part of three characters.

    Shorter patterns meet the parts of their own length.  Parts are counted
    over the texts, so a part that many texts hold is no pattern's key unless
    all parts of the pattern are as frequent.
    """
    patterns = patterns.select("pattern").filter("pattern <> ''").distinct()
    out = None
    for size in (3, 2, 1):
        own = patterns.filter((F.length("pattern") >= 3) if size == 3 else (F.length("pattern") == size))
        held = texts.filter(F.length("norm") >= size).select("norm", F.explode(_grams("norm", size)).alias("gram"))
        often = held.groupBy("gram").agg(F.count("*").alias("c"))
        keys = own.select("pattern", F.explode(_grams("pattern", size)).alias("gram")).join(often, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("k"))
        keys = keys.filter("k.c > 0").select("pattern", F.col("k.gram").alias("gram"))
        found = held.join(keys, "gram").filter(F.contains("norm", "pattern")).select("norm", "pattern")
        out = found if out is None else out.unionByName(found)
    return out


def rule_matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(norm, pattern): rules whose pattern is in a text, or that have two words or more of which three quarters are.

    A rule with enough words in common shares one, which makes the second arm
    an equi-join, too.
    """
    rules = rules.select("pattern").distinct()
    inside = contained(texts, rules)
    tokens = rules.withColumn("words", words_of(F.col("pattern"))).filter(F.size("words") >= 2).select("pattern", F.size("words").alias("n"), F.explode("words").alias("word"))
    held = texts.select("norm", F.explode(F.array_distinct(words_of(F.col("norm")))).alias("word"))
    alike = held.join(tokens, "word").groupBy("norm", "pattern", "n").agg(F.count("*").alias("c")).filter("4 * c >= 3 * n").select("norm", "pattern")
    return inside.union(alike).distinct()


def rule_category(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(norm, category_id) of the matching rule with most hits (ties: pattern, then user)."""
    rules = plain_rules(rules)
    found = rule_matches(texts, rules).join(rules, "pattern")
    return found.groupBy("norm").agg(F.min(F.struct((-F.col("hits")).alias("h"), "pattern", "user_id", "category_id")).alias("r")).select("norm", F.col("r.category_id").alias("category_id"))


def categorise(txns: DataFrame, rules: DataFrame, keywords: DataFrame) -> DataFrame:
    """(txn_id, category_id, tier) of every row: ``rule``, else ``keyword``, else ``none``.

    ``keywords`` has priority, keyword, sign (in, out or any) and category_id;
    rows bound to a sign come first, then by priority.  An amount of 0 comes in;
    a row without amount meets no signed keyword.  Patterns and keywords are
    compared in lower case.
    """
    rows = txns.select("txn_id", normalised(F.col("description")).alias("norm"), F.when(F.col("amount") >= 0, "in").when(F.col("amount") < 0, "out").otherwise("none").alias("way"))
    texts = rows.select("norm", "way").distinct()
    by_rule = rule_category(texts.select("norm").distinct(), rules).withColumnRenamed("category_id", "ruled")
    fits = (F.col("sign") == "any") | (F.col("sign") == F.col("way"))
    keywords = keywords.withColumn("keyword", F.lower("keyword"))
    met = contained(texts.select("norm").distinct(), keywords.select(F.col("keyword").alias("pattern"))).withColumnRenamed("pattern", "keyword")
    words = texts.join(met, "norm").join(keywords, "keyword").filter(fits)
    by_word = words.groupBy("norm", "way").agg(F.min(F.struct((F.col("sign") == "any").alias("any"), "priority", "category_id")).alias("k")).select("norm", "way", F.col("k.category_id").alias("worded"))
    out = rows.join(texts.join(by_rule, "norm", "left").join(by_word, ["norm", "way"], "left"), ["norm", "way"])
    return out.select("txn_id", F.coalesce("ruled", "worded").alias("category_id"), F.when(F.col("ruled").isNotNull(), "rule").when(F.col("worded").isNotNull(), "keyword").otherwise("none").alias("tier"))


def apply_rule_history(txns: DataFrame, rules: DataFrame) -> DataFrame:
    """(txn_id, category_id): rows without a category whose text equals or contains a rule's pattern take that of the rule with most hits."""
    open_rows = txns.filter("category_id is null").select("txn_id", normalised(F.col("description")).alias("norm"))
    texts = open_rows.select("norm").distinct()
    rules = plain_rules(rules)
    found = contained(texts, rules).join(rules, "pattern")
    best = found.groupBy("norm").agg(F.min(F.struct((-F.col("hits")).alias("h"), "pattern", "user_id", "category_id")).alias("r"))
    return open_rows.join(best, "norm").select("txn_id", F.col("r.category_id").alias("category_id"))
