"""Fenced code of the vulnerable and the secure side of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodemill.functions.regex import all_matches, found, java
from lodemill.functions.text import strip
from lodemill.rules.security import HEADED, PLAIN_FENCE, SKIPPED_TITLES, TITLE_FENCE


def best_block(blocks: Column, language: Column) -> Column:
    """The longest block; one with the language's file ending counts 10,000 more, one with its name 1,000."""
    ends = F.when(language == "python", ".py").when(language == "javascript", ".js").otherwise(".ts")

    def score(b: Column) -> Column:
        named = F.lower(b["lang"]).isin("js", "ts", "py") | (F.lower(b["lang"]) == language) | (F.lower(b["lang"]) == F.substring(language, 1, 2))
        return F.struct((F.length(b["body"]) + F.when(F.endswith(F.lower(b["title"]), ends), 10000).otherwise(0) + F.when(named, 1000).otherwise(0)).alias("score"), b["body"].alias("body"))

    def skipped(b: Column) -> Column:
        low, test = F.lower(b["title"]), F.contains(F.lower(b["title"]), F.lit("/pom.xml"))
        for s in SKIPPED_TITLES:
            test = test | F.endswith(low, F.lit(s))
        return test

    return strip(F.array_max(F.transform(F.filter(blocks, lambda b: ~skipped(b)), score))["body"])


def _headed(text: Column, word: str, other: str) -> Column:
    """The first fence of the last section whose heading has the word and not only the other."""
    pattern = HEADED % word
    titles, bodies = (all_matches(text, pattern, g, ignore_case=True, dot_all=True) for g in (1, 2))
    both = F.arrays_zip(titles.alias("t"), bodies.alias("b"))
    fence = lambda b: F.regexp_extract(b, java(PLAIN_FENCE, dot_all=True), 2)
    wrong = (lambda s: found(s["t"], "secure") & ~found(s["t"], "vulnerab")) if word == "vulnerable" else (lambda s: found(s["t"], other))
    kept = F.filter(F.transform(F.filter(both, lambda s: ~wrong(s)), lambda s: strip(fence(s["b"]))), lambda c: c != "")
    return F.try_element_at(kept, F.lit(-1))


def fenced_pair(text: Column, language: Column) -> Column:
    """Titled blocks first, then headed sections; null where a side has neither."""
    parts = [all_matches(text, TITLE_FENCE, g, dot_all=True) for g in (1, 2, 3)]
    blocks = F.arrays_zip(parts[0].alias("lang"), parts[1].alias("title"), parts[2].alias("body"))
    bad = F.filter(blocks, lambda b: F.contains(F.lower(b["title"]), F.lit("vulnerab")))
    good = F.filter(blocks, lambda b: ~F.contains(F.lower(b["title"]), F.lit("vulnerab")) & F.contains(F.lower(b["title"]), F.lit("secure")))
    return F.struct(F.coalesce(best_block(bad, language), _headed(text, "vulnerable", "secure")).alias("vulnerable"), F.coalesce(best_block(good, language), _headed(text, "secure", "vulnerab")).alias("secure"))


