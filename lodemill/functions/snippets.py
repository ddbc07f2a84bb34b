"""numbered snippets of a file around a patch's changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodemill.functions.regex import all_matches
from lodemill.functions.text import strip
from lodemill.rules.security import HUNK, SNIPPET_CHARS, SNIPPET_CONTEXT, TRUNCATED


def snippet(text: Column, patch: Column, side: Column, most: int = SNIPPET_CHARS, context: int = SNIPPET_CONTEXT) -> Column:
    """``snippet`` and ``mode``: the whole file if it is short, else the changed ranges of a side with their context."""
    text = F.coalesce(text, F.lit(""))
    start_of = lambda a, b: F.when(side == "parent", a).otherwise(b)
    groups = [all_matches(patch, HUNK, g, multiline=True) for g in (1, 2, 3, 4)]
    hunks = F.arrays_zip(*[g.alias(f"g{k}") for k, g in enumerate(groups)])
    number = lambda c: F.when(c == "", 1).otherwise(c.cast("int"))
    # Lines end as they do for a text reader: a last line end opens no further line.
    lines = F.split(F.regexp_replace(text, r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")

    def bounds(h: Column, lines: Column) -> Column:
        first = number(start_of(h["g0"], h["g2"]))
        end = first + number(start_of(h["g1"], h["g3"])) + context
        return F.struct(F.greatest(F.lit(1), first - context).alias("a"), F.least(F.size(lines), end).alias("b"))

    def chunk(r: Column, lines: Column) -> Column:
        numbers = F.when(r["b"] >= r["a"], F.sequence(r["a"], r["b"])).otherwise(F.array().cast("array<int>"))
        body = F.array_join(F.transform(numbers, lambda k: F.concat(k.cast("string"), F.lit("| "), F.element_at(lines, k))), "\n")
        return F.concat(F.lit("# lines "), r["a"].cast("string"), F.lit("-"), r["b"].cast("string"), F.lit("\n"), body)

    def joined(lines: Column) -> Column:
        ranges = F.array_distinct(F.transform(hunks, lambda h: bounds(h, lines)))
        return F.array_join(F.transform(ranges, lambda r: chunk(r, lines)), "\n\n")

    # What stands in a lambda is made anew for every element: so the lines become a lambda's own argument, made once for a file.
    once = lambda made, use: F.transform(F.array(made), use)[0]
    cut = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(TRUNCATED))).otherwise(c)
    row = lambda s, m: F.struct(s.alias("snippet"), F.lit(m).alias("mode"))
    no_patch = F.coalesce(patch, F.lit("")) == ""
    return (
        F.when(strip(text) == "", row(F.lit(""), "empty"))
        .when(F.length(text) <= most, row(text, "full_file"))
        .when(no_patch | (F.size(hunks) == 0), row(cut(text), "truncated_file"))
        .otherwise(row(once(once(lines, joined), cut), "hunks"))
    )
