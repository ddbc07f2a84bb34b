"""Text operators over documents as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemill.functions.regex import all_matches, found, java, matches, replaced
from lodemill.rules import documents as R


def _flags(letters: str) -> dict[str, bool]:
    return {"ignore_case": "i" in letters, "multiline": "m" in letters, "dot_all": "s" in letters}


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, java(r"\A\s+|\s+\Z"), "")


def clean_markup(text: Column) -> Column:
    """Titles and descriptions of the front matter, and prose without layout markup."""
    matter = F.regexp_extract(text, java(R.FRONT_MATTER, dot_all=True), 1)
    has = text.rlike(java(R.FRONT_MATTER, dot_all=True))
    named = F.array_join(all_matches(matter, R.FRONT_MATTER_TEXT, 1, ignore_case=True, multiline=True), "\n")
    out = F.when(has, F.concat(named, F.lit("\n"), F.regexp_replace(text, java(R.FRONT_MATTER, dot_all=True), ""))).otherwise(text)
    for letters, pattern, by in R.MARKUP:
        out = replaced(out, pattern, by, **_flags(letters))
    return out


def readme_snippet(text: Column, most: int = R.SNIPPET_CHARS) -> Column:
    """Tags, images and markup out, links as their text, one line."""
    out = replaced(text, r"<[^>]+>", " ")
    out = replaced(out, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = replaced(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = replaced(out, r"[#*`_>-]{1,}", " ")
    return F.substring(strip(replaced(out, r"\s+", " ")), 1, most)


def modeling_text(text: Column, most: int = R.TEXT_CHARS, keep_code: bool = False) -> Column:
    """The outline of headings, then the prose, cut to a length; null if nothing is left."""
    whole = strip(text)
    prose = replaced(whole, R.FENCE, "\n", multiline=True, dot_all=True)
    bare = F.regexp_replace(prose, java(R.FRONT_MATTER, dot_all=True), "")
    md, rst = (all_matches(bare, R.HEADING, g, multiline=True) for g in (1, 2))
    heads = F.transform(F.arrays_zip(md.alias("md"), rst.alias("rst")), lambda h: F.trim(F.when(h["md"] != "", h["md"]).otherwise(h["rst"])))
    outline = F.substring(clean_markup(F.array_join(F.array_distinct(heads), "; ")), 1, R.OUTLINE_CHARS)
    body = clean_markup(whole if keep_code else prose)
    joined = strip(replaced(F.concat(strip(outline), F.lit("\n\n"), body), r"\n{3,}", "\n\n"))
    cut = F.substring(joined, 1, most)
    return F.when(cut != "", cut)


def is_english(text: Column) -> Column:
    """Nearly all letters ASCII, counted by whole words, and enough function words; false without letters."""
    words = F.trim(F.regexp_replace(F.lower(text), java(r"[\W\d_]++"), " "))  # the one pass over all characters
    letters = F.length(F.replace(words, F.lit(" "), F.lit("")))
    count = F.when(letters > 0, F.length(words) - letters + 1)
    plain = F.length(F.replace(F.regexp_replace(words, "([a-z]++(?![^ ]))|[^ ]++", "$1"), F.lit(" "), F.lit("")))
    functional = F.regexp_count(F.concat(F.lit(" "), words), F.lit(f" (?:{'|'.join(R.FUNCTION_WORDS)})(?![^ ])"))
    share = (F.try_divide(plain, letters) >= R.ASCII_SHARE) & (F.try_divide(functional, count) >= R.FUNCTION_SHARE)
    return F.coalesce(share, F.lit(False))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_excluded_path(path: Column) -> Column:
    """Vendored code, fixtures, translations, and text files that are no documentation."""
    name = F.lower(base_name(path))
    return found(path, R.EXCLUDED_PATH) | (F.endswith(name, F.lit(".txt")) & ~name.isin(R.TXT_NAMES))


def doc_type(path: Column) -> Column:
    """The first of the ordered rules that the path matches."""
    out = None
    for label, pattern in R.DOC_TYPES:
        test = found(path, pattern)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.when(found(path, R.DOCS_SITE), R.DOCS_SITE_LABEL).otherwise(R.OTHER_LABEL)


def unassigned_reason(content: Column, path: Column, text: Column) -> Column:
    """Why a document is not modelled; null if it is."""
    empty, excluded, other, _ = R.UNASSIGNED
    return (
        F.when(F.coalesce(strip(content), F.lit("")) == "", empty)
        .when(is_excluded_path(path), excluded)
        .when(text.isNull() | ~is_english(text), other)
    )


@F.pandas_udf(T.StringType())
def strip_names(text: pd.Series, repository: pd.Series) -> pd.Series:
    """A repository's own owner and name out of its text; ordinary words stay."""
    patterns: dict[str, re.Pattern | None] = {}

    def pattern(name: str) -> re.Pattern | None:
        if name not in patterns:
            parts = [p for p in name.lower().split("/") if len(p) > 2 and p not in R.GENERIC_WORDS]
            parts.sort(key=len, reverse=True)
            patterns[name] = re.compile(rf"(?i)\b(?:{'|'.join(map(re.escape, parts))})\b") if parts else None
        return patterns[name]

    return pd.Series([None if t is None else p.sub(" ", t) if (p := pattern(r or "")) else t for t, r in zip(text, repository, strict=True)], dtype=object)


def triage(name: Column, description: Column, topics: Column, readme: Column) -> Column:
    """Whether a repository is an agent's: Y, Maybe or N."""
    text = F.concat_ws(" ", name, description)
    full = F.concat_ws(" ", text, readme)
    has = lambda listed: F.arrays_overlap(F.transform(topics, F.lower), F.array(*map(F.lit, listed)))
    strong, near = F.coalesce(has(R.STRONG_TOPICS), F.lit(False)), F.coalesce(has(R.ADJACENT_TOPICS), F.lit(False))
    loose = found(full, R.LOOSE_TERMS) | near
    return (
        F.when(found(text, R.EXCLUDE_TERMS) & ~found(name, R.AGENT_CORE) & ~strong, "N")
        .when(found(full, R.AGENT_CORE) | strong, "Y")
        .when(loose & found(full, R.BEHAVIOR), "Y")
        .when(loose, "Maybe")
        .otherwise("N")
    )


def signals(text: Column, rules: dict[str, list[str]]) -> dict[str, Column]:
    """One flag for each signal, each from one pass over the text."""
    return {name: matches(patterns, text) for name, patterns in rules.items()}


def version_key(repository: Column, path: Column) -> Column:
    """One key for the version snapshots of a page."""
    return F.concat(F.coalesce(repository, F.lit("")), F.lit(":"), replaced(F.concat(F.lit("/"), F.coalesce(path, F.lit(""))), R.VERSION_SEGMENT, ""))


def normal_hash(text: Column) -> Column:
    """Hash of a text in lower case with single spaces."""
    return F.sha2(F.lower(strip(replaced(text, r"\s+", " "))), 256)
