"""Scalar functions as column expressions, with SQL names in ``register``."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemill.functions.regex import all_matches, found, java
from lodemill.functions.text import base_name, doc_type, is_english, strip
from lodemill.rules import security as R


def extract(text: Column, pattern: str, group: int = 1, ignore_case: bool = False) -> Column:
    """A group of the first match; empty if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), java(pattern, ignore_case), group)


def lookup(value: Column, table: dict[str, str]) -> Column:
    """The value's entry in a small fixed table, or null."""
    out = F.lit(None)
    for k, v in reversed(table.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def age_in_days(created: Column, now: Column) -> Column:
    """whole days from an ISO time to now; null if it cannot be read."""
    seconds = F.unix_timestamp(F.to_timestamp(now)) - F.unix_timestamp(F.try_to_timestamp(created))
    return F.floor(seconds / 86400).cast("int")


def norm_cwe(value: Column) -> Column:
    """``CWE-n`` from the first integer, without leading zeros; empty if there is none."""
    n = extract(value, r"(\d+)")
    return F.when(n != "", F.concat(F.lit("CWE-"), n.cast("decimal(38,0)").cast("string"))).otherwise("")


def cwe_in_text(value: Column) -> Column:
    return F.upper(extract(value, r"CWE-\d+", 0, True))


def norm_model_cwe(value: Column) -> Column:
    """``CWE-n`` as written, or ``LLMnn``; empty if there is neither."""
    token = F.upper(extract(value, r"(CWE-\d+|LLM\d+)", 1, True))
    digits = F.regexp_extract(token, r"^LLM(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("LLM"), F.lpad(digits.cast("int").cast("string"), 2, "0"))).otherwise(token)


def norm_lang(value: Column, strict: bool = False) -> Column:
    """language names; others as they are, or null with ``strict``."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    known = lookup(raw, R.LANGUAGES)
    return known if strict else F.coalesce(known, raw)


def lang_from_path(path: Column) -> Column:
    low, out = F.lower(F.coalesce(path, F.lit(""))), F.lit("")
    for language, ends in reversed(R.EXTENSIONS.items()):
        test = F.endswith(low, F.lit(ends[0]))
        for e in ends[1:]:
            test = test | F.endswith(low, F.lit(e))
        out = F.when(test, language).otherwise(out)
    return out


def llm_key(value: Column) -> Column:
    """``LLMnn``; empty if there is none."""
    n = extract(value, r"LLM\s*(\d{1,2})", 1, True)
    return F.when(n != "", F.concat(F.lit("LLM"), F.lpad(n.cast("int").cast("string"), 2, "0"))).otherwise("")


def owasp_2025(value: Column) -> Column:
    """the 2025 category of a 2021 or 2025 one; other values trimmed."""
    raw = F.replace(F.upper(F.trim(F.coalesce(value, F.lit("")))), F.lit(" "), F.lit(""))
    old, new = extract(raw, r"A0?(\d{1,2}):2021"), extract(raw, r"A0?(\d{1,2}):2025")
    key = lambda n: F.concat(F.lit("A"), F.lpad(n.cast("int").cast("string"), 2, "0"))
    return F.when(old != "", F.coalesce(lookup(F.concat(key(old), F.lit(":2021")), R.OWASP_2021_TO_2025), F.lit(""))).when(new != "", F.concat(key(new), F.lit(":2025"))).otherwise(clean(value))


def norm_owasp(value: Column) -> Column:
    """``Ann:year`` of a category, else the value in upper case without spaces."""
    raw = F.replace(F.upper(F.trim(F.coalesce(value, F.lit("")))), F.lit(" "), F.lit(""))
    n, year = extract(raw, r"A0?(\d{1,2}):(202[15])"), extract(raw, r"A0?(\d{1,2}):(202[15])", 2)
    return F.when(n != "", F.concat(F.lit("A"), F.lpad(n.cast("int").cast("string"), 2, "0"), F.lit(":"), year)).otherwise(raw)


def cvss(value: Column, cwe: Column) -> Column:
    """a positive score to one place, else the weakness's usual one, else 7.5."""
    given = F.round(value.try_cast("double"), 1)
    usual = F.coalesce(*[F.when(cwe.isin([k for k, v in R.CWE_CVSS.items() if v == score]), score) for score in sorted(set(R.CWE_CVSS.values()))])
    return F.when((given > 0) & ~F.isnan(given), given).otherwise(F.coalesce(usual, F.lit(R.DEFAULT_CVSS)))


def stable_id(prefix: Column, code: Column) -> Column:
    """the prefix and eight hex digits of the code's MD5."""
    return F.concat(prefix, F.lit("_"), F.upper(F.substring(F.md5(code.cast("binary")), 1, 8)))


def provenance(source: Column, sample: Column, own_parts: tuple[str, ...] = (), rules: list | None = None) -> Column:
    """source, kind and note of a sample, by its source's name or its id.

    ``own_parts`` are names under which a team's own samples go, which have the second rule;
    ``rules`` replaces the table.
    """
    rules = rules or [(p + list(own_parts) if k == 1 else p, i, v) for k, (p, i, v) in enumerate(R.PROVENANCE)]
    source, sample = F.coalesce(source, F.lit("")), F.coalesce(sample, F.lit(""))
    row = lambda a, b, c: F.struct(F.lit(a).alias("source") if isinstance(a, str) else a.alias("source"), F.lit(b).alias("kind"), F.lit(c).alias("note"))
    out = row(F.concat(F.lit("custom_security_benchmark.json ("), F.when(source == "", "Curated").otherwise(source), F.lit(")")), "synthetic_manual", "Curated security benchmark test case")
    for parts, ids, values in reversed(rules):
        test = F.lit(False)
        for p in parts:
            test = test | F.contains(source, F.lit(p))
        for i in ids:
            test = test | (F.startswith(sample, F.lit(i[1:])) if i[0] == "^" else F.contains(sample, F.lit(i)))
        out = F.when(test, row(*values)).otherwise(out)
    return out


def catalogue_id(cwe: Column, llm: Column, sample: Column, cwe_name: Column, by_cwe: Column) -> Column:
    """the catalogue entry: by model weakness, then by id or name for CWE-200, else the weakness's first entry (``by_cwe``)."""
    sample, name = F.coalesce(sample, F.lit("")), F.coalesce(cwe_name, F.lit(""))
    has = lambda t: F.contains(sample, F.lit(t))
    return (
        F.when(has("LLM02") | (llm == "LLM02"), "VULN-LLM-002")
        .when(has("LLM07") | (llm == "LLM07"), "VULN-LLM-007")
        .when(llm == "LLM01", "VULN-LLM-001")
        .when(llm == "LLM05", "VULN-LLM-005")
        .when((cwe == "CWE-200") & (name == "Sensitive Information Disclosure"), "VULN-LLM-002")
        .when((cwe == "CWE-200") & (name == "System Prompt Leakage"), "VULN-LLM-007")
        .when(cwe == "CWE-200", "")
        .otherwise(F.coalesce(by_cwe, F.lit("")))
    )


def llm_weakness(raw: Column, name: Column, owasp: Column) -> Column:
    """weakness, name and category of a model weakness; others keep their own."""
    pick = lambda k: lookup(raw, {i: v[k] for i, v in R.LLM_MAP.items()})
    return F.struct(F.coalesce(pick(0), raw).alias("cwe_id"), F.coalesce(pick(1), name, raw).alias("cwe_name"), F.coalesce(pick(2), owasp, F.lit("OWASP LLM Top 10:2025")).alias("owasp"))


def parse_purl(purl: Column) -> Column:
    """ecosystem, name and version of a package URL; null if it has no known type or no version."""
    pattern = r"^pkg:([^/]+)/(.+)$"
    kind = extract(purl, pattern, 1)
    rest = F.split_part(F.split_part(extract(purl, pattern, 2), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    path = F.regexp_extract(rest, java(r"^(.*)@([^@]*)$", dot_all=True), 1)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    version = plain(F.regexp_extract(rest, java(r"^(.*)@([^@]*)$", dot_all=True), 2))
    parts = F.split(path, "/")
    name = F.when((kind == "maven") & (F.size(parts) >= 2), F.concat(plain(F.get(parts, F.lit(0))), F.lit(":"), plain(F.get(parts, F.lit(1))))).otherwise(plain(path))
    eco = lookup(kind, R.ECOSYSTEMS)
    return F.when(eco.isNotNull() & F.contains(rest, F.lit("@")), F.struct(eco.alias("ecosystem"), name.alias("name"), version.alias("version")))


def source_tag(sources: Column) -> Column:
    """kind and split of the first source."""
    raw = F.coalesce(F.get(sources, F.lit(0)), F.lit(""))
    kind, rest = F.split_part(raw, F.lit(":"), F.lit(1)), F.when(F.contains(raw, F.lit(":")), F.regexp_replace(raw, r"^[^:]*:", "")).otherwise("")
    last = F.substring_index(raw, ":", -1)
    row = lambda a, b: F.struct((F.lit(a) if isinstance(a, str) else a).alias("kind"), (F.lit(b) if isinstance(b, str) else b).alias("split"))
    return F.when(kind == "appsecbench", row("appsec", last)).when(kind == "securecodepairs", row("scp", last)).when(kind == "ghsa", row("ghsa", "eval")).when(kind == "gift", row("gift", "879")).otherwise(row(kind, rest))


def verdict(text: Column) -> Column:
    """VULNERABLE, SAFE or UNKNOWN, and the weakness that is named."""
    cwe = F.upper(extract(text, r"\bCWE-\d+\b", 0, True))
    said = F.upper(extract(text, r"\b(SAFE|VULNERABLE)\b", 1, True))
    label = F.when(said != "", said).when(cwe != "", "VULNERABLE").otherwise("UNKNOWN")
    return F.struct(label.alias("label"), F.when(label == "VULNERABLE", cwe).otherwise("").alias("cwe"))


def json_object(text: Column) -> Column:
    """a JSON object as text: all of a fenced or plain answer, else its widest braces, else an empty one."""
    raw = F.regexp_replace(strip(text), java(r"^```(?:json)?\s*|\s*```$", ignore_case=True, dot_all=True), "")
    brace = F.regexp_extract(raw, java(r"\{.*\}", dot_all=True), 0)
    is_object = lambda c: F.json_object_keys(c).isNotNull()
    return F.when(is_object(raw), raw).when(is_object(brace), brace).otherwise("{}")


def as_flag(value: Column) -> Column:
    """F16."""
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False))


def to_float(value: Column) -> Column:
    """the value as a number, else the first number in it."""
    first = extract(value.cast("string"), r"\d+(?:\.\d+)?", 0)
    return F.coalesce(value.try_cast("double"), F.when(first != "", first.try_cast("double")))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(all_matches(F.lower(F.coalesce(text, F.lit(""))), r"[a-z0-9_]+"), lambda t: F.length(t) > 2))


def token_f1(left: Column, right: Column) -> Column:
    """F1 of the two texts' token sets, to four places; 0 if either is empty."""
    a, b = token_set(left), token_set(right)
    hit = F.size(F.array_intersect(a, b))
    return F.round(F.coalesce(F.try_divide(2.0 * hit, F.size(a) + F.size(b)), F.lit(0.0)), 4)


def normal_code(code: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(code, F.lit(""))), java(r"\s+"), " ")


@F.pandas_udf(T.DoubleType())
def seq_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """matching share of two texts, after white space is collapsed."""
    clean_ = lambda t: re.sub(r"\s+", " ", (t or "").strip())
    return pd.Series([round(difflib.SequenceMatcher(None, clean_(a), clean_(b)).ratio(), 4) for a, b in zip(left, right, strict=True)])


def location_hit(code: Column, said: Column) -> Column:
    """whether the text names an identifier of the code."""
    low = F.lower(F.coalesce(said, F.lit("")))
    names = F.transform(all_matches(code, r"[A-Za-z_]{4,}"), F.lower)
    return F.exists(names, lambda t: ~t.isin("function", "return", "const", "vulnerable", "secure") & F.contains(low, t))


def within(a: Column, b: Column, most: float) -> Column:
    """F21."""
    return F.coalesce(F.abs(a - b) <= most, F.lit(False))


def per_second(count: Column, nanoseconds: Column) -> Column:
    """null for no time."""
    return F.round(F.try_divide(count, nanoseconds / 1e9), 4)


def path_parts(path: Column) -> Column:
    """name, suffix (from the last dot, lower case), parent, root flag and top folder."""
    name = base_name(path)
    suffix = F.lower(F.regexp_extract(name, java(r"^.+(\.[^.]+)$", dot_all=True), 1))
    deep = F.contains(path, F.lit("/"))
    parent = F.when(deep, F.regexp_replace(path, java(r"/[^/]*\Z"), "")).otherwise(".")
    top = F.when(deep, F.split_part(path, F.lit("/"), F.lit(1))).otherwise("(root)")
    return F.struct(name.alias("name"), suffix.alias("suffix"), parent.alias("parent"), (~deep).alias("is_root"), top.alias("top"))


def joined_patterns(patterns: Column, language: Column) -> Column:
    """a language's patterns, TypeScript falling back to JavaScript."""
    own = F.try_element_at(patterns, language)
    fallback = F.when(language == "typescript", F.try_element_at(patterns, F.lit("javascript")))
    chosen = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.coalesce(fallback, F.array().cast("array<string>")))
    return F.array_join(F.filter(chosen, lambda p: p != ""), "; ")


def advisory_status(fix_sha: Column, has_parent: Column, n_sources: Column, n_patched: Column) -> Column:
    """F27."""
    has = F.coalesce(fix_sha, F.lit("")) != ""
    return F.when(has & has_parent & (n_sources > 0), "fixed_with_code").when(has, "fixed_no_code").when(n_patched > 0, "patched_no_commit").otherwise("not_fixed")


def recheck_status(http: Column, found_any: Column) -> Column:
    """F28."""
    said = http.cast("string")
    return F.when((http == 200) & ~found_any, "confirmed_zero").when(http == 200, "found_on_recheck").when(http.isin(403, 404), F.concat(F.lit("denied_or_disabled (HTTP "), said, F.lit(")"))).otherwise(F.concat(F.lit("error (HTTP "), said, F.lit(")")))


def real_absence(status: Column, n_docs: Column, missed: Column, hits: Column) -> Column:
    return (status == "confirmed_zero") & (n_docs > 0) & (F.coalesce(missed, F.lit("")) == "") & (F.coalesce(hits, F.lit("")) == "")


def review_label(code: Column, label: Column, cwe: Column) -> Column:
    """verdict and notes on a labelled snippet."""
    leak, bad = found(code, R.GIVEAWAY), label == "vulnerable"
    notes = F.array_compact(
        F.array(
            F.when(leak, "giveaway token still present"),
            F.when(bad & cwe.isin("CWE-78", "CWE-94") & ~found(code, R.SINKS, False), "sink not obvious for injection CWE"),
            F.when(bad & (cwe == "CWE-798") & ~found(code, R.SECRETS, False), "hardcoded secret not obvious"),
            F.when(bad & (F.length(code) < 20), "snippet too short"),
            F.when(~bad & found(code, R.UNSAFE, False), "safe case still looks unsafe"),
        )
    )
    result = F.when(leak, "fix").when(F.size(notes) > 0, "review").otherwise("keep")
    return F.struct(result.alias("verdict"), F.when(F.size(notes) > 0, F.array_join(notes, "; ")).otherwise("ok").alias("notes"))


def findings(loc: Column, params: Column, cyclomatic: Column, cognitive: Column, nesting: Column) -> Column:
    """what exceeds its thresholds; parameters have only the high one."""

    def over(name: str, value: Column, moderate: str | None, high: str) -> Column:
        low, top = R.THRESHOLDS[name]
        say = lambda limit, word: F.concat(F.lit(f"{name} "), value.cast("string"), F.lit(f" >= {limit}{word}"))
        out = F.when(value >= top, say(top, high))
        return out if moderate is None else out.when(value >= low, say(low, moderate))

    return F.array_compact(
        F.array(
            over("cyclomatic", cyclomatic, " (moderate)", " (high)"),
            over("cognitive", cognitive, " (moderate)", " (high)"),
            over("loc", loc, " (long method)", " (god function)"),
            over("nesting", nesting, "", ""),
            over("params", params, None, ""),
        )
    )


def topic_label(name: Column, words: Column, topic: Column) -> Column:
    """a topic's name, else its first three keywords in title case; and up to ten keywords."""
    kept = F.filter(F.slice(words, 1, 10), lambda w: w != "")
    made = F.array_join(F.transform(F.slice(kept, 1, 3), lambda w: F.initcap(F.replace(w, F.lit("_"), F.lit(" ")))), " | ")
    label = F.coalesce(F.when(name != "", name), F.when(made != "", made), F.concat(F.lit("Topic "), topic.cast("string")))
    return F.struct(F.when(topic == -1, "Unassigned").otherwise(label).alias("name"), F.when(topic == -1, "").otherwise(F.array_join(kept, ", ")).alias("keywords"))


def clean(value: Column) -> Column:
    """F32: trimmed text; what stands for nothing is empty."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(text.isin("", "nan", "None", "null", "NaN"), "").otherwise(text)


def blank_to_null(value: Column) -> Column:
    return F.nullif(clean(value), F.lit(""))


def last_page(link: Column, n_items: Column) -> Column:
    """The total from a Link header's last page, else the items at hand."""
    page = extract(link, r'[?&]page=(\d+)[^>]*>;\s*rel="last"')
    return F.when(page != "", page.cast("int")).otherwise(n_items.cast("int"))


def full_name(url: Column) -> Column:
    """owner/repository of a github.com address; null for others."""
    path = extract(url, r"^https?://(?:www\.)?github\.com/([^/?#]+/[^/?#]+)", 1, True)
    return F.nullif(F.regexp_replace(path, r"\.git$", ""), F.lit(""))


def last_segments(url: Column) -> Column:
    """The last two parts of an address."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"/+$", ""), r"\.git$", ""), "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)))


def name_or_url(name: Column, url: Column) -> Column:
    """The address's name, else a name with a slash."""
    return F.coalesce(full_name(url), F.when(F.contains(name, F.lit("/")), name))


def severity(score: Column, dashboard: bool = False) -> Column:
    """Band of a score; a missing one counts as 7.5. The dashboard's low band takes all the rest."""
    s = F.when(F.coalesce(score, F.lit(0.0)) == 0, 7.5).otherwise(score)
    out = F.when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium")
    return out.otherwise("low") if dashboard else out.when(s >= 0.1, "low").otherwise("unscored")


def code_key(language: Column, code: Column) -> Column:
    """Hash of a language and its code with single spaces."""
    return F.sha1(F.concat(F.coalesce(language, F.lit("")), F.lit("\n"), normal_code(code)).cast("binary"))
