"""Readers and writers: CSV with a byte-order mark, tolerant JSON lines, concatenated JSON, catalogues, file trees."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

MARK = "﻿"


def read_csv(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """All columns text, a byte-order mark dropped; with ``missing_ok`` no file gives no rows."""
    try:
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    except Exception as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "missing string")
        raise
    return rows.toDF(*[c.removeprefix(MARK) for c in rows.columns])


def write_csv(rows: DataFrame, path: str, columns: list[str], mark: bool = False) -> None:
    """The named columns in order, others left out; arrays joined with ``; ``."""
    joined = [F.array_join(c, "; ").alias(c) if rows.schema[c].dataType.typeName() == "array" else F.col(c) for c in columns]
    out = rows.select(*joined)
    if mark:
        out = out.withColumnRenamed(columns[0], MARK + columns[0])
    out.write.mode("overwrite").csv(path, header=True, escape='"', quote='"')


def read_json_lines(spark: SparkSession, path: str, schema: str, mode: str = "skip") -> DataFrame:
    """One object a line, blank lines passed over. Malformed lines are left out (``skip``), kept in ``malformed`` (``keep``) or fail (``strict``)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_json_lines(lines, schema, mode)


def parse_json_lines(lines: DataFrame, schema: str, mode: str = "skip", column: str = "value") -> DataFrame:
    good = F.json_object_keys(column).isNotNull()
    if mode == "strict":
        return lines.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    parsed = lines.select(F.when(good, F.from_json(column, schema)).alias("r"), F.when(~good, F.col(column)).alias("malformed"))
    return parsed.select("r.*", "malformed") if mode == "keep" else parsed.where("malformed is null").select("r.*")


@udtf(returnType="ord int, value string, error string")
class json_objects:
    """The JSON values that stand one after another in a text, whatever the white space between them."""

    def eval(self, text: str):
        decoder, at, text = json.JSONDecoder(), 0, text or ""
        for k in range(len(text) + 1):
            while at < len(text) and text[at].isspace():
                at += 1
            if at >= len(text):
                return
            try:
                value, at = decoder.raw_decode(text, at)
            except ValueError as e:
                yield k, None, str(e)
                return
            yield k, json.dumps(value, ensure_ascii=False), None


def json_line(rows: Column) -> Column:
    """A struct as one line of JSON; line ends beyond the line feed are escaped."""
    out = F.to_json(rows)
    for code in (0x85, 0x2028, 0x2029):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return out


def write_json_document(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """A summary and its records beside each other."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/records")


def read_tree(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """Files under a folder with one of the extensions: relative path and text; no hidden or unsafe paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    relative = F.replace(F.regexp_replace("path", r"^file:/*", "/"), F.lit(path.rstrip("/") + "/"), F.lit(""))
    named = files.select(relative.alias("path"), as_text(F.col("content")).alias("text"))
    return named.where(has_extension(F.col("path"), extensions) & is_safe_path(F.col("path")))


def has_extension(path: Column, extensions: list[str]) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return F.contains(name, F.lit(".")) & F.concat(F.lit("."), F.substring_index(name, ".", -1)).isin([e.lower() for e in extensions])


def is_safe_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return ~F.startswith(path, F.lit("/")) & ~F.exists(parts, lambda p: p.isin("..", ".git", "")) & ~F.contains(path, F.lit("\\"))


def parse_catalogue(text: str) -> list[dict]:
    """Entries of a catalogue in a fixed YAML layout, up to its exclusions; it is one small file."""
    entries: list[dict] = []
    section = None
    for line in text.split("exclusions:")[0].splitlines():
        if m := re.match(r'  - id: "([^"]+)"', line):
            entries.append({"id": m[1]})
            section = None
        elif entries and (m := re.match(r'    (\w+): "([^"]*)"', line)):
            entries[-1][m[1]] = m[2]
        elif entries and (m := re.match(r"    (\w+_patterns):", line)):
            section = entries[-1].setdefault(m[1], {})
        elif section is not None and (m := re.match(r"      (\w+): \[(.*)\]", line)):
            section[m[1]] = re.findall(r'"([^"]*)"', m[2])
    return entries


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: under ``spark.checkpoint.dir``, or a local one where that is unset."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    return f"{top or 'file://' + tempfile.mkdtemp(prefix='lodemill-')}/{uuid.uuid4().hex}"


class Scratch:
    """Tables that cut lineage, in a folder of their own that the driver and all executors see."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{scratch(spark)}-{name}"

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows, written and read again: later work starts from the files."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")  # known: no job looks for it

    def counted(self, rows: DataFrame, name: str, of: Column | None = None) -> tuple[DataFrame, int]:
        """``keep``, and how many rows it has (``of``: for which this is true), counted while they are written."""
        seen = Observation()
        kept = self.keep(rows.observe(seen, F.count_if(F.lit(True) if of is None else of).alias("n")), name)
        return kept, seen.get["n"]


def enriched(repos: DataFrame, details: DataFrame, key: str = "full_name") -> DataFrame:
    """Repositories with their details; null where a lookup has none."""
    return repos.join(details, key, "left")


def cached_enrichment(repos: DataFrame, cache: DataFrame, key: str = "full_name", stamp: str = "updated_at", needed: str = "contributors_count") -> DataFrame:
    """What a cache knows of repositories that have not changed since; ``cached`` tells which."""
    valid = cache.where(F.col(needed).isNotNull())
    return repos.join(valid, [key, stamp], "left").withColumn("cached", F.col(needed).isNotNull())


def tree_flags(trees: DataFrame, repository: str = "full_name") -> DataFrame:
    """Markdown files and guidance flags from listings of (path, type)."""
    name = F.upper(F.substring_index("path", "/", -1))
    blob = F.col("type") == "blob"
    has = lambda n: F.coalesce(F.bool_or(blob & (name == n)), F.lit(False))
    return trees.groupBy(repository).agg(F.count_if(blob & F.endswith(F.lower("path"), F.lit(".md"))).alias("n_md"), has("SECURITY.MD").alias("has_security"), has("CONTRIBUTING.MD").alias("has_contributing"), has("SKILL.MD").alias("has_skill"), has("AGENTS.MD").alias("has_agents"))


def as_text(content: Column) -> Column:
    """Bytes as text; those that are no UTF-8 become replacement characters, one for each longest broken sequence."""
    return F.make_valid_utf8(content.cast("string"))


def decoded(content: Column) -> Column:
    """Text of base64 content, whose line feeds are dropped; null if it is no base64."""
    return as_text(F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64")))


def first_purls(sboms: DataFrame, packages: str = "packages") -> DataFrame:
    """The first package URL among each package's references."""
    ref = F.filter(F.col("p.externalRefs"), lambda r: r["referenceType"] == "purl")
    rest = [c for c in sboms.columns if c != packages]
    return sboms.select(*rest, F.explode(packages).alias("p")).select(*rest, F.col("p.name").alias("package"), F.get(ref, F.lit(0))["referenceLocator"].alias("purl"))


def with_lookup(keys: DataFrame, table: DataFrame, on: list[str], value: str, chunk: int = 500) -> DataFrame:
    """A lookup with three states: found, not_found, or error where the table says so; ``chunk`` numbers the requests."""
    from lodemill.operators.numbering import numbered

    joined = numbered(keys, on, "__at").join(table.withColumn("__known", F.lit(True)), on, "left")
    state = F.when(F.col("__known").isNull(), "not_found").when(F.col(value).isNull(), "error").otherwise("found")
    return joined.withColumns({"state": state, "chunk": F.floor(F.col("__at") / chunk).cast("int")}).drop("__known", "__at", "__total")


def paged(pages: DataFrame, group: str, page: str, items: str, page_size: int | None = None, most_pages: int | None = None) -> DataFrame:
    """Rows of a paged listing, read until a page is empty or short: ``group``, ``page``, ``place`` and ``item``.

    Pages count from 1. A group's pages after its first empty one, after its first one with fewer
    than ``page_size`` items, after a gap and beyond ``most_pages`` were never asked for; they are
    left out.
    """
    n = F.coalesce(F.size(items), F.lit(0))
    short = (n == 0) if page_size is None else (n < page_size)
    kept = pages if most_pages is None else pages.where(F.col(page) <= most_pages)
    # The last page asked for: the first short one, or the one before the first gap; a row for each page that ends a listing.
    nxt = kept.select(F.col(group).alias("__g"), (F.col(page) - 1).alias("__p"), F.lit(True).alias("__next")).distinct()
    ends = kept.join(nxt, (F.col(group) == F.col("__g")) & (F.col(page) == F.col("__p")), "left").where(short | F.col("__next").isNull())
    first = ends.groupBy(F.col(group).alias("__g")).agg(F.min(page).alias("__last"))
    begun = kept.where(F.col(page) == 1).select(F.col(group).alias("__b")).distinct()
    read = kept.join(first, F.col(group) == F.col("__g")).join(begun, F.col(group) == F.col("__b"), "left_semi").where(F.col(page) <= F.col("__last"))
    return read.select(group, page, F.posexplode(items).alias("place", "item"))
