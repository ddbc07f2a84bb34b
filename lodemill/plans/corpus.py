"""Profiles and duplicates of the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemill.functions.text import normal_hash
from lodemill.operators import dedupe, metrics, stats
from lodemill.plans.fixtures import FILES, files
from lodemill.registry import query, table

NORMAL = "sha256(lower(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '^\\s+|\\s+$', '', 'g')))"


@query(
    "a01",
    f"""WITH f AS ({FILES}), g AS (SELECT sha256(coalesce(text, '')) AS h, count(*) AS n FROM f GROUP BY 1)
    SELECT count(*) AS files, count(DISTINCT repository) AS repositories, count(*) FILTER (NOT contains(path, '/')) AS root_files,
    count(*) FILTER (contains(path, '/')) AS nested_files, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(median(length(text)) AS DOUBLE) AS median_characters,
    count(*) FILTER (coalesce(length(text), 0) = 0) AS empty, (SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM g) AS in_duplicate_groups FROM f""",
)
def a01(spark, sf_dir):
    """Overview of the files."""
    return stats.corpus_overview(files(spark, sf_dir), "repository", "path", "text")


@query("a02", "SELECT source, lang, n_chars, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def a02(spark, sf_dir):
    """Keys that occur more than once."""
    return stats.repeated_keys(table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"])


@query(
    "a03",
    f"""WITH f AS ({FILES}) SELECT lower(string_split(path, '/')[-1]) AS name_key, count(*) AS files, arg_min(string_split(path, '/')[-1], ord) AS spelling,
    count(DISTINCT repository) AS repositories FROM f GROUP BY 1""",
)
def a03(spark, sf_dir):
    """File names without regard to case."""
    return stats.name_counts(files(spark, sf_dir), "path", "repository", "ord")


@query(
    "a04",
    """SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(floor(median(length(text))) AS BIGINT) AS median_chars,
    count(DISTINCT lang) AS n_langs FROM documents GROUP BY source""",
)
def a04(spark, sf_dir):
    """Documents, characters, median length (truncated) and languages of each source."""
    return stats.sizes_by(table(spark, sf_dir, "documents"), "source", "text", "lang")


@query(
    "a05",
    f"""WITH f AS ({FILES}) SELECT regexp_extract(path, '(\\.[^./]+)$', 1) AS suffix, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(root)' END AS top,
    count(*) AS n FROM f GROUP BY ALL""",
)
def a05(spark, sf_dir):
    """Extensions and top folders."""
    from lodemill.functions.scalars import path_parts

    parts = files(spark, sf_dir).select(path_parts(F.col("path")).alias("p"))
    return parts.groupBy(F.col("p.suffix").alias("suffix"), F.col("p.top").alias("top")).agg(F.count("*").alias("n"))


@query(
    "a06",
    """WITH l AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, quantile_cont(n_chars, 0.99) AS hi FROM documents),
    c AS (SELECT CAST(CASE WHEN hi > lo THEN least(39, floor((least(n_chars, hi) - lo) / (hi - lo) * 40)) ELSE 0 END AS INTEGER) AS bin FROM documents, l)
    SELECT CAST(r.range AS INTEGER) AS bin, (SELECT count(*) FROM c WHERE c.bin = r.range) AS n FROM range(40) AS r""",
)
def a06(spark, sf_dir):
    """Sizes in equal bins up to the 99th percentile."""
    return stats.size_histogram(table(spark, sf_dir, "documents"), F.col("n_chars"))


@query("a11", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY event_type")
def a11(spark, sf_dir):
    """Shares of categories."""
    return metrics.category_shares(table(spark, sf_dir, "events"), "event_type")


@query(
    "a19",
    """SELECT 'all' AS slice, 'all' AS value, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
    UNION ALL SELECT 'lang', lang, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY lang
    UNION ALL SELECT 'source', source, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY source""",
)
def a19(spark, sf_dir):
    """Coverage by several slices in one pass."""
    return stats.sliced(table(spark, sf_dir, "documents"), ["lang", "source"], F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "a26",
    f"""WITH g AS (SELECT {NORMAL} AS h, count(*) AS n FROM documents GROUP BY 1)
    SELECT count(*) AS uniques, CAST(sum(n - 1) AS BIGINT) AS extras, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS grouped FROM g""",
)
def a26(spark, sf_dir):
    """Duplicates of normalised texts."""
    return dedupe.duplicate_counts(table(spark, sf_dir, "documents"), normal_hash(F.coalesce("text", F.lit(""))))


@query("f24", "SELECT doc_id, sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS n FROM documents")
def f24(spark, sf_dir):
    """content hash and length."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("n"))


@query(
    "u03",
    """SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY md5(concat(lang, trim(text))) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""",
)
def u03(spark, sf_dir):
    """The first row of each language and text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.concat("lang", F.trim("text")).cast("binary")).alias("h"))
    return dedupe.keep_one(docs, ["h"], [F.col("doc_id")]).select("doc_id", "lang")


@query(
    "u06",
    f"""WITH f AS (SELECT *, concat(repository, ':', regexp_replace(concat('/', path), '/v?\\d+(\\.\\d+)+/', '/', 'g')) AS v FROM ({FILES}) WHERE text IS NOT NULL),
    g AS (SELECT v, min(ord) AS first, arg_min(ord, length(path) * 100000000 + ord) AS o, arg_min({NORMAL}, length(path) * 100000000 + ord) AS h FROM f GROUP BY v),
    w AS (SELECT v, first_value(o) OVER (PARTITION BY h ORDER BY first) AS canonical FROM g)
    SELECT ord, canonical FROM f JOIN w USING (v)""",
)
def u06(spark, sf_dir):
    """Which text stands for each file."""
    return dedupe.canonical_texts(files(spark, sf_dir)).select("ord", "canonical")


@query("u09", "SELECT count(*) AS overlap FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)")
def u09(spark, sf_dir):
    """Texts that both tables have."""
    both = table(spark, sf_dir, "documents").select("text").intersect(table(spark, sf_dir, "benchmark").select("text"))
    return both.agg(F.count("*").alias("overlap"))


@query("j05", "SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j05(spark, sf_dir):
    """Documents that have a label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left_semi").select("doc_id", "lang")


@query("j06", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j06(spark, sf_dir):
    """Documents that have none."""
    return dedupe.only_new(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("s13", "SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n FROM conversations")
def s13(spark, sf_dir):
    """A Parquet table."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("s16", "SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events k WHERE k.event_id = e.event_id AND k.event_type = 'view')")
def s16(spark, sf_dir):
    """Records whose keys are not known yet."""
    events = table(spark, sf_dir, "events")
    return dedupe.only_new(events, events.where("event_type = 'view'"), ["event_id"]).select("event_id")


@query("p18", "SELECT DISTINCT l_linenumber AS n, l_linenumber BETWEEN 2 AND 5 AS ok FROM lineitem")
def p18(spark, sf_dir):
    """Arguments outside their range are refused."""
    from lodemill.operators.checks import require

    def ok(n: int) -> bool:
        try:
            require("n", n, 2, 5)
            return True
        except ValueError:
            return False

    lines = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    return spark.createDataFrame([(r[0], ok(r[0])) for r in lines.collect()], "n int, ok boolean")  # seven arguments
