"""The vulnerability dataset: unions, keys, splits, snippets and statistics over literal rows and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemill.functions import scalars as S
from lodemill.functions.snippets import snippet
from lodemill.operators import dedupe, stats
from lodemill.plans.fixtures import dealt, table_of, with_fixture
from lodemill.registry import query, table
from lodemill.rules import security as R

SAMPLES = dealt(
    """('s1','python','eval( x )','CWE-94','9.8','gift',1),('s2','python','eval( x )','CWE-94','9.8','ghsa',2),('s3','javascript','a  =  b','CWE-79','6.1','scp',3),
    ('s4','javascript','a = b','CWE-79',NULL,'appsec',4),('s3','javascript','c','CWE-89','3.9','scp',5),('s6','typescript','d','CWE-1321','2.0','gift',6),('s7','python','k','CWE-22','7.5','gift',7),('s8','python','e','CWE-999','0','ghsa',8)""",
    "sample_id, language, code, cwe, score, kind, ord", own=("sample_id",), mix=("code",))
KB = dealt("('s9','python','k'),('s7x','python','z')", "sample_id, language, code", own=("sample_id",), of=8)
_KEY = "sha1(concat(language, chr(10), regexp_replace(trim(code), '\\s+', ' ', 'g')))"


@query("u04", with_fixture("s", SAMPLES, f"SELECT sample_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY CASE kind WHEN 'ghsa' THEN 0 WHEN 'scp' THEN 1 WHEN 'appsec' THEN 2 ELSE 3 END, ord) AS r FROM s) WHERE r = 1"))
def u04(spark, sf_dir):
    """One row for each language and code, by the priority of its source."""
    rank = F.when(F.col("kind") == "ghsa", 0).when(F.col("kind") == "scp", 1).when(F.col("kind") == "appsec", 2).otherwise(3)
    return dedupe.keep_one(table_of(spark, SAMPLES, sf_dir), [S.code_key(F.col("language"), F.col("code"))], [rank, F.col("ord")]).select("sample_id", "ord")


@query("u05", with_fixture("s", SAMPLES, "SELECT code_key, n FROM (SELECT regexp_replace(trim(code), '\\s+', ' ', 'g') AS code_key, count(*) AS n FROM s GROUP BY 1)"))
def u05(spark, sf_dir):
    """Groups of equal code whatever the language."""
    return table_of(spark, SAMPLES, sf_dir).groupBy(S.normal_code(F.col("code")).alias("code_key")).agg(F.count("*").alias("n"))


@query(
    "u07",
    with_fixture("s", SAMPLES, f"""SELECT sample_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY g, ord) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY g, ord) AS i FROM
    (SELECT *, {_KEY} AS k, CASE kind WHEN 'ghsa' THEN 0 ELSE 1 END AS g FROM s) WHERE sample_id NOT IN (SELECT sample_id FROM ({KB})) AND (g = 0 OR k NOT IN (SELECT {_KEY} FROM ({KB})))) WHERE i = 1) WHERE g = 0 OR n = 1"""),
)
def u07(spark, sf_dir):
    """The exam, without what the knowledge base has."""
    return dedupe.exam_split(table_of(spark, SAMPLES, sf_dir), table_of(spark, KB, sf_dir)).select("sample_id", "ord")


@query("u11", "SELECT doc_id, CAST(len(list_distinct(string_split(text, ' '))) AS INTEGER) AS n FROM documents")
def u11(spark, sf_dir):
    """Distinct values of a list, in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.split("text", " "))).alias("n"))


@query("j08", with_fixture("s", SAMPLES, "SELECT ord, coalesce(c.entry, '') AS entry FROM s LEFT JOIN (VALUES ('CWE-94','VULN-1'),('CWE-79','VULN-2')) AS c(cwe, entry) ON c.cwe = s.cwe"))
def j08(spark, sf_dir):
    """Catalogue entries by weakness, with a default."""
    entries = spark.createDataFrame([("CWE-94", "VULN-1"), ("CWE-94", "VULN-9"), ("CWE-79", "VULN-2")], "cwe string, entry string")
    first = entries.groupBy("cwe").agg(F.min("entry").alias("entry"))
    return table_of(spark, SAMPLES, sf_dir).join(F.broadcast(first), "cwe", "left").select("ord", F.coalesce("entry", F.lit("")).alias("entry"))


ADVISORIES = dealt("(1,'CWE-79|CWE-1','fixed_with_code'),(2,'CWE-79','not_fixed'),(3,'CWE-22|CWE-79','fixed_no_code'),(4,'','not_fixed')", "id, cwes, status")


@query("j09", with_fixture("a", ADVISORIES, "SELECT id, array_to_string(list_sort(list_intersect(string_split(cwes, '|'), ['CWE-79','CWE-22'])), ',') AS scoped FROM a"))
def j09(spark, sf_dir):
    """Weaknesses that are in scope."""
    return table_of(spark, ADVISORIES, sf_dir).select("id", F.array_join(F.array_sort(F.array_intersect(F.split("cwes", r"\|"), F.array(F.lit("CWE-79"), F.lit("CWE-22")))), ",").alias("scoped"))


@query("a24", with_fixture("a", ADVISORIES, "SELECT cwe, count(*) AS n, count(*) FILTER (status = 'fixed_with_code') AS fixed_with_code, count(*) FILTER (status = 'fixed_no_code') AS fixed_no_code, count(*) FILTER (status = 'not_fixed') AS not_fixed FROM (SELECT unnest(list_filter(string_split(cwes, '|'), lambda x: x <> '')) AS cwe, status FROM a) GROUP BY cwe"))
def a24(spark, sf_dir):
    """The funnel of each weakness."""
    rows = table_of(spark, ADVISORIES, sf_dir).withColumn("c", F.filter(F.split("cwes", r"\|"), lambda x: x != ""))
    return stats.funnel(rows, "c", "status", ["fixed_with_code", "fixed_no_code", "not_fixed"])


_TOP = "(VALUES " + ", ".join(f"('{c}', {k})" for k, c in enumerate(R.TOP_25, 1)) + ") AS t(cwe, rank)"


@query("a20", with_fixture("s", SAMPLES, f"SELECT cwe, rank, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM s), 2) AS pct, cwe IN ('CWE-94','CWE-79') AS in_catalogue FROM (SELECT cwe, count(*) AS n FROM s GROUP BY cwe) FULL JOIN {_TOP} USING (cwe)"))
def a20(spark, sf_dir):
    """Weaknesses with their share and rank; listed ones without rows stay."""
    return stats.weakness_ranks(table_of(spark, SAMPLES, sf_dir), "cwe", ["CWE-94", "CWE-79"]).select("cwe", "rank", "n", "pct", "in_catalogue")


@query("a21", "SELECT lang, count(*) FILTER (x >= 9) AS critical, count(*) FILTER (x >= 7 AND x < 9) AS high, count(*) FILTER (x >= 4 AND x < 7) AS medium, count(*) FILTER (x >= 0.1 AND x < 4) AS low, count(*) FILTER (x < 0.1) AS unscored FROM (SELECT lang, CASE WHEN n_chars % 11 = 0 THEN 7.5 ELSE n_chars % 11 END AS x FROM documents) GROUP BY lang")
def a21(spark, sf_dir):
    """Severity bands."""
    return stats.severity_counts(table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") % 11).cast("double").alias("score")), "score", "lang")


_BINS = "SELECT CAST(r.range AS INTEGER) AS low, (SELECT count(*) FROM part WHERE least(9, floor(p_retailprice / 200.0)) = r.range AND p_retailprice / 200.0 >= 2 AND p_retailprice / 200.0 < 10.05) AS n FROM range(2, 10) AS r"


@query("a22", f"SELECT low, n, CASE WHEN max(n) OVER () > 0 THEN round(n / max(n) OVER () * 95, 1) ELSE 0 END AS height FROM ({_BINS})")
def a22(spark, sf_dir):
    """A histogram of scores."""
    return stats.score_histogram(table(spark, sf_dir, "part").select((F.col("p_retailprice") / 200.0).alias("s")), "s")


@query("a23", with_fixture("s", SAMPLES, "SELECT cwe, count(*) FILTER (language = 'python') AS python, count(*) FILTER (language = 'javascript') AS javascript, array_to_string(list_sort(list(score) FILTER (score IS NOT NULL)), ',') AS scores FROM s GROUP BY cwe"))
def a23(spark, sf_dir):
    """A pivot by language with the scores."""
    got = stats.by_language(table_of(spark, SAMPLES, sf_dir), "cwe", "language", ["python", "javascript"], "score")
    return got.withColumn("scores", F.array_join("scores", ","))


SOURCES = dealt("(1,'a1',NULL,'CWE-1','m1','appsec'),(2,NULL,'b2','CWE-2',NULL,'scp'),(3,'c3','d3',NULL,'m3','gift')", "id, sample, alt, cwe, meta_cwe, source", mix=("meta_cwe",))


@query("s27", with_fixture("t", SOURCES, "SELECT id, coalesce(sample, alt) AS sample_id, coalesce(cwe, meta_cwe) AS cwe, concat(source, ':', coalesce(sample, alt)) AS original FROM t"))
def s27(spark, sf_dir):
    """A source's own columns as common ones."""
    return table_of(spark, SOURCES, sf_dir).select("id", F.coalesce("sample", "alt").alias("sample_id"), F.coalesce("cwe", "meta_cwe").alias("cwe"), F.format_string("%s:%s", "source", F.coalesce("sample", "alt")).alias("original"))


FILES = dealt("(1,'long','@@ -2,1 +2,2 @@ x','hunks'),(2,'short',NULL,'full_file'),(3,'',NULL,'empty')", "id, body, patch, mode", mix=("patch",))
_RANGE = "SELECT '# lines 1-28' || chr(10) || string_agg(k || '| line ' || k, chr(10) ORDER BY k) FROM range(1, 29) AS r(k)"


@query("f26", with_fixture("f", FILES, f"SELECT id, CASE WHEN body = 'long' THEN ({_RANGE}) ELSE body END AS snippet, mode FROM f"))
def f26(spark, sf_dir):
    """numbered snippets around changes."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(900)), lambda k: F.concat(F.lit("line "), k.cast("string"))), "\n")
    rows = table_of(spark, FILES, sf_dir).withColumn("body", F.when(F.col("body") == "long", lines).otherwise(F.col("body"))).drop("mode")
    return rows.select("id", snippet(F.col("body"), F.col("patch"), F.lit("parent")).alias("s")).select("id", "s.*")


#: Bytes that are no UTF-8 after every third document: a lone byte, and a sequence that breaks off.
_BROKEN = "CASE WHEN doc_id % 3 = 0 THEN concat(chr(65533), 'x', chr(65533)) ELSE '' END"


def _with_broken(text):
    return F.concat(F.encode(text, "UTF-8"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF78E282"))).otherwise(F.unhex(F.lit(""))))


@query("s06", f"SELECT doc_id, concat(text, {_BROKEN}) AS text FROM documents")
def s06(spark, sf_dir):
    """Text of base64 content, of which some is no UTF-8."""
    from lodemill.sources.readers import decoded

    return table(spark, sf_dir, "documents").select("doc_id", decoded(F.base64(_with_broken(F.col("text")))).alias("text"))


@query("s29", f"SELECT doc_id, CAST(length(concat(text, {_BROKEN})) AS INTEGER) AS parent_n, CAST(length(text) + 2 AS INTEGER) AS fix_n FROM documents WHERE text IS NOT NULL")
def s29(spark, sf_dir):
    """Both versions of a file from base64 content, joined into a pair."""
    from lodemill.sources.readers import decoded

    files = table(spark, sf_dir, "documents").select("doc_id", F.base64(_with_broken(F.col("text"))).alias("parent"), F.base64(F.encode(F.concat("text", F.lit("\n#")), "UTF-8")).alias("fix"))
    parent, fix = files.select("doc_id", decoded(F.col("parent")).alias("a")), files.select("doc_id", decoded(F.col("fix")).alias("b"))
    return parent.join(fix, "doc_id").where("a <> b").select("doc_id", F.length("a").alias("parent_n"), F.length("b").alias("fix_n"))


TREE = dealt("(1,'docs/a.MD',TRUE),(2,'b.rst',TRUE),(3,'../c.md',FALSE),(4,'.git/d.md',FALSE),(5,'/e.md',FALSE),(6,'noext',FALSE),(7,'x.py',FALSE)", "id, path, kept")


@query("s14", with_fixture("t", TREE, "SELECT id, path FROM t WHERE kept"))
def s14(spark, sf_dir):
    """Files by extension, without unsafe and hidden paths."""
    from lodemill.sources.readers import has_extension, is_safe_path

    return table_of(spark, TREE, sf_dir).where(has_extension(F.col("path"), [".md", ".rst"]) & is_safe_path(F.col("path"))).select("id", "path")


@query("s17", "SELECT concat('VULN-', CAST(n_nationkey AS VARCHAR)) AS id, concat('CWE-', CAST(n_regionkey AS VARCHAR)) AS cwe_id, CASE WHEN n_nationkey % 2 = 0 THEN concat(lower(n_name), '(; b(') ELSE '' END AS sinks FROM nation WHERE n_nationkey < 20")
def s17(spark, sf_dir):
    """A catalogue's entries up to its exclusions."""
    from lodemill.sources.readers import parse_catalogue

    lines = []
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # one small file
        if r["n_nationkey"] == 20:
            lines.append("exclusions:")
        lines += [f'  - id: "VULN-{r["n_nationkey"]}"', f'    cwe_id: "CWE-{r["n_regionkey"]}"']
        if r["n_nationkey"] % 2 == 0:
            lines += ["    sink_patterns:", f'      python: ["{r["n_name"].lower()}(", "b("]']
    entries = [(e["id"], e["cwe_id"], "; ".join(e.get("sink_patterns", {}).get("python", []))) for e in parse_catalogue("\n".join(lines))]
    return spark.createDataFrame(entries, "id string, cwe_id string, sinks string")


_QUOTED = "replace(replace(replace(CAST(to_json(text) AS VARCHAR), chr(133), '\\u0085'), chr(8232), '\\u2028'), chr(8233), '\\u2029')"


@query("s11", f"SELECT item_id, concat('{{\"item_id\":', CAST(item_id AS VARCHAR), ',\"text\":', {_QUOTED}, '}}') AS line FROM benchmark")
def s11(spark, sf_dir):
    """Rows as JSON lines."""
    from lodemill.sources.readers import json_line

    return table(spark, sf_dir, "benchmark").select("item_id", json_line(F.struct("item_id", "text")).alias("line"))


@query("s09", "SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0")
def s09(spark, sf_dir):
    """JSON lines of which malformed ones are left out."""
    from lodemill.sources.readers import parse_json_lines

    line = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("conv_id", "turn"))).otherwise("{bad")
    return parse_json_lines(table(spark, sf_dir, "conversations").select(line.alias("value")), "conv_id long, turn long")


@query("s10", "SELECT item_id, 0 AS ord, concat('{\"item_id\": ', CAST(item_id AS VARCHAR), '}') AS value FROM benchmark UNION ALL SELECT item_id, 1, concat('{\"text\": ', CAST(to_json(text) AS VARCHAR), '}') FROM benchmark")
def s10(spark, sf_dir):
    """JSON values that stand one after another."""
    from lodemill.sources.readers import json_objects

    joined = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.to_json(F.struct("item_id")), F.lit("\n "), F.to_json(F.struct("text"))).alias("t"))
    return joined.lateralJoin(json_objects(F.col("t").outer())).select("item_id", "ord", "value")


def _written(spark, write, read):
    """What ``read`` finds where ``write`` has put it."""
    from lodemill.sources.readers import scratch

    place = scratch(spark)
    write(place)
    return read(place)


@query("s07", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def s07(spark, sf_dir):
    """A CSV file with a byte-order mark, all columns text, others left out."""
    from lodemill.sources.readers import read_csv, write_csv

    columns = ["s_suppkey", "s_name", "s_nationkey"]
    return _written(spark, lambda p: write_csv(table(spark, sf_dir, "supplier"), p, columns, mark=True), lambda p: read_csv(spark, p))


@query("s08", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, concat(n_name, '; ', n_name) AS names FROM nation")
def s08(spark, sf_dir):
    """Arrays of a CSV file joined in its fixed columns."""
    from lodemill.sources.readers import read_csv, write_csv

    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.array("n_name", "n_name").alias("names"), "n_regionkey")
    return _written(spark, lambda p: write_csv(rows, p, ["n_nationkey", "names"]), lambda p: read_csv(spark, p))


@query("s12", "SELECT 'summary' AS part, CAST(count(*) AS BIGINT) AS n FROM region UNION ALL SELECT 'record', CAST(r_regionkey AS BIGINT) FROM region")
def s12(spark, sf_dir):
    """A summary and its records."""
    from lodemill.sources.readers import write_json_document

    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("n"))
    read = lambda p: spark.read.schema("n long").json(f"{p}/summary").select(F.lit("summary").alias("part"), "n").unionByName(spark.read.schema("n long").json(f"{p}/records").select(F.lit("record").alias("part"), "n"))
    return _written(spark, lambda p: write_json_document(rows.agg(F.count("*").alias("n")), rows, p), read)


@query("s25", "SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 10 <> 0 THEN 1.0 ELSE 2.0 END AS made_by, CAST(length(concat(url, CASE WHEN page_id % 10 = 0 THEN '#' ELSE '' END)) AS DOUBLE) AS v FROM pages WHERE page_id % 7 <> 0")
def s25(spark, sf_dir):
    """Vectors kept by signature, key and content: a second request makes what is new or has changed, and gets what it asked for."""
    from lodemill.sources.readers import scratch
    from lodemill.sources.vectors import embedding_cache

    place, pages = scratch(spark), table(spark, sf_dir, "pages").select("page_id", "url")
    made = lambda n: lambda rows: rows.select("page_id", F.array(F.lit(n), F.length("url").cast("double")).alias("embedding"))
    embedding_cache(pages.where("page_id % 2 = 0"), {"encoder": "length"}, place, made(1.0), "page_id", "url")
    later = pages.where("page_id % 7 <> 0").withColumn("url", F.when(F.col("page_id") % 10 == 0, F.concat("url", F.lit("#"))).otherwise(F.col("url")))
    got = embedding_cache(later, {"encoder": "length"}, place, made(2.0), "page_id", "url")
    return got.select("page_id", F.col("embedding")[0].alias("made_by"), F.col("embedding")[1].alias("v"))


@query("s28", with_fixture("s", SAMPLES, "SELECT * FROM s"))
def s28(spark, sf_dir):
    """Literal tables."""
    return table_of(spark, SAMPLES, sf_dir)
