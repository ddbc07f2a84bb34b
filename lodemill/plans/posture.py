"""Security posture: signals, advisories, dependencies, repository listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemill.operators import posture as P
from lodemill.plans.fixtures import dealt, table_of, with_fixture
from lodemill.registry import query, table
from lodemill.rules import documents as D
from lodemill.sources import readers
from lodemill.sources.responses import answered

DOCS = dealt(
    """('a','README.md','We sandbox tools. Rate limits apply: see CVE-2024-12345.'),('a','docs/SECURITY.md','Mail sec@x.org within 5 days to respond. cve-2024-12345 GHSA-abcd-1234-efgh'),
    ('b','readme.rst','nothing here'),('b','CHANGELOG.md','Fixes ghsa-abcd-1234-efgh and GHSA-zzzz-1111-yyyy; audit logging'),('z','README.md','prompt injection')""",
    "repository, path, text", own=("repository",), mix=("text",))
SAMPLE = dealt("('a'),('b'),('c')", "repository", own=("repository",), of=5)


def _any(patterns: list[str]) -> str:
    return "regexp_matches(text, '" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "', 'i')"


_FLAGS = ", ".join(f"coalesce(bool_or({_any(p)}), FALSE) AS \"{k}\"" for k, p in D.GUARDRAILS.items()) + ", " + ", ".join(f"coalesce(bool_or(n = 'SECURITY.MD' AND {_any(p)}), FALSE) AS \"{k}\"" for k, p in D.POLICIES.items())


@query(
    "a07",
    f"""WITH d AS (SELECT *, upper(string_split(path, '/')[-1]) AS n FROM ({DOCS})), g AS (SELECT s.repository, count(path) AS n_docs, coalesce(bool_or(starts_with(n, 'README')), FALSE) AS has_readme, coalesce(bool_or(n = 'SECURITY.MD'), FALSE) AS has_security,
    CAST(coalesce(sum(length(text)) FILTER (n = 'SECURITY.MD') + count(*) FILTER (n = 'SECURITY.MD') - 1, 0) AS BIGINT) AS security_chars, {_FLAGS} FROM ({SAMPLE}) s LEFT JOIN d ON d.repository = s.repository GROUP BY s.repository)
    SELECT *, CAST({' + '.join(f'CAST("{k}" AS INTEGER)' for k in D.GUARDRAILS)} AS INTEGER) AS guardrail_signals FROM g""",
)
def a07(spark, sf_dir):
    """Documentation signals of each repository of a sample."""
    return P.doc_signals(table_of(spark, DOCS, sf_dir), table_of(spark, SAMPLE, sf_dir))


@query(
    "a08",
    with_fixture("d", DOCS, f"SELECT repository, path, CAST(len(x) AS BIGINT) AS mentions, array_to_string(list_sort(list_filter(list_distinct(x), lambda i: starts_with(i, 'CVE'))), ',') AS cves, array_to_string(list_sort(list_filter(list_distinct(x), lambda i: starts_with(i, 'GHSA'))), ',') AS ghsas FROM (SELECT repository, path, list_transform(regexp_extract_all(text, '(?i)(?:{D.CVE}|{D.GHSA})'), lambda i: upper(i)) AS x FROM d)"),
)
def a08(spark, sf_dir):
    """Advisory ids in texts."""
    got = P.advisory_ids(table_of(spark, DOCS, sf_dir), "repository", "path", "text")
    return got.select("repository", "path", "mentions", F.array_join("cves", ",").alias("cves"), F.array_join("ghsas", ",").alias("ghsas"))


SIGNALS = dealt("('a','CVE-1|ghsa-x','GHSA-X',''),('b','','',''),('c','','CVE-2|CVE-2','GHSA-Q')", "repository, docs, releases, api", own=("repository",))


@query(
    "a09",
    with_fixture("s", SIGNALS, "SELECT repository, CAST(len(list_filter(i, lambda x: starts_with(x, 'CVE-'))) AS INTEGER) AS n_cve, CAST(len(list_filter(i, lambda x: starts_with(x, 'GHSA-'))) AS INTEGER) AS n_ghsa, array_to_string(list_filter([CASE WHEN docs <> '' THEN 'docs' END, CASE WHEN releases <> '' THEN 'releases' END, CASE WHEN api <> '' THEN 'api' END], lambda x: x IS NOT NULL), '; ') AS sources, len(i) > 0 AS any_signal FROM (SELECT *, list_distinct(list_filter(string_split(upper(concat(docs, '|', releases, '|', api)), '|'), lambda x: x <> '')) AS i FROM s)"),
)
def a09(spark, sf_dir):
    """Ids over all sources."""
    names = ["docs", "releases", "api"]
    rows = table_of(spark, SIGNALS, sf_dir).select("repository", *[F.filter(F.split(n, r"\|"), lambda x: x != "").alias(n) for n in names])
    return P.signal_union(rows, names).select("repository", "n_cve", "n_ghsa", "sources", "any_signal")


@query(
    "a10",
    """WITH p AS (SELECT o_custkey % 7 AS repository, 'npm' AS ecosystem, CAST(o_custkey % 50 AS VARCHAR) AS name, CAST(o_orderkey % 3 AS VARCHAR) AS version FROM orders),
    v AS (SELECT 'npm' AS ecosystem, CAST(c_custkey % 50 AS VARCHAR) AS name, CAST(c_custkey % 3 AS VARCHAR) AS version, concat('V', lpad(CAST(c_custkey AS VARCHAR), 5, '0')) AS vuln_id FROM customer),
    k AS (SELECT ecosystem, name, version, list_sort(list_distinct(list(vuln_id))) AS ids FROM v GROUP BY ALL),
    j AS (SELECT p.*, k.ids FROM p LEFT JOIN k USING (ecosystem, name, version)),
    w AS (SELECT repository, string_agg(concat(name, '@', version, ' (', array_to_string(ids[1:3], ', '), ')'), '; ' ORDER BY r) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY len(ids) DESC, name, version) AS r FROM (SELECT DISTINCT * FROM j WHERE ids IS NOT NULL)) WHERE r <= 5 GROUP BY repository)
    SELECT j.repository, count(*) AS total, count(ids) AS vulnerable, (SELECT count(DISTINCT x) FROM (SELECT unnest(ids) AS x FROM j AS q WHERE q.repository = j.repository)) AS distinct_ids, coalesce(max(worst), '') AS worst, round(count(ids) / CAST(count(*) AS DOUBLE), 4) AS ratio
    FROM j LEFT JOIN w ON w.repository = j.repository GROUP BY j.repository""",
)
def a10(spark, sf_dir):
    """A10: dependency risk."""
    packages = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("repository"), F.lit("npm").alias("ecosystem"), (F.col("o_custkey") % 50).cast("string").alias("name"), (F.col("o_orderkey") % 3).cast("string").alias("version"))
    vulns = table(spark, sf_dir, "customer").select(F.lit("npm").alias("ecosystem"), (F.col("c_custkey") % 50).cast("string").alias("name"), (F.col("c_custkey") % 3).cast("string").alias("version"), F.concat(F.lit("V"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("vuln_id"))
    return P.dependency_risk(packages, vulns).select("repository", "total", "vulnerable", "distinct_ids", "worst", "ratio")


@query("j07", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def j07(spark, sf_dir):
    """Packages with what is known of them."""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(known, "o_custkey", "left").select("o_orderkey", "c_mktsegment")


NAMES = dealt("('a','CHANGELOG.md|HISTORY-old.txt|x'),('b','security.txt|RELEASES.md'),('c','')", "repository, names", own=("repository",))


@query("p14", with_fixture("n", NAMES, f"SELECT repository, array_to_string(list_filter(string_split(names, '|'), lambda x: regexp_matches(x, '{D.CHANGELOG_NAME}', 'i') AND upper(x) NOT IN ('CHANGELOG.MD','RELEASES.MD')), ', ') AS missed FROM n"))
def p14(spark, sf_dir):
    """Changelogs with other names."""
    rows = table_of(spark, NAMES, sf_dir).withColumn("n", F.split("names", r"\|"))
    return P.missed_changelogs(rows, "n", ["CHANGELOG.MD", "RELEASES.MD"]).select("repository", "missed")


REPOS = dealt("('o/a','2026-01-01'),('o/b','2026-01-02'),('o/c','2026-01-03')", "full_name, updated_at", own=("full_name",))
CACHE = dealt("('o/a','2026-01-01',5),('o/b','2025-01-02',6),('o/c','2026-01-03',NULL)", "full_name, updated_at, contributors_count", own=("full_name",))


@query("s02", f"SELECT r.full_name, c.contributors_count FROM ({REPOS}) r LEFT JOIN ({CACHE}) c ON c.full_name = r.full_name")
def s02(spark, sf_dir):
    """Repositories with their details."""
    return readers.enriched(table_of(spark, REPOS, sf_dir), table_of(spark, CACHE, sf_dir).drop("updated_at")).select("full_name", "contributors_count")


@query("s04", f"SELECT r.full_name, c.contributors_count, c.contributors_count IS NOT NULL AS cached FROM ({REPOS}) r LEFT JOIN (SELECT * FROM ({CACHE}) WHERE contributors_count IS NOT NULL) c ON c.full_name = r.full_name AND c.updated_at = r.updated_at")
def s04(spark, sf_dir):
    """What a cache still knows."""
    return readers.cached_enrichment(table_of(spark, REPOS, sf_dir), table_of(spark, CACHE, sf_dir)).select("full_name", "contributors_count", "cached")


TREES = dealt("('a','README.md','blob'),('a','docs','tree'),('a','docs/security.MD','blob'),('b','x.py','blob'),('b','AGENTS.md','blob'),('b','skill.md','tree')", "full_name, path, type", own=("full_name",))


@query("s05", with_fixture("t", TREES, "SELECT full_name, count(*) FILTER (type = 'blob' AND lower(path) LIKE '%.md') AS n_md, " + ", ".join(f"bool_or(type = 'blob' AND upper(string_split(path,'/')[-1]) = '{n}') AS {c}" for n, c in (("SECURITY.MD", "has_security"), ("CONTRIBUTING.MD", "has_contributing"), ("SKILL.MD", "has_skill"), ("AGENTS.MD", "has_agents"))) + " FROM t GROUP BY full_name"))
def s05(spark, sf_dir):
    """Flags of repository listings."""
    return readers.tree_flags(table_of(spark, TREES, sf_dir))


@query("s15", with_fixture("t", TREES, "SELECT path, CASE WHEN path LIKE '%.py' THEN 'py' END AS kind FROM t WHERE path LIKE '%.py'"))
def s15(spark, sf_dir):
    """Sources of a tree."""
    from lodemill.functions.code import source_files

    return source_files(table_of(spark, TREES, sf_dir)).select("path", "kind")


@query("s18", "SELECT conv_id, unnest(list_sort(list(turn))) AS turn FROM conversations GROUP BY conv_id")
def s18(spark, sf_dir):
    """Pages of a listing flattened."""
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("page"))
    return pages.select("conv_id", F.explode("page").alias("turn"))


@query(
    "s01",
    """WITH p AS (SELECT conv_id, turn + 1 AS page, CASE WHEN length(text) % 7 = 0 THEN [] ELSE [role, text] END AS items FROM conversations),
    e AS (SELECT conv_id, min(page) AS last FROM p WHERE len(items) = 0 OR NOT EXISTS (SELECT 1 FROM p AS q WHERE q.conv_id = p.conv_id AND q.page = p.page + 1) GROUP BY conv_id)
    SELECT p.conv_id, p.page, unnest(range(len(items))) AS place, unnest(items) AS item FROM p JOIN e ON e.conv_id = p.conv_id AND p.page <= e.last WHERE EXISTS (SELECT 1 FROM p AS q WHERE q.conv_id = p.conv_id AND q.page = 1)""",
)
def s01(spark, sf_dir):
    """Results of a paged search, up to its first empty page; the conversation is the keyword."""
    c = table(spark, sf_dir, "conversations")
    items = F.when(F.length("text") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("role", "text"))
    return readers.paged(c.select("conv_id", (F.col("turn") + 1).alias("page"), items.alias("items")), "conv_id", "page", "items")


@query(
    "s19",
    """WITH p AS (SELECT conv_id, turn + 1 AS page, CASE WHEN length(text) % 3 = 0 THEN [role] ELSE [role, text] END AS items FROM conversations WHERE turn + 1 <= 3),
    e AS (SELECT conv_id, min(page) AS last FROM p WHERE len(items) < 2 OR NOT EXISTS (SELECT 1 FROM p AS q WHERE q.conv_id = p.conv_id AND q.page = p.page + 1) GROUP BY conv_id)
    SELECT p.conv_id, p.page, unnest(range(len(items))) AS place, unnest(items) AS item FROM p JOIN e ON e.conv_id = p.conv_id AND p.page <= e.last WHERE EXISTS (SELECT 1 FROM p AS q WHERE q.conv_id = p.conv_id AND q.page = 1)""",
)
def s19(spark, sf_dir):
    """Releases of three pages at most, up to the first short one."""
    c = table(spark, sf_dir, "conversations")
    items = F.when(F.length("text") % 3 == 0, F.array("role")).otherwise(F.array("role", "text"))
    return readers.paged(c.select("conv_id", (F.col("turn") + 1).alias("page"), items.alias("items")), "conv_id", "page", "items", page_size=2, most_pages=3)


@query(
    "s22",
    """SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN concat(CASE WHEN early = 0 THEN 'first ' ELSE 'second ' END, CAST(length(text) AS VARCHAR)) END AS response
    FROM (SELECT *, min(conv_id % 2) OVER (PARTITION BY text) AS early FROM conversations)""",
)
def s22(spark, sf_dir):
    """Prompts of two runs; the second asks a model only for those that the first one's log lacks."""
    place, turns = readers.scratch(spark), table(spark, sf_dir, "conversations")
    said = lambda name: lambda texts: [f"{name} {len(t)}" for t in texts]
    answered(turns.where("conv_id % 2 = 0"), said("first"), place, {"seed": 42}, "text").write.format("noop").mode("overwrite").save()
    return answered(turns, said("second"), place, {"seed": 42}, "text").select("conv_id", "turn", "response")


@query("s20", "SELECT page_id, concat('pkg:npm/p', CAST(page_id AS VARCHAR), '@1') AS purl FROM pages")
def s20(spark, sf_dir):
    """The first package URL of each package."""
    ref = lambda kind, text: F.struct(F.lit(kind).alias("referenceType"), text.alias("referenceLocator"))
    refs = F.array(ref("other", F.lit("x")), ref("purl", F.concat(F.lit("pkg:npm/p"), F.col("page_id").cast("string"), F.lit("@1"))), ref("purl", F.lit("y")))
    boms = table(spark, sf_dir, "pages").select("page_id", F.array(F.struct(F.lit("n").alias("name"), refs.alias("externalRefs"))).alias("packages"))
    return readers.first_purls(boms).select("page_id", "purl")


@query("s21", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'not_found' WHEN c_mktsegment = 'BUILDING' THEN 'error' ELSE 'found' END AS state, CAST((row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 500 AS INTEGER) AS chunk FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey")
def s21(spark, sf_dir):
    """A lookup in chunks with three states."""
    keys = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("v"))
    both = keys.select("o_custkey", "o_orderkey").join(known.withColumn("k", F.lit(1)), "o_custkey", "left").select("o_custkey", "o_orderkey", "v", "k")
    return readers.with_lookup(keys, both.where("k = 1").select("o_custkey", "o_orderkey", "v"), ["o_custkey", "o_orderkey"], "v").select("o_orderkey", "state", "chunk")
