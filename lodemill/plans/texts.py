"""Text operators, predicates and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemill.functions import text as X
from lodemill.functions.regex import found
from lodemill.plans.fixtures import dealt, table_of, with_fixture
from lodemill.registry import query, table
from lodemill.rules import documents as D
from lodemill.rules import security as R


@query("p01", "SELECT doc_id FROM documents WHERE CAST(contains(lower(concat(lang, ' ', source, ' ', text)), 'the') AS INTEGER) + CAST(contains(lower(concat(lang, ' ', source, ' ', text)), 'que') AS INTEGER) + CAST(contains(lower(concat(lang, ' ', source, ' ', text)), 'und') AS INTEGER) >= 2")
def p01(spark, sf_dir):
    """Rows with k of the terms."""
    text = F.lower(F.concat_ws(" ", "lang", "source", "text"))
    hits = F.size(F.filter(F.array(*map(F.lit, ["the", "que", "und"])), lambda t: F.contains(text, t)))
    return table(spark, sf_dir, "documents").where(hits >= 2).select("doc_id")


GUIDES = dealt("(1,'True',' true '),(2,'TRUE','false'),(3,NULL,'true')", "id, has_a, has_b")


@query("p02", with_fixture("t", GUIDES, "SELECT id FROM t WHERE lower(trim(has_a)) = 'true' AND lower(trim(has_b)) = 'true'"))
def p02(spark, sf_dir):
    """All flags set."""
    test = F.lit(True)
    for c in ("has_a", "has_b"):
        test = test & (F.lower(F.trim(c)) == "true")
    return table_of(spark, GUIDES, sf_dir).where(test).select("id")


PATHS = dealt("(1,'third_party/json/README.md'),(2,'src/__fixtures__/a.md'),(3,'translations/pcm/README.md'),(4,'i18n/zh-CN/docs/a.md'),(5,'CMakeLists.txt'),(6,'translations/en/README.md'),(7,'locales/en-US/a.md'),(8,'docs/llms.txt'),(9,'docs/i18n.md'),(10,'docs/CONTRIBUTING.md'),(11,'docs/tools/overview.mdx'),(12,'plugins/x/agents.md'),(13,'docs/adr/ADR-1.md'),(14,'engineering/sre.md'),(15,'docs/security.mdx')", "id, path")


@query("p04", with_fixture("t", PATHS, r"SELECT id, regexp_matches(path, '(?i)(?:^|/)(?:third[_-]party|vendor|node_modules|\.omo/evidence|__fixtures__|fixtures|test-fixtures|__snapshots__|snapshots|testdata)/') OR (regexp_matches(path, '(?i)(?:^|/)(?:translations|i18n|locales?|l10n)/[^/]+/') AND NOT regexp_matches(path, '(?i)(?:^|/)(?:translations|i18n|locales?|l10n)/en(?:[-_][a-z]+)?/')) OR (lower(path) LIKE '%.txt' AND lower(string_split(path,'/')[-1]) NOT IN ('readme.txt','llms.txt','llms-full.txt')) AS excluded FROM t"))
def p04(spark, sf_dir):
    """Paths that are no documentation."""
    return table_of(spark, PATHS, sf_dir).select("id", X.is_excluded_path(F.col("path")).alias("excluded"))


WORDS = "regexp_extract_all(lower(text), '\\pL+')"


@query("p05", "SELECT doc_id, coalesce(a >= 0.95 AND f >= 0.02, FALSE) AS english FROM (SELECT doc_id, list_sum(list_transform(list_filter(w, lambda x: strlen(x) = length(x)), lambda x: length(x))) / list_sum(list_transform(w, lambda x: length(x))) AS a, len(list_filter(w, lambda x: list_contains([" + ",".join(f"'{w}'" for w in D.FUNCTION_WORDS) + f"], x))) / len(w) AS f FROM (SELECT doc_id, {WORDS} AS w FROM documents))")
def p05(spark, sf_dir):
    """The English gate."""
    return table(spark, sf_dir, "documents").select("doc_id", X.is_english(F.col("text")).alias("english"))


LABELLED = dealt("(1,'Cursor|x'),(2,'cursors'),(3,'BOT'),(4,''),(5,NULL)", "id, labels")


@query("p06", with_fixture("t", LABELLED, "SELECT id, coalesce(list_has_any(list_transform(string_split(labels,'|'), lambda x: lower(x)), ['cursor','bot']), FALSE) AS hit FROM t"))
def p06(spark, sf_dir):
    """Labels without regard to case, whole."""
    lowered = F.transform(F.split("labels", r"\|"), F.lower)
    return table_of(spark, LABELLED, sf_dir).select("id", F.coalesce(F.arrays_overlap(lowered, F.array(F.lit("cursor"), F.lit("bot"))), F.lit(False)).alias("hit"))


@query("p07", f"WITH f AS (SELECT ord, path, text, {WORDS} AS w FROM (SELECT doc_id AS ord, CASE WHEN doc_id % 7 = 0 THEN 'vendor/a.md' ELSE 'docs/a.md' END AS path, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS text FROM documents)) SELECT ord, CASE WHEN trim(text) = '' THEN 'Not modeled: empty file' WHEN starts_with(path, 'vendor/') THEN 'Not modeled: excluded path or file type' WHEN NOT coalesce(list_sum(list_transform(list_filter(w, lambda x: strlen(x) = length(x)), lambda x: length(x))) / list_sum(list_transform(w, lambda x: length(x))) >= 0.95 AND len(list_filter(w, lambda x: list_contains([" + ",".join(f"'{w}'" for w in D.FUNCTION_WORDS) + "], x))) / len(w) >= 0.02, FALSE) THEN 'Not modeled: non-English or no prose' END AS reason FROM f")
def p07(spark, sf_dir):
    """Why a document is not modelled."""
    n = F.col("doc_id")
    held = table(spark, sf_dir, "documents").select(n.alias("ord"), F.when(n % 7 == 0, "vendor/a.md").otherwise("docs/a.md").alias("path"), F.when(n % 11 == 0, " ").otherwise(F.col("text")).alias("text"))
    return held.select("ord", X.unassigned_reason(F.col("text"), F.col("path"), F.col("text")).alias("reason"))


CHANGES = dealt("(1,'fixed_with_code','src/a.py','CWE-1','x'),(2,'fixed_with_code','tests/a.py|b.ts','CWE-2','x'),(3,'fixed_with_code','a.py|b.py','CWE-3','x'),(4,'not_fixed','a.py','CWE-4','x'),(5,'fixed_with_code','c.md|d.go|e.js','CWE-5|CWE-6','x'),(6,'fixed_with_code','x.spec.ts|y.jsx','CWE-7',NULL)", "id, status, files, cwes, sha")
_SOURCES = "list_filter(string_split(files,'|'), lambda f: regexp_matches(lower(f), '\\.(py|js|mjs|cjs|jsx|ts|tsx)$') AND NOT regexp_matches(f, '" + R.TEST_FILE + "'))"


def _source_files(files):
    kept = lambda f: F.lower(F.substring_index(f, ".", -1)).isin(R.SOURCE_EXTENSIONS) & F.contains(f, F.lit(".")) & ~found(f, R.TEST_FILE, False)
    return F.filter(files, kept)


@query("p08", with_fixture("t", CHANGES, f"SELECT id FROM t WHERE status = 'fixed_with_code' AND len({_SOURCES}) = 1 AND NOT contains(cwes, '|') AND sha IS NOT NULL"))
def p08(spark, sf_dir):
    """Candidates: one source file, one weakness, a commit."""
    return table_of(spark, CHANGES, sf_dir).where((F.col("status") == "fixed_with_code") & (F.size(_source_files(F.split("files", r"\|"))) == 1) & (F.size(F.split("cwes", r"\|")) == 1) & F.col("sha").isNotNull()).select("id")


@query("p09", with_fixture("t", CHANGES, f"SELECT id, array_to_string({_SOURCES}, '|') AS sources FROM t"))
def p09(spark, sf_dir):
    """Source files that are no tests."""
    return table_of(spark, CHANGES, sf_dir).select("id", F.array_join(_source_files(F.split("files", r"\|")), "|").alias("sources"))


@query("p10", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 15 AND lang IN ('en','de')")
def p10(spark, sf_dir):
    """P10: length and language gates."""
    return table(spark, sf_dir, "documents").where((F.length(F.trim("text")) >= 15) & F.col("lang").isin("en", "de")).select("doc_id")


PAIRS = dealt("(1,'python','CWE-1','a','b'),(2,'','CWE-1','a','b'),(3,'python','nan','a','b'),(4,'python','CWE-2',' a ','a'),(5,'js','CWE-2','a',NULL)", "id, lang, cwe, bad, good", mix=("good",))


@query("p11", with_fixture("t", PAIRS, "SELECT id FROM t WHERE " + " AND ".join(f"trim(coalesce({c},'')) NOT IN ('','nan','None','null','NaN')" for c in ("lang", "cwe", "bad", "good"))))
def p11(spark, sf_dir):
    """Rows with all that they need."""
    from lodemill.functions.scalars import clean

    test = F.lit(True)
    for c in ("lang", "cwe", "bad", "good"):
        test = test & (clean(F.col(c)) != "")
    return table_of(spark, PAIRS, sf_dir).where(test).select("id")


@query("p12", with_fixture("t", PAIRS, "SELECT id FROM t WHERE trim(coalesce(bad,'')) <> '' AND trim(coalesce(good,'')) <> '' AND trim(bad) <> trim(good)"))
def p12(spark, sf_dir):
    """Pairs that differ."""
    bad, good = F.trim(F.coalesce("bad", F.lit(""))), F.trim(F.coalesce("good", F.lit("")))
    return table_of(spark, PAIRS, sf_dir).where((bad != "") & (good != "") & (bad != good)).select("id")


NAMES = dealt("(1,'a/SECURITY.md'),(2,'Readme.rst'),(3,'x/releases.md'),(4,'docs/History.txt'),(5,'security.MD'),(6,'b.md')", "id, path")


@query("p13", with_fixture("t", NAMES, f"SELECT id, upper(n) = 'SECURITY.MD' AS policy, starts_with(upper(n), 'README') AS readme, regexp_matches(n, '{D.CHANGELOG_NAME}', 'i') AS changelog FROM (SELECT id, string_split(path,'/')[-1] AS n FROM t)"))
def p13(spark, sf_dir):
    """Documents by name."""
    name = X.base_name(F.col("path"))
    return table_of(spark, NAMES, sf_dir).select("id", (F.upper(name) == "SECURITY.MD").alias("policy"), F.startswith(F.upper(name), F.lit("README")).alias("readme"), found(name, D.CHANGELOG_NAME).alias("changelog"))


@query("p15", with_fixture("t", PAIRS, "SELECT id FROM t WHERE lang = 'python' AND length(bad) <= 2 AND cwe <> 'nan'"))
def p15(spark, sf_dir):
    """The pool of examples."""
    return table_of(spark, PAIRS, sf_dir).where((F.col("lang") == "python") & (F.length("bad") <= 2) & (F.col("cwe") != "nan")).select("id")


@query("p16", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_type), 're') OR contains(lower(p_brand), 're')")
def p16(spark, sf_dir):
    """A search over several columns."""
    test = F.lit(False)
    for c in ("p_name", "p_type", "p_brand"):
        test = test | F.contains(F.lower(c), F.lit("re"))
    return table(spark, sf_dir, "part").where(test).select("p_partkey")


@query("p17", "SELECT doc_id, replace(left(text, 300), chr(10), '⏎') AS preview, split_part(text, chr(10), 1) AS title, left(sha256(text), 7) AS short FROM documents")
def p17(spark, sf_dir):
    """Previews and excerpts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.substring("text", 1, 300), F.lit("\n"), F.lit("⏎")).alias("preview"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.substring(F.sha2("text", 256), 1, 7).alias("short"))


@query("t01")
def t01(spark, sf_dir):
    """Markup cleaned from pages."""
    return table(spark, sf_dir, "pages").select("page_id", X.clean_markup(F.col("html")).alias("text"))


_SPACE = "regexp_replace({}, '\\s+', ' ', 'g')"


@query("t02", "SELECT page_id, left(trim(" + _SPACE.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[#*`_>-]{1,}', ' ', 'g')") + "), 400) AS snippet FROM pages")
def t02(spark, sf_dir):
    """Snippets of pages."""
    return table(spark, sf_dir, "pages").select("page_id", X.readme_snippet(F.col("html")).alias("snippet"))


@query("t03")
def t03(spark, sf_dir):
    """Outline and prose."""
    return table(spark, sf_dir, "documents").select("doc_id", X.modeling_text(F.concat(F.lit("## "), "text")).alias("text"))


#: A whole word by its neighbours, twice, as two in a row share one of them.
_OWN = r"'(^|[^\p{L}\p{N}_])(?:' || CASE lang WHEN 'en' THEN 'the|and' WHEN 'de' THEN 'der|und' ELSE 'que|les' END || ')([^\p{L}\p{N}_]|$)', '\1 \2', 'gi'"


@query("t04", f"SELECT doc_id, regexp_replace(regexp_replace(text, {_OWN}), {_OWN}) AS text FROM documents")
def t04(spark, sf_dir):
    """A repository's own names out of its texts, each row's own."""
    own = F.when(F.col("lang") == "en", "the/and").when(F.col("lang") == "de", "der/und").otherwise("que/les")
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_names(F.col("text"), own).alias("text"))


def _type_sql() -> str:
    """The rules in order; a look-ahead is written as a second test."""
    out = "CASE"
    for label, pattern in D.DOC_TYPES:
        if "(?!" in pattern:
            head = pattern.split("(?!")[0]
            test = f"regexp_matches(path, '{head}[^/]+/', 'i') AND NOT regexp_matches(path, '{head}en([-_][a-z]+)?/', 'i')"
        else:
            test = f"regexp_matches(path, '{pattern}', 'i')"
        out += f" WHEN {test} THEN '{label}'"
    return out + f" WHEN regexp_matches(path, '{D.DOCS_SITE}', 'i') THEN '{D.DOCS_SITE_LABEL}' ELSE '{D.OTHER_LABEL}' END"


@query("t05", with_fixture("t", PATHS, f"SELECT id, {_type_sql()} AS doc_type FROM t"))
def t05(spark, sf_dir):
    """Document types."""
    return table_of(spark, PATHS, sf_dir).select("id", X.doc_type(F.col("path")).alias("doc_type"))


TRIAGE = dealt("(1,'my-agent','does things','x',''),(2,'awesome list','of agents','',''),(3,'helper','an assistant','chatbot','it runs tasks'),(4,'helper','an assistant','',''),(5,'lib','plain code','',''),(6,'course','notes','ai-agents','')", "id, name, description, topics, readme", mix=("description", "readme"))


_TRIAGED = f"""SELECT id, CASE WHEN regexp_matches(tx, '{D.EXCLUDE_TERMS}', 'i') AND NOT regexp_matches(name, '{D.AGENT_CORE}', 'i') AND NOT strong THEN 'N' WHEN regexp_matches(fu, '{D.AGENT_CORE}', 'i') OR strong THEN 'Y'
  WHEN (regexp_matches(fu, '{D.LOOSE_TERMS}', 'i') OR near) AND regexp_matches(fu, '{D.BEHAVIOR}', 'i') THEN 'Y' WHEN regexp_matches(fu, '{D.LOOSE_TERMS}', 'i') OR near THEN 'Maybe' ELSE 'N' END AS class
  FROM (SELECT *, concat(name, ' ', description) AS tx, concat(name, ' ', description, ' ', readme) AS fu, list_has_any(string_split(lower(topics), '|'), {D.STRONG_TOPICS}) AS strong, list_has_any(string_split(lower(topics), '|'), {D.ADJACENT_TOPICS}) AS near FROM t)"""


@query("t06", with_fixture("t", TRIAGE, _TRIAGED))
def t06(spark, sf_dir):
    """Triage of repositories."""
    c = F.col
    return table_of(spark, TRIAGE, sf_dir).select("id", X.triage(c("name"), c("description"), F.split("topics", r"\|"), c("readme")).alias("class"))


@query("a28", with_fixture("t", TRIAGE, f"SELECT k AS class, count(id) AS n FROM (VALUES ('Y'), ('Maybe'), ('N')) AS v(k) LEFT JOIN ({_TRIAGED}) ON class = k GROUP BY k"))
def a28(spark, sf_dir):
    """Rows of each class of a fixed list."""
    c = F.col
    held = table_of(spark, TRIAGE, sf_dir).select(X.triage(c("name"), c("description"), F.split("topics", r"\|"), c("readme")).alias("class"))
    return spark.createDataFrame([("Y",), ("Maybe",), ("N",)], "class string").join(held.groupBy("class").agg(F.count("*").alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


COMMENTED = dealt("(1,'python','x = 1','  # SECURE note'),(2,'javascript','var u = \"http://a\";',' // gone'),(3,'python','s = \"# kept\"','  #')", "id, lang, code, note", mix=("note",))


@query("t07", with_fixture("t", COMMENTED, "SELECT id, code FROM t"))
def t07(spark, sf_dir):
    """Code without comments."""
    from lodemill.functions.comments import strip_comments

    return table_of(spark, COMMENTED, sf_dir).select("id", strip_comments(F.concat("code", "note"), F.col("lang")).alias("code"))


FENCED = dealt("(1,'bad','ok'),(2,'x','y'),(3,NULL,NULL)", "id, bad, good", mix=("bad",))


@query("t08", with_fixture("t", FENCED, "SELECT id, trim(bad) AS vulnerable, good AS secure FROM t"))
def t08(spark, sf_dir):
    """The best fenced block of each side, titled or under a heading."""
    from lodemill.functions.fences import fenced_pair

    titled = F.format_string('```js title="vulnerable.js"\n%s\n```\n```py title="secure.py"\n%s\n```', "bad", "good")
    headed = F.format_string("## Vulnerable code\n\n```js\n%s\n```\n## Secure code\n\n```js\n%s\n```\n", "bad", "good")
    text = F.when(F.col("bad").isNull(), None).when(F.col("good") == "ok", titled).otherwise(headed)
    return table_of(spark, FENCED, sf_dir).select("id", fenced_pair(text, F.lit("javascript")).alias("p")).select("id", "p.*")


@query("r06", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN concat('short', lang) END AS best FROM documents")
def r06(spark, sf_dir):
    """The best block: file ending and language count more than length; manifests are passed over."""
    from lodemill.functions.fences import best_block

    block = lambda lang, title, body: F.struct(F.lit(lang).alias("lang"), F.lit(title).alias("title"), body.alias("body"))
    text = F.concat(F.lit("x"), F.repeat("source", 9))
    blocks = F.array(block("js", "package.json", text), block("", "a.md", F.concat(text, text)), block("py", "b.py", text), block("js", "c.js", F.concat(F.lit("short"), "lang", F.lit("\n"))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), best_block(F.when(F.col("doc_id") % 2 == 0, blocks).otherwise(F.slice(blocks, 1, 0)), F.lit("javascript")).alias("best"))


@query("t09", "SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def t09(spark, sf_dir):
    """The first assistant turn."""
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))


@query("t10", "SELECT doc_id, regexp_matches(text, '(?:example\\.com)|(?:token = )|(?:Licensed under)', 'i') AS hit FROM documents")
def t10(spark, sf_dir):
    """Several patterns in one pass."""
    from lodemill.functions.regex import matches

    return table(spark, sf_dir, "documents").select("doc_id", matches([r"example\.com", "token = ", "Licensed under"], F.col("text")).alias("hit"))


@query("t14", "SELECT item_id, concat('Language: ', 'en', chr(10), 'Text:', chr(10), text, chr(10), 'Answer:') AS prompt FROM benchmark")
def t14(spark, sf_dir):
    """Prompts."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.format_string("Language: %s\nText:\n%s\nAnswer:", F.lit("en"), "text").alias("prompt"))
