"""Scalar functions over columns derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemill.functions import scalars as S
from lodemill.plans.fixtures import dealt, table_of, with_fixture
from lodemill.registry import query, table
from lodemill.rules import security as R


def _sql_map(table_: dict[str, str], value: str) -> str:
    return "CASE " + value + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


REPOS = dealt("(1,'2024-01-01T00:00:00Z'),(2,'2025-12-31T12:00:00Z'),(3,NULL),(4,'soon')", "id, created")


@query("f01", with_fixture("t", REPOS, "SELECT id, CAST(floor(epoch(TIMESTAMPTZ '2026-01-01 00:00:00+00' - TRY_CAST(created AS TIMESTAMPTZ)) / 86400) AS INTEGER) AS days FROM t"))
def f01(spark, sf_dir):
    """age in whole days."""
    return table_of(spark, REPOS, sf_dir).select("id", S.age_in_days(F.col("created"), F.lit("2026-01-01T00:00:00Z")).alias("days"))


CWES = dealt("(1,'cwe-0079'),(2,'CWE-89: x'),(3,'none'),(4,NULL),(5,'LLM02 and 7'),(6,'llm10')", "id, raw", mix=("raw",))


@query("f02", with_fixture("t", CWES, r"SELECT id, CASE WHEN regexp_matches(coalesce(raw,''), '\d+') THEN concat('CWE-', CAST(CAST(regexp_extract(raw, '\d+') AS HUGEINT) AS VARCHAR)) ELSE '' END AS cwe FROM t"))
def f02(spark, sf_dir):
    """weakness ids."""
    return table_of(spark, CWES, sf_dir).select("id", S.norm_cwe(F.col("raw")).alias("cwe"))


@query("f03", with_fixture("t", CWES, r"SELECT id, CASE WHEN regexp_matches(x, '^LLM') THEN concat('LLM', lpad(CAST(CAST(substr(x, 4) AS INTEGER) AS VARCHAR), 2, '0')) ELSE x END AS cwe FROM (SELECT id, upper(regexp_extract(coalesce(raw,''), '(?i)(CWE-\d+|LLM\d+)')) AS x FROM t)"))
def f03(spark, sf_dir):
    """weakness ids with those of models."""
    return table_of(spark, CWES, sf_dir).select("id", S.norm_model_cwe(F.col("raw")).alias("cwe"))


LANGS = dealt("(1,' JS ','a/b.TSX'),(2,'TypeScript','x.mjs'),(3,'py','y.py'),(4,'Rust','z.rs'),(5,NULL,NULL)", "id, lang, path")


@query("f04", with_fixture("t", LANGS, f"SELECT id, coalesce({_sql_map(R.LANGUAGES, 'l')}, l) AS loose, {_sql_map(R.LANGUAGES, 'l')} AS strict, CASE WHEN regexp_matches(p, '\\.tsx?$') THEN 'typescript' WHEN regexp_matches(p, '\\.(js|jsx|mjs|cjs)$') THEN 'javascript' WHEN regexp_matches(p, '\\.py$') THEN 'python' ELSE '' END AS of_path FROM (SELECT id, lower(trim(coalesce(lang,''))) AS l, lower(coalesce(path,'')) AS p FROM t)"))
def f04(spark, sf_dir):
    """languages by name and path."""
    return table_of(spark, LANGS, sf_dir).select("id", S.norm_lang(F.col("lang")).alias("loose"), S.norm_lang(F.col("lang"), strict=True).alias("strict"), S.lang_from_path(F.col("path")).alias("of_path"))


@query("f05", with_fixture("t", CWES, r"SELECT id, CASE WHEN x <> '' THEN concat('LLM', lpad(CAST(CAST(x AS INTEGER) AS VARCHAR), 2, '0')) ELSE '' END AS k FROM (SELECT id, regexp_extract(coalesce(raw,''), '(?i)LLM\s*(\d{1,2})', 1) AS x FROM t)"))
def f05(spark, sf_dir):
    """model weakness keys."""
    return table_of(spark, CWES, sf_dir).select("id", S.llm_key(F.col("raw")).alias("k"))


OWASP = dealt("(1,'A03:2021 - Injection'),(2,'a10:2021'),(3,'A1:2025 x'),(4,' other '),(5,NULL),(6,'None')", "id, raw", mix=("raw",))


@query(
    "f06",
    with_fixture("t", OWASP, f"SELECT id, CASE WHEN o <> '' THEN coalesce({_sql_map(R.OWASP_2021_TO_2025, 'ok')}, '') WHEN n <> '' THEN concat('A', lpad(n, 2, '0'), ':2025') WHEN trim(coalesce(raw,'')) IN ('nan','None','null','NaN') THEN '' ELSE trim(coalesce(raw,'')) END AS y25, CASE WHEN b <> '' THEN concat('A', lpad(b, 2, '0'), ':', y) ELSE r END AS norm FROM (SELECT *, concat('A', lpad(o, 2, '0'), ':2021') AS ok FROM (SELECT *, regexp_extract(r, 'A0?(\\d{{1,2}}):2021', 1) AS o, regexp_extract(r, 'A0?(\\d{{1,2}}):2025', 1) AS n, regexp_extract(r, 'A0?(\\d{{1,2}}):(202[15])', 1) AS b, regexp_extract(r, 'A0?(\\d{{1,2}}):(202[15])', 2) AS y FROM (SELECT *, replace(upper(trim(coalesce(raw,''))), ' ', '') AS r FROM t)))"),
)
def f06(spark, sf_dir):
    """categories of 2025, and normal forms."""
    return table_of(spark, OWASP, sf_dir).select("id", S.owasp_2025(F.col("raw")).alias("y25"), S.norm_owasp(F.col("raw")).alias("norm"))


SCORES = dealt("(1,'9.84','CWE-1'),(2,'0','CWE-79'),(3,NULL,'CWE-22'),(4,'x','CWE-338'),(5,'-2','NVD-CWE-Other')", "id, raw, cwe")


@query("f07", with_fixture("t", SCORES, "SELECT id, CASE WHEN TRY_CAST(raw AS DOUBLE) > 0 THEN round(TRY_CAST(raw AS DOUBLE), 1) ELSE coalesce(CAST(" + _sql_map({k: str(v) for k, v in R.CWE_CVSS.items()}, "cwe") + " AS DOUBLE), 7.5) END AS score FROM t"))
def f07(spark, sf_dir):
    """scores with fallbacks."""
    return table_of(spark, SCORES, sf_dir).select("id", S.cvss(F.col("raw"), F.col("cwe")).alias("score"))


@query("f08", "SELECT doc_id, concat(upper(lang), '_', upper(substr(md5(text), 1, 8))) AS id FROM documents")
def f08(spark, sf_dir):
    """stable ids."""
    return table(spark, sf_dir, "documents").select("doc_id", S.stable_id(F.upper("lang"), F.col("text")).alias("id"))


SAMPLES = dealt("(1,'x Semgrep y','a'),(2,NULL,'CVEFIXES_1'),(3,'','SEC_TS_CWE9'),(4,'BIPIA','z'),(5,NULL,NULL),(6,'Own','q')", "id, src, sid")


def _provenance_sql(k: int) -> str:
    out = ""
    for parts, ids, row in R.PROVENANCE:
        tests = [f"contains(s, '{p}')" for p in parts] + [f"starts_with(i, '{x[1:]}')" if x[0] == "^" else f"contains(i, '{x}')" for x in ids]
        out += f" WHEN {' OR '.join(tests)} THEN '{row[k]}'"
    return out


@query("f09", with_fixture("t", SAMPLES, f"SELECT id, CASE {_provenance_sql(0)} ELSE concat('custom_security_benchmark.json (', CASE WHEN s = '' THEN 'Curated' ELSE s END, ')') END AS source, CASE {_provenance_sql(1)} ELSE 'synthetic_manual' END AS kind FROM (SELECT id, coalesce(src,'') AS s, coalesce(sid,'') AS i FROM t)"))
def f09(spark, sf_dir):
    """provenance."""
    got = S.provenance(F.col("src"), F.col("sid"))
    return table_of(spark, SAMPLES, sf_dir).select("id", got.alias("p")).select("id", "p.source", "p.kind")


ENTRIES = dealt("(1,'CWE-200','','x LLM02','',NULL),(2,'CWE-200','','a','System Prompt Leakage',NULL),(3,'CWE-79','','a','','VULN-XSS-001'),(4,'CWE-1','LLM05','a','',NULL),(5,'CWE-200','','a','other','VULN-X'),(6,'CWE-9','',NULL,NULL,NULL)", "id, cwe, llm, sid, name, first_id")


@query("f10", with_fixture("t", ENTRIES, "SELECT id, CASE WHEN contains(s, 'LLM02') OR llm = 'LLM02' THEN 'VULN-LLM-002' WHEN contains(s, 'LLM07') OR llm = 'LLM07' THEN 'VULN-LLM-007' WHEN llm = 'LLM01' THEN 'VULN-LLM-001' WHEN llm = 'LLM05' THEN 'VULN-LLM-005' WHEN cwe = 'CWE-200' THEN CASE n WHEN 'Sensitive Information Disclosure' THEN 'VULN-LLM-002' WHEN 'System Prompt Leakage' THEN 'VULN-LLM-007' ELSE '' END ELSE coalesce(first_id, '') END AS entry FROM (SELECT *, coalesce(sid,'') AS s, coalesce(name,'') AS n FROM t)"))
def f10(spark, sf_dir):
    """catalogue entries."""
    c = F.col
    return table_of(spark, ENTRIES, sf_dir).select("id", S.catalogue_id(c("cwe"), c("llm"), c("sid"), c("name"), c("first_id")).alias("entry"))


MODELS = dealt("(1,'LLM01:2025',NULL,NULL),(2,'LLM07:2025','x','y'),(3,'CWE-5','n','o'),(4,'CWE-6',NULL,NULL)", "id, raw, name, owasp")


@query("f11", with_fixture("t", MODELS, f"SELECT id, coalesce({_sql_map({k: v[0] for k, v in R.LLM_MAP.items()}, 'raw')}, raw) AS cwe_id, coalesce({_sql_map({k: v[1] for k, v in R.LLM_MAP.items()}, 'raw')}, name, raw) AS cwe_name, coalesce({_sql_map({k: v[2] for k, v in R.LLM_MAP.items()}, 'raw')}, owasp, 'OWASP LLM Top 10:2025') AS owasp FROM t"))
def f11(spark, sf_dir):
    """model weaknesses."""
    c = F.col
    return table_of(spark, MODELS, sf_dir).select("id", S.llm_weakness(c("raw"), c("name"), c("owasp")).alias("w")).select("id", "w.*")


PURLS = dealt("(1,'pkg:maven/g/a@1?x#y'),(2,'pkg:npm/%40s/n@2'),(3,'pkg:apk/x@1'),(4,'pkg:npm/x'),(5,NULL),(6,'pkg:golang/a/b/c@v1.2')", "id, purl")


@query(
    "f12",
    with_fixture("t", PURLS, f"SELECT id, CASE WHEN ok THEN eco END AS ecosystem, CASE WHEN ok THEN CASE WHEN k = 'maven' AND contains(p, '/') THEN concat(url_decode(split_part(p, '/', 1)), ':', url_decode(split_part(p, '/', 2))) ELSE url_decode(p) END END AS name, CASE WHEN ok THEN url_decode(v) END AS version FROM (SELECT *, {_sql_map(R.ECOSYSTEMS, 'k')} AS eco, eco IS NOT NULL AND contains(r, '@') AS ok, regexp_extract(r, '^(.*)@([^@]*)$', 1) AS p, regexp_extract(r, '^(.*)@([^@]*)$', 2) AS v FROM (SELECT id, regexp_extract(coalesce(purl,''), '^pkg:([^/]+)/(.+)$', 1) AS k, split_part(split_part(regexp_extract(coalesce(purl,''), '^pkg:([^/]+)/(.+)$', 2), '?', 1), '#', 1) AS r FROM t))"),
)
def f12(spark, sf_dir):
    """package URLs."""
    return table_of(spark, PURLS, sf_dir).select("id", S.parse_purl(F.col("purl")).alias("p")).select("id", "p.ecosystem", "p.name", "p.version")


TAGS = dealt("(1,'appsecbench:a:train'),(2,'securecodepairs:x'),(3,'ghsa:q'),(4,'gift:1'),(5,'other:rest:more'),(6,'plain'),(7,NULL)", "id, src", mix=("src",))


@query("f13", with_fixture("t", TAGS, "SELECT id, CASE k WHEN 'appsecbench' THEN 'appsec' WHEN 'securecodepairs' THEN 'scp' ELSE k END AS kind, CASE WHEN k IN ('appsecbench','securecodepairs') THEN string_split(s, ':')[-1] WHEN k = 'ghsa' THEN 'eval' WHEN k = 'gift' THEN '879' WHEN contains(s, ':') THEN substr(s, strpos(s, ':') + 1) ELSE '' END AS split FROM (SELECT id, coalesce(src,'') AS s, split_part(coalesce(src,''), ':', 1) AS k FROM t)"))
def f13(spark, sf_dir):
    """kind and split of a source."""
    return table_of(spark, TAGS, sf_dir).select("id", S.source_tag(F.array("src")).alias("s")).select("id", "s.*")


OUTPUTS = dealt("(1,'- SAFE'),(2,'CWE-22'),(3,''),(4,NULL),(5,'vulnerable, cwe-5'),(6,'SAFE CWE-1'),(7,'unsafe')", "id, said", mix=("said",))


@query("f14", with_fixture("t", OUTPUTS, r"SELECT id, l AS label, CASE WHEN l = 'VULNERABLE' THEN c ELSE '' END AS cwe FROM (SELECT *, CASE WHEN s <> '' THEN s WHEN c <> '' THEN 'VULNERABLE' ELSE 'UNKNOWN' END AS l FROM (SELECT id, upper(regexp_extract(coalesce(said,''), '(?i)\b(SAFE|VULNERABLE)\b', 1)) AS s, upper(regexp_extract(coalesce(said,''), '(?i)\bCWE-\d+\b')) AS c FROM t))"))
def f14(spark, sf_dir):
    """verdicts."""
    return table_of(spark, OUTPUTS, sf_dir).select("id", S.verdict(F.col("said")).alias("v")).select("id", "v.*")


@query("f15", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f15(spark, sf_dir):
    """JSON objects in text, tolerantly."""
    text = S.json_object(F.concat(F.lit("said: "), "props"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(text, "$.k").cast("long").alias("k"))


FLAGS = dealt("(1,'true','7.5'),(2,'True','about 3.2 or so'),(3,'yes',''),(4,NULL,NULL),(5,'false','x')", "id, flag, number")


@query("f16", with_fixture("t", FLAGS, "SELECT id, coalesce(lower(flag) = 'true', FALSE) AS flag FROM t"))
def f16(spark, sf_dir):
    """F16: flags."""
    return table_of(spark, FLAGS, sf_dir).select("id", S.as_flag(F.col("flag")).alias("flag"))


@query("f17", with_fixture("t", FLAGS, r"SELECT id, coalesce(TRY_CAST(number AS DOUBLE), TRY_CAST(nullif(regexp_extract(coalesce(number,''), '\d+(?:\.\d+)?'), '') AS DOUBLE)) AS number FROM t"))
def f17(spark, sf_dir):
    """numbers in text."""
    return table_of(spark, FLAGS, sf_dir).select("id", S.to_float(F.col("number")).alias("number"))


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+'), lambda t: length(t) > 2))"


@query("f18", f"SELECT doc_id, item_id, round(coalesce(2.0 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 0), 4) AS f1 FROM (SELECT d.doc_id, i.item_id, {TOKENS.format('d.text')} AS a, {TOKENS.format('i.text')} AS b FROM documents d JOIN benchmark i ON i.item_id = d.doc_id)")
def f18(spark, sf_dir):
    """token overlap."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item")
    return docs.join(items, F.col("doc_id") == F.col("item_id")).select("doc_id", "item_id", S.token_f1(F.col("text"), F.col("item")).alias("f1"))


@query("f19")
def f19(spark, sf_dir):
    """matching share of texts."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item")
    return docs.join(items, F.col("doc_id") == F.col("item_id")).select("doc_id", S.seq_ratio(F.col("text"), F.col("item")).alias("ratio"))


CODE = dealt("(1,'db.execute(query)','the QUERY is built'),(2,'return x','return'),(3,'ab','ab'),(4,NULL,'x'),(5,'render(page)',NULL)", "id, code, said", mix=("code", "said"))


@query("f20", with_fixture("t", CODE, "SELECT id, len(list_filter(regexp_extract_all(coalesce(code,''), '[A-Za-z_]{4,}'), lambda t: lower(t) NOT IN ('function','return','const','vulnerable','secure') AND contains(lower(coalesce(said,'')), lower(t)))) > 0 AS hit FROM t"))
def f20(spark, sf_dir):
    """identifiers that are named."""
    return table_of(spark, CODE, sf_dir).select("id", S.location_hit(F.col("code"), F.col("said")).alias("hit"))


@query("f21", "SELECT l_orderkey, l_linenumber, coalesce(abs(l_discount - l_tax) <= 0.03, FALSE) AS near FROM lineitem")
def f21(spark, sf_dir):
    """tolerances."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.within(F.col("l_discount"), F.col("l_tax"), 0.03).alias("near"))


@query("f22", "SELECT event_id, round(event_id / nullif(user_id * 1000000.0 / 1e9, 0), 4) AS rate FROM events")
def f22(spark, sf_dir):
    """rates that are null for no time."""
    return table(spark, sf_dir, "events").select("event_id", S.per_second(F.col("event_id"), F.col("user_id") * 1000000.0).alias("rate"))


PATHS = dealt("(1,'docs/A.TAR.Gz'),(2,'.gitignore'),(3,'a/b/.x.md'),(4,'README')", "id, path")


@query("f23", with_fixture("t", PATHS, r"SELECT id, n AS name, lower(regexp_extract(n, '^.+(\.[^.]+)$', 1)) AS suffix, CASE WHEN contains(path,'/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent, NOT contains(path,'/') AS is_root, CASE WHEN contains(path,'/') THEN split_part(path,'/',1) ELSE '(root)' END AS top FROM (SELECT *, string_split(path,'/')[-1] AS n FROM t)"))
def f23(spark, sf_dir):
    """parts of paths."""
    return table_of(spark, PATHS, sf_dir).select("id", S.path_parts(F.col("path")).alias("p")).select("id", "p.*")


PATTERNS = dealt("(1,'python','exec(|eval('),(2,'typescript',''),(3,'javascript','x'),(4,'go','y')", "id, lang, own")


@query("f25", with_fixture("t", PATTERNS, "SELECT id, CASE WHEN own <> '' THEN replace(own, '|', '; ') WHEN lang = 'typescript' THEN 'a; b' ELSE '' END AS patterns FROM t"))
def f25(spark, sf_dir):
    """a language's patterns."""
    own = F.filter(F.split("own", r"\|"), lambda x: x != "")
    javascript = F.when(F.col("lang") == "javascript", own).otherwise(F.array(F.lit("a"), F.lit("b")))
    rest = F.when(F.col("lang") == "javascript", F.lit("none")).otherwise(F.col("lang"))
    return table_of(spark, PATTERNS, sf_dir).select("id", S.joined_patterns(F.create_map(F.lit("javascript"), javascript, rest, own), F.col("lang")).alias("patterns"))


STATES = dealt("(1,'abc',TRUE,2,0,200,FALSE),(2,'abc',FALSE,2,0,200,TRUE),(3,'',TRUE,0,1,404,FALSE),(4,NULL,FALSE,0,0,500,FALSE)", "id, sha, parent, n_src, n_patched, http, any_found")


@query("f27", with_fixture("t", STATES, "SELECT id, CASE WHEN coalesce(sha,'') <> '' AND parent AND n_src > 0 THEN 'fixed_with_code' WHEN coalesce(sha,'') <> '' THEN 'fixed_no_code' WHEN n_patched > 0 THEN 'patched_no_commit' ELSE 'not_fixed' END AS status FROM t"))
def f27(spark, sf_dir):
    """advisory states."""
    c = F.col
    return table_of(spark, STATES, sf_dir).select("id", S.advisory_status(c("sha"), c("parent"), c("n_src"), c("n_patched")).alias("status"))


@query("f28", with_fixture("t", STATES, "SELECT id, s AS status, s = 'confirmed_zero' AND n_src > 0 AS absent FROM (SELECT *, CASE WHEN http = 200 AND NOT any_found THEN 'confirmed_zero' WHEN http = 200 THEN 'found_on_recheck' WHEN http IN (403,404) THEN concat('denied_or_disabled (HTTP ', http, ')') ELSE concat('error (HTTP ', http, ')') END AS s FROM t)"))
def f28(spark, sf_dir):
    """recheck states and absences."""
    c = F.col
    status = S.recheck_status(c("http"), c("any_found"))
    return table_of(spark, STATES, sf_dir).select("id", status.alias("status"), S.real_absence(status, c("n_src"), F.lit(""), F.lit("")).alias("absent"))


REVIEWS = dealt("(1,'eval(x) and more code here','vulnerable','CWE-94'),(2,'plain text only, nothing','vulnerable','CWE-78'),(3,'x # SECURE','safe','CWE-1'),(4,'Math.random()','safe','CWE-338'),(5,'short','vulnerable','CWE-798')", "id, code, label, cwe", mix=("code",))


@query("f29", with_fixture("t", REVIEWS, f"SELECT id, CASE WHEN leak THEN 'fix' WHEN len(n) > 0 THEN 'review' ELSE 'keep' END AS verdict, CASE WHEN len(n) > 0 THEN array_to_string(n, '; ') ELSE 'ok' END AS notes FROM (SELECT *, list_filter([CASE WHEN leak THEN 'giveaway token still present' END, CASE WHEN label = 'vulnerable' AND cwe IN ('CWE-78','CWE-94') AND NOT regexp_matches(code, '{R.SINKS}') THEN 'sink not obvious for injection CWE' END, CASE WHEN label = 'vulnerable' AND cwe = 'CWE-798' AND NOT regexp_matches(code, '{R.SECRETS}') THEN 'hardcoded secret not obvious' END, CASE WHEN label = 'vulnerable' AND length(code) < 20 THEN 'snippet too short' END, CASE WHEN label <> 'vulnerable' AND regexp_matches(code, '{R.UNSAFE}') THEN 'safe case still looks unsafe' END], lambda x: x IS NOT NULL) AS n FROM (SELECT *, regexp_matches(code, '{R.GIVEAWAY}', 'i') AS leak FROM t))"))
def f29(spark, sf_dir):
    """review of labels."""
    c = F.col
    return table_of(spark, REVIEWS, sf_dir).select("id", S.review_label(c("code"), c("label"), c("cwe")).alias("r")).select("id", "r.*")


MEASURES = dealt("(1,10,2,3,4,1),(2,60,4,12,9,3),(3,120,6,20,30,5)", "id, loc, params, cyclomatic, cognitive, nesting")


@query("f30", with_fixture("t", MEASURES, "SELECT id, array_to_string(list_filter([CASE WHEN cyclomatic >= 15 THEN concat('cyclomatic ', cyclomatic, ' >= 15 (high)') WHEN cyclomatic >= 10 THEN concat('cyclomatic ', cyclomatic, ' >= 10 (moderate)') END, CASE WHEN cognitive >= 15 THEN concat('cognitive ', cognitive, ' >= 15 (high)') WHEN cognitive >= 8 THEN concat('cognitive ', cognitive, ' >= 8 (moderate)') END, CASE WHEN loc >= 100 THEN concat('loc ', loc, ' >= 100 (god function)') WHEN loc >= 50 THEN concat('loc ', loc, ' >= 50 (long method)') END, CASE WHEN nesting >= 4 THEN concat('nesting ', nesting, ' >= 4') WHEN nesting >= 3 THEN concat('nesting ', nesting, ' >= 3') END, CASE WHEN params >= 5 THEN concat('params ', params, ' >= 5') END], lambda x: x IS NOT NULL), '; ') AS findings FROM t"))
def f30(spark, sf_dir):
    """findings over thresholds."""
    c = F.col
    return table_of(spark, MEASURES, sf_dir).select("id", F.array_join(S.findings(c("loc"), c("params"), c("cyclomatic"), c("cognitive"), c("nesting")), "; ").alias("findings"))


LABELS = dealt("(1,0,'Named','a b|c'),(2,1,NULL,'agent memory|tool_use|x|y'),(3,2,NULL,''),(4,-1,NULL,'z')", "id, topic, name, words")


@query("f31", with_fixture("t", LABELS, "SELECT id, CASE WHEN topic = -1 THEN 'Unassigned' WHEN name <> '' THEN name WHEN words <> '' THEN array_to_string(list_transform(string_split(replace(words, '_', ' '), '|')[1:3], lambda w: array_to_string(list_transform(string_split(w, ' '), lambda p: concat(upper(left(p, 1)), lower(substr(p, 2)))), ' ')), ' | ') ELSE concat('Topic ', topic) END AS label, CASE WHEN topic = -1 THEN '' ELSE array_to_string(string_split(words, '|'), ', ') END AS keywords FROM t"))
def f31(spark, sf_dir):
    """topic labels."""
    got = S.topic_label(F.col("name"), F.split("words", r"\|"), F.col("topic"))
    return table_of(spark, LABELS, sf_dir).select("id", got.alias("l")).select("id", F.col("l.name").alias("label"), "l.keywords")


BLANKS = dealt("(1,' a '),(2,'nan'),(3,'None'),(4,NULL),(5,'null'),(6,'  ')", "id, raw")


@query("f32", with_fixture("t", BLANKS, "SELECT id, CASE WHEN s IN ('nan','None','null','NaN') THEN '' ELSE s END AS text, nullif(CASE WHEN s IN ('nan','None','null','NaN') THEN '' ELSE s END, '') AS value FROM (SELECT id, trim(coalesce(raw,'')) AS s FROM t)"))
def f32(spark, sf_dir):
    """F32: what stands for nothing."""
    return table_of(spark, BLANKS, sf_dir).select("id", S.clean(F.col("raw")).alias("text"), S.blank_to_null(F.col("raw")).alias("value"))


LINKS = dealt("(1,'<https://h/x?page=2>; rel=\"next\", <https://h/x?per_page=1&page=34>; rel=\"last\"',1),(2,NULL,7),(3,'',0)", "id, link, n")


@query("s03", with_fixture("t", LINKS, "SELECT id, CASE WHEN p <> '' THEN CAST(p AS INTEGER) ELSE CAST(n AS INTEGER) END AS total FROM (SELECT *, regexp_extract(coalesce(link,''), '[?&]page=(\\d+)[^>]*>;\\s*rel=\"last\"', 1) AS p FROM t)"))
def s03(spark, sf_dir):
    """Totals from link headers."""
    return table_of(spark, LINKS, sf_dir).select("id", S.last_page(F.col("link"), F.col("n")).alias("total"))


URLS = dealt("(1,'n','https://github.com/a/b.git'),(2,'x/y','http://GitHub.com/a/b/tree/z'),(3,'x/y','https://gitlab.com/q/r/'),(4,'x',NULL)", "id, name, url")


@query("p03", with_fixture("t", URLS, r"SELECT id, f AS full_name, l AS last_two, coalesce(f, CASE WHEN contains(name, '/') THEN name END) AS either FROM (SELECT *, nullif(regexp_replace(regexp_extract(coalesce(url,''), '(?i)^https?://(?:www\.)?github\.com/([^/?#]+/[^/?#]+)', 1), '\.git$', ''), '') AS f, CASE WHEN contains(u, '/') THEN concat(string_split(u, '/')[-2], '/', string_split(u, '/')[-1]) END AS l FROM (SELECT *, regexp_replace(regexp_replace(coalesce(url,''), '/+$', ''), '\.git$', '') AS u FROM t))"))
def p03(spark, sf_dir):
    """Repository names from addresses, three ways."""
    c = F.col
    return table_of(spark, URLS, sf_dir).select("id", S.full_name(c("url")).alias("full_name"), S.last_segments(c("url")).alias("last_two"), S.name_or_url(c("name"), c("url")).alias("either"))
