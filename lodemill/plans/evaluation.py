"""Scores of predictions over labels, conversations, events and literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemill.functions import scalars as S
from lodemill.operators import metrics as M
from lodemill.plans.fixtures import dealt, table_of, with_fixture
from lodemill.registry import query, table

RATES = """round(coalesce((tp + tn) / nullif(CAST(tp + fp + tn + fn AS DOUBLE), 0), 0), 4) AS accuracy, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 4) AS precision,
    round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 4) AS recall, round(coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0), 4) AS specificity, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 4) AS f1"""
CELLS = "count(*) AS n, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (t AND NOT p) AS fn"
_KEPT = ["n", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "specificity", "f1"]
_JUDGED = "SELECT d.lang, d.source, l.quality = 1 AS t, d.n_chars > 1200 AS p FROM documents d JOIN labels l ON l.doc_id = d.doc_id"


def _judged(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "source", (F.col("quality") == 1).alias("t"), (F.col("n_chars") > 1200).alias("p"))


@query("a13", f"SELECT *, {RATES} FROM (SELECT {CELLS} FROM ({_JUDGED}))")
def a13(spark, sf_dir):
    """Confusion of a rule against labels."""
    return M.confusion(_judged(spark, sf_dir), F.col("t"), F.col("p")).select(*_KEPT)


@query("a15", f"SELECT *, {RATES} FROM (SELECT lang, {CELLS} FROM ({_JUDGED}) GROUP BY lang)")
def a15(spark, sf_dir):
    """The same by slice."""
    return M.confusion(_judged(spark, sf_dir), F.col("t"), F.col("p"), ["lang"]).select("lang", *_KEPT)


PREDICTIONS = dealt(
    """('g1','VULNERABLE','VULNERABLE','CWE-1','CWE-1',1.5),('g1','SAFE','SAFE','CWE-1','',2.5),('g2','VULNERABLE','SAFE','CWE-2','',0.5),('g2','SAFE','VULNERABLE','CWE-2','CWE-9',3.5),
    ('g3','VULNERABLE','UNKNOWN','CWE-3','',4.5),('g3','SAFE','SAFE','CWE-3','',NULL),('g4','VULNERABLE','VULNERABLE','CWE-4','CWE-5',2.0)""",
    "ghsa, truth, said, cwe, said_cwe, latency",
    casts={"latency": "DOUBLE"}, own=("ghsa",))


@query(
    "a14",
    with_fixture("x", PREDICTIONS, f"SELECT *, {RATES}, round(joint_correct / CAST(tp + fp + tn + fn AS DOUBLE), 4) AS joint_accuracy FROM (SELECT count(*) AS n, count(*) FILTER (said = 'UNKNOWN') AS unknown, count(*) FILTER (k AND t AND p) AS tp, count(*) FILTER (k AND NOT t AND p) AS fp, count(*) FILTER (k AND NOT t AND NOT p) AS tn, count(*) FILTER (k AND t AND NOT p) AS fn, count(*) FILTER (k AND t AND cwe = said_cwe) AS cwe_correct, count(*) FILTER (k AND ((t AND p AND cwe = said_cwe) OR (NOT t AND NOT p))) AS joint_correct FROM (SELECT *, truth = 'VULNERABLE' AS t, said = 'VULNERABLE' AS p, said <> 'UNKNOWN' AS k FROM x))"),
)
def a14(spark, sf_dir):
    """Confusion in which unknown answers are not scored."""
    c = F.col
    got = M.confusion(table_of(spark, PREDICTIONS, sf_dir), c("truth") == "VULNERABLE", c("said") == "VULNERABLE", None, c("cwe") == c("said_cwe"), c("said") == "UNKNOWN")
    return got.select("n", "unknown", "tp", "fp", "tn", "fn", "cwe_correct", "joint_correct", "accuracy", "precision", "recall", "specificity", "f1", "joint_accuracy")


_PAIRS = "SELECT ghsa, max(said) FILTER (truth = 'VULNERABLE') AS v, max(said) FILTER (truth = 'SAFE') AS s, bool_or(truth = 'VULNERABLE' AND cwe = said_cwe) AS hit FROM x GROUP BY ghsa HAVING count(DISTINCT truth) = 2"
_PAIRED = with_fixture("x", PREDICTIONS, f"SELECT *, round(coalesce(ideal / nullif(CAST(pairs AS DOUBLE), 0), 0), 4) AS ideal_rate, round(coalesce(parent_flagged / nullif(CAST(pairs AS DOUBLE), 0), 0), 4) AS parent_flagged_rate, round(coalesce(fix_cleared / nullif(CAST(pairs AS DOUBLE), 0), 0), 4) AS fix_cleared_rate FROM (SELECT count(*) AS pairs, count(*) FILTER (v = 'VULNERABLE') AS parent_flagged, count(*) FILTER (s = 'SAFE') AS fix_cleared, count(*) FILTER (v = 'VULNERABLE' AND s = 'SAFE' AND hit) AS ideal FROM ({_PAIRS}))")


@query("a16", _PAIRED)
def a16(spark, sf_dir):
    """Pairs of predictions."""
    return M.paired(table_of(spark, PREDICTIONS, sf_dir), "ghsa", "truth", "said", F.col("cwe") == F.col("said_cwe"))


@query("j10", "SELECT u.conv_id, u.turn, CAST(length(u.text) AS INTEGER) AS asked, CAST(length(a.text) AS INTEGER) AS answered FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def j10(spark, sf_dir):
    """Both sides of a pair in one row, without a self join."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "user", F.col("turn")).otherwise(F.col("turn") - 1).alias("turn"), "role", F.length("text").alias("n"))
    both = rows.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("role") == "user", F.col("n"))).alias("asked"), F.max(F.when(F.col("role") == "assistant", F.col("n"))).alias("answered"))
    return both.where("asked is not null and answered is not null")


@query(
    "a17",
    """SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, list_sort(list(value))[CAST(floor(0.9 * (count(value) - 1)) AS BIGINT) + 1] AS p90,
    min(value) AS least, max(value) AS most, round(count(value) / sum(value), 4) AS per_second FROM events WHERE value IS NOT NULL GROUP BY event_type""",
)
def a17(spark, sf_dir):
    """Latency statistics; p90 is a value, not between two."""
    return M.latency(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", "n", "mean", "median", "p90", "least", "most", "per_second")


SCORED = dealt("(1,TRUE,'CWE-1','CWE-1','9.1','8.5','a cat sat','cat sat'),(2,FALSE,'','CWE-2','x','7.0','','dog ran'),(3,TRUE,'CWE-3','CWE-4',NULL,'5.0','bird flew','bird flew')", "id, flagged, said_cwe, cwe, said_cvss, cvss, said, gold")


@query("a18", with_fixture("x", SCORED, "SELECT count(*) AS n, round(avg(CAST(flagged AS INTEGER)), 4) AS detection, round(avg(CAST(said_cwe = cwe AS INTEGER)), 4) AS cwe, round(avg(CAST(coalesce(abs(TRY_CAST(said_cvss AS DOUBLE) - CAST(cvss AS DOUBLE)) <= 1.0, FALSE) AS INTEGER)), 4) AS cvss_within_1, round(avg(round(abs(TRY_CAST(said_cvss AS DOUBLE) - CAST(cvss AS DOUBLE)), 3)), 4) AS cvss_mae FROM x"))
def a18(spark, sf_dir):
    """A scorecard of several tasks."""
    c = F.col
    said, gold = S.to_float(c("said_cvss")), S.to_float(c("cvss"))
    off = F.lit(False)
    rows = table_of(spark, SCORED, sf_dir).select("flagged", (c("said_cwe") == c("cwe")).alias("cwe_correct"), S.within(said, gold, 1.0).alias("cvss_within_1"), F.round(F.abs(said - gold), 3).alias("cvss_abs_err"), S.token_f1(c("said"), c("gold")).alias("explanation_f1"), off.alias("owasp_correct"), off.alias("severity_correct"), off.alias("location_hit"), off.alias("fp_within"), off.alias("fn_within"), F.lit(0.0).alias("similarity"))
    return M.scorecard(rows).select("n", "detection", "cwe", "cvss_within_1", "cvss_mae")
