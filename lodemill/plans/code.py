"""Code metrics and graphs over sources derived from the documents, whose values follow from their making."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemill.functions import code as C
from lodemill.registry import query, table

#: A document's source: so many branches as its id says, a file that cannot be parsed, or one in a skipped folder.
_MADE = """SELECT doc_id, doc_id % 8 AS k, doc_id // 16 AS project, doc_id % 11 = 3 AS bad, doc_id % 13 = 5 AS skipped,
    concat(CASE WHEN doc_id % 13 = 5 THEN 'node_modules/' ELSE '' END, 'f', CAST(doc_id AS VARCHAR), '.py') AS path FROM documents"""
_SEEN = f"SELECT *, CAST(k AS INTEGER) AS n FROM ({_MADE}) WHERE NOT skipped"
_GOOD = f"SELECT * FROM ({_SEEN}) WHERE NOT bad"


def _files(spark, sf_dir):
    k = (F.col("doc_id") % 8).cast("int")
    head = F.concat(F.lit("import os\nfrom pkg.db import get as g"), k.cast("string"), F.lit("\n\ndef top(a, b=2, *c):\n    # note\n"))
    source = F.concat(head, F.repeat(F.lit("    if a and b:\n        return g(a)\n"), k), F.lit("    return a\n"))
    path = F.concat(F.when(F.col("doc_id") % 13 == 5, "node_modules/").otherwise(""), F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("project"), path.alias("path"), F.when(F.col("doc_id") % 11 == 3, "def (").otherwise(source).alias("source"))


def _scanned(spark, sf_dir):
    return C.scan(C.source_files(_files(spark, sf_dir)))


def _functions(spark, sf_dir, *columns):
    return _scanned(spark, sf_dir).where("error is null").select("path", "function", *columns)


@query("g01", f"SELECT path, 'top' AS function, 2 * n + 3 AS loc, 2 * n + 2 AS sloc FROM ({_GOOD})")
def g01(spark, sf_dir):
    """Lines and source lines."""
    return _functions(spark, sf_dir, "loc", "sloc")


@query("g02", f"SELECT path, 'top' AS function, 2 * n + 1 AS cyclomatic FROM ({_GOOD})")
def g02(spark, sf_dir):
    """Decisions."""
    return _functions(spark, sf_dir, "cyclomatic")


@query("g03", f"SELECT path, 'top' AS function, n AS cognitive, CASE WHEN n > 0 THEN 1 ELSE 0 END AS max_nesting FROM ({_GOOD})")
def g03(spark, sf_dir):
    """Cognitive score and nesting."""
    return _functions(spark, sf_dir, "cognitive", "max_nesting")


@query("g04", f"SELECT path, 'top' AS function, 3 AS params FROM ({_GOOD})")
def g04(spark, sf_dir):
    """Parameters."""
    return _functions(spark, sf_dir, "params")


@query("g05", f"SELECT path, 'top' AS function, 4 AS line, 2 * n + 6 AS end_line FROM ({_GOOD})")
def g05(spark, sf_dir):
    """Functions and where they are."""
    return _functions(spark, sf_dir, "line", "end_line")


SCRIPT = """// a note
export async function load(url, {retry = 2} = {}, ...rest) {
  // a comment
  if (url && retry || rest.length) {
    for (const r of rest) { if (!r) continue; }
  } else if (retry) {
    return url ? 1 : 2;
  } else {
    switch (retry) { case 1: break; default: fail(); }
  }
  try { await get(url); } catch (e) { log(e ?? url); }
  const inner = x => x && x.y;
  return function () { while (inner(1)) {} };
}
class Store extends Base {
  static async open(name) { do { name(); } while (name || this.size); }
  close = (hard: boolean): void => { this.on = hard; };
}
module.exports = { get(a, b) { return a / b / 2; }, again: () => `x${a ? 1 : "}"}` };
"""
_SCRIPT_ROWS = "('load', 2, 14, 13, 12, 3, 12, 13, 3), ('inner', 12, 12, 1, 1, 1, 2, 1, 0), ('(anonymous)', 13, 13, 1, 1, 0, 2, 1, 1), ('open', 16, 16, 1, 1, 1, 3, 2, 1), ('(anonymous)', 17, 17, 1, 1, 1, 1, 0, 0), ('get', 19, 19, 1, 1, 2, 1, 0, 0), ('again', 19, 19, 1, 1, 0, 2, 1, 0)"


@query("g06", f"SELECT concat('f', CAST(doc_id AS VARCHAR), '.js') AS path, t.* FROM documents, (VALUES {_SCRIPT_ROWS}) AS t(function, line, end_line, loc, sloc, params, cyclomatic, cognitive, max_nesting) WHERE doc_id % 4 = 0")
def g06(spark, sf_dir):
    """Functions of a script, inner ones on their own; typings, minified and built files are left out."""
    name = F.element_at(F.array(F.lit(".js"), F.lit(".min.js"), F.lit(".d.ts"), F.lit("/dist/a.js")), (F.col("doc_id") % 4 + 1).cast("int"))
    note = F.coalesce(F.regexp_extract("text", "[a-z]+", 0), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), name).alias("path"), F.replace(F.lit(SCRIPT), F.lit("a note"), note).alias("source"))
    return C.scan(C.source_files(rows)).select("path", "function", "line", "end_line", "loc", "sloc", "params", "cyclomatic", "cognitive", "max_nesting")


@query("g07", f"SELECT path, CASE WHEN bad THEN 0 ELSE 1 END AS functions, CASE WHEN bad THEN 1 ELSE 0 END AS errors FROM ({_SEEN})")
def g07(spark, sf_dir):
    """A scan that goes on after errors."""
    return _scanned(spark, sf_dir).groupBy("path").agg(F.count("function").cast("int").alias("functions"), F.count("error").cast("int").alias("errors"))


@query("a27", f"SELECT CAST(count(*) AS INTEGER) AS files, CAST(count(*) FILTER (NOT bad) AS INTEGER) AS functions, CAST(count(*) FILTER (NOT bad AND 2 * n + 1 >= 10) AS INTEGER) AS with_findings FROM ({_SEEN})")
def a27(spark, sf_dir):
    """Summary of a scan."""
    return _scanned(spark, sf_dir).agg(F.countDistinct("path").cast("int").alias("files"), F.count("function").cast("int").alias("functions"), F.count_if(F.size("findings") > 0).cast("int").alias("with_findings"))


@query("g08", "SELECT doc_id, CASE WHEN doc_id % 11 <> 3 THEN CAST(4 * (doc_id % 8 + 1) + 1 AS INTEGER) END AS nodes, CASE WHEN doc_id % 11 <> 3 THEN CAST(4 * (doc_id % 8 + 1) AS INTEGER) END AS edges, doc_id % 11 = 3 AS failed FROM documents")
def g08(spark, sf_dir):
    """Nodes and edges of syntax trees: a module, and of each assignment itself, its target with its context and its value."""
    source = F.when(F.col("doc_id") % 11 == 3, "def (").otherwise(F.repeat(F.lit("x = 1\n"), (F.col("doc_id") % 8 + 1).cast("int")))
    got = table(spark, sf_dir, "documents").select("doc_id", source.alias("source")).lateralJoin(C.py_graph_stats(F.col("source").outer()))
    return got.select("doc_id", F.col("ast_nodes").cast("int").alias("nodes"), F.col("ast_edges").cast("int").alias("edges"), F.col("error").isNotNull().alias("failed"))


def _graphs(spark, sf_dir, *columns):
    got = C.source_files(_files(spark, sf_dir)).lateralJoin(C.py_graph_stats(F.col("source").outer()))
    return got.where("error is null").select("path", *[F.col(c).cast("int").alias(c) for c in columns])


@query("g09", f"SELECT path, 2 * n + 3 AS cfg_nodes, 5 * n + 3 AS cfg_edges FROM ({_GOOD})")
def g09(spark, sf_dir):
    """Flow graphs."""
    return _graphs(spark, sf_dir, "cfg_nodes", "cfg_edges")


@query("g10", f"SELECT path, CASE WHEN n > 0 THEN 3 ELSE 2 END AS dfg_nodes, 3 * n + 1 AS dfg_edges FROM ({_GOOD})")
def g10(spark, sf_dir):
    """Data-flow graphs."""
    return _graphs(spark, sf_dir, "dfg_nodes", "dfg_edges")


@query("g11", f"SELECT path, 'os' AS name, 'os' AS module FROM ({_GOOD}) UNION ALL SELECT path, concat('g', CAST(n AS VARCHAR)), 'db' FROM ({_GOOD})")
def g11(spark, sf_dir):
    """Imports."""
    rows = C.source_files(_files(spark, sf_dir)).drop("kind").lateralJoin(C.py_calls(F.col("source").outer()))
    return rows.where("kind = 'import'").select("path", "name", "module")


@query("g12", f"SELECT project, CAST(count(*) AS INTEGER) AS nodes, 0 AS resolved, CAST(sum(n) AS INTEGER) AS unresolved, 0 AS cross_file, CAST(0 AS DOUBLE) AS rate FROM ({_GOOD}) GROUP BY project")
def g12(spark, sf_dir):
    """The call graph of each project; what is called is defined nowhere."""
    got = C.call_graph(C.source_files(_files(spark, sf_dir)))
    return got.select("project", *[F.col(c).cast("int").alias(c) for c in ("nodes", "resolved", "unresolved", "cross_file")], "rate")


@query("j14", "SELECT doc_id AS project, 2 AS nodes, 1 AS resolved, CAST(doc_id % 8 AS INTEGER) AS unresolved, 1 AS cross_file, round(1.0 / (1 + doc_id % 8), 3) AS rate FROM documents")
def j14(spark, sf_dir):
    """Calls to another file's definition and to nothing."""
    k = (F.col("doc_id") % 8).cast("int")
    caller = F.concat(F.lit("def a():\n"), F.repeat(F.lit("    nowhere()\n"), k), F.lit("    return b()\n"))
    both = F.array(F.struct(F.lit("one.py").alias("path"), caller.alias("source")), F.struct(F.lit("two.py").alias("path"), F.lit("def b():\n    pass\n").alias("source")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project"), F.explode(both).alias("f")).select("project", "f.path", "f.source")
    return C.call_graph(rows).select("project", *[F.col(c).cast("int").alias(c) for c in ("nodes", "resolved", "unresolved", "cross_file")], "rate")


@query("g13", f"SELECT project, CAST(coalesce(sum(2 * n + 3) FILTER (NOT bad), 0) AS INTEGER) AS cfg_nodes, CAST(coalesce(sum(5 * n + 3) FILTER (NOT bad), 0) AS INTEGER) AS cfg_edges, CAST(coalesce(sum(CASE WHEN n > 0 THEN 3 ELSE 2 END) FILTER (NOT bad), 0) AS INTEGER) AS dfg_nodes, CAST(coalesce(sum(3 * n + 1) FILTER (NOT bad), 0) AS INTEGER) AS dfg_edges, CAST(count(*) FILTER (bad) AS INTEGER) AS failed FROM ({_SEEN}) GROUP BY project")
def g13(spark, sf_dir):
    """Graph sizes of a project."""
    got = C.graph_sizes(C.source_files(_files(spark, sf_dir)))
    return got.select("project", *[F.col(c).cast("int").alias(c) for c in ("cfg_nodes", "cfg_edges", "dfg_nodes", "dfg_edges", "failed")])
