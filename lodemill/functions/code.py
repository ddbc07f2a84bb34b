"""Code metrics and graphs as table functions over source texts.

A file that cannot be parsed gives one row with its error, so that a scan goes on.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodemill.functions import script
from lodemill.functions.scalars import findings
from lodemill.sources.readers import Scratch

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Definitions inside a function, which are measured on their own.
INNER = (*FUNCTION, ast.ClassDef)
LOOP = (ast.For, ast.AsyncFor, ast.While)


def _inside(body: list[ast.AST]) -> Iterator[ast.AST]:
    """All nodes of a body but those of inner definitions."""
    todo = [n for n in body if not isinstance(n, INNER)]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in ast.iter_child_nodes(node) if not isinstance(c, INNER)]


def _paths(node: ast.AST) -> int:
    """Decisions that a node adds."""
    match node:
        case ast.If() | ast.For() | ast.AsyncFor() | ast.While() | ast.ExceptHandler() | ast.Assert() | ast.IfExp():
            return 1
        case ast.comprehension(ifs=ifs):
            return 1 + len(ifs)
        case ast.BoolOp(values=values):
            return len(values) - 1
        case ast.Match(cases=cases):
            return len(cases)
    return 0


def cyclomatic(function: ast.AST) -> int:
    return 1 + sum(map(_paths, _inside(function.body)))


def cognitive(function: ast.AST) -> tuple[int, int]:
    """Score, and the deepest nesting: a branch costs one and its depth, a chain of conditions one."""
    total = deepest = 0
    todo: list[tuple[ast.AST, int]] = [(n, 0) for n in function.body]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, INNER):
            continue
        inner = depth
        if isinstance(node, ast.If):
            # The condition itself is not scored; an else costs one, an elif is an if at this depth.
            total += 1 + depth
            deepest = max(deepest, depth + 1)
            todo += [(c, depth + 1) for c in node.body]
            if node.orelse and not (len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If)):
                total += 1
            todo += [(c, depth) for c in node.orelse]
            continue
        if isinstance(node, (*LOOP, ast.ExceptHandler, ast.Match)):
            total += 1 + depth
            inner = depth + 1
            deepest = max(deepest, inner)
        elif isinstance(node, ast.IfExp):
            total += 1 + depth
        elif isinstance(node, ast.comprehension):
            total += (1 + depth) * (1 + len(node.ifs))
        elif isinstance(node, ast.BoolOp):
            total += 1
        todo += [(c, inner) for c in ast.iter_child_nodes(node)]
    return total, deepest


def functions_of(tree: ast.AST) -> list[ast.AST]:
    """Every function in source order, an outer one before its inner ones."""
    return sorted((n for n in ast.walk(tree) if isinstance(n, FUNCTION)), key=lambda n: (n.lineno, n.col_offset))


def measured(source: str) -> Iterator[tuple]:
    lines = source.splitlines()
    for node in functions_of(ast.parse(source)):
        end = node.end_lineno or node.lineno
        text = [line.strip() for line in lines[node.lineno - 1 : end]]
        a = node.args
        params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
        score, nesting = cognitive(node)
        yield node.name, node.lineno, end, len(text), sum(bool(t) and t[0] != "#" for t in text), params, cyclomatic(node), score, nesting


def control_flow(function: ast.AST) -> tuple[int, int]:
    """Nodes and edges of the flow heuristic: a node a statement, more edges where the flow parts."""
    nodes, edges, todo = 2, 1, list(function.body)
    while todo:
        node = todo.pop()
        nodes, edges = nodes + 1, edges + 1
        if isinstance(node, ast.If):
            todo += node.body + node.orelse
            edges += 2
        elif isinstance(node, LOOP):
            todo += node.body
            edges += 2
        elif isinstance(node, ast.Try):
            todo += node.body + node.orelse + node.finalbody + [s for h in node.handlers for s in h.body]
            edges += len(node.handlers)
        elif isinstance(node, ast.Return):
            edges += 1
    return nodes, edges


def data_flow(function: ast.AST) -> tuple[int, int]:
    """Names, and loads of names that were stored before in visiting order; inner functions are left out."""
    known = {a.arg for a in function.args.args}
    names, edges = set(known), 0
    todo = list(reversed(function.body))
    while todo:
        node = todo.pop()
        if isinstance(node, FUNCTION):
            continue
        if isinstance(node, ast.Name):
            names.add(node.id)
            if isinstance(node.ctx, ast.Store):
                known.add(node.id)
            elif isinstance(node.ctx, ast.Load):
                edges += node.id in known
        else:
            todo += reversed(list(ast.iter_child_nodes(node)))
    return len(names), edges


@udtf(returnType="function string, line int, end_line int, loc int, sloc int, params int, cyclomatic int, cognitive int, max_nesting int, error string")
class py_functions:
    """One row for each function of a Python source."""

    def eval(self, source: str):
        try:
            for row in measured(source or ""):
                yield (*row, None)
        except (SyntaxError, ValueError, RecursionError) as e:
            yield (*[None] * 9, f"{type(e).__name__}: {e}")


@udtf(returnType="ast_nodes long, ast_edges long, cfg_nodes long, cfg_edges long, dfg_nodes long, dfg_edges long, functions int, error string")
class py_graph_stats:
    """Sizes of a Python source's graphs."""

    def eval(self, source: str):
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError, RecursionError) as e:
            yield (*[None] * 7, f"{type(e).__name__}: {e}")
            return
        nodes = edges = 0
        for node in ast.walk(tree):
            nodes, edges = nodes + 1, edges + sum(1 for _ in ast.iter_child_nodes(node))
        found = functions_of(tree)
        flow, data = [control_flow(f) for f in found], [data_flow(f) for f in found]
        total = lambda pairs, k: sum(p[k] for p in pairs)
        yield nodes, edges, total(flow, 0), total(flow, 1), total(data, 0), total(data, 1), len(found), None


@udtf(returnType="kind string, ord int, caller string, name string, bare boolean, module string")
class py_calls:
    """Definitions (kind def), imports (import) and calls (call) of a Python source, each in order."""

    def eval(self, source: str):
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError, RecursionError):
            return
        for k, node in enumerate(ast.walk(tree)):
            if isinstance(node, ast.ImportFrom) and node.module:
                for alias in node.names:
                    yield "import", k, None, alias.asname or alias.name, None, node.module.rpartition(".")[2]
            elif isinstance(node, ast.Import):
                for alias in node.names:
                    first = alias.name.partition(".")[0]
                    yield "import", k, None, alias.asname or first, None, first
        for k, function in enumerate(functions_of(tree)):
            yield "def", k, None, function.name, None, None
            for node in ast.walk(function):
                if isinstance(node, ast.Call):
                    bare = isinstance(node.func, ast.Name)
                    name = node.func.id if bare else node.func.attr if isinstance(node.func, ast.Attribute) else None
                    yield "call", k, function.name, name, bare, None


@udtf(returnType="function string, line int, end_line int, loc int, sloc int, params int, cyclomatic int, cognitive int, max_nesting int, error string")
class js_functions:
    """One row for each function of a JavaScript or TypeScript source."""

    def eval(self, source: str):
        try:
            for row in script.measured(source or ""):
                yield (*row, None)
        except (SyntaxError, ValueError, IndexError, KeyError, RecursionError) as e:
            yield (*[None] * 9, f"{type(e).__name__}: {e}")


UDTFS = {"py_functions": py_functions, "py_graph_stats": py_graph_stats, "py_calls": py_calls, "js_functions": js_functions}

#: Folders that a scan leaves out.
SKIPPED_FOLDERS = [".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".mypy_cache", ".pytest_cache", ".tox", "site-packages"]


def source_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Python and JavaScript sources outside skipped folders, with their ``kind``; no typings or minified files."""
    name = F.lower(F.substring_index(path, "/", -1))
    ends = lambda *e: F.array_contains(F.array(*map(F.lit, e)), F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    js = ends(".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx") & ~F.endswith(name, F.lit(".d.ts")) & ~F.contains(name, F.lit(".min."))
    skipped = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    kind = F.when(ends(".py"), "py").when(js, "js")
    return files.where(~skipped).withColumn("kind", kind).where("kind is not null")


def scan(files: DataFrame, source: str = "source") -> DataFrame:
    """A row for each function with its findings; sources that fail have their error instead."""
    py = files.where("kind = 'py'").lateralJoin(py_functions(F.col(source).outer())).drop(source)
    js = files.where("kind = 'js'").lateralJoin(js_functions(F.col(source).outer())).drop(source)
    out = py.unionByName(js)
    return out.withColumn("findings", findings(F.col("loc"), F.col("params"), F.col("cyclomatic"), F.col("cognitive"), F.col("max_nesting")))


def call_graph(files: DataFrame, project: str = "project", path: str = "path", source: str = "source") -> DataFrame:
    """Per project nodes, resolved and unresolved calls, those across files, and the share resolved.

    A call goes to the last definition of its name, else to its name in the module that it is
    imported from.
    """
    # Every source is parsed once: what is found in it is stored, as it is read for definitions, imports and calls.
    rows = Scratch(files.sparkSession, "calls").keep(files.select(project, path, source).lateralJoin(py_calls(F.col(source).outer())).drop(source), "rows")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    defs = rows.where("kind = 'def'").select(project, path, "ord", F.col("name").alias("defined"), F.concat(path, F.lit(":"), "name").alias("target"), stem.alias("stem"))
    last = lambda key: defs.groupBy(project, key.alias("key")).agg(F.max_by("target", F.struct(path, "ord")).alias("found"))
    by_name, by_module = last(F.col("defined")), last(F.concat_ws(".", "stem", "defined"))
    imports = rows.where("kind = 'import'").groupBy(project, path, F.col("name").alias("local")).agg(F.max_by("module", "ord").alias("module_of"))
    calls = rows.where("kind = 'call'").select(project, path, F.concat(path, F.lit(":"), "caller").alias("from"), "name", "bare")
    named = calls.join(by_name.withColumnsRenamed({"key": "name", "found": "direct"}), [project, "name"], "left")
    named = named.join(imports.withColumnRenamed("local", "name"), [project, path, "name"], "left")
    qualified = named.withColumn("key", F.when(F.col("bare"), F.concat_ws(".", "module_of", "name"))).join(by_module, [project, "key"], "left")
    edges = qualified.withColumn("to", F.coalesce("direct", F.when(F.col("module_of").isNotNull(), F.col("found"))))
    file_of = lambda c: F.substring_index(F.substring_index(c, ":", 1), "/", -1)
    summed = edges.groupBy(project).agg(F.count_if(F.col("to").isNotNull()).alias("resolved"), F.count_if(F.col("to").isNull()).alias("unresolved"), F.count_if(file_of("from") != file_of("to")).alias("cross_file"))
    nodes = defs.groupBy(project).agg(F.countDistinct("target").alias("nodes"))
    out = nodes.join(summed, project, "left").fillna(0, ["resolved", "unresolved", "cross_file"])
    share = F.round(F.coalesce(F.try_divide(F.col("resolved"), F.col("resolved") + F.col("unresolved")), F.lit(0.0)), 3)
    return out.withColumn("rate", share)


def graph_sizes(files: DataFrame, project: str = "project", path: str = "path", source: str = "source") -> DataFrame:
    """Sums of the graph sizes of a project's Python files; those that cannot be parsed are counted."""
    rows = files.where(F.endswith(F.lower(path), F.lit(".py"))).select(project, source).lateralJoin(py_graph_stats(F.col(source).outer())).drop(source)
    names = ["ast_nodes", "ast_edges", "cfg_nodes", "cfg_edges", "dfg_nodes", "dfg_edges"]
    return rows.groupBy(project).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.count_if(F.col("error").isNotNull()).alias("failed"))


