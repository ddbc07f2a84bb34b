"""Columns that queries derive from the given tables, in SQL that both Spark and the oracle read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


_WORD = "coalesce(regexp_extract(d.text, '[a-z]+', 0), '')"


def dealt(rows: str, names: str, own: tuple[str, ...] = (), mix: tuple[str, ...] = (), of: int | None = None, casts: dict[str, str] | None = None) -> str:
    """A row for each document: kinds of rows in turn, ``of`` documents (as many as there are kinds) being a group.

    ``id`` and ``ord`` are the document's id; columns ``own`` carry the group's number, so that keys are those of a
    group; columns ``mix`` carry a word of the document's text in every other group.
    """
    columns = [x.strip() for x in names.split(",")]
    kinds = _split_rows(rows)
    of = of or len(kinds)
    group = f"CAST(floor(d.doc_id / {of}.0) AS BIGINT)"
    out = []
    for c in columns:
        x = f"t.{c}"
        if c in ("id", "ord"):
            x = "d.doc_id"
        elif c in own:
            x = f"{x} || '-' || CAST({group} AS VARCHAR)"
        elif c in mix:
            x = f"CASE WHEN {group} % 2 = 0 THEN {x} || ' ' || {_WORD} ELSE {x} END"
        out.append(f"CAST({x} AS {casts[c]}) AS {c}" if c in (casts or {}) else f"{x} AS {c}")
    first = ("id",) if columns[0] != "id" else ()
    listed = ", ".join(f"({k}{', ' if first else ', '}{r if first else r.split(',', 1)[1]})" for k, r in enumerate(kinds))
    rest = columns if first else columns[1:]
    return f"SELECT {', '.join(out)} FROM documents AS d JOIN (SELECT * FROM (VALUES {listed}) AS v(kind__, {', '.join(rest)})) AS t ON t.kind__ = d.doc_id % {of}"


def _split_rows(rows: str) -> list[str]:
    """The inside of each parenthesized row of a VALUES list; strings may hold parentheses."""
    out, depth, quoted, start = [], 0, False, 0
    for k, ch in enumerate(rows):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch == "(":
            depth += 1
            start = k + 1 if depth == 1 else start
        elif not quoted and ch == ")":
            depth -= 1
            if not depth:
                out.append(rows[start:k])
    return out


def table_of(spark: SparkSession, sql: str, sf_dir: str) -> DataFrame:
    """A query over ``documents AS d`` that both engines read."""
    place = f"{sf_dir}/documents.parquet".replace("`", "``")
    return spark.sql(sql.replace("documents AS d", f"parquet.`{place}` AS d").replace("AS VARCHAR)", "AS STRING)"))


def with_fixture(name: str, fixture: str, query: str) -> str:
    """The oracle's form of a query over a fixture."""
    return f"WITH {name} AS ({fixture}) {query}"


#: Documents as files of a repository: the source is the repository.
FILES = """SELECT source AS repository, CASE WHEN doc_id % 5 = 0 THEN concat('Doc', CAST(doc_id % 40 AS VARCHAR(9)), '.md')
  WHEN doc_id % 5 = 1 THEN concat(lang, '/v1.', CAST(doc_id % 3 AS VARCHAR(9)), '/doc', CAST(doc_id % 40 AS VARCHAR(9)), '.md')
  ELSE concat(lang, '/doc', CAST(doc_id % 40 AS VARCHAR(9)), '.', CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'rst' END) END AS path,
  text, lang, doc_id AS ord FROM documents"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(FILES.replace("VARCHAR(9)", "STRING").replace("FROM documents", "FROM {docs}"), docs=docs)
