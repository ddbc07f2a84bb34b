"""Ranking, sorting, sampling, set operations and joins over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemill.operators import dedupe, linking, sampling, stats
from lodemill.registry import query, table


@query("r01", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def r01(spark, sf_dir):
    """The highest row of each key, ties to the first."""
    return dedupe.keep_one(table(spark, sf_dir, "customer"), ["c_nationkey"], [-F.col("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("r02", "SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, length(p_name), p_partkey) AS r FROM part) WHERE r = 1")
def r02(spark, sf_dir):
    """The best row of each cell by rank, length and id."""
    return dedupe.keep_one(table(spark, sf_dir, "part"), ["p_brand", "p_type"], [F.col("p_size"), F.length("p_name"), F.col("p_partkey")]).select("p_brand", "p_type", "p_partkey")


@query("r03", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS r FROM orders) WHERE r = 1")
def r03(spark, sf_dir):
    """The best duplicate by split, then id."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return dedupe.keep_one(table(spark, sf_dir, "orders"), ["o_custkey"], [rank, F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("r04", "SELECT source, arg_min(doc_id, length(text) * 100000000 + doc_id) AS doc_id FROM documents GROUP BY source")
def r04(spark, sf_dir):
    """The shortest of each group."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(F.length("text"), "doc_id")).alias("doc_id"))


@query(
    "r05",
    """SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY r) AS best FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)
    WHERE r <= 5 GROUP BY s_nationkey""",
)
def r05(spark, sf_dir):
    """The top five as text."""
    best = dedupe.top_n(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 5)
    return best.groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "s_name"))), lambda s: s["s_name"]), ", ").alias("best"))


@query("r07", "SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS place FROM part GROUP BY p_brand")
def r07(spark, sf_dir):
    """Values by frequency, ties by first sight."""
    from pyspark.sql import Window

    counted = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("seen"))
    return counted.select("p_brand", "n", F.row_number().over(Window.orderBy(F.desc("n"), "seen")).cast("long").alias("place"))


@query("r08", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 20")
def r08(spark, sf_dir):
    """The first twenty of each class."""
    return dedupe.top_n(table(spark, sf_dir, "events"), ["event_type"], [F.col("event_id")], 20).select("event_type", "event_id")


@query("r09", "SELECT user_id, first, last FROM (SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id)")
def r09(spark, sf_dir):
    """First-seen and last-seen values."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"), F.max_by("event_type", "event_id").alias("last"))


@query("r10", "SELECT c_mktsegment, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM customer GROUP BY 1")
def r10(spark, sf_dir):
    """Percentages of the total."""
    from lodemill.operators.metrics import category_shares

    return category_shares(table(spark, sf_dir, "customer"), "c_mktsegment").select("c_mktsegment", "pct")


@query(
    "l01",
    """SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, coalesce(TRY_CAST(left(o_orderpriority, 1) AS INTEGER), 0) DESC, o_orderkey) AS place
    FROM orders ORDER BY place LIMIT 100""",
)
def l01(spark, sf_dir):
    """A custom order, then numbers in text from the largest."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    number = F.coalesce(F.substring("o_orderpriority", 1, 1).try_cast("int"), F.lit(0))
    top = table(spark, sf_dir, "orders").orderBy(rank, F.desc(number), "o_orderkey").limit(100)
    from pyspark.sql import Window

    return top.select("o_orderkey", F.row_number().over(Window.orderBy(rank, F.desc(number), "o_orderkey")).cast("long").alias("place"))


@query("l02", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def l02(spark, sf_dir):
    """Several sort keys."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@query("l03", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15")
def l03(spark, sf_dir):
    """The top fifteen."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(15)


@query("l04", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def l04(spark, sf_dir):
    """The first rows in an explicit order."""
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(50)


_TURN = "md5(concat('42|', CAST(doc_id AS VARCHAR)))"


@query("l05", f"SELECT doc_id, lang FROM documents ORDER BY {_TURN}, doc_id LIMIT 50")
def l05(spark, sf_dir):
    """A seeded sample."""
    return sampling.seeded(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


@query("l06")
def l06(spark, sf_dir):
    """A sample balanced by repository, folder and name."""
    from lodemill.plans.fixtures import files

    return sampling.balanced(files(spark, sf_dir).select("repository", "path", "ord"), 12, 4)


@query(
    "l07",
    """WITH s AS (SELECT *, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS s FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY s) AS n, [10, 20, 20][s + 1] AS k FROM s),
    m AS (SELECT *, greatest(1, n // k) AS step FROM p), t AS (SELECT *, i % step = 0 AND i // step < k AS pick FROM m)
    SELECT doc_id FROM t ORDER BY CASE WHEN pick THEN 0 ELSE 1 END, CASE WHEN pick THEN s END, doc_id LIMIT 50""",
)
def l07(spark, sf_dir):
    """An audit sample by strides."""
    lang = F.col("lang")
    return sampling.strided(table(spark, sf_dir, "documents").select("doc_id", "lang"), [(lang == "en", 10), (lang == "de", 20), (~lang.isin("en", "de"), 20)], "doc_id", 50).select("doc_id")


@query("l08", f"SELECT doc_id, lang FROM documents WHERE lang <> 'en' OR lang IS NULL UNION ALL (SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY {_TURN}, doc_id LIMIT 40)")
def l08(spark, sf_dir):
    """One dominant group cut to a number."""
    return sampling.cap_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("lang") == "en", "doc_id", 40)


@query("l09", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents")
def l09(spark, sf_dir):
    """Rows of like length together."""
    return sampling.by_length(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 8).select("doc_id", F.length("text").alias("n"))


@query(
    "u01",
    """SELECT k, source_rank FROM (SELECT c_custkey AS k, 0 AS source_rank FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier UNION ALL SELECT p_partkey, 2 FROM part)""",
)
def u01(spark, sf_dir):
    """An ordered union."""
    one = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("k"))
    return dedupe.union_ranked(one("customer", "c_custkey"), one("supplier", "s_suppkey"), one("part", "p_partkey"))


@query("u02", "SELECT c_custkey AS k, c_mktsegment AS segment, NULL AS brand, 0 AS source_rank FROM customer UNION ALL SELECT p_partkey, NULL, p_brand, 1 FROM part")
def u02(spark, sf_dir):
    """A union of tables with different columns."""
    return dedupe.union_ranked(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"))).select("k", "segment", "brand", "source_rank")


@query("u08", "SELECT k, src FROM (SELECT k, src, row_number() OVER (PARTITION BY k ORDER BY src) AS r FROM (SELECT o_custkey AS k, 0 AS src FROM orders UNION ALL SELECT c_custkey, 1 FROM customer)) WHERE r = 1")
def u08(spark, sf_dir):
    """One row for each id, the first table's before the second's."""
    both = dedupe.union_ranked(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    return dedupe.keep_one(both, ["k"], [F.col("source_rank")]).select("k", F.col("source_rank").alias("src"))


@query("u10", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u10(spark, sf_dir):
    """Keys that never occur."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("u12", "SELECT key, n FROM (SELECT lower(c_mktsegment) AS key, min(c_custkey) AS n FROM customer GROUP BY 1)")
def u12(spark, sf_dir):
    """One row for each name without regard to case."""
    rows = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("key"), F.col("c_custkey").alias("n"))
    return dedupe.keep_one(rows, ["key"], [F.col("n")])


@query(
    "u13",
    """SELECT conv_id, turn, 'vulnerable' AS label, concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR), '_VULN') AS case_id, role AS code FROM conversations
    UNION ALL SELECT conv_id, turn, 'safe', concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR), '_FIXED'), CAST(length(text) AS VARCHAR) FROM conversations""",
)
def u13(spark, sf_dir):
    """A pair row becomes two rows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("a"), F.length("text").cast("string").alias("b"))
    return dedupe.both_sides(rows, "a", "b", "id").drop("id")


@query(
    "j03",
    """SELECT n.n_name AS name, coalesce(s.n, '') AS sup_n, coalesce(s.top, '') AS sup_top, coalesce(c.n, '') AS cus_n FROM nation n
    LEFT JOIN (SELECT n_name, CAST(count(*) AS VARCHAR) AS n, max(s_name) AS top FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) s ON s.n_name = n.n_name
    LEFT JOIN (SELECT n_name, CAST(count(*) AS VARCHAR) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) c ON c.n_name = n.n_name""",
)
def j03(spark, sf_dir):
    """A wide merge by name with prefixes."""
    nation = table(spark, sf_dir, "nation")
    sup = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"), F.max("s_name").alias("top")).withColumn("ord", F.lit(0))
    cus = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n")).withColumn("ord", F.lit(0))
    return linking.wide_merge(nation.select(F.col("n_name").alias("name")), [("sup_", sup), ("cus_", cus)], "name")


@query("j04", "SELECT c_custkey, o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j04(spark, sf_dir):
    """A left merge with the first match."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", F.col("o_orderkey").alias("ord"))
    return linking.merge_first(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("j11", "SELECT r_name, l FROM region, (VALUES ('python'), ('javascript')) AS t(l) WHERE NOT (r_name = 'ASIA' AND l = 'python')")
def j11(spark, sf_dir):
    """All cells of two small dimensions but those to skip."""
    left = table(spark, sf_dir, "region").select("r_name")
    return linking.cells(left, spark.createDataFrame([("python",), ("javascript",)], "l string"), spark.createDataFrame([("ASIA", "python")], "r_name string, l string"))


@query("a25", "SELECT p_brand, p_size, cell_n FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS cell_n FROM part) WHERE cell_n >= 2")
def a25(spark, sf_dir):
    """Rows of cells with two at least."""
    return stats.cell_counts(table(spark, sf_dir, "part"), ["p_brand", "p_size"], 2).select("p_brand", "p_size", "cell_n")
