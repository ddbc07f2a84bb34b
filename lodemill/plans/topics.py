"""Topics over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemill.operators import topics as T
from lodemill.operators.clustering import density_clusters
from lodemill.operators.neighbours import nearest_graph
from lodemill.registry import query, table
from lodemill.rules.words import ENGLISH
from lodemill.sources.readers import Scratch

CENTERS = "SELECT label, list(v ORDER BY k) AS center FROM (SELECT label, k, avg(v) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k) GROUP BY label"


def _centers(spark, sf_dir):
    return T.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumnRenamed("label", "topic")


@query(
    "j12",
    f"""WITH c AS ({CENTERS}),
    t AS (SELECT vec_id, arg_max(label2, s) AS best, max(s) AS m FROM (SELECT e.vec_id, c.label AS label2, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.center) AS s FROM embeddings e, c WHERE c.label <> 2) GROUP BY vec_id)
    SELECT vec_id, CAST(CASE WHEN m >= 0.2 THEN best ELSE -1 END AS BIGINT) AS topic, round(m, 6) AS similarity FROM t""",
)
def j12(spark, sf_dir):
    """The nearest centre but one, from a threshold."""
    found = T.nearest_topic(table(spark, sf_dir, "embeddings"), _centers(spark, sf_dir), 0.2, (2,))
    return found.withColumn("similarity", F.round("similarity", 6))


@query("t12")
def t12(spark, sf_dir):
    """Topics by neighbours, layout and density: outliers are -1."""
    return T.fit_topics(table(spark, sf_dir, "embeddings"), least=15, rounds=10)


@query("t12_neighbours")
def t12_neighbours(spark, sf_dir):
    """The 30 nearest neighbours of every vector."""
    return nearest_graph(table(spark, sf_dir, "embeddings"), 30)


@query("t12_density")
def t12_density(spark, sf_dir):
    """Density clusters of the events' users by their habits, outliers -1."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("b"), F.log1p(F.count("*")).alias("c"))
    habits = events.select(F.col("user_id").cast("long").alias("vec_id"), F.array(*[F.round(F.coalesce(c, F.lit(0.0)), 6).cast("double") for c in ("a", "b", "c")]).alias("embedding"))
    return density_clusters(habits, least=10, k=15)


@query(
    "t13",
    """WITH m AS (SELECT vec_id, CASE WHEN label = 3 THEN 1 ELSE label END AS t FROM embeddings), n AS (SELECT t, row_number() OVER (ORDER BY count(*) DESC, t) - 1 AS new FROM m WHERE t <> 0 GROUP BY t)
    SELECT vec_id, CAST(coalesce(new, -1) AS INTEGER) AS topic FROM m LEFT JOIN n USING (t)""",
)
def t13(spark, sf_dir):
    """Topics merged, dropped and numbered anew."""
    return T.renumber(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("topic")), {3: 1}, (0,))


@query("t11", "SELECT vec_id, CAST(length(embedding) AS INTEGER) AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def t11(spark, sf_dir):
    """The given vectors, with their size."""
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims"), F.round(F.sqrt(square), 5).alias("norm"))


@query("t11_embed", "SELECT page_id, round(CAST(CAST(n / sqrt(n * n + m * m) AS FLOAT) AS DOUBLE), 5) AS x, round(CAST(CAST(m / sqrt(n * n + m * m) AS FLOAT) AS DOUBLE), 5) AS y FROM (SELECT page_id, CAST(length(html) AS DOUBLE) AS n, CAST(1000 + length(html) - length(replace(html, 'a', '')) AS DOUBLE) AS m FROM pages)")
def t11_embed(spark, sf_dir):
    """Vectors by a given encoder, batched by length and scaled to length one."""
    made = T.embedded(table(spark, sf_dir, "pages"), "page_id", "html", lambda texts: [[len(t), 1000 + t.count("a")] for t in texts])
    return made.select("page_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("x"), F.round(F.col("embedding")[1].cast("double"), 5).alias("y"))


@query("j13", "SELECT d.doc_id, CAST(coalesce(e.label, -1) AS INTEGER) AS topic FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id // 2")
def j13(spark, sf_dir):
    """Rows inherit the topic of the text that stands for them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("canonical"))
    given = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("label").alias("topic"))
    return T.spread_topics(docs, given).select("doc_id", "topic")


#: Letters beyond ASCII as one that stands in no word, so that word ends are those of all letters.
_WORDS = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[\x{80}-\x{10FFFF}]', 'Z', 'g'), '\b[a-z][a-z0-9_-]{2,}\b')"
_TERMS = "list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))"


@query(
    "a29",
    f"""WITH c AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS docs FROM (SELECT lang, doc_id, term, count(*) AS n FROM (SELECT lang, doc_id, unnest({_TERMS}) AS term FROM (SELECT lang, doc_id, {_WORDS} AS w FROM documents)) GROUP BY ALL) GROUP BY ALL),
    p AS (SELECT term, sum(tf) AS f FROM c GROUP BY term HAVING sum(docs) >= 3 AND sum(docs) <= 0.9 * (SELECT count(*) FROM documents)),
    k AS (SELECT c.lang, c.term, c.tf, CAST(p.f AS BIGINT) AS f FROM c JOIN p USING (term)), s AS (SELECT lang, CAST(sum(tf) AS DOUBLE) AS size FROM k GROUP BY lang),
    x AS (SELECT k.*, sqrt(tf / size) * ln(1 + (SELECT avg(size) FROM s) / f) AS score FROM k JOIN s USING (lang))
    SELECT * FROM (SELECT lang, term, tf, f, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(score, 12) DESC, term) AS INTEGER) AS place FROM x) WHERE place <= 10""",
)
def a29(spark, sf_dir):
    """Keywords of each language."""
    return T.keywords(table(spark, sf_dir, "documents"), "lang", "text").withColumn("score", F.round("score", 6))


@query("t12_keywords")
def t12_keywords(spark, sf_dir):
    """The languages' keywords chosen anew by vectors, each unlike those before; a vector counts pairs of letters, in a term or in each of a language's texts."""
    docs = table(spark, sf_dir, "documents").select("lang", F.lower("text").alias("text"))
    scored = Scratch(spark, "candidates").keep(T.keywords(docs, "lang", "text", n=100, stop_words=ENGLISH), "scored")
    vectors = T.embedded(scored.select("term", F.col("term").alias("text")).distinct(), "term", "text", T.letter_pairs)
    return T.refined_keywords(scored, vectors, T.text_centroids(docs, "lang", "text", T.letter_pairs), topic="lang")
