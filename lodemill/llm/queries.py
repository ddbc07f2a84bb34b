"""The operators' queries over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm import conversations, decontaminate, gif, jaccard, langid, lines, ngram_lm, phrases, pii, pieces, sharding, token_files, transducer
from lodemill.llm.common import Shared


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(column: str, n: int):
    """crc32 of an id's text modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


#: Words of the longest n-gram of the query's model.
LM_ORDER = 3


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = ngram_lm.train(docs.where(fold_of("doc_id", 7) != 2), Shared.create(spark, "lm"), order=LM_ORDER)
    keyed = docs.select(F.struct("doc_id", (fold_of("doc_id", 7) == 2).alias("held_out")).alias("key"), "text")
    return ngram_lm.score_texts(keyed, model, id_col="key").select("key.*", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir), details=False)


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    index = decontaminate.build_index(docs, items, Shared.create(spark, "benchmark"))
    return decontaminate.find_contamination(docs, index, keep_items=False)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = lines.line_report(docs, lines.learn(docs, Shared.create(spark, "lines")), keep_text=False)
    return found.withColumn("dropped", F.array_join("dropped", ","))


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(documents(spark, sf_dir), keep_gif=False)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, usable=fold_of("doc_id", 3) != 1)
    held = docs.withColumn("held_out", fold_of("doc_id", 3) == 1)
    # The id carries its fold through the operator, which reads nothing but the text.
    keyed = held.select(F.struct("doc_id", "held_out").alias("key"), "text")
    return langid.identify(keyed, model, id_col="key").select("key.doc_id", "key.held_out", "lang_pred", "score", "rejected")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), Shared.create(spark, "jaccard")).drop("fp", "label")


#: Bytes of text in a shard of the query, at most.
SHARD_LIMIT = 1 << 18


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), SHARD_LIMIT, Shared.create(spark, "shards"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), keep_ids=False)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared.create(spark, "tokens")
    files = token_files.write_files(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), shared, added_tokens=True)
    return token_files.read_files(spark, files, shared, keep_ids=False)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir), Shared.create(spark, "phrases"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.repair(damaged, Shared.create(spark, "conversations"), present=F.col("present"), keep_text=False)


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json")
    return transducer.encode_decode(docs, path, transducer.compile_lexicon(docs, path, Shared.create(spark, "lexicon")), keep_ids=False)


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({decontaminate.WINDOW}, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, n, item_id FROM places JOIN windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {jaccard.SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {jaccard.SHINGLE - 2}), lambda k: array_to_string(w[k:k + {jaccard.SHINGLE - 1}], ' ')) END) AS s FROM d),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat AS a JOIN flat AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {jaccard.SIMILAR} * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least_id AS component_id FROM sets JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) ON a = doc_id"""

PHRASES_SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, {LOWER} AS x FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS p FROM t)),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS k) WHERE len(w) >= k)) GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_phrases AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.k, c.a, h, l.a AS l, r.a AS r, n, (CAST({phrases.SCALE} AS HUGEINT) * c.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS h FROM c) AS c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:h], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[h + 1:c.k], ' ')
  JOIN totals USING (lang)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1),
kept AS (SELECT b.* FROM best AS b LEFT JOIN inner_phrases AS i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < {phrases.SHARE} * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= {phrases.TOP}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kneser_ney, op2_pii, op3_contamination, op4_lines, op5_gif, op6_language, op7_jaccard, op8_sharding, op9_pieces, op10_token_files, op11_phrases, op12_conversations, op13_byte_pairs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_contamination": CONTAMINATION_SQL, "op7_jaccard": JACCARD_SQL, "op8_sharding": sharding.shard_sql(SHARD_LIMIT), "op11_phrases": PHRASES_SQL}
