"""Topics from embeddings: nearest topic, centroids, keywords, renumbering, clustering."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemill.functions.regex import all_matches
from lodemill.operators.numbering import numbered
from lodemill.sources.readers import Scratch


def centroids(rows: DataFrame, topic: str, vector: str) -> DataFrame:
    """Mean vector of each topic, one row a topic; sums are built up in the map tasks."""
    parts = rows.where(F.col(topic).isNotNull()).select(topic, F.posexplode(vector).alias("k", "v")).groupBy(topic, "k").agg(F.avg("v").alias("v"))
    return parts.groupBy(topic).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("center"))


#: Centres of a stored block, rows that meet a block at once, and bytes of blocks that a worker keeps.
BLOCK_CENTERS, ROWS_AT_ONCE, KEPT_BYTES = 4096, 4096, 64 << 20


class _Blocks:
    """The stored blocks of centres, read one by one; the last ones stay in memory as far as they fit."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSelector, FileSystem

        self.fs, top = FileSystem.from_uri(folder)
        self.files = sorted(e.path for e in self.fs.get_file_info(FileSelector(top)) if e.path.endswith(".parquet"))
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for path in self.files:
            if path in self.held:
                yield self.held[path]
                continue
            with self.fs.open_input_file(path) as f:
                rows = pq.read_table(f, columns=["topic", "center"])
            if not rows.num_rows:
                continue
            matrix = rows.column("center").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            block = (rows.column("topic").to_numpy(), matrix)
            if self.size + matrix.nbytes <= KEPT_BYTES:
                self.held[path] = block
                self.size += matrix.nbytes
            yield block


_blocks: dict[str, _Blocks] = {}


def _of_length_one(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.square(x).sum(-1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def nearest_topic(rows: DataFrame, topics: DataFrame, threshold: float, excluded: tuple[int, ...] = (), id_col: str = "vec_id", vector: str = "embedding", topic: str = "topic", center: str = "center") -> DataFrame:
    """Each row's most similar topic by cosine, or -1 below the threshold; ``id_col``, ``topic``, ``similarity``.

    Centres are stored in blocks; a worker multiplies its rows with one block after another and keeps
    each row's best, so there may be any number of them. What comes within a rounding of a
    block's best is measured again, alike for all blocks: ties go to the smaller topic. Vectors
    of no length are similar to nothing; rows without a vector, or where there are no topics, get -1 and null.
    """
    kept = topics.where(~F.col(topic).isin(list(excluded))) if excluded else topics
    scratch = Scratch(rows.sparkSession, "centers")
    named = kept.where(F.col(topic).isNotNull() & F.col(center).isNotNull()).select(F.col(topic).cast("long").alias("topic"), F.col(center).cast("array<double>").alias("center"))
    stored = named.mapInArrow(_scaled, "topic long, center array<double>")
    stored.write.mode("overwrite").option("maxRecordsPerFile", BLOCK_CENTERS).parquet(f"{scratch.folder}/blocks")
    folder = f"{scratch.folder}/blocks" if "://" in scratch.folder else f"file://{scratch.folder.removeprefix('file:')}/blocks"

    def run(batches) -> Iterator[pa.RecordBatch]:
        if folder not in _blocks:
            _blocks.clear()
            _blocks[folder] = _Blocks(folder)
        for held in _many_rows(batches):
            ok = held.column(1).is_valid().to_numpy(zero_copy_only=False)
            best, score = np.full(len(ok), -1, np.int64), np.full(len(ok), np.nan)
            if ok.any():
                x = _of_length_one(held.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(ok.sum()), -1))
                top, name = np.full(len(x), -np.inf), np.full(len(x), -1, np.int64)
                for names, matrix in _blocks[folder]:
                    s = x @ matrix.T
                    near_row, near = np.nonzero(s >= np.maximum(s.max(1), top)[:, None] - 1e-9)
                    exact, told = (x[near_row] * matrix[near]).sum(-1), names[near]
                    order = np.lexsort((told, -exact, near_row))
                    first = order[np.concatenate(([True], np.diff(near_row[order]) > 0))] if len(order) else order
                    r, e, t = near_row[first], exact[first], told[first]
                    better = (e > top[r]) | (e == top[r]) & (t < name[r])
                    top[r[better]], name[r[better]] = e[better], t[better]
                if np.isfinite(top).all():
                    score[ok] = top
                    best[ok] = np.where(top >= threshold, name, -1)
            yield pa.RecordBatch.from_pydict({id_col: held.column(0), "topic": pa.array(best), "similarity": pa.array(score, mask=np.isnan(score))})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, vector).mapInArrow(run, f"`{id_col}` {kind}, topic long, similarity double")


def _scaled(batches) -> Iterator[pa.RecordBatch]:
    """Centres of length one."""
    for b in batches:
        if b.num_rows:
            x = _of_length_one(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], names=["topic", "center"])


def _many_rows(batches) -> Iterator[pa.RecordBatch]:
    """Batches of as many rows as meet a block at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def embedded(rows: DataFrame, id_col: str, text: str, encode, batch: int = 256, partitions: int | None = None) -> DataFrame:
    """A vector of length one for each text: ``id_col`` and ``embedding`` (floats).

    ``encode`` takes a list of texts and gives an array of a row for each; it is called with
    batches of texts of like length, and with none is a null text, which has no vector. A zero
    vector stays so.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for first in range(0, held.num_rows, batch):
                part = held.slice(first, batch)
                texts = part.column(1).to_pylist()
                known = [t for t in texts if t is not None]
                vectors = iter(())
                if known:
                    x = np.asarray(encode(known), np.float64)
                    n = np.linalg.norm(x, axis=1, keepdims=True)
                    vectors = iter(np.divide(x, n, out=np.zeros_like(x), where=n > 0).astype(np.float32))
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "embedding": pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float32()))})

    from lodemill.operators.sampling import by_length

    dealt = by_length(rows.select(id_col, text), text, partitions) if partitions else rows.select(id_col, text).sortWithinPartitions(F.length(text))
    return dealt.mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")


#: Pairs of letters, units of a sum for a vector of length one, and topics whose sums a task holds before it passes them on.
PAIRS, UNITS, SUMS_AT_ONCE = 26 * 26, 1 << 32, 4096


def letter_pairs(texts: list[str]) -> np.ndarray:
    """An encoder without a model: how often each pair of letters, from a to z, stands side by side in a text."""
    out = np.zeros((len(texts), PAIRS))
    for row, text in zip(out, texts, strict=True):
        a = np.frombuffer(text.encode(), np.uint8) - np.uint8(97)  # what is below a wraps round
        both = (a[:-1] < 26) & (a[1:] < 26)
        row += np.bincount(a[:-1][both] * np.int64(26) + a[1:][both], minlength=PAIRS)
    return out


def text_centroids(rows: DataFrame, topic: str, text: str, encode, batch: int = 256) -> DataFrame:
    """The mean vector of all texts of each topic, one row a topic: ``topic`` and ``center``.

    ``encode`` is as in ``embedded``, and a text's vector of length one likewise; null texts have none.
    Sums are built up in the map tasks, in whole numbers, so that their order does not change them.
    """
    kind = rows.schema[topic].dataType.simpleString()

    def told(held: dict, of: pa.DataType) -> pa.RecordBatch:
        sums, n = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_pydict({topic: pa.array(list(held), of), "sums": pa.array(sums, pa.list_(pa.int64())), "n": pa.array(n, pa.int64())})

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            of = b.schema.field(0).type
            for first in range(0, b.num_rows, batch):
                part = b.slice(first, batch)
                x = np.rint(_of_length_one(np.asarray(encode(part.column(1).to_pylist()), np.float64)) * UNITS).astype(np.int64)
                for t, v in zip(part.column(0).to_pylist(), x, strict=True):
                    before, n = held.get(t, (0, 0))
                    held[t] = (before + v, n + 1)
                if len(held) >= SUMS_AT_ONCE:
                    yield told(held, of)
                    held = {}
        if held:
            yield told(held, of)

    known = rows.where(F.col(topic).isNotNull() & F.col(text).isNotNull()).select(topic, text)
    parts = known.mapInArrow(run, f"`{topic}` {kind}, sums array<long>, n long").select(topic, "n", F.posexplode("sums").alias("k", "v"))
    means = parts.groupBy(topic, "k").agg((F.sum("v") / F.sum("n") / UNITS).alias("v"))
    return means.groupBy(topic).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("center"))


def reassign_outliers(rows: DataFrame, topics: DataFrame, threshold: float, excluded: tuple[int, ...] = (), id_col: str = "vec_id", vector: str = "embedding", topic: str = "topic") -> DataFrame:
    """Only rows without a topic (-1) get their nearest one."""
    near = nearest_topic(rows.where(F.col(topic) == -1), topics, threshold, excluded, id_col, vector).select(id_col, F.col("topic").alias("__t"))
    return rows.join(near, id_col, "left").withColumn(topic, F.coalesce("__t", topic)).drop("__t")


def renumber(rows: DataFrame, merged: dict[int, int], dropped: tuple[int, ...] = (), topic: str = "topic") -> DataFrame:
    """Topics merged and dropped, the rest numbered anew from 0 by size, then by number."""
    new = F.col(topic)
    for a, b in merged.items():
        new = F.when(F.col(topic) == a, b).otherwise(new)
    kept = rows.withColumn("__t", F.when(new.isin(list(dropped)) | (new < 0), -1).otherwise(new))
    sizes = kept.where("__t >= 0").groupBy("__t").agg(F.count("*").alias("n"))
    new = numbered(sizes.withColumn("__fewer", -F.col("n")), ["__fewer", "__t"], "__new").select("__t", F.col("__new").cast("int").alias("__new"))
    return kept.join(new, "__t", "left").withColumn(topic, F.coalesce("__new", F.lit(-1))).drop("__t", "__new")


#: Characters of text for each part of the terms, and distinct terms that a task counts before it passes them on.
PART_CHARS, TERMS_AT_ONCE = 8 << 20, 1 << 20
#: Topics whose sizes are sent to every task.
FEW_TOPICS = 100_000
#: A term's number of texts stands above its count.
_TEXT = 1 << 64


def _terms(parts: int):
    """Words and pairs of them with their counts and numbers of texts: a row for a topic and a part of the terms, by their hashes."""

    def passed_on(held: dict) -> Iterator[list[tuple]]:
        rows = []
        for topic, counts in held.items():
            dealt: dict[int, list[str]] = {}
            for t in counts:
                dealt.setdefault(crc32(t.encode()) % parts, []).append(t)
            for part, terms in dealt.items():
                terms.sort()  # like terms beside each other, for the shuffle's compression
                rows.append((part, topic, " ".join(t.replace(" ", "+") for t in terms), [counts[t] % _TEXT for t in terms], [counts[t] // _TEXT for t in terms]))
        for first in range(0, len(rows), 1000):
            yield rows[first : first + 1000]

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in batches:
            kind = b.schema.field(0).type
            for topic, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not text:
                    continue
                w = text.split(" ")
                counts = held.setdefault(topic, {})
                size -= len(counts)
                for t, n in Counter(chain(w, map(" ".join, pairwise(w)))).items():
                    counts[t] = counts.get(t, 0) + n + _TEXT
                size += len(counts)
                if size >= TERMS_AT_ONCE:
                    yield from map(partial(_batch, kind), passed_on(held))
                    held, size = {}, 0
        if size:
            yield from map(partial(_batch, kind), passed_on(held))

    return run


def _batch(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    part, topic, terms, tf, docs = zip(*rows, strict=True)
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(topic, kind), pa.array(terms, pa.string()), pa.array(tf, longs), pa.array(docs, longs)], names=["part", "topic", "terms", "tf", "docs"])


def _kept_terms(least: int, most: float):
    """Each topic's terms that stand in so many texts of all topics: ``topic``, ``term``, ``tf``, and ``f`` over all topics."""

    def settled(held: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        every: dict[str, int] = {}
        for counts in held.values():
            for t, n in counts.items():
                every[t] = every.get(t, 0) + n
        for topic, counts in held.items():
            terms = [t for t in counts if least <= every[t] // _TEXT <= most]
            yield pa.RecordBatch.from_arrays([pa.array([topic] * len(terms), kind), pa.array([t.replace("+", " ") for t in terms], pa.string()), pa.array([counts[t] % _TEXT for t in terms], pa.int64()), pa.array([every[t] % _TEXT for t in terms], pa.int64())], names=["topic", "term", "tf", "f"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            kind = b.schema.field(1).type
            for k in range(b.num_rows):
                part, topic, terms, tf, docs = (c[k].as_py() for c in b.columns)
                if part != now:
                    if held:
                        yield from settled(held, kind)
                    now, held = part, {}
                counts = held.setdefault(topic, {})
                for t, n, d in zip(terms.split(" "), tf, docs, strict=True):
                    counts[t] = counts.get(t, 0) + n + d * _TEXT
        if held:
            yield from settled(held, kind)

    return run


def keywords(rows: DataFrame, topic: str, text: str, least_docs: int = 3, most_share: float = 0.9, n: int = 10, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Class-based tf-idf: the square root of a term's share of the topic's terms times log(1 + A / f).

    f is the term's count over all topics and A the mean number of terms in a topic. Terms are
    words of three characters and more and pairs of them; those in too few or too many texts go.
    """
    words = F.filter(all_matches(F.lower(F.col(text)), r"\b[a-z][a-z0-9_-]{2,}\b"), lambda w: ~w.isin(list(stop_words)) if stop_words else F.lit(True))
    known = rows.agg(F.count("*").alias("docs"), F.sum(F.length(text)).alias("chars")).first()
    parts, most = max(8, (known["chars"] or 0) // PART_CHARS), most_share * known["docs"]
    kind = next(t for c, t in rows.dtypes if c == topic)
    # A shuffle row holds many terms: a row for each would weigh several times the texts.
    told = rows.select(F.col(topic).alias("topic"), F.array_join(words, " ").alias("w")).mapInArrow(_terms(parts), f"part int, topic {kind}, terms string, tf array<long>, docs array<long>")
    dealt = told.repartition(parts, "part").sortWithinPartitions("part")
    merged = dealt.mapInArrow(_kept_terms(least_docs, most), f"topic {kind}, term string, tf long, f long")
    kept = Scratch(rows.sparkSession, "keywords").keep(merged, "kept").withColumnRenamed("topic", topic)
    sizes = kept.groupBy(topic).agg(F.sum("tf").alias("size"))
    mean = sizes.agg(F.avg("size").alias("a"))
    if sizes.count() <= FEW_TOPICS:  # else all terms of a topic would meet in one task
        sizes = F.broadcast(sizes)
    scored = kept.join(sizes, topic).crossJoin(F.broadcast(mean)).withColumn("score", F.sqrt(F.col("tf") / F.col("size")) * F.log(1 + F.col("a") / F.col("f")))
    place = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc(F.round("score", 12)), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= n).select(topic, "term", "tf", "f", "score", "place")


def refined_keywords(scored: DataFrame, vectors: DataFrame, topics: DataFrame, topic: str = "topic", candidates: int = 30, diversity: float = 0.3, n: int = 10, term: str = "term", vector: str = "embedding", center: str = "center") -> DataFrame:
    """A topic's keywords by likeness to it, each as unlike those before as ``diversity`` asks: ``topic``, ``place``, ``term``, ``likeness``.

    ``scored`` has each topic's terms with their ``place`` by class-based tf-idf, ``vectors`` a vector for each term, ``topics`` one for each
    topic. Of a topic's first terms the ``candidates`` most like its vector are taken; the first keyword
    is the likest, then comes, again and again, the term with the most of (1 - diversity) times its
    likeness minus diversity times its greatest likeness to a keyword chosen before. Ties go by term. Terms without a vector are
    left out. A topic's candidates are one small group, bounded by ``candidates``.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = lambda c: F.when(dot(c, c) > 0, F.transform(c, lambda x: x / F.sqrt(dot(c, c)))).otherwise(c)
    words = vectors.where(F.col(vector).isNotNull()).select(F.col(term).alias("term"), unit(F.col(vector).cast("array<double>")).alias("v"))
    middles = topics.where(F.col(center).isNotNull()).select(F.col(topic).alias("topic"), unit(F.col(center).cast("array<double>")).alias("c"))
    held = scored.select(F.col(topic).alias("topic"), F.col(term).alias("term")).join(words, "term").join(middles, "topic")
    like = held.select("topic", "term", "v", F.round(dot(F.col("v"), F.col("c")), 9).alias("likeness"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("likeness"), "term"))
    few = like.withColumn("at", place).where(F.col("at") <= candidates)
    kind = few.schema["topic"].dataType.simpleString()

    def choose(key, group):
        group = group.sort_by("at")
        terms, score = group.column("term").to_pylist(), group.column("likeness").to_numpy()
        x = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(terms), -1)
        between = np.round(x @ x.T, 9)
        chosen = [0]
        while len(chosen) < min(n, len(terms)):
            left = [k for k in range(len(terms)) if k not in chosen]
            worth = np.round((1 - diversity) * score[left] - diversity * between[np.ix_(left, chosen)].max(1), 9)
            chosen.append(min(zip(-worth, [terms[k] for k in left], left, strict=True))[2])
        return pa.table({"topic": pa.array([key[0].as_py()] * len(chosen), group.schema.field("topic").type), "place": pa.array(range(1, len(chosen) + 1), pa.int32()), "term": [terms[k] for k in chosen], "likeness": score[chosen]})

    return few.groupBy("topic").applyInArrow(choose, f"topic {kind}, place int, term string, likeness double")


def fit_topics(rows: DataFrame, least: int = 100, samples: int = 5, neighbours: int = 30, dims: int = 5, rounds: int = 20, seed: int = 42, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Topics by a neighbour graph, a layout of few dimensions and density clusters: ``id_col`` and ``topic``, -1 for outliers."""
    from lodemill.operators.clustering import density_clusters
    from lodemill.operators.layout import layout
    from lodemill.operators.neighbours import nearest_graph

    known = rows.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    graph = nearest_graph(known, neighbours, "cosine", id_col, vector, seed)
    places = layout(known, graph, dims, rounds, seed, id_col, vector)
    return density_clusters(places, least, samples, neighbours, "euclidean", id_col, "place", seed)


def spread_topics(rows: DataFrame, assigned: DataFrame, canonical: str = "canonical", id_col: str = "ord") -> DataFrame:
    """Every row gets the topic of the text that stands for it; without one -1."""
    named = assigned.select(F.col(id_col).alias(canonical), "topic")
    return rows.join(named, canonical, "left").withColumn("topic", F.coalesce("topic", F.lit(-1)))
