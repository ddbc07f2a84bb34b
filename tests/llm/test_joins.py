"""Joins over texts against plain Python: nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemill.llm import decontaminate, jaccard, lines, ngram_lm, runs, sharding
from lodemill.llm.common import Shared

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


@pytest.fixture(scope="module")
def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


def words(rng, n, alphabet=("a", "b", "C", "dé", "É1")):
    return " ".join(rng.choice(alphabet) + rng.choice(["", ".", " ;"]) for _ in range(n))


def contamination(spark, docs, items, **more):
    d = spark.createDataFrame(docs, DOC).withColumn("n_words", F.lit("clash")).withColumn("block", F.lit(None).cast("int"))
    index = decontaminate.build_index(d, spark.createDataFrame(items, ITEM), Shared.create(spark, "t"), **more)
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(d, index).collect()} == {r["doc_id"] for r in decontaminate.find_contamination(d, index).where("not contaminated").collect()}
    return sorted((tuple(r) for r in decontaminate.find_contamination(d, index, keep_items=False).collect()), key=str)


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 20), (2, 60)])
def test_decontamination(spark, seed, block):
    rng = random.Random(seed)
    docs = [(k, words(rng, rng.randrange(60))) for k in range(60)] + [(None, None), (7, ""), (7, "")]
    items = [(k, words(rng, rng.choice([1, 4, 5, 6, 9, 10, 11, 14]) if seed == 1 else rng.choice([5, 10, 14]))) for k in range(20)]
    items += [(99, None), (98, "..."), (3, "a b c1 dé"), (None, "a")]
    assert contamination(spark, docs, items, block_bytes=block) == brute.hit_words(docs, items)


def test_decontamination_of_sample(spark, sample):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    got = contamination(spark, sample, items)
    assert got == brute.hit_words(sample, items)
    assert any(r[-1] for r in got)


def test_decontamination_of_nothing(spark):
    assert contamination(spark, [], [(1, "a b")]) == []
    assert contamination(spark, [(1, "a b")], []) == brute.hit_words([(1, "a b")], [])


def report(spark, docs, **more):
    d = spark.createDataFrame(docs, DOC).withColumn("n_lines", F.lit(1))
    found = lines.line_report(d, lines.learn(d, Shared.create(spark, "t"), **more), keep_text=False)
    return sorted(((a, b, c, tuple(p), s) for a, b, c, p, s in map(tuple, found.collect())), key=str)


def test_line_dedup(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 3, 4, 6, 9, 10, 11, 15, 40]))] for _ in range(30)]

    def line():
        w = rng.choice(base)[:]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice([[], ["x"], ["B"]])
        return rng.choice([" ", "  ", "\t"]).join(w)

    docs = [(rng.choice([k, k, k, 5]), "\n".join(line() for _ in range(rng.randrange(1, 8)))) for k in range(120)]
    docs += [(None, None), (7, ""), (7, ""), (None, "a b c d e\n\na b c d e"), *docs[:3]]
    assert report(spark, docs) == brute.dropped_lines(docs)
    assert report(spark, docs, same_words=2, near_words=8) == brute.dropped_lines(docs, 2, 8)


def test_line_dedup_in_many_runs(spark, sample, monkeypatch):
    # Runs as short as batches, folded in every step: workers get the number with the function's module.
    monkeypatch.setattr(lines, "RUN", 10)
    blobs = lines.Held(4)
    every = []
    for k in range(30):
        h, keys = np.arange(k, k + 50, dtype=np.uint64) << np.uint64(58), np.full(50, k // 2, np.uint64)
        blobs.add(h, keys, np.zeros(50, np.int8))
        every += blobs.runs(10)
    got = {s: lines._shared_ones(b for t, b in every if t == s)[0] for s in range(4)}
    holders = {}
    for k in range(30):
        for x in range(k, k + 50):
            holders.setdefault((x << 58) % (1 << 64), set()).add(k // 2)
    assert sorted({int(x) for g in got.values() for x in g}) == sorted(h for h, c in holders.items() if len(c) > 1)


def test_line_dedup_of_sample(spark, sample):
    assert report(spark, sample) == brute.dropped_lines(sample)
    assert report(spark, []) == []


def test_dropping_lines(spark):
    d = spark.createDataFrame([(1, "a b c d\nx", 9, None), (2, "a b c d", 7, "k"), (3, "A  B c D\nnew", 5, None), (4, None, None, None), (5, "", 0, None)], DOC + ", n_chars long, lang string")
    kept = lines.drop_lines(d, lines.learn(d, Shared.create(spark, "t")))
    assert kept.columns == d.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d\nx", 9, None), (3, "new", 3, None), (4, None, None, None), (5, "", 0, None)], key=str)


def test_short_lines_go(spark):
    docs = [(1, "a b\nx\n\np q r s"), (2, "A  b\ny\n\np q r t"), (3, "x\n\np q r s u v w x y"), (4, "p q r s u v w x z\na c")]
    assert [(k, places) for k, _, _, places, _ in report(spark, docs)] == [(1, ()), (2, (0, 3)), (3, (0,)), (4, (0,))]
    assert report(spark, docs) == brute.dropped_lines(docs)


def groups(spark, docs, **more):
    d = spark.createDataFrame(docs, DOC).withColumn("n", F.lit("x")).withColumn("fp", F.lit(1))
    return sorted((tuple(r)[:3] for r in jaccard.jaccard_components(d, Shared.create(spark, "t"), **more).collect()), key=str)


@pytest.mark.parametrize(("seed", "block"), [(3, 8 << 20), (4, 1000), (5, 2000)])
def test_jaccard_components(spark, seed, block):
    rng, docs = random.Random(seed), []
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnop") for _ in range(rng.choice([3, 6, 30, 80]))]
        for _ in range(rng.randrange(1, 12)):
            w = base[:]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice("abcdefghijklmnop")
            docs.append((len(docs) + 100, " ".join(w)))
    docs += [(None, None), (3, ""), (3, " \n"), (None, docs[0][1]), docs[1], (1, docs[5][1].upper())]
    assert groups(spark, docs, block_bytes=block) == brute.jaccard_groups(docs)


def test_deals_of_a_few_parts(spark, sample, monkeypatch):
    """The shards of both joins reached by three deals."""
    monkeypatch.setattr(runs, "FAN", 4)
    docs = [*sample[:120], (None, sample[3][1]), (10**6, sample[5][1])]
    assert report(spark, docs) == brute.dropped_lines(docs)
    assert groups(spark, docs) == brute.jaccard_groups(docs)


def test_jaccard_of_nothing(spark):
    assert groups(spark, []) == []


def test_keep_first(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (3, None), (4, "q r s t u v"), (None, "q r s t u v")], DOC)
    kept = sorted(map(tuple, jaccard.keep_first(d, Shared.create(spark, "t")).collect()), key=str)
    assert kept == sorted([(1, "a b c d e f"), (3, None), (3, None), (4, "q r s t u v")], key=str)


def test_keep_first_tells_components_apart(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (None, "g h i j k l"), (None, "G h i j k l"), (5, "m n o p q r"), (5, "s t u v w x"), (6, "S t u v w x"), (None, None), (None, "")], DOC)
    kept = [tuple(r) for r in jaccard.keep_first(d, Shared.create(spark, "t")).collect()]
    assert sorted(((k, (t or "").lower()) for k, t in kept), key=str) == sorted([(None, "a b c d e f"), (None, "g h i j k l"), (5, "m n o p q r"), (5, "s t u v w x"), (None, ""), (None, "")], key=str)


def test_trie_prunes_and_finds():
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(30), rng.randrange(5, 25))) for _ in range(200)]
    sets += sets[:5]
    parts, sizes = [np.array(s, np.uint64).tobytes() for s in sets], np.array([len(s) for s in sets])
    got = set()
    jaccard.walk(jaccard.Trie(parts, sizes), parts[:40], sizes[:40], lambda m, hits: got.update((m, int(h)) for h in hits))
    assert got == {(m, p) for m, s in enumerate(sets) for p, q in enumerate(sets[:40]) if 100 * len({*s} & {*q}) >= 75 * len({*s} | {*q})}


@pytest.mark.parametrize("walk_bytes", [1, 500, 1 << 20])
def test_self_join_keeps_components(monkeypatch, walk_bytes):
    monkeypatch.setattr(jaccard, "WALK_BYTES", walk_bytes)
    rng = random.Random(2)
    base = [rng.sample(range(1, 90), 20) for _ in range(3)]
    sets = [sorted({0, *rng.sample(b, 18), *rng.sample(range(100, 130), rng.randrange(6))}) for b in base for _ in range(60)]
    parts, sizes = [np.array(s, np.uint64).tobytes() for s in sets], np.array([len(s) for s in sets])

    def comps(links):
        top = list(range(len(sets)))
        for a, b in links:
            x, y = top[a], top[b]
            top = [min(x, y) if t in (x, y) else t for t in top]
        return top

    links = jaccard.self_join(parts, sizes)
    every = [(i, j) for i, s in enumerate(sets) for j, q in enumerate(sets[:i]) if 100 * len({*s} & {*q}) >= 75 * len({*s} | {*q})]
    assert comps(links) == comps(every) and len(links) < len(sets)


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, sample, order):
    docs = sample[:80] + [(None, None), (900, ""), (901, "the THE  the"), (902, "the")]
    train = [t for k, t in docs if k is None or k % 7]
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in train], "text string"), Shared.create(spark, "t"), order=order)
    got = sorted((tuple(r) for r in ngram_lm.score_texts(spark.createDataFrame(docs, DOC), model).drop("perplexity").collect()), key=str)
    want, p, vocabulary = brute.kneser_ney(train, [t for _, t in docs], order)
    want = sorted(((k, *w) for (k, _), w in zip(docs, want)), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], abs=1e-6)
    context = tuple(sample[0][1].lower().encode().split()[: order - 1])
    assert sum(p((*context, w)) for w in vocabulary) + p((*context, "never seen")) == pytest.approx(1)


def test_query_sees_two_words_of_context(spark, tmp_path):
    from lodemill.llm import queries

    rows = [(k, ["a b c d", "x b e f"][k % 2]) for k in range(40)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["score"]) for r in queries.op1_kneser_ney(spark, str(tmp_path)).select("doc_id", "score").collect())
    train = [t for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    want, _, _ = brute.kneser_ney(train, [t for _, t in rows], 3)
    assert [s for _, s in got] == pytest.approx([w[4] for w in want], abs=1e-6)


def test_layouts_give_one_model(spark, sample, monkeypatch):
    monkeypatch.setattr(ngram_lm, "FAN", 4)
    docs = spark.createDataFrame(sample[:40], DOC)
    scores = []
    for layout in (ngram_lm.Layout(1, 1), ngram_lm.Layout(64, 8)):
        model = ngram_lm.train(docs, Shared.create(spark, "t"), order=3, layout=layout)
        scores.append(sorted(map(tuple, ngram_lm.score_texts(docs, model).collect())))
    assert scores[0] == scores[1]


def test_missing_file_is_no_empty_one(spark):
    shared = Shared.create(spark, "t")
    model = ngram_lm.train(spark.createDataFrame([("a b",)], "text string"), shared)
    fs, top = shared._fs()
    fs.delete_file(f"{top}/t1-{model.tables.stored[1][0]}.high")
    with pytest.raises(FileNotFoundError):
        model.score([b"a b"] * 3)


def test_very_long_texts(spark):
    rng = random.Random(12)
    words_ = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(900)]
    long = [rng.choice(words_) for _ in range(60_000)]
    near = [*long[:30_000], "x", *long[30_000:]]
    texts = [" ".join(long), "\n".join(" ".join(long[k : k + 600]) for k in range(0, len(long), 600)), " ".join(near), " ".join(long[:5000]), None, ""]
    docs = list(enumerate(texts))
    assert groups(spark, docs) == brute.jaccard_groups(docs)
    assert [r[3] for r in report(spark, docs)][:3] == [(), (), (0,)]
    items = [(1, " ".join(long[59_980:])), (2, " ".join(long[100:109])), (3, "not there")]
    assert contamination(spark, docs, items) == brute.hit_words(docs, items)
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in texts[:1]], "text string"), Shared.create(spark, "t"), order=3)
    want, _, _ = brute.kneser_ney(texts[:1], texts, 3)
    got = sorted((tuple(r) for r in ngram_lm.score_texts(spark.createDataFrame(docs, DOC), model).select("doc_id", "n_tokens", "score").collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == [w[0] for w in want] and [r[2] for r in got] == pytest.approx([w[4] for w in want], rel=1e-9)


def test_untrained_model(spark):
    model = ngram_lm.train(spark.createDataFrame([], "text string"), Shared.create(spark, "t"))
    got = ngram_lm.score_texts(spark.createDataFrame([(1, "a")], DOC), model).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"]) == (2, 0, 0, 0.0)


def test_sharding(spark):
    d = spark.createDataFrame([(1, "x" * 100)] * 50 + [(None, None), (2, "y" * 5000), (3, "")] + [(k, "z" * 20) for k in range(10, 60)], DOC)
    got = sharding.assign(d, 1000, Shared.create(spark, "t")).toPandas()
    assert len(got) == d.count()
    sums = got.groupby("shard").agg({"bytes": "sum", "shard_bytes": "max", "shard_rows": "max", "doc_id": "size", "oversize": "max"})
    assert (sums["bytes"] == sums["shard_bytes"]).all() and (sums["shard_rows"] == sums["doc_id"]).all()
    assert (sums["oversize"] == (sums["bytes"] > 1000)).all() and (sums[sums["oversize"]]["shard_rows"] == 1).all()
    # No shard could have stayed one: a split prefix did not fit.
    plain = {s: b for s, b in sums["bytes"].items() if "." not in s and s != "*"}
    for s in plain:
        assert sums["bytes"][[x.startswith(s[:-1]) for x in sums.index]].sum() > 1000
    assert sharding.assign(d.limit(0), 1000, Shared.create(spark, "t")).count() == 0
    assert {r["shard"] for r in sharding.assign(d, 10**9, Shared.create(spark, "t")).collect()} == {"*"}


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(None, "n" * 30, 1), (None, None, 2), *[(7, "x" * 100, k) for k in range(20)], *[(k, "z" * 20, k) for k in range(10, 60)]]
    d = spark.createDataFrame(rows, DOC + ", extra long")
    sharding.write_shards(d, 1000, Shared.create(spark, "t"), f"{tmp_path}/out", task_bytes=1000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select("doc_id", "text", "extra").collect()), key=str) == sorted(rows, key=str)
    assert back.select("shard").distinct().count() > 1
