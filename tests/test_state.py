"""What outlives a run: the embedding cache, the log of answers, the key index; selection and samples without hot tasks."""

import hashlib
import itertools
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemill.operators import sampling, selection, topics
from lodemill.operators.numbering import numbered
from lodemill.sources import readers
from lodemill.sources.responses import answered
from lodemill.sources.vectors import embedding_cache
from lodemill.streaming import resume


def encoder(calls, n=2, drop=()):
    def make(rows):
        calls.append(sorted(r["k"] for r in rows.collect()))
        return rows.where(~F.col("k").isin(list(drop))).select("k", F.array(*[F.length("t").cast("double")] * n).alias("embedding")) if drop else rows.select("k", F.array(*[F.length("t").cast("double")] * n).alias("embedding"))

    return make


def test_embedding_cache(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k long, t string")
    calls, place, model = [], str(tmp_path), {"model": "m", "chars": 10}
    ask = lambda df, make, sig=model: {r["k"]: list(r["embedding"]) for r in embedding_cache(df, sig, place, make, "k", "t").collect()}
    assert ask(rows((1, "a"), (2, "bb"), (3, None)), encoder(calls)) == {1: [1, 1], 2: [2, 2], 3: [None, None]}
    assert ask(rows((2, "bb"), (4, "dddd"), (1, "changed")), encoder(calls)) == {1: [7, 7], 2: [2, 2], 4: [4, 4]}  # grown and changed
    assert ask(rows((2, "bb")), encoder(calls)) == {2: [2, 2]}  # shrunk
    assert calls == [[1, 2, 3], [1, 4]]
    with pytest.raises(ValueError, match="1 rows were asked for"):  # vectors of another length
        ask(rows((9, "x")), encoder(calls, 3))
    with pytest.raises(ValueError, match="2 rows were asked for, 1 came"):
        ask(rows((9, "x"), (10, "y")), encoder(calls, drop=(10,)))
    assert ask(rows((9, "xy")), encoder(calls)) == {9: [2, 2]}  # what failed half written does not count
    broken = next(pathlib.Path(place).glob("signature=*/manifest-*.json"))
    broken.write_text(broken.read_text()[:20])
    assert ask(rows((2, "bb"), (9, "xy")), encoder(calls)) == {2: [2, 2], 9: [2, 2]}
    assert ask(rows((2, "bb")), encoder(calls), {"model": "other"}) == {2: [2, 2]} and calls[-1] == [2]
    assert ask(rows(), encoder(calls)) == {}


def test_each_prompt_is_asked_once(spark, tmp_path):
    """A task fails after some batches and is tried again; a second run and repeated prompts ask nothing anew."""
    seen, log = str(tmp_path / "asked"), str(tmp_path / "log")
    pathlib.Path(seen).mkdir()

    def ask(texts):
        import uuid

        asked = pathlib.Path(seen)
        for t in texts:
            (asked / uuid.uuid4().hex).write_text(t)
        return [t.upper() for t in texts]

    def failing(texts):
        if len(list(pathlib.Path(seen).iterdir())) >= 12:
            raise RuntimeError("the model is away")
        return ask(texts)

    prompts = spark.createDataFrame([(k, f"p{k % 30}") for k in range(60)] + [(99, None)], "k long, prompt string")
    run = lambda f, **kw: {r["k"]: r["response"] for r in answered(prompts, f, log, {"seed": 42}, buckets=4, batch=2, **kw).collect()}
    with pytest.raises(Exception, match="the model is away"):
        run(failing)
    assert 12 <= len(list(pathlib.Path(seen).iterdir())) < 30
    want = {k: f"P{k % 30}" for k in range(60)} | {99: None}
    assert run(ask) == want and run(ask) == want
    texts = [p.read_text() for p in pathlib.Path(seen).iterdir()]
    assert sorted(texts) == sorted({f"p{k}" for k in range(30)})
    answered(prompts, ask, log, {"seed": 43}, buckets=4).count()
    assert len(list(pathlib.Path(seen).iterdir())) == 30 or len(list(pathlib.Path(seen).iterdir())) == 60


def keys_of(df):
    return sorted((r["repository"], r["sha"]) for r in df.collect())


def test_key_index(spark, tmp_path):
    target, shape = str(tmp_path / "out"), "repository string, branch string, path string, sha string, content string"
    batch = lambda shas, c="c": spark.createDataFrame([("r", None, "p", s, c) for s in shas], shape)
    resume.append_batch(batch(["1", "2", "2"]), target, "a-0", buckets=64)
    resume.append_batch(batch(["2", "3"]), target, "a-1", buckets=64)
    assert [s for _, s in keys_of(resume.read_appended(spark, target))] == ["1", "2", "3"]
    for _ in range(2):  # a batch that is tried again takes its own place
        resume.append_batch(batch(["2", "3"]), target, "a-1", buckets=64)
    assert [s for _, s in keys_of(resume.read_appended(spark, target))] == ["1", "2", "3"]
    many = [f"x{k}" for k in range(3000)]
    resume.append_batch(batch(many), target, "a-2", buckets=64)
    # A few new keys meet filters alone; known ones read their own buckets.
    fresh = resume._keyed(batch([f"new{k}" for k in range(20)]), resume.KEYS, 64)
    assert len(resume.known_keys(fresh, target).inputFiles()) <= 4
    some = resume._keyed(batch(["x7", "x8", "1"]), resume.KEYS, 64)
    found = resume.known_keys(some, target)
    touched = {r["__bucket"] for r in some.collect()}
    assert found.count() == 3
    assert {int(f.split("/bucket=")[1].split("/")[0]) for f in found.inputFiles() if "/bucket=" in f} <= touched
    resume.append_batch(batch([*many[:50], "y"]), target, "b-0", buckets=64)
    assert resume.read_appended(spark, target).count() == 3 + 3000 + 1


def test_selection(spark):
    rng = np.random.default_rng(5)
    values = {None: [3.5], "a": [*rng.normal(0, 1, 999).tolist(), 1e300, -0.0, 0.0, float("-inf")], "b": [2.0] * 500, "c": [None], "d": [float("nan"), 1.0, -1e-310]}
    rows = [(g, v) for g, every in values.items() for v in every]
    at = {"first": F.lit(0), "middle": F.floor((F.col("n") - 1) / 2), "last": F.col("n") - 1, "beyond": F.col("n")}
    got = {r["g"]: r for r in selection.places(spark.createDataFrame(rows, "g string, v double").repartition(5), F.col("v"), at, ["g"]).collect()}
    for g, every in values.items():
        held = np.sort([v for v in every if v is not None])
        if not len(held):
            assert g not in got
            continue
        same = lambda a, b: a == b or np.isnan(a) and np.isnan(b)
        assert same(got[g]["first"], held[0]) and same(got[g]["middle"], held[(len(held) - 1) // 2]) and same(got[g]["last"], held[-1])
        assert got[g]["beyond"] is None and got[g]["n"] == len(held)
    whole = [(int(x),) for x in rng.integers(-(1 << 62), 1 << 62, 400)] + [(-(1 << 63),), ((1 << 63) - 1,)]
    r = selection.places(spark.createDataFrame(whole, "v long"), F.col("v"), {f"p{k}": F.lit(k) for k in (0, 1, 200, 401)}).first()
    every = sorted(x for (x,) in whole)
    assert [r[f"p{k}"] for k in (0, 1, 200, 401)] == [every[k] for k in (0, 1, 200, 401)]
    q = selection.quantiles(spark.createDataFrame([(float(x),) for x in range(10)], "v double"), F.col("v"), {"m": 0.5, "p99": 0.99}).first()
    assert (q["m"], round(q["p99"], 9)) == (4.5, 8.91)
    assert selection.places(spark.createDataFrame([], "v double"), F.col("v"), {"p": F.lit(0)}).first()["p"] is None


def test_selection_deals_distinct_values_evenly(spark):
    """10^6 distinct values and one far away: a place is found by counts of digits, of which no task gets more than the digits there are."""
    rows = spark.range(1_000_000).select((F.col("id") / 7.0).alias("v")).unionByName(spark.createDataFrame([(1e200,)], "v double"))
    r = selection.places(rows, F.col("v"), {"p90": F.floor(F.lit(0.9) * (F.col("n") - 1))}).first()
    assert r["p90"] == 900_000 / 7.0
    plan = selection.places(rows, F.col("v"), {"p90": F.lit(0)})._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "percentile" not in plan.lower()


def greedy(files, per_repo, per_folder):
    turn = lambda *k: hashlib.md5("|".join(["42", *k]).encode()).hexdigest()
    counts, kept = {}, []
    for r, p in sorted(files, key=lambda f: (turn(*f), f[1])):
        parts = p.split("/")
        keys = [("r", r), ("f", r, "/".join(parts[:-1])), ("n", r, "/".join(parts[:-2]), parts[-1])]
        if all(counts.get(k, 0) < cap for k, cap in zip(keys, (per_repo, per_folder, per_folder))):
            kept.append((r, p))
            for k in keys:
                counts[k] = counts.get(k, 0) + 1
    return sorted(kept)


@pytest.mark.parametrize(("per_repo", "per_folder"), [(40, 3), (7, 7)])
def test_balanced_sample_of_a_hot_repository(spark, per_repo, per_folder):
    files = {("hot", f"a{k % 9}/b{k % 4}/n{k % 13}.md" if k % 3 else f"c{k % 50}/{k}.md") for k in range(1500)} | {(f"r{k % 5}", f"d{k % 2}/{k}.md") for k in range(60)}
    got = sampling.balanced(spark.createDataFrame(sorted(files), "repository string, path string").repartition(4), per_repo, per_folder)
    assert sorted((r["repository"], r["path"]) for r in got.collect()) == greedy(files, per_repo, per_folder)


def test_numbering_of_a_frequent_key(spark):
    rows = spark.createDataFrame([(1 if k % 3 else k, f"g{k % 2}" if k % 5 else None, k) for k in range(400)], "v int, g string, k int").repartition(3)
    got = numbered(rows, ["v"], "at").collect()
    assert sorted(r["at"] for r in got) == list(range(400)) and {r["__total"] for r in got} == {400}
    by = sorted(got, key=lambda r: r["at"])
    assert all(a["v"] <= b["v"] for a, b in itertools.pairwise(by))
    inside = numbered(rows, ["v"], "at", ["g"]).collect()
    for g in ("g0", "g1", None):
        own = sorted((r["at"], r["v"]) for r in inside if r["g"] == g)
        assert [a for a, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    assert numbered(rows.limit(0), ["v"], "at").count() == 0


def test_nearest_of_many_blocks(spark, monkeypatch):
    """Centres in many blocks, some of them equal: the smaller topic, whatever block it lies in."""
    monkeypatch.setattr(topics, "BLOCK_CENTERS", 7)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (60, 16))
    centres[41] = centres[3]
    centres[50] = 0
    x = np.concatenate([rng.normal(0, 1, (200, 16)), centres[[41, 3, 7]], np.zeros((1, 16))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>").repartition(3)
    names = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centres)], "topic long, center array<double>").repartition(5)
    got = {r["vec_id"]: (r["topic"], r["similarity"]) for r in topics.nearest_topic(rows, names, 0.2, (9,)).collect()}
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    s = unit(x) @ unit(centres).T
    s[:, 9] = -9
    for k in range(len(x)):
        best = min((j for j in range(60) if j != 9 and s[k, j] >= s[k].max() - 1e-12))
        assert got[k][0] == (best if s[k, best] >= 0.2 else -1) and abs(got[k][1] - s[k].max()) < 1e-9
    assert got[201][0] == got[200][0] == 3 and got[900] == (-1, None)
    assert {r["topic"] for r in topics.nearest_topic(rows, names.limit(0), 0.2).collect()} == {-1}


def test_refined_keywords(spark):
    rng = np.random.default_rng(4)
    words = {f"w{k}": rng.normal(0, 1, 8) for k in range(40)}
    words["w5"] = words["w4"] * 2
    middles = {t: rng.normal(0, 1, 8) for t in (0, 1)}
    scored = spark.createDataFrame([(t, w, k) for t in middles for k, w in enumerate(words)] + [(0, "unknown", 99)], "topic long, term string, place int")
    vectors = spark.createDataFrame([(w, v.tolist()) for w, v in words.items()], "term string, embedding array<double>")
    centre = spark.createDataFrame([(t, v.tolist()) for t, v in middles.items()], "topic long, center array<double>")
    got = {}
    for r in topics.refined_keywords(scored, vectors, centre, candidates=15, n=6).orderBy("topic", "place").collect():
        got.setdefault(r["topic"], []).append(r["term"])
    unit = lambda v: v / np.linalg.norm(v)
    for t, c in middles.items():
        like = {w: round(float(unit(v) @ unit(c)), 9) for w, v in words.items()}
        few = sorted(words, key=lambda w: (-like[w], w))[:15]
        chosen = [few[0]]
        while len(chosen) < 6:
            chosen.append(min((w for w in few if w not in chosen), key=lambda w: (-round(0.7 * like[w] - 0.3 * max(round(float(unit(words[w]) @ unit(words[x])), 9) for x in chosen), 9), w)))
        assert got[t] == chosen


def test_chosen_keywords_of_whole_texts(spark, tmp_path):
    """t12_keywords equals a plain version: stop words go before pairs of words, vectors count pairs of letters, topics' vectors come from all their texts."""
    import collections
    import math
    import random
    import re

    from lodemill import registry

    draw = random.Random(5)
    words = ["".join(draw.choices("abcdeg", k=draw.randint(3, 6))) for _ in range(60)] + ["the", "with", "den", "der", "a1_", "b22", "été"]
    texts = [(k, draw.choice(["en", "de"]), " ".join(draw.choices(words[:40] if k % 2 else words, k=12)) + f". Xyz{chr(97 + k % 26)}zyx") for k in range(80)]
    texts += [(80 + k, lang, text) for k, (lang, text) in enumerate([("en", None), (None, "the den der"), ("de", ""), ("de", "DEN DER " * 9), ("en", "der den")])]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in registry.queries()["t12_keywords"](spark, str(tmp_path)).orderBy("topic", "place").collect():
        got.setdefault(r["topic"], []).append((r["term"], r["likeness"]))

    def vector(text):
        x = np.zeros(26 * 26)
        for a, b in zip(text, text[1:]):
            if "a" <= a <= "z" and "a" <= b <= "z":
                x[(ord(a) - 97) * 26 + ord(b) - 97] += 1
        return x / (np.linalg.norm(x) or 1)

    tf, docs, middles = collections.defaultdict(collections.Counter), collections.Counter(), collections.defaultdict(list)
    for _, lang, text in texts:
        w = [x for x in re.findall(r"\b[a-z][a-z0-9_-]{2,}\b", (text or "").lower()) if x not in ("the", "with")]
        terms = w + [f"{x} {y}" for x, y in zip(w, w[1:])]
        docs.update(set(terms))
        tf[lang].update(terms)
        if text is not None:
            middles[lang].append(vector(text.lower()))
    keep = {t for t, n in docs.items() if 3 <= n <= 0.9 * len(texts)}
    f = {t: sum(c[t] for c in tf.values()) for t in keep}
    size = {k: sum(n for t, n in c.items() if t in keep) for k, c in tf.items() if k}
    mean = sum(sum(n for t, n in c.items() if t in keep) for c in tf.values()) / len(tf)
    assert set(got) == set(size)
    for lang in got:
        score = {t: round(math.sqrt(n / size[lang]) * math.log(1 + mean / f[t]), 12) for t, n in tf[lang].items() if t in keep}
        c = np.mean(middles[lang], axis=0)
        like = {t: float(vector(t) @ c / np.linalg.norm(c)) for t in sorted(score, key=lambda t: (-score[t], t))[:100]}
        few = sorted(like, key=lambda t: (-round(like[t], 6), t))[:30]
        chosen = [few[0]]
        while len(chosen) < 10:
            chosen.append(min((t for t in few if t not in chosen), key=lambda t: (-round(0.7 * like[t] - 0.3 * max(float(vector(t) @ vector(x)) for x in chosen), 6), t)))
        assert [t for t, _ in got[lang]] == chosen
        assert [n for _, n in got[lang]] == pytest.approx([like[t] for t in chosen], abs=1e-6)


def test_letter_pairs_and_sums_passed_on_in_several_rows(spark, monkeypatch):
    x = topics.letter_pairs(["abab ab", "", "zé{z`aa", "a"])
    assert [{chr(97 + k // 26) + chr(97 + k % 26): v for k, v in enumerate(r) if v} for r in x] == [{"ab": 3, "ba": 1}, {}, {"aa": 1}, {}]
    monkeypatch.setattr(topics, "SUMS_AT_ONCE", 2)
    rows = spark.createDataFrame([(k % 5 if k % 7 else None, "ab" * (k % 3) + "c" if k % 4 else None) for k in range(60)], "t long, text string")
    got = {r["t"]: r["center"] for r in topics.text_centroids(rows, "t", "text", topics.letter_pairs, batch=3).collect()}
    for t in range(5):
        each = [topics._of_length_one(topics.letter_pairs([r["text"]]))[0] for r in rows.collect() if r["t"] == t and r["text"] is not None]
        assert np.abs(np.array(got[t]) - np.mean(each, axis=0)).max() < 1e-8
    assert set(got) == set(range(5))


def test_tolerant_text(spark, tmp_path):
    samples = [b"ok", b"\xff", b"a\xc3", b"\xe2\x82x", b"\xf0\x9f\x98", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf5\x80", "é日😀".encode(), b"", b"x\x80\x80y"]
    import base64

    rows = spark.createDataFrame([(k, base64.b64encode(s).decode()) for k, s in enumerate(samples)] + [(99, None)], "k int, c string")
    got = {r["k"]: r["t"] for r in rows.select("k", readers.decoded(F.col("c")).alias("t")).collect()}
    assert {k: got[k] for k in range(len(samples))} == {k: s.decode("utf-8", "replace") for k, s in enumerate(samples)} and got[99] is None
    (tmp_path / "a.md").write_bytes(b"one\xfftwo")
    assert [r["text"] for r in readers.read_tree(spark, str(tmp_path), [".md"]).collect()] == ["one�two"]
