"""Phrases against counting every run of words, and the tables they rest on."""

import collections
import random
import re

import numpy as np
import pytest

from lodemill.llm import perfect, phrases, runs
from lodemill.llm.common import U64, Shared, mix, unmix

SHAPE = "doc_id long, text string, lang string"


def counted(rows, least, longest, share, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + m]) for (lang, w), a in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= share * f[lang, w[i : i + m]]}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:c]] * f[lang, w[c:]]), c, f[lang, w[:c]], f[lang, w[c:]]) for c in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for lang, every in out.items() for k, (score, a, p, left, right) in enumerate(sorted(every)[:top]))


def texts(seed, n):
    rng = random.Random(seed)
    fixed = ["in spite of it", "as well as", "New York", "straße nach oben", "à la"]
    word = lambda: rng.choice(["the", "of", "a", "b", "c.", "d,", "e\n", "tab\t", "x  y", "Ö", "\x00", "q!"] + fixed)
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for k in range(n)]
    return [*rows, (None, None, "en"), (1, "", None), (5, rows[3][1], rows[3][2]), (6, "long " * 50_000, "en"), (7, "one" * 400_000, "en")]


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("least", "longest", "share", "top"), [(3, 5, 100, 2000), (8, 4, 60, 7), (2, 2, 100, 10)])
def test_equals_plain_counts(spark, least, longest, share, top):
    rows = texts(least, 150)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SHAPE + ", part int, slot string").repartition(5)
    assert rows_of(phrases.mine(docs, Shared.create(spark, "test"), least=least, longest=longest, share=share, top=top)) == counted(rows, least, longest, share, top)


def test_many_blocks_and_trees(spark, monkeypatch):
    """Narrow blocks, short runs and a tree of more than one step give the same."""
    rows = texts(1, 80)
    for name, value in (("BLOCK_SLOTS", 4), ("ADDED", 2), ("TEXT_BYTES", 2000), ("REMEMBERED", 10)):
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(runs, "FAN", 4)  # the 32 shards by three deals
    monkeypatch.setattr(runs, "RUN_BYTES", 1 << 14)
    docs = spark.createDataFrame(rows, SHAPE).repartition(7)
    assert rows_of(phrases.mine(docs, Shared.create(spark, "test"), least=3, longest=3)) == counted(rows, 3, 3, 100, 2000)


def test_no_texts(spark):
    for rows in ([], [(1, None, None)], [(1, "a b", "en")]):
        assert phrases.mine(spark.createDataFrame(rows, SHAPE), Shared.create(spark, "test")).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(3)
    some = rng.integers(0, 1 << 63, 1000, dtype=U64) * U64(2) + U64(1)
    assert (unmix(mix(some)) == some).all()
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=U64))
        table = perfect.Table(perfect.build(mix(keys), keys))
        slots = table.find(mix(keys), keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(0, 1 << 63, 1000, dtype=U64), keys)
        assert (table.find(mix(others), others) == -1).all()


def test_deals_of_a_few_parts(spark):
    """64 shards by deals of 4 parts: every key's counts meet in its shard."""
    assert runs.widths(64, 4) == [4, 16, 64] and runs.widths(1 << 17) == [128, 1 << 17]
    first = runs.widths(64, 4)[0]

    def make(batches):
        for _ in batches:
            keys = np.random.default_rng(7).integers(0, 500, 4000).astype(U64) * U64(0x9E3779B97F4A7C15)
            yield runs.cut(*runs.fold([(keys, np.ones(4000, np.int64))]), first)

    def read(batches):
        import pyarrow as pa

        from lodemill.llm.common import by_key, shard_of

        for (part,), group in by_key(batches, 1):
            for keys, n in runs.folded(runs.read(r[1]) for r in group):
                assert (shard_of(keys, 64) == part).all()
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "keys": pa.array([len(keys)], pa.int64()), "n": pa.array([int(n.sum())], pa.int64())})

    from lodemill.llm.common import map_arrow

    dealt = runs.dealt(map_arrow(spark.range(0, 3, 1, 3), make, runs.RUN), 64, fan=4)
    got = map_arrow(dealt, read, "part int, keys long, n long").collect()
    assert len({r["part"] for r in got}) == len(got)
    assert sum(r["n"] for r in got) == 12_000 and sum(r["keys"] for r in got) == len(np.unique(np.random.default_rng(7).integers(0, 500, 4000)))
