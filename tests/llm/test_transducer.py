"""The transducer against the words it was built of, and encoding against the library."""

import functools
import hashlib
import itertools
import random
import struct

import pytest
from tokenizers import Tokenizer

from lodemill.llm import token_files, transducer
from lodemill.llm.common import Shared
from lodemill.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
ODD = ["", None, " ", "  ", "\n", "a\n\nb", " lead", "trail ", "two  spaces", "tab\there", "é è ü ß", "日本語のテキスト", "<|endoftext|>", "a<|endoftext|>b", "it's we'll I'D", "x" * 5000, " nbsp", "\x00", "a\x00b", "👩‍👩‍👧 ok", "1234567 89", "...!?", "ﬁ ligature", "line\r\nend", " ", "end\n", ", a", ". b", "a, b. c", "x), y., z", "1, 2. 3², ½. Ⅷ, ", "it's, don't. ... , . a,. b", "é́, ñ. 中, 文. "]


@pytest.mark.parametrize("seed", range(30))
def test_build_and_walk(seed):
    rng = random.Random(seed)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 200))})
    ids = {w: tuple(rng.randint(0, 3) for _ in range(rng.randint(1, 4))) for w in words}
    made = transducer.Transducer.of(transducer.build((w, ids[w]) for w in words))
    asked = words + [w + b"a" for w in words] + [b"zz", b"a" * 60]
    known, n, got = made.walk(asked)
    at = 0
    for w, k, m in zip(asked, known, n):
        assert k == (w in ids)
        assert tuple(got[at : at + m]) == ids.get(w, ())
        at += m
    assert at == len(got)


def test_shared_ends():
    """Words that are any of 26 beginnings and any of 4 ends, with ids of both: one state for each step of the ends."""
    ends = [b"ing", b"ed", b"s", b"er"]
    words = {bytes([97 + k]) + e: (k, 100 + j) for k in range(26) for j, e in enumerate(ends)}
    arrays = transducer.build(sorted(words.items()))
    # The start, what follows each beginning (the same for all), the ends' inner states, and the last one.
    assert len(arrays["end_n"]) == 1 + 1 + 3 + 1
    assert len(arrays["target"]) == 26 + 3 + 4


@functools.cache
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def library(text):
    t = tokenizer()
    ids = t.encode(text or "", add_special_tokens=False).ids
    back = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(ODD * 2)] + [(None, "null id")], "doc_id long, text string")
    every = docs.unionByName(more).selectExpr("*", "1 AS chunk", "'x' AS n").repartition(4)
    made = transducer.encode_decode(every, PATH, transducer.compile_lexicon(every, PATH, Shared.create(spark, "test")))
    texts = {r["doc_id"]: r["text"] for r in every.collect()}
    got = made.collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == library(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert hashlib.sha256(struct.pack(f"<{len(r['ids'])}I", *r["ids"])).hexdigest() == r["ids_sha256"]


def test_decode_of_any_ids():
    """Ids that are no UTF-8 together decode as in the library."""
    own = transducer.Encoder(PATH, transducer.Transducer.of(transducer.build([])))
    rng, t = random.Random(2), Tokenizer.from_file(PATH)
    runs = [[rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randint(0, 30))] for _ in range(300)]
    import numpy as np

    got = own.decode(np.array(list(itertools.chain(*runs)), np.int64), np.array([len(r) for r in runs]))
    assert got == [t.decode(r, skip_special_tokens=False) for r in runs]


def test_no_words_and_hot_words(spark):
    for rows in ([], [(1, None)], [(1, "the same word " * 30_000), (2, "the")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        made = transducer.encode_decode(docs, PATH, transducer.compile_lexicon(docs, PATH, Shared.create(spark, "test")), keep_ids=False)
        assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in made.collect()) == [(k, *library(t)) for k, t in rows]


def test_word_memo_is_bounded(monkeypatch):
    """Texts without spaces fill no chunk table; the memo of their tokens is emptied all the same."""
    monkeypatch.setattr(token_files, "TABLE_CHUNKS", 500)
    table = token_files.ByteTable(PATH)
    for k in range(20):
        table.encode(["".join(chr(0x4E00 + (k * 1000 + j * 7) % 20_000) + chr(33 + j % 15) for j in range(1000))])
        assert len(table.words) <= 500 and len(table) <= 500
