"""Operators on single texts: against the libraries, exact round trips, brute force and held-out accuracy."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemill.llm import common, gif, langid, pieces, pii, token_files
from lodemill.llm.common import Shared
from lodemill.llm.queries import tokenizer_file

DOC = "doc_id long, text string"
ODD = ["a  b", "  a", "a ", "", " ", "a\tb", "▁a", "a▁b", "\x00", "\r\n \n", " x ", "<unk> </s>", "é ñ", "a\x1cb\x1d c", "x\u0085y z", "​ a", "﻿", "  \n\n  a", " 　 b", "<|endoftext|>", "it's 'll", "🙂 👩‍👩 x", "\n", "a\n", "\na", "a\n b", "a \nb", "a,b. c, d"]


def noise(seed, alphabet, n=3000, size=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_word_hashes():
    raw = [bytes(random.Random(k).choice(b"ab \n\x00\xc3\xa9AB.") for _ in range(k % 40)) for k in range(900)] + [b"word " * 300_000, b"x" * 2_500_000, b"", b"end"]
    h, bounds = common.hash_words(raw)
    names = {}
    for k, text in enumerate(raw):
        found = text.lower().split()
        assert len(found) == bounds[k + 1] - bounds[k]
        for w, x in zip(found, h[bounds[k] : bounds[k + 1]].tolist(), strict=True):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_packed_arrays():
    keys, n = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)), np.arange(500, dtype=np.uint8)
    a, b = common.unpack(common.pack(keys, n))
    assert (a == keys).all() and (b == n).all()


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        Shared.create(session, "t")


def test_each_shard_has_a_partition(spark):
    for n in (1, 2, 32, 64):
        rows = spark.range(n * 10).select((F.col("id") % n).cast("int").alias("k")).repartition(n, common.shared_key("k", n)).select("k", F.spark_partition_id().alias("p")).distinct().collect()
        assert len(rows) == n and {r["p"] for r in rows} == set(range(n))


def test_orders():
    rng = np.random.default_rng(3)
    for keys in (rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 40, 5000).astype(np.uint64), np.zeros(0, np.uint64), (rng.integers(0, 9, 500) << 60).astype(np.uint64) + rng.integers(0, 9, 500).astype(np.uint64)):
        assert (keys[common.order_of(keys)] == np.sort(keys)).all()
        found, back = common.distinct(keys)
        assert (found == np.unique(keys)).all() and (found[back] == keys).all()


def test_pieces_equal_the_library(texts):
    table = pieces.ChunkTable(tokenizer_file("piece_bpe_32k.model"))
    assert not table.whole
    every = ODD + noise(1, " \n\ta1'.é▁ 　Z🙂") + noise(2, " abé\n.,") + texts
    want = table.model.encode(every)
    assert table.encode(every) == [",".join(map(str, x)) for x in want]


def test_pieces_query(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rows = [(k, t) for k, t in enumerate([*ODD, *texts[:20]])] + [(None, None), (5, "x"), (5, "x")]
    d = spark.createDataFrame(rows, DOC).withColumn("n_tokens", F.lit("clash"))
    got = sorted((tuple(r) for r in pieces.encode_decode(d, tokenizer_file("piece_bpe_32k.model")).collect()), key=str)
    want = []
    for key, text in rows:
        ids = model.encode(text or "")
        back = model.decode(ids)
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back))
    assert got == sorted(want, key=str)


def test_byte_table_equals_the_library(texts):
    table = token_files.ByteTable(tokenizer_file("byte_bpe_50k.json"))
    assert table.safe
    every = ODD + noise(3, " \n\ta1'.é 　\x1c\u0085Z🙂") + noise(4, " \na1'.,éZ") + noise(5, " abé\n.,") + texts
    assert table.encode(every) == table._plain(every)


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    model.encode_special_tokens = True  # a text has no special tokens, only their strings
    rows = [(3 * k % 101, t) for k, t in enumerate([*ODD, *texts[:60]])] + [(None, None)]
    shared = Shared.create(spark, "t")
    files = token_files.write_files(spark.createDataFrame(rows, DOC).withColumn("k", F.lit(0)), tokenizer_file("byte_bpe_50k.json"), shared)
    got = sorted((tuple(r) for r in token_files.read_files(spark, files, shared).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    start = 0
    by_id = {k: [*model.encode(t or "", add_special_tokens=False).ids, 0] for k, t in rows}
    for key, at, n, check, ids in got:
        assert (at, ids) == (start, by_id[key])
        assert (n, check) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert token_files.read_files(spark, token_files.write_files(spark.createDataFrame([], DOC), tokenizer_file("byte_bpe_50k.json"), shared), shared).count() == 0


def test_query_finds_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from lodemill.llm import queries

    model = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = list(enumerate(["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>\n<|endoftext|> b", "<|endoftext |>", "a b"]))
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.op10_token_files(spark, str(tmp_path)).collect()}
    want = {k: [*model.encode(t, add_special_tokens=False).ids, 0] for k, t in rows}
    assert got == {k: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in want.items()}


def test_one_document_is_read_alone(tmp_path):
    sink = io.BytesIO()
    out = token_files.FrameWriter(sink, frame_bytes=64)
    data = {k: np.arange(k, dtype="<u4").tobytes() for k in range(40)}
    for k, ids in data.items():
        out.add(k, ids)
    out.finish()
    raw = bytearray(sink.getvalue())
    touched = []
    reader = token_files.FrameReader(lambda at, n: touched.append((at, n)) or bytes(raw[at : at + n]), len(raw))
    before = len(touched)
    assert reader.read(reader.docs[20]) == data[20]
    assert len(touched) == before + 1
    at, packed, *_ = reader.frames[-1]
    raw[at + packed - 1] ^= 1
    with pytest.raises(Exception):  # noqa: B017  either library may notice
        reader.read(reader.docs[-1])


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
VALID = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": pii._is_card, "phone": pii._is_phone}


def test_base_spans(texts):
    for t in texts + noise(7, "a1.@-+ 2(5)%", 8000, 60) + ["4111 1111 1111 1111", "@a.b x@a.b@c.d", "1.2.3.4.5.6.7.8", "0256.1.1.1 001.2.3.255", "1" * 5000]:
        want = [(k, *m.span()) for k in RULES for m in re.finditer(RULES[k], t) if VALID[k](m.group())]
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == want


def test_checksums_and_context():
    found = pii.find_spans("IBAN DE89 3704 0044 0532 0130 00 ok, ssn 123-45-6789, call (974) 555-3436")
    assert [s[0] for s in found] == ["iban", "ssn", "national_phone"]
    assert pii.find_spans("DE88 3704 0044 0532 0130 00, part 123-45-6789 of (974) 555-3436") == []
    key = "9f86d081884c7d659a2feaa0c55ad015"
    assert [s[:3] for s in pii.find_spans(f'token = "{key}"')] == [("secret", 9, 41)]
    assert pii.find_spans(f"word {key}") == pii.find_spans("token = aaaa1111aaaa1111") == pii.find_spans("secret key abcdefghijklmnopqrstuvwxyz") == []
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_planted_spans_are_found_by_kind():
    """A span of each kind in each of many texts, between words: all are found, and nothing in the words alone."""
    rng, digits = random.Random(9), lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    def iban():
        body = digits(18)
        return next(f"DE{k:02d}{body}" for k in range(2, 99) if pii.mod97(f"DE{k:02d}{body}"))

    make = {
        "email": lambda: f"ab.{digits(2)}@mail{digits(1)}.example.com",
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+1 ({rng.randrange(200, 999)}) 555-{digits(4)}",
        "iban": iban,
        "ssn": lambda: f"ssn {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "national_phone": lambda: f"call (212) 555-{digits(4)}",
        "secret": lambda: f'token = "{rng.getrandbits(160):040x}"',
    }
    words = lambda: " ".join(rng.choice(["the", "erand", "ñja", "of."]) for _ in range(rng.randrange(1, 30)))
    for kind, of in make.items():
        found = [any(s[0] == kind for s in pii.find_spans(f"{words()} {of()} {words()}")) for _ in range(200)]
        assert sum(found) >= 198, kind  # a random key may lack letters or digits
    assert not any(pii.find_spans(words()) for _ in range(200))


def test_many_spans_take_linear_time():
    import time

    text = "ab.12@mail.example.com, 10.2.3.4 iban DE89 3704 0044 0532 0130 00; ssn 123-45-6789\n" * 6000
    began = time.perf_counter()
    assert len(pii.find_spans(text)) == 4 * 6000
    assert time.perf_counter() - began < 5


def test_personal_data_rows(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "x@y.zz"), (2, "")], DOC).withColumn("spans", F.lit(1))
    got = {(r["doc_id"], r["n_email"], r["spans"]) for r in pii.find_personal_data(d).collect()}
    assert got == {(1, 0, ""), (2, 0, ""), (None, 1, "email:0:6")}
    assert pii.find_personal_data(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 100, 3000, 9216, 70000])
def test_lzw_round_trip(n):
    rng = random.Random(n)
    for data in (rng.randbytes(n), b"a" * n, bytes(rng.choice(b"ab") for _ in range(n))):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data
    small = bytes(rng.randrange(4) for _ in range(n))
    assert gif.lzw_decode(gif.lzw_encode(small, 2), 2, n) == small


def slow_lzw(data, bits):
    """A decoder that reads bit by bit."""
    clear, out, table, width, held, n, last = 1 << bits, [], None, bits + 1, 0, 0, None
    for byte in data:
        held |= byte << n
        n += 8
        while n >= width:
            code, held, n = held & (1 << width) - 1, held >> width, n - width
            if code == clear:
                table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], bits + 1, None
                continue
            if code == clear + 1:
                return b"".join(out)
            entry = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            out.append(entry)
            last = entry
    return b"".join(out)


def test_streams_are_plain_lzw():
    for data in (random.Random(1).randbytes(30_000), b"abc" * 9000):
        assert slow_lzw(gif.lzw_encode(data), 8) == data


def animation():
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    out = b"GIF89a" + bytes([4, 0, 4, 0, 0x81, 0, 0]) + palette

    def image(pixels, place, disposal, transparent=None, interlace=False, delay=5):
        control = bytes([disposal << 2 | (transparent is not None), delay, 0, transparent or 0])
        head = b"".join(v.to_bytes(2, "little") for v in place) + bytes([0x40 if interlace else 0])
        return b"\x21\xf9\x04" + control + b"\0\x2c" + head + b"\x02" + gif._blocks(gif.lzw_encode(bytes(pixels), 2))

    out += image([0] * 16, (0, 0, 4, 4), 1)
    out += image([1, 3, 3, 1], (1, 1, 2, 2), 3, transparent=3)
    out += image([2] * 4, (0, 0, 2, 2), 2)
    out += image([k // 4 % 4 for k in range(16)], (0, 0, 4, 4), 0, interlace=True)
    return out + b"\x3b"


def test_disposal_transparency_and_interlace():
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    one, two, three, four = list(gif.decode(animation()))
    assert (one.canvas == red).all()
    assert tuple(two.canvas[1, 1]) == green and tuple(two.canvas[1, 2]) == red
    assert tuple(three.canvas[0, 0]) == blue and tuple(three.canvas[1, 1]) == blue and tuple(three.canvas[2, 2]) == red
    assert [tuple(four.canvas[k, 0]) for k in (0, 2, 1, 3)] == [red, green, blue, (9, 9, 9, 255)]
    assert [f.start_ms for f in (one, two, three, four)] == [0, 50, 100, 150]
    assert sum(gif.histogram(one)) == 48


def test_gif_columns(spark):
    d = spark.createDataFrame([(1, animation()), (2, None), (3, b"no")], "doc_id long, gif binary")
    rows = gif.frames_column(d, "doc_id", "gif").collect()
    assert sorted((r["doc_id"], r["frame"] is not None) for r in rows) == [(1, True)] * 4 + [(2, False), (3, False)]
    texts = [(1, None), (2, ""), (3, "x" * 20_000), (None, "é"), (4, "x" * 20_000)]
    got = {r["doc_id"]: r for r in gif.store_texts(spark.createDataFrame(texts, DOC).withColumn("gif", F.lit(1))).collect()}
    for key, text in texts:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[key]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert gif.payload_of(r["gif"])[0] == payload
    assert got[3][1:] == got[4][1:]


def test_unknown_language_is_rejected(spark):
    import random

    rng = random.Random(4)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(30)) for _ in range(20)]
    other = ["Хорошо жить на свете и знать много слов", "これは日本語の文章です", "to jest zdanie po polsku którego nikt się nie uczył", "tämä on suomenkielinen lause jota kukaan ei ole opettanut"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs, usable=fold != 1)
    assert all(model.predict([*junk, *other])[2])
    assert model.predict(["the and of the"])[2] == [False]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs, usable=fold != 1)
    got = langid.identify(docs.where(fold == 1), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97
    assert sum(r["rejected"] for r in got) / len(got) < 0.01
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (3, "12 34 !?"), (None, "the and of the")], DOC).withColumn("score", F.lit(0))
    found = sorted((tuple(r) for r in langid.identify(odd, model).collect()), key=str)
    assert [r[1] for r in found if r[0] is not None] == ["und"] * 4 and [r[1] for r in found if r[0] is None] == ["en"]
    kept = langid.keep_identified(odd.withColumn("lang", F.lit(None).cast("string")), model).collect()
    assert [(r["doc_id"], r["lang"]) for r in kept] == [(None, "en")]
    for unlabelled in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        none = langid.train(unlabelled)
        assert none.predict(["the and", None]) == (["und"] * 2, [0.0] * 2, [True] * 2)
        assert langid.identify(odd, none).count() == 5


def test_letters_and_sample_bounds(spark):
    rows = [(k, " ".join(["der die und", "the and of"][k % 2] for _ in range(k % 7 + 1)), ["de", "en"][k % 2]) for k in range(60)]
    rows += [(100, "x y " * 50_000, "xx"), (101, None, "de"), (102, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, most_bytes=20_000)
    assert model.langs == ["de", "en"]  # the long row does not fit
    assert langid.train(docs).langs == ["de", "en", "xx"]
    langs, scores, rejected = model.predict(["½ ² 12", "Ⅷ ①", "_ _", "", None, "der und die"])
    assert langs == ["und"] * 5 + ["de"] and scores[:5] == [0.0] * 5 and rejected[:5] == [True] * 5


def test_very_long_texts(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(11)
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(500_000)) + " 10.2.3.4\nx@y.zz"
    assert [s[:3] for s in pii.find_spans(long)] == [("email", len(long) - 6, len(long)), ("ip", len(long) - 15, len(long) - 7)]
    assert pii.find_spans("1" * 1_000_000 + " " + "a" * 1_000_000) == []
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert pieces.ChunkTable(tokenizer_file("piece_bpe_32k.model")).encode([long]) == [",".join(map(str, library.encode(long)))]
    model = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    assert token_files.ByteTable(tokenizer_file("byte_bpe_50k.json"), added_tokens=True).encode([long]) == [np.array(model.encode(long, add_special_tokens=False).ids, "<u4").tobytes()]
    learned = langid.fit(["der die das und"] * 3 + ["the of and to"] * 3, ["de"] * 3 + ["en"] * 3)
    assert learned.predict(["der die das und " * 200_000])[0] == ["de"]
    d = spark.createDataFrame([(1, long[:300_000])], DOC)
    assert gif.store_texts(d).first()["n_bytes"] == len(long[:300_000].encode())


def test_empty_tables(spark):
    d = spark.createDataFrame([], DOC)
    assert gif.store_texts(d).count() == 0
    assert pieces.encode_decode(d, tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_damaged_streams_give_no_frames(spark):
    whole = animation()
    cut = [whole[:k] for k in range(6, len(whole), 3)]
    rows = [(k, x) for k, x in enumerate(cut)] + [(-1, b""), (-2, b"GIF89a"), (-3, None)]
    got = gif.frames_column(spark.createDataFrame(rows, "doc_id long, gif binary"), "doc_id", "gif").collect()
    assert {r["doc_id"] for r in got} == {k for k, _ in rows}


def plain_language(model, text):
    """Language, score and rejection of a text, subword by subword from the stored table."""
    import math

    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    raw = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b"    "
    total, count, seen, whole = [0.0] * len(model.langs), 0, 0, 0
    for i in range(len(raw)):
        for size in range(1, 5):
            run = raw[i : i + size]
            if len(run) < size or (run[0] == 32 if size == 1 else run[:2] == b"  "):
                continue
            value = 0
            for b in run:
                value = value * 257 + b + 1
            mixed = value * 0x9E3779B97F4A7C15 % 2**64
            total = [x + float(y) for x, y in zip(total, model.table[mixed >> 64 - langid.BUCKET_BITS])]
            count += 1
            if size == 4 and 32 not in run[1:3]:
                whole += 1
                seen += bool(model.seen[mixed >> 64 - langid.SEEN_BITS])
    z = [(x / count + float(b)) * model.scale for x, b in zip(total, model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    best = max(range(len(z)), key=lambda k: (z[k], -k))
    score, share = e[best] / sum(e), seen / whole if whole else 1.0
    return model.langs[best], score, score < model.least or share < model.least_seen


def test_language_equals_plain_scorer(spark):
    """Every held-out document's prediction, probability and rejection, and those of odd texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs, usable=fold != 1)
    texts = {r["doc_id"]: r["text"] for r in docs.where(fold == 1).where("length(text) < 1500").collect()}
    texts |= {-1: "a", -2: "É", -3: "x y", -4: "Straße über den Fluss", -5: "日本語 text", -6: "\n\n the \t of", -7: "12", -8: None, -9: "ab" * 3000}
    odd = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert len(got) == len(texts) > 150
    for k, text in texts.items():
        lang, score, rejected = plain_language(model, text)
        assert (got[k]["lang_pred"], got[k]["rejected"]) == (lang, rejected) and abs(got[k]["score"] - score) < 1e-4


def test_claimed_pixels_are_refused(spark):
    """A few bytes that claim very many pixels, as the canvas or as an image, give an error row and take no memory."""
    import struct

    canvas = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08\x02\x00\x01\x00;"
    image = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08\x02\x00\x01\x00;"
    got = gif.frames_column(spark.createDataFrame([(1, bytearray(canvas)), (2, bytearray(image)), (3, None)], "k int, g binary"), "k", "g").collect()
    assert sorted((r["k"], r["frame"], "pixels" in (r["error"] or "")) for r in got) == [(1, None, True), (2, None, True), (3, None, False)]


def test_files_open_at_once(tmp_path):
    """2,000 stored shards are read under a limit of 256 open files."""
    import subprocess
    import sys

    code = f"""
import resource, numpy as np
resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))
from lodemill.llm.common import Shared, U64
from lodemill.llm.lookup import look_up
shared = Shared("file://{tmp_path}")
keys = (np.arange(2000, dtype=U64) << U64(53)) + U64(7)
for s in range(2048):
    own = keys[s : s + 1]
    shared.save(f"t-key-{{s}}", own)
    shared.save(f"t-v-{{s}}", (own >> U64(53)).astype(np.int64))
hit, (v,) = look_up(keys, shared, "t", ["key", "v"], 2048)
assert hit.all() and (v == np.arange(2000)).all()
hit, (v,) = look_up(keys[::-1], shared, "t", ["key", "v"], 2048)
assert hit.all() and (v[::-1] == np.arange(2000)).all()
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_byte_table_keeps_frequent_chunks(monkeypatch):
    monkeypatch.setattr(token_files, "TABLE_CHUNKS", 50)
    table = token_files.ByteTable(tokenizer_file("byte_bpe_50k.json"))
    frequent, texts = "often met words come again", [f"often met words come again and once word{k}x word{k}y word{k}z" for k in range(200)]
    merged = []
    merge = table.merge
    monkeypatch.setattr(table, "merge", lambda token: merged.append(token) or merge(token))
    monkeypatch.setattr(table, "words", {})
    got = [table.encode([t])[0] for t in texts]
    assert got == table._plain(texts)
    assert table.met < 650 and max(len(table), len(table.aside)) <= 50  # 600 chunks are met once
    assert all(sum(t.strip("Ġ") == w for t in merged) < 10 for w in frequent.split())


def test_books_of_numbers_are_read_once(spark):
    from lodemill.llm import ngram_lm

    shared = common.Shared.create(spark, "books")
    shared.save("t1-0.book", np.arange(3, dtype=np.uint64))
    first = ngram_lm._book(shared, "t1-0")
    shared.save("t1-0.book", np.zeros(1, np.uint64))
    assert ngram_lm._book(shared, "t1-0") is first and first.tolist() == [0, 1, 2]
    other = common.Shared.create(spark, "books")
    other.save("t1-0.book", np.full(2, 7, np.uint64))
    assert ngram_lm._book(other, "t1-0").tolist() == [7, 7] and len(ngram_lm._books) == 1


def test_a_file_is_opened_once_for_a_search_and_keeps_all_numbers(spark, monkeypatch):
    from lodemill.llm import ngram_lm

    shared, rng = common.Shared.create(spark, "grams"), np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    fields = [np.where(np.arange(len(keys)) % 7 == 0, rng.integers(0, 5000, len(keys)), rng.integers(0, 40, len(keys))) for _ in range(2)]
    with ngram_lm.ExitStack() as stack:
        out = ngram_lm._Writer(shared, "t3-0", 1, 2, stack)
        out.add(keys[:3000], [f[:3000] for f in fields])
        out.add(keys[3000:], [f[3000:] for f in fields])
        out.finish()
    opened, held = [], common._held
    monkeypatch.setattr(common, "_held", lambda uri, name, make: opened.append(name) or held(uri, name, make))
    tables = ngram_lm.Tables(shared, 1, 3, {3: (0,)})
    wanted = np.unique(np.concatenate([keys[::2], rng.integers(0, 1 << 63, 3000).astype(np.uint64)]))
    got, known = tables.get(3, wanted, (0, 1)), np.isin(wanted, keys)
    for f, g in zip(fields, got, strict=True):
        assert (g[known] == f[np.isin(keys, wanted)]).all() and not g[~known].any()
    assert opened == ["t3-0.high"]


def test_what_texts_add_is_sorted_once_for_each_length(monkeypatch):
    from lodemill.llm import ngram_lm

    sorts, order_of = [], common.order_of
    for module in (common, ngram_lm):
        monkeypatch.setattr(module, "order_of", lambda keys, *a, **k: sorts.append(len(keys)) or order_of(keys, *a, **k))
    monkeypatch.setattr(ngram_lm.Tables, "get", lambda self, n, keys, fields=(0, -1): np.ones((len(fields), len(keys)), np.int64))
    texts = [b"a b a b", b"", b"b a"]
    for n in (1, 2):
        sorts.clear()
        keys, fields = ngram_lm.counted(texts, n, ngram_lm.Tables(None, 1, 3, {}))
        assert len(sorts) == 2 and len(fields) == 6
    pairs = {("^", "a"): 1, ("a", "b"): 1, ("b", "a"): 2, ("b", "$"): 1, ("^", "$"): 1, ("^", "b"): 1, ("a", "$"): 1, ("^", "^"): 0}
    assert sorted(fields[-1].tolist()) == sorted(pairs.values())
