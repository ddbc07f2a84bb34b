"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte runs of one to four, lower-cased, with anything but letters as one
space. Each is hashed into a bucket; a bucket has an embedding; a text is the average of its
subwords' embeddings, on which a linear softmax stands. Both layers are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows. A temperature fitted
on rows kept out of the training calibrates the probabilities. Two thresholds reject texts: one on
the probability, and one on the share of the text's longest subwords that the labelled rows hold,
as a softmax is sure of text in no known language too. Each is set so that no more than a stated
share of labelled rows, each scored as if it were not known itself, would be rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import U64, map_arrow, spans

#: Hash buckets, embedding size, longest subword in bytes.
BUCKET_BITS, DIMS, LONGEST = 15, 16, 4
#: Bits of the hash under which a longest subword counts as seen.
SEEN_BITS = 22
#: Labelled rows used for training and calibration, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 64 << 20
#: Steps of training at least, however few the rows.
LEAST_STEPS = 1000
#: Share of the labelled rows that may be rejected.
REJECT_SHARE = 0.001
UNKNOWN = "und"

_GAP = b" " * LONGEST
_MUL = U64(0x9E3779B97F4A7C15)
#: ASCII but letters becomes a space.
_LETTERS = bytes(b if b >= 128 or bytes([b]).isalpha() else 32 for b in range(256))


def _clean(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_LETTERS) + _GAP


def subwords(cleaned: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the subwords at each byte, one length after another, which bytes count, and the hashes."""
    raw = np.frombuffer(b"".join(cleaned), np.uint8)
    code = raw.astype(U64)
    space = raw == 32
    n = len(raw)
    value = np.zeros(n, U64)
    for k in range(LONGEST):
        value[: n - k] = value[: n - k] * U64(257) + code[k:] + U64(1)
        # A subword may begin or end with the space beside a word but not lie in a gap.
        keep = ~space if k == 0 else ~(space & np.roll(space, -1))
        mixed = value * _MUL
        yield (mixed >> U64(64 - BUCKET_BITS)).astype(np.int32), keep, mixed


def _long(keep: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Which longest subwords lie in one word with the spaces beside it."""
    inner = np.roll(space, -1) | np.roll(space, -2)
    return keep & ~inner


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket by language: embedding times weights, and a row of zeros
    bias: np.ndarray
    scale: float  # one over the temperature
    least: float  # below it a prediction is rejected
    seen: np.ndarray  # whether the labelled rows hold a longest subword, by its hash
    least_seen: float = 0.0  # a text with a lower share of seen ones is rejected

    def logits(self, texts: list[str]) -> np.ndarray:
        return self.measure(texts)[0]

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the share of the longest subwords that were seen: 1 where there are none."""
        cleaned = [_clean(t) for t in texts]
        bounds = np.cumsum([0, *map(len, cleaned)])[:-1]
        total, count = 0, 0
        for bucket, keep, mixed in subwords(cleaned):
            bucket[~keep] = 1 << BUCKET_BITS  # the row of zeros after the table
            total = total + self.table[bucket]
            count = count + keep.astype(np.int32)
        sums = np.add.reduceat(total, bounds, axis=0, dtype=np.float64)
        inner = _long(keep, np.frombuffer(b"".join(cleaned), np.uint8) == 32)
        known = inner & self.seen[mixed >> U64(64 - SEEN_BITS)]
        whole = np.add.reduceat(inner, bounds, dtype=np.int64)
        share = np.where(whole > 0, np.add.reduceat(known, bounds, dtype=np.int64) / np.maximum(whole, 1), 1.0)
        return sums / np.maximum(np.add.reduceat(count, bounds), 1)[:, None] + self.bias, share

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, calibrated probability, and whether it is rejected."""
        langs, scores, rejected = [], [], []
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        known = [t if t and any(map(str.isalpha, t)) else None for t in texts]
        for first, last in spans([(t or "").encode() for t in known], 1 << 18):
            part = known[first:last]
            z, shares = self.measure([t or "" for t in part])
            for t, row, share in zip(part, softmax(z * self.scale), shares.tolist(), strict=True):
                best = int(row.argmax())
                langs.append(self.langs[best] if t else UNKNOWN)
                scores.append(float(row[best]) if t else 0.0)
                rejected.append(not t or float(row[best]) < self.least or share < self.least_seen)
        return langs, scores, rejected


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    every = np.concatenate([bucket[keep] for bucket, keep, _ in subwords([_clean(text)])])
    buckets, n = np.unique(every, return_counts=True)
    return buckets, (n / max(1, n.sum())).astype(np.float32)


def _low_score(scores: np.ndarray, share: float) -> float:
    """Score below which a share of the rows is expected: the sample's, or lower by an exponential tail of the log odds, as few rows show no rare score."""
    p = np.clip(scores, 1e-12, 1 - 1e-12)
    some, more = np.quantile(np.log(p / (1 - p)), [0.05, 0.2])
    tail = some - (more - some) * np.log(0.05 / share) / np.log(4)
    return float(min(np.quantile(scores, share, method="lower"), 1 / (1 + np.exp(-tail))))


def fit(texts: list[str], langs: list[str], epochs: int = 8, rate: float = 4.0, batch: int = 16, seed: int = 7) -> Model:
    """Train on labelled texts; every fifth is kept for the calibration. From none, a model that knows no language."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 1.0, np.zeros(1, bool))
    rng = np.random.default_rng(seed)
    rows = [_features(t) for t in texts]
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(rows))
    held = order[::5] if len(rows) >= 20 else order
    used = order[np.arange(len(order)) % 5 > 0] if len(rows) >= 20 else order
    e = rng.normal(0, 0.3, (1 << BUCKET_BITS, DIMS)).astype(np.float32)
    w, bias = np.zeros((DIMS, len(names)), np.float32), np.zeros(len(names), np.float32)
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(used)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for first in range(0, len(used), batch):
            part = used[first : first + batch]
            at = np.concatenate([rows[k][0] for k in part])
            share = np.concatenate([rows[k][1] for k in part])
            own = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
            starts = np.searchsorted(own, np.arange(len(part)))
            x = np.add.reduceat(e[at] * share[:, None], starts, axis=0)
            g = softmax(x @ w + bias)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            back = g @ w.T
            w -= step * (x.T @ g)
            bias -= step * 0.1 * g.sum(0)
            np.subtract.at(e, at, step * back[own] * share[:, None])
    longest = []
    for t in texts:
        cleaned = _clean(t)
        *_, (_, keep, mixed) = subwords([cleaned])
        longest.append((mixed[_long(keep, np.frombuffer(cleaned, np.uint8) == 32)] >> U64(64 - SEEN_BITS)).astype(np.int32))
    holders = np.zeros(1 << SEEN_BITS, np.int32)
    for found in longest:
        holders[np.unique(found)] += 1
    # What each row would score if it were not known itself.
    shares = np.array([(holders[found] > 1).mean() if len(found) else 1.0 for found in longest])
    model = Model(names, np.vstack([e @ w, np.zeros((1, len(names)))]).astype(np.float32), bias.astype(np.float64), 1.0, 0.0, holders > 0)
    z = np.concatenate([model.logits([texts[k]]) for k in held])
    loss = {s: -np.log(np.maximum(softmax(z * s)[np.arange(len(held)), y[held]], 1e-12)).mean() for s in np.geomspace(0.1, 40, 61)}
    # The least scale that does as well: rows that are all told right would else drive it up until every probability is 1.
    model.scale = float(min(s for s in loss if loss[s] <= min(loss.values()) + 0.001))
    best = softmax(z * model.scale).max(1)
    # A labelled row that has a threshold itself is not rejected.
    if len(names) > 1:
        model.least = _low_score(best, REJECT_SHARE)
    model.least_seen = float(np.quantile(shares, REJECT_SHARE, method="lower")) if len(texts) > 1 else 0.0
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, usable=None) -> Model:
    """Learn from at most ``rows`` labelled rows, those with the lowest hash of id and length, and at most ``most_bytes`` of text.

    A row whose text does not fit into what is left of the bytes is not used. Rows with a null
    text or label are left out; ``usable`` may restrict the rest. Without labelled rows the model
    gives every text ``und`` and rejects it.
    """
    kept = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    kept = kept.where(usable) if usable is not None else kept
    labelled = kept.select(F.xxhash64(F.col(id_col), F.octet_length(text_col)).alias("h"), F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    # Hashes and sizes first, so that no text is sorted; then the texts of those rows.
    lowest, chosen, total = labelled.select("h", F.octet_length("t").alias("n")).orderBy("h", "n").limit(rows).collect(), set(), 0
    for r in lowest:
        if total + r["n"] <= most_bytes:
            total += r["n"]
            chosen.add(r["h"])
    if not chosen:
        return fit([], [])
    # Of rows that share id and length those with the lowest hash of the text.
    some = labelled.where(F.col("h") <= max(chosen)).where(F.col("h").isin(sorted(chosen)))
    got = some.orderBy("h", F.xxhash64("t"), "l").limit(len(lowest)).collect()
    got.sort(key=lambda r: (r["h"], str(r["k"]), r["t"]))
    return fit([r["t"] for r in got], [r["l"] for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``rejected`` of each row, from the whole text alone.

    A null text and one without a letter give ``und``, score 0, rejected, and so does every text to a model that knows no language. Repeated rows give
    repeated results; no other column is read.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is not rejected, all columns as they were, with the predicted language in ``lang_col`` where it was null."""
    names = docs.columns
    at, lang_at = names.index(text_col), names.index(lang_col) if lang_col in names else None

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, rejected = model.predict(batch.column(at).to_pylist())
            columns = list(batch.columns)
            if lang_at is not None:
                columns[lang_at] = pa.array([old if old is not None else new for old, new in zip(columns[lang_at].to_pylist(), langs, strict=True)], columns[lang_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array([not r for r in rejected]))

    return map_arrow(docs, run, docs.schema)
