"""Plain Python versions of the operators, to compare with."""

import collections
import hashlib
import math
import re

import xxhash

from lodemill.llm import lines, ngram_lm


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def hit_words(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = collections.defaultdict(set)
    for key, text in items:
        if text is not None and key is not None and (w := split(text)):
            n = min(len(w), 10)
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(key))
    sizes, out = sorted({len(w) for w in windows}), []
    for key, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) - len(b) == 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def dropped_lines(docs, same_words=lines.SAME_WORDS, near_words=lines.NEAR_WORDS):
    every = []
    for key, text in set(docs):
        raw = (text or "").encode()
        for pos, line in enumerate(raw.split(b"\n")):
            every.append(((lines.NULL_ID if key is None else key, xxhash.xxh3_64_intdigest(raw) >> 1, pos), tuple(line.lower().split()), (key, text, pos)))
    gone, seen = set(), set()
    for _, words, at in sorted(every, key=lambda x: x[0]):
        if len(words) >= same_words:
            if words in seen or len(words) >= near_words and any(len(s) >= near_words and one_edit(words, s) for s in seen):
                gone.add(at)
            seen.add(words)
    out = []
    for key, text in docs:
        parts = (text or "").split("\n")
        drop = [p for p in range(len(parts)) if (key, text, p) in gone]
        kept = "\n".join(x for p, x in enumerate(parts) if p not in drop)
        out.append((key, len(parts), len(drop), tuple(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shingles(text, size=5):
    w = low(text).encode().split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def jaccard_groups(docs):
    sets, top = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if sets[j] and find(j) == find(i) and docs[j][0] is not None]
        out.append((key, len(sets[i]), (min(ids) if ids else None) if sets[i] else key))
    return sorted(out, key=str)


def kneser_ney(train, texts, order):
    tokens = lambda t: [None] * (order - 1) + low(t).encode().split() + ["end"]
    counts = [collections.Counter() for _ in range(order + 1)]
    for t in train:
        w = tokens(t)
        counts[order].update(tuple(w[k - order + 1 : k + 1]) for k in range(order - 1, len(w)))
    raw = collections.Counter(g[-1] for g in counts[order].elements())
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    discount, follow = {}, {}
    for n in range(1, order + 1):
        discount[n] = (0, *ngram_lm._discounts(*[sum(v == k for v in counts[n].values()) for k in (1, 2, 3, 4)]))
        for g, v in counts[n].items():
            x = follow.setdefault((n, g[:-1]), [0, 0, 0, 0])
            x[0] += v
            x[min(v, 3)] += 1
    size, total = len(counts[1]), sum(raw.values())

    def p(g):
        n, lower = len(g), 1 / (size + 1) if len(g) == 1 else p(g[1:])
        if (n, g[:-1]) not in follow:
            return lower
        t, c = follow[n, g[:-1]], counts[n].get(g, 0)
        return max(c - discount[n][min(c, 3)], 0) / t[0] + sum(a * b for a, b in zip(discount[n][1:], t[1:])) / t[0] * lower

    out = []
    for t in texts:
        w = tokens(t)
        grams = [tuple(w[k - order + 1 : k + 1]) for k in range(order - 1, len(w))]
        out.append((len(grams), sum(raw[g[-1]] > 0 for g in grams), total, sum(math.log10((raw[g[-1]] + 1) / (total + size + 1)) for g in grams), sum(math.log10(p(g)) for g in grams)))
    return out, p, [g[0] for g in counts[1]]
