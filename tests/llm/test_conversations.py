"""Repair of conversations against a programme over strings and against all edits of short ones."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodemill.llm import conversations as C
from lodemill.llm.common import Shared

GOOD = re.compile(r"(s?(ua)+)?\Z")
SHAPE = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """The contract's damage, row by row: {conversation: rows}."""
    shown, out = (lambda x: " " if x is None else str(x)), {}
    for c, t, r, x in rows:
        held, kind = out.setdefault(c, []), zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20
        r, x = shown(r), shown(x)
        x = "" if kind == 1 else re.sub(r"[.!?]", "", x) if kind == 2 else x
        held.extend([(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return out


def plain(rows):
    """The report of a conversation by strings: (cost, audit) of each role sequence state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, kinds = set(), []
    for _, r, x in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", x)
        kinds.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(states):
        new = dict(states)
        for _ in range(3):
            for q, (cost, audit, said) in list(new.items()):
                for role in ("user", "assistant"):
                    if (q, role[0]) in step:
                        to = step[q, role[0]]
                        new[to] = min(new.get(to, (10**9, "", [])), (cost + 5, audit + "I", [*said, (role, "")]))
        return new

    states = {"": (0, "", [])}
    for (_, r, x), kind in zip(rows, kinds):
        after = {}
        for q, (cost, audit, said) in inserted(states).items():
            ways = [(q, cost + 2, "D", said)]
            if kind in ("", "truncated"):
                more = 5 * (kind == "truncated")
                ways += [(step[q, new[:1]], cost + more + price, e, [*said, (new, x)]) for new, price, e in ((r, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")) if (q, new[:1]) in step]
            for to, price, e, line in ways:
                after[to] = min(after.get(to, (10**9, "", [])), (price, audit + e, line))
        states = after
    cost, audit, said = min(v for q, v in inserted(states).items() if q in ("", "a"))
    text = "\n".join(f"{r}:{x}" for r, x in said)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def columns(r):
    return tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def conversations(seed, n, longest):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c or None, rng.choice([t, t, t, t, t // 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["Yes.", "No", "So it is!", " ", None, f"{t}.", "é", "Why? \n"])))
    return rows


def test_programme_equals_strings():
    for seed in range(400):
        rng = random.Random(seed)
        rows = [(t, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", f"{t}!", "c?"])) for t in range(rng.randint(0, 12))]
        assert columns(C.repair_rows(sorted(rows))) == plain(rows)


def test_cheapest_of_all_edits():
    """Every string of edits of short conversations, tried out."""

    @functools.cache
    def best(row_kinds):
        found = []
        for runs in itertools.product(range(3), repeat=len(row_kinds) + 1):
            for edits in itertools.product("KDua", repeat=len(row_kinds)):
                cost, roles, audit = 5 * sum(runs), [], ""
                for k, n in enumerate(runs):
                    roles += ["?"] * n
                    audit += "I" * n
                    if k < len(row_kinds):
                        e, (role, kind) = edits[k], row_kinds[k]
                        if e != "D" and kind == "f":
                            break
                        cost += 2 if e == "D" else 5 * (kind == "t") + (e != "K")
                        roles += [] if e == "D" else [role if e == "K" else e]
                        audit += e if e in "KD" else "R"
                else:
                    for fill in itertools.product("ua", repeat=roles.count("?")):
                        f = iter(fill)
                        if GOOD.match("".join(next(f) if r == "?" else r for r in roles)):
                            found.append((cost, audit))
                            break
        return min(found)

    texts = {"f": " ", "t": "x", "o": "x."}
    for n in range(3):
        for kinds in itertools.product([("u", "o"), ("a", "t"), ("s", "o"), ("a", "o"), ("t", "o"), ("u", "f")], repeat=n):
            rows = [(t, {"u": "user", "a": "assistant", "s": "system", "t": "tool"}[r], texts[k] if k != "o" else f"{t}.") for t, (r, k) in enumerate(kinds)]
            if len({(r, x) for _, r, x in rows if x == "x"}) == sum(x == "x" for _, _, x in rows):
                got = C.repair_rows(rows)
                assert (got["cost"], got["audit"]) == best(kinds)


@pytest.mark.parametrize("longest", [9, 400])
def test_damaged_tables(spark, longest):
    rows = conversations(longest, 60 if longest == 9 else 5, longest)
    turns = spark.createDataFrame(rows, SHAPE).repartition(3)
    made = C.repair(C.damage(turns), Shared.create(spark, "test"), present=C.F.col("present"))
    got = {r["conv_id"]: r for r in made.collect()}
    want = damaged(rows)
    assert set(got) == set(want)
    for c, held in want.items():
        assert columns(got[c]) == plain(held)
        assert hashlib.sha256(got[c]["repaired"].encode()).hexdigest() == got[c]["repaired_sha256"]


def test_one_conversation_in_many_segments(spark):
    """A hot conversation is cut into the ranges of all partitions; other columns, whatever their names, play no part."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t % 97}.", f"{t}", "Same.", ""])) for t in range(3000)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE + ", part string, c int")
    got = C.repair(turns, Shared.create(spark, "test"), keep_text=False).collect()
    assert len(got) == 1 and columns(got[0]) == plain([r[1:] for r in rows])


def test_empty_and_dropped(spark):
    assert C.repair(C.damage(spark.createDataFrame([], SHAPE)), Shared.create(spark, "test"), present=C.F.col("present")).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, gone, "user", "Hi."), (2, None, None, None), (2, None, None, None)]
    got = {r["conv_id"]: columns(r) for r in C.repair(C.damage(spark.createDataFrame(rows, SHAPE)), Shared.create(spark, "test"), present=C.F.col("present")).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2] == plain(damaged(rows)[2])
