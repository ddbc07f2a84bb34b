"""Conversation structure repair: the cheapest edits that make turns alternate.

A conversation's rows, by turn, become a sequence of role initials that reads ``(s?(ua)+)?``. Each
row takes one macro edit: a run of inserted turns, then the row is kept, deleted or given another
role. The macro edits are codes of which none begins another, so of two strings of as many codes
the first code that differs decides, and the order of the codes is the order of the strings. The
dynamic programme therefore holds no strings: in each layer a state has its cost and the rank of
its string among the layer's strings, ranked by (rank of the parent, code), and a byte that points
to its parent. Strings are put together afterwards.

Rows are dealt by ranges of (conversation, turn). A conversation inside one range is repaired
there. One that a range's end cuts is repaired in segments: each segment gives cost and rank from
every state to every other, these are joined along the conversation, and then each segment is put
together on its own. So no task holds more than a range's rows, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import Shared, input_bytes, map_arrow

#: Costs of a new role, a deletion, an insertion, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Input bytes for each range of rows, and characters of a text that order ranges.
RANGE_BYTES, PREFIX = 8 << 20, 64
#: Macro edits in the order of their strings; a run of more than two insertions comes back to a state it had.
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a turn that is made to fit, and what ends a conversation in a state.
_MADE, _TAIL = (USER, USER, ASSISTANT, USER), ("", "II", "I", "")
_FAR = 1 << 60
_LEGAL = {"su", "ua", "au"}


@lru_cache(64)
def _moves(forced: bool, cut: bool, initial: str) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, code) of the best macro edit between two states for a kind of row."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for code, text in enumerate(CODES):
        for state in range(4):
            at = state
            for _ in text[:-1]:
                at = _MADE[at]
            cost, stay = INSERT * (len(text) - 1), TRUNCATED * cut
            if text[-1] == "D":
                to, cost = at, cost + DELETE
            elif forced or text[-1] == "K" and (at, initial) not in _KEPT:
                continue
            elif text[-1] == "K":
                to, cost = _KEPT[at, initial], cost + stay
            else:
                to, cost = _MADE[at], cost + REROLE + stay
            best[state, to] = min(best.get((state, to), (_FAR, 0)), (cost, code))
    return tuple((a, b, *x) for (a, b), x in best.items())


class Layers:
    """The programme over a run of rows, from each of some states: lanes of four states."""

    def __init__(self, starts: tuple[int, ...]):
        self.starts, n = starts, 4 * len(starts)
        self.cost, self.rank, self.back = [_FAR] * n, [0] * n, []
        for lane, state in enumerate(starts):
            self.cost[4 * lane + state] = 0

    def add(self, forced: bool, cut: bool, initial: str) -> None:
        moves = _moves(forced, cut, initial if initial in ("s", "u", "a") else "")
        n = len(self.cost)
        cost, key, back = [_FAR] * n, [(-1, 0)] * n, bytearray(n)
        for lane in range(0, n, 4):
            for a, b, price, code in moves:
                before = self.cost[lane + a]
                if before < _FAR:
                    total, own, to = before + price, (self.rank[lane + a], code), lane + b
                    if total < cost[to] or total == cost[to] and own < key[to]:
                        cost[to], key[to], back[to] = total, own, a | code << 2
        places = {k: r for r, k in enumerate(sorted({k for k, c in zip(key, cost, strict=True) if c < _FAR}))}
        self.cost, self.rank = cost, [places.get(k, 0) for k in key]
        self.back.append(back)

    def trace(self, lane: int, end: int) -> list[str]:
        """The codes of the way from a lane's start to a state."""
        out, at = [], end
        for back in reversed(self.back):
            x = back[4 * lane + at]
            out.append(CODES[x >> 2])
            at = x & 3
        return out[::-1]


def best_end(cost: list[int], rank: list[int]) -> tuple[int, int]:
    """Cost and state of the cheapest way that ends well; of equals the one whose string is first."""
    total, _, tail, state = min((cost[q] + INSERT * len(_TAIL[q]), rank[q], _TAIL[q], q) for q in range(4) if cost[q] < _FAR)
    return total, state


def repaired(rows: list[tuple[str, str]], codes: list[str], state: int, tail: str = "") -> Iterator[tuple[str, str]]:
    """Role and text of the turns after the edits, from a state on."""
    for (role, text), code in zip(rows, codes, strict=True):
        for _ in code[:-1]:
            state = _MADE[state]
            yield ("user" if state == USER else "assistant"), ""
        if code[-1] == "K":
            state = _KEPT[state, role[:1]]
            yield role, text
        elif code[-1] == "R":
            state = _MADE[state]
            yield ("user" if state == USER else "assistant"), text
    for _ in tail:
        state = _MADE[state]
        yield ("user" if state == USER else "assistant"), ""


def flaws(text: str) -> tuple[bool, bool]:
    """Whether a text is blank, and whether its last character that is no white space ends no sentence."""
    kept = text.encode().rstrip(b" \t\n\x0b\x0c\r")
    return not kept, kept[-1:] not in (b".", b"!", b"?")


class Tally:
    """Counts of a run of rows in order, which two neighbouring runs can add up."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> tuple[bool, bool]:
        """Count a row; whether it must go and whether it is truncated."""
        blank, cut = flaws(text)
        seen, cut = seen and not blank, cut and not blank and not seen
        self.blank += blank
        self.duplicate += seen
        self.truncated += cut
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if self.most is None or turn > self.most:
                self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        return blank or seen, cut

    def join(self, after: dict) -> None:
        """Add the counts of the run that follows."""
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, k, getattr(self, k) + after[k])
        if after["first"] is not None:
            if self.first is None:
                self.first = after["first"]
            elif self.last + after["first"] not in _LEGAL:
                self.illegal += 1
            self.last = after["last"]
        if after["least"] is not None:
            if self.most is not None and self.most == after["least"]:
                self.turns -= 1
            self.least, self.most = after["least"] if self.least is None else self.least, after["most"]

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns

    def counts(self) -> dict[str, int]:
        return {"gaps": self.gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def repair_rows(rows: Iterable[tuple[int | None, str, str]]) -> dict:
    """The report of one conversation whose rows (turn, role, text) are in order."""
    tally, layers, seen, kept = Tally(), Layers((START,)), set(), []
    for turn, role, text in rows:
        known = (role, text) in seen
        seen.add((role, text))
        layers.add(*tally.add(turn, role, text, known), role[:1])
        kept.append((role, text))
    cost, end = best_end(layers.cost, layers.rank)
    codes = layers.trace(0, end)
    said = "\n".join(f"{r}:{t}" for r, t in repaired(kept, codes, START, _TAIL[end]))
    return {**tally.counts(), "cost": cost, "audit": "".join(codes) + _TAIL[end], "repaired": said, "repaired_sha256": hashlib.sha256(said.encode()).hexdigest()}


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string, repaired_sha256 string"
_KEYS = [x.split()[0] for x in _REPORT.split(", ")]
_LONG = 1000
_SUMS = ["blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "first", "last"]


def _batch(rows: list[dict], like: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in like.items()], names=list(like))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _many(rows: Iterable[dict], like: dict[str, pa.DataType], most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows, closed by their number or by the size of their texts."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r.values() if isinstance(x, (str, bytes)))
        if len(held) >= _LONG or size >= most_bytes:
            yield _batch(held, like)
            held, size = [], 0
    if held:
        yield _batch(held, like)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}


def _arrow(schema: str) -> dict[str, pa.DataType]:
    return {x.split()[0]: _TYPES[x.split()[1]] for x in schema.split(", ")}


def repair(turns: DataFrame, shared: Shared, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, keep_text: bool = True) -> DataFrame:
    """What is wrong with each conversation, and its cheapest repair: a row for each value of ``id_col`` (long).

    ``gaps``: turns missing between the first and the last. ``blank``, ``duplicate``, ``truncated``:
    rows by their first fault. ``illegal``: neighbours whose role initials are not su, ua or au.
    ``cost``, ``audit``: the cheapest edits, of equals the string that comes first. With
    ``keep_text`` ``repaired`` has the turns as ``role:text`` lines; their hash is given always.

    Rows are ordered by turn (null first), then role, then text. Null roles and texts count as one
    space; null ids are one conversation; other columns play no part. ``present`` is false for rows
    that only name their conversation; one with no others has zeros and the empty text.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    named = turns.select(F.col(id_col).cast("long").alias("c"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role), F.lit(" ")).alias("r"), F.coalesce(F.col(text), F.lit(" ")).alias("x"), there.alias("p"))
    n = max(8, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(turns) // RANGE_BYTES))
    bounds = ["c", "t", "r", F.substring("x", 1, PREFIX)]
    ranged = named.repartitionByRange(n, *bounds).sortWithinPartitions("c", "t", "r", "x")
    open_schema = "part int, seg int, pos long, t long, r string, x string"
    like = {"c": pa.int64(), **_arrow(_REPORT), **_arrow(open_schema)}

    def whole(batches) -> Iterator[pa.RecordBatch]:
        """Reports of the conversations inside the range, and the rows of the first and the last."""
        part = TaskContext.get().partitionId()

        def rest(rows: list[tuple], seg: int) -> Iterator[dict]:
            for pos, (c, t, r, x, p) in enumerate(rows):
                yield {"c": c, "part": part, "seg": seg, "pos": pos, "t": t, "r": r if p else None, "x": x if p else None}

        def every() -> Iterator[dict]:
            groups = groupby(_rows(batches), key=lambda r: r[0])
            for c, rows in groups:  # the first may have begun in the range before
                yield from rest(list(rows), 0)
                break
            held = None
            for c, rows in groups:
                if held is not None:
                    yield {"c": held[0][0], **report(held)}
                held = list(rows)
            if held is not None:
                yield from rest(held, 1)

        def report(rows: list[tuple]) -> dict:
            found = repair_rows((t, r, x) for _, t, r, x, p in rows if p)
            return found if keep_text else found | {"repaired": None}

        yield from _many(every(), like)

    first = shared.table(map_arrow(ranged, whole, f"c long, {_REPORT}, {open_schema}"), "whole")
    done = first.where("part IS NULL").select("c", *_KEYS)
    cut = first.where("part IS NOT NULL").select("c", "part", "seg", "pos", "t", "r", "x")
    out = done.unionByName(_in_segments(cut, shared, n, keep_text))
    return out.select(F.col("c").alias(id_col), *[k for k in _KEYS if keep_text or k != "repaired"])


def _in_segments(rows: DataFrame, shared: Shared, n: int, keep_text: bool) -> DataFrame:
    """Reports of conversations whose rows are in segments: (part, seg), in order, by pos."""
    at = F.struct("part", "seg", "pos")
    said = F.md5(F.concat(F.length("r").cast("string"), F.lit(":"), F.col("r"), F.col("x")))
    keyed = rows.withColumn("said", said)
    firsts = keyed.where("r IS NOT NULL").groupBy("c", "said").agg(F.min(at).alias("first"))
    firsts = firsts.select(F.col("c").alias("c1"), F.col("said").alias("said1"), "first")
    known = keyed.join(firsts, F.col("c").eqNullSafe(F.col("c1")) & (F.col("said") == F.col("said1")), "left")
    flagged = shared.table(known.select("part", "seg", "pos", "c", "t", "r", "x", F.coalesce(F.col("first") < at, F.lit(False)).alias("seen")), "cut")
    by_range = lambda df: df.repartition(n, "part").sortWithinPartitions("part", "seg", "pos")
    sums_schema = "c long, part int, seg int, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, first string, last string, costs string, ranks string"
    sums_like = _arrow(sums_schema)

    def summed(batches) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[dict]:
            for (part, seg), group in groupby(_rows(batches), key=lambda r: r[:2]):
                tally, layers, c = Tally(), Layers((0, 1, 2, 3)), None
                for _, _, _, c, t, r, x, seen in group:  # noqa: B007
                    if r is not None:
                        layers.add(*tally.add(t, r, x, seen), r[:1])
                yield {"c": c, "part": part, "seg": seg, **{k: getattr(tally, k) for k in _SUMS}, "costs": ",".join(map(str, layers.cost)), "ranks": ",".join(map(str, layers.rank))}

        yield from _many(every(), sums_like)

    sums = map_arrow(by_range(flagged), summed, sums_schema)
    plan_schema = "c long, part int, seg int, start int, end int, cost long, gaps long, blank long, duplicate long, truncated long, illegal long, tail string"
    plan_like = _arrow(plan_schema)

    def planned(batches) -> Iterator[pa.RecordBatch]:
        """The states in which the segments of the cheapest repair begin and end; counts are with the last one."""

        def every() -> Iterator[dict]:
            names = [x.split()[0] for x in sums_schema.split(", ")]
            for c, group in groupby(_rows(batches), key=lambda r: r[0]):
                tally, cost, rank, back, places = Tally(), [0, _FAR, _FAR, _FAR], [0] * 4, [], []
                for row in group:
                    row = dict(zip(names, row, strict=True))
                    tally.join(row)
                    own, of = [int(x) for x in row["costs"].split(",")], [int(x) for x in row["ranks"].split(",")]
                    best = [min(((cost[a] + own[4 * a + b], rank[a], of[4 * a + b], a) for a in range(4) if cost[a] < _FAR and own[4 * a + b] < _FAR), default=(_FAR, 0, 0, 0)) for b in range(4)]
                    order = {k: r for r, k in enumerate(sorted({x[1:3] for x in best if x[0] < _FAR}))}
                    cost, rank = [x[0] for x in best], [order.get(x[1:3], 0) for x in best]
                    back.append(bytes(x[3] for x in best))
                    places.append((row["part"], row["seg"]))
                total, state = best_end(cost, rank)
                tail, last = _TAIL[state], True
                for (part, seg), parent in zip(reversed(places), reversed(back), strict=True):
                    before = parent[state]
                    yield {"c": c, "part": part, "seg": seg, "start": before, "end": state, "tail": tail if last else "", **({"cost": total, **tally.counts()} if last else {})}
                    state, last = before, False

        yield from _many(every(), plan_like)

    plan = shared.table(map_arrow(sums.repartition(n, "c").sortWithinPartitions("c", "part", "seg"), planned, plan_schema), "plan")
    ways = flagged.join(plan.select("part", "seg", "start", "end", "tail"), ["part", "seg"])
    piece_schema = "c long, part int, seg int, piece long, audit string, said string"
    piece_like = _arrow(piece_schema)

    def put(batches) -> Iterator[pa.RecordBatch]:
        """Edits and lines of each segment, some at a time."""

        def every() -> Iterator[dict]:
            for (part, seg), group in groupby(_rows(batches), key=lambda r: r[:2]):
                tally, held, start, end, tail, c = None, [], 0, 0, "", None
                for _, _, _, c, t, r, x, seen, start, end, tail in group:  # noqa: B007
                    if tally is None:
                        tally, layers = Tally(), Layers((start,))
                    if r is not None:
                        layers.add(*tally.add(t, r, x, seen), r[:1])
                        held.append((r, x))
                codes = layers.trace(0, end)
                lines = [f"{r}:{x}\n" for r, x in repaired(held, codes, start, tail)]
                yield {"c": c, "part": part, "seg": seg, "piece": -1, "audit": "".join(codes) + tail, "said": ""}
                for k in range(0, len(lines), 100):
                    yield {"c": c, "part": part, "seg": seg, "piece": k, "audit": "", "said": "".join(lines[k : k + 100])}

        yield from _many(every(), piece_like)

    columns = ["part", "seg", "pos", "c", "t", "r", "x", "seen", "start", "end", "tail"]
    pieces = map_arrow(by_range(ways.select(columns)), put, piece_schema)
    done_like = {"c": pa.int64(), "audit": pa.string(), "repaired": pa.string(), "repaired_sha256": pa.string()}

    def joined(batches) -> Iterator[pa.RecordBatch]:
        """The pieces of each conversation in order; its text goes through the hash and, unless asked for, away."""

        def every() -> Iterator[dict]:
            for c, group in groupby(_rows(batches), key=lambda r: r[0]):
                total, audit, kept, last = hashlib.sha256(), [], [], ""
                for _, _, _, _, edits, said in group:
                    audit.append(edits)
                    if said:  # the line feed after the last line does not count
                        total.update((last + said[:-1]).encode())
                        if keep_text:
                            kept.append(last + said[:-1])
                        last = "\n"
                yield {"c": c, "audit": "".join(audit), "repaired": "".join(kept) if keep_text else None, "repaired_sha256": total.hexdigest()}

        yield from _many(every(), done_like)

    texts = map_arrow(pieces.repartition(n, "c").sortWithinPartitions("c", "part", "seg", "piece"), joined, "c long, audit string, repaired string, repaired_sha256 string")
    counts = plan.where("cost IS NOT NULL").select(F.col("c").alias("c1"), "cost", "gaps", "blank", "duplicate", "truncated", "illegal")
    return texts.join(counts, F.col("c").eqNullSafe(F.col("c1"))).select("c", *_KEYS)


def damage(turns: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults put into conversations by the CRC-32 of ``id:turn`` modulo 20: the same columns and ``present``.

    0 leaves the row as a name of its conversation only, 1 empties its text, 2 takes its sentence
    ends away, 3 repeats it, 4 makes it a user's. Nulls count as one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(id_col), F.lit(":"), shown(turn)).cast("binary")) % 20
    held = turns.select(F.col(id_col), F.col(turn), kind.alias("__k"), shown(role).alias("__r"), shown(text).alias("__x"))
    bare = F.translate("__x", ".!?", "")
    made = held.select(
        id_col,
        turn,
        F.when(F.col("__k") == 4, "user").otherwise(F.col("__r")).alias(role),
        F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, bare).otherwise(F.col("__x")).alias(text),
        (F.col("__k") != 0).alias("present"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("__k") == 3, 2).otherwise(1))).alias("__n"),
    )
    return made.drop("__n")
