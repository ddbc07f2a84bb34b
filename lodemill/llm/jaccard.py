"""N-gram Jaccard join: links between documents whose shingle sets overlap enough, exactly.

Shingles are ordered globally, rare ones first. Two sets that are similar enough share one of the
first shingles of each (its prefix), and one that occurs only once is shared with nothing. So the
shingles' counts come first, as sorted hash arrays by shard; each set then gives its prefix's
shared shingles. Equal sets are one class from the start.

Sets that reach each other by prefix shingles are a cluster; each set goes to its cluster once.
The cluster's ordered sets are stored in a trie: sets that begin alike are one path. Many probes
walk it together; the overlap that they have with a path is counted once for all sets below it,
and a branch is left when what remains of it cannot reach the overlap that its smallest set needs,
or when all that it holds is linked with the probes already. First a few sets probe the trie, then
those that are not in the largest component, until all others are in one: so a group of copies
costs little more than its size, no pairs are written, and no link is lost.

A cluster whose sets take more than a bounded number of bytes is joined shingle by shingle: what
follows a shingle in its holders is stored in tries of bounded blocks. Each block is joined first;
the components tell which holders are still outside a shingle's largest component, and these probe
the tries of the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm import runs
from lodemill.llm.common import SPACED, U64, Shared, bound_batches, by_key, find, gather, gathered, hash_words, map_arrow, mix, roll, shard_of, shards_for, signed, sum_by_key, unpack, utf8
from lodemill.llm.graph import components
from lodemill.llm.lookup import look_up, save_sorted

#: Words of a shingle, and the similarity from which sets link, in hundredths.
SHINGLE, SIMILAR = 5, 75
#: Bits of a shingle's hash by which it is counted: two that agree in them are ordered as one.
COUNT_BITS = 48
#: Hashes gathered before a sorted run is given out.
RUN = 1 << 20
#: Bytes of the sets in one trie, those that a set takes besides its shingles, and those of a walk.
BLOCK_BYTES, MEMBER_BYTES, WALK_BYTES = 8 << 20, 400, 32 << 20


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the bounds of each text's."""
    h, bounds = hash_words(texts, SPACED)
    n = np.diff(bounds)
    g = roll(h, size)
    doc = np.repeat(np.arange(len(texts)), n)[: len(g)]
    inside = np.arange(len(g)) + size <= bounds[1:][doc] if len(g) else np.zeros(0, bool)
    g, doc = g[inside], doc[inside]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        whole = np.array([roll(h[bounds[d] : bounds[d + 1]], int(n[d]))[0] for d in few], U64)
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, few])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(texts) + 1))


# Counts of all shingles


def count_shingles(docs: DataFrame, text_col: str, shared: Shared, shards: int, size: int) -> None:
    """Write the shingles that more than one document holds, and in how many, by shard."""
    cut, parts = U64(64 - COUNT_BITS), runs.widths(shards)[0]

    def counted(batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, n = sum_by_key(np.concatenate(held), np.ones(sum(map(len, held)), np.uint32))
            held.clear()
            return runs.cut(keys, n, parts, keys << cut)

        for batch in batches:
            g, _ = shingle_sets(utf8(batch.column(0)), size)
            held.append(g >> cut)
            if sum(map(len, held)) >= RUN:
                yield out()
        if held and sum(map(len, held)):
            yield out()

    def merge(batches) -> Iterator[pa.RecordBatch]:
        for (shard,), group in by_key(batches, 1):
            keys, n = merged(blob for _, blob in group)
            shared.save(f"shingles-{shard}", keys[n > 1])
            shared.save(f"counts-{shard}", n[n > 1].astype(np.uint32))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32())})

    dealt = runs.dealt(map_arrow(docs.select(text_col), counted, runs.RUN), shards, 64 - COUNT_BITS)
    done = {r["shard"] for r in gather(map_arrow(dealt, merge, "shard int"))}  # one row for each shard
    for s in set(range(shards)) - done:
        shared.save(f"shingles-{s}", np.zeros(0, U64))
        shared.save(f"counts-{s}", np.zeros(0, np.uint32))


def merged(blobs: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of sorted runs; runs are folded as they come."""
    keys, n = np.zeros(0, U64), np.zeros(0, np.int64)
    held: list[list[np.ndarray]] = []
    size = 0

    def fold_in() -> None:
        nonlocal keys, n, size
        keys, n = sum_by_key(np.concatenate([keys, *(h[0] for h in held)]), np.concatenate([n, *(h[1].astype(np.int64) for h in held)]))
        held.clear()
        size = 0

    for blob in blobs:
        held.append(unpack(blob))
        size += len(held[-1][0])
        if size > max(1 << 19, len(keys)):
            fold_in()
    fold_in()
    return keys, n


def lookup(g: np.ndarray, shared: Shared, shards: int) -> np.ndarray:
    """In how many documents each shingle is; 1 for those that are not stored."""
    cut = U64(64 - COUNT_BITS)
    keys, back = np.unique(g >> cut, return_inverse=True)
    n = np.ones(len(keys), np.uint32)
    edges = np.searchsorted(shard_of(keys << cut, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        part = slice(edges[s], edges[s + 1])
        at, hit = find(shared.load(f"shingles-{s}"), keys[part])
        if hit.any():
            n[part][hit] = shared.load(f"counts-{s}")[at[hit]]
    return n[back]


# Sets, prefixes and classes


def fingerprints(g: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit fingerprints of each set, in whatever order its hashes are; null for an empty set."""
    n = np.diff(bounds)
    full = n > 0
    total = np.zeros((2, len(n)), U64)
    if full.any():
        at = bounds[:-1][full]
        total[0, full] = np.add.reduceat(mix(g ^ U64(0x5BD1E995)), at)
        total[1, full] = np.add.reduceat(mix(g + U64(0x27D4EB2F165667C5)), at)
    return pa.array(signed(mix(total[0] + n.astype(U64))), mask=~full), pa.array(signed(mix(total[1])), mask=~full)


def least_overlap(x, y, similar: int = SIMILAR):
    """Smallest overlap of sets of x and y shingles that makes 100 * overlap >= similar * union."""
    return -(-similar * (x + y) // (100 + similar))


def ordered_sets(docs: DataFrame, id_col: str, text_col: str, shared: Shared, shards: int, size: int, similar: int) -> DataFrame:
    """Each document's set: size, class (a fingerprint of the set), shared shingles of its prefix, and all shared ones in order."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 2 << 20):
            texts = utf8(batch.column(1))
            g, bounds = shingle_sets(texts, size)
            n = np.diff(bounds)
            doc = np.repeat(np.arange(len(texts)), n)
            count = lookup(g, shared, shards)
            order = np.lexsort((g, count, doc))
            g, count = g[order], count[order]
            rank = np.arange(len(g)) - bounds[:-1][doc]
            prefix = (rank < (n - -(-similar * n // 100) + 1)[doc]) & (count > 1)
            own, check = fingerprints(g, bounds)
            shared_only = count > 1
            held = np.concatenate(([0], np.cumsum(shared_only)))[bounds]
            begun = np.concatenate(([0], np.cumsum(prefix)))[bounds]
            kept, tokens = g[shared_only], signed(g[prefix])
            sets = [kept[held[d] : held[d + 1]].tobytes() if begun[d] < begun[d + 1] else None for d in range(len(texts))]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0),
                    "n": pa.array(n, pa.int64()),
                    "fp": own,
                    "check": check,
                    "tokens": pa.ListArray.from_arrays(pa.array(begun, pa.int32()), pa.array(tokens)),
                    "shared": pa.array(sets, pa.binary()),
                }
            )

    bound_batches(docs.sparkSession)
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), text_col), run, "id long, n long, fp long, check long, tokens array<long>, shared binary")


# The trie


class Trie:
    """Ordered sets as a trie in flat arrays: nodes in preorder, chains without a branch are one node.

    A set is the bytes of its shingles; sizes are those of the whole sets, which may hold more.
    """

    def __init__(self, sets: list[bytes], sizes: np.ndarray):
        self.order = np.array(sorted(range(len(sets)), key=sets.__getitem__), np.int64)
        arrays = [np.frombuffer(sets[k], U64) for k in self.order]
        length = [len(a) for a in arrays]
        same = [0] * len(arrays)
        for i in range(1, len(arrays)):
            k = min(length[i - 1], length[i])
            differ = arrays[i - 1][:k] != arrays[i][:k]
            j = int(differ.argmax()) if k else 0
            same[i] = j if k and differ[j] else k
        cuts = _cuts(same, length)
        self.parent, self.skip, self.level, parts, ends = [], [], [], [], []
        node_of, path = np.zeros(len(arrays), np.int64), []
        for i, whole in enumerate(arrays):
            while path and ends[path[-1]] > same[i]:
                self.skip[path.pop()] = len(ends)
            at = same[i]
            for upto in (*cuts[i], length[i]):
                if upto > at or not path:
                    self.parent.append(path[-1] if path else -1)
                    self.level.append(len(path))
                    path.append(len(ends))
                    self.skip.append(0)
                    ends.append(upto)
                    parts.append(whole[at:upto])
                    at = upto
            node_of[i] = path[-1]
        for k in path:
            self.skip[k] = len(ends)
        self.tokens = np.concatenate(parts)
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        self.lo = np.searchsorted(node_of, np.arange(len(ends)))  # the members at or below each node, in order
        self.hi = np.searchsorted(node_of, np.array(self.skip))
        self.here = np.searchsorted(node_of, np.arange(1, len(ends) + 1))  # those that end there come first
        both = np.stack([self.lo, self.hi], 1).ravel()
        self.longest = np.maximum.reduceat(np.append(length, 0), both)[::2] - np.array(ends)
        self.smallest = np.minimum.reduceat(np.append(sizes[self.order], 0), both)[::2]
        self.sizes = sizes


def _cuts(same: list[int], length: list[int]) -> list[list[int]]:
    """The depths at which later sets branch off each set's own chain."""
    out: list[list[int]] = [[] for _ in same]
    least: list[int] = []  # what the later sets have in common with this one, the nearest last
    for i in range(len(same) - 1, -1, -1):
        if i + 1 < len(same):
            while least and least[-1] >= same[i + 1]:
                least.pop()
            least.append(same[i + 1])
        k = len(least) - 1
        while k >= 0 and least[k] > same[i]:
            if least[k] < length[i]:
                out[i].append(least[k])
            k -= 1
        out[i].reverse()
    return out


def walk(trie: Trie, probes: list[bytes], sizes: np.ndarray, found, comp: np.ndarray | None = None, own: np.ndarray | None = None, similar: int = SIMILAR) -> None:
    """Walk the trie with all probes at once; ``found(member, hits)`` gets the probes that link with a member.

    comp and own name the components of the members and the probes: within one, nothing is found.
    """
    words = [np.frombuffer(p, U64) for p in probes]
    long = np.array([len(w) for w in words])
    every, row = np.unique(np.concatenate(words), return_inverse=True)
    holds = np.zeros((len(every), len(probes)), np.uint8)
    holds[row, np.repeat(np.arange(len(probes)), long)] = 1
    at, hit = find(every, trie.tokens)
    rows = at[hit]
    first = np.concatenate(([0], np.cumsum(hit)))[trie.first].tolist()
    # A node whose members are all of one component is left out for probes of the same.
    one = None
    if comp is not None:
        sorted_ = comp[trie.order]
        change = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        one = np.where(change[trie.lo] == change[trie.hi - 1], sorted_[trie.lo], -1).tolist()
    path = np.zeros((max(trie.level) + 2, len(probes)), np.int64)  # overlaps from the root to each level
    whole, need = 100 + similar, similar * sizes
    longest, smallest, lo, here = trie.longest.tolist(), trie.smallest.tolist(), trie.lo.tolist(), trie.here.tolist()
    node, n = 0, len(first) - 1
    while node < n:
        level = trie.level[node]
        overlap = path[level + 1]
        if first[node] < first[node + 1]:
            np.add(path[level], holds[rows[first[node] : first[node + 1]]].sum(0, dtype=np.int64), out=overlap)
        else:
            overlap[:] = path[level]
        alive = (overlap + np.minimum(longest[node], long - overlap)) * whole >= need + similar * smallest[node]
        if one is not None and one[node] >= 0:
            alive &= own != one[node]
        if not alive.any():
            node = trie.skip[node]
            continue
        for k in range(lo[node], here[node]):
            member = int(trie.order[k])
            hits = np.flatnonzero(overlap * whole >= need + similar * trie.sizes[member])
            if len(hits):
                found(member, hits)
        node += 1


class Groups:
    """Components of numbered things, joined one link after another."""

    def __init__(self, comp: np.ndarray):
        self.comp, self.links = comp, []

    def join(self, a: int, others: np.ndarray) -> None:
        """Link a with others, as far as they are apart."""
        apart = others[self.comp[others] != self.comp[a]]
        while len(apart):
            b = int(apart[0])
            self.links.append((a, b))
            self.comp[self.comp == self.comp[b]] = self.comp[a]
            apart = apart[self.comp[apart] != self.comp[a]]


def _many(probes: list[int], sets: list[bytes]) -> int:
    """As many of the probes as fit into WALK_BYTES."""
    words = 0
    for k, p in enumerate(probes):
        words += len(sets[p]) // 8
        if k and words * (k + 1) > WALK_BYTES:
            return k
    return len(probes)


def self_join(sets: list[bytes], sizes: np.ndarray, similar: int = SIMILAR) -> list[tuple[int, int]]:
    """Links among sets that hold all components of the links that overlaps of the given parts of them show."""
    groups = Groups(np.arange(len(sets)))
    trie, open_ = Trie(sets, sizes), np.ones(len(sets), bool)
    todo = list(range(len(sets) - 1)) if len(sets) <= 64 else _commonest(trie, 4)
    while len(todo):
        batch = np.array(todo[: _many(todo, sets)])
        walk(trie, [sets[k] for k in batch], sizes[batch], lambda m, hits, b=batch: groups.join(m, b[hits]), groups.comp.copy(), groups.comp[batch], similar)
        open_[batch] = False
        left = np.flatnonzero(open_)
        if not len(left):
            break
        comps, n = np.unique(groups.comp[left], return_counts=True)
        todo = left[groups.comp[left] != comps[n.argmax()]].tolist()
    return groups.links


def _commonest(trie: Trie, most: int) -> list[int]:
    """The members whose shingles most others hold."""
    held = (trie.hi - trie.lo).astype(np.float64)
    sums = np.zeros(len(held))
    for k, p in enumerate(trie.parent):
        sums[k] = (sums[p] if p >= 0 else 0) + held[k] * (trie.first[k + 1] - trie.first[k])
    value = np.zeros(len(trie.order))
    for k in range(len(held)):
        value[trie.order[trie.lo[k] : trie.here[k]]] = sums[k]
    return np.argsort(-value)[:most].tolist()


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def link_blocks(blocks: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) within each block of (token, block, fp, n, part)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, group in by_key(batches, 2):
            members = list(group)
            if len(members) > 1:
                names = [r[2] for r in members]
                out += [(names[a], names[b]) for a, b in self_join([r[4] for r in members], np.array([r[3] for r in members]), similar)]
            if len(out) > 1000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return map_arrow(blocks, run, "a long, b long")


def link_across(blocks: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) of probes with the members of each (token, block, chunk) of (..., probe, fp, n, comp, part)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches, 3):
            rows = list(group)  # members come first; both are bounded
            members, probes = [r for r in rows if not r[3]], [r for r in rows if r[3]]
            if not members or not probes:
                continue
            _, comp = np.unique([r[6] for r in rows], return_inverse=True)
            groups, trie = Groups(comp), Trie([r[7] for r in members], np.array([r[5] for r in members]))
            parts = [r[7] for r in rows]
            todo = list(range(len(members), len(rows)))
            while todo:
                batch = np.array(todo[: _many(todo, parts)])
                todo = todo[len(batch) :]
                walk(trie, [parts[k] for k in batch], np.array([rows[k][5] for k in batch]), lambda m, hits, g=groups, b=batch: g.join(m, b[hits]), groups.comp[: len(members)].copy(), groups.comp[batch], similar)
            yield _pairs([(rows[a][4], rows[b][4]) for a, b in groups.links])

    return map_arrow(blocks, run, "a long, b long")


# Who meets whom


def prefix_entries(classes: DataFrame, block_bytes: int) -> DataFrame:
    """(token, fp, k, block, blocks, lo) of the shingles that several classes have in their prefixes; k is the place among the shared ones, lo the least holder.

    Of shingles that the very same classes hold, only the first in the order is kept: a pair meets
    at its first common shingle. Blocks are dealt by a hash of class and shingle.
    """
    first = F.col("n") - F.octet_length("shared") / 8
    entries = classes.select("fp", first.cast("long").alias("first"), F.octet_length("shared").alias("bytes"), F.posexplode("tokens").alias("k", "token"))
    held = entries.groupBy("token").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min_by(F.col("first") + F.col("k"), "fp").alias("at_lo"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"), F.sum(F.col("bytes") + MEMBER_BYTES).alias("bytes")).where("lo <> hi")
    kept = held.groupBy("c", "x", "y", "lo", "hi").agg(F.min_by(F.struct("token", F.ceil(F.col("bytes") / block_bytes).alias("blocks"), "lo"), "at_lo").alias("kept")).select("kept.*")
    return entries.join(kept, "token").select("token", "fp", "k", F.pmod(F.xxhash64("fp", "token"), "blocks").cast("int").alias("block"), "blocks", "lo")


def clusters(entries: DataFrame, classes: DataFrame, shared: Shared, block_bytes: int) -> DataFrame:
    """(fp, cluster, small): which sets reach each other by prefix shingles, and whether a cluster's fit into one block."""
    reached = components(entries.select("fp", "lo").where("fp <> lo"), shared, "clusters", "fp", "lo").select(F.col("node").alias("fp"), F.col("comp").alias("cluster"))
    sizes = reached.join(classes.select("fp", (F.octet_length("shared") + MEMBER_BYTES).alias("bytes")), "fp").groupBy("cluster").agg((F.sum("bytes") <= block_bytes).alias("small"))
    return reached.join(sizes, "cluster")


def with_parts(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """Entries with the class's size and ``part``, its shared shingles from the entry's own on."""
    return entries.join(classes.select("fp", "n", "shared"), "fp").withColumn("part", F.expr("substring(shared, 8 * k + 1)")).drop("shared")


def outside(entries: DataFrame, labels: DataFrame, block_bytes: int, classes: DataFrame) -> DataFrame:
    """Of shingles with several blocks and components: the members of each block, and as probes the other blocks' holders that are not in the largest component."""
    known = labels.select(F.col("node").alias("fp"), "comp")
    many = entries.where("blocks > 1").join(known, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    counts = many.groupBy("token", "comp").agg(F.count("*").alias("c"))
    tokens = counts.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("token", "main")
    open_ = with_parts(many.join(tokens, "token"), classes)
    weight = F.when(F.col("comp") != F.col("main"), F.octet_length("part") + MEMBER_BYTES)
    chunks = open_.groupBy("token").agg(F.ceil(F.sum(weight) / block_bytes).cast("int").alias("chunks"))
    dealt = open_.join(chunks, "token")
    columns = ["token", "block", "chunk", "probe", "fp", "n", "comp", "part"]
    members = dealt.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("probe", F.lit(False))
    probes = dealt.where("comp <> main").withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int")).withColumn("to", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)"))).where("to <> block").withColumn("block", F.col("to")).withColumn("probe", F.lit(True))
    return members.select(columns).unionByName(probes.select(columns))


# The join


def jaccard_components(docs: DataFrame, shared: Shared, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similar: int = SIMILAR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``fp``, the class of equal sets, and ``label``.

    ``label`` is one for each component, also where ids are null or repeat; null without words. Ids are integers. A text with fewer words than a shingle is one shingle; without words, or
    null, it has none and is linked with nothing. Repeated rows are linked with each other; a null
    id is reached by no other id's component and takes the smallest id of its own.
    """
    shards = shards_for(docs)
    count_shingles(docs, text_col, shared, shards, size)
    sets = shared.table(ordered_sets(docs, id_col, text_col, shared, shards, size, similar), "sets")
    if sets.where("fp is not null").groupBy("fp").agg((F.min("check") != F.max("check")).alias("clash")).where("clash").limit(1).count():
        raise ValueError("two different sets have one 64-bit fingerprint")
    first = sets.where("shared is not null").groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "shared")))
    classes = shared.table(first, "classes")
    entries = shared.table(prefix_entries(classes, block_bytes), "entries")
    reached = shared.table(clusters(entries, classes, shared, block_bytes), "reached")
    blocks = reached.where("small").join(classes, "fp").select(F.col("cluster").alias("token"), F.lit(-1).alias("block"), "fp", "n", F.col("shared").alias("part"))
    large = None
    if reached.where("not small").limit(1).count():
        large = entries.join(reached.where("not small").select("fp"), "fp", "left_semi")
        blocks = blocks.unionByName(with_parts(large, classes).select("token", "block", "fp", "n", "part"))
    links = shared.table(link_blocks(blocks.repartition("token", "block").sortWithinPartitions("token", "block"), similar), "links")
    labels = components(links, shared, "labels")
    if large is not None and large.where("blocks > 1").limit(1).count():
        probes = outside(large, labels, block_bytes, classes).repartition("token", "block", "chunk").sortWithinPartitions("token", "block", "chunk", "probe")
        links = links.unionByName(shared.table(link_across(probes, similar), "links-across"))
        labels = components(links, shared, "labels-across")
    named = labels.select(F.col("node").alias("fp"), "comp")
    lowest = sets.where("fp is not null").groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("rows"))
    of_class = lowest.join(named, "fp", "left")
    of_comp = of_class.where("comp is not null").groupBy("comp").agg(F.min("low").alias("least"))
    known = of_class.where("comp is not null or rows > 1").join(of_comp, "comp", "left").select("fp", F.coalesce("least", "low").alias("least"), "comp")
    for done in ("classes", "entries", "reached"):
        shared.drop(done)
    return sets.select("id", "n", "fp").join(known, "fp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "fp", F.coalesce("comp", "fp").alias("label"))


def keep_first(docs: DataFrame, shared: Shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they were: that with the smallest id.

    Of rows with one id in a component one stays; a component of null ids keeps one row too. A document without words is a component alone.
    """
    found = shared.table(jaccard_components(docs, shared, id_col, text_col), "components")
    many = found.where("fp is not null").groupBy(id_col, "component_id").count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count()
    if many:
        return _one_each(docs, found, id_col, text_col)
    shards = shards_for(docs)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.xxhash64(id_col).alias("key"), F.col(id_col).alias("id"))
    save_sorted(gone, ["key", "id"], shared, "gone", shards)
    at = docs.columns.index(id_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at).cast(pa.int64())
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            # The hash that xxhash64 gives a long.
            keys = np.array([xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed=42) for i in known], U64)
            hit, (stored,) = look_up(keys, shared, "gone", ["key", "id"], shards)
            drop = hit & (stored == known) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~drop))

    return map_arrow(docs, run, docs.schema)


def _one_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same where ids are null or repeat: components are told apart by their labels."""
    from pyspark.sql import Window

    own = Window.partitionBy("__label").orderBy("__fp", F.xxhash64(text_col), text_col)
    sets = docs.withColumn("__fp", fingerprint_udf()(F.col(text_col)))
    # Rows that hold their component's smallest id, or a null one where it has no other.
    comps = found.where(F.col("fp").isNotNull() & F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id"), F.col("fp").alias("__of"), F.col("label").alias("__label")).distinct()
    placed = sets.where(F.col("__fp").isNotNull()).join(comps, sets[id_col].eqNullSafe(comps["__id"]) & (sets["__fp"] == comps["__of"]))
    first = placed.withColumn("__turn", F.row_number().over(own)).where("__turn = 1")
    whole = sets.where(F.col("__fp").isNull())
    return first.select(docs.columns).unionByName(whole.select(docs.columns))


def fingerprint_udf(size: int = SHINGLE):
    """The class of a text's set, as in ``jaccard_components``."""

    @F.pandas_udf("long")
    def of(texts):
        g, bounds = shingle_sets([(t or "").encode() for t in texts], size)
        return fingerprints(g, bounds)[0].to_pandas().astype("Int64")

    return of
