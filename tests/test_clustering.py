"""Neighbour graphs, density clusters and layouts against plain versions."""

import numpy as np
import pytest

from lodemill.operators import clustering, layout, neighbours


def blobs(n, dims, centres, seed, noise=0.15, spread=0.35):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 4, (centres, dims))
    x = at[rng.integers(0, centres, n)] + rng.normal(0, 1, (n, dims)) * rng.uniform(spread / 3, spread * 3, (n, 1))
    far = rng.random(n) < noise
    x[far] = rng.uniform(-9, 9, (int(far.sum()), dims))
    return x


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(parts)


def distances(x, metric):
    x = neighbours.prepared(x, metric)
    return np.stack([neighbours.measured(x[i][None, :], x, metric) for i in range(len(x))])


def graph_of(d, k):
    out = {}
    for i in range(len(d)):
        order = sorted((float(d[i, j]), j) for j in range(len(d)) if j != i)[:k]
        out[i] = order
    return out


def spanning(edges, n):
    """Kruskal over edges (w, lo, hi)."""
    top, out = list(range(n)), []

    def find(v):
        while top[v] != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    for w, a, b in sorted(edges):
        if find(a) != find(b):
            top[find(a)] = find(b)
            out.append((w, a, b))
    return out


def leaves(tree, n, least):
    """Leaf clusters from the top down: a dendrogram is cut edge by edge, the heaviest first."""
    links = {}
    for e in tree:
        links.setdefault(e[1], []).append(e)
        links.setdefault(e[2], []).append(e)

    def side(start, gone):
        seen, todo = {start}, [start]
        while todo:
            v = todo.pop()
            for e in links.get(v, []):
                if e not in gone:
                    other = e[2] if e[1] == v else e[1]
                    if other not in seen:
                        seen.add(other)
                        todo.append(other)
        return seen

    found, gone = [], set()

    def go(rows, edges, born):
        """born: the rows the cluster had when it was made by a split, none for the root."""
        while edges:
            e = edges.pop()
            gone.add(e)
            a = side(e[1], gone)
            b = rows - a
            if len(a) >= least and len(b) >= least:
                for part in (a, b):
                    go(part, [x for x in edges if x[1] in part], part)
                return
            rows = a if len(a) >= least else b
            if len(rows) < least:
                break
            edges = [x for x in edges if x[1] in rows]
        if born is not None:
            found.append(born)

    go(set(range(n)), sorted(tree), None)
    out = np.full(n, -1)
    for k, rows in enumerate(sorted(found, key=lambda r: (-len(r), min(r)))):
        out[sorted(rows)] = k
    return out


def same_clusters(got, want):
    assert len(got) == len(want)
    pairs = set(zip(got, want))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all((a == -1) == (b == -1) for a, b in pairs)


@pytest.mark.parametrize(("metric", "rounds"), [("cosine", 1), ("euclidean", 2)])
def test_recall_at_30(spark, metric, rounds):
    """Many leaves: at least nine of ten true neighbours are found, over all rows."""
    x = blobs(4000, 24, 12, 1)
    x[100:160] = x[100]  # equal vectors
    x[7] = 0
    got = neighbours.nearest_graph(table(spark, x), 30, metric, leaf_rows=256, rounds=rounds).collect()
    d = distances(x, metric)
    np.fill_diagonal(d, np.inf)
    last = np.sort(d, axis=1)[:, 29]
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["distance"], r["neighbour"], r["place"]))
        assert abs(d[r["id"], r["neighbour"]] - r["distance"]) < 1e-12
    hits = sum(sum(dist <= last[i] + 1e-12 for dist, _, _ in v) for i, v in by.items())
    assert len(by) == len(x) and all([p for _, _, p in sorted(v)] == list(range(1, 31)) for v in by.values())
    assert hits / (30 * len(x)) >= 0.9


def test_one_leaf_is_exact(spark):
    x = blobs(300, 5, 3, 2)
    want = graph_of(distances(x, "euclidean"), 10)
    got = neighbours.nearest_graph(table(spark, x), 10, "euclidean").collect()
    assert {(r["id"], r["place"]): r["neighbour"] for r in got} == {(i, k + 1): j for i, v in want.items() for k, (_, j) in enumerate(v)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.nearest_graph(empty, 5).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest_graph(one, 5).count() == 0


@pytest.mark.parametrize(("n", "least", "k", "seed"), [(2000, 60, 30, 3), (600, 10, 12, 4)])
def test_tree_and_clusters(spark, n, least, k, seed):
    x = blobs(n, 4, 7, seed)
    d = distances(x, "euclidean")
    graph = graph_of(d, k)
    core = [v[clustering.SAMPLES - 1][0] for v in graph.values()]
    edges = {(max(dist, core[i], core[j]), min(i, j), max(i, j)) for i, v in graph.items() for dist, j in v}
    near = spark.createDataFrame([(i, j, dist, p + 1) for i, v in graph.items() for p, (dist, j) in enumerate(v)], "id long, neighbour long, distance double, place int")
    cores = clustering.core_distances(near)
    ids = spark.range(n)

    def bridge(members):
        """All pairs of components: what the small graph leaves apart is joined by true distances."""
        c = {r["id"]: r["c"] for r in members.collect()}
        best = {}
        for i in range(n):
            for j in range(i):
                if c[i] != c[j]:
                    key = tuple(sorted((c[i], c[j])))
                    best[key] = min(best.get(key, (9e9, 0, 0)), (max(float(d[i, j]), core[i], core[j]), j, i))
        edges.update(best.values())
        return spark.createDataFrame([(a, b, (w, a, b)) for w, a, b in best.values()] + [(b, a, (w, a, b)) for w, a, b in best.values()], "a long, b long, k struct<w double, lo long, hi long>")

    made = clustering.density_tree(clustering.reachability(near, cores), ids, least, bridge)
    got = sorted((r["w"], r["lo"], r["hi"]) for r in made.tree.collect())
    want = spanning(edges, n)
    assert got == want
    label = {r["id"]: r["leaf"] for r in made.leaves.collect()}
    assert len(label) == n
    brute = leaves(want, n, least)
    assert (brute == -1).any() and brute.max() > 1
    same_clusters([label[i] for i in range(n)], brute.tolist())


def test_clusters_of_blobs(spark):
    """From vectors to topics: separate blobs are found again, lone rows are outliers, parts that the graph leaves apart are joined."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.3, (150, 5)) for c in (0, 6, 12)] + [rng.uniform(-40, 60, (20, 5))])
    got = {r["vec_id"]: r["topic"] for r in clustering.density_clusters(table(spark, x), least=50, k=15).collect()}
    for b in range(3):
        assert len({got[i] for i in range(b * 150, b * 150 + 150) if got[i] >= 0}) == 1
    assert sorted(set(got.values())) == [-1, 0, 1, 2] and sum(got[i] == -1 for i in range(450, 470)) >= 5
    assert [r["vec_id"] for r in clustering.density_clusters(table(spark, x[:1])).collect()] == [0]


def test_no_split_is_no_cluster(spark):
    x = np.random.default_rng(1).normal(0, 1, (120, 3))
    assert {r["topic"] for r in clustering.density_clusters(table(spark, x), least=50).collect()} == {-1}


def test_layout_keeps_neighbours_better_than_components(spark):
    x = blobs(300, 24, 6, 9, noise=0.3)
    rows = table(spark, x)
    graph = neighbours.nearest_graph(rows, 15).cache()
    trusted = {}
    for name, df in (("components", layout.principal(rows, 3, "vec_id", "embedding").withColumnRenamed("id", "vec_id")), ("layout", layout.layout(rows, graph, 3, 12)), ("again", layout.layout(rows.repartition(2), graph, 3, 12))):
        place = {r["vec_id"]: r["place"] for r in df.collect()}
        assert sorted(place) == list(range(300))
        trusted[name] = layout.trustworthiness(x, np.array([place[k] for k in range(300)]))
    assert trusted["layout"] > trusted["components"] and abs(trusted["layout"] - trusted["again"]) < 0.02


def test_fuzzy_weights(spark):
    graph = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.0), (1, 4, 2.0), (2, 1, 0.5), (2, 3, 0.5), (5, 5 + 1, 0.0)], "id long, neighbour long, distance double")
    got = {(r["i"], r["j"]): r["w"] for r in layout.fuzzy_weights(graph).collect()}
    assert all(abs(got[j, i] - w) < 1e-12 for (i, j), w in got.items()) and got[1, 2] == pytest.approx(1) and got[5, 6] == pytest.approx(1)
    falling = layout._falling(np.array([0.5, 1.0, 2.0]))
    assert falling[0] == 1 and falling.sum() == pytest.approx(np.log2(3), abs=1e-4) and got[1, 3] == pytest.approx(falling[1])
    a, b = layout.curve(0.05)
    assert 1.5 < a < 2.0 and 0.8 < b < 0.9


def test_pushes_take_memory_for_few_rows_at_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lodemill.operators import layout as L

    draw = np.random.default_rng(1)
    lists = lambda: pa.FixedSizeListArray.from_arrays(pa.array(draw.standard_normal(50_000)), 5).cast(pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), lists(), pa.array(draw.integers(0, 9, 10_000)), lists()], names=["id", "place", "pulls", "g"])
    run = L._pushed([(k * 7, draw.standard_normal(5).tolist()) for k in range(L.PUSHERS)], 0.5, 1.5, 0.9, 5)
    tracemalloc.start()
    got = pa.Table.from_batches(list(run([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = pa.Table.from_batches([b for k in range(0, 10_000, 100) for b in run([batch.slice(k, 100)])])
    assert got.column(0).to_pylist() == list(range(10_000)) and got.column(1).to_pylist() == alone.column(1).to_pylist()
    assert peak < 60e6, peak


def test_roots_of_a_long_chain_in_few_tables(spark, monkeypatch):
    """Components that hang together in one chain of 100: what each sees grows fourfold from table to table, and no job but its writing counts what moved."""
    from pyspark.sql import functions as F

    from lodemill.sources.readers import Scratch

    made, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, rows, name: made.append(name) or keep(self, rows, name))
    best = spark.createDataFrame([(0, 1, 1.0)] + [(k, k - 1, float(k)) for k in range(1, 100)] + [(200, 201, 1.0), (201, 200, 1.0)], "c long, p long, k double")
    roots = {r["c"]: r["root"] for r in clustering._roots(best, Scratch(spark, "chain"), 1).collect()}
    assert roots == {k: 0 for k in range(100)} | {200: 200, 201: 200}
    assert len(made) <= 6
    rows, n = Scratch(spark, "none").counted(spark.range(3).where("id > 5"), "empty")
    assert n == 0 and rows.count() == 0
    rows, n = Scratch(spark, "some").counted(spark.range(3), "some", F.col("id") > 0)
    assert n == 2 and rows.count() == 3
