import math
import random
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessella.operators import centrality, community, components, cores, edges, generators, independent, partition, spanning, traversal, triangles
from tessella.operators import degree as degrees
from tessella.plans.layout import Layout
from tessella.plans.store import Scratch

# Core numbers of the karate club; G6 and its centralities, below.
KARATE_CORES = [4, 4, 4, 4, 3, 3, 3, 4, 4, 2, 3, 1, 2, 4, 2, 2, 2, 2, 2, 3, 2, 2, 2, 3, 3, 3, 2, 3, 3, 3, 4, 3, 4, 4]
G6 = [(0, 1), (0, 2), (2, 0), (2, 1), (2, 4), (3, 4), (3, 5), (4, 3), (4, 5), (5, 3)]
FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def graph(spark, pairs, both=False, w=None):
    rows = [(*p, w[i]) for i, p in enumerate(pairs)] if w else list(pairs)
    df = spark.createDataFrame(rows, "src long, dst long" + (", w double" if w else ""))
    return edges.symmetrize_edges(df) if both else df


def values(df, *columns):
    rows = sorted(tuple(r) for r in df.select("id", *columns).collect())
    return [r[1] if len(r) == 2 else r[1:] for r in rows]


def pairs_of(df):
    return sorted(tuple(r) for r in df.collect())


def complete(n, base=0):
    return [(base + i, base + j) for i in range(n) for j in range(i)]


@pytest.fixture(scope="module")
def karate(spark):
    return generators.karate_club_graph(spark).cache()


def random_pairs(n=14, m=40, seed=5):
    r = random.Random(seed)
    return [(r.randrange(n) * 3, r.randrange(n) * 3) for _ in range(m)]


def test_edge_steps(spark):
    pairs = random_pairs()
    e = graph(spark, pairs)
    plain = {p for p in pairs if p[0] != p[1]}
    assert pairs_of(edges.remove_loops(e)) == sorted(p for p in pairs if p[0] != p[1])
    assert pairs_of(edges.remove_duplicates(e)) == sorted(set(pairs))
    out, labels = edges.standardize_edges(e, return_labels=True)
    names = sorted({x for p in plain for x in p})
    assert values(labels, "label") == names
    assert pairs_of(out) == sorted((names.index(a), names.index(b)) for a, b in plain)
    both = edges.standardize_edges(e, symmetric=True, sort=True)
    assert [tuple(r) for r in both.collect()] == sorted({(names.index(a), names.index(b)) for p in plain for a, b in (p, p[::-1])})
    with pytest.raises(ValueError, match="weights"):
        edges.standardize_edges(e, weight_reduce="sum")


def test_subgraph(spark):
    pairs = random_pairs(seed=6)
    e, nodes = graph(spark, pairs), spark.range(0, 20)
    assert pairs_of(edges.subgraph(e, nodes)) == sorted(p for p in pairs if p[0] < 20 and p[1] < 20)
    assert pairs_of(edges.subgraph(e, nodes, one_hop=True)) == sorted(p for p in pairs if p[0] < 20 or p[1] < 20)


@pytest.mark.parametrize("light", [5, 100_000])
def test_layout_joins_as_a_join_does(spark, light):
    """With and without heavy nodes, whose edges lie in several slots."""
    pairs = [(0, i) for i in range(60)] + [(7, i) for i in range(30)] + random_pairs()
    values_ = spark.createDataFrame([(i, i * 2) for i in range(0, 45)], "id long, x long")
    laid = Layout(graph(spark, pairs), "src", Scratch(spark, "test"), light)
    assert (laid.heavy is None) == (light > 100)
    assert sorted(tuple(r) for r in laid.join(values_).select("src", "dst", "x").collect()) == sorted((a, b, 2 * a) for a, b in pairs)
    plan = laid.join(values_.hint("shuffle_merge"))._jdf.queryExecution().executedPlan().toString() if laid.heavy is None else "Bucketed: true"
    assert "Bucketed: true" in plan


@FEW
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=8))
def test_pack_round_trip(spark, pairs):
    e = graph(spark, pairs)
    assert pairs_of(edges.unpack_edges(edges.pack_edges(e))) == sorted(pairs)


def test_pack_refuses_large_labels(spark):
    with pytest.raises(Exception, match="32 bits"):
        edges.pack_edges(graph(spark, [(1 << 32, 1)])).collect()


def test_degrees(spark):
    pairs = random_pairs(9, 25, 7)
    e, n = graph(spark, pairs), max(max(p) for p in pairs) + 1
    assert values(degrees.out_degree(e), "degree") == [sum(a == i for a, _ in pairs) for i in range(n)]
    assert values(degrees.in_degree(e), "degree") == [sum(b == i for _, b in pairs) for i in range(n)]
    names = sorted({x for p in pairs for x in p})
    assert values(degrees.degree(e), "degree") == [len({b for a, b in pairs if a == i} | {a for a, b in pairs if b == i}) for i in names]
    w = graph(spark, pairs, w=[float(i) for i in range(len(pairs))])
    assert values(degrees.degree(w), "degree") == [sum(k * ((a == i) + (b == i)) for k, (a, b) in enumerate(pairs)) for i in names]
    assert sum(values(degrees.degree(e, normalize=True), "degree")) == pytest.approx(1)


def test_degree_order(spark):
    ranks, arcs = degrees.degree_order(generators.path_graph(spark, 4))
    assert values(ranks, "rank") == [0, 2, 3, 1]
    assert pairs_of(arcs) == [(0, 2), (1, 3), (2, 3)]


def test_partitions(spark):
    a = [1, 2, 3, 1, 2, 3, 1, 2, 2, 3]
    t = spark.createDataFrame(list(enumerate(a)), "idx long, label long")
    assert [r[1] for r in sorted(partition.canonical_partition(t).collect())] == [0, 1, 2, 0, 1, 2, 0, 1, 1, 2]
    fine = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "a long, b long")
    assert partition.is_refinement(fine).first()[0]
    assert not partition.is_refinement(fine, "b", "a").first()[0]
    assert partition.is_permutation(partition.random_permutation(spark, 50)).first()[0]


def python_bfs(pairs, sources, limit=None):
    out, todo, parent = {s: 0 for s in sources}, deque(sources), {s: s for s in sources}
    nxt = {}
    for a, b in pairs:
        nxt.setdefault(a, []).append(b)
    while todo:
        x = todo.popleft()
        if limit is not None and out[x] >= limit:
            continue
        for y in nxt.get(x, []):
            if y not in out:
                out[y] = out[x] + 1
                todo.append(y)
    for a, b in pairs:
        if a in out and b in out and out[b] == out[a] + 1:
            parent[b] = max(parent.get(b, -1), a)
    return out, parent


def test_bfs(spark, karate):
    assert values(traversal.bfs_distance(graph(spark, [(0, 1), (0, 2), (2, 3), (3, 4)]), 0), "dist") == [0, 1, 1, 2, 3]
    pairs = pairs_of(karate)
    for sources, limit in (([0], None), ([0, 33], None), ([0], 2)):
        dist, parent = python_bfs(pairs, sources, limit)
        assert values(traversal.bfs_distance(karate, sources, limit), "dist") == [dist.get(i, -1) for i in range(34)]
        assert values(traversal.bfs_forest(karate, sources, limit), "parent") == [parent.get(i, -1) if i in dist else -1 for i in range(34)]
        assert values(traversal.bfs_reachable(karate, sources, limit), "reached") == [i in dist for i in range(34)]


def test_sssp(spark):
    r = random.Random(9)
    pairs = list({tuple(sorted(r.sample(range(10), 2))) for _ in range(18)})
    w = [r.randint(1, 9) / 10 for _ in pairs]
    both = {p: x for (a, b), x in zip(pairs, w, strict=True) for p in ((a, b), (b, a))}
    dist = {pairs[0][0]: 0.0}
    for _ in range(10):
        for (a, b), x in both.items():
            if a in dist and dist[a] + x < dist.get(b, 99):
                dist[b] = dist[a] + x
    found = traversal.sssp_bf(graph(spark, pairs, True, w), pairs[0][0], full=False)
    for row in found.collect():
        assert row["dist"] == pytest.approx(dist.get(row["id"], -1))
        if row["dist"] > 0:
            assert dist[row["parent"]] + both[row["parent"], row["id"]] == pytest.approx(row["dist"])


def two_parts(spark):
    return graph(spark, [(i, i + 1) for i in range(4)] + complete(5, 5), True)


@pytest.mark.parametrize("way", ["bfs_lp", "bfs_lp_rs", "fast_sv", "lps"])
def test_components(spark, karate, way):
    find = getattr(components, way)
    assert values(find(two_parts(spark))[1], "label") == [0] * 5 + [5] * 5
    assert set(values(find(karate)[1], "label")) == {0}


@pytest.mark.parametrize("small", [0, 1000])
def test_star_components(spark, small):
    assert values(components.star_components(two_parts(spark), small=small), "label") == [0] * 5 + [5] * 5
    assert components.star_components(graph(spark, []), small=small).count() == 0


def test_cores(spark, karate):
    p10, k10 = generators.path_graph(spark, 10), generators.complete_graph(spark, 10)
    assert sum(values(cores.k_core(p10, 2), "in_core")) == 0
    assert sum(values(cores.k_core(p10, 1), "in_core")) == 10
    assert sum(values(cores.k_core(k10, 9), "in_core")) == 10
    assert sum(values(cores.k_core(k10, 10), "in_core")) == 0
    assert values(cores.k_core(karate, 3), "in_core") == [c >= 3 for c in KARATE_CORES]
    assert values(cores.core_number(karate), "core") == KARATE_CORES
    assert values(cores.k_core_decomp(karate)[2], "core") == KARATE_CORES


def test_cdlp(spark):
    k, n, ok, labels = community.cdlp(graph(spark, [(0, 1), (1, 0)]), randomize=False)
    assert (k, n, ok, values(labels, "label")) == (2, 2, True, [0, 1])
    k, n, ok, labels = community.cdlp(graph(spark, [(0, 2), (2, 3), (0, 3), (1, 4), (4, 5), (1, 5)], True), randomize=False)
    assert (k, n, values(labels, "label")) == (3, 2, [0, 1, 0, 0, 1, 1])
    k, _, _, labels = community.cdlp(graph(spark, complete(5) + complete(5, 5) + [(0, 5)], True), randomize=False)
    assert (k, values(labels, "label")) == (3, [0] * 5 + [5] * 5)
    k, n, _, labels = community.cdlp(generators.complete_graph(spark, 30), randomize=False)
    assert (k, n, set(values(labels, "label"))) == (2, 1, {0})


def test_mis(spark, karate):
    by_id = karate.selectExpr("src as id", "src as place").distinct()
    found = independent.maximal_independent_set(karate, by_id)
    near, inside = {}, set()
    for a, b in pairs_of(karate):
        near.setdefault(a, set()).add(b)
    for i in sorted(near):
        if not near[i] & inside:
            inside.add(i)
    assert {i for i, m in enumerate(values(found, "member")) if m} == inside
    assert independent.valid_mis(karate, found).first()[0]
    assert not independent.valid_mis(karate, found.selectExpr("id", "false as member")).first()[0]
    for bad in (by_id.where("id > 0"), by_id.selectExpr("id", "id % 7 as place")):
        with pytest.raises(ValueError, match="permutation"):
            independent.maximal_independent_set(karate, bad)


def test_mis_in_random_order_takes_few_rounds(spark, monkeypatch):
    path = generators.path_graph(spark, 1000)
    made = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, *p: made.append(1) or keep(self, df, *p))
    found = independent.maximal_independent_set(path, seed=3).cache()
    assert independent.valid_mis(path, found).first()[0]
    assert len(made) < 5 * 2 * math.log2(1000)


def kruskal(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in rows):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.append((a, b, w))
    return sorted(out)


@FEW
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 4)), min_size=1, max_size=25))
def test_msf_is_kruskals(spark, rows):
    rows = [(a, b, float(w)) for a, b, w in rows if a != b] or [(0, 1, 1.0)]
    df = spark.createDataFrame(rows, "src long, dst long, w double")
    assert pairs_of(spanning.msf_boruvka(edges.symmetrize_edges(df))[1]) == kruskal(rows)


def test_msf_labels(spark):
    labels, forest = spanning.msf_boruvka(graph(spark, [(0, 1), (1, 2), (4, 5)], True, [2.0, 1.0, 3.0]))
    assert values(labels, "component") == [0, 0, 0, 4, 4] and forest.count() == 3


def test_centrality_goldens(spark):
    e, w = graph(spark, G6), graph(spark, G6, w=[float(i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 1)])
    c, x = centrality.eigenvector_centrality(e)
    assert c == pytest.approx(1.61803397, abs=1e-4)
    assert values(x, "x") == pytest.approx([0.3185602, 0, 0.5154412, 0.51544117, 0.51544117, 0.31856016], abs=1e-4)
    c, x = centrality.eigenvector_centrality(w, tol=1e-6)
    assert c == pytest.approx(7.86545993, abs=1e-4)
    assert values(x, "x") == pytest.approx([0.11856115, 0, 0.46627055, 0.56972278, 0.66234765, 0.07243326], abs=1e-4)
    h = centrality.hub_auth(e)
    assert values(h, "hub") == pytest.approx([0.35468849, 0, 0.75013338, 0.48164091, 0.26849258, 0.08619601], abs=1e-4)
    assert values(h, "authority") == pytest.approx([0.3697928, 0.54464337, 0.17485057, 0.17485062, 0.60722703, 0.36979285], abs=1e-4)
    assert values(centrality.pagerank(e, alpha=0.9), "rank") == pytest.approx([0.03721197, 0.05395736, 0.04150566, 0.3750808, 0.20599833, 0.28624587], abs=1e-6)
    assert values(centrality.pagerank(w), "rank") == pytest.approx([0.04711131, 0.06477131, 0.06087235, 0.35146311, 0.19361657, 0.28216535], abs=1e-6)


def test_personal_pagerank(spark):
    k4 = generators.complete_graph(spark, 4)
    for p, want in (([1, 1, 4, 4], [0.23246, 0.23246, 0.26753, 0.26753]), ([0, 0, 0, 1], [0.22077, 0.22077, 0.22077, 0.33766])):
        vec = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "id long, x double")
        assert values(centrality.pagerank(k4, p_vec=vec), "rank") == pytest.approx(want, abs=1e-4)
    with pytest.raises(ValueError, match="3 values"):
        centrality.pagerank(k4, p_vec=spark.createDataFrame([(i, 1.0) for i in range(3)], "id long, x double"))


def test_triangles(spark, karate):
    total, per = triangles.count_triangles(karate)
    assert total == 45
    assert sum(values(per, "triangles")) == 135
    # K4: every node has all 4 triangles within reach of its triangle neighbours
    assert values(triangles.triangle_centrality(generators.complete_graph(spark, 4)), "centrality") == pytest.approx([1.0] * 4)
    assert triangles.count_triangles(generators.path_graph(spark, 5))[0] == 0


def test_generators(spark):
    sides = generators.karate_club_sides(spark).collect()
    assert len(sides) == 34 and sum(r["community"] for r in sides) == 17
    tree = generators.random_tree(spark, 40)
    assert tree.count() == 78 and components.component_count(components.star_components(tree)).first()[0] == 1
    r = generators.rmat(spark, 6, 4)
    assert r.where("src = dst").count() == 0 and r.count() == r.distinct().count()
    assert pairs_of(r) == pairs_of(generators.rmat(spark, 6, 4))
    with pytest.raises(ValueError):
        generators.rmat(spark, 4, 4, p=(0.5, 0.5, 0.5, 0.5))
    assert math.isclose(generators.complete_graph(spark, 6).count(), 30)
    assert generators.gnp(spark, 30, 0.2).where("src = dst").count() == 0
