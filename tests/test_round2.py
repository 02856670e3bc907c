"""Tests of what the findings of round 2 named."""

import ipaddress
import os
import random

import duckdb
import pandas as pd
import pytest

import tessella.queries as core
from tessella.operators import degree as degrees
from tessella.operators import cores, icws, solvers, spanning, stars, traversal
from tessella.operators.matrix import SparseMatrix
from tessella.sources import netaddr

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def against_sql(spark, name, folder, **tables):
    """The query and its SQL on tables written by hand, as sorted rows."""
    duck = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(f"{folder}/{t}.parquet")
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = core.QUERIES[name](spark, str(folder))
    r = duck.execute(core.ORACLE[name])
    columns = [c[0] for c in r.description]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(r.fetchall())


@needs_data
def test_matrix_arrays_stay_with_the_executors(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("the arrays came to the driver")

    monkeypatch.setattr(SparseMatrix, "to_arrays", fail)
    assert core.QUERIES["matrix_arrays"](spark, DATA).count() > 0


@pytest.mark.parametrize("layout", ["csr", "csc"])
def test_array_blocks(spark, layout):
    cells = {(i * 7 % 50, i * 13 % 40): float(i) for i in range(500)}
    m = getattr(SparseMatrix.from_coo(spark.createDataFrame([(*k, v) for k, v in cells.items()], "row long, col long, val double")), f"to_{layout}")()
    blocks = sorted(m.array_blocks().collect())
    place = 0
    for b in blocks:
        assert b["start"] == place
        place += len(b["row"])
    listed = [(r, c, v) for b in blocks for r, c, v in zip(b["row"], b["col"], b["val"], strict=True)]
    assert listed == sorted(((*k, v) for k, v in cells.items()), key=lambda e: e[:2] if layout == "csr" else e[1::-1])
    assert list(zip(*m.to_arrays(), strict=True)) == listed


def test_ip_split_v6_of_large_keys(spark, tmp_path):
    keys = [1, 9, 65535, 65536, 900_000, 2**32 + 5, 2**48 + 70_000]
    against_sql(spark, "ip_split_v6", tmp_path, customer=pd.DataFrame({"c_custkey": keys}))


def test_halves_stay_exact_beside_missing_ones():
    texts = ["2001:db8:0:7::ffff:1", "none", None, "10.0.0.1"]
    n = int(ipaddress.ip_address(texts[0]))
    found = netaddr.halves(pd.Series(texts))
    assert found["hi"].tolist()[0] == n >> 64 and found["lo"].tolist()[0] == 0xFFFF0001
    assert found["hi"].isna().tolist() == [False, True, True, False]


def test_sym_edges_where_labels_meet(spark, tmp_path):
    s = core.SUPPLIERS
    pairs = [(s + 1, 2), (s + 2, 1), (s + 2, 1), (s + 3, 3), (5, 1), (5, 1), (s + 1, 2)]
    against_sql(spark, "sym_edges", tmp_path, lineitem=pd.DataFrame([(p, q, 1.0) for p, q in pairs], columns=["l_partkey", "l_suppkey", "l_quantity"]))


@pytest.mark.parametrize("bands", [3, 4, 10])
def test_band_links_and_pairs_lose_none(spark, bands):
    rng = random.Random(bands)
    known = {i: [rng.randrange(3 * bands) for _ in range(2 * bands)] for i in range(90)}
    known |= {i + 90: list(known[i]) for i in range(0, 90, 7)}
    for i in range(0, 60, 2):  # sets of the same band
        b = rng.randrange(bands)
        known[i + 1][2 * b : 2 * b + 2] = known[i][2 * b : 2 * b + 2]
    table = spark.createDataFrame([(i, h, e) for i, v in known.items() for h, e in enumerate(v)], "set_id long, hash int, elt long")
    cut = {i: [tuple(v[2 * b : 2 * b + 2]) for b in range(bands)] for i, v in known.items()}
    links = {i: {j for j in cut if j != i and any(x == y for x, y in zip(cut[i], cut[j], strict=True))} for i in cut}
    label = {i: i for i in cut}
    for _ in cut:
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in cut}
    assert {tuple(r) for r in icws.band_links(table, 2).collect()} == {(i, label[i], len(links[i])) for i in cut}
    found = {tuple(r) for r in icws.band_pairs(table, 2).collect()}
    head = {i: min(j for j in cut if cut[j] == cut[i]) for i in cut}
    heads = {(a, b) for a in set(head.values()) for b in links[a] if a < b and head[b] == b}
    assert found == heads | {(head[i], i) for i in cut if head[i] != i}


def test_minhash_in_several_passes(spark):
    sets = spark.createDataFrame([(s, e, 1.0 + (s * e) % 4) for s in range(5) for e in range(20)], "set_id long, elt long, weight double")
    whole = {tuple(r) for r in icws.minhash(sets, 37).collect()}
    assert len(whole) == 5 * 37
    assert {r for r in whole if r[1] < 16} == {tuple(r) for r in icws.minhash(sets.repartition("set_id"), 16, gathered=True).collect()}


@needs_data
def test_icws_bands_gives_every_document(spark):
    found = core.QUERIES["icws_bands"](spark, DATA)
    assert found.count() == spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").distinct().count()
    assert found.where("n_links > 0").count() > 0


def test_products_move_sums_only(spark):
    n = 64  # dense: n * n cells, n ** 3 products
    cells = spark.range(n * n).selectExpr("id div 64 as row", "id % 64 as col", "1.0d as val")
    m = SparseMatrix.from_coo(cells.repartition(4))
    entries = m.transpose().spgemm(m).entries
    assert {tuple(r) for r in entries.collect()} == {(i, j, float(n)) for i in range(n) for j in range(n)}
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(k" in plan and "Join" not in plan


@needs_data
@pytest.mark.parametrize("name", ["spgemm", "spgemm_min_plus", "jaccard_rows"])
def test_products_by_more_ranges_than_partitions(spark, monkeypatch, name):
    whole = {tuple(round(x, 6) for x in r) for r in core.QUERIES[name](spark, DATA).collect()}
    monkeypatch.setattr("tessella.operators.matrix.RANGE", 7)
    monkeypatch.setattr("tessella.operators.matrix.FEW_ROWS", 1)
    assert {tuple(round(x, 6) for x in r) for r in core.QUERIES[name](spark, DATA).collect()} == whole


@needs_data
@pytest.mark.parametrize("name", ["mat_equal", "degree"])
def test_parts_grow_with_the_rows(spark, monkeypatch, name):
    whole = sorted(map(tuple, core.QUERIES[name](spark, DATA).collect()))
    seen = []
    move = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *c: seen.append(n) or move(self, n, *c))
    for module in ("tessella.operators.matrix", "tessella.operators.degree", "tessella.queries"):
        monkeypatch.setattr(f"{module}.PART", 500)
    assert sorted(map(tuple, core.QUERIES[name](spark, DATA).collect())) == whole
    assert any(isinstance(n, int) and n >= 11 for n in seen)


def test_degree_counts_neighbours_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (1, 3), (4, 4)], "src long, dst long")
    assert sorted(map(tuple, degrees.degree(edges).collect())) == [(1, 2), (2, 1), (3, 1), (4, 1)]


def test_forest_sends_no_table_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(spanning, "star_components", lambda edges, scratch, **k: stars.star_components(edges, scratch, small=0, **k))
    plans = []
    keep = spanning.Scratch.keep

    def watched(self, df, *partitions):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, *partitions)

    monkeypatch.setattr(spanning.Scratch, "keep", watched)
    rng = random.Random(5)
    known = {(a, b): rng.randrange(9) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a < b}
    _, forest = spanning.msf_boruvka(spark.createDataFrame([(a, b, w) for (a, b), w in known.items()], "src long, dst long, w long"))
    root, want = {}, set()

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for w, a, b in sorted((w, a, b) for (a, b), w in known.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    assert {tuple(r) for r in forest.collect()} == want
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_preconditioner_reads_its_entries_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    entries = spark.createDataFrame([(i, i, 2.0 + i) for i in range(20)], "row long, col long, val double").mapInPandas(counted, "row long, col long, val double")
    precon = solvers.diagonal_preconditioner(entries, 20)
    x = spark.range(20).selectExpr("id", "1.0d as x")
    for _ in range(3):
        assert {tuple(r) for r in precon(x).collect()} == {(i, 1 / (2.0 + i)) for i in range(20)}
    assert reads.value == 20


def _random_graph(nodes, count, seed):
    rng = random.Random(seed)
    known = {(a, b): float(rng.randrange(1, 98)) for a, b in ((rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)) if a < b}
    return known | {(b, a): w for (a, b), w in known.items()}


def test_shortest_paths_pass_edges_on_about_once(spark, monkeypatch):
    known = _random_graph(300, 6000, 4)
    moved = []
    join = traversal.Layout.join

    def watched(self, values, how="inner"):
        out = join(self, values, how)
        moved.append(out.count())
        return out

    monkeypatch.setattr(traversal.Layout, "join", watched)
    monkeypatch.setattr(traversal.Layout.__init__, "__defaults__", (5, *traversal.Layout.__init__.__defaults__[1:]))
    edges = spark.createDataFrame([(*p, w) for p, w in known.items()], "src long, dst long, w double")
    best = {7: (0.0, 0, 7)}  # distance, edges, parent
    for _ in range(300):
        fresh = dict(best)
        for (a, b), w in known.items():
            if a in best:
                fresh[b] = min(fresh.get(b, (1e9, 0, 0)), (best[a][0] + w, best[a][1] + 1, a))
        if fresh == best:
            break
        best = fresh
    found = traversal.sssp_bf(edges, 7, full=False)
    assert {r["id"]: (r["dist"], r["parent"]) for r in found.collect()} == {i: (b[0], b[2]) for i, b in best.items()}
    assert sum(moved) < 2 * len(known)  # Bellman-Ford without waiting: 2.96 times
    found = traversal.sssp_bf(edges, 7, full=False, parents=False)
    assert {r["id"]: r["dist"] for r in found.collect()} == {i: b[0] for i, b in best.items()}


def test_core_numbers_move_what_fell_only(spark, monkeypatch):
    moved = []
    join = cores.Layout.join

    def watched(self, values, how="inner"):
        out = join(self, values, how)
        moved.append(out.count())
        return out

    monkeypatch.setattr(cores.Layout, "join", watched)
    monkeypatch.setattr(cores.Layout.__init__, "__defaults__", (5, *cores.Layout.__init__.__defaults__[1:]))
    path = [(1000 + i, 1001 + i) for i in range(30)]  # falls from its ends, a node a round
    hub = [(0, i) for i in range(1, 60)]
    known = {p for a, b in path + hub + list(_random_graph(60, 400, 8)) if a != b for p in ((a, b), (b, a))}
    near = {}
    for a, b in known:
        near.setdefault(a, set()).add(b)
    degree, want, k = {i: len(x) for i, x in near.items()}, {}, 0
    while degree:
        i = min(degree, key=degree.get)
        k = want[i] = max(k, degree.pop(i))
        for j in near[i] & degree.keys():
            degree[j] -= 1
    edges = spark.createDataFrame(sorted(known), "src long, dst long")
    assert {tuple(r) for r in cores.core_number(edges).collect()} == set(want.items())
    assert len(moved) > 14 and sum(moved) < 4 * len(known)
    one = {i: max(min(c, sum(len(near[j]) >= c for j in near[i])) for c in range(len(near[i]) + 1)) for i in near}
    assert {tuple(r) for r in cores.core_number(edges, 1).collect()} == set(one.items())
    assert cores.core_number(edges.limit(0)).count() == 0
