import random

import numpy as np
import pytest

from tessella.operators import dense2d, distance, icws, solvers, summaries
from tessella.operators.matrix import SparseMatrix, gen_ranges
from tessella.plans.rank import with_rank, with_running_sum


def coo(spark, dense):
    a = np.array(dense)
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return SparseMatrix.from_coo(spark.createDataFrame(rows, "row long, col long, val double"), a.shape)


def dense(m):
    out = np.zeros(m.shape)
    for r in m.entries.collect():
        out[r["row"], r["col"]] = r["val"]
    return out


def vector(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")


def listed(df):
    return [r[1] for r in sorted((r["id"], r["x"]) for r in df.collect())]


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(1)
    return [rng.integers(-3, 4, s) * (rng.random(s) < 0.5) for s in ((6, 5), (5, 4), (6, 5))]


def test_products(spark, pair):
    a, b, c = pair
    A, B, C = (coo(spark, x) for x in pair)
    assert (dense(A.spgemm(B)) == a @ b).all()
    assert (dense(A + C) == a + c).all() and (dense(A - C) == a - c).all()
    assert (dense(A.hadamard(C)) == a * c).all()
    assert (dense(A.transpose()) == a.T).all()
    x = np.arange(1, 6)
    got = {r["id"]: r["y"] for r in A.dot(vector(spark, x), full=True).collect()}
    assert [got[i] for i in range(6)] == (a @ x).tolist()
    assert A.product_size(B) == sum(np.count_nonzero(a[:, k]) * np.count_nonzero(b[k]) for k in range(5))


def test_scalars_touch_stored_entries(spark, pair):
    a, A = pair[0], coo(spark, pair[0])
    stored = a != 0
    for got, want in ((A + 2, a + 2), (A - 2, a - 2), (2 - A, 2 - a), (A * 3, a * 3), (A / 2, a / 2)):
        assert (dense(got) == np.where(stored, want, 0)).all()
    with pytest.raises(ZeroDivisionError):
        A / 0
    with pytest.raises(TypeError):
        A + "x"


def test_errors_and_equality(spark, pair):
    A, B, _ = (coo(spark, x) for x in pair)
    with pytest.raises(ValueError):
        A.spgemm(A)
    with pytest.raises(ValueError):
        A + B
    with pytest.raises(ValueError):
        A.dot(vector(spark, [1.0]))
    assert A == A.transpose().transpose()
    assert A != A * 2 and A != A.to_csr()
    with pytest.raises(ValueError):
        SparseMatrix.from_coo(spark.createDataFrame([(-1, 0, 1.0)], "row long, col long, val double"))


def test_layouts(spark, pair):
    a, A = pair[0], coo(spark, pair[0])
    ptr = [r["ptr"] for r in sorted(A.indptr("row").collect())]
    assert ptr == np.r_[0, np.cumsum((a != 0).sum(axis=1))].tolist()
    ptr = [r["ptr"] for r in sorted(A.indptr("col").collect())]
    assert ptr == np.r_[0, np.cumsum((a != 0).sum(axis=0))].tolist()
    rows, cols, _ = A.to_csc().to_arrays()
    assert list(zip(cols, rows, strict=True)) == sorted(zip(cols, rows, strict=True))


def test_jaccard(spark):
    a = np.array([[1, 1, 0], [1, 1, 1], [0, 0, 1]])
    got = dense(coo(spark, a).jaccard())
    want = [[len(set(np.flatnonzero(x)) & set(np.flatnonzero(y))) / len(set(np.flatnonzero(x)) | set(np.flatnonzero(y))) for y in a] for x in a]
    assert np.allclose(got, want)
    with pytest.raises(ValueError, match="ones"):
        (coo(spark, a) * 2).jaccard()
    with pytest.raises(ValueError, match="empty"):
        coo(spark, [[1, 1], [0, 0]]).jaccard()


def test_ranges(spark):
    r = spark.createDataFrame([(1, 0, 3), (2, 5, 5), (3, 7, 8)], "key long, start long, end long")
    assert sorted(tuple(x) for x in gen_ranges(r).collect()) == [(1, 0), (1, 1), (1, 2), (3, 7)]


def test_global_rank_and_sum(spark):
    n = list(range(500))
    random.Random(1).shuffle(n)
    df = spark.createDataFrame([(x, x % 7) for x in n], "a long, b long")
    assert all(r["rank"] == r["a"] for r in with_rank(df, "a").collect())
    want = np.cumsum([x % 7 for x in range(500)])
    assert all(r["total"] == want[r["a"]] for r in with_running_sum(df, "b", "a").collect())


def test_cg(spark):
    e = coo(spark, [[4, 1], [1, 3]]).entries
    A, b = solvers.matvec_from_coo(e), vector(spark, [1, 2])
    s = solvers.cg(A, b, vector(spark, [2, 1]))
    assert listed(s.x) == pytest.approx([1 / 11, 7 / 11]) and (s.istop, s.niter) in ((3, 2), (2, 2))
    assert solvers.cg(A, vector(spark, [0, 0])).istop == 0
    assert solvers.cg(A, b, vector(spark, [1 / 11, 7 / 11])).istop == 1
    P = solvers.diagonal_preconditioner(e, 2)
    assert listed(P(vector(spark, [1, 1]))) == pytest.approx([1 / 4, 1 / 3])
    assert listed(solvers.cg(A, b, precon=P).x) == pytest.approx([1 / 11, 7 / 11])
    with pytest.raises(ValueError, match="diagonal"):
        solvers.diagonal_preconditioner(coo(spark, [[4, 1], [1, 0]]).entries, 2)


def test_minres_and_symmlq(spark):
    A = solvers.matvec_from_coo(coo(spark, [[6, 3, 0], [3, -2, 5], [0, 5, 2]]).entries, (3, 3))
    b = vector(spark, [6, 55, 8])
    s = solvers.minres(A, b)
    assert listed(s.x) == pytest.approx([2, -2, 9]) and (s.istop, s.niter) == (1, 3)
    assert solvers.minres(A, b, vector(spark, [2, -2, 9])).istop == 0
    s = solvers.symmlq(A, b)
    assert listed(s.x) == pytest.approx([2, -2, 9]) and s.istop in (1, 2)
    crooked = solvers.matvec_from_coo(coo(spark, [[1, 2], [0, 1]]).entries, (2, 2))
    assert solvers.minres(crooked, vector(spark, [1, 2])).istop == 7
    assert solvers.symmlq(crooked, vector(spark, [1, 2])).istop == 6
    double = solvers.matvec_from_coo(coo(spark, [[2, 0], [0, 2]]).entries)
    s = solvers.symmlq(double, vector(spark, [2, 4]))
    assert s.istop == -1 and listed(s.x) == pytest.approx([1, 2])
    assert solvers.minres(double, vector(spark, [2, 4])).istop == -1


def test_distances(spark):
    df = spark.createDataFrame([(0, 3), (1, 4), (2, 5)], "a long, b long")
    row = df.agg(distance.dot("a", "b"), distance.cosine("a", "b"), distance.euclidean("a", "b")).first()
    assert row[0] == 14 and row[1] == pytest.approx(0.1145622551528539) and row[2] == pytest.approx(5.196152422706632)
    assert spark.range(10).agg(distance.magnitude("id")).first()[0] == pytest.approx(16.881943016134134)
    arrays = spark.createDataFrame([([0.0, 1.0, 2.0], [3.0, 4.0, 5.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "u array<double>, v array<double>")
    got = arrays.select(distance.array_cosine("u", "v"), distance.array_euclidean("u", "v")).collect()
    assert got[0][0] == pytest.approx(0.1145622551528539) and got[1][0] is None and got[2][1] is None


def test_minhash(spark):
    offsets, rng = [0, 3, 10, 15], random.Random(3)
    elements, weights = [rng.randrange(40) for _ in range(20)], [rng.uniform(0.5, 5) for _ in range(20)]
    sets = icws.sets_from_offsets(spark, offsets, elements, weights)
    assert sets.select("set_id").distinct().count() == 4
    a, b = (sorted(map(tuple, icws.minhash(sets, 5).collect())) for _ in range(2))
    assert a == b and len(a) == 20
    own = {}
    for r in sets.collect():
        own.setdefault(r["set_id"], set()).add(r["elt"])
    assert all(e in own[s] for s, _, e, _ in a)
    x = [(0, i, 1.0) for i in range(20)] + [(1, i + 4, 1.0) for i in range(20)]
    h = icws.minhash(spark.createDataFrame(x, "set_id long, elt long, weight double"), 600)
    hits = h.groupBy("hash").agg({"elt": "min"}).count()
    agree = h.alias("p").join(h.alias("q"), "hash").where("p.set_id = 0 and q.set_id = 1 and p.elt = q.elt and p.t = q.t").count()
    assert hits == 600 and agree / 600 == pytest.approx(16 / 24, abs=0.07)
    same = spark.createDataFrame([(s, i, 1.0) for s in (3, 5, 9) for i in range(6)], "set_id long, elt long, weight double")
    assert sorted(map(tuple, icws.band_pairs(icws.minhash(same, 8), 4).collect())) == [(3, 5), (3, 9)]


def test_dense(spark):
    flat = spark.createDataFrame([(i, i + 1) for i in range(4)], "idx long, val long")
    a = dense2d.reshape(flat, (2, 2))
    assert [r["vals"] for r in sorted(a.rows.collect())] == [[1, 2], [3, 4]]
    assert [r["val"] for r in a[-1].collect()] == [3, 4]
    assert [r["vals"] for r in sorted((a / 2).rows.collect())] == [[0.5, 1.0], [1.5, 2.0]]
    assert (a + True).dtype == "int64" and (a * 1.5).dtype == "float64" and a.binop(a, "==").dtype == "bool"
    assert dense2d.reshape(flat, (1, -1)).shape == (1, 4)
    with pytest.raises(IndexError):
        a[2]
    with pytest.raises(TypeError):
        a["x"]
    with pytest.raises(ValueError):
        dense2d.reshape(flat, (3, 2))
    with pytest.raises(ValueError):
        a + dense2d.full(spark, 1, 4, 1)
    with pytest.raises(ValueError):
        dense2d.random(spark, 5, 1, 2, 2)
    assert dense2d.full(spark, True, 2, 3).text() == "[[True True True]\n [True True True]]"


def test_summaries(spark):
    df = spark.createDataFrame([(float(i), "x") for i in range(11)] + [(None, "x")], "v double, s string")
    h = sorted(map(tuple, summaries.histogram(df, "v", 5).collect()))
    assert [r[3] for r in h] == [2, 2, 2, 2, 3]
    one = summaries.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 3)
    assert sorted(r["n"] for r in one.collect()) == [0, 0, 4]
    assert summaries.histogram(df.where("false"), "v").count() == 0
    assert tuple(summaries.box_whisker(df).first()) == ("v", 0.0, 2.0, 5.0, 8.0, 10.0)
    with pytest.raises(ValueError):
        summaries.numeric_columns(df.select("s"))
    assert summaries.zscore_filter(df, "v", 1).count() == 7
