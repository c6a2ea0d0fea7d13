"""Whitening against plain linear algebra, on the small table and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import registry, whiten

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, x string, deviation string, key string"


def same_up_to_sign(got, want):
    return np.abs(got * np.sign((got * want).sum(axis=0)) - want).max()


@pytest.mark.parametrize("kind", ["random", "equal", "repeated", "rank", "zero", "one", "pair", "blocks", "close"])
def test_leading_eigenvectors(kind):
    draw = np.random.default_rng(1)
    wide, blocks = draw.normal(size=(40, 5)), np.kron(np.eye(6), np.array([[2.0, 1], [1, 2]]))
    turn = np.linalg.qr(draw.normal(size=(30, 30)))[0]
    close = turn @ np.diag(1 + 1e-6 * np.arange(30)) @ turn.T
    a = {"random": np.cov(draw.normal(size=(30, 200))), "equal": np.eye(8), "repeated": np.diag([5.0, 5, 5, 1, 1, 0]), "rank": wide @ wide.T, "zero": np.zeros((3, 3)), "one": np.array([[3.0]]), "pair": np.array([[2.0, 1], [1, 2]]), "blocks": blocks, "close": close}[kind]
    values, vectors = whiten.leading(a, 12)
    want = np.linalg.eigvalsh(a)[::-1]
    assert len(values) == min(12, int((want > 1e-9).sum()))
    size = max(1, np.abs(want).max())
    assert np.allclose(values, want[: len(values)], atol=1e-13 * size, rtol=0)
    assert np.abs(a @ vectors.T - vectors.T * values).max(initial=0) < 1e-12 * size
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max(initial=0) < 1e-12


def test_query_equals_plain_algebra(spark):
    got = registry.QUERIES["op13_whitening"](spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(table.embedding).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    assert list(wide.index) == list(table.vec_id) and list(wide.columns) == list(range(1, 33))
    assert same_up_to_sign(wide.to_numpy(), centred @ vectors / np.sqrt(values)) < 1e-8
    first = got[got.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == ((n * x - total) ** 2).sum(axis=1).tolist() and set(got.n) == {n}
    assert np.allclose(got.groupby("component").explained.first(), values / np.trace(v), rtol=1e-10)
    cov = np.cov(wide.to_numpy().T, bias=True)
    assert got.identity_error.nunique() == 1 and abs(got.identity_error[0] - np.abs(cov - np.eye(32)).max()) < 1e-12


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], VECTORS)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    kept = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, -2.0, 0.25]), (4, [3.0, 0.0, 0.5]), (5, [-0.001, 1e-9, 0.5])]
    left_out = [(6, None), (7, [1.0, None, 1.0]), (8, [nan, 0.0, 0.0]), (9, [inf, 0.0, 0.0]), (10, []), (11, [1.0, 2.0])]
    x = whiten.on_grid(rows_of(spark, kept + left_out))
    model = whiten.fit(x)
    assert model.n == 5 and len(model.values) == 3 and whiten.identity_error(whiten.whiten(x, model), 5, 3) < 1e-9
    got = whiten.whiten(x, model).collect()
    whole = np.floor(64 * np.array([v for _, v in kept], np.float32).astype(float)).astype(int) + 1_000_000
    want = ((5 * whole - whole.sum(axis=0)) ** 2).sum(axis=1).tolist()
    assert sorted((str(r.vec_id), int(r.deviation)) for r in got) == sorted((str(i), d) for (i, _), d in zip(kept, want))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])], [(1, []), (2, [])]])
def test_nothing_to_whiten_gives_no_rows(spark, tmp_path, rows):
    rows_of(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whiten.op13_whitening(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_sums_are_exact_and_the_partitioning_changes_nothing(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(draw.normal(size=(300, 6)) * [1e-2, 1, 1e3, 1e6, 1e9, 1e11] + 7)]
    x = whiten.on_grid(rows_of(spark, rows))
    once, again = whiten.fit(x), whiten.fit(x.repartition(7))
    assert once.sums == again.sums and (once.values == again.values).all() and (once.components == again.components).all()
    whole = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    assert list(once.sums) == [sum(column) for column in zip(*whole)]
    got = {r.vec_id: int(r.deviation) for r in whiten.whiten(x, once).collect()}
    assert got == {i: sum((300 * c - s) ** 2 for c, s in zip(v, once.sums)) for i, v in enumerate(whole)}
    with pytest.raises(Exception, match="too large"):
        whiten.on_grid(rows_of(spark, [(1, [1e30])])).select(F.sum(F.element_at("x", 1))).collect()
