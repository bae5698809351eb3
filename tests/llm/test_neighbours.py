import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import neighbours
from millrace.llm.additive import train

VECTORS = "vec_id long, coll_name string, vector_name string, _id string, embedding array<float>"
SPECS = "coll_name string, schema_version long, vector_name string, dim int, distance_kind string, element_type string, index_kind string"
KINDS = ["Cosine", "Euclid", "Dot", "Manhattan"]


def score(kind, a, b):
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    if kind == "Cosine":
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    if kind == "Dot":
        return a @ b
    return -np.linalg.norm(a - b, 2 if kind == "Euclid" else 1)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    out = []
    for s, kind in enumerate(KINDS):
        centres = rng.normal(size=(6, 8)) * 4
        x = (centres[rng.integers(0, 6, 260)] + rng.normal(size=(260, 8)) * 0.6).astype(np.float32)
        x[100:150] = x[99]  # a large group of copies
        x[200] = x[201] * np.float32(1.001)
        out += [(1000 * s + k, "c", kind, str(k), v.tolist()) for k, v in enumerate(x)]
        out += [(1000 * s + 900, "c", kind, "null", None), (1000 * s + 901, "c", kind, "short", [1.0] * 7), (1000 * s + 902, "c", kind, "nan", [float("nan")] * 8)]
        out += [(1000 * s + 903, "c", kind, "zero", [0.0] * 8), (1000 * s + 904, "c", kind, "gap", [None] + [1.0] * 7), (1000 * s + 905, "x", kind, "none", [1.0] * 8)]
    return out + out[:20] + [(9000, "c", "one", "a", [1.0, 2.0])]


@pytest.fixture(scope="module")
def frames(spark, data):
    specs = [("c", v, kind, 8, kind, "F32", None) for kind in KINDS for v in (1, 2)] + [("c", 1, "one", 2, "Cosine", "F32", None), ("e", 1, "x", 3, "Euclid", "F32", None)]
    return spark.createDataFrame(data, VECTORS), spark.createDataFrame(specs, SPECS)


def usable(data):
    for i, c, kind, name, v in dict.fromkeys((*r[:4], r[4] and tuple(r[4])) for r in data):
        if c == "c" and kind in KINDS and name not in ("null", "short", "nan", "gap") and not (name == "zero" and kind == "Cosine"):
            yield i, kind, v


def test_usable(frames, data):
    got = {r.vec_id for r in neighbours.usable_vectors(*frames).collect()}
    assert got == {i for i, _, _ in usable(data)} | {9000}


@pytest.mark.parametrize("block", [4096, 40])
def test_similar_against_brute_force(frames, data, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    got = {r.vec_id: r.hits for r in neighbours.similar(*frames, k=5, probes=99).collect()}
    rows = list(usable(data))
    assert got.keys() == {i for i, _, _ in rows} | {9000} and got[9000] == []
    right = total = 0
    for i, kind, v in rows:
        scored = sorted((-score(kind, v, w), j) for j, other, w in rows if other == kind and j != i)
        for h in got[i]:
            assert h.far == pytest.approx(next(s for s, j in scored if j == h.id), abs=1e-5)
        assert len(got[i]) == 5 and len({h.id for h in got[i]}) == 5 and list(got[i]) == sorted(got[i], key=lambda h: (h.far, h.id))
        total += 5
        right += sum(h.far <= scored[4][0] + 1e-5 for h in got[i])
    assert right / total > 0.97


def test_copies_are_listed_by_id(frames):
    got = {r.vec_id: [h.id for h in r.hits] for r in neighbours.similar(*frames, k=3).collect()}
    assert got[1149] == [1099, 1100, 1101] and got[1099] == [1100, 1101, 1102] and got[1100] == [1099, 1101, 1102]


def test_mutual_pairs(frames, data):
    got = {tuple(r) for r in neighbours.mutual_pairs(*frames, k=4).collect()}
    rows = list(usable(data))
    near = {}
    for i, kind, v in rows:
        scored = sorted((-score(kind, v, w), j) for j, other, w in rows if other == kind and j != i)[:4]
        near[i] = {j for s, j in scored if (kind == "Cosine" and s <= -0.98) or (kind == "Euclid" and s <= 1)}
    exact = {(i, j) for i in near for j in near[i] if i < j and i in near[j]}
    assert len(got & exact) / len(got | exact) > 0.97
    assert (200, 201) in got


def test_only_restricts_queries(frames):
    condition = F.col("vec_id") % 100 == 0
    found = neighbours.similar(*frames, k=5, only=condition)
    exact = neighbours.exact_neighbours(*frames, condition, k=5, block=7)
    assert {r.vec_id for r in found.collect()} == {r.vec_id for r in exact.collect()} | ({9000})
    r = neighbours.recall(found, exact).first()
    assert r.queries == found.count() and r.recall > 0.9


def test_empty(spark, frames):
    none = frames[0].limit(0)
    assert neighbours.similar(none, frames[1]).count() == 0 and neighbours.mutual_pairs(none, frames[1]).count() == 0
    assert neighbours.mutual_pairs(frames[0], frames[1].limit(0)).count() == 0


def test_encoding_reduces_the_error():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 12)).astype(np.float32)
    model = train(x, "Euclid", len(x))
    codes, norms = model.encode(x)
    assert ((x - model.decode(codes)) ** 2).sum() < 0.25 * ((x - model.coarse[codes[:, 0]]) ** 2).sum()
    scores = model.scores(x[:5], [codes[:, m].astype(np.intp) for m in range(codes.shape[1])], norms)
    direct = -((x[:5, None] - model.decode(codes)[None]) ** 2).sum(2) + (x[:5] ** 2).sum(1)[:, None]
    assert np.allclose(scores, direct, atol=1e-3)
    for total in (2_000_000, 4_000_000, 40_000_000):  # cells in groups, and divided
        model = train(x, "Euclid", total)
        parts = len(model.middles)
        cells = model.cells(x, 8)
        shards = model.shard_of(cells)
        assert parts == (1 if total < 3_000_000 else -(-total // (3000 * len(model.coarse)))) and len(np.unique(shards)) >= min(100, total // 30_000)
        assert cells.shape == (2000, 8) and all(len(set(c)) == 8 for c in cells)
        middle = model.coarse[cells // parts] + model.middles[cells % parts]
        far = ((x[:, None] - middle) ** 2).sum(2)
        assert (np.diff(far, axis=1) >= -1e-3).all()


@pytest.mark.parametrize("kind", KINDS)
def test_recall_over_many_shards(spark, kind):
    """Cells and shards as of twenty times the rows, so that a query sees a part of them."""
    rng = np.random.default_rng(11)
    n, k = 3000, 10
    centres = rng.normal(size=(60, 16)) * 1.5
    x = (centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 16)) * 0.7) * np.exp(rng.uniform(-1, 1, (n, 1)) * (1.5 if kind == "Dot" else 0.7))
    x = x.astype(np.float32)
    x[7] = x[5] * np.float32(0.01)  # under Dot far from what it finds
    model = train(neighbours.unit(x) if kind == "Cosine" else x, kind, 20 * n)
    asks = np.arange(0, n, 10) + np.arange(300) % 10
    frame = lambda ids: spark.createDataFrame([("s", kind, int(i), bytearray(x[i].tobytes())) for i in ids], "space string, kind string, class_id long, vector binary")
    model.total = n
    neighbours.calibrate(frame(range(n)), {"s": model}, k)
    found = {r.id: [h.class_id for h in r.hits] for r in neighbours.nearest_classes(frame(range(n)), frame(asks), {"s": model}, k).collect()}
    assert found.keys() == set(asks.tolist())
    q = neighbours.unit(x) if kind == "Cosine" else x
    own = model.shard_of(model.cells(q, 1)[:, 0])
    probed = model.shard_of(model.cells(q[asks], model.probes, True))
    scanned = np.mean([np.isin(own, p).mean() for p in probed])
    right = 0
    for i in asks:
        scores = np.array([score(kind, x[i], v) for v in x]) if kind == "Manhattan" else q @ q[i] if kind in ("Cosine", "Dot") else -((q - q[i]) ** 2).sum(1)
        right += len(set(np.argsort(-scores)[:k].tolist()) & set(found[int(i)]))
    assert scanned < 0.7 and right / (k * len(asks)) > 0.9, (scanned, right / (k * len(asks)))


def test_divided_cells_under_dot():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 12)).astype(np.float32)
    model = train(x, "Dot", 40_000_000)
    cells, parts = model.cells(x[:50], 8, True), len(model.middles)
    assert parts > 1 and cells.shape == (50, 9) and (cells[:, :1] == model.cells(x[:50], 1)).all()
    product = np.einsum("nd,nkd->nk", x[:50], model.coarse[cells // parts] + model.middles[cells % parts])[:, 1:]
    assert (np.diff(product, axis=1) <= 1e-3).all() and (product[:, 0] > product[:, -1]).all()


@pytest.mark.parametrize("total", [60_000, 4_000_000])
def test_probes_follow_from_the_data(spark, total):
    """Vectors that do not cluster need more cells than those that do; either way the neighbours are found."""
    rng = np.random.default_rng(3)
    n, k, probes = 3000, 10, []
    tight = rng.normal(size=(60, 16)) * 3
    for x in (tight[rng.integers(0, 60, n)] + rng.normal(size=(n, 16)) * 0.3, rng.normal(size=(n, 16))):
        x = x.astype(np.float32)
        model = train(x, "Euclid", total)  # shards as of so many vectors
        model.total = n
        frame = spark.createDataFrame([("s", "Euclid", i, bytearray(x[i].tobytes())) for i in range(n)], "space string, kind string, class_id long, vector binary")
        neighbours.calibrate(frame, {"s": model}, k)
        probes.append(model.probes)
        shards = model.shard_of(model.cells(x, 1))[:, 0]
        asks = np.arange(0, n, 7)
        probed = model.shard_of(model.cells(x[asks], model.probes, True))
        far = neighbours._far("Euclid", x[asks], x)
        true = np.argsort(far, 1)[:, 1 : k + 1]
        assert np.mean([np.isin(shards[t], p).mean() for t, p in zip(true, probed)]) > 0.95
    assert probes[1] > probes[0] >= neighbours.PROBES
