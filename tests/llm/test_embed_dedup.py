"""Cells, blocks and links against brute force."""

import time

import numpy as np
import pytest

from pixelloom.llm import embed_dedup
from pixelloom.llm.embed_dedup import cells_of, embedding_groups, spherical_kmeans
from tests.llm.test_dedup import groups


def data(seed=1):
    r = np.random.default_rng(seed)
    x = [r.standard_normal(16) for _ in range(250)]
    for scale in (0.05, 0.2, 0.3):
        x += [b + scale * r.standard_normal(16) for b in x[:60]]
    x += [x[3] * 7, x[3] * 0.001] + [x[9]] * 40 + [x[20] + 0.08 * r.standard_normal(16) for _ in range(150)]
    return [(int(i), [float(np.float32(e)) for e in v]) for i, v in zip(r.permutation(len(x)) * 3, x)]


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 20, "block_rows": 15}, {"cell_rows": 100, "block_rows": 40}])
def test_links_as_by_brute_force(spark, sizes):
    rows = data()
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0] * 15 + [float("inf")]), (5005, [1.0] * 15 + [None]), (5006, [1.0, 0.0]), (5007, [2.0, -0.0])]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    ids = [i for i, _ in rows]
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(close, 1)))] + [(5006, 5007)]
    want = groups(pairs, ids + [i for i, _ in odd])
    n = {i: int(close[k].sum()) - 1 for k, i in enumerate(ids)} | {i: int(i > 5005) for i, _ in odd}
    got = embedding_groups(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), **sizes).collect()
    assert len(pairs) > 5000 and len(got) == len(want)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)


def test_no_pair_is_lost_between_cells():
    """Pairs just above the threshold: one of the two visits the other's cell."""
    r = np.random.default_rng(3)
    x = r.standard_normal((4000, 8))
    y = x + 0.11 * r.standard_normal(x.shape) * np.linalg.norm(x, axis=1, keepdims=True)
    x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    ok = (x * y).sum(axis=1) >= 0.95
    centres = spherical_kmeans(x, 40)
    reach = np.sqrt(2 - 2 * 0.95) / 2
    (hx, vx), (hy, vy) = (cells_of(m, centres, reach) for m in (x, y))
    k = np.arange(len(x))
    assert (hx != hy)[ok].sum() > 100 and (vx[k, hy] | vy[k, hx])[ok].all()


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, n_links int, v string"
    assert embedding_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 2.0], 1, "a"), (4, [1.0, 2.0], 1, "a"), (4, [1.0, 2.0], 2, "b"), (None, [5.0, -1.0], 1, "a"), (None, None, 1, "a")]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([("None", 2, "4", False), ("4", 2, "4", True), ("4", 2, "4", True), ("None", 0, "None", True), ("None", 0, "None", True)])


def test_disk_of_vectors_without_clusters(spark, monkeypatch):
    """Each vector visits some twenty of 64 cells: what leaves for them at once, and what is left behind, is a few times the input."""
    monkeypatch.setattr(embed_dedup, "WAVE", 1, raising=False)
    r = np.random.default_rng(5)
    x = r.standard_normal((6000, 64))
    x[:1500] = x[1500:3000] + r.uniform(0.25, 0.4, (1500, 1)) * r.standard_normal((1500, 64))  # on both sides of the threshold
    x = x.astype(np.float32)
    jvm, sc = spark.sparkContext._gateway.jvm, spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    def left():
        files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    known, before = stages(), left()
    out = embedding_groups(rows)
    for _ in range(20):  # files go a moment after their job
        if (more := left() - before) <= x.nbytes:
            break
        time.sleep(0.5)
    assert more <= x.nbytes
    written = [n for k, n in stages().items() if k not in known]
    assert max(written) <= 4 * x.nbytes < sum(written)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    assert 300 < close.sum() - len(x) < 2700
    assert {r.vec_id: r.n_links for r in out.collect()} == dict(enumerate((close.sum(axis=1) - 1).tolist()))
