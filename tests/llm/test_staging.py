"""Staged tables: where they lie, and when they go."""

import os
from types import SimpleNamespace

import pytest

from pixelloom.llm.common import settle, shared_dir, stage


def fake(master, path=None):
    conf = SimpleNamespace(get=lambda key, default=None: path, set=lambda key, value: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None)))


def test_a_cluster_must_name_its_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            shared_dir(fake(master))
        assert shared_dir(fake(master, "hdfs://x/shared/")) == "hdfs://x/shared"
    assert os.path.isdir(shared_dir(fake("local[4]")))


def files(spark):
    top = shared_dir(spark).removeprefix("file:") + "/pixelloom"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_settle_keeps_the_result_alone(spark):
    before = files(spark)

    def make():
        a = stage(spark.range(10), "a")
        b = stage(a.filter("id > 3"), "b", ("id", 3))
        return a.join(b, "id")

    out = settle(spark, lambda: settle(spark, make, "inner").filter("id < 8"), "outer")
    new = {f.rsplit("_", 1)[0] for f in files(spark) - before}
    assert new == {"outer"} and sorted(r.id for r in out.collect()) == [4, 5, 6, 7]


def test_buckets_need_no_shuffle(spark):
    t = stage(spark.range(1000).selectExpr("id % 50 AS k", "id"), "buckets", ("k", 8))
    plan = t.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and t.groupBy("k").count().count() == 50 and not spark.catalog.listTables()


def test_settle_in_two_threads(spark):
    """What one thread stages is no business of another's settle."""
    import threading
    from concurrent.futures import ThreadPoolExecutor

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting, both = files(spark), spark.conf.get(key, None), threading.Barrier(2, timeout=60)

    def run(n):
        def make():
            a = stage(spark.range(n), "a")
            both.wait()
            b = stage(a.filter("id > 3"), "b", ("id", 3))
            both.wait()
            return a.join(b, "id")

        return sorted(r.id for r in settle(spark, make, f"outer{n}").collect())

    with ThreadPoolExecutor(2) as pool:
        assert [*pool.map(run, (10, 20))] == [list(range(4, 10)), list(range(4, 20))]
    assert {f.rsplit("_", 1)[0] for f in files(spark) - before} == {"outer10", "outer20"}
    assert spark.conf.get(key, None) == setting
