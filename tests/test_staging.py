"""Staged tables: where they are, and that they can be discarded."""

import os

import pytest

from lanternfish.plans import staging


def test_stage_and_discard(spark):
    staged = staging.stage(spark.range(5), "t")
    folder = staged.staged_path.removeprefix("file://")
    assert staged.count() == 5 and os.path.isdir(folder) and staged.staged_path.startswith(staging.shared_dir(spark))
    staging.discard(staged)
    assert not os.path.exists(folder)


def test_settled_leaves_the_result_alone(spark):
    passed = []

    def inner():
        passed.append(staging.stage(spark.range(7), "inner"))
        return passed[-1].where("id > 4")

    def outer():
        passed.append(staging.settled(inner, "half"))
        return passed[-1].union(staging.stage(spark.range(2), "more"))

    result = staging.settled(outer, "whole")
    assert sorted(r["id"] for r in result.collect()) == [0, 1, 5, 6]
    assert [os.path.exists(t.staged_path.removeprefix("file://")) for t in (*passed, result)] == [False, False, True]
    lone = staging.stage(spark.range(1), "lone")  # outside: nobody deletes it
    assert lone.count() == 1


def test_settled_cleans_up_after_a_failure(spark):
    passed = []

    def fails():
        passed.append(staging.stage(spark.range(3), "lost"))
        raise ValueError("no result")

    with pytest.raises(ValueError):
        staging.settled(fails, "never")
    assert not os.path.exists(passed[0].staged_path.removeprefix("file://"))
    assert staging.stage(spark.range(1), "after").count() == 1


class Session:
    """A cluster's session without a checkpoint folder."""

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(dict)

    def __init__(self):
        self.conf = self
        self.known = {"spark.sql.warehouse.dir": "hdfs://store/warehouse/"}

    def get(self, key, default=None):
        return self.known.get(key, default)

    def set(self, key, value):
        self.known[key] = value


def test_a_cluster_stages_in_its_warehouse():
    session = Session()
    assert staging.shared_dir(session) == "hdfs://store/warehouse/lanternfish-staging" == session.known["spark.checkpoint.dir"]
    session.set("spark.checkpoint.dir", "s3://b/c/")
    assert staging.shared_dir(session) == "s3://b/c"
