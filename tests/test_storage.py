from __future__ import annotations

import os

import pytest

from quillon import storage
from quillon.storage import scratch, settled, shared_dir, stored


def local(df) -> str:
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_scratch_and_settled(spark):
    with scratch():
        inner = stored(spark.range(3).toDF("x"), "a")
        assert os.path.isdir(local(inner)) and inner.count() == 3
        path = local(inner)
    assert not os.path.isdir(path)
    seen = []

    @settled("sum")
    def total(df):
        step = stored(df.selectExpr("x + 1 as x"), "step")
        seen.append(local(step))
        return step.groupBy().sum("x").toDF("s")

    out = total(spark.range(4).toDF("x"))
    assert out.first()["s"] == 10 and not os.path.isdir(seen[0]) and os.path.isdir(local(out))
    with scratch():
        nested = total(spark.range(2).toDF("x"))
        at = local(nested)
    assert not os.path.isdir(at)


def test_setting_of_the_session_wins():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.checkpoint.dir": "hdfs://shared/x/"}.get(key, default)

    assert shared_dir(Session) == "hdfs://shared/x"


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
