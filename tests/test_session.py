import pytest

from wartalens import session


class Conf:
    def __init__(self, value=None):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class Context:
    def __init__(self, master):
        self.master = master


class Session:
    def __init__(self, master, value=None):
        self.conf, self.sparkContext = Conf(value), Context(master)


def test_shared_folder_comes_from_the_session():
    assert session.work_dir(Session("yarn", "hdfs://x/ck")) == "hdfs://x/ck"
    assert session.work_dir(Session("local[2]")) == session.work_dir(Session("local[2]"))
    with pytest.raises(RuntimeError):
        session.work_dir(Session("yarn"))


def test_stage_keeps_rows_and_spread_only_small(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    assert sorted(r["doc_id"] for r in session.stage(df).collect()) == list(range(10))
    assert session.spread(df, "doc_id").rdd.getNumPartitions() >= 1


def test_spread_parts_grow_with_the_table(spark, monkeypatch):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    cores = spark.sparkContext.defaultParallelism
    parts = []
    for size in (1, 100 * session.SPREAD_BYTES, 1 << 60):
        monkeypatch.setattr(session, "estimated_bytes", lambda _, size=size: size)
        spread = session.spread(df, "doc_id")
        parts.append(spread.rdd.getNumPartitions())
        assert spread.count() == 10
    assert parts == [cores, 100, df.rdd.getNumPartitions()]
