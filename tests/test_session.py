from types import SimpleNamespace

import pytest

from ridertide import session


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def fake(master, setting=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=Context(master))


def test_stage_folder_prefers_the_setting():
    spark = fake("spark://host:7077", "/shared/stages")
    assert session.stage_folder(spark) == "/shared/stages"
    session.ensure_checkpoints(spark)
    assert spark.sparkContext.folder == "/shared/stages"


def test_stage_folder_without_a_setting(monkeypatch, tmp_path):
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    spark = fake("local[2]")
    assert session.stage_folder(spark) == str(tmp_path) == session.stage_folder(spark)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.stage_folder(fake("yarn"))


def test_stage_keeps_rows_and_schema(spark):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' AS t, CAST(NULL AS double) AS v FROM range(5)")
    staged = session.stage(df)
    assert staged.schema.simpleString() == df.schema.simpleString() and staged.count() == 5
    assert "Range" not in staged._jdf.queryExecution().optimizedPlan().toString()
