import json
import subprocess
import sys

import numpy as np
import pytest

from postsieve import cli
from postsieve.operators import blocks as B, training as R
from postsieve.sources import store as S


@pytest.fixture(autouse=True)
def home(tmp_path, monkeypatch):
    monkeypatch.setenv(S.HOME, str(tmp_path / "home"))


def box(path, subjects):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(f"From x\nFrom: a@b.example\nSubject: {s}\n\nbody\n\n".encode() for s in subjects))


def test_import_and_datasets(spark, tmp_path, capsys):
    box(tmp_path / "in" / "Inbox", ["one", "two"])
    box(tmp_path / "in" / "Junk", ["win"])
    box(tmp_path / "in" / "Trash", ["gone"])
    (tmp_path / "in" / "Bulk").write_bytes(b"From x\n\n")
    run = lambda *a: (cli.main(list(map(str, a))), capsys.readouterr())
    code, out = run("import", tmp_path / "in", "--name", "mine", "--dry-run")
    assert code == 0 and "5 messages: 2 ham, 1 skip, 2 spam" in out.out and not S.exists("mine")
    code, out = run("import", tmp_path / "in", "--name", "mine")
    m = S.manifest("mine")
    assert code == 0 and m["labels"] == {"ham": 2, "spam": 1} and m["skipped"] == {"empty": 1} and m["folders"]["Inbox"] == {"ham": 2}
    assert {r.subject for r in S.read(spark, "mine").collect()} == {"one", "two", "win"}
    assert run("import", tmp_path / "in", "--name", "mine")[0] == 1 and run("import", tmp_path / "in", "--name", "base-x")[0] == 1
    assert "mine" in run("datasets", "list")[1].out and json.loads(run("datasets", "show", "mine")[1].out)["count"] == 3
    assert run("datasets", "show")[0] == 1 and run("datasets", "delete", "mine")[0] == 0 and run("datasets", "show", "mine")[0] == 1
    assert cli.main([]) == 2 and run("import", tmp_path / "none", "--name", "x")[0] == 1 and run("train", "-o", "m", "--no-base")[0] == 1


def test_failed_write_keeps_old_data(spark):
    rows = spark.createDataFrame([("a", "ham", None, 1)], "folder string, label string, error string, v int")
    S.write("d", rows)
    with pytest.raises(Exception):  # noqa: B017
        S.write("d", rows.selectExpr("folder", "label", "error", "raise_error('no') as v"), force=True)
    assert S.read(spark, "d").count() == 1 and [m["name"] for m in S.datasets()] == ["d"]
    for bad in ("", ".x", "a/b", "x.old", "x\n", "a" * 65):
        with pytest.raises(S.InvalidDatasetName):
            S.location(bad)


@pytest.mark.parametrize("far", [False, True])
def test_store_on_any_file_system(spark, tmp_path, monkeypatch, far):
    """Rows are written once; errors are counted and not read back; a replaced dataset leaves no old rows; tasks may fail and come again."""
    monkeypatch.setenv(S.HOME, f"file:{tmp_path}/far" if far else str(tmp_path / "near"))
    rows = spark.range(40).selectExpr("id", "concat('f', id % 2) folder", "if(id % 3 = 0, null, if(id % 3 = 1, 'spam', 'ham')) label", "if(id % 8 = 7, 'empty', null) error")
    m = S.write("d", rows.repartition(3), {"importer": "test"})
    assert (m["count"], m["labels"], m["skipped"]) == (35, {"unlabeled": 12, "spam": 11, "ham": 12}, {"empty": 5})
    assert sum(sum(x.values()) for x in m["folders"].values()) == 35 and m["importer"] == "test"
    assert sorted(r.id for r in S.read(spark, "d").collect()) == [i for i in range(40) if i % 8 != 7]
    with pytest.raises(S.DatasetExists):
        S.write("d", rows)
    again = S.write("d", rows.where("id < 9"), force=True)
    assert again["count"] == 8 and S.read(spark, "d").count() == 8
    kept = (tmp_path / ("far" if far else "near") / "datasets" / "d").iterdir()
    assert sorted(f.name for f in kept if not f.name.endswith(".crc")) == sorted([again["data"], "manifest.json"])
    # a task that dies after it has written rows is no part of the result
    with pytest.raises(Exception):  # noqa: B017
        S.write("d", rows.selectExpr("id", "folder", "label", "if(id = 39, raise_error('late'), error) error").repartition(2), force=True)
    assert S.manifest("d") == again and S.read(spark, "d").count() == 8
    S.save_settings({"active_model": "x"})
    S.save_settings({"active_model": "y"})
    assert S.settings() == {"active_model": "y"} and [x["name"] for x in S.datasets()] == ["d"]
    S.delete("d")
    assert not S.exists("d") and S.datasets() == []
    with pytest.raises(S.DatasetNotFound):
        S.read(spark, "d")


def test_repeated_task(tmp_path):
    """With tasks that may fail, one that dies after its first rows and runs again leaves each row once."""
    code = f"""
import os, sys
sys.path.insert(0, {str(S.__file__).split('/postsieve/')[0]!r})
os.environ["POSTSIEVE_HOME"] = {str(tmp_path)!r}
from pyspark.sql import SparkSession
from pyspark import TaskContext
from postsieve.sources import store as S
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def some(batches):
    for n, b in enumerate(batches):
        if n == 1 and TaskContext.get().attemptNumber() == 0:
            raise OSError("lost")
        yield b
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
rows = spark.range(0, 100, 1, 2).selectExpr("id", "'f' folder", "'ham' label", "cast(null as string) error")
m = S.write("d", rows.mapInArrow(some, rows.schema))
print("RESULT", m["count"], sorted(r.id for r in S.read(spark, "d").collect()) == list(range(100)))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "RESULT 100 True" in out.stdout, out.stderr[-2000:]


def test_predict(spark, tmp_path, capsys):
    v = B.Vocabulary({"subj": ["win"], "body": []}, {"subj": np.array([1.0]), "body": np.array([])}, np.array([]), np.array([]))
    R.Bundle(R.Model("cnb", v, np.array([[1.0]] * 3), np.zeros(3), [{"a": 1.0, "b": 0.0}] * 3), 0.6, 0.95).save(cli.model_path("m"))
    assert cli.main(["models", "activate", "m"]) == 0 and cli.main(["models", "list"]) == 0 and capsys.readouterr().out.rstrip().endswith("yes")
    (tmp_path / "a.eml").write_bytes(b"From: a@b.example\nSubject: win\n\nhello\n")
    assert cli.main(["predict", str(tmp_path / "a.eml"), "--json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["verdict"] == "suspicious" and got["p_spam"] == 0.8808 and got["reasons"] == [{"feature": "win [subject]", "weight": 2.0}]
    (tmp_path / "b").write_bytes(b"%PDF")
    assert cli.main(["predict", str(tmp_path / "b")]) == 1 and "not-an-email" in capsys.readouterr().err
