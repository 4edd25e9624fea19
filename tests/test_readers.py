"""Readers that work in tasks: blobs of a repository, coverage databases."""

import sqlite3
import subprocess

import pytest
from pyspark.errors import PySparkException

from tidemark.sources import documents, snapshots


@pytest.fixture
def repo(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "pkg").mkdir()
    for i in range(9):
        (tmp_path / "pkg" / f"m{i}.py").write_text(f"x = {i % 4}\n" * i)
    (tmp_path / "data.bin").write_bytes(b"\0\n\xff")
    (tmp_path / "odd.py").write_bytes(b"# no end")
    (tmp_path / "link.py").symlink_to("odd.py")
    git("add", ".")
    git("commit", "-qm", "one")
    return tmp_path


@pytest.mark.parametrize("revision", ["HEAD", "INDEX"])
def test_tasks_read_what_the_driver_reads(spark, repo, monkeypatch, revision):
    monkeypatch.setattr(snapshots, "FILES_A_TASK", 3)
    monkeypatch.setattr(snapshots, "BLOBS", 2)
    rows = lambda df: sorted((r.path, r.module, r.role, r.content, r.blob_id, r.mode) for r in df.collect())
    by_tasks = snapshots.read_git(spark, str(repo), revision, roots=["pkg"], shared=True)
    assert rows(by_tasks) == rows(snapshots.read_git(spark, str(repo), revision, roots=["pkg"], shared=False))
    assert len(by_tasks.inputFiles()) > 2 and "content" not in by_tasks.select("path", "blob_id")._jdf.queryExecution().executedPlan().toString()


def test_a_missing_blob_is_an_error(spark, repo):
    files = spark.createDataFrame([("s", "a.py", "0" * 40, "100644")], "snapshot string, path string, blob_id string, mode string")
    with pytest.raises(PySparkException, match="no blob"):
        snapshots._with_contents(files, str(repo))


def test_coverage_of_several_databases(spark, tmp_path):
    for i in range(3):
        with sqlite3.connect(tmp_path / f"c{i}.db") as db:
            if i == 1:
                db.execute("PRAGMA journal_mode = wal")
            db.executescript("CREATE TABLE context(id, context); CREATE TABLE file(id, path); INSERT INTO context VALUES (1, 't'), (2, ''), (3, 'u|run'); INSERT INTO file VALUES (1, 'a.py'), (2, 'b.py');")
            if i < 2:
                db.execute("CREATE TABLE line_bits(file_id, context_id, numbits)")
                db.executemany("INSERT INTO line_bits VALUES (?, ?, ?)", [(1, 1, b"\x06"), (2, 2, b"\xff"), (1, 3, bytes([0, 1 << i]))])
            else:
                db.execute("CREATE TABLE arc(file_id, context_id, fromno, tono)")
                db.executemany("INSERT INTO arc VALUES (?, ?, ?, ?)", [(2, 1, -1, 5), (2, 1, 5, -1), (2, 1, 5, 6), (2, 2, 1, 9)])
        db.close()
    (tmp_path / "c3.db").write_bytes(b"")
    got = documents.read_coverage(spark, [f"{tmp_path}/c{i}.db" for i in range(4)]).collect()
    assert sorted((r.test_id, r.path, r.line) for r in got) == [("t", "a.py", 1), ("t", "a.py", 2), ("t", "b.py", 5), ("t", "b.py", 6), ("u|run", "a.py", 8), ("u|run", "a.py", 9)]
