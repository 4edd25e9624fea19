"""Snapshots of a repository: plain folders by Spark; of git, names by the driver and contents by tasks, where these reach the repository."""

from __future__ import annotations

import os
import stat
import subprocess
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import exclude, module_names, role
from tidemark.schema import FILES
from tidemark.tables import written


class GitError(RuntimeError):
    """A git command failed."""


def _git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    got = subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=False)
    if got.returncode:
        raise GitError(got.stderr.decode(errors="replace").strip())
    return got.stdout


def _shaped(files: DataFrame, roots: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """FILES rows: modules under the roots are source, the rest and excluded ones are other; what lies under no root is outside."""
    named = module_names(files, list(roots))
    kept, out = exclude(named, list(patterns))
    rows = kept.unionByName(out.withColumn("module", F.lit(None).cast("string")))
    return rows.select("snapshot", "path", "module", role(list(roots)).alias("role"), "content", "blob_id", "mode")


def read_folder(spark: SparkSession, root: str, snapshot: str, roots: Sequence[str] = ("",), patterns: Sequence[str] = ()) -> DataFrame:
    """A snapshot that lies in a folder of any file system; contents stay on the executors.

    Such file systems keep no modes, so all files have the plain one: compare two folders, not a folder with a commit.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^\w+:/*", "/")
    path = F.regexp_replace("path", r"^\w+:/*", "/")
    files = read.select(F.lit(snapshot).alias("snapshot"), F.substring(path, F.length(base) + 2, F.length(path)).alias("path"), "content", F.sha1("content").alias("blob_id"), F.lit("100644").alias("mode"))
    return _shaped(files.where(~F.col("path").rlike(r"(^|/)\.git/")), roots, patterns)


def _blobs(repo: str, ids: list[str]) -> Iterator[bytes]:
    """Contents of blobs, by one batch process."""
    data, at = _git(repo, "cat-file", "--batch", data="".join(f"{i}\n" for i in ids).encode()), 0
    for i in ids:
        end = data.index(b"\n", at)
        head = data[at:end].split()
        if len(head) != 3:
            raise GitError(f"no blob {i}")
        size = int(head[2])
        yield data[end + 1 : end + 1 + size]
        at = end + 2 + size


#: Files of a task that reads blobs, and blobs of one batch process.
FILES_A_TASK, BLOBS = 2_000, 200


def _with_contents(files: DataFrame, repo: str) -> DataFrame:
    """Files (snapshot, path, blob_id, mode) with the contents of their modules, read by tasks and written once: later readers take the columns they need."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), BLOBS):
                own = part.iloc[at : at + BLOBS]
                wanted = own["path"].str.endswith(".py") & (own["mode"] != LINK)
                found = _blobs(repo, own["blob_id"][wanted].tolist())
                yield own.assign(content=[next(found) if w else None for w in wanted])

    return written(files.mapInPandas(run, "snapshot string, path string, blob_id string, mode string, content binary").select("snapshot", "path", "content", "blob_id", "mode"), "blobs")


def resolve_commit(repo: str, revision: str) -> str:
    return _git(repo, "rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()


def file_id(repo: str, revision: str, path: str) -> str | None:
    """The blob id of a path in a revision; null if it has none."""
    rows = _git(repo, "ls-tree", revision, "--", path).decode().split()
    return rows[2] if len(rows) >= 3 and rows[1] == "blob" else None


def commits_in_range(repo: str, span: str) -> list[tuple[str, str, str]]:
    """(commit, first parent, subject) of a range, oldest first."""
    lines = _git(repo, "log", "--first-parent", "--reverse", "--format=%H%x09%P%x09%s", span).decode().splitlines()
    return [(c, p.split(" ")[0], s) for c, p, s in (x.split("\t", 2) for x in lines)]


#: git's modes.
PLAIN, EXECUTABLE, LINK = "100644", "100755", "120000"


def _mode(path: str) -> str | None:
    """The mode git gives a file of the working tree; null for what is no file or link."""
    try:
        found = os.lstat(path).st_mode
    except (FileNotFoundError, NotADirectoryError):
        return None
    if stat.S_ISLNK(found):
        return LINK
    return (EXECUTABLE if found & stat.S_IXUSR else PLAIN) if stat.S_ISREG(found) else None


def _read(path: str) -> bytearray:
    with open(path, "rb") as f:
        return bytearray(f.read())


def read_git(spark: SparkSession, repo: str, revision: str = "HEAD", snapshot: str = "head", roots: Sequence[str] = ("",), patterns: Sequence[str] = (), shared: bool | None = None) -> DataFrame:
    """A commit (any revision), the staged content (``INDEX``) or the working tree (``WORKTREE``).

    Modules are read whole, other files and links by their ids and modes alone.  ``shared`` says that executors reach the repository's folder,
    as they do in local runs: then tasks read what commits and the index hold.  Else, and for a working tree, the driver does.
    """
    if revision == "WORKTREE":
        names = [p for p in _git(repo, "ls-files", "-z", "--cached", "--others", "--exclude-standard").decode().split("\0") if p]
        modes = {p: m for p in dict.fromkeys(names) if (m := _mode(f"{repo}/{p}"))}
        plain = [p for p, m in modes.items() if m != LINK and "\n" not in p]
        ids = dict(zip(plain, _git(repo, "hash-object", "--stdin-paths", data="".join(f"{p}\n" for p in plain).encode()).decode().split(), strict=True))
        for p, m in modes.items():
            if m == LINK:  # a link is what it points to, as git keeps it
                ids[p] = _git(repo, "hash-object", "--stdin", data=os.fsencode(os.readlink(f"{repo}/{p}"))).decode().strip()
            elif p not in ids:
                ids[p] = _git(repo, "hash-object", "--", p).decode().strip()
        table = [(snapshot, p, _read(f"{repo}/{p}") if p.endswith(".py") and m != LINK else None, ids[p], m) for p, m in modes.items()]
    else:
        if revision == "INDEX":
            listed = [x.split("\t", 1) for x in _git(repo, "ls-files", "-s", "-z").decode().split("\0") if x]
            entries = [(h.split()[0], h.split()[1], p) for h, p in listed]
        else:
            listed = [x.split("\t", 1) for x in _git(repo, "ls-tree", "-r", "-z", resolve_commit(repo, revision)).decode().split("\0") if x]
            entries = [(h.split()[0], h.split()[2], p) for h, p in listed if h.split()[1] == "blob"]
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-") if shared is None else shared:
            names = spark.createDataFrame([(snapshot, p, i, m) for m, i, p in entries], "snapshot string, path string, blob_id string, mode string")
            return _shaped(_with_contents(names.repartition(len(entries) // FILES_A_TASK + 1), os.path.abspath(repo)), roots, patterns)
        wanted = [(m, i, p) for m, i, p in entries if p.endswith(".py") and m != LINK]
        content = dict(zip((p for _, _, p in wanted), _blobs(repo, [i for _, i, _ in wanted]), strict=True))
        table = [(snapshot, p, bytearray(content[p]) if p in content else None, i, m) for m, i, p in entries]
    files = spark.createDataFrame(table, "snapshot string, path string, content binary, blob_id string, mode string")
    return _shaped(files, roots, patterns)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FILES)
