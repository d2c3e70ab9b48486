"""Named datasets and models under one folder, and the settings file.

A dataset is a manifest that names a folder of Parquet.  Rows are written once, by Spark's own commit of
tasks, into a new folder; then the manifest is replaced in one step, and what it named before is deleted.  So a
write that fails, or a task that runs twice, changes nothing, and readers see old or new rows.  The root may be a
path or a URI of any file system that Spark reaches; models are files of this machine or a mounted folder.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

HOME = "POSTSIEVE_HOME"
UNFINISHED = (".partial", ".old")


class DatasetExists(ValueError):
    pass


class DatasetNotFound(ValueError):
    pass


class InvalidDatasetName(ValueError):
    pass


def is_uri(path: str) -> bool:
    return len(urlsplit(path).scheme) > 1


class Folder:
    """Files by name below a path of this machine or, through Spark, below a URI."""

    def __init__(self, root: str):
        self.root, self.far = root.rstrip("/"), is_uri(root)
        if self.far:
            self.spark = SparkSession.getActiveSession()
            if self.spark is None:
                raise ValueError(f"{root} is reached through Spark, and there is no session")
            self.jvm = self.spark._jvm
            self.files = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}" if self.far else "file://" + os.path.abspath(os.path.join(self.root, name))

    def names(self) -> list[str]:
        if not self.far:
            return sorted(os.listdir(self.root)) if os.path.isdir(self.root) else []
        return sorted(f.getPath().getName() for f in self.files.listStatus(self._path(""))) if self.files.exists(self._path("")) else []

    def exists(self, name: str = "") -> bool:
        return self.files.exists(self._path(name)) if self.far else os.path.exists(os.path.join(self.root, name))

    def read(self, name: str) -> str:
        if not self.far:
            with open(os.path.join(self.root, name), encoding="utf-8") as f:
                return f.read()
        stream = self.files.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """The file has the old text or the new, at any time."""
        new = f".{name}-{uuid.uuid4().hex}"
        if not self.far:
            os.makedirs(self.root, exist_ok=True)
            with open(os.path.join(self.root, new), "w", encoding="utf-8") as f:
                f.write(text)
            return os.replace(os.path.join(self.root, new), os.path.join(self.root, name))
        stream = self.files.create(self._path(new))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(new), self._path(name), option)

    def delete(self, name: str = "") -> None:
        if self.far:
            self.files.delete(self._path(name), True)
        else:
            shutil.rmtree(os.path.join(self.root, name), ignore_errors=True)


def root() -> str:
    """$POSTSIEVE_HOME, else the local application data, else ~/.postsieve."""
    local = os.environ.get("LOCALAPPDATA")
    return os.environ.get(HOME) or (os.path.join(local, "postsieve") if local else os.path.expanduser("~/.postsieve"))


def home(*below: str) -> str:
    """A folder below the root, made on first use where it is on this machine."""
    path = "/".join([root().rstrip("/"), *below]) if is_uri(root()) else os.path.join(root(), *below)
    if not is_uri(path):
        os.makedirs(path, exist_ok=True)
    return path


@contextmanager
def at(folder: str) -> Iterator[None]:
    """Another root inside the block."""
    before = os.environ.get(HOME)
    os.environ[HOME] = folder
    try:
        yield
    finally:
        if before is None:
            del os.environ[HOME]
        else:
            os.environ[HOME] = before


def settings() -> dict:
    folder = Folder(home())
    return json.loads(folder.read("config.json")) if folder.exists("config.json") else {}


def save_settings(values: dict) -> None:
    Folder(home()).replace("config.json", json.dumps(values, indent=2))


def location(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,63}", name or "") or name.endswith(UNFINISHED):
        raise InvalidDatasetName(f"invalid dataset name {name!r}: 1-64 letters, digits, '.', '_' or '-', a letter or digit first, not ending in {' or '.join(UNFINISHED)}")
    return f"{home('datasets')}/{name}"


def exists(name: str) -> bool:
    return Folder(location(name)).exists("manifest.json")


def manifest(name: str) -> dict:
    if not exists(name):
        raise DatasetNotFound(f"no dataset named {name!r}")
    return json.loads(Folder(location(name)).read("manifest.json"))


def datasets() -> list[dict]:
    known = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,63}")
    return [manifest(n) for n in Folder(home("datasets")).names() if known.fullmatch(n) and not n.endswith(UNFINISHED) and exists(n)]


def delete(name: str) -> None:
    manifest(name)
    Folder(location(name)).delete()


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(Folder(location(name)).uri(manifest(name)["data"])).where("error is null").drop("error")


def write(name: str, rows: DataFrame, about: dict | None = None, force: bool = False) -> dict:
    """Stores the rows, of which those with an error are counted by it and never read back, and returns the manifest."""
    folder, data = Folder(location(name)), f"data-{uuid.uuid4().hex}"
    before = manifest(name) if exists(name) else None
    if before is not None and not force:
        raise DatasetExists(f"dataset {name!r} already exists; force replaces it")
    try:
        # counted from three columns of what was committed, not from the parse
        rows.write.parquet(folder.uri(data))
        told = rows.sparkSession.read.parquet(folder.uri(data)).groupBy("folder", F.coalesce("label", F.lit("unlabeled")).alias("label"), "error").count().collect()
        labels: dict = {}
        folders: dict = {}
        skipped: dict = {}
        for r in sorted(told, key=lambda r: (str(r["folder"]), r["label"], str(r["error"]))):
            if r["error"] is not None:
                skipped[r["error"]] = skipped.get(r["error"], 0) + r["count"]
                continue
            labels[r["label"]] = labels.get(r["label"], 0) + r["count"]
            folders.setdefault(r["folder"], {})[r["label"]] = r["count"]
        full = (about or {}) | {"name": name, "created": datetime.now(timezone.utc).isoformat(), "count": sum(labels.values()), "labels": labels, "folders": folders, "skipped": skipped, "data": data}
        folder.replace("manifest.json", json.dumps(full, indent=2, ensure_ascii=False))
    except BaseException:
        folder.delete(data)
        raise
    if before is not None:
        folder.delete(before["data"])
    return full


def write_table(report: DataFrame, uri: str, digits: int = 4) -> str:
    """A small report as one CSV file with a header, doubles rounded; the folder's URI."""
    rounded = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes]
    report.select(*rounded).coalesce(1).write.mode("overwrite").option("header", True).csv(uri)
    return uri
