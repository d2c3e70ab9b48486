"""Mail written from the driver's documents, for the queries that read sources back.

Files go to a fresh folder below spark.checkpoint.dir, which all executors share.  Each task
writes files of its own under a name of its partition, so a repeated task replaces its own.
"""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tarfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.cuts import shared_root
from . import views as W

#: Subject, and the dates that messages carry by doc_id % 4: with zone, without, too old, none.
SUBJECT = "=?utf-8?q?No_=C3=A9_"
DATES = ["Mon, 01 Jan 2024 10:00:00 +0200", "1 Feb 2024 10:00:00", "Thu, 01 Jan 1970 00:00:00 +0000", "soon"]
HTML = '<div>More<br>at <a href=" https://b.example/x ">b</a><script>var t="</p>";</script></div>'
LABELS = "concat(CASE WHEN doc_id % 3 = 0 THEN 'Inbox, \"Work, home\",' ELSE 'Important,' END, CASE WHEN doc_id % 5 = 0 THEN ' Spam' WHEN doc_id % 7 = 0 THEN 'Sent' ELSE '' END)"


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one, removed at exit."""
    parts = urlsplit(shared_root(spark))
    if parts.scheme not in ("", "file"):
        raise ValueError("mail is read from mounted folders only")
    root = os.path.join(parts.path, f"mail-{uuid.uuid4().hex}")
    os.makedirs(root)
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def _lines(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _head(*more) -> Column:
    id_ = F.col("doc_id").cast("string")
    when = F.element_at(F.array(*map(F.lit, DATES)), (F.col("doc_id") % 4 + 1).cast("int"))
    return _lines("From: A <U", id_, "@Alpha.example>\nReply-To: R@Beta.example\nSubject: ", SUBJECT, id_, "?=\nDate: ", when, "\n", *more)


def plain() -> Column:
    """A message with the text as its body."""
    return _lines(_head("Content-Type: text/plain; charset=utf-8\n\n"), F.col("text")).cast("binary")


def labelled() -> Column:
    """The same with a label header."""
    return _lines(_head("X-Gmail-Labels: ", F.expr(LABELS), "\nContent-Type: text/plain; charset=utf-8\n\n"), F.col("text")).cast("binary")


def mime() -> Column:
    """By doc_id % 6: stored text, base64, plain with HTML and an attachment, HTML alone, none or no mail, an unknown charset."""
    coded = lambda c: F.base64(c.cast("binary"))
    kind = lambda t, charset="utf-8": f"Content-Type: {t}; charset={charset}\nContent-Transfer-Encoding: base64\n\n"
    text = F.col("text")
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mixed = _lines(
        "Content-Type: multipart/mixed; boundary=b\n\n--b\n", kind("text/plain"), coded(text), "\n--b\n", kind("text/html"), coded(F.lit(HTML)),
        "\n--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=R.EXE\n\nx\n--b--\n",
    )
    bodies = {
        0: plain(), 1: _lines(_head(kind("text/plain")), coded(text)).cast("binary"), 2: _lines(_head(), mixed).cast("binary"),
        3: _lines(_head(kind("text/html")), coded(_lines("<p>", escaped))).cast("binary"),
        4: F.when(F.col("doc_id") % 12 == 10, F.lit(" \n").cast("binary")).otherwise(F.lit("%PDF-1.4 nothing").cast("binary")),
        5: _lines(_head(kind("text/plain", "x-unknown")), coded(text)).cast("binary"),
    }
    out = F.lit(None).cast("binary")
    for k, body in bodies.items():
        out = F.when(F.col("doc_id") % 6 == k, body).otherwise(out)
    return out


def documents(spark: SparkSession, sf_dir: str, raw: Column) -> DataFrame:
    """doc_id, folder (of W.FOLDERS, in turn) and raw."""
    at = F.element_at(F.array(*map(F.lit, W.FOLDERS)), (F.col("doc_id") % len(W.FOLDERS) + 1).cast("int"))
    return W.table(spark, sf_dir, "documents").select("doc_id", at.alias("folder"), raw.alias("raw"))


def _write(rows: DataFrame, put) -> list[str]:
    """The paths that put(partition, frames) gives; as many as it has files, so few."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"path": put(TaskContext.get().partitionId(), frames)}, dtype=object)

    return sorted(r["path"] for r in rows.mapInPandas(run, "path string").collect())


def boxed(root: str, part: int, frames: Iterator[pd.DataFrame]) -> list[str]:
    """Writes p<part>/<folder> for each folder of (folder, raw): whole files that take their places at the end, so tries that run at once don't mix."""
    files, own = {}, os.path.join(f"{root}.tries", f"{part}-{uuid.uuid4().hex}")
    with ExitStack() as stack:
        for f in frames:
            for name, raw in zip(f["folder"], f["raw"], strict=True):
                if name not in files:
                    path = os.path.join(own, name)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    files[name] = stack.enter_context(open(path, "wb"))
                files[name].write(b"From x\n" + re.sub(rb"(?m)^From ", b">From ", raw) + b"\n\n")
    for name in files:
        path = os.path.join(root, f"p{part}", name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        os.replace(os.path.join(own, name), path)
    return []


def boxes(rows: DataFrame, root: str) -> str:
    """An mbox tree of (folder, raw): p<partition>/<folder>."""
    atexit.register(shutil.rmtree, f"{root}.tries", ignore_errors=True)
    _write(rows, lambda part, frames: boxed(root, part, frames))
    return root


def emls(rows: DataFrame, root: str) -> str:
    """One file a row: <folder>/<doc_id>.eml, folders below the first kept."""

    def put(_, frames):
        for f in frames:
            for name, key, raw in zip(f["folder"], f["doc_id"], f["raw"], strict=True):
                os.makedirs(os.path.join(root, name), exist_ok=True)
                with open(os.path.join(root, name, f"{key}.eml"), "wb") as out:
                    out.write(raw)
        return []

    _write(rows, put)
    return root


def tars(rows: DataFrame, root: str) -> list[str]:
    """One archive a partition of (member, raw), each with members that readers skip."""

    def put(part, frames):
        path = os.path.join(root, f"{part}.tar.gz")
        with tarfile.open(path, "w:gz", compresslevel=1) as tar:

            def add(name, raw):
                m = tarfile.TarInfo(name)
                m.size = len(raw)
                tar.addfile(m, io.BytesIO(raw))

            for name in ("top", "c/other/cmds"):
                add(name, b"mv 1 2")
            for f in frames:
                for name, raw in zip(f["member"], f["raw"], strict=True):
                    add(name, raw)
        return [path]

    return _write(rows, put)
