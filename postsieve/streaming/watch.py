"""A stream of new mail in a folder: messages as they are added to mbox files, or files as they appear in .eml trees.

The offset says for each file how many of its bytes are done, so after a restart each message comes once.  An mbox
message counts when the blank line that closes it, or the next message, is there; a .eml file when it is not
empty (write it elsewhere and move it in).  A batch takes about `max_bytes`, at least one file; the first
batch after a start takes all, as Spark does not tell a source where it stood.  The path is on storage that driver and executors
mount alike.  The offset grows with the number of files, so trees of very many small files are better imported.
"""

from __future__ import annotations

import os
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..sources import mail

MAX_BYTES, TAIL = 256 << 20, 1 << 16


def finished(path: str) -> int:
    """Bytes of an mbox file up to the end of its last finished message."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(max(0, size - 2))
        if f.read(2) == b"\n\n":
            return size
        end, after = size, b""
        while end > 0:
            start = max(0, end - TAIL)
            f.seek(start)
            # a line may begin in one piece and go on in the next
            piece = f.read(end - start) + after
            at = piece.rfind(b"\nFrom ")
            if at >= 0:
                return start + at + 1
            end, after = start, piece[:6]
    return 0


class Watch(DataSource):
    """spark.readStream.format("mail_watch"): options source, kind (mbox, takeout or eml) and max_bytes."""

    @classmethod
    def name(cls):
        return "mail_watch"

    def schema(self):
        return "source string, folder string, seq long, raw binary"

    def streamReader(self, schema):  # noqa: N802
        return _WatchReader(self.options)


class _WatchReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.source = options["path"], options.get("source", "")
        self.kind, self.most = options.get("kind", "mbox"), int(options.get("max_bytes", MAX_BYTES))
        if self.kind not in ("mbox", "takeout", "eml"):
            raise mail.UnsupportedFormat(f"{self.kind!r} cannot be watched: mbox, takeout or eml")
        #: The end of the last batch that was planned; Spark asks for the latest offset more than once a batch.
        self.planned: dict[str, int] | None = None

    def initialOffset(self):  # noqa: N802
        return {"done": {}}

    def _ready(self) -> dict[str, int]:
        if self.kind == "eml":
            return {f: os.path.getsize(f) for f in mail.files_below(self.root) if f.lower().endswith(".eml")}
        return {f: finished(f) for _, f in mail.mbox_files(self.root)}

    def latestOffset(self):  # noqa: N802
        known, left = self.planned, self.most
        # files that are gone keep their place, so they are not read anew if they come back
        now = dict(known or {})
        for path, size in sorted(self._ready().items()):
            begin = now.get(path, 0)
            if size <= begin:
                continue
            if known is not None and left <= 0:
                break
            now[path] = size if known is None or self.kind == "eml" else min(size, begin + max(1, left))
            left -= now[path] - begin
        return {"done": now}

    def partitions(self, start, end):
        before, folders, out, emls = start["done"], {}, [], []
        if self.kind != "eml":
            folders = {f: folder for folder, f in mail.mbox_files(self.root)}
        for path, size in sorted(end["done"].items()):
            begin, number = before.get(path, 0), (zlib.crc32(path.encode()) >> 9) << mail.OFFSET_BITS
            if size <= begin:
                continue
            if self.kind == "eml":
                parts = os.path.relpath(path, self.root).split(os.sep)
                emls.append((path, parts[0] if len(parts) > 1 else ".", number))
            else:
                out += [mail._Mbox(path, folders.get(path, ""), number, k, min(k + mail.TASK_BYTES, size)) for k in range(begin, size, mail.TASK_BYTES)]
        self.planned = end["done"]
        return out + mail.dealt(emls)

    def read(self, part):
        yield from mail.messages_of(part, self.source, self.kind)

    def commit(self, end):
        self.planned = end["done"]


def watch(spark: SparkSession, path: str, source: str, kind: str = "mbox", max_bytes: int = MAX_BYTES) -> DataFrame:
    """source, folder, seq, raw of messages as they come; scoring.score_stream takes it."""
    spark.dataSource.register(Watch)
    return spark.readStream.format("mail_watch").option("source", source).option("kind", kind).option("max_bytes", max_bytes).load(path)
