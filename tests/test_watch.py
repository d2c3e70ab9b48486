"""Watched folders: each message once, across growth, new files, unfinished messages and restarts."""

import os
import time

import pytest

from postsieve.streaming import watch as W


def message(i):
    return f"From x\nFrom: a@b.example\nSubject: s{i}\n\nbody {i}\n".encode()


def add(path, raw):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab") as f:
        f.write(raw)


def test_finished(tmp_path, monkeypatch):
    box = tmp_path / "box"
    for tail in (1 << 16, 7):
        monkeypatch.setattr(W, "TAIL", tail)
        box.write_bytes(b"")
        assert W.finished(str(box)) == 0
        box.write_bytes(message(1))
        assert W.finished(str(box)) == 0
        box.write_bytes(message(1) + b"\n")
        whole = len(message(1)) + 1
        assert W.finished(str(box)) == whole
        box.write_bytes(message(1) + b"\n" + message(2) + b"more")
        assert W.finished(str(box)) == whole
        box.write_bytes(message(1) + b"\n" + message(2) + b"\n")
        assert W.finished(str(box)) == os.path.getsize(box)


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_mbox_folder(spark, tmp_path, most):
    root, got = tmp_path / "mail", []

    def start():
        stream = W.watch(spark, str(root), "mine", max_bytes=most)
        return stream.writeStream.foreachBatch(lambda df, n: got.extend((n, r.folder, bytes(r.raw)) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="50 milliseconds").start()

    def wait(q, n):
        until = time.time() + 60
        while len(got) < n and time.time() < until and q.exception() is None:
            time.sleep(0.1)
        q.processAllAvailable()

    add(root / "Inbox", message(0) + b"\n" + message(1) + b"\n")
    q = start()
    wait(q, 2)
    add(root / "Inbox", message(2)[:20])
    q.processAllAvailable()
    assert len(got) == 2
    add(root / "Inbox", message(2)[20:] + b"\n")
    add(root / "Junk", message(3) + b"\n")
    wait(q, 4)
    q.stop()
    # what comes while nothing runs is found after the restart, what was read is not read again
    add(root / "Inbox", message(4) + b"\n" + message(5) + b"\n")
    add(root / "Archive.mbox", message(6) + b"\n")
    q = start()
    wait(q, 7)
    add(root / "Junk", message(7) + b"\n")
    wait(q, 8)
    add(root / "Junk", message(8) + b"\n" + message(9) + b"\n")
    wait(q, 10)
    q.stop()
    assert q.exception() is None
    want = [("Inbox", 0), ("Inbox", 1), ("Inbox", 2), ("Junk", 3), ("Inbox", 4), ("Inbox", 5), ("Archive", 6), ("Junk", 7), ("Junk", 8), ("Junk", 9)]
    assert sorted((f, raw) for _, f, raw in got) == sorted((f, message(i).split(b"\n", 1)[1]) for f, i in want)
    if most == 40:
        assert got[-1][0] != got[-2][0], "a small bound parts messages that come together"


def test_eml_folder(spark, tmp_path):
    root, got = tmp_path / "mail", []
    for i in range(3):
        add(root / "spam" / f"{i}.eml", b"Subject: s%d\n\nx\n" % i)
    q = W.watch(spark, str(root), "e", "eml").writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="50 milliseconds").start()
    q.processAllAvailable()
    add(root / "9.eml", b"Subject: s9\n\nx\n")
    until = time.time() + 30
    while len(got) < 4 and time.time() < until:
        time.sleep(0.1)
    q.stop()
    assert sorted((r.folder, bytes(r.raw)[:11]) for r in got) == [(".", b"Subject: s9"), *[("spam", b"Subject: s%d" % i) for i in range(3)]]
