"""Files that arrive in a folder: one verdict each, refused ones moved, also after a crash in mid-batch."""

import os

import pytest

from factweave.sources.commits import Store
from factweave.streaming import intake

GOOD = b"%PDF-1.4\n<< /Type /Page >>\n%%EOF"
FILES = {"a.pdf": GOOD, "deep/b.pdf": GOOD.replace(b"1.4", b"1.7"), "c.txt": GOOD, "d.pdf": b"PNG", "e.pdf": b"", "f.pdf": GOOD + b"/Encrypt 1 0 R", "g.pdf": b"%PDF-1.4\nno end", "h.pdf": b"%PDF-1.4 " + b"x" * 4000 + b"%%EOF", "deep/c.txt": b"other"}
WANT = {"a.pdf": "ok", "deep/b.pdf": "ok", "c.txt": "BAD_EXTENSION", "d.pdf": "BAD_MAGIC", "e.pdf": "EMPTY", "f.pdf": "ENCRYPTED", "g.pdf": "TRUNCATED", "h.pdf": "TOO_LARGE", "deep/c.txt": "BAD_EXTENSION"}


def put(root, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)


def below(root):
    return {os.path.relpath(f"{d}/{n}", root) for d, _, names in os.walk(root) for n in names if not n.startswith(".")}


def test_restart_in_mid_batch(spark, tmp_path):
    source, away = f"{tmp_path}/in", f"{tmp_path}/away"
    put(source, FILES)
    store = Store(spark, f"file://{tmp_path}/store")
    real, moved = intake.mover(spark, source, away), []

    def dies(path):
        if len(moved) == 2:
            raise RuntimeError("the driver is lost")
        moved.append(path)
        real(path)

    args = (spark, source, store, f"{tmp_path}/checkpoint", away)
    with pytest.raises(Exception, match="the driver is lost"):
        intake.watch(*args, files_per_batch=4, max_bytes=3000, move=dies).awaitTermination()
    assert len(moved) == 2 and len(below(away)) == 2
    intake.watch(*args, files_per_batch=4, max_bytes=3000).awaitTermination()
    put(source, {"late.pdf": GOOD})
    for _ in range(2):
        intake.watch(*args, files_per_batch=4, max_bytes=3000).awaitTermination()
    got = {r.path.split("/in/")[1]: r for r in store.read("verdicts").collect()}
    assert store.read("verdicts").count() == len(got) == len(FILES) + 1
    assert {k: r.verdict for k, r in got.items()} == WANT | {"late.pdf": "ok"}
    assert below(source) == {"a.pdf", "deep/b.pdf", "late.pdf"}
    assert below(away) == {f"quarantine/{k}" for k, v in WANT.items() if v != "ok"}
    assert (got["deep/b.pdf"].pdf_version, got["a.pdf"].pages, got["d.pdf"].checksum) == ("1.7", 1, None)
    logged = store.read("events").groupBy("document_id").count().collect()
    assert sorted(r["count"] for r in logged) == [1] * 7 + [5] * 3


def test_a_lost_writer_leaves_no_verdict(spark, tmp_path, monkeypatch):
    """Killed after staging and before the manifest: the batch is judged again, once."""
    source = f"{tmp_path}/in"
    put(source, FILES)
    store = Store(spark, f"file://{tmp_path}/store")
    args = (spark, source, store, f"{tmp_path}/checkpoint", f"{tmp_path}/away")
    os.remove(f"{source}/e.pdf")  # files of no byte are judged before the stream begins
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("no manifest")))
        with pytest.raises(Exception, match="no manifest"):
            intake.watch(*args).awaitTermination()
    assert store.version() == 0 and below(source) == set(FILES) - {"e.pdf"}
    intake.watch(*args).awaitTermination()
    assert store.read("verdicts").count() == len(FILES) - 1 and store.vacuum() >= 2
