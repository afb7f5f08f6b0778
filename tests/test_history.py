"""Segments, manifest and tiers; the batch job's pieces, progress and paid calls."""

import os
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import pages as P
from ledgerlake.plans import invoice_job as J
from ledgerlake.sinks.history import Conflict, History, Table
from ledgerlake.sources import files as S

STORE = {"seen": Table("sha string, v int", ("sha",), "sha")}


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "sha string, v int")


def test_tiers_keep_folders_few_and_rows_whole(spark, tmp_path):
    h = History(spark, str(tmp_path), STORE)
    assert h.read("seen").count() == 0
    for k in range(7):
        h.commit(add={"seen": [h.write("seen", rows(spark, [(f"{k % 3:x}a", k % 3), (f"{k:x}b", k)]))], "plain": [h.write("plain", rows(spark, [("x", k)]))]})
        h.compact(fan=2, keep_seconds=0)
    live = h.manifest()["tables"]
    assert sorted(s["level"] for s in live["seen"]) == [0, 1, 2]  # seven runs in binary
    assert h.read("plain").count() == 7
    got = Counter(map(tuple, h.read("seen").collect()))
    assert set(got) == {(f"{k % 3:x}a", k % 3) for k in range(7)} | {(f"{k:x}b", k) for k in range(7)}
    assert max(got.values()) <= 3  # repeated keys are merged within a segment
    assert {r.sha for r in h.read("seen", prefixes=["1", "2"]).collect()} == {"1a", "1b", "2a", "2b"}
    h.compact(fan=2, keep_seconds=0)
    assert sorted(h.folders("seen")) == sorted(os.path.basename(s["dir"]) for s in live["seen"])
    assert len(os.listdir(tmp_path / "_manifest")) < 100


def test_concurrent_commits_are_all_kept(spark, tmp_path):
    h = History(spark, str(tmp_path), STORE)

    def add(k):
        History(spark, str(tmp_path), STORE).commit(add={"seen": [{"dir": f"seen/seg={k}", "level": 0}]})

    threads = [threading.Thread(target=add, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    m = h.manifest()
    assert m["version"] == 6 and sorted(s["dir"] for s in m["tables"]["seen"]) == [f"seen/seg={k}" for k in range(6)]
    with pytest.raises(Conflict):
        h.commit(drop={"seen": [{"dir": "seen/seg=gone", "level": 0}]})
    assert h.manifest() == m


def test_damaged_manifest_is_an_error(spark, tmp_path):
    h = History(spark, str(tmp_path), STORE)
    h.commit(progress={"r": {"pieces": [1, 2]}})
    name = max(n for n in os.listdir(tmp_path / "_manifest") if n.endswith(".json"))
    with open(tmp_path / "_manifest" / name, "a") as f:
        f.write("x")
    crc = tmp_path / "_manifest" / f".{name}.crc"
    if crc.exists():
        os.remove(crc)
    with pytest.raises(RuntimeError, match="damaged"):
        h.manifest()


def test_files_are_read_by_path(spark, tmp_path):
    for name in ("a[1].pdf", "b*.pdf", "c{x,y}.pdf", "d e.pdf", "other.pdf"):
        (tmp_path / name).write_bytes(name.encode())
    paths = [r.path for r in S.scan_files(spark, str(tmp_path)).select("path").collect() if "other" not in r.path]
    got = S.read_files(spark, paths)
    assert sorted(bytes(r.content) for r in got.collect()) == [b"a[1].pdf", b"b*.pdf", b"c{x,y}.pdf", b"d e.pdf"]
    assert sorted(r.path for r in got.select("path").collect()) == sorted(paths)


def test_paid_calls_are_published_in_pieces(spark, tmp_path, monkeypatch):
    """The client fails midway; the next run repeats the calls of one piece at most, and progress grows."""
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    os.makedirs(src), os.makedirs(log)
    for k in range(12):
        with open(os.path.join(src, f"{k}.pdf"), "wb") as f:
            f.write(b"no page" if k == 5 else b"text %d" % k)

    def decoder():
        return lambda content, kind, dpi: iter([] if content == b"no page" else [content.decode()])

    def client_factory(limit):
        def factory():
            def call(prompt):
                import uuid
                if len(os.listdir(log)) >= limit:
                    raise RuntimeError("quota used up")
                with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                    f.write(prompt)
                return "{\"notes\": \"seen\"}"
            return call
        return factory

    noted = []
    commit = History.commit

    def noting(self, *a, progress=None, **k):
        noted.extend(dict(p) for p in (progress or {}).values())
        return commit(self, *a, progress=progress, **k)

    monkeypatch.setattr(History, "commit", noting)
    o = J.JobOptions(partitions=2, piece_contents=3, on_error="fail", prompt_style="plain")
    args = (spark, src, out, decoder, P.identity_recogniser)
    with pytest.raises(Exception, match="quota"):
        J.run_invoice_job(*args, client_factory(7), options=o)
    assert J.published_runs(spark, out) == []
    stored = J.history(spark, out).read("responses").count()
    assert 1 <= stored <= 7
    first = list(noted)
    assert [p["calls"] for p in first] == sorted(p["calls"] for p in first) and first[-1]["pages"] >= stored - 1
    assert list(J.read_progress(spark, out).values())[-1]["calls"] == stored
    pieces = Counter(p["pieces"][0] for p in first)
    assert pieces[0] and max(pieces) < 4
    paid = len(os.listdir(log))
    done = J.run_invoice_job(*args, client_factory(1000), options=o)
    assert len(os.listdir(log)) - paid == 12 - stored  # nothing stored is paid for again
    assert done["summary"]["records"] == {("ok", True): 12}
    last = J.read_progress(spark, out)[done["run"]]
    assert last["pieces"][0] == last["pieces"][1] >= 2 and last["calls"] == 12 - stored
    metrics = {os.path.basename(r.path): r for r in J.read_published(spark, out, "file_metrics").collect()}
    assert metrics["5.pdf"].pages == 0 and metrics["5.pdf"].file_type == "PDF" and metrics["4.pdf"].pages == 1
    # the file without pages is done, as all others
    assert J.read_published(spark, out, "file_index").count() == 12 and J.read_published(spark, out, "failures").count() == 0
