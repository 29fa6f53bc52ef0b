import gzip
import io
import zlib

import pytest

from wardline.llm import warc
from wardline.llm.common import Scratch


def record(k, body, kind="response"):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


BODIES = [b"", b"a", b"x\r\n\r\nWARC/1.1\r\n" * 5, bytes(range(256)) * 9000]


@pytest.mark.parametrize("form", ["whole", "members", "plain"])
def test_rewrite(form):
    plain = [record(k, b) for k, b in enumerate(BODIES)]
    data = {"whole": gzip.compress(b"".join(plain)), "members": b"".join(map(gzip.compress, plain)), "plain": b"".join(plain)}[form]
    out = io.BytesIO()
    index = list(warc.rewrite(io.BytesIO(data), out))
    assert [r["record_id"] for r in index] == [f"<urn:x-page:{k}>" for k in range(4)]
    for row, own in zip(index, plain, strict=True):
        assert zlib.decompress(out.getvalue()[row["offset"]:row["offset"] + row["length"]], 31) == own
    assert gzip.decompress(out.getvalue()) == b"".join(plain)


@pytest.mark.parametrize("cut", [5, 200, -3])
def test_broken_streams_are_refused(cut):
    data = gzip.compress(b"".join(record(k, b) for k, b in enumerate(BODIES)))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.rewrite(io.BytesIO(data[:cut]), io.BytesIO()))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.rewrite(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n"), io.BytesIO()))


def test_round_trip(spark, table):
    copy = "é" * 60
    rows = [(5, "u", copy), (3, "u\r\nX: y", copy), (None, "u", copy), (3, "u", copy), (7, None, "short"), (8, "u", "short"), (9, "u", None), (10, "u", "")]
    rows += [(20, "u", "z" * 300_000), (21, "u", "z" * 300_000)]
    scratch = Scratch(spark, "test-warc")
    warc.write(table(rows, "page_id long, url string, html string").coalesce(1), scratch.path("in"), scratch)
    index = warc.normalise(spark, scratch.path("in"), scratch.path("out"))
    got = warc.read(spark, scratch.path("out"), index).collect()
    name = lambda k: f"<urn:x-page:{'null' if k is None else k}>"
    kinds = sorted((r.record_id, r.type, r.refers_to) for r in got)
    want = [(k, "response", None) for k in (3, 7, 8, 9, 10, 20)] + [(k, "revisit", 3) for k in (3, 5, None)] + [(21, "revisit", 20)]
    assert kinds == sorted(((name(k), t, None if to is None else name(to)) for k, t, to in want), key=lambda x: (x[0], x[1], x[2] or ""))
    by = {(r.record_id, r.type): r for r in got}
    assert bytes(by[name(3), "response"].payload).decode() == copy and by[name(5), "revisit"].http_length == 120
    assert by[name(9), "response"].payload == b"" and len(by[name(20), "response"].payload) == 300_000
    empty = Scratch(spark, "test-warc")
    warc.write(table([], "page_id long, url string, html string"), empty.path("in"), empty)
    assert warc.read(spark, empty.path("out"), warc.normalise(spark, empty.path("in"), empty.path("out"))).collect() == []


def test_small_records_and_bombs():
    """Time is linear in the records, memory in neither their number nor what a piece inflates to."""
    import time
    import tracemalloc

    data = gzip.compress(b"".join(record(k, b"x") for k in range(60_000)))
    start = time.process_time()
    assert sum(1 for _ in warc.rewrite(io.BytesIO(data), io.BytesIO(), level=1)) == 60_000
    assert time.process_time() - start < 6
    bomb = gzip.compress(record(1, bytes(200_000_000)), 9)
    tracemalloc.start()
    try:
        assert [r["record_id"] for r in warc.rewrite(io.BytesIO(bomb), io.BytesIO(), level=1)] == ["<urn:x-page:1>"]
        assert tracemalloc.get_traced_memory()[1] < 20_000_000
    finally:
        tracemalloc.stop()


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_no_archive_is_lost(spark, tmp_path):
    """Names with many full stops, plain files, sub-folders."""
    own = {"host.a.warc.gz": 1, "host.b.warc.gz": 2, "c.warc": 3, "deep/er/host.a.warc.gz": 4, "d.gz": 5}
    for name, k in own.items():
        put(tmp_path / "in", name, record(k, b"p") if name == "c.warc" else gzip.compress(record(k, b"p") + record(-k, b"q")))
    index = warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {(r.file, r.record_id) for r in index.collect()}
    kept = {n: n.removesuffix(".gz").removesuffix(".warc") + ".warc.gz" for n in own}
    assert got == {(kept[n], f"<urn:x-page:{i}>") for n, k in own.items() for i in ((k,) if n == "c.warc" else (k, -k))}
    found = warc.read(spark, str(tmp_path / "out"), index)
    assert sorted(r.record_id for r in found.collect()) == sorted(i for _, i in got)
    put(tmp_path / "in", "c.warc.gz", gzip.compress(record(9, b"p")))
    with pytest.raises(ValueError, match="two archives would be c.warc.gz"):
        warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "other"))


def test_reading_is_dealt_by_bytes(spark, table, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 1000)
    scratch = Scratch(spark, "test-warc")
    rows = [(k, "u", f"{k} page " * 20) for k in range(100)]
    warc.write(table(rows, "page_id long, url string, html string"), scratch.path("in"), scratch)
    index = warc.normalise(spark, scratch.path("in"), scratch.path("out"))
    found = warc.read(spark, scratch.path("out"), index)
    assert found.rdd.getNumPartitions() > 10 and found.count() == 100
