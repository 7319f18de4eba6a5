import base64
import hashlib

import pytest

from plumbline.llm import warc
from plumbline.llm._io import shared_dir

SCHEMA = "page_id long, url string, html string, id string, digest string"


@pytest.mark.parametrize("bits", [8, 64, 1 << 20])
def test_full_filters_lose_nothing(spark, monkeypatch, bits):
    """Filters so small that most rows hit both: still one record per row, each of the right type."""
    monkeypatch.setattr(warc, "FILTER_BITS", bits)
    rows = [(i, f"http://{i}", f"text {i % 70}" if i % 3 else f"own {i}", "x", "y") for i in range(400)] + [(None, "u", "text 1", "x", "y"), (399, "u", "own 399", "x", "y")]
    back = warc.read(spark, warc.write(spark.createDataFrame(rows, SCHEMA), shared_dir(spark, "warc"))).collect()
    top = {}
    for i, _, html, *_ in rows:
        top[html] = max(top.get(html, -1), -1 if i is None else i)
    want = [(i, "response" if i is None or top[h] == i else "revisit", None if i is None or top[h] == i else top[h], h.encode() if i is None or top[h] == i else b"") for i, _, h, *_ in rows]
    assert sorted([(r["page_id"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in back], key=str) == sorted(want, key=str)


def test_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", ((10, 5), (100, 2), (None, 1)))
    pages = spark.createDataFrame([(i, "u", chr(97 + i) * n, "", "") for i, n in enumerate([3] * 12 + [50] * 5 + [400] * 3)], SCHEMA).coalesce(1)
    path = warc.write(pages, shared_dir(spark, "warc"))
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) == 3 + 3 + 3 and warc.read(spark, path).count() == 20


def test_round_trip(spark):
    tricky = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n\r\n\r\n"
    rows = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", tricky), (7, "u", "é" * 70_000), (None, "u", "same"), (8, "u", "other"), (8, "u", "other")]
    path = warc.write(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), shared_dir(spark, "warc"))
    back = warc.read(spark, path)
    got = sorted([tuple(r) for r in back.select("page_id", "record_type", "payload_digest", "payload_bytes", "refers_to").collect()], key=str)
    top = {"same": 3, "": 5, tricky: 6, "é" * 70_000: 7, "other": 8}
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = i is not None and top[html or ""] != i
        want.append((i, "revisit" if revisit else "response", base64.b32encode(hashlib.sha1(raw).digest()).decode(), len(raw), top[html or ""] if revisit else None))
    assert got == sorted(want, key=str)
    full = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.resolve(back).collect()}
    assert full == {(i, h or "") for i, _, h in rows}


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab", "", ""), (2, "u", "ab", "", "")], SCHEMA)
    kinds = warc.read(spark, warc.write(pages, shared_dir(spark, "warc"), min_bytes=3)).select("record_type").distinct().collect()
    assert [r[0] for r in kinds] == ["response"]


def test_empty_and_broken(spark):
    path = warc.write(spark.createDataFrame([], SCHEMA), shared_dir(spark, "warc"))
    assert warc.read(spark, path).collect() == []
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n"))
