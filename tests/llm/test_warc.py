"""WARC archives: round trips, reruns byte for byte, and what a reader of the format expects."""

import base64
import gzip
import hashlib
import os
import random

import pytest

from valueflow.llm import warc

SCHEMA = "page_id long, url string, html string, copy string"


def made():
    rng = random.Random(7)
    rows = [(i, f"http://h{i % 7}.example/{i}?q=a b\r\né", "".join(rng.choices("abc <p>é\r\n", k=rng.randrange(900))), "x") for i in range(300)]
    rows += [(1000 + i, "http://hot.example/", "the same page", "x") for i in range(150)]
    rows += [(None, None, None, "x")] * 40 + [(None, "http://u/", f"page {i}", "x") for i in range(30)]
    rows += [rows[3], rows[3], (5000, None, ""), (-5, "", "the same page"), (-5, "", "the same page")]
    return [r if len(r) == 4 else (*r, None) for r in rows]


def plain(rows, least=0):
    out, seen = [], {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        payload = (r[2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = len(payload) < least or payload not in seen
        out.append((r[0], r[1], len(payload), digest, "response" if first else "revisit", None if first else seen[payload]))
        seen.setdefault(payload, r[0])
    return sorted(out, key=repr)


def read(spark, folder):
    return sorted(((None if r["id"] is None else int(r["id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"],
                    None if r["refers_to"] is None else int(r["refers_to"])) for r in warc.read_archives(spark, folder).collect()), key=repr)


@pytest.mark.parametrize("least", [0, 14])
@pytest.mark.parametrize("shard_bytes,file_bytes", [(1 << 30, None), (20_000, 3_000)])
def test_round_trip(spark, least, shard_bytes, file_bytes):
    rows = made()
    folder = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(6), min_bytes=least, shard_bytes=shard_bytes, file_bytes=file_bytes)
    assert read(spark, folder) == plain(rows, least)
    files = warc.manifest(spark, folder).collect()
    assert sum(f["records"] for f in files) == len(rows)
    if file_bytes:
        assert len({f["shard"] for f in files}) > 5 and len(files) > len({f["shard"] for f in files})
        assert all(f["bytes"] < file_bytes + 1500 for f in files)
    texts = {r["url"]: r["payload"] for r in warc.read_archives(spark, folder, with_payload=True).collect() if r["record_type"] == "response"}
    assert texts[rows[10][1]] == rows[10][2].encode()


def test_reruns_are_equal_and_ordered(spark):
    rows = made()
    sums = []
    for n in (2, 7):
        folder = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(n), shard_bytes=20_000)
        sums.append({r["file"]: r["sha256"] for r in warc.manifest(spark, folder).collect()})
        local = folder.removeprefix("file://")
        for name, want in sums[-1].items():
            raw = open(f"{local}/{name}", "rb").read()
            assert hashlib.sha256(raw).hexdigest() == want
        assert not [f for f in os.listdir(f"{local}/_temporary")]
    assert sums[0] == sums[1] and len(sums[0]) > 5
    ids = []
    for name in sorted(sums[0]):
        for part in gzip.open(f"{local}/{name}").read().split(b"WARC/1.1\r\n")[1:]:
            ids += [int(line.split(b'"')[1]) for line in part.split(b"\r\n\r\n")[0].split(b"\r\n") if line.startswith(b"X-Page-ID")]
    assert ids == sorted(ids)


def test_damage_is_found(spark):
    folder = warc.write_archives(spark.createDataFrame([(1, "http://a/", "text" * 50, "")], SCHEMA)).removeprefix("file://")
    name = warc.manifest(spark, folder).first()["file"]
    raw = open(f"{folder}/{name}", "rb").read()
    whole = list(warc.members(iter([raw])))
    assert len(whole) == 2 and warc.parsed(whole[1])[0]["WARC-Type"] == "response"
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(whole[1].replace(b"texttext", b"textTEXT", 1))
    with pytest.raises(ValueError, match="length"):
        warc.parsed(whole[1][:-1])
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.members(iter([raw[:-5]])))
    assert list(warc.members(raw[i : i + 3] for i in range(0, len(raw), 3))) == whole


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.read_archives(spark, warc.write_archives(none)).count() == 0
    texts = spark.createDataFrame([("b\n", "u", "1"), ("a", "u", "1")], "page_id string, url string, html string")
    got = {r["id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, warc.write_archives(texts)).collect()}
    assert got == {"a": ("response", None), "b\n": ("revisit", "a")}


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 16)
    rows = [(9, "u", "p" * 40, "")] * 500
    folder = warc.write_archives(spark.createDataFrame(rows, SCHEMA), shard_bytes=30_000)
    assert read(spark, folder) == plain(rows)
    assert len({r["shard"] for r in warc.manifest(spark, folder).collect()}) > 5
