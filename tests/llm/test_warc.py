"""Archives of pages: written, indexed, read back by ranges; revisits; defined results."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parchmint.llm import warc
from parchmint.llm.common import shared_folder

SCHEMA = "page_id long, url string, html string"
LONG = "<p>" + "é" * 200 + "</p>"


def expected(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        alike = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(alike) if alike and len(data) >= warc.LEAST else page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if first == page_id else "revisit", None if first == page_id else first))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a.b/5", LONG), (3, "http://a.b/3", LONG), (9, None, LONG), (9, None, LONG), (None, "http://n", LONG), (1, "u\r\n\\x: y", "short"), (2, "v", "short"), (4, "w", None), (6, "x", ""),
    (-7, "minus", "<b>" + "z" * 300), (3, "http://a.b/3", LONG), (10, "big", "<i>" + "word " * 500_000), (11, "big too", "<i>" + "word " * 500_000),
]


@pytest.mark.parametrize("broadcast", [warc.BROADCAST, 0])
def test_query_against_plain_python(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST", broadcast)
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in warc.op11_warc(spark, str(tmp_path)).collect()), key=repr)
    assert got == expected(ROWS)


def test_records_come_back_whole_and_some_by_url(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("digest", "d", "salt", "salt2", "payload", "refers_to", "first_id", "offset")})
    index, folder = warc.archived(pages)
    records = {(r.page_id, r.url): r for r in warc.read_records(index, folder).collect()}
    assert records[(1, "u\r\n\\x: y")].payload.decode() == "short" and records[(10, "big")].payload == ("<i>" + "word " * 500_000).encode()
    assert records[(11, "big too")].payload is None and records[(11, "big too")].refers_to == 10
    chosen = warc.select_urls(index, F.col("url") == "http://a.b/5")
    assert sorted(r.page_id for r in warc.read_records(chosen, folder).collect()) == [3, 3, 5]
    assert {r.page_id: r.payload_bytes for r in warc.resolved(warc.read_records(chosen, folder)).collect()} == {3: len(LONG.encode()), 5: len(LONG.encode())}


def test_an_archive_is_a_series_of_members_at_the_offsets_of_the_index(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(200)]
    folder = shared_folder(spark, "warc")
    index = warc.write_archives(warc.classed(spark.createDataFrame(rows, SCHEMA)), folder, archive=2000)
    store, base = warc.opened(f"{folder}/archives")
    by_archive = {}
    for r in index.collect():
        by_archive.setdefault(r.archive, []).append(r)
    assert len(by_archive) > 20
    for name, own in by_archive.items():
        with store.open_input_file(f"{base}/{name}") as f:
            data = f.read()
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            assert warc.parsed(zlib.decompress(data[r.offset : at], 31))["url"] == r.url
        assert at == len(data)


def test_ranges_cover_each_record_once():
    rng = random.Random(1)
    for _ in range(200):
        at, offsets, lengths = 0, [], []
        for _ in range(rng.randrange(30)):
            at += rng.choice([0, 0, 5, 50])
            offsets.append(at)
            lengths.append(rng.randrange(1, 40))
            at += lengths[-1]
        got = warc.ranges(offsets, lengths, gap=10, most=100)
        assert [i for _, _, a, b in got for i in range(a, b)] == list(range(len(offsets)))
        for start, size, a, b in got:
            assert (start, start + size) == (offsets[a], offsets[b - 1] + lengths[b - 1]) and (size <= 100 or b - a == 1)


def test_damage_is_found():
    record = warc.record_bytes(1, "u", "response", None, hashlib.sha256(b"abc").hexdigest(), b"abc")
    assert warc.parsed(record)["payload"] == b"abc"
    for bad in (record.replace(b"abc\r\n", b"abd\r\n"), record[:-1]):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op11_warc(spark, str(tmp_path)).collect() == []
