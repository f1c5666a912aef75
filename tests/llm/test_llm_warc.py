import base64
import gzip
import hashlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillbook.llm import warc
from tillbook.llm.warc import packed, page_records, read, record_bytes, records, round_trip, write

PAGES = "page_id long, url string, html string, record_type string, size long, headers string"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "clash", 1, "clash") for row in rows], PAGES)


def sample():
    return [
        (1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3\r\nX-Page-ID: 9", "other <p>é\U0001f600"), (4, None, None), (5, "http://a/5", ""),
        (6, "http://a/6", "x" * 300_000), (7, "http://b/ü", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (8, "u", "same"),
    ]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least=0):
    keep = {}
    for page_id, _, html in rows:
        keep[html or ""] = max(keep.get(html or "", -1), page_id)
    out = []
    for page_id, _, html in rows:
        size = len((html or "").encode())
        response = size < least or keep[html or ""] == page_id
        out.append((page_id, size, digest(html), "response" if response else "revisit", None if response else keep[html or ""]))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = round_trip(pages(spark, sample()), least).collect()
    assert sorted(map(tuple, rows)) == expected(sample(), least)


def test_payloads_come_back(spark, tmp_path):
    write(page_records(pages(spark, sample())), str(tmp_path / "w 1%"))
    got = {r["headers"]["X-Page-ID"]: r for r in read(spark, str(tmp_path / "w 1%")).collect()}
    for page_id, url, html in sample():
        row = got[str(page_id)]
        if row["record_type"] == "response":
            assert bytes(row["payload"]) == (html or "").encode()
        else:
            assert row["payload"] is None
        assert row["payload_length"] == len((html or "").encode())
    assert got["4"]["target_uri"] is None and got["7"]["target_uri"] == "http://b/ü"


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "u", "p"), (1, "u", "p"), (1, "u", "p"), (None, None, None), (None, None, "q")]
    found = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in round_trip(pages(spark, rows)).collect())
    assert found == [(-1, "response", None), (-1, "response", None), (-1, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert round_trip(pages(spark, [])).count() == 0


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    path = str(tmp_path / "w")
    write(page_records(pages(spark, sample())), path)
    rows = read(spark, path, payload=False)
    chosen = rows.where(F.col("record_type").isin("revisit") & F.col("target_uri").startswith("http://a/"))
    assert sorted(r["headers"]["X-Page-ID"] for r in chosen.collect()) == ["1", "2"]
    assert " Filter " not in chosen._jdf.queryExecution().executedPlan().toString()
    by_header = read(spark, path, headers={"X-Page-ID": "8", "warc-type": "response"})
    assert [(r["target_uri"], bytes(r["payload"])) for r in by_header.collect()] == [("u", b"same")]
    assert rows.where("payload IS NOT NULL").count() == 0
    assert rows.where("target_uri LIKE 'http://a/%'").count() == 5


def rows_of(data, wanted=lambda h: True, payload=True):
    return list(records(pa.BufferReader(data), wanted, payload))


def made(n, payload=b"hello\r\n\r\nworld"):
    row = dict(record_type="response", record_id=f"<urn:page:{n}>", target_uri="u", refers_to=None, payload_digest=None, payload_length=None, headers=[], payload=payload)
    return record_bytes(row, "2020-01-01T00:00:00Z")


@pytest.mark.parametrize("pack", [packed, gzip.compress, bytes])
def test_own_and_foreign_files(pack):
    data = b"".join(pack(made(n, bytes([65 + n]) * (n * 5000))) for n in range(6))
    found = rows_of(data)
    assert [h["WARC-Record-ID"] for h, _, _ in found] == [f"<urn:page:{n}>" for n in range(6)]
    assert [p for _, _, p in found] == [bytes([65 + n]) * (n * 5000) for n in range(6)]
    third = rows_of(data, lambda h: h["WARC-Record-ID"] == "<urn:page:3>")
    assert [n for _, n, _ in third] == [15_000]
    assert [p for _, _, p in rows_of(data, payload=False)] == [None] * 6


def test_skipping_inflates_heads_only(monkeypatch):
    data = b"".join(packed(made(n, hashlib.sha512(bytes([n])).digest() * 1 + bytes(5_000_000))) for n in range(4))
    inflated = 0
    plain = warc._Inflated.more

    def more(self, raw=None):
        nonlocal inflated
        result = plain(self, raw)
        inflated = max(inflated, len(self.data))
        return result

    monkeypatch.setattr(warc._Inflated, "more", more)
    monkeypatch.setattr(warc._Inflated, "unused", lambda self: pytest.fail("inflated to its end"))
    assert len(rows_of(data, lambda h: False)) == 0
    assert 0 < inflated


def test_a_member_is_plain_gzip():
    assert gzip.GzipFile(fileobj=io.BytesIO(packed(made(1)))).read() == made(1)


def test_a_broken_file_is_reported(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc").write_bytes(b"nonsense")
    with pytest.raises(Exception, match="no WARC record"):
        read(spark, str(tmp_path / "w")).collect()


def test_a_payload_that_a_third_of_the_pages_share(spark):
    rows = [(i, f"u{i}", "" if i % 3 == 0 else f"body {i}") for i in range(3000)]
    before = {name: spark.conf.get(name, None) for name in NARROW}
    for name, value in NARROW.items():
        spark.conf.set(name, value)
    try:
        frame = page_records(pages(spark, rows))
        sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 600  # a thousand pages have the empty payload
        assert sorted(map(tuple, round_trip(pages(spark, rows)).collect())) == expected(rows)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


NARROW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "12k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}
