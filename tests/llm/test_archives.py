"""ZIP directories and web archives."""

import hashlib
import io
import random
import struct
import zipfile

import duckdb
import pytest

from spendscope.llm.warc_zip import SQL, archive_pages, parse_record, warc_record
from spendscope.llm.zip_reader import STORED, members


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, nbytes, offset):
        return self.data[offset : offset + nbytes]


def zipped(force64=False, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("a.txt", b"first"), ("dir/b.bin", bytes(range(256)))):
            with z.open(name, "w", force_zip64=force64) as f:
                f.write(data)
        z.writestr("c.txt", b"packed" * 50, zipfile.ZIP_DEFLATED)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("force64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"note PK\5\6 in it"])
def test_members_are_found(force64, comment):
    file = Bytes(zipped(force64, comment))
    found = {m.name: m for m in members(file)}
    assert [found[n].method == STORED for n in ("a.txt", "dir/b.bin", "c.txt")] == [True, True, False]
    for name, data in (("a.txt", b"first"), ("dir/b.bin", bytes(range(256)))):
        assert file.read_at(found[name].size, found[name].start(file)) == data


def test_zip64_end_record():
    """Directory place and number of entries stand only in the ZIP64 records."""
    data = zipped()
    k = data.rfind(b"PK\5\6")
    entries, length, offset = struct.unpack("<HII", data[k + 10 : k + 20])
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, entries, entries, length, offset)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, k, 1)
    end = b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert [m.name for m in members(Bytes(data[:k] + end64 + locator + end))] == ["a.txt", "dir/b.bin", "c.txt"]


def test_zip64_entry_fields():
    """Sizes and place of a member stand only in its extra field."""
    data = bytearray(zipped())
    k = bytes(data).rfind(b"PK\5\6")
    _, length, offset = struct.unpack("<HII", data[k + 10 : k + 20])
    entry = bytearray(data[offset : offset + 46 + 5])
    size, header = struct.unpack("<I", entry[24:28])[0], struct.unpack("<I", entry[42:46])[0]
    entry[20:28], entry[42:46] = b"\xff" * 8, b"\xff" * 4
    extra = struct.pack("<HHI", 0x7777, 4, 1) + struct.pack("<HHQQQ", 1, 24, size, size, header)
    entry[30:32] = struct.pack("<H", len(extra))
    directory = bytes(entry) + extra
    end = b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(directory), offset, 0)
    file = Bytes(bytes(data[:offset]) + directory + end)
    (member,) = members(file)
    assert file.read_at(member.size, member.start(file)) == b"first"


def test_broken_files():
    for data in (b"", b"nothing", zipped()[:-30]):
        with pytest.raises(ValueError):
            list(members(Bytes(data)))


def test_record_round_trip():
    payload = "<p>é\r\n\r\nWARC/1.1</p>".encode()
    read = parse_record(warc_record(5, "http://x/a b\r\n", payload, None, False))
    assert read["payload"] == payload and read["warc"]["warc-target-uri"] == "http://x/a%20b%0D%0A"
    read = parse_record(warc_record(6, None, payload, 5, True))
    assert read["payload"] == b"" and read["http"]["content-length"] == str(len(payload))
    assert read["warc"]["warc-refers-to"] == "<urn:page:5>"


def test_pages_come_back(spark, tmp_path):
    rng = random.Random(1)
    big = ["é" * 50, "b" * 100, "c" * 99, "", None]
    rows = [(i, f"http://h/{i}", rng.choice(big), 1) for i in range(60)] + [(200, "u", "d" * 3000, 1), (200, "u", "d" * 3000, 1), (201, None, "d" * 3000, 1)]
    pages = spark.createDataFrame([*rows], "page_id long, url string, html string, digest int").repartition(5)
    # archives of one record or two each
    found = archive_pages(pages, f"file://{tmp_path}", payloads=True, archive_bytes=200).toPandas()
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL})").df()
    as_rows = lambda f: sorted(tuple(None if v != v else v for v in r) for r in f[columns].astype(object).itertuples(index=False))
    assert [r[:5] for r in as_rows(found.fillna({"refers_to": -1, "url": ""}))] == [r[:5] for r in as_rows(expected.fillna({"refers_to": -1, "url": ""}))]
    assert (found["record_type"] == "revisit").sum() > 20
    for row in found.itertuples():
        if row.record_type == "response":
            assert hashlib.sha256(row.payload).hexdigest() == row.payload_digest and len(row.payload) == row.payload_bytes


def test_rows_without_id_and_empty_tables(spark, tmp_path):
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame([(None, None, "z" * 200), (3, "u", "z" * 200), (4, "u", "z" * 200)], schema)
    found = {(r["page_id"], r["record_type"], r["refers_to"]) for r in archive_pages(pages, str(tmp_path)).collect()}
    assert found == {(None, "response", None), (3, "response", None), (4, "revisit", 3)}
    assert archive_pages(spark.createDataFrame([], schema), str(tmp_path)).count() == 0
