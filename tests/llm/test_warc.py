"""Archives: exact round trips, the choice of responses against plain Python, and damaged files."""

import base64
import glob
import hashlib
import random
import struct

import pytest
import zstandard
from tradewind.llm import warc
from tradewind.llm.queries import op12_warc


def _pages(spark, rows, path):
    spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(4).write.parquet(f"{path}/pages.parquet")
    return spark.read.parquet(f"{path}/pages.parquet")


def _some(n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefé") for _ in range(6)) for _ in range(300)]
    rows = [(k, f"http://h{k % 9}.org/{k}", f"<html><head><title>t</title></head><body><p>{' '.join(rng.choices(words, k=rng.randint(1, 80)))}</p></body></html>", "x") for k in range(n)]
    copies = [(1000 + k, f"http://copy/{k}", rows[k % 3][2] if k % 4 else None if k % 8 else "", "x") for k in range(n // 2)]
    odd = [(None, None, "same", "x"), (None, "a b\r\nWARC-Type: warcinfo", "same", "x"), (5000, "u", "same", "x"), (5000, "u", "same", "x"), (5001, "v", "long " * 50_000, "x"), (None, "n", "only", "x"), (None, "n", "only", "x"), (5002, "w", "a\r\n\r\nb\x00", "x")]
    return rows + copies + odd


def test_query_is_its_definition(spark, tmp_path):
    rows = _some()
    _pages(spark, rows, tmp_path)
    got = op12_warc(spark, str(tmp_path)).collect()
    payloads = {}
    for i, _, html, _ in rows:
        payloads.setdefault((html or "").encode(), []).append(i)
    want = []
    for payload, ids in payloads.items():
        ids.sort(key=lambda i: (i is not None, i))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want += [(i, len(payload), digest, "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(payload), digest, "response", None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_small_payloads_stay_apart(spark, tmp_path):
    pages = _pages(spark, [(1, "u", "abc", "x"), (2, "u", "abc", "x"), (3, "u", "abcd", "x"), (4, "u", "abcd", "x")], tmp_path)
    warc.write_archives(pages, f"{tmp_path}/out", min_bytes=4)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, f"{tmp_path}/out").collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_payloads_come_back_whole(spark, tmp_path):
    rows = _some()
    index = warc.write_archives(_pages(spark, rows, tmp_path), f"{tmp_path}/out", file_bytes=1 << 14).collect()
    assert len(index) > 8 and sum(r.n_records for r in index) == len(rows)
    back = warc.read_archives(spark, f"{tmp_path}/out", payloads=True).collect()
    assert sorted(r.payload for r in back if r.record_type == "response") == sorted({(html or "").encode() for _, _, html, _ in rows})
    assert {r.url for r in back if r.page_id is None} == {"about:blank", "a%20b%0D%0AWARC-Type:%20warcinfo", "n"}


def test_file_layout(spark, tmp_path):
    """A leading skippable frame with a dictionary, then frames that are read alone at the offsets told."""
    warc.write_archives(_pages(spark, _some(), tmp_path), f"{tmp_path}/out")
    told = warc.read_archives(spark, f"{tmp_path}/out").collect()
    for path in glob.glob(f"{tmp_path}/out/*.warc.zst"):
        data = open(path, "rb").read()
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D
        learnt = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        assert learnt.dict_id() != 0
        for row in told:
            if path.endswith(row.archive):
                assert zstandard.get_frame_parameters(data[row.offset :]).dict_id == learnt.dict_id()
                record = zstandard.ZstdDecompressor(dict_data=learnt).decompressobj().decompress(data[row.offset :])
                assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    plain = zstandard.ZstdCompressor(level=3)
    records = [warc.page_record({"id": i, "file": 0, "row": i, "url": u, "payload": (h or "").encode(), "to_file": None}) for i, u, h, _ in _some(300)[:300]]
    assert len(warc.pack(records, "x")) < sum(len(plain.compress(r)) for r in records)


def test_damage_is_an_error():
    records = [warc.page_record({"id": k, "file": 0, "row": k, "url": "u", "payload": b"payload %d" % k * 20, "to_file": None}) for k in range(50)]
    whole = warc.pack(records, "x")
    assert [r for _, r in warc.unpack(whole)][1:] == records
    with pytest.raises(ValueError):
        list(warc.unpack(whole[:-5]))
    with pytest.raises(ValueError):
        warc.parse(records[0][:-6])
    few = warc.pack(records[:2], "x")
    assert few.startswith(warc.FRAME_MAGIC) and [r for _, r in warc.unpack(few)][1:] == records[:2]


def test_files_of_lost_attempts_go(spark, tmp_path):
    pages = _pages(spark, _some(20), tmp_path)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "pages-00000-999999-0000.warc.zst").write_bytes(warc.pack([], "lost"))
    index = {r.archive for r in warc.write_archives(pages, f"{tmp_path}/out").collect()}
    assert {p.rsplit("/", 1)[-1] for p in glob.glob(f"{tmp_path}/out/*.zst")} == index


def test_empty_table(spark, tmp_path):
    _pages(spark, [], tmp_path)
    got = op12_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and got.count() == 0
