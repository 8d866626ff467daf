import io
import struct

import pytest
import zstandard

from deeptime.llm import warc


def rows(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, kind int")


def test_round_trip(spark):
    big = "é" * 600
    data = [(1, "http://a/x y", big, 1), (2, None, big, 2), (9, "http://b/\r\nX: 1", big, 3), (3, "http://c/", None, 4), (4, "u", "", 5), (5, "u", "small", 6), (6, "u", "small", 7), (None, "u", big, 8), (7, "u", "long " * 100_000, 9)]
    got = {r.page_id: r for r in warc.read_archives(warc.archive_pages(rows(spark, data).repartition(3))).collect()}
    assert len(got) == len(data)
    for page_id, _, html, _ in data:
        r = got[page_id]
        assert r.payload_bytes == len((html or "").encode())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if page_id in (1, 2, None) else ("response", None))
        assert r.html == (None if r.record_type == "revisit" else html or "")


def test_empty_table(spark):
    assert warc.read_archives(warc.archive_pages(rows(spark, []))).count() == 0


def archive(records, dictionary=b"", magic=warc.DICTIONARY_MAGIC):
    packer = zstandard.ZstdCompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    return struct.pack("<II", magic, len(dictionary)) + dictionary + b"".join(map(packer.compress, records))


def record(**change):
    args = {"page_id": 1, "url": "u", "payload": b"abc", "digest": "a9993e364706816aba3e25717850c26c9cd0d89d", "kind": "response", "refers_to": None} | change
    return warc.build_record(**args)


def read(data, step=1 << 20):
    return [warc.parse_record(x) for x in warc.read_frames(io.BytesIO(data), step)]


def test_frames_across_short_reads():
    samples = [b"WARC/1.1 page %d " % i * 50 for i in range(300)]
    dictionary = zstandard.train_dictionary(4096, samples).as_bytes()
    for step in (1, 7, 1 << 20):
        assert [r["page_id"] for r in read(archive([record(page_id=k) for k in range(5)], dictionary), step)] == list(range(5))


@pytest.mark.parametrize(
    "data",
    [
        b"",
        archive([record()], magic=0x184D2A50),
        archive([record()])[:-3],
        archive([record()]) + b"junk",
        archive([record().replace(b"WARC/1.1", b"WARC/9")]),
        archive([record()[:-1]]),
        archive([record().replace(b"Content-Length: 3", b"Content-Length: 4")]),
        archive([record(payload=b"abd")]),
        archive([record(kind="metadata")]),
        archive([record().replace(b"WARC-Type: response\r\n", b"")]),
    ],
)
def test_damage_is_refused(data):
    with pytest.raises(warc.WarcError):
        read(data)
