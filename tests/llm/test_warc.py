import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from curatrix.llm import warc


def pages(spark, n=60):
    rng = random.Random(3)
    body = lambda k: f"<html><head><title>Page</title></head><body>{' '.join(rng.choices(['alpha', 'beta', 'gamma', 'delta'], k=k))}</body></html>"
    same, small = body(400), body(10)
    rows = [(i, f"http://x.example/{i}?q=a bé%20", same if i % 4 == 0 else small if i % 4 == 1 else body(rng.randint(5, 500)), "o", "digest") for i in range(n)]
    rows += [(100, None, None, "o", ""), (101, "", "", "o", ""), (102, "u", "WARC/1.1\r\n\r\n" * 200 + "é", "o", ""), (None, "v", same, "o", ""), (103, "w", same, "o", ""), (103, "w", same, "o", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, digest string")


def expected(rows):
    digest = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[digest(h)] = max(last.get(digest(h), p), p)
    out = []
    for p, u, h in rows:
        size, top = len((h or "").encode()), last.get(digest(h))
        again = size >= 1000 and top is not None and (p is None or p < top)
        out.append((p, u, "revisit" if again else "response", top if again else None, digest(h), size, None if again else (h or "").encode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 5000])
def test_round_trip(spark, archive_bytes):
    df = pages(spark)
    manifest = warc.write_archives(df, archive_bytes=archive_bytes)
    rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.read_archives(spark, manifest).collect()]
    assert sorted(got, key=repr) == expected(rows)


def test_form_of_an_archive(spark):
    manifest = warc.write_archives(pages(spark, 200).coalesce(1))
    path = manifest.orderBy(F.desc("bytes")).first().path
    data = open(path.removeprefix("file://"), "rb").read()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    n = int.from_bytes(data[4:8], "little")
    words = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    # Each record is a frame of its own, which the dictionary opens.
    first = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
    one = first.decompress(data[8 + n :])
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: ") and one.endswith(b"\r\n\r\n") and one.count(b"WARC-Type") == 1
    assert zstandard.get_frame_parameters(data[8 + n :]).dict_id == words.dict_id()
    assert first.unused_data.startswith(b"\x28\xb5\x2f\xfd")


def test_archives_of_few_records_have_a_dictionary_too(spark):
    manifest = warc.write_archives(pages(spark).where("page_id in (100, 2, 3)").coalesce(1), archive_bytes=100)
    paths = [r.path.removeprefix("file://") for r in manifest.collect()]
    assert len(paths) == 3
    for path in paths:
        data = open(path, "rb").read()
        n = int.from_bytes(data[4:8], "little")
        assert int.from_bytes(data[:4], "little") == 0x184D2A5D and 8 < n <= warc.BEGINNING_BYTES
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompressobj().decompress(data[8 + n :])
        assert len(list(warc.read_archive(memoryview(data)))) == 1
    assert warc.read_archives(spark, manifest).count() == 3


def test_unlisted_files_do_not_count_and_damage_is_seen(spark, tmp_path):
    manifest = warc.write_archives(pages(spark))
    n = warc.read_archives(spark, manifest).count()
    path = manifest.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    open(path.replace(".warc.zst", "x.warc.zst"), "wb").write(data)
    assert warc.read_archives(spark, manifest).count() == n
    record = warc.record(1, "u", b"payload", "0" * 40, None, "1970-01-01T00:00:00Z")
    open(path, "wb").write(zstandard.ZstdCompressor().compress(record))
    with pytest.raises(Exception, match="not what was archived"):
        warc.read_archives(spark, manifest).collect()


def test_no_pages(spark):
    manifest = warc.write_archives(pages(spark).where(F.lit(False)))
    assert manifest.count() == 0 and warc.read_archives(spark, manifest).count() == 0
