import base64
import hashlib

import pyarrow.fs as pafs
import zstandard
from pyspark.sql import functions as F

from histomesh.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def expected(rows):
    heads = {}
    for page_id, _, html, _ in rows:
        key = html or ""
        heads[key] = max(heads.get(key, -1), -1 if page_id is None else page_id)
    out = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        head = heads[html or ""]
        same = head == (-1 if page_id is None else page_id)
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else head))
    return sorted(out, key=repr)


def run(spark, rows, **sizes):
    frames, folder = warc.archive(spark.createDataFrame(rows, PAGES), **sizes)
    return frames, folder, warc.read_bundles(frames, folder)


def test_round_trip_with_nulls_ties_and_repeats(spark):
    rows = [(1, "http://a/ü\r\nX: y", "é<p>", "x"), (2, None, "é<p>", "x"), (3, "u", None, None), (4, "u", "", None),
            (5, "u", "long " * 400_000, None), (6, "u", "one\r\n\r\nWARC/1.1", None), (6, "u", "one\r\n\r\nWARC/1.1", None), (None, "u", "alone", None)]
    frames, folder, back = run(spark, rows, frame_bytes=1000)
    got = sorted([tuple(r)[:5] for r in back.collect()], key=repr)
    assert got == expected(rows)


def test_frames_stand_alone_and_index_finds_a_record(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 50, None) for i in range(200)]
    frames, folder, _ = run(spark, rows, frame_bytes=2000)
    index = warc.record_index(frames)
    one = index.filter("record_id = 77").first()
    fs, base = warc._filesystem(folder)
    with fs.open_input_file(f"{base}/{one.bundle}") as f:
        start, packed, plain = warc.read_seek_table(f)[one.frame]
        f.seek(start)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
    fields, block = warc.parse_record(data[one.offset : one.offset + one.length])
    assert fields["WARC-Record-ID"] == "<urn:page:77>" and block.endswith(b"page 77 " * 50)
    lookup = frames.join(index.filter("record_id = 77").select("bundle", "frame"), ["bundle", "frame"])
    assert 77 in [r.page_id for r in warc.read_bundles(lookup, folder).collect()]
    # a plain Zstandard reader skips the seek table
    name = [i.path for i in fs.get_file_info(pafs.FileSelector(base))][0]
    with fs.open_input_file(name) as f:
        text = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
    assert text.startswith(b"WARC/1.1")


def test_bundles_roll_and_min_bytes(spark):
    rows = [(i, "u", "x" * 9 if i % 2 else f"{hashlib.sha256(str(i).encode()).hexdigest() * 20}", None) for i in range(100)]
    frames, folder, back = run(spark, rows, frame_bytes=1500, bundle_bytes=300, min_bytes=10)
    assert frames.select("bundle").distinct().count() > 8
    assert back.filter("record_type = 'revisit'").count() == 0 and back.count() == 100


def test_empty_table(spark):
    frames, folder, back = run(spark, [])
    assert back.count() == 0 and warc.record_index(frames).count() == 0


def test_base32_matches_the_standard(spark):
    got = spark.createDataFrame([("",), ("abc",)], "t string").select(warc.base32_sha1(F.encode("t", "UTF-8"))).collect()
    assert [r[0] for r in got] == [base64.b32encode(hashlib.sha1(t).digest()).decode() for t in (b"", b"abc")]
