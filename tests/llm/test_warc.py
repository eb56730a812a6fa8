import io

import zstandard

from pagegauge.llm import warc
from pagegauge.llm.common import scratch


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, sha string, payload string").repartition(3)


ROWS = [
    (1, "http://a.example/", "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"), (3, "http://c.example/", "<p>own é</p>"), (4, None, None),
    (5, "http://d.example/", ""), (9, "http://bad.example/\r\nX: y", "<p>same</p>"), (None, "http://n.example/", "<p>own é</p>"),
    (None, "http://n.example/", "<p>nobody</p>"), (12, "http://t.example/", "<b>twice</b>"), (12, "http://t.example/", "<b>twice</b>"),
    (13, "http://l.example/", "x" * 3_000_000),
]


def test_round_trip(spark):
    got = sorted((r.page_id is None, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, ROWS)).collect())
    last = {}
    for i, _, h in ROWS:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    want = []
    for i, _, h in ROWS:
        body = (h or "").encode()
        target = last.get(h or "")
        first = target is None or i == target
        want.append((i is None, i, len(body), warc.digest(body), "response" if first else "revisit", None if first else target))
    assert got == sorted(want)
    assert warc.round_trip(pages(spark, ROWS).limit(0)).count() == 0


def test_archives(spark):
    folder = scratch(spark, "warc")
    index = warc.write(pages(spark, ROWS), folder)
    assert index.count() == len(ROWS)
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder)
    files = fs.get_file_info(pafs.FileSelector(root))
    assert files and not [f for f in files if f.base_name.startswith(".")]
    for info in files:
        with fs.open_input_file(info.path) as file:
            frames = warc.read_seek_table(file)
            whole = file.read_at(info.size, 0)
        # Any Zstandard reader gets the same bytes, skipping the table.
        streamed = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read()
        each = b"".join(zstandard.ZstdDecompressor().decompress(whole[a : a + n]) for a, n in frames)
        assert streamed == each and len(frames) > 1
    # A record by its place in a frame.
    wanted = index.where("page_id = 3")
    (row,) = warc.fetch(wanted, folder).collect()
    assert row.payload == "<p>own é</p>".encode() and row.record_type == "response" and row.target == "http://c.example/"
    bad = warc.fetch(index.where("page_id = 9"), folder).first()
    assert bad.target == "http://bad.example/%0D%0AX:%20y"


def test_damage_is_noticed():
    record = warc.page_record(1, "http://a.example/", b"payload", None)
    ((headers, block),) = warc.parse_records(record)
    assert warc._row(headers, block)[:5] == (1, 7, warc.digest(b"payload"), "response", None)
    try:
        warc._row(headers, block.replace(b"payload", b"pay1oad"))
    except ValueError:
        return
    raise AssertionError("a changed payload was not noticed")
