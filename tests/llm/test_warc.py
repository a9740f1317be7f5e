import hashlib

from tessera.llm.warc import END, MAGIC, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, size int, block string"


def expected(rows):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        known = [x for x in groups[html or ""] if x is not None]
        keep = max(known) if known else None
        revisit = len(body) >= 1000 and i != keep and keep is not None
        out.append((i, "revisit" if revisit else "response", keep if revisit else None, len(body), hashlib.sha1(body).hexdigest()))
    return sorted(out, key=str)


def round_trip(spark, rows, tmp_path, files=1):
    path = f"file://{tmp_path}/warc"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    write_warc(df.repartition(files) if files else df, path)
    return sorted(map(tuple, read_warc(spark, path).collect()), key=str)


def record(payload):
    block = "HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + payload
    return f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {len(block.encode())}{END}{block}{END}"


def test_round_trip_with_nulls_ties_and_magic(spark, tmp_path):
    long = "é" * 700
    rows = [
        (1, "http://a/", "x" * 1000),
        (2, "http://b/", "x" * 1000),
        (3, None, "x" * 999),
        (4, "http://c/\r\nWARC-Type: revisit", "x" * 999),
        (5, "http://d/", None),
        (6, "http://e/", ""),
        (None, "http://f/", long),
        (7, "http://g/", long),
        (8, "http://h/", f"a {MAGIC} b {MAGIC}{END}"),
        (9, "http://i/", "nested " + record("inner") + record("second") + "tail"),
        (10, "http://j/", record("only")),
        (11, "http://k/", f"{MAGIC}Content-Length: 5{END}"),
        (7, "http://g/", long),
        (12, "http://k/", END + END),
    ]
    assert round_trip(spark, rows, tmp_path) == expected(rows)


def test_records_over_many_byte_ranges(spark, tmp_path):
    rows = [(i, f"http://h/{i}", (record(f"deep {i}") + "x" * 37 * i) * (1 + i % 3)) for i in range(60)]
    rows.append((60, "http://h/", ("y" * 3000 + record("z")) * 8))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        assert round_trip(spark, rows, tmp_path, files=2) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_cut_off_record_is_left_out(spark, tmp_path):
    (tmp_path / "warc").mkdir()
    whole = record("one") + record("two")
    (tmp_path / "warc" / "a.txt").write_bytes(whole.encode()[:-20])
    assert [r.payload_bytes for r in read_warc(spark, f"file://{tmp_path}/warc").collect()] == [3]


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, [], tmp_path, files=0) == []
