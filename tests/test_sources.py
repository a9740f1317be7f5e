import struct

import pytest

from tessera.sources import captions, fits


def test_vtt_to_srt_and_back(spark, tmp_path):
    (tmp_path / "a.vtt").write_bytes(b"WEBVTT\r\n\r\ncue-7\r\n00:01:03.040 --> 00:01:05.500\r\n<v Ada>Rain on the roof\r\n\r\nno times here\r\n\r\n00:01:06.125 --> 00:01:09.000\r\nand on\r\nthe road\r\n")
    cues = captions.read_vtt(spark, f"file://{tmp_path}/a.vtt")
    rows = sorted((r.start, r.end, r.text, r.speaker) for r in cues.collect())
    assert rows == [(63.04, 65.5, "Rain on the roof", "Ada"), (66.125, 69.0, "and on\nthe road", None)]
    srt = captions.srt_text(cues).collect()[0].value
    assert srt == "1\n00:01:03,040 --> 00:01:05,500\n[Ada] Rain on the roof\n\n2\n00:01:06,125 --> 00:01:09,000\nand on\nthe road\n\n"
    (tmp_path / "b.srt").write_text(srt)
    back = captions.read_srt(spark, f"file://{tmp_path}/b.srt")
    assert sorted((r.start, r.end, r.text, r.speaker) for r in back.collect()) == rows
    assert captions.vtt_text(back).collect()[0].value.startswith("WEBVTT\n\n00:01:03.040 --> 00:01:05.500\n<v Ada>Rain on the roof\n\n")


def test_asr_shapes(spark):
    one = '{"transcription": [{"text": " Hello big world", "offsets": {"from": 0, "to": 300}}]}'
    two = '{"segments": [{"words": [{"word": "hi", "t0": 10, "t1": 20}]}]}'
    got = captions.asr_words(spark.createDataFrame([("a", one), ("b", two)], "file string, value string")).collect()
    assert sorted((r.file, r.word, r.start_ms, r.end_ms) for r in got) == [("a", "Hello", 0, 100), ("a", "big", 100, 200), ("a", "world", 200, 300), ("b", "hi", 100, 200)]


def test_bad_word_record_fails(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text('{"word": "a", "source_time_ticks": 1}\nnot json\n')
    with pytest.raises(Exception):
        captions.read_words(spark, f"file://{tmp_path}/w.jsonl").collect()


def test_cube(spark, tmp_path):
    (tmp_path / "a.cube").write_text("# note\nLUT_3D_SIZE 2\n" + "\n".join(f"{i / 8} 0 1" for i in range(8)))
    (tmp_path / "b.cube").write_text("LUT_3D_SIZE 3\n0 0 0\n")
    got = captions.read_cube(spark, f"file://{tmp_path}/*.cube").collect()
    assert [r.r for r in sorted(got, key=lambda r: r.i)] == [i / 8 for i in range(8)]


def test_fits(spark, tmp_path):
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -32", "NAXIS   =                    2", "NAXIS1  =                    2", "NAXIS2  =                    2", "END"]
    head = "".join(c.ljust(80) for c in cards).ljust(2880).encode()
    (tmp_path / "a.fits").write_bytes(head + struct.pack(">4f", 1, 2, 3, 4).ljust(2880, b"\0"))
    lines = fits.read_fits(spark, f"file://{tmp_path}/a.fits")
    assert [r.row for r in lines.orderBy("y").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    assert [r.row for r in fits.read_fits(spark, f"file://{tmp_path}/a.fits", 1, 2).collect()] == [[3.0, 4.0]]
    (tmp_path / "b.fits").write_bytes((tmp_path / "a.fits").read_bytes().replace(b"                  -32", b"                  -64"))
    with pytest.raises(Exception, match="BITPIX -64"):
        fits.read_fits(spark, f"file://{tmp_path}/b.fits").collect()
    s = fits.statistics(lines).collect()[0]
    assert (s.lo, s.hi, s["mean"]) == (1.0, 4.0, 2.5)


def test_unknown_project_version_fails(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"schemaVersion": 1, "name": "a", "visualContext": "x"}\n{"schemaVersion": 9, "name": "b"}\n')
    with pytest.raises(Exception, match="unknown schemaVersion 9"):
        captions.read_projects(spark, f"file://{tmp_path}/p.json", (1, 2)).collect()
    assert "visualContext" in captions.read_projects(spark, f"file://{tmp_path}/p.json", (1, 9), with_context=True).columns
