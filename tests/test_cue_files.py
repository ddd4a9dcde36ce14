"""The cue formats: parsing as the column functions do, names, choice of files, bad files and tasks that fail."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from cueloom.sources import cue_files, timed_text

CUES = "media_id string, id int, start double, end double, text string, proofread string, translation string"


def cues(spark, rows):
    return spark.createDataFrame([(m, i, s, e, t, None, None) for m, i, s, e, t in rows], CUES)


def files(folder):
    return {p.name: p.read_bytes().decode() for p in sorted(folder.iterdir())}


SAMPLES = [
    "﻿\r\n7\r\n00:00:01,000 --> 00:00:02.500 align:left\r\nHello\r\nworld\r\n\r\n\r\nno timing here\r\n\r\n00:00:03,000 --> 00:00:04,000\r\nunnumbered\r\n\r\n9\r\n00:00:05,000 --> 00:00:06,000\r\n  \r\n",
    "1\n00:00:01,000 --> 00:00:02,000\na\n\n\n3\n01:00:03,000 --> 01:00:04,020\n  b  \n c\n",
    "x\n00:00:01,000 --> 00:00:02,000\nlabel above\n",
    " \n",
    "",
]


def test_srt_reads_as_the_column_functions_do(spark):
    for content in SAMPLES:
        want = timed_text.parse_srt(spark.createDataFrame([("m", ".srt", content)], "media_id string, suffix string, content string")).orderBy("id").collect()
        assert sorted(cue_files.srt_cues(cue_files.normal_text(content.encode()))) == [tuple(r)[1:] for r in want]
    for bad, why in (("1\n00:00:01,000 --> 00:00:02,000\na\n\n1\n00:00:03,000 --> 00:00:04,000\n \n", "duplicate cue id: 1"), ("00:00:01,000 --> 00:00:02,000 --> 3\nx", "does not read")):
        with pytest.raises(ValueError, match=why):
            cue_files.srt_cues(bad)


def test_vtt_and_lrc_lines():
    text = "WEBVTT - title\n\nNOTE 00:01.000 --> 00:02.000 is no cue\nx\n\nid one\n00:01.500 --> 00:02.000 align:left\nHi\nthere\n\n01:00:00.000 --> 01:00:01.250\nlate\n\n00:03.000 --> 00:04.000\n\n"
    assert cue_files.vtt_cues(text) == [(1, 1.5, 2.0, "Hi\nthere"), (2, 3600.0, 3601.25, "late")]
    with pytest.raises(ValueError, match="WEBVTT"):
        cue_files.vtt_cues("00:01.500 --> 00:02.000\nHi")
    lines = cue_files.lrc_lines("[ti:Song]\n\n[00:01.50][00:09.00]<00:01.60>first <00:02.00>line\nplain\n[01:02]\n[01:02:25] x")
    assert lines == [(0, True, None, "[ti:Song]"), (2, False, 1.5, "first line"), (3, False, None, "plain"), (5, False, 62.25, "x")]


def test_written_names_and_bytes(spark, tmp_path):
    rows = [("b c", 2, 4.0, 5.0, "Two"), ("b c", 1, 0.0, 1.5, "One\nline"), ("a", 1, 3661.2345, 3662.0, ""), ("a", 4, 3663.0, 3664.0, "é"), ("none", 1, 0.0, 1.0, "")]
    cue_files.write_cues(cues(spark, rows).repartition(3), str(tmp_path / "out"), suffix=".original")
    assert files(tmp_path / "out") == {
        "a.original.srt": "2\n01:01:03,000 --> 01:01:04,000\né\n",
        "b c.original.srt": "1\n00:00:00,000 --> 00:00:01,500\nOne\nline\n\n2\n00:00:04,000 --> 00:00:05,000\nTwo\n",
        "none.original.srt": "",
    }
    cue_files.write_cues(cues(spark, rows[:2]), str(tmp_path / "out"), "vtt", strip_stops=True)
    assert files(tmp_path / "out")["b c.vtt"] == "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\nOne\nline\n\n00:00:04.000 --> 00:00:05.000\nTwo\n"
    cue_files.write_cues(cues(spark, rows[2:4]), str(tmp_path / "out"), save="overwrite", suffix=".original")
    assert set(files(tmp_path / "out")) == {"a.original.srt", "b c.vtt"}


def test_choice_of_files(spark, tmp_path):
    for name in ("a1.srt", "a2.SRT", "b.srt", "_c.srt", ".d.srt", "e.txt"):
        (tmp_path / name).write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    # A file that does not read is not opened if it is not asked for.
    (tmp_path / "bad.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n\n1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    read = lambda: cue_files.read_cues(spark, str(tmp_path))
    assert {r.media_id for r in read().where("media_id like 'a%'").collect()} == {"a1", "a2"}
    assert {r.media_id for r in read().where("media_id in ('b', 'x')").collect()} == {"b"}
    assert read().where("media_id = 'a1' and start > 1").count() == 0
    with pytest.raises(Exception, match="duplicate cue id"):
        read().collect()
    found = cue_files.read_cues(spark, str(tmp_path), mode="permissive").collect()
    assert sorted((r.media_id, r.id, r.error) for r in found if r.error) == [("bad", None, "duplicate cue id: 1")]
    assert len(found) == 4
    assert cue_files.read_cues(spark, str(tmp_path / "b.srt")).count() == 1
    with pytest.raises(Exception, match="FileNotFound"):
        cue_files.read_cues(spark, str(tmp_path / "nothing")).collect()
    reader = cue_files.CueReader(str(tmp_path), ".srt", cue_files.srt_cues, None, False)
    left = list(reader.pushFilters([EqualTo(("media_id",), "b"), GreaterThan(("start",), 1.0), In(("media_id",), ("b", "a1")), StringStartsWith(("media_id",), "b")]))
    assert left == [GreaterThan(("start",), 1.0)] and [m for _, m, _ in reader.listed()] == ["b"]


def test_files_are_dealt_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(cue_files, "TASK_BYTES", 1000)
    monkeypatch.setattr(cue_files, "OPEN_BYTES", 100)
    for k in range(40):
        (tmp_path / f"{k}.srt").write_text("x" * (k * 20))
    tasks = cue_files.CueReader(str(tmp_path), ".srt", cue_files.srt_cues, None, False).partitions()
    assert sum(len(t.files) for t in tasks) == 40
    assert all(sum(os.path.getsize(p) for _, p in t.files) <= 1000 for t in tasks) and len(tasks) < 40


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    """The second media's rows fail half way through its file; the folder and the old file are as before."""
    (tmp_path / "a.srt").write_text("old")
    rows = cues(spark, [("a", 1, 0.0, 1.0, "new"), *[("b", k, 0.0, 1.0, "x") for k in range(50)]])
    broken = rows.withColumn("text", F.when((F.col("media_id") == "b") & (F.col("id") == 40), F.raise_error(F.lit("no text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no text"):
        cue_files.write_cues(broken, str(tmp_path))
    assert files(tmp_path) == {"a.srt": "old"}


def test_rows_that_stand_apart(spark, tmp_path):
    cue_files.register(spark)
    rows = cues(spark, [("a", 1, 0.0, 1.0, "x"), ("b", 1, 0.0, 1.0, "y"), ("a", 2, 0.0, 1.0, "z")])
    with pytest.raises(Exception, match="stand apart"):
        rows.coalesce(1).write.format("srt").mode("append").save(str(tmp_path / "one"))
    with pytest.raises(Exception, match="several tasks"):
        rows.where("media_id = 'a'").repartition(2).write.format("srt").mode("append").save(str(tmp_path / "two"))
    with pytest.raises(Exception, match="not in order"):
        rows.where("media_id = 'a'").coalesce(1).sortWithinPartitions(F.desc("id")).write.format("srt").mode("append").save(str(tmp_path / "three"))
    with pytest.raises(Exception, match="name of media_id"):
        cue_files.write_cues(cues(spark, [("a/b", 1, 0.0, 1.0, "x")]), str(tmp_path / "four"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_a_repeated_attempt_counts_once(tmp_path):
    """Two attempts of a task write; only the one whose message arrives gets names."""
    import pyarrow as pa

    writer = cue_files.CueWriter(str(tmp_path), ".srt", False, "", "\n", "id", cue_files.Srt.show, True)
    batch = pa.RecordBatch.from_pylist([{"media_id": "m", "id": 1, "start": 0.0, "end": 1.0, "text": "hi"}])
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch])), cue_files.Written()])
    assert files(tmp_path) == {"m.srt": "1\n00:00:00,000 --> 00:00:01,000\nhi\n"}


def test_empty(spark, tmp_path):
    cue_files.write_cues(cues(spark, []), str(tmp_path))
    assert files(tmp_path) == {} and cue_files.read_cues(spark, str(tmp_path)).count() == 0
