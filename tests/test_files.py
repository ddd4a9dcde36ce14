"""Sources, sinks, configuration, plans and streams."""

import ast
import io
import json
import random
import wave
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.plans import pipelines, queries
from cueloom.operators import providers
from cueloom.sinks import render
from cueloom.sources import config, media, timed_text
from cueloom.streaming import events as E

SF = "/root/testdata/sf0.001"


def files(spark, content, suffix=".srt"):
    return spark.createDataFrame([("m", suffix, content)], "media_id string, suffix string, content string")


def test_srt(spark):
    text = "﻿\r\n7\r\n00:00:01,000 --> 00:00:02.500 align:left\r\nHello\r\nworld\r\n\r\n\r\nno timing here\r\n\r\n00:00:03,000 --> 00:00:04,000\r\nunnumbered\r\n\r\n9\r\n00:00:05,000 --> 00:00:06,000\r\n  \r\n"
    got = [(r.id, r.start, r.end, r.text) for r in timed_text.parse_srt(files(spark, text)).orderBy("start").collect()]
    assert got == [(7, 1.0, 2.5, "Hello\nworld"), (3, 3.0, 4.0, "unnumbered")]
    double = "1\n00:00:01,000 --> 00:00:02,000\na\n\n1\n00:00:03,000 --> 00:00:04,000\n"
    with pytest.raises(Exception, match="duplicate cue id"):
        timed_text.parse_srt(files(spark, double + "b\n")).collect()
    assert timed_text.parse_srt(files(spark, " \n")).count() == 0


def test_lrc(spark):
    text = "[ti:Song]\n[offset:+5]\n\n[00:01.00][00:09.00]<00:01.10>first <00:01.50>line\r\n[00:00.50]earlier\n[00:02]\n"
    tags, lines = timed_text.parse_lrc(files(spark, text, ".lrc"))
    assert [r.line for r in tags.orderBy("at").collect()] == ["[ti:Song]", "[offset:+5]"]
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["first line", "earlier"]
    tags, lines = timed_text.untimed_lines(files(spark, text, ".lrc").union(files(spark, " a \r\rb\n", ".txt")))
    assert [r.line for r in tags.collect()] == ["[ti:Song]"] and lines.count() == 4


def cues(spark):
    rows = [("m", 1, 0.0, 1.5, "One, two.", None, "Un."), ("m", 2, 2.0, 3.0, "", None, None), ("m", 5, 4.0, 5.0, "Three", "THREE", None)]
    return spark.createDataFrame(rows, "media_id string, id int, start double, end double, text string, proofread string, translation string")


def test_rendering(spark):
    body = lambda df: df.first()["content"]
    assert body(render.render_srt(cues(spark))) == "1\n00:00:00,000 --> 00:00:01,500\nOne, two.\n\n3\n00:00:04,000 --> 00:00:05,000\nThree\n"
    assert body(render.render_vtt(cues(spark), "bilingual", True)).startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\nOne, two\nUn\n")
    tags = spark.createDataFrame([("m", 0, "[ti:x]")], "media_id string, at int, line string")
    assert body(render.render_lrc(cues(spark), tags)) == "[ti:x]\n[00:00.00]One, two.\n[00:02.00]\n[00:04.00]Three\n"
    whole = json.loads(body(render.render_json(cues(spark), "original", True)))
    assert whole[0] == {"id": 1, "start": 0.0, "end": 1.5, "text": "One, two.", "translation": "Un."} and "proofread" not in whole[1]
    assert [x["text"] for x in json.loads(body(render.render_json(cues(spark), "proofread")))] == ["One, two.", "", "THREE"]
    names = [r.name for r in render.output_matrix(spark, cues(spark).select("media_id").distinct(), ["vtt", ".srt", "vtt"], bilingual=True).orderBy("position").collect()]
    assert names == ["m.original.vtt", "m.bilingual.vtt", "m.original.srt", "m.bilingual.srt"]
    with pytest.raises(ValueError):
        render.rendered(cues(spark), "doc")


def test_written_and_read(spark, tmp_path):
    out = str(tmp_path / "out")
    render.write_texts(render.render_srt(cues(spark)), out)
    again = timed_text.read_texts(spark, out + "/*/*.txt")
    assert timed_text.parse_srt(again).count() == 2


def wav(samples, channels=1, rate=16000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.repeat(samples, channels) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_media(spark, tmp_path):
    loud = np.concatenate([np.zeros(16000), 0.5 * np.sin(np.arange(32000)), np.zeros(16000)])
    found = media.detect_speech(spark.createDataFrame([("m", bytearray(wav(loud, 2)))], "media_id string, content binary")).collect()
    assert len(found) == 1 and abs(found[0].start - 1) < 0.05 and abs(found[0].end - 3) < 0.05
    assert media.mono_samples(wav(np.empty(0))).size == 0
    with pytest.raises(ValueError):
        media.mono_samples(wav(loud, rate=8000))
    assert media.mono_samples(media.cut_window(wav(loud), 1.0, 2.0)).size == 16000
    (tmp_path / "a.wav").write_bytes(wav(loud))
    listed = media.list_media(spark, str(tmp_path)).collect()
    assert len(listed) == 1 and len(listed[0].media_id) == 16
    assert media.probe_duration("x", lambda c: " 3.5\n") == 3.5
    with pytest.raises(RuntimeError):
        media.probe_duration("x", lambda c: "N/A")
    with pytest.raises(RuntimeError, match="not installed"):
        media.run_tool(["no-such-tool-here"])


def test_config():
    c = config.load_config("[llm]\ntemperature = 1\n[cache]\nmax_media_entries = 3\n", {"llm": {"batch_size": 7, "timeout": None}}, environment={"CUELOOM_MODEL": "x"})
    assert (c.llm.temperature, c.cache.max_media_entries, c.llm.batch_size, c.llm.model) == (1.0, 3, 7, "x")
    for bad in ("[llm]\ntemperature = 5.0", "[llm]\nconcurrency = 0", "[nothing]\na = 1", "[model]\nb = 1", "[segment]\nmode = 'odd'", "[llm]\nmodel = 3", "model = 3", "["):
        with pytest.raises(config.ConfigError):
            config.load_config(bad)


def test_plans(spark):
    media_rows = spark.createDataFrame([("m", 12.0)], "media_id string, duration double")
    silent = spark.createDataFrame([], "media_id string, start double, end double")
    hear = lambda: lambda row: ("Hello there, friend. How are you?", "English")
    made = pipelines.subtitles(silent, media_rows, hear, lambda: providers.evenly_spoken).orderBy("id").collect()
    assert [r.text for r in made] == ["Hello there,", "friend.", "How are you?"]
    assert [r.id for r in made] == list(range(1, len(made) + 1))
    assert [r.text for r in pipelines.subtitles(silent, media_rows, hear, None, "none").collect()] == ["Hello there, friend. How are you?"]
    ask = lambda: lambda prompt: json.dumps([{"i": x["i"], "t": x["t"].upper()} for x in json.loads(prompt.partition("every i: ")[2])])
    assert {r.translation for r in pipelines.edited(cues(spark), ask, "translate", 2).collect()} == {"ONE, TWO.", "", "THREE"}
    with pytest.raises(ValueError):
        pipelines.edited(cues(spark), lambda: lambda prompt: "[]", "translate", 2)


def test_repeats_of_a_stream(spark):
    rows = E.drained(E.first_events(E.read_events(spark, SF), "1 hour").select("event_id"))
    assert rows.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def brute_groups(events, mark):
    """Closed groups of the events up to the watermark: {(user, opened, until, n)}."""
    out, now = set(), {}
    for user, at, value in sorted(e for e in events if e[1] <= mark):
        held = now.get(user)
        if held and at - held[1] < 3600:
            now[user] = (held[0], max(held[1], at + value), held[2] + 1)
        else:
            out |= {(user, *held)} if held else set()
            now[user] = (at, at + value, 1)
    return out | {(user, *held) for user, held in now.items() if held[1] + 3600 <= mark}


@pytest.mark.parametrize("parts", [1, 3])
def test_gap_groups(spark, tmp_path, parts):
    """Events that come late, but within the watermark, in a later batch, make the same groups as all at once."""
    rng = random.Random(7)
    events = [(u, 1_700_000_000.0 + rng.randrange(0, 200_000) + u / 8, float(rng.choice([1, 60, 2000]))) for u in range(12) for _ in range(40)]
    first = max(e[1] for e in events)
    events.append((99, first + 50_000.0, 1.0))  # moves the watermark
    order = sorted(events, key=lambda e: e[1] + rng.uniform(-1500, 1500) * (parts > 1))
    for k in range(parts):
        own = order[k * len(order) // parts : (k + 1) * len(order) // parts]
        frame = spark.createDataFrame(own, "user_id long, at double, value double").select("user_id", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"), "value")
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {(r.user_id, r.opened, r.until, r.n) for r in E.drained(E.gap_groups(stream, 3600.0, "1 hour")).collect()}
    assert got == brute_groups(events, first + 50_000.0 - 3600)


def test_gap_groups_go_on_from_a_checkpoint(spark, tmp_path):
    """Stopped in the middle and started again, the stream gives the groups of one that ran through."""
    rng = random.Random(8)
    events = sorted(((u, 1_700_000_000.0 + rng.randrange(0, 100_000), float(rng.choice([1, 60, 2000]))) for u in range(6) for _ in range(30)), key=lambda e: e[1])
    events.append((99, events[-1][1] + 50_000.0, 1.0))
    got = None
    for k, own in enumerate((events[:70], events[70:120], events[120:])):
        frame = spark.createDataFrame(own, "user_id long, at double, value double").select("user_id", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"), "value")
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        got = E.drained(E.gap_groups(stream, 3600.0, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/marks")
    found = [(r.user_id, r.opened, r.until, r.n) for r in got.collect()]
    want = brute_groups(events, events[-1][1] - 3600)
    assert set(found) == want and len(found) == len(want)


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, sql, name):
    said = sql.sql(queries.ORACLES[name])
    names = sorted(said.columns)
    plain = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    want = plain(sql.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from said").fetchall())
    assert want and plain(map(tuple, got.select(*names).collect())) == want


@pytest.mark.parametrize("path", sorted(p for p in Path(queries.__file__).parents[1].rglob("*.py") if "llm" not in p.parts), ids=lambda p: p.stem)
def test_names_are_bound_once(path):
    """No constant, function or class of a module is bound twice."""
    bound = Counter()
    for node in ast.parse(path.read_text()).body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        bound.update(x.id for t in targets for x in ast.walk(t) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store))
        bound.update([node.name] if isinstance(node, (ast.FunctionDef, ast.ClassDef)) else [])
    assert [n for n, k in bound.items() if k > 1] == []
