"""Models' cues, plans with a store, outputs by name, chat requests and progress."""

import io
import json
import os
import random
import urllib.error
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators import align, artifacts as A, chat, model_cues, providers, segment
from cueloom.operators.store import Conflict, Snapshot, Store
from cueloom.plans import pipelines
from cueloom.sinks import progress, render
from cueloom.sources import config, media

KEYS = ["media_id", "window_index"]


def tokens(spark, texts, seconds=1.0, window=1):
    return spark.createDataFrame([("m", window, i, t, i * seconds, (i + 1) * seconds, "en") for i, t in enumerate(texts)], "media_id string, window_index int, pos int, text string, start double, end double, language string")


def chunk(spark, must_split=False, context=None):
    return spark.createDataFrame([("m", 1, context, must_split)], "media_id string, window_index int, context string, must_split boolean")


def asked(prompt):
    return prompt.rpartition("\nText: ")[2]


@pytest.mark.parametrize(
    "reply, must_split, texts, reason",
    [
        (lambda p: asked(p).replace("two", "two |"), True, ["one two", "three four"], None),
        (lambda p: asked(p), False, ["one two three four"], None),
        (lambda p: asked(p), True, ["one two three four"], "invalid output: no usable split"),
        (lambda p: asked(p).replace("two", "2 |"), True, ["one two three four"], "invalid output: text changed outside delimiters"),
        (lambda p: 1 / 0, False, ["one two three four"], "request error: ZeroDivisionError: division by zero"),
    ],
)
def test_model_cues(spark, reply, must_split, texts, reason):
    cues, report = model_cues.model_cues(tokens(spark, "one two three four".split()), chunk(spark, must_split), lambda: reply, KEYS, retries=0)
    assert [r.text for r in cues.orderBy("id").collect()] == texts
    assert [r.reason for r in report.collect()] == [reason]


def test_model_cues_inside_a_token(spark):
    """A delimiter inside a token moves the boundary's time into it."""
    cues, _ = model_cues.model_cues(tokens(spark, ["こんにちは", "世界だ"]), chunk(spark), lambda: lambda p: asked(p).replace("ちは", "|ちは"), KEYS)
    assert [(r.text, r.start, r.end) for r in cues.orderBy("id").collect()] == [("こんにちは", 0.0, pytest.approx(0.6)), ("世界だ", pytest.approx(0.6), 2.0)]


def test_hybrid_cues(spark, tmp_path):
    """Only the overlong group goes to the model, once; what it leaves whole is split by the search."""
    calls = str(tmp_path / "calls")

    def load(split):
        def ask(prompt):
            with open(calls, "a") as f:
                f.write("x")
            return asked(prompt).replace("delta", "delta|") if split else asked(prompt)

        return lambda: ask

    said = tokens(spark, "Short. Alpha bravo charlie delta echo foxtrot.".split(), 0.5)
    limits = T.Limits(min_duration=0.2, max_lines=1, chars=(("ja", 13), ("zh", 16), ("en", 12)))
    # The soft search has no cut inside the second sentence, as nothing marks one.
    cues, report = model_cues.hybrid_cues(said, load(True), KEYS, limits)
    assert [r.text for r in cues.orderBy("id").collect()] == ["Short.", "Alpha bravo charlie delta", "echo foxtrot."]
    assert os.path.getsize(calls) == 1 and [(r.group_id, r.reason) for r in report.collect()] == [(2, None)]
    cues, report = model_cues.hybrid_cues(said, load(False), KEYS, limits)
    made = [r.text for r in cues.orderBy("id").collect()]
    assert made[0] == "Short." and len(made) > 2 and " ".join(made[1:]) == "Alpha bravo charlie delta echo foxtrot."
    assert [r.reason for r in report.collect()] == ["invalid output: no usable split"]


def test_store_spares_the_models(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def counted(f):
        def call(*args):
            with open(calls, "a") as out:
                out.write("x")
            return f(*args)

        return lambda: call

    files = spark.createDataFrame([("a", 8.0), ("b", 9.0)], "media_id string, duration double")
    silent = spark.createDataFrame([], "media_id string, start double, end double")
    hear, place = counted(lambda row: (f"Hello from {row['media_id']}. Bye now.", "English")), counted(providers.evenly_spoken)
    store = f"file://{tmp_path}/store"
    run = lambda m=files, models=("h", "p"), most=12: pipelines.subtitles(silent, m, hear, place, store=store, models=models, most_media=most).orderBy("media_id", "id").collect()
    first = run()
    assert [r.text for r in first] == ["Hello from a.", "Bye now.", "Hello from b.", "Bye now."] and os.path.getsize(calls) == 4
    assert run() == first and os.path.getsize(calls) == 4
    assert run(models=("h", "other")) == first and os.path.getsize(calls) == 6
    assert len(run(files.where("media_id = 'a'"), ("h", "other"), 1)) == 2 and os.path.getsize(calls) == 6
    assert {r.media_id for r in Store(spark, store).read().collect()} == {"a"}
    assert [r.text for r in pipelines.subtitles(silent, files, hear, None, "none", store=store, models=("h", "p")).orderBy("media_id").collect()] == ["Hello from a. Bye now.", "Hello from b. Bye now."]
    assert os.path.getsize(calls) == 7


ARTIFACT = "media_id string, window_index int, start double, end double, version int, model_id string, mtime long, kind string, language string, transcript_sha1 string, payload string"


def made(spark, *rows):
    """Artifacts of (media_id, window_index, kind, mtime, payload)."""
    return spark.createDataFrame([(m, w, w * 1.0, w + 1.0, 1, "x", t, kind, "en", None, p) for m, w, kind, t, p in rows], ARTIFACT)


def held(store, number=None):
    return sorted((r.media_id, r.window_index, r.kind, r.payload) for r in store.read(None if number is None else store.snapshot(number)).collect())


def test_store_writes_the_touched_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=8)
    assert held(store) == [] and store.snapshot().number == 0
    media = [f"m{k}" for k in range(30)]
    store.upsert(made(spark, *[(m, 1, "asr", 5, "old") for m in media], ("m0", 1, "alignment", 5, "placed"), ("m1", 1, "alignment", 5, "placed")))
    before = store.snapshot()
    after = store.upsert(made(spark, ("m0", 1, "asr", 6, "new"), ("m0", 1, "asr", 7, "newest"), ("m1", 1, "asr", 6, "old"), ("m0", 2, "asr", 6, "more")))
    assert (before.number, after.number) == (1, 2)
    moved = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert 1 <= len(moved) <= 2 < len(before.folders)
    want = [(m, 1, "asr", "newest" if m == "m0" else "old") for m in media] + [("m0", 2, "asr", "more"), ("m1", 1, "alignment", "placed")]
    assert held(store) == sorted(want)
    # A reader of the old snapshot still sees it; a change of nothing publishes nothing.
    assert len(held(store, 1)) == 32 and ("m0", 1, "asr", "old") in held(store, 1)
    assert store.upsert(made(spark).limit(0)).number == 2
    planned = spark.createDataFrame([("m0", 1, 1.0, 2.0)], "media_id string, window_index int, start double, end double")
    assert store.retain(planned, spark.createDataFrame([("m0",)], "media_id string"), 40).number == 3
    assert held(store) == sorted(x for x in want if x != ("m0", 2, "asr", "more"))
    store.retain(planned, spark.createDataFrame([("m0",)], "media_id string"), 3)
    assert {x[0] for x in held(store)} == {"m0", "m1", "m9"}
    store.vacuum(1)
    assert store.numbers() == [4] and {x[0] for x in held(store)} == {"m0", "m1", "m9"}
    kept = {str(p.parent.relative_to(tmp_path / "s")) for p in (tmp_path / "s/data").rglob("*.parquet")}
    assert kept == set(store.snapshot().folders.values())


def test_a_writer_that_dies_leaves_the_snapshot(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert(made(spark, ("a", 1, "asr", 5, "old")))

    def dies(snapshot):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "publish", dies)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(made(spark, ("a", 1, "asr", 6, "new")))
    again = Store(spark, f"file://{tmp_path}/s")
    assert held(again) == [("a", 1, "asr", "old")] and again.numbers() == [1]
    again.upsert(made(spark, ("a", 1, "asr", 6, "new")))
    assert held(again) == [("a", 1, "asr", "new")]
    files = len(list((tmp_path / "s/data").rglob("*.parquet")))
    again.vacuum(1)
    assert len(list((tmp_path / "s/data").rglob("*.parquet"))) == 1 < files


def test_two_writers(spark, tmp_path, monkeypatch):
    """One publishes while the other works: the slower one does its change again on top, and neither's rows are lost."""
    slow, fast = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    publish = slow.publish

    def late(snapshot):
        if not fast.numbers():
            fast.upsert(made(spark, ("a", 1, "asr", 5, "fast")))
        publish(snapshot)

    monkeypatch.setattr(slow, "publish", late)
    slow.upsert(made(spark, ("a", 2, "asr", 5, "slow")))
    assert held(slow) == [("a", 1, "asr", "fast"), ("a", 2, "asr", "slow")] and slow.numbers() == [1, 2]
    with pytest.raises(Conflict):
        publish(Snapshot(2))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    take = store.sink("calls")
    take(made(spark, ("a", 1, "asr", 5, "one")), 0)
    take(made(spark, ("a", 1, "asr", 6, "two")), 1)
    take(made(spark, ("a", 1, "asr", 5, "one")), 0)
    assert held(store) == [("a", 1, "asr", "two")] and store.numbers() == [1, 2]
    store.sink("others")(made(spark, ("b", 1, "asr", 5, "x")), 0)
    assert store.snapshot().batches == {"calls": 1, "others": 0}


def test_modes_of_the_plan(spark):
    files = spark.createDataFrame([("m", 12.0)], "media_id string, duration double")
    silent = spark.createDataFrame([], "media_id string, start double, end double")
    hear = lambda: lambda row: ("Hello there, friend. How are you?", "English")
    split = lambda: lambda p: asked(p).replace("there,", "there,|")
    run = lambda mode, ask=None: [r.text for r in pipelines.subtitles(silent, files, hear, lambda: providers.evenly_spoken, mode, ask).orderBy("id").collect()]
    assert run("llm", split) == ["Hello there,", "friend. How are you?"]
    assert run("hybrid", split) == ["Hello there,", "friend.", "How are you?"]
    with pytest.raises(ValueError, match="needs a model"):
        run("llm")


def aligned(spark, heard, place=None, text="hello\nworld"):
    files = spark.createDataFrame([("m", ".txt", text)], "media_id string, suffix string, content string")
    rows = spark.createDataFrame([("m", 1, i, t, a, b) for i, (t, a, b) in enumerate(heard)], "media_id string, window_index int, pos int, text string, start double, end double")
    windows = spark.createDataFrame([("m", 1, 0.0, 10.0)], "media_id string, window_index int, start double, end double")
    files_of = spark.createDataFrame([("m", 10.0)], "media_id string, duration double")
    return [(r.text, r.start, r.end) for r in pipelines.aligned_subtitles(files, rows, windows, files_of, place).orderBy("id").collect()]


def test_aligned_subtitles(spark):
    heard = [("hello", 1.0, 2.0), ("world", 3.0, 4.0)]
    assert aligned(spark, heard) == [("hello", 1, 2), ("world", 3, 4)]
    assert aligned(spark, [("hello", 1.0, 2.0)], text="hello") == [("hello", 1, 2)]
    for heard, text in (([], "hello"), ([("zzz", 1.0, 2.0)], "...")):
        with pytest.raises(align.AlignmentError, match="no heard word"):
            aligned(spark, heard, text=text)


def test_lines_are_aligned_again(spark):
    """The second pass hears each line in its own window; failures and empty results leave the rough span."""
    heard = [("hello", 1.0, 2.0), ("world", 3.0, 4.0)]
    place = lambda: lambda text, seconds, language: [(text, 0.2, 0.8)] if text == "hello" else []
    assert aligned(spark, heard, place) == [("hello", 0.7, 1.3), ("world", 3, 4)]

    def broken(text, seconds, language):
        raise RuntimeError("no")

    assert aligned(spark, heard, lambda: broken) == [("hello", 1, 2), ("world", 3, 4)]


def test_edits_name_the_cause(spark):
    cues = spark.createDataFrame([("m", 1, "a")], "media_id string, id int, text string")
    with pytest.raises(RuntimeError, match="busy"):
        pipelines.edited(cues, lambda: lambda p: (_ for _ in ()).throw(providers.ReplyError("busy", final=True)), "translate")


def test_one_media_does_not_end_the_others(spark):
    """Media without a duration, and those of which nothing matches, are told with their reason; the rest is aligned."""
    names = ["good", "mute", "timeless", "none"]
    files = spark.createDataFrame([(m, ".txt", "hello\nworld") for m in names], "media_id string, suffix string, content string")
    heard = [("good", "hello", 1.0), ("good", "world", 3.0), ("mute", "...", 1.0), ("timeless", "hello", 1.0)]
    words = spark.createDataFrame([(m, 1, i, t, a, a + 1) for i, (m, t, a) in enumerate(heard)], "media_id string, window_index int, pos int, text string, start double, end double")
    windows = spark.createDataFrame([(m, 1, 0.0, 10.0) for m in names], "media_id string, window_index int, start double, end double")
    media = spark.createDataFrame([(m, None if m == "timeless" else 10.0) for m in names], "media_id string, duration double")
    found, errors = pipelines.timed_where_possible(files, words, windows, media)
    assert sorted((r.media_id, r.text, r.start, r.end) for r in found.collect()) == [("good", "hello", 1, 2), ("good", "world", 3, 4)]
    assert sorted(map(tuple, errors.collect())) == [("mute", align.UNMATCHED), ("none", align.UNMATCHED), ("timeless", "no usable duration")]
    with pytest.raises(align.AlignmentError, match="mute: no heard word"):
        pipelines.aligned_subtitles(files, words, windows, media)


def test_files_by_name(spark, tmp_path):
    schema = "media_id string, id int, start double, end double, text string, translation string, proofread string"
    cues = spark.createDataFrame([("m", 1, 0.0, 1.5, "Né, \"x\"", None, "Nez."), ("m", 2, 2.0, 3.0, "b", "B", None)], schema)
    records = [{"id": 1, "start": 0.0, "end": 1.5, "text": 'Né, "x"', "proofread": "Nez."}, {"id": 2, "start": 2.0, "end": 3.0, "text": "b", "translation": "B"}]
    made = render.write_subtitles(cues, tmp_path / "deep/er/a.JSON")
    assert made.read_text(encoding="utf-8") == json.dumps(records, ensure_ascii=False, indent=2) + "\n"
    assert render.write_subtitles(cues, tmp_path / "a.lrc", metadata=["[ti:x]"]).read_text().startswith("[ti:x]\n[00:00.00]")
    with pytest.raises(ValueError, match="unknown format"):
        render.write_subtitles(cues, tmp_path / "a.ass")
    names = [p.name for p in render.write_output_set(cues, tmp_path / "out", "m", ["srt", ".VTT"], translation=True)]
    assert names == ["m.original.srt", "m.translation.srt", "m.original.vtt", "m.translation.vtt"] and (tmp_path / "out" / names[-1]).exists()
    everything = {r.name: r.content for r in render.output_set(cues, ["srt", "vtt"], translation=True).collect()}
    assert everything == {n: (tmp_path / "out" / n).read_text(encoding="utf-8") for n in names}
    with pytest.raises(ValueError, match="unknown format"):
        render.output_matrix(spark, cues.select("media_id").distinct(), ["lrc"])


def test_names_of_outputs():
    names = lambda *a, **k: [(str(p), m) for p, m in render.subtitle_names(*a, **k)]
    assert names("d/v.mp4") == [("d/v.original.srt", "original")]
    assert names("v.mp4", out_dir="o", formats=["srt", "json"], translation=True, bilingual=True)[:4] == [(f"o/v.{m}.srt", m) for m in ("original", "proofread", "translation", "bilingual")]
    assert names("v.mp4", out="x/y.srt", translation=True, bilingual=True) == [("x/y.srt", "translation"), ("x/y.bilingual.srt", "bilingual")]
    assert names("v.mp4", bilingual=True) == [("v.original.srt", "original")]
    assert list(map(str, render.timed_names("d/t.txt"))) == ["d/t.timed.lrc"]
    assert list(map(str, render.timed_names("t.txt", formats=["srt", "lrc", "srt"]))) == ["t.timed.srt", "t.timed.lrc"]
    assert str(render.edited_name("d/a.srt", "proofread")) == "d/a.proofread.srt"
    for f in (render.subtitle_names, render.timed_names):
        with pytest.raises(ValueError, match="exclude"):
            f("a", out="b", formats=["srt"])


def test_config_sections():
    c = config.load_config('cache_dir = "x"\n[llm]\nmodel = "m"\nbatch_size = 3\n[llm.segmentation]\nmodel = "n"\n[output]\ndefault_formats = ["vtt"]\n', {"segment": {"mode": "hybrid"}, "cache_dir": None}, True, {"CUELOOM_API_KEY": "k", "CUELOOM_MODEL": "z"})
    assert (c.cache_dir, c.llm.model, c.segmentation.model, c.segmentation.batch_size, c.segmentation.api_key) == ("x", "m", "n", 3, "k")
    assert c.output.default_formats == ("vtt",) and c.segment.mode == "hybrid" and c.model.asr_model == c.model.low_vram_asr_model
    assert config.load_config(environment={"CUELOOM_MODEL": "z"}).llm.model == "z" and config.load_config(environment={}).segmentation is None
    for bad in ("[segmentation]\nmodel = 'x'", "[llm.segmentation]\ntemperature = 3.0", "[llm]\nthinking_effort = 'odd'", "[llm]\nmax_retries = true", "[output]\ndefault_formats = 3", "llm = 3", "[llm]\ntimeout = 0"):
        with pytest.raises(config.ConfigError):
            config.load_config(bad, environment={})


def test_chat_requests():
    sent = []

    def send(request, timeout):
        sent.append((request.full_url, json.loads(request.data), request.get_header("Authorization"), timeout))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "hi"}}]}).encode())

    llm = config.load_config('[llm]\nmodel = "m"\nthinking = true\nthinking_effort = "low"', environment={"CUELOOM_API_KEY": "k"}).llm
    assert chat.chat_loader(llm, "be brief", send=send)()("hello") == "hi"
    url, body, key, timeout = sent[0]
    assert url.endswith("/v1/chat/completions") and key == "Bearer k" and timeout == 60
    assert body == {"model": "m", "temperature": 0.0, "thinking": {"type": "enabled"}, "reasoning_effort": "low", "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hello"}]}

    def failing(code):
        def send(request, timeout):
            raise urllib.error.HTTPError(request.full_url, code, "Why", SimpleNamespace(get_content_charset=lambda: None), io.BytesIO(b"body"))

        return send

    for code, final in ((400, True), (429, False), (503, False)):
        with pytest.raises(providers.ReplyError, match=rf"HTTP {code} Why$") as e:
            chat.chat_loader(llm, send=failing(code))()("p")
        assert e.value.final == final
    for missing in ({"CUELOOM_API_KEY": "k"}, {"CUELOOM_MODEL": "m"}):
        with pytest.raises(providers.ReplyError):
            chat.chat_loader(config.load_config(environment=missing).llm)


def test_chat_stream():
    event = lambda **delta: [b"data: " + json.dumps({"choices": [{"delta": delta}]}).encode() + b"\n", b"\n"]
    shown = []
    lines = [b": ping\n", b"\n", *event(reasoning_content="hm"), b"event: x\r\n", b"id: 7\n", *event(content="a"), b"data: {broken\n", b"\n", b'data: {"choices": []}\n', b"\n"]
    lines += [b'data:{"choices": [{"delta":\r\n', b'data: {"content": "b"}}]}\r\n', b"\r\n", b"data: [DONE]\n", b"\n", *event(content="c")]
    assert chat.streamed(lines, shown.append) == "ab" and shown == ["hm", "a", "b"]
    assert list(chat.event_data([b"data: one\n", b"data\n", b"data:  two\n", b"\n", b"\n", b"data: cut"])) == ["one\n\n two", "cut"]


def test_progress():
    assert progress.read_message("refining line 3/10") == ("refining line", 3, 10, "")
    assert progress.read_message("segmentation 2/5: fallback (x)") == ("segmentation", 2, 5, "fallback (x)")
    assert progress.read_message("loading") == ("loading", None, None, "")
    out = io.StringIO()
    show = progress.Console(out, 4)
    show("loading")
    show("line 1/2")
    assert out.getvalue() == "loading\nline [##..] 1/2\n"


def test_window_files(spark, tmp_path):
    import numpy as np

    from tests.test_files import wav

    loud = np.concatenate([np.zeros(16000), 0.5 * np.sin(np.arange(32000)), np.zeros(16000)])
    files = spark.createDataFrame([("m", bytearray(wav(loud)))], "media_id string, content binary")
    windows = spark.createDataFrame([("m", 1, 0.0, 1.0), ("m", 2, 1.0, 2.5)], "media_id string, window_index int, start double, end double")
    got = sorted((r.window_index, r.name, media.mono_samples(r.content).size) for r in media.window_files(files, windows).collect())
    assert got == [(1, "chunk-00001-0.000-1.000.wav", 16000), (2, "chunk-00002-1.000-2.500.wav", 24000)]
    found = media.detect_speech(files, padding=0.25).collect()
    assert len(found) == 1 and abs(found[0].start - 0.75) < 0.05 and abs(found[0].end - 3.25) < 0.05
    two = media.detect_speech(files, lambda s: [(0.1, 1.0), (1.2, 3.9)], padding=0.25).orderBy("start").collect()
    assert [(r.start, r.end) for r in two] == [(0.0, pytest.approx(1.1)), (pytest.approx(1.1), 4.0)]
    source, runs = tmp_path / "a.mp4", []
    source.write_bytes(b"x")
    run = lambda command: (runs.append(command), open(command[-1], "w").close())
    out = media.to_wav(str(source), str(tmp_path / "w"), run=run)
    assert out.endswith(f"{media.file_id(source)}.16k-mono.wav") and media.to_wav(str(source), str(tmp_path / "w"), run=run) == out and len(runs) == 1
    media.to_wav(str(source), str(tmp_path / "w"), overwrite=True, run=run)
    assert len(runs) == 2


def test_subtitles_keep_words_in_their_windows(spark, tmp_path):
    """Placed words go to cues as lists of their windows, with the rows of the operators on single tokens."""
    rng = random.Random(5)
    rows = []
    for w in range(30):
        words = [rng.choice(["one", "two,", "three.", "so", "(x", "7", " ", "漢字", "long" * 7]) for _ in range(rng.randint(0, 60))]
        times = [(round(k * 0.4 + rng.choice([0, 0.9]), 3), rng.choice([0.3, 0.5, -1.0])) for k in range(len(words))]
        said = " ".join(x.rstrip(",.") + rng.choice(["", ",", "?!", '."', " -"]) for x in words)
        rows.append((f"m{w % 4}", w, w * 100.0, rng.choice([None, "English", "ja"]), said if w % 9 else None, [(x, a, a + d) for x, (a, d) in zip(words, times)]))
    listed = spark.createDataFrame(rows, f"media_id string, window_index int, start double, language string, context string, tokens {providers.TOKENS}")
    for mode in segment.MODES:
        got = segment.segmented_lists(listed, KEYS, mode)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan
        marked = segment.with_context_punctuation(pipelines.media_tokens(listed), listed.select(*KEYS, "context"), KEYS).withColumn("pos", F.col("atom_id"))
        want = segment.segmented(marked.join(listed.select(*KEYS, "language"), KEYS), KEYS, mode)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert segment.followers(["a", "b", "c"], "a, b c.") == {0: ",", 2: "."}


def test_placed_words_are_not_written(spark, tmp_path, monkeypatch):
    """Words go from the aligner to cues within a task; cues are numbered over their media, though one is dealt to several tasks."""
    calls, written, real = str(tmp_path / "calls"), [], pipelines.shared_table
    monkeypatch.setattr(pipelines, "shared_table", lambda df: written.append(df.columns) or real(df))

    def place():
        def model(*given):
            with open(calls, "ab") as f:
                f.write(b".")
            return providers.evenly_spoken(*given)

        return model

    films = spark.createDataFrame([("b", 20000.0), ("a", 500.0), ("c", 60.0), ("mute", 60.0), (None, 60.0)], "media_id string, duration double")
    silent = spark.createDataFrame([], "media_id string, start double, end double")
    hear = lambda: lambda row: (" ".join(f"Part {k} of {row['window_index']}, told." for k in range(int(row["window_index"]) * 7 % 5)) if row["media_id"] != "mute" else " ", "English")
    for mode in ("soft", "hard"):
        written.clear()
        cues = pipelines.subtitles(silent, films, hear, place, mode)
        asked = os.path.getsize(calls)
        got = sorted(map(tuple, cues.collect()))
        assert sorted(map(tuple, cues.collect())) == got and os.path.getsize(calls) == asked
        assert not [c for c in written if "tokens" in c] and ["media_id", "id", "start", "end", "text", "task"] in written
        heard = providers.transcribed(pipelines.W.planned_windows(silent, films).withColumn("hint", F.lit(None).cast("string")), hear).withColumnRenamed("spoken", "language")
        listed = providers.force_aligned(heard, place).join(heard.select(*KEYS, "start", "language", F.col("transcript").alias("context")), KEYS)
        order = F.row_number().over(pipelines.W.Window.partitionBy("media_id").orderBy("window_index", "id"))
        want = segment.segmented_lists(listed, KEYS, mode).select("media_id", order.alias("id"), "start", "end", "text")
        assert got == sorted(map(tuple, want.collect())) and {r[0] for r in got} == {"a", "b", "c"}
    with pytest.raises(ValueError, match="unknown mode"):
        pipelines.subtitles(silent, films, hear, place, "odd")


def test_cues_are_counted_over_batches(spark):
    import pyarrow as pa

    batch = lambda media: pa.RecordBatch.from_pydict({"media_id": pa.array(media, pa.string()), "id": [0] * len(media), "start": [0.0] * len(media), "end": [1.0] * len(media), "text": ["x"] * len(media)})
    parts = [batch(m) for m in (["a", "a"], [], ["a"], ["a", "b", "c", "c"], ["c"], ["d"])]
    assert [n for b in segment.counted(iter(parts)) for n in b["id"].to_pylist()] == [1, 2, 3, 4, 1, 1, 2, 3, 1]
    # Tasks 0, 1 and 3 hold the media "b"; its cues go on counting in the later ones.
    rows = [(0, "a", 1), (0, "b", 1), (0, "b", 2), (1, "b", 1), (3, "b", 1), (3, "b", 2), (3, "c", 1)]
    cues = spark.createDataFrame([(t, m, n, 0.0, 1.0, "x") for t, m, n in rows], "task int, media_id string, id int, start double, end double, text string")
    assert sorted((r.media_id, r.id) for r in segment.renumbered(cues).collect()) == [("a", 1), *[("b", n) for n in range(1, 6)], ("c", 1)]


def test_marks_are_looked_up_by_running_lengths(monkeypatch):
    """Where words say just what their context does no word is searched; the marks are those of the search."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    texts, opens, contexts = [], [], []
    for _ in range(300):
        words = [rng.choice(["one", "Two", "three", "7", "漢字", "don't"]) for _ in range(rng.randint(1, 9))]
        opens.append(len(texts))
        texts += words
        contexts.append(rng.choice(["", " ", "(", ". "]) + "".join(w.upper() + rng.choice([" ", ", ", ".", "?! ", " - ", "  ", '." ']) for w in words))
    assert segment.standing(" .a, b -c. (d)?!") == ({1: ",", 3: ".", 4: ")?!"}, "abcd") and segment.standing("a b") == ({}, "")
    asked, real = [], segment.followed
    monkeypatch.setattr(segment, "followed", lambda words, *x: asked.append(words) or real(words, *x))
    for said in (contexts, [f"so, {c}" if k % 2 else c for k, c in enumerate(contexts)]):
        want = list(texts)
        for a, b, c in zip(opens, [*opens[1:], len(texts)], said):
            for k, marks in real([w.lower().replace("'", "") for w in texts[a:b]], *segment.standing(c)).items():
                want[a + k] = segment.append_missing(texts[a + k], marks)
        assert segment.punctuated(pa.array(texts), np.array(opens), said).to_pylist() == want != texts
        # Words that are not the context's are still searched, and only they.
        assert len(asked) == (0 if said is contexts else 150)


def test_parts_are_joined_by_batches(spark):
    rows = spark.createDataFrame([(["a", " ", "b,", None, "( c", ")", "1", "2"],), ([],), (None,), (["漢", "x", "'s"],)], "p array<string>")
    made = rows.select(T.join_parts(F.col("p")).alias("t"))
    assert "lambda" not in made._jdf.queryExecution().executedPlan().toString()
    assert [r.t for r in made.collect()] == ["a b, ( c) 12", "", None, "漢x's"]


def test_groups_take_one_pass(spark):
    """Sentences, measures and the search are one map over sorted tokens, without windows."""
    grouped = segment.grouped_tokens(tokens(spark, "Short. Alpha bravo".split()), KEYS, "soft")
    assert "Window" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert [r.group_id for r in grouped.orderBy("pos").collect()] == [1, 2, 2]
