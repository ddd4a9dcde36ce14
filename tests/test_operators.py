"""Golden cases of the operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as T, timecode as C
from cueloom.operators import align, align_matrix, anchors, overlaps, artifacts as A, providers, replies as R, segment as S, spans, tokens as K, windows as W


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def lit(*parts):
    return F.array(*map(F.lit, parts))


def words(spark, rows, language="en"):
    """(text, start, end) rows as tokens of one window."""
    return spark.createDataFrame([("m", 1, i, t, float(a), float(b), language) for i, (t, a, b) in enumerate(rows)], "media_id string, window_index int, pos int, text string, start double, end double, language string")


KEYS = ["media_id", "window_index"]


@pytest.mark.parametrize("seconds, srt, lrc", [(3661.2345, "01:01:01,234", "[61:01.23]"), (0.9996, "00:00:01,000", "[00:01.00]"), (-1.0, "00:00:00,000", "[00:00.00]"), (59.996, "00:00:59,996", "[01:00.00]"), (3599.999, "00:59:59,999", "[60:00.00]"), (360000.0, "100:00:00,000", "[6000:00.00]")])
def test_clocks(spark, seconds, srt, lrc):
    assert one(spark, C.srt_time(F.lit(seconds))) == srt
    assert one(spark, C.vtt_time(F.lit(seconds))) == srt.replace(",", ".")
    assert one(spark, C.lrc_time(F.lit(seconds))) == lrc
    assert one(spark, C.parse_clock(F.lit("01:02:03,456 align:left"))) == pytest.approx(3723.456)


@pytest.mark.parametrize("parts, joined", [(["你", "好", "，", "world", "!"], "你好，world!"), (["a", " ", "(", "b", ")", "1", "2", "it", "'", "s"], "a (b) 12 it's"), ([], ""), (["  x  ", "y"], "x y")])
def test_joined_parts(spark, parts, joined):
    assert one(spark, T.join_parts(lit(*parts).cast("array<string>"))) == joined


def test_small_text_functions(spark):
    assert one(spark, T.append_missing(F.lit("Hello."), F.lit('."'))) == 'Hello."'
    assert one(spark, T.append_missing(F.lit("a"), F.lit(",."))) == "a,."
    assert [one(spark, T.for_alignment(F.lit(t), F.lit(x))) for t, x in [("Hello, World!", None), ("ABC１２３", None), ("ベタな愛", "ja"), ("ベタな愛", "en")]] == ["helloworld", "abc123", "べたな愛", "ベタな愛"]
    assert [one(spark, T.language_of(F.lit(n), F.lit(t))) for n, t in [("Japanese", "x"), ("zh-TW", "x"), (None, "かな"), (None, "漢字"), (None, "한글"), ("fr", "x")]] == ["ja", "zh", "ja", "zh", "en", "en"]
    assert [one(spark, T.measure(F.lit(" a  b "), F.lit(x))) for x in ("en", "zh")] == [3, 2]
    assert one(spark, T.major_boundary(F.lit('end.")'))) and one(spark, T.soft_boundary(F.lit("end,"))) and not one(spark, T.major_boundary(F.lit("end")))
    assert one(spark, T.break_before(F.lit("And so"))) and not one(spark, T.break_before(F.lit("android")))
    assert one(spark, T.without_line_stops(F.lit("a, b.\nc！?\n"))) == "a, b\nc"
    assert one(spark, T.without_fence(F.lit("```json\n[1]\n```"))) == "[1]" and one(spark, T.json_part(F.lit('so: {"a": 1}. ok'))) == '{"a": 1}' and one(spark, T.json_part(F.lit("none"))) is None
    assert [one(spark, T.text_by_mode(m, F.lit("t"), F.lit(""), F.lit("x"))) for m in ("original", "proofread", "translation", "bilingual")] == ["t", "t", "x", "t\nx"]
    with pytest.raises(ValueError):
        T.text_by_mode("other", F.lit(""), F.lit(""), F.lit(""))


def media(spark, duration):
    return spark.createDataFrame([("m", float(duration))], "media_id string, duration double")


def speech(spark, rows):
    return spark.createDataFrame([("m", float(a), float(b)) for a, b in rows], "media_id string, start double, end double")


def bounds(df, order="window_index"):
    return [(r.start, r.end) for r in df.orderBy(order).collect()]


def test_windows(spark):
    none = W.SpeechPlan(padding=0.0)
    assert bounds(W.packed_windows(speech(spark, [(1, 4), (20, 22)]), media(spark, 30), none)) == [(1, 4), (20, 22)]
    assert bounds(W.packed_windows(speech(spark, [(0, 25)]), media(spark, 30), W.SpeechPlan(0.0, 10.0, 10.0))) == [(0, 10), (10, 20), (20, 25)]
    assert bounds(W.packed_windows(speech(spark, []), media(spark, 500))) == [(0, 240), (240, 480), (480, 500)]
    assert bounds(W.planned_windows(speech(spark, []), media(spark, 30))) == [(0, 30)]
    assert bounds(W.merged_intervals(speech(spark, [(0, 1), (1, 2), (3, 4), (3.5, 3.6), (9, 9)]), media(spark, 10), 0.0), "start") == [(0, 2), (3, 4)]
    for d, overlap, want in [(75, 1.0, [(0, 30), (29, 59), (58, 75)]), (75, 0.0, [(0, 30), (30, 60), (60, 75)]), (0, 1.0, [(0, 0)]), (30, 1.0, [(0, 30)]), (59, 1.0, [(0, 30), (29, 59)])]:
        assert bounds(W.fixed_tiles(media(spark, d), 30.0, overlap)) == want


def test_packing_against_a_loop(spark):
    rng, rows = random.Random(1), []
    at = 0.0
    for _ in range(200):
        at += rng.choice([0.5, 3.0, 7.9, 8.0, 8.5, 20.0])
        rows.append((at, at + rng.choice([1.0, 30.0, 119.0, 300.0])))
        at = rows[-1][1]
    want, now = [], None
    for a, b in [(x, min(b, x + 240)) for a, b in rows for x in np.arange(a, b, 240)]:
        if now and not (a - now[1] > 8 or b - now[0] > 120):
            now = (now[0], b)
        else:
            want += [now] if now else []
            now = (a, b)
    got = bounds(W.packed_windows(speech(spark, rows), media(spark, 1e6), W.SpeechPlan(padding=0.0)))
    assert got == [(round(a, 3), round(b, 3)) for a, b in [*want, now]]


def test_overlap_and_refine(spark):
    heard = spark.createDataFrame([("m", 1, 0, "a", 0.0, 1.0), ("m", 1, 1, "b", 29.0, 30.0), ("m", 2, 0, "b", 0.0, 1.0), ("m", 2, 1, "c", 1.0, 2.0)], "media_id string, window_index int, pos int, text string, start double, end double")
    tiles = spark.createDataFrame([("m", 1, 0.0, 30.0), ("m", 2, 29.0, 59.0)], "media_id string, window_index int, start double, end double")
    assert sorted((r.text, r.start, r.end) for r in W.without_overlap_tokens(heard, tiles).collect()) == [("a", 0, 1), ("b", 29, 30), ("c", 30, 31)]
    lines = spark.createDataFrame([("m", 1, 0.0, 2.0), ("m", 2, 4.0, 6.0), ("m", 3, 10.0, 12.0)], "media_id string, line_no int, start double, end double")
    assert bounds(W.refine_windows(lines, media(spark, 20)).where("line_no = 2"), "line_no") == [(3.5, 6.5)]


def test_isolated_tokens(spark):
    rows = words(spark, [("x", 0, 1), ("y", 10, 11), ("a", 20, 21), ("b", 21.5, 22), ("c", 23, 24)])
    assert [r.text for r in K.connected_tokens(rows).orderBy("start").collect()] == ["a", "b", "c"]
    alone = words(spark, [("x", 0, 1)])
    assert K.connected_tokens(alone).count() == 0 and K.connected_or_all(alone).count() == 1


def segments(spark, rows, mode="hard", limits=T.Limits()):
    return [(r.start, r.end, r.text) for r in S.segmented(words(spark, rows), KEYS, mode, limits).orderBy("id").collect()]


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_isolated_media_are_kept_by_one_sort(spark):
    rows = [("a", k, t, t + 1.0) for k, t in enumerate((0.0, 1.5, 90.0))] + [("b", k, k * 50.0, k * 50.0 + 1) for k in range(3)] + [("c", 0, 0.0, 1.0)]
    kept = K.connected_or_all(spark.createDataFrame(rows, "media_id string, pos int, start double, end double"))
    assert sorted((r.media_id, r.pos) for r in kept.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2), ("c", 0)]
    assert plan_of(kept).count("Scan") == 1 and "Join" not in plan_of(kept)


def test_nearest_boundaries_by_one_sort(spark):
    """Against all pairs; several boundaries at one place, the smaller place on ties."""
    rng = random.Random(17)
    asked = sorted({(k, rng.randrange(30)) for k in range(20) for _ in range(8)})
    ends = [(k, rng.randrange(30), p) for k in range(19) for p in range(rng.randint(0, 9))]
    want: dict = {}
    for k, at in asked:
        if own := [(abs(b - at), b, p) for e, b, p in ends if e == k]:
            p = min(own)[2]
            want[k, p] = min(at, want.get((k, p), 99))
    found = W.nearest_boundaries(spark.createDataFrame(asked, "k int, at long"), spark.createDataFrame(ends, "k int, boundary long, position int"), ["k"])
    assert {(r.k, r.position): r.at for r in found.collect()} == want
    assert len({line[line.index("Window") :].rpartition("], [")[2] for line in plan_of(found).splitlines() if "Window" in line}) == 1


def test_segments(spark):
    two = [("Hello", 0, 0.4), ("world.", 0.4, 1), ("Next", 1.2, 1.6), ("one.", 1.6, 2.2)]
    assert segments(spark, two, limits=T.Limits(min_duration=0.2)) == [(0, 1, "Hello world."), (1.2, 2.2, "Next one.")]
    assert segments(spark, [("Yes.", 0, 0.3), ("Go", 0.3, 0.8), ("now.", 0.8, 1.5)], limits=T.Limits(min_duration=0.8)) == [(0, 1.5, "Yes. Go now.")]
    long = [(w, 0.3 * i, 0.3 * i + 0.3) for i, w in enumerate("this is fairly long, but still goes on".split())]
    short = T.Limits(min_duration=0.2, max_lines=1, chars=(("ja", 13), ("zh", 16), ("en", 20)))
    cut = segments(spark, long, limits=short)
    assert [t for _, _, t in cut] == ["this is fairly long,", "but still goes on"]
    assert len(segments(spark, long, "none", short)) == 1
    assert segments(spark, []) == []


def glued(parts):
    out = ""
    for p in parts:
        tight = not out or out[-1] in "([{（【「『，。；：！？、'" or p[0] in ",.;:!?，。；：！？、)]}）】」』'" or (out[-1].isdigit() and p[0].isdigit()) or any("㐀" <= c <= "鿿" for c in (out[-1], p[0]))
        out += p if tight else " " + p
    return out


def brute_cues(rows, language, weak, limits=T.Limits()):
    """Cues of one window by their texts: every candidate is joined and measured anew."""
    chars, cps = limits.max_lines * dict(limits.chars)[language], dict(limits.cps)[language]

    def size(a, b):
        text = glued([t for t, _, _ in rows[a:b]])
        return len(text.replace(" ", "")) if language == "zh" else len(text)

    span = lambda a, b: max(0.001, rows[b - 1][2] - rows[a][1])
    long = lambda a, b, slack=1.0: span(a, b) > limits.max_duration * slack or size(a, b) > chars
    last = lambda i: rows[i][0].rstrip("\"'”’)]}）】」』")[-1:]

    def value(a, at, b):
        pause = max(0.0, rows[at][1] - rows[at - 1][2])
        marks = [100.0] * (last(at - 1) in tuple(".!?。！？")) + [80.0] * (last(at - 1) in tuple(",;:，；：、")) + [70 + 5 * min(pause, 1.5)] * (pause >= limits.pause)
        base = max([0.0, *marks, *[45.0] * (language == "en" and rows[at][0] in T.BREAK_BEFORE)])
        if not base and not (weak and long(a, b, 1.1)):
            return None
        out = base + (not base) - 30 * abs(size(a, at) / size(a, b) - 0.5)
        for x, y in ((a, at), (at, b)):
            d, n = span(x, y), size(x, y)
            out -= 35 * max(0.0, (limits.min_duration - d) / limits.min_duration) + 25 * (max(0, d / limits.max_duration - 1) + max(0, n / chars - 1) + max(0, n / d / cps - 1))
        return out

    def split(a, b):
        scored = [(round(v, 9), -at) for at in range(a + 1, b) if (v := value(a, at, b)) is not None] if long(a, b) else []
        return [(a, b)] if not scored else split(a, -max(scored)[1]) + split(-max(scored)[1], b)

    starts = [i for i in range(len(rows)) if not i or rows[i][1] - rows[i - 1][2] >= limits.pause or last(i - 1) in tuple(".!?。！？")]
    todo, out = [x for a, b in zip(starts, [*starts[1:], len(rows)]) for x in split(a, b)], []
    several = len(todo) > 1
    while todo:
        a, b = todo.pop(0)
        if several and span(a, b) < limits.min_duration:
            if todo and not long(a, todo[0][1]):
                b = todo.pop(0)[1]
            elif out and not long(out[-1][0], b):
                a = out.pop()[0]
        out.append((a, b))
    return [(rows[a][1], rows[b - 1][2], glued([t for t, _, _ in rows[a:b]])) for a, b in out]


@pytest.mark.parametrize("mode", ["soft", "hard"])
@pytest.mark.parametrize("language", ["en", "zh"])
def test_search_against_brute_force(spark, mode, language):
    rng = random.Random(2)
    tokens, want = [], {}
    for w in range(25):
        at, rows = 0.0, []
        for _ in range(rng.randint(1, 60)):
            at += rng.choice([0, 0, 0, 0.1, 0.9])
            rows.append((rng.choice(["word", "and", "(", "x)", "1", "2", "long,", "end.", "好", "it's", "another"]), round(at, 3), round(at + rng.choice([0.2, 0.3, 0.7]), 3)))
            at = rows[-1][2]
        tokens += [("m", w, i, *r, language) for i, r in enumerate(rows)]
        want[w] = brute_cues(rows, language, mode == "hard")
    given = spark.createDataFrame(tokens, "media_id string, window_index int, pos int, text string, start double, end double, language string")
    got = {}
    for r in S.segmented(given.repartition(3), KEYS, mode).orderBy("window_index", "id").collect():
        got.setdefault(r.window_index, []).append((r.start, r.end, r.text))
    assert got == want


def test_long_runs_take_linear_time_per_level(spark):
    rows = [(("m", 1, i, "word" + "." * (i % 9 == 8), i * 0.3, i * 0.3 + 0.3, "en")) for i in range(30_000)]
    given = spark.createDataFrame(rows, "media_id string, window_index int, pos int, text string, start double, end double, language string")
    assert S.segmented(given, KEYS, "hard").count() == 3334


def test_sentence_splitter(spark):
    said = 'He said "No." Then left... Why? 好。不好！「是」 3.5 is one'
    assert one(spark, T.sentences(F.lit(said))) == ['He said "No."', "Then left...", "Why?", "好。", "不好！", "「是」 3.5 is one"]
    rows = [(w, i, i + 0.5) for i, w in enumerate("Mr . Smith went. Then he came".split())]
    cues = lambda splitter: [r.text for r in S.segmented(words(spark, rows), KEYS, "none", splitter=splitter).orderBy("id").collect()]
    assert cues(lambda text: F.array(F.lit("Mr. Smith went."), F.lit("Then he came"))) == ["Mr. Smith went.", "Then he came"]
    assert cues(T.sentences) == ["Mr.", "Smith went.", "Then he came"]
    for bad in (["Mr. Smi", "th went. Then he came"], ["Mr. Smith went."], ["Mr. Smith went.", "Then she came"]):
        assert cues(lambda text, bad=bad: F.array(*map(F.lit, bad))) == ["Mr.", "Smith went.", "Then he came"]


def replies_of(spark, said, texts):
    atoms = spark.createDataFrame([("m", 1, i + 1, w, float(i), i + 1.0) for i, w in enumerate(texts)], "media_id string, window_index int, atom_id int, text string, start double, end double")
    row = S.parsed_replies(spark.createDataFrame([("m", 1, said)], "media_id string, window_index int, reply string"), atoms, KEYS).first()
    return row.ends, row.error, row.times


def test_replies_of_delimiters(spark):
    six = "one two three four five six".split()
    assert replies_of(spark, "one two three four| five six", six) == ([4, 6], None, None)
    assert replies_of(spark, "```\none| two three\nfour |five six\n```", six) == ([1, 4, 6], None, None)
    assert replies_of(spark, "one two three four five six", six) == ([6], None, None)
    assert replies_of(spark, "one two 3 four five six", six) == ([], S.CHANGED, None)
    assert replies_of(spark, None, six) == ([], S.CHANGED, None)
    assert replies_of(spark, "o|ne", ["one"]) == ([], S.UNMAPPED, None)
    assert replies_of(spark, "こんに|ちは世界だ", ["こんにちは", "世界だ"]) == ([1, 2], None, [pytest.approx(0.6)])
    # Two delimiters at one boundary: the first gives the time; one at a boundary is snapped with the others.
    assert replies_of(spark, "ab|c|d|ef|gh", ["abcd", "ef", "gh"]) == ([1, 2, 3], None, [pytest.approx(0.5), pytest.approx(2.0)])


def test_context_punctuation(spark):
    def punctuated(texts, context):
        atoms = [("m", 1, i, w, float(i), i + 1.0) for i, w in enumerate(texts)]
        given = spark.createDataFrame(atoms, "media_id string, window_index int, pos int, text string, start double, end double")
        said = spark.createDataFrame([("m", 1, context)], "media_id string, window_index int, context string")
        return [r.text for r in S.with_context_punctuation(given, said, KEYS).orderBy("atom_id").collect()]

    assert punctuated(["Hello", "world"], "Hello world!") == ["Hello", "world!"]
    assert punctuated(["Hello."], 'Hello."') == ['Hello."']
    assert punctuated(["a", "zz", "b"], "a, c b.") == ["a", "zz", "b."]
    assert punctuated(["a"], None) == ["a"]


def brute_alignment(ref, heard):
    n, m = len(ref), len(heard)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                score[i][j] = max(([score[i - 1][j - 1] + (2 if ref[i - 1] == heard[j - 1] else -1)] if i and j else []) + ([score[i - 1][j] - 2] if i else []) + ([score[i][j - 1] - 2] if j else []))
    out, i, j = [-1] * n, n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + (2 if ref[i - 1] == heard[j - 1] else -1):
            i, j = i - 1, j - 1
            out[i] = j
        elif i and score[i][j] == score[i - 1][j] - 2:
            i -= 1
        else:
            j -= 1
    return out


def test_alignment(monkeypatch):
    for ref, heard, want in [("abc", "abc", [0, 1, 2]), ("ac", "abc", [0, 2]), ("abc", "ac", [0, -1, 1]), ("", "abc", []), ("abc", "", [-1, -1, -1])]:
        assert align.aligned(ref, heard).tolist() == want
    rng = random.Random(3)
    for _ in range(60):
        ref, heard = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 25))) for _ in range(2))
        assert align.aligned(ref, heard).tolist() == brute_alignment(ref, heard)
    same = "ab" * 1200
    assert align.aligned(same, same).tolist() == list(range(2400))
    monkeypatch.setattr(align_matrix, "FULL_CELLS", 1)
    for _ in range(20):
        ref = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 40)))
        assert align.aligned(ref, ref[: len(ref) // 2] + "x" + ref[len(ref) // 2 :]).tolist() == brute_alignment(ref, ref[: len(ref) // 2] + "x" + ref[len(ref) // 2 :])


def score_of(ref, heard, places):
    """Score of an alignment: matches and mismatches, and a gap for each character of either text without a partner."""
    hits = [(i, j) for i, j in enumerate(places) if j >= 0]
    assert [j for _, j in hits] == sorted({j for _, j in hits})
    return sum(2 if ref[i] == heard[j] else -1 for i, j in hits) - 2 * (len(ref) - len(hits)) - 2 * (len(heard) - len(hits))


def test_alignment_in_halves(monkeypatch):
    """Parts of a few cells give the score of the whole matrix."""
    monkeypatch.setattr(align_matrix, "FULL_CELLS", 30)
    monkeypatch.setattr(align_matrix, "band_for", lambda n, m: m)
    rng = random.Random(11)
    for _ in range(40):
        ref, heard = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(2))
        assert score_of(ref, heard, anchors.aligned_in_halves(ref, heard).tolist()) == score_of(ref, heard, brute_alignment(ref, heard))


def test_alignment_in_bands(monkeypatch):
    """Many pairs side by side have the whole matrix's alignment, ties too, also where the best path leaves the first bands."""
    monkeypatch.setattr(align_matrix, "BAND_FIRST", 1)
    rng = random.Random(15)
    text = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randint(0, n)))
    pairs = [(text("ab", 40), text("abc", 90)) for _ in range(150)] + [(a, noisy(rng, a)) for a in (text("abcdef", 200) for _ in range(50))]
    pairs += [("abc", "abc" * 30), ("abc" * 30, "abc"), ("xyz" + "a" * 50, "a" * 50 + "xyz"), ("", "a"), ("a", ""), ("", "")]
    for held in (16_000_000, 3_000):
        monkeypatch.setattr(align_matrix, "HELD_CELLS", held)
        found = align_matrix.aligned_many(pairs)
        assert all(p is None or p.tolist() == align.aligned(*x).tolist() for x, p in zip(pairs, found))
        assert held == 3_000 or not any(p is None for p in found)
    assert all(score_of(*x, p.tolist()) == score_of(*x, align.aligned(*x).tolist()) for x, p in zip(pairs, anchors.aligned_pairs(pairs)))


def test_places_of_many_names(spark, monkeypatch):
    """Short pairs go side by side, none of them through a matrix of its own; null and empty ones are told apart."""
    monkeypatch.setattr(anchors, "aligned", None)
    assert [p.tolist() for p in anchors.aligned_pairs([("abc", "ac"), ("", "b"), ("b", "")] * 500)][:3] == [[0, -1, 1], [], [-1]]
    rows = spark.createDataFrame([("abc", "ac"), (None, "b"), ("b", None), ("", "b"), ("b", "")], "ref string, heard string")
    assert [r[0] for r in rows.select(align.character_places(F.col("ref"), F.col("heard"))).collect()] == [[0, -1, 1], None, None, [], [-1]]


def test_equal_pairs_are_aligned_once(monkeypatch):
    """What repeats in a batch goes through one matrix and stands at each of its places; nulls do not come here, empty texts do."""
    seen, many = [], align_matrix.aligned_many
    monkeypatch.setattr(align_matrix, "aligned_many", lambda pairs: seen.extend(pairs) or many(pairs))
    pairs = [("abc", "ac"), ("ac", "abc"), ("", "b"), ("abc", "ac"), ("", "b")] * 400
    assert [p.tolist() for p in anchors.aligned_pairs(pairs)] == [align.aligned(*p).tolist() for p in pairs]
    assert sorted(seen) == sorted(set(pairs))


def test_pairs_of_names_are_dealt_out(spark, tmp_path):
    """One small file is scanned and joined by one task; its pairs are aligned by as many as a shuffle has."""
    from cueloom.plans.queries import QUERIES

    names = "large ring", "hot bolt", "old plate", "cold plate"
    spark.createDataFrame([(k, names[k % 4]) for k in range(101)], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = QUERIES["aln_characters"](spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    bare = [n.replace(" ", "") for n in names]
    want = {k: ",".join(map(str, align.aligned(bare[k % 4], bare[(k + 1) % 4]).tolist())) for k in range(100)}
    assert {r.p_partkey: r.places for r in rows.collect()} == want


def test_anchors_are_found_without_a_row_a_gram(spark):
    """Nothing is shuffled to find the blocks."""
    given = spark.createDataFrame([("m", "abcdefghij" * 99, "abcdefghij" * 99)], "media_id string, ref string, heard string")
    assert "Exchange" not in anchors.blocks_of(given, full_cells=1000)._jdf.queryExecution().executedPlan().toString()
    rng = random.Random(16)
    for _ in range(30):
        ref, heard = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(2))
        grams = lambda t: [t[k : k + 4] for k in range(len(t) - 3)]
        want = [(i, grams(heard).index(g)) for i, g in enumerate(grams(ref)) if grams(ref).count(g) == 1 == grams(heard).count(g)]
        assert anchors.anchored(ref, heard, 4) == want


def test_longest_chain():
    rng = random.Random(12)
    for _ in range(50):
        j = rng.sample(range(30), rng.randint(0, 12))
        i = sorted(rng.sample(range(30), len(j)))
        chain = anchors.longest_chain(i, j)
        assert all(i[a] < i[b] and j[a] < j[b] for a, b in zip(chain, chain[1:]))
        best = [0] * len(j)
        for b in range(len(j)):
            best[b] = 1 + max([best[a] for a in range(b) if j[a] < j[b]], default=0)
        assert len(chain) == max(best, default=0)


def noisy(rng, text):
    """Some characters changed, some left out, some put in."""
    return "".join(rng.choice("xyz") if (r := rng.random()) < 0.03 else "" if r < 0.05 else c + "q" * (r < 0.07) for c in text)


def test_alignment_by_anchors(spark):
    """Cut at anchors, texts have the alignment of the whole matrix, but for ties within a run of equal characters."""
    rng = random.Random(13)
    texts = []
    for k in range(12):
        ref = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(300, 600)))
        heard = noisy(rng, ref)
        at = rng.randrange(len(ref))
        texts.append((f"m{k}", ref, heard[: at // 2] + heard[at:] if k % 3 == 0 else heard))
    texts += [("empty", "", ""), ("deaf", "abc" * 200, ""), ("other", "ab" * 300, "xy" * 300)]
    given = spark.createDataFrame(texts, "media_id string, ref string, heard string")
    blocks = anchors.blocks_of(given, gram=8, block=60, full_cells=1000).collect()
    assert max(len(b.ref) * len(b.heard) for b in blocks if b.media_id.startswith("m")) < 600 * 600 / 2
    for media_id, ref, heard in texts:  # the blocks are the texts, in order
        own = sorted((b.ref_at, b.heard_at, b.ref, b.heard) for b in blocks if b.media_id == media_id)
        assert "".join(b[2] for b in own) == ref and "".join(b[3] for b in own) == heard
    runs = anchors.matched_runs(spark.createDataFrame(blocks, "media_id string, ref_at int, heard_at int, ref string, heard string")).collect()
    for media_id, ref, heard in texts:
        places = [-1] * len(ref)
        for r in runs:
            if r.media_id == media_id:
                places[r.i : r.i + r.n] = range(r.j, r.j + r.n)
        whole = score_of(ref, heard, align.aligned(ref, heard).tolist())
        assert whole - 12 <= score_of(ref, heard, places) <= whole


def test_long_media_is_aligned_in_blocks(spark):
    """A hundred thousand characters: the matrix would have ten thousand million cells."""
    rng = random.Random(14)
    said = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(18_000)]
    heard = [w if rng.random() > 0.1 else rng.choice(["zz", "zzzzz"]) for w in said]
    words = spark.createDataFrame([("m", k, w, float(k), k + 0.5) for k, w in enumerate(heard)], "media_id string, pos int, text string, start double, end double")
    own = spark.createDataFrame([("m", k, " ".join(said[10 * k : 10 * k + 10]), "en") for k in range(1800)], "media_id string, line_no int, text string, language string")
    got = {r.line_no: (r.start, r.end) for r in align.matched_lines(own, words).collect()}
    assert len(got) == 1800
    near = [k for k in got if got[k][0] is not None and abs(got[k][0] - 10 * k) <= 1 and abs(got[k][1] - (10 * k + 9.5)) <= 1]
    assert len(near) >= 0.98 * len(got)


@pytest.mark.parametrize("share", [0.9, 0.3])
def test_overlapping(spark, share):
    """Every pair once, whatever the lengths: points, hours beside seconds, touching ends, bounds below zero."""
    rng = random.Random(15)
    rows = [(rng.choice("ab"), k, float(a := rng.choice([rng.uniform(-50, 50), rng.randint(-50, 50)])), a + float(rng.choice([0, 0.5, 1, 3, -2, rng.expovariate(0.1), 900, 20_000]))) for k in range(160)]
    rows += [(None, 900, 0.0, 1.0), ("a", 901, None, 1.0), ("a", 902, 0.0, None)]
    left = spark.createDataFrame(rows[:70] + rows[160:], "k string, x int, a double, b double")
    right = spark.createDataFrame(rows[70:], "k string, y int, c double, d double")
    got = [(r.x, r.y) for r in overlaps.overlapping(left, right, ("a", "b"), ("c", "d"), ["k"], share).collect()]
    want = [(p[1], q[1]) for p in rows[:70] for q in rows[70:160] if p[0] == q[0] and p[3] > p[2] and q[3] > q[2] and p[2] < q[3] and q[2] < p[3]]
    assert sorted(got) == sorted(want) and len(want) > 500
    assert overlaps.overlapping(left.limit(0), right, ("a", "b"), ("c", "d"), ["k"]).count() == 0


def test_overlaps_of_a_hot_media_are_linear(spark):
    """One media with twice the intervals at the same density has about twice the rows behind the bins' join, not four times."""
    def looked_at(n):
        rows = spark.range(n).selectExpr("'m' k", "id x", "id * 1.0D a", "id + case when id % 100 = 0 then 300 else 2.5D end b")
        found = overlaps.overlapping(rows, rows.selectExpr("k", "x y", "a c", "b d"), ("a", "b"), ("c", "d"), ["k"])
        return found.count()

    assert looked_at(40_000) < 2.2 * looked_at(20_000)


def lines(spark, texts):
    return spark.createDataFrame([("m", i, t, "en") for i, t in enumerate(texts)], "media_id string, line_no int, text string, language string")


def test_matched_lines(spark):
    heard = words(spark, [("hello", 0, 0.5), ("world", 1, 1.5)]).drop("language")
    got = align.matched_lines(lines(spark, ["hello", "missing", "world"]), heard).orderBy("line_no").collect()
    assert [(r.start, r.end) for r in got] == [(0, 0.5), (None, None), (1, 1.5)]
    twice = words(spark, [("hello", 0, 0.5), ("again", 1, 1.5), ("hello", 2, 2.5)]).drop("language")
    got = align.matched_lines(lines(spark, ["hello", "hello"]), twice).orderBy("line_no").collect()
    assert [(r.start, r.end) for r in got] == [(0, 0.5), (2, 2.5)]
    lonely = words(spark, [("hello", 50, 50.5)]).drop("language")
    assert bounds(align.aligned_lines(lines(spark, ["hello"]), lonely, media(spark, 60)), "line_no") == [(50, 50.5)]
    empty = align.matched_lines(lines(spark, ["hello"]), heard.limit(0)).collect()
    assert [(r.start, r.end) for r in empty] == [(None, None)]


def test_spans(spark):
    """Filled and finished spans by what they have to be."""
    rng = random.Random(4)
    schema = "media_id string, line_no int, start double, end double"
    cases = [([(0, 1), (None, None), (None, None), (4, 5)], 10), ([(0, 8), (2, 3)], 5), ([(0.3, 0.4)], 0.1), ([(None, None)] * 3, 10)]
    cases += [([(None, None) if rng.random() < 0.4 else (a := rng.uniform(0, 20), a + rng.uniform(-1, 4)) for _ in range(12)], rng.choice([5, 15, 30])) for _ in range(10)]
    rows = [(str(c), i, None if a is None else float(a), None if b is None else float(b)) for c, (own, _) in enumerate(cases) for i, (a, b) in enumerate(own)]
    given = spark.createDataFrame(rows, schema)
    durations = spark.createDataFrame([(str(c), float(d)) for c, (_, d) in enumerate(cases)], "media_id string, duration double")
    by = lambda df: {c: [(r.start, r.end) for r in sorted(df_rows, key=lambda r: r.line_no)] for c, df_rows in group(df.collect()).items()}

    def group(found):
        out = {}
        for r in found:
            out.setdefault(int(r.media_id), []).append(r)
        return out

    filled, finished = by(spans.filled_spans(given)), by(spans.finished_spans(given, durations))
    assert filled[0] == [(0, 1), (2, 3), (3, 4), (4, 5)] and filled[3] == [(0, 1)] * 3
    assert finished[1] == [(0, 2), (2, 3)] and finished[2] == [(0, pytest.approx(0.1))]
    for c, (own, duration) in enumerate(cases):
        known = [i for i, (a, b) in enumerate(own) if a is not None and b > a]
        assert all(filled[c][i] == pytest.approx(own[i]) for i in known)  # anchors are kept
        for p, q in zip(known, known[1:]):  # what is between two anchors is spread evenly from the one's end to the other's start
            starts = [filled[c][i][0] for i in range(p + 1, q)] + [own[q][0]]
            assert np.diff([own[p][1], *starts]) == pytest.approx([(own[q][0] - own[p][1]) / (q - p)] * (q - p))
        got = finished[c]
        assert all(0 <= a <= b + 1e-9 and b <= duration + 1e-9 for a, b in got)
        assert all(a <= x for (a, _), (x, _) in zip(got, got[1:]))
        assert all(b <= x + 1e-9 or b <= a + 0.5 + 1e-9 for (a, b), (x, _) in zip(got, got[1:]))  # overlaps only where a span would have no length


def test_frames_are_linear(spark):
    """Twice the lines of one media take about twice the time, not four times."""
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("'m' media_id", "cast(id as int) line_no", "if(id % 7 = 0, id * 2.0D, null) start", "if(id % 7 = 0, id * 2.0D + 1, null) end")
        began = time.time()
        assert spans.filled_spans(rows).where("start is null").count() == 0
        return time.time() - began

    seconds(1000)
    assert seconds(200_000) < 20


def test_best_cuts_of_equal_scores(spark):
    """Scores that differ in their last bits alone are equal: the first cut is taken."""
    rows = [("m", 1, k, "あああ、" if k in (3, 7) else "ああああ", g * 12.3 + k * 2.0, g * 12.3 + k * 2.0 + 1.9, g) for g in range(200) for k in range(1, 11)]
    given = spark.createDataFrame(rows, "media_id string, window_index int, atom_id int, text string, start double, end double, group_id int")
    assert {r.atom_id for r in S.best_cuts(given, ["media_id", "window_index"], F.lit("en")).collect()} == {4}


def test_replies(spark):
    rows = [("m", 0, '[{"i": 1, "t": " a "}, {"i": 2, "t": "b"}]'), ("m", 1, '{"items": [{"i": 2, "t": "b"}]}'), ("m", 2, '[{"i": "1", "t": "a"}]'), ("m", 3, '[{"i": 1, "t": 5}]'), ("m", 4, '[{"i": 1, "t": "a"}, {"i": 1, "t": "b"}]'), ("m", 5, '[{"i": 9, "t": "a"}]'), ("m", 6, "not json"), ("m", 7, "[3]"), ("m", 8, None), ("m", 9, '{"i": 1}')]
    asked = spark.createDataFrame([(*r, [1, 2]) for r in rows], "media_id string, batch_id int, reply string, ids array<int>")
    assert sorted((r.batch_id, r.id, r.text) for r in R.corrections(asked).collect()) == [(0, 1, "a"), (0, 2, "b"), (1, 2, "b")]
    assert sorted((r.batch_id, r.id) for r in R.translations(asked).collect()) == [(0, 1), (0, 2)]
    items = spark.createDataFrame([('{"word": "w", "start_time": 1, "end_time": 2.5}',)], "item string")
    assert [tuple(r) for r in R.timed_items(items).collect()] == [("w", 1.0, 2.5)]
    with pytest.raises(Exception, match="invalid timed item"):
        R.timed_items(spark.createDataFrame([('{"text": "w", "start": 1}',)], "item string")).collect()


ARTIFACT = "media_id string, window_index int, start double, end double, version int, model_id string, mtime long, kind string, language string, transcript_sha1 string, payload string"


def test_artifacts(spark):
    rows = [("m", 1, 0.0, 1.0, 1, "a", 10, "asr", None, None, "t"), ("m", 1, 0.0, 1.0, 1, "a", 11, "alignment", "en", None, "p"), ("old", 1, 0.0, 1.0, 1, "a", 1, "asr", None, None, "x"), ("m", 2, 1.0, 2.0, 1, "a", 12, "asr", None, None, "u")]
    held = spark.createDataFrame(rows, ARTIFACT)
    asked = spark.createDataFrame([("m", 1, 0.0, 1.0, None), ("m", 2, 1.0, 2.5, None), ("old", 1, 0.0, 1.0, "en")], "media_id string, window_index int, start double, end double, hint string")
    assert sorted((r.media_id, r.window_index, r.payload) for r in A.with_asr(asked, held, "a").collect() if r.payload) == [("m", 1, "t")]
    same = spark.createDataFrame([("m", 1, 0.0, 1.0, 1, "a", 20, "asr", None, None, "t")], ARTIFACT)
    other = spark.createDataFrame([("m", 1, 0.0, 1.0, 1, "a", 20, "asr", None, None, "changed")], ARTIFACT)
    assert A.upserted(held, same).count() == 4 and A.upserted(held, other).where("kind = 'alignment'").count() == 0
    assert [r.media_id for r in A.evicted(held, held.where("media_id = 'm'"), 1).collect()] == ["old"]
    assert A.evicted(held, held.limit(0), 0).count() == 0
    assert sorted((r.media_id, r.window_index) for r in A.active_only(held, asked.where("window_index = 1 and media_id = 'm'")).collect()) == [("m", 1), ("m", 1), ("old", 1)]


def test_newest_payloads(spark):
    """Of equally new artifacts the least payload, in whatever order they come."""
    rows = [("m", "asr", f"said {k}", 7 if k % 3 else 5) for k in range(40)]
    for given in (rows, rows[::-1]):
        (got,) = A.newest_payloads(spark.createDataFrame(given, "media_id string, kind string, payload string, mtime long")).collect()
        assert tuple(got) == ("m", "asr", "said 1", 7)


def test_providers(spark):
    tries = []

    def flaky(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise providers.ReplyError("busy")
        return "done"

    assert providers.with_retries(flaky, "p", 2, lambda s: None) == "done" and len(tries) == 3
    with pytest.raises(providers.ReplyError):
        providers.with_retries(lambda p: (_ for _ in ()).throw(providers.ReplyError("no", final=True)), "p", 2, lambda s: None)
    assert providers.final_status(404) and not providers.final_status(429) and not providers.final_status(500)
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string")
    said = providers.replied(prompts, lambda: lambda p: p.upper() if p == "a" else 1 / 0, retries=0).orderBy("prompt").collect()
    assert said[0].reply == "A" and said[1].error == "ZeroDivisionError: division by zero"


def test_hybrid_choice(spark):
    groups = spark.createDataFrame([("m", 1, 1, 0.0, 1.0, "short", False), ("m", 1, 2, 1.0, 9.0, "too long", True), ("m", 1, 3, 9.0, 19.0, "also long", True)], "media_id string, window_index int, group_id int, start double, end double, text string, overlong boolean")
    schema = "media_id string, window_index int, group_id int, id int, start double, end double, text string"
    new = spark.createDataFrame([("m", 1, 2, 1, 1.0, 5.0, "too"), ("m", 1, 2, 2, 5.0, 9.0, "long"), ("m", 1, 3, 1, 9.0, 19.0, "alsolong")], schema)
    hard = spark.createDataFrame([("m", 1, 3, 1, 9.0, 14.0, "also"), ("m", 1, 3, 2, 14.0, 19.0, "long"), ("m", 1, 2, 1, 1.0, 9.0, "unused")], schema)
    assert [(r.id, r.text) for r in S.chosen_cues(groups, new, hard, KEYS).orderBy("id").collect()] == [(1, "short"), (2, "too"), (3, "long"), (4, "also"), (5, "long")]
