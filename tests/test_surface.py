"""Table functions, the learned splitter and the cap on requests."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators import providers, segment as S, splitter
from cueloom.plans import table_functions
from cueloom.shared import scratch, shared_table

KEYS = ["media_id", "window_index"]
TOKENS = "media_id string, window_index int, pos int, text string, start double, end double, language string"


def spoken(rng, key, window, language):
    """Words with marks, pauses, odd white space, equal times and lengths below zero."""
    words = {"en": ["Hello", "and", "so,", "end.", "(x", "y)", "it's", "7", "8", " ", "why?\"", "but", "long" * 6], "ja": ["これ", "は。", "テスト", "「a", "b」", "漢字、"], None: ["und", "漢字", "ok.", "wait,"]}[language]
    at, out = 0.0, []
    for pos in range(rng.randint(0, 60)):
        at += rng.choice([0, 0, 0.1, 0.7, 2.5])
        out.append((key, window, pos, rng.choice(words), at, at + rng.choice([0.3, 0.5, 1.5, 0, -0.2]), language if rng.random() < 0.8 else None))
        at += 0.3
    return out


def test_cues_by_sql(spark):
    rng = random.Random(21)
    rows = [r for k in range(40) for r in spoken(rng, f"m{k % 7}", k, rng.choice(["en", "en", "ja", None]))]
    rows += [("x", 1, 0, None, 0.0, 1.0, "en"), ("x", 1, 1, "a", None, 1.0, "en"), ("x", 1, 2, "b", 0.0, None, "en")]
    tokens = spark.createDataFrame(rows, TOKENS)
    table_functions.register(spark)
    for mode in ("none", "soft", "hard"):
        got = spark.sql(f"select * from readable_cues(table(select * from {{tokens}}) partition by (media_id, window_index), '{mode}')", tokens=tokens)
        assert got.columns == [*KEYS, "id", "start", "end", "text"]
        want = S.segmented(tokens.where("text is not null and start is not null and end is not null"), KEYS, mode).select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="unknown mode"):
        spark.sql("select * from readable_cues(table(select * from {tokens}) partition by (media_id), 'odd')", tokens=tokens)
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("select * from packed_windows(table(select media_id from {tokens}) partition by media_id)", tokens=tokens)


def test_cues_by_sql_of_lists(spark):
    """A window as one row of lists has the cues of its tokens' rows."""
    rng = random.Random(22)
    tokens = spark.createDataFrame([r for k in range(30) for r in spoken(rng, f"m{k % 7}", k, rng.choice(["en", "ja", None]))] + [("x", 1, 0, None, 0.0, 1.0, "en"), ("x", 1, 2, "b", 0.0, None, "en")], TOKENS)
    table_functions.register(spark)
    rows = "select * from {tokens}"
    lists = "select media_id, window_index, w.pos, w.text, w.start, w.end, w.language from (select media_id, window_index, collect_list(struct(pos, text, start, end, language)) w from {tokens} group by media_id, window_index)"
    one, other = (spark.sql(f"select * from readable_cues(table({x}) partition by (media_id, window_index), 'hard')", tokens=tokens).collect() for x in (rows, lists))
    assert one and sorted(map(tuple, one)) == sorted(map(tuple, other))


def prose(rng, n):
    """Sentences with abbreviations inside, with the true ends."""
    shorts, names = ["Dr.", "approx.", "z.B.", "No."], ["Smith", "Jones", "Marple", "Five"]
    starts, words = ["The", "This", "When", "However"], [f"word{chr(97 + k)}" for k in range(20)]
    out = []
    for _ in range(n):
        said = [rng.choice(starts)]
        for _ in range(rng.randint(4, 12)):
            said += [rng.choice(shorts), rng.choice(names)] if rng.random() < 0.15 else [rng.choice(words)]
        said += [rng.choice(["end", *words])]
        out.append(" ".join(said) + rng.choice([".", ".", "!", "?"]))
    return out


def test_learned_splitter(spark):
    """Held-out texts: the default cuts behind abbreviations, the learned one does not."""
    rng = random.Random(22)
    texts = spark.createDataFrame([(" ".join(prose(rng, 12)),) for _ in range(60)] + [(None,), ("",)], "text string")
    model = splitter.learned(texts)
    assert {"dr", "approx", "z.b", "no"} <= set(model.abbreviations) and not {f"word{chr(97 + k)}" for k in range(20)} & set(model.abbreviations)
    assert {"the", "this", "when", "however"} <= set(model.starters)
    truth = [prose(rng, 10) for _ in range(30)]
    held = spark.createDataFrame([(k, " ".join(s)) for k, s in enumerate(truth)], "k int, text string")
    split = splitter.splitter(model)
    got = {r.k: (r.plain, r.learned) for r in held.select("k", T.sentences(F.col("text")).alias("plain"), split(F.col("text")).alias("learned")).collect()}
    right = sum(got[k][1] == s for k, s in enumerate(truth))
    assert right >= 28 and sum(got[k][0] == s for k, s in enumerate(truth)) < 5
    odd = spark.createDataFrame([("",), (None,), ("Dr. Smith",), ("He saw Dr. The end.",), ("a. b",), ("One. Two",)], "text string").select(split(F.col("text"))).collect()
    assert [r[0] for r in odd] == [[], None, ["Dr. Smith"], ["He saw Dr.", "The end."], ["a. b"], ["One.", "Two"]]
    words = spark.createDataFrame([("m", 1, i, w, float(i), i + 0.9, "en") for i, w in enumerate("We met Dr. Smith there. The end.".split())], TOKENS)
    cues = lambda f: [r.text for r in S.segmented(words, KEYS, "none", splitter=f).orderBy("id").collect()]
    assert cues(split) == ["We met Dr. Smith there.", "The end."] and cues(T.sentences) == ["We met Dr.", "Smith there.", "The end."]


def test_nothing_to_learn_from(spark):
    none = splitter.learned(spark.createDataFrame([], "text string"))
    assert none == splitter.Model()
    one = spark.createDataFrame([("One. Two.",)], "text string").select(splitter.splitter(none)(F.col("text"))).first()[0]
    assert one == ["One.", "Two."]


def noting(folder):
    """A loader of a model that notes when each request begins and ends."""

    def load():
        import uuid
        from pathlib import Path

        def ask(prompt):
            began = time.time()
            time.sleep(0.05)
            Path(folder, uuid.uuid4().hex).write_text(f"{began} {time.time()} {prompt}")
            return prompt.upper()

        return ask

    return load


def notes(folder):
    return [(float(a), float(b), p) for a, b, p in (f.read_text().split(" ", 2) for f in folder.iterdir())]


@pytest.mark.parametrize("most", [1, 3, 5])
def test_requests_are_capped_in_the_whole(spark, tmp_path, most):
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(40)], "k int, prompt string").repartition(8)
    got = providers.replied(prompts, noting(str(tmp_path)), concurrency=most).collect()
    assert {(r.k, r.reply, r.error) for r in got} == {(k, f"P{k}", None) for k in range(40)}
    asked = notes(tmp_path)
    assert len(asked) == 40
    # What is under way changes at beginnings and ends; an end at the time of a beginning comes first.
    moments = sorted([(a, 1) for a, _, _ in asked] + [(b, -1) for _, b, _ in asked])
    now = peak = 0
    for _, step in moments:
        now += step
        peak = max(peak, now)
    assert peak <= most and (most == 1 or peak > 1)


def test_an_attempt_that_runs_again_asks_only_the_rest(tmp_path):
    first, again = (providers.Ledger(f"file://{tmp_path}", 3) for _ in range(2))
    assert first.known() == {}
    first.note([("a", "A"), ("b", "B")])
    (tmp_path / "3" / "cut.json").write_text('[["c", "C"')
    assert again.known() == {"a": ["A", None], "b": ["B", None]} and providers.Ledger(str(tmp_path), 4).known() == {}


def test_equal_prompts_and_errors(spark):
    def load():
        def ask(prompt):
            if prompt == "bad":
                raise providers.ReplyError("no", final=True)
            return prompt

        return ask

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, "")], "k int, prompt string")
    got = sorted(map(tuple, providers.replied(rows, load, 2).collect()))
    assert got == [(1, "a", "a", None), (2, "a", "a", None), (3, "bad", None, "ReplyError: no"), (4, "", "", None)]
    assert providers.replied(rows.limit(0), load).count() == 0


def test_scratch_tables_end_with_their_block(spark):
    folder = lambda df: df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    kept = folder(shared_table(spark.range(3)))
    with scratch(spark):
        outer = folder(shared_table(spark.range(3)))
        with scratch(spark):
            inner = folder(shared_table(spark.range(3)))
            assert all(map(os.path.isdir, (kept, outer, inner)))
        assert os.path.isdir(outer) and not os.path.exists(inner)
    assert os.path.isdir(kept) and not os.path.exists(outer)
