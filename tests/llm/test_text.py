"""Decontamination, languages, pieces, token files and chats against brute force and their libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F

from cueloom.llm import chat_format, decontaminate, language_id, pieces, token_files

SCHEMA = "doc_id long, text string, lang string, items string, key string, ids string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(documents, items):
    out = []
    for i, t in documents:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            m = min(10, len(v))
            grams = {tuple(v[p : p + m]) for p in range(len(v) - m + 1)} if v else set()
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in grams:
                    hit |= set(range(p, p + m))
                    if item is not None:
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [15, 25])
def test_contamination(spark, monkeypatch, bits):
    """With few bits most foreign fingerprints reach the join."""
    monkeypatch.setattr(decontaminate, "TABLE_BITS", bits)
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "c", "dé", "É", "1", "zz", "ß"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 9, 10, 11, 14, 40])))) for i in range(30)]
    items += [(None, "null item text"), (50, None), (51, ""), (52, "..."), (3, "second text of three")]
    rows = []
    for i in range(80):
        parts = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            other = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(other) - 3))
            at = rng.randint(0, len(parts))
            parts[at:at] = other[a : a + rng.randint(3, 20)]
        rows.append((i, ", ".join(parts).title()))
    rows += [(100, None), (101, ""), (102, "x " * 100_000 + "SECOND text-of.three"), (103, "null item text"), (103, "null item text"), (None, "second text of three")]
    got = decontaminate.contamination(docs(spark, rows), bench(spark, items)).select("doc_id", "n_words", "spans", "items").collect()
    want = brute_hits(rows, items)
    seen = [(r.doc_id, r.n_words, sum(b - a for a, b in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans)) for r in got]
    assert sorted(seen, key=str) == want
    clean = decontaminate.drop_contaminated(docs(spark, rows), bench(spark, items))
    assert clean.columns == ["doc_id", "text", "lang", "items", "key", "ids"]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in want if not x[5])


def test_contamination_empty(spark):
    assert decontaminate.contamination_report(docs(spark, []), bench(spark, [(1, "a b")])).count() == 0
    got = decontaminate.contamination_report(docs(spark, [(1, "a b")]), bench(spark, [])).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]


def brute_forward(number, table, word, k):
    """Logarithm of the sum over all segmentations, by plain recursion over ends with exact scaling."""
    marked, most = "▁" + word, max(map(len, number))
    alpha = [Fraction(1)] + [Fraction(0)] * len(marked) if len(word) < 30 else None
    logs = [0.0]
    for j in range(1, len(marked) + 1):
        terms = []
        for i in range(max(0, j - most), j):
            chance = table[number[marked[i:j]], k] if marked[i:j] in number else language_id.FLOOR if j - i == 1 else 0.0
            if alpha:
                alpha[j] += alpha[i] * Fraction(chance)
            if chance:
                terms.append(logs[i] + math.log(chance))
        logs.append(max(terms) + math.log(math.fsum(math.exp(x - max(terms)) for x in terms)))
    return math.log(alpha[-1]) if alpha else logs[-1]


def random_model(languages):
    names = language_id.public_pieces()
    table = np.random.default_rng(0).dirichlet(np.ones(len(names)), languages).T
    piece, lang = np.nonzero(table)
    return names, table, language_id.Model(names, [str(k) for k in range(languages)], np.zeros(languages), piece, lang, table[piece, lang])


def test_forward_sums_all_segmentations(monkeypatch):
    names, table, model = random_model(3)
    segmenter, number = language_id.Segmenter(names), {p: i for i, p in enumerate(names)}
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghiétß日") for _ in range(5000))
    some = ["a", "the", "unbelievable", "écoute", "straße", "日本", "x" * 40, "x" * 41, "ǌ", long]
    want = [[brute_forward(number, table, w, k) for k in range(3)] for w in some]
    for cells in (language_id.CELLS, 200):  # in blocks and chunks of a few, and with rows made as they are needed
        monkeypatch.setattr(language_id, "CELLS", cells)
        assert np.allclose(segmenter.scores(model, some), want, rtol=1e-9)
        monkeypatch.setattr(language_id, "SHORT", 5)
        assert np.allclose(segmenter.scores(model, some), want, rtol=1e-9)
        monkeypatch.undo()


def test_expected_counts():
    names, table, model = random_model(2)
    segmenter = language_id.Segmenter(names)
    some, times, langs = ["ab", "unbelievable", "thethethe" * 300], np.array([2.0, 1.0, 3.0]), np.array([1, 0, 1])
    total = np.zeros((len(names), 2))
    for piece, lang, n in segmenter.expected(model, some, times, langs):
        np.add.at(total, (piece, lang), n)
    letters = np.array([len(x.replace("▁", "")) for x in names])
    # Each letter is covered once by the pieces of a segmentation, letters outside the vocabulary apart.
    assert letters @ total == pytest.approx([12, 4 + 3 * 2700], rel=1e-3)
    together = np.zeros_like(total)
    for piece, lang, n in [segmenter._expected_together(model, some[1:2], times[1:2], langs[1:2])]:
        np.add.at(together, (piece, lang), n)
    alone = np.zeros_like(total)
    for piece, lang, n in segmenter._expected_alone(model, some[1], 1.0, 0):
        np.add.at(alone, (piece, lang), n)
    assert np.allclose(together, alone)


def test_words_are_letters_alone():
    assert language_id.words_of("²½① x² Ünï-Code 日本語 12 _") == ["x", "ünï", "code", "日本語"]


def brute_languages(rows, rounds):
    """Fit and prediction by plain loops over one word after the other: {doc_id: (language, score)}."""
    names = language_id.public_pieces()
    longest, usual = max(map(len, names)), set(names)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    said = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    langs = sorted({lang for i, t, lang in rows if lang is not None and t is not None and not held(i)})

    def spans(word, chance):
        return [(i, j, word[i:j], chance(word[i:j])) for j in range(1, len(word) + 1) for i in range(max(0, j - longest), j) if word[i:j] in usual or j - i == 1]

    def sums(word, chance):
        found, alpha, beta = spans(word, chance), [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
        for i, j, _, c in found:
            alpha[j] += alpha[i] * c
        for i, j, _, c in reversed(found):
            beta[i] += c * beta[j]
        return found, alpha, beta

    models = {}
    for lang in langs:
        counts = Counter(w for i, t, own in rows if own == lang and t is not None and not held(i) for w in said(t))
        table = dict.fromkeys(names, 1 / len(names))
        for _ in range(rounds):
            total = Counter()
            for w, n in counts.items():
                found, alpha, beta = sums("▁" + w, lambda x: table.get(x, language_id.FLOOR))
                for i, j, piece, c in found:
                    if piece in usual:
                        total[piece] += n * alpha[i] * c * beta[j] / alpha[-1]
            whole = sum(total.values()) + language_id.SMOOTHING * len(names)
            table = {x: (total[x] + language_id.SMOOTHING) / whole for x in names}
        models[lang] = table
    out = {}
    for i, t, _ in rows:
        logs = {lang: sum(math.log(sums("▁" + w, lambda x: table.get(x, language_id.FLOOR))[1][-1]) for w in said(t)) for lang, table in models.items()}
        best = max(langs, key=lambda x: (logs[x], [-ord(c) for c in x]))
        out[i] = (best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())) if said(t) else ("und", 0.0)
    return out


def test_languages_against_brute_force(spark):
    rng = random.Random(12)
    lists = {"en": "the house and this other thing which café".split(), "de": "das haus und dieses andere ding welches ist".split(), "fi": "talo sekä tämä muut asiat jotka on".split()}
    rows = [(i, " ".join(rng.choice(lists[lang if rng.random() < 0.7 else "en"]) for _ in range(rng.randint(1, 5))), lang) for i in range(60) for lang in [rng.choice(list(lists))]]
    rows += [(100, "das 日本 thing ǌǌ", None), (101, None, "en"), (102, "12 ½", "de"), (103, "talo", None)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=2).collect()
    want = brute_languages(rows, 2)
    assert {r.doc_id: r.lang_pred for r in found} == {i: lang for i, (lang, _) in want.items()}
    for r in found:
        assert r.score == pytest.approx(want[r.doc_id][1], rel=1e-6)
    assert len({lang for lang, _ in want.values()}) == 4


def test_language_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34 !", "en", "s", 0), (None, "the thing", None, "s", 0), (10**6 + 2, "thing " * 50_000, "en", "s", 0)], rows.schema)
    got = language_id.identify(rows.union(extra)).join(rows.select("doc_id", "lang"), "doc_id", "left").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 1004 and (by[10**6].lang_pred, by[10**6].score) == ("und", 0.0) and by[10**6 + 1].lang_pred == "und" and by[10**6 + 2].lang_pred == "en"
    held = [r for r in got if r.held_out and r.lang]
    assert 0.1 < len(held) / len(got) < 0.3
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_rare(spark):
    """Languages with one row each are learned beside one with very many."""
    some = ["the house and this other thing which", "talo sekä tämä muut asiat jotka", "dom oraz ten inne rzeczy które", "ev ve bu başka şeyler ki", "ház meg ez más dolgok amelyek"]
    rows = [(5 * i, some[i // 600 if i % 600 == 7 else 0], str(i // 600 if i % 600 == 7 else 0)) for i in range(600, 3000)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=60)
    assert model.langs == list("01234")
    own = model.rows(np.arange(len(model.pieces)))
    assert (own.max(axis=0) > 2 * own.min(axis=0)).all() and np.allclose(own.sum(axis=0), 1)


def test_language_two_thousand_labels(spark):
    rows = [(10 * i + j, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " * 3, f"l{i:04d}") for i in range(2000) for j in range(2)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=1).collect()
    right = [r.lang_pred == f"l{r.doc_id // 10:04d}" for r in found if not r.held_out]
    assert len(found) == 4000 and sum(right) / len(right) > 0.9


def test_language_rows_each():
    assert language_id.rows_each({"a": 5, "b": 10}, 15) == math.inf
    assert language_id.rows_each({"a": 50, "b": 10_000, "c": 10**9}, 1050) == 500
    assert language_id.rows_each({str(i): 10**6 for i in range(1000)}, 12_000) == language_id.LEAST_ROWS


def test_language_nothing_to_learn(spark):
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs(spark, [(None, "abc")])).collect()] == [("und", 0.0)]
    got = language_id.identify(docs(spark, [(1, "the thing"), (1, "the thing"), (2, "② ½"), (2, None), (3, "the")])).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(1, "en"), (1, "en"), (2, "und"), (2, "und"), (3, "en")]
    kept = language_id.drop_unidentified(docs(spark, [(1, "the thing"), (2, "②"), (3, "thing")]))
    assert kept.columns == ["doc_id", "text", "lang", "items", "key", "ids"] and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert language_id.identify(docs(spark, [])).count() == 0


TEXTS = ["Hello  world\nfoo <s> éあ\U0001f600\t x ", " ", "", " a", "a ", "a▁b", "ﬁ ① ²", "<|endoftext|> it's", "\n\n \n", "aaaa" * 30_000, "日本語 한국어", "a\x1cb\x85c"]


def texts():
    rng = random.Random(1)
    return TEXTS + ["".join(rng.choice("abcdefgh  THE.,-=_/0é\n") for _ in range(120)) for _ in range(200)]


def test_pieces_by_merges_are_the_librarys(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = list(enumerate(texts()))
    encoded = pieces.encoded(docs(spark, [*rows, (999, None), (3, " a")]), by="merges")
    got = [(r.doc_id, r.ids, r.lossless) for r in encoded.collect()]
    want = [(i, library.encode(t), "▁" not in t) for i, t in rows] + [(999, [], True), (3, library.encode(" a"), True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def brute_viterbi(text):
    """Ids of the largest sum of scores, word by word, with the piece lengths tried from the longest."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    ids, scores = {model.id_to_piece(i): i for i in usual}, {i: model.get_score(i) for i in usual}
    longest, unknown, out = max(map(len, ids)), min(scores.values()) - 10, []
    for word in re.findall("▁*[^▁]+|▁+", "▁" + text.replace(" ", "▁")) if text else []:
        best = [(0.0, [])]
        for j in range(1, len(word) + 1):
            options = []
            for n in range(min(j, longest), 0, -1):
                piece, (sum_, path) = word[j - n : j], best[j - n]
                if piece in ids:
                    options.append((sum_ + scores[ids[piece]], (path, [ids[piece]])))
                elif n == 1:
                    options.append((sum_ + unknown, (path, [model.piece_to_id(f"<0x{x:02X}>") for x in piece.encode()])))
            best.append(max(options, key=lambda x: x[0]))
        path, parts = best[-1][1], []
        while path:
            parts.append(path[1])
            path = path[0]
        out += [i for p in reversed(parts) for i in p]
    return out


def test_pieces_have_the_largest_sum(spark):
    rows = list(enumerate(texts()))
    encoded = pieces.encoded(docs(spark, [*rows, (999, None), (3, " a"), (3, " a")]))
    got = [(r.doc_id, r.ids, r.lossless) for r in encoded.collect()]
    want = [(i, brute_viterbi(t), "▁" not in t) for i, t in rows] + [(999, [], True), *[(3, brute_viterbi(" a"), True)] * 2]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = {r.doc_id: r.text for r in pieces.decoded(encoded).collect()}
    assert all(back[i] == t for i, t in rows if "▁" not in t)
    assert pieces.piece_report(docs(spark, [])).count() == 0
    report = {r.doc_id: r for r in pieces.piece_report(docs(spark, rows)).collect()}
    assert all(report[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest() and report[i].n_pieces == len(brute_viterbi(t)) for i, t in rows if "▁" not in t)


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*enumerate(texts(), 5), (-3, None), (2**40, "last"), (7, "twice")]
    got = token_files.stored_report(docs(spark, random.Random(0).sample(rows, len(rows)))).collect()
    start, want = 0, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        if i != 7:
            assert next(r.start for r in got if r.doc_id == i) == start
        start += len(ids)
    assert {i: sorted(v) for i, v in want.items()} == {i: sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i) for i in want}
    assert token_files.stored_report(docs(spark, [])).count() == 0


def test_token_files_skip_by_id(spark, tmp_path):
    """A predicate on doc_id skips stripes: by their least and largest id, and by the Bloom filter for ids between these."""
    path = f"file://{tmp_path}/tokens"
    rows = spark.range(60_000).selectExpr("id * 2 doc_id", "concat('text of ', id) text")
    token_files.write_tokens(rows, path, ranges=2)

    def read(i):
        found = spark.read.schema(token_files.STORED).orc(path).where(f"doc_id = {i}")
        plan = found._jdf.queryExecution().executedPlan()
        assert found._jdf.collectToPython()
        scan = plan
        while scan.children().nonEmpty():
            scan = scan.children().head()
        return found.count(), scan.metrics().apply("numOutputRows").value()

    count, scanned = read(2 * 12_345)
    assert count == 1 and scanned <= 10_000  # one group of rows
    count, scanned = read(2 * 12_345 + 1)
    assert count == 0 and scanned == 0  # between the ids that are there: only the Bloom filter tells


def test_token_files_repeated_ids(spark):
    """Rows of one doc_id are dealt over ranges and have the same offsets each time."""
    rows = [(7, f"text {i}") for i in range(300)] + [(8, "last"), (6, "first")]
    once, again = ([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.stored_report(docs(spark, random.Random(k).sample(rows, len(rows)))).collect()] for k in (1, 2))
    assert sorted(once) == sorted(again)
    ordered = sorted(once, key=lambda r: r[1])
    assert ordered[0][0] == 6 and ordered[-1][0] == 8 and all(a[1] + a[2] == b[1] for a, b in zip(ordered, ordered[1:]))


SAID = [r"\### Assistant: </turn> ok", "", None, "\n<+>\n", "a\n</turn>\n### assistant:\nb", "\\s\\l<#", "plain", "é" * 20_000, "\n", "<", "\\"]


def test_chats(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys:\n#x", None, ""]), rng.choice(SAID), "clash") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "x", "c"), (None, 0, "assistant", "y", "c"), (70, 1, "user", "same", "c"), (70, 1, "user", "same", "c"), (71, None, "assistant", None, "c")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    laid = chat_format.formatted(table)
    got = {r.conv_id: r for r in chat_format.read_back(laid).collect()}
    by = {}
    for c, turn, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    for c, own in by.items():
        own.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in own]
        assert got[c].trained == [t for _, r, t in own if r == "assistant"]
    for r in laid.collect():
        assert sum(x.chars for x in r.loss_runs) == len(r.formatted)
        at, under = 0, []
        for x in r.loss_runs:
            under += [r.formatted[at : at + x.chars]] if x.loss else []
            at += x.chars
        plain = [t.replace("\\l", "<").replace("\\h", "#").replace("\\s", "\\") for t in under]
        assert plain == got[r.conv_id].trained
        assert r.formatted.count("### ") == sum(a[1] != b[1] for a, b in zip(by[r.conv_id], by[r.conv_id][1:])) + 1
    report = {r.conv_id: r for r in chat_format.format_report(table).collect()}
    for c, own in by.items():
        said = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        r = report[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_report(table.limit(0)).count() == 0


def test_chat_mask_that_does_not_fit(spark):
    laid = chat_format.formatted(spark.createDataFrame([(1, 0, "user", "one two"), (1, 1, "assistant", "three")], "conv_id long, turn long, role string, text string"))
    moved = F.transform("loss_runs", lambda r, i: F.struct(r["loss"].alias("loss"), (r["chars"] + F.when(i == 0, 1).when(i == 1, -1).otherwise(0)).alias("chars")))
    marked = F.transform("loss_runs", lambda r, i: F.struct((r["loss"] | (i == 2)).alias("loss"), r["chars"].alias("chars")))
    for runs in (moved, marked, F.slice("loss_runs", F.lit(1), F.lit(4))):
        with pytest.raises(Exception, match="mask does not fit"):
            chat_format.read_back(laid.withColumn("loss_runs", runs)).select("trained").collect()
    assert chat_format.read_back(laid).first().trained == ["three"]


def test_language_scores_are_the_same_in_any_order(spark):
    """To the bit: counts and logarithms are summed as whole numbers, in whatever order and batches the rows come."""
    rng = random.Random(31)
    lists = {"en": "the of and to that with was for this from have which".split(), "de": "der die und das nicht ein mit auf für ist von werden".split()}
    rows = [(i, " ".join(rng.choices(lists[lang], k=rng.randint(1, 9)) + rng.choices(lists["en"] + lists["de"], k=rng.randint(1, 9))), lang) for i in range(300) for lang in [rng.choice(["en", "de"])]]
    found = []
    for seed, parts in ((1, 1), (2, 7)):
        given = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string, lang string").repartition(parts)
        found.append({r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(given).collect()})
    assert found[0] == found[1] and len({s for _, s in found[0].values()}) > 10


def test_token_units_of_one_hash(monkeypatch):
    """With a first hash that knows only a unit's length, the second tells units apart and the ids stay the library's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FACTORS", np.zeros_like(token_files.FACTORS))
    texts = ["the cat sat on the mat.", "a dog ran to the sea, and so on.", "mat cat sat"] * 2
    encoder = token_files.Encoder(public_tokenizers.path(token_files.VOCABULARY))
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    ids, counts = encoder.encode(texts)
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_items_with_one_common_window(spark):
    """A boilerplate window of many items beside others: each item of a document is one row before they are listed."""
    common = "this notice stands in every item of the whole benchmark set"
    items = [(k, f"{common} {' '.join(f'q{k}x{j}' for j in range(12))}") for k in range(3000)]
    rows = [(1, f"start {items[5][1]} end"), (2, f"x {common} y"), (3, "nothing of it at all in here but some ten words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.contaminated) for r in decontaminate.contamination_report(docs, benchmark).collect()}
    assert got == {1: (3000, True), 2: (3000, True), 3: (0, False)}
