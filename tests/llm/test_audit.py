"""Source divergence, Merkle manifest and quality classifier against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cueloom.llm import divergence, manifest, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, part string, at long, node string"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with other columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", "y", 7, "z") for i, t, lang, source in rows], SCHEMA)


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_divergence(rows):
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in {k[0] for k in groups}:
        kept = [t for t, n in seen[lang].items() if n >= divergence.LEAST_DOCS]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        total = sum(own.values(), Counter())

        def share(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(total)
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[: divergence.TOP]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms, 1)]
    return sorted(out)


def divergent(df, **options):
    return sorted(tuple(r) for r in divergence.divergence(df, **options).collect())


@pytest.mark.parametrize("sides", [{}, {"terms": 3, "groups": 2}])
def test_divergence(spark, sides):
    """With small tiles every language is cut into many blocks and parts."""
    rng = random.Random(5)
    words = ["The", "été", "ÉTÉ", "zé", "z", "Zz", "a1b", "naïve", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 30]))) + rng.choice(["", "\n", "!x_"]), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", "é", "Z", None, ""])) for k in range(500)]
    rows += [(None, None, "xx", "only"), (None, "", None, None), (1, "rare words here", "rare", "a"), (1, "rare words here", "rare", "b")]
    assert divergent(docs(spark, rows), **sides) == brute_divergence(rows)


def test_divergence_ties_and_top(spark):
    """More than TOP terms of one value: the first in order stay. Two languages without kept terms."""
    words = [f"{a}{b}" for a in "abcdefghij" for b in "abcdefg"]
    rows = [(k, " ".join(words), "en", "s1") for k in range(30)] + [(k, "other", "en", "s2") for k in range(30)] + [(9, "x", "de", "s1"), (9, "x", "de", "s2"), (9, None, "fr", "s1")]
    got = divergent(docs(spark, rows), terms=8)
    assert got == brute_divergence(rows)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[:3] == ("en", "s1", "term")] == words[:50]
    assert [r[2:] for r in got if r[0] == "de"] == [("pair", "s2", 0, 1), ("pair", "s1", 0, 1)]


def test_divergence_empty(spark):
    df = divergence.divergence(docs(spark, []))
    assert df.count() == 0 and df.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_long_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    text = ("Abc def-ghi  é1 " * 40).encode()
    assert [t for part in divergence.pieces_of(text.translate(divergence.LOWERED)) for t in part] == [t.translate(LOWER).encode() for t in TERM.findall(text.decode())]


def test_shares_are_exact():
    counts, whole = np.array([0, 10**15, 7, 9 * 10**15 - 5], np.int64), np.array([1, 3 * 10**15 + 1, 9 * 10**15, 9 * 10**15], np.int64)
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * (c + 5) // w for c, w in zip(counts.tolist(), whole.tolist())]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def leaf(i, t, lang, source, n):
        return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, t)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
        return out

    def way(tree, at):
        for nodes in tree[:-1]:
            first = at - at % 3
            yield nodes[first:at], nodes[at + 1 : first + 3]
            at //= 3

    leaves = defaultdict(list)
    for i, t, lang, source in rows:
        n = None if t is None else len(t)
        bad = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        leaves[source].append((i is not None, i or 0, leaf(i, t, lang, source, n), leaf(i, t.replace("\n", "") if bad and t else t, lang, source, n), i))
    names = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(leaves[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, node, sent, i) in enumerate(sorted(leaves[s], key=lambda x: x[:3])):
            path = [*way(trees[s], at), *way(top, k)]
            now = sent
            for left, right in path:
                now = sha(*left, now, *right)
            out.append((i, node, trees[s][-1][0], top[-1][0], sha(*(x for left, right in path for x in (*left, *right))), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [5, 1])
def test_manifest(spark, monkeypatch, levels):
    """With blocks of three nodes each level is a round of its own."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    rng = random.Random(6)
    rows = [(rng.randrange(400), rng.choice(["a\nb", "", "x" * 5000, "é\n\n", None, "plain"]), rng.choice(["en", None]), rng.choice(["s"] * 20 + ["t", "é", None, "", "Z"])) for _ in range(330)]
    rows += [(None, "a\n", "en", "s")] * 2 + [(7, "same\n", "en", "t")] * 5 + [(8, "lone", None, "single")]
    got = sorted((tuple(r) for r in manifest.manifest(docs(spark, rows)).collect()), key=str)
    assert got == brute_manifest(rows)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_manifest_small_trees(spark):
    for n in (1, 2, 3, 4, 243, 244):
        rows = [(k, "a\nb", "en", "s") for k in range(n)]
        assert sorted((tuple(r) for r in manifest.manifest(docs(spark, rows)).collect()), key=str) == brute_manifest(rows)


def test_manifest_empty(spark):
    df = manifest.manifest(docs(spark, []))
    assert df.count() == 0 and df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_uses_no_python_workers(spark):
    plan = manifest.manifest(docs(spark, [(k, "a\nb", "en", "s") for k in range(9)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "PythonUDF" not in plan


def learnable(seed, n):
    """Texts of quality 1 are prose; those of quality 0 shout, repeat or are full of marks."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(rng.randint(3, 120))]
        good = rng.random() < 0.7
        text = " ".join(words).capitalize() + "."
        if not good:
            text = rng.choice([text.upper() + "!!", " | ".join(words), " ".join(words[:2] * 40), "### ".join(words)])
        out.append((k, text, "en", "s", int(good)))
    return out


def test_quality_on_held_out_rows(spark):
    rows = learnable(7, 900)
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, _, q in rows] + [(3, None, 0), (None, 1, 0), (5, 9, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs(spark, [r[:4] for r in rows]), labels).collect()
    want = {r[0]: r[4] for r in rows}
    held = [r for r in got if r.held_out]
    assert len(got) == 900 and {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_ignores_labels_of_held_out_rows(spark):
    rows = learnable(8, 300)
    df = docs(spark, [r[:4] for r in rows])
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, _, _, _, q in rows]
    once, again = (quality.quality(df, spark.createDataFrame(x, "doc_id long, quality int")).collect() for x in ([(r[0], r[4]) for r in rows], turned))
    assert sorted(once) == sorted(again)


def test_quality_odd_tables(spark):
    rows = [(1, None, "en", "s"), (2, "", None, None), (None, "x", "en", "s"), (3, "word " * 300_000, "en", "s"), (3, "a", "en", "s"), (3, "a", "en", "s"), (4, "é" * 100_000, "en", "s")]
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality(docs(spark, rows), none).collect()
    assert len(got) == 7 and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(i, q) for i in (1, 2, 3, 4, 9) for q in (0, 1)], "doc_id long, quality int")
    found = quality.quality(docs(spark, rows), one).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    empty = quality.quality(docs(spark, []), one)
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "score", "predicted"]


def test_features_by_pieces(monkeypatch):
    """A text in pieces has the numbers of the whole, but for what compares neighbours across a cut."""
    text = " ".join(f"word{k % 37}" for k in range(4000)).encode()
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PIECE", 1000)
    parts = quality.features(text)
    names = [n for n, a, b in zip(quality.NAMES, whole, parts) if abs(a - b) > 1e-9]
    assert set(names) <= {"repeated_neighbours", "distinct_words", "distinct_neighbours", "words_a_line", "distinct_lines", "open_lines"}
    assert len(list(quality._pieces(b"x" * 10_000))) == 10


def test_interaction_is_learned():
    """An exclusive or of two numbers, which no sum of single tables can tell."""
    rng = np.random.default_rng(9)
    x = rng.random((4000, len(quality.NAMES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.learned(x[:3000], y[:3000])
    assert (2, 7) in model.pairs
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    single = model.margins(x[3000:]) - sum(g[np.searchsorted(model.coarse[i], x[3000:, i], "right"), np.searchsorted(model.coarse[j], x[3000:, j], "right")] for (i, j), g in zip(model.pairs, model.grids))
    assert ((single >= 0) == y[3000:]).mean() < 0.65
