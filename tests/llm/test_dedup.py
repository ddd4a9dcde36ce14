"""Exact, near and line dedup against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import exact_dedup, line_dedup, near_dedup
from cueloom.llm.graph import components

SCHEMA = "doc_id long, text string, keep_id string, component_id string, covered string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b\n"), (3, "a  b\n"), (4, None), (5, ""), (None, "ab "), (6, " \t"), (7, "é " * 50_000), (8, "é" * 50_000)]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm])[3]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda norm: (F.length(norm) % 2).cast("string")])
def test_exact_groups(spark, digest):
    """The weak digest puts different texts into one group; whole texts tell them apart."""
    got = [tuple(r) for r in exact_dedup.exact_groups(docs(spark, ROWS), digest).collect()]
    want = brute_exact(ROWS)
    assert sorted((r[:4] for r in got), key=str) == sorted((r[:4] for r in want), key=str)
    if digest is exact_dedup.sha256_hex:
        assert sorted(got, key=str) == want


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_exact_keeps_columns(spark):
    kept = exact_dedup.drop_copies(docs(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "keep_id", "component_id", "covered"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7]


def test_exact_one_row_of_a_repeated_id_stays(spark):
    rows = [(3, "a b"), (3, "ab"), (3, "a b"), (3, "other"), (None, "x"), (None, "x"), (4, "ab ")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs(spark, rows)).collect()))) == sorted(map(str, [(3, "a b"), (3, "other"), (None, "x")]))
    assert exact_dedup.drop_copies(docs(spark, [])).columns == ["doc_id", "text", "keep_id", "component_id", "covered"]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklmn") + rng.choice("opqrst")
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 40, 200]))]
        for _ in range(8):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                other[rng.randrange(len(other))] = word()
            base = other if rng.random() < 0.5 else base  # chains as well as stars
            rows.append((len(rows), " ".join(other)))
    return [*rows, (900, None), (901, ""), (902, " \n "), (903, "ONE two"), (904, "one\tTWO"), (905, "one"), (906, "x" * 200_000)]


@pytest.mark.parametrize("k", [4, 5])
@pytest.mark.parametrize("rest", [8, 0])
def test_near_components(spark, monkeypatch, k, rest):
    """With REST 0 the later pivot rounds run too."""
    monkeypatch.setattr(near_dedup, "REST", rest)
    monkeypatch.setattr(near_dedup, "CELL", 3)
    monkeypatch.setattr(near_dedup, "FEW", 0 if k == 4 else 2000)
    rows = near_rows()
    found = near_dedup.near_components(docs(spark, rows), k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    want = brute_components(rows, k)
    assert got == want
    assert len(set(c for _, c in want.values())) < len(want)


def test_near_misses_of_one_passage(spark, monkeypatch):
    """Texts that share most of a long passage are in all its buckets and yet not linked; those that are copies as well, are."""
    monkeypatch.setattr(near_dedup, "CELL", 16)
    monkeypatch.setattr(near_dedup, "FEW", 0)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for i in range(400):
        rest = [f"{rng.randrange(10**6)}r{i}" for _ in range(50)]
        rows.append((i, " ".join(passage + rest)))
        if i % 40 == 0:
            rows.append((1000 + i, " ".join(passage + rest[:48] + ["x", "y"])))
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(docs(spark, rows), 4).collect()}
    want = brute_components(rows, 4)
    assert got == {i: c for i, (_, c) in want.items()}
    assert sum(c != i for i, c in got.items()) == 10


def test_near_components_of_other_similarities(spark):
    """Bands and the screen follow the similarity: no pair of 0.5 to 0.6 is lost, and what cannot be found is refused."""
    rng = random.Random(17)
    rows = []
    for k in range(200):
        same, a, b = ([f"{side}{k}x{rng.randrange(10**6)}" for _ in range(n)] for side, n in (("s", 130), ("a", 45), ("b", 45)))
        rows += [(2 * k, " ".join(same + a)), (2 * k + 1, " ".join(same + b))]
    want = {i: c for i, (_, c) in brute_components(rows, 4, 50).items()}
    assert sum(c != i for i, c in want.items()) == 200
    for percent, links in ((50, 200), (65, 0)):
        got = {r.doc_id: r.component_id for r in near_dedup.near_components(docs(spark, rows), 4, percent).collect()}
        assert sum(c != i for i, c in got.items()) == links
    assert [near_dedup.band_rows(p) for p in (15, 50, 80, 100)] == [1, 2, 4, 4] and near_dedup.least_equal(80) == 76
    for bad in (14, 101):
        with pytest.raises(ValueError, match="percent"):
            near_dedup.near_components(docs(spark, rows), 4, bad)


def test_near_edges(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (2, "A B C D E"), (None, "a b c d e"), (None, "lonely text"), (None, None)]
    got = near_dedup.near_components(docs(spark, rows), 4).collect()
    assert sorted(map(str, [(r.doc_id, r.component_id, r.kept) for r in got])) == sorted(
        map(str, [(5, 2, False), (5, 2, False), (2, 2, True), (None, 2, False), (None, None, True), (None, None, True)])
    )
    assert near_dedup.near_components(docs(spark, [])).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        errors = []
        for n in (2, 10, 100, 3000):
            both = max(1, round(n * share))
            pool = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n:]])
            s = near_dedup.sketch([np.sort(a), np.sort(b)])
            assert (s != np.uint64(2**64 - 1)).all()
            errors.append(abs((s[0] == s[1]).mean() - both / (2 * n - both)))
        assert max(errors) < 0.25


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(300, 200), (200, 300), (7, 7)] + [(rng.randint(500, 700), rng.randint(500, 700)) for _ in range(120)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: r for x, r in root.items() if x in got} and all(root[x] == x for x in root if x not in got)


def brute_lines(rows):
    seen, out = {}, []
    for i, t in sorted(rows):
        lines = t.split("\n") if t is not None else []
        for p in range(len(lines) - 2):
            seen.setdefault(tuple(lines[p : p + 3]), (i, p))
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = {q for p in range(len(lines) - 2) if seen[tuple(lines[p : p + 3])] != (i, p) for q in range(p, p + 3)}
        out.append((i, None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), sorted(gone)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "x\ny"), (104, "\n".join(f"line {i}" for i in range(3000)) + "\na\na\na")]
    got = line_dedup.without_repeats(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.removed) for r in got), key=str) == brute_lines(rows)
    assert line_dedup.without_repeats(docs(spark, [])).count() == 0


def test_line_dedup_repeated_rows(spark):
    text = "a\nb\nc\nd"
    got = [(r.doc_id, r.text) for r in line_dedup.without_repeats(docs(spark, [(1, text), (1, text), (None, "a\nb\nc"), (2, "q\n" + text)])).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "d"), (1, "d"), (None, "a\nb\nc"), (2, "q")]))


def test_line_dedup_versions_of_one_id(spark):
    """Of two texts of one doc_id that share a passage at one place, one keeps it."""
    got = [r.text for r in line_dedup.without_repeats(docs(spark, [(1, "a\nb\nc\nd"), (1, "a\nb\nc\ne"), (1, "a\nb\nc\ne")])).collect()]
    assert sorted(got) in (["a\nb\nc\nd", "e", "e"], ["a\nb\nc\ne", "a\nb\nc\ne", "d"])
