"""The pipeline against a brute-force version on a fixture, stage by stage."""

import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_dedup import brute_components, brute_exact
from tests.llm.test_text import brute_hits


def fixture():
    rng = random.Random(9)
    lists = {"en": "the of and to that with was for this from have which".split(), "de": "der die und das nicht ein mit auf für ist von werden".split()}
    text = lambda lang, n: " ".join(rng.choice(lists[lang]) for _ in range(n))
    rows = [(i, text(lang, rng.randint(25, 60)), lang) for i in range(60) for lang in [rng.choice(["en", "de"])]]
    rows += [(100 + i, rows[i][1].replace(" ", "\n"), rows[i][2]) for i in range(5)]
    rows += [(200 + i, rows[i + 10][1] + " more", rows[i + 10][2]) for i in range(5)]
    items = [(i, text("en", 14)) for i in range(4)]
    rows += [(300 + i, text("en", 20) + " " + items[i][1] + " " + text("en", 20), "en") for i in range(3)]
    rows += [(400, None, "en"), (401, "12 !", "en"), (402, "", None)]
    return [(i, t, lang, f"s{i % 3}", len(t or "")) for i, t, lang in rows], items


def test_pipeline(spark, tmp_path):
    rows, items = fixture()
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    for (name, stage), want in zip(
        corpus_pipeline.STAGES,
        [
            lambda own: own,
            lambda own: [(i, t) for i, t in own if any(r[0] == i and r[3] for r in brute_exact(own))],
            lambda own: [(i, t) for i, t in own if brute_components(own, 5)[i][1] == i],
            lambda own: [(i, t) for i, t in own if not next(h for h in brute_hits(own, items) if h[0] == i)[5]],
        ],
    ):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        left = want(left)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(left), name
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    final = {r.doc_id: (r.n_pieces, r.ids, r.lossless) for r in corpus_pipeline.run(spark, folder).collect()}
    assert final == {i: (len(ids), ids, True) for i, t in left for ids in [library.encode(t)]}
    assert 20 < len(final) < len(rows)


def test_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, one very long text, columns that clash with those of the operators, and no rows at all."""
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    said = "the house and this other thing which is not that"
    rows = [(1, said), (1, said), (None, said + " more"), (None, None), (2, None), (3, ""), (4, "the of and " * 60_000), (5, "12 ½"), (6, "The house one two three four five six seven eight nine ten")]
    schema = "doc_id long, text string, lang string, keep_id string, found string, spans string, band long, node long, _c0 string"
    docs = spark.createDataFrame([(i, t, "en", "k", "f", "s", 1, 2, "c") for i, t in rows], schema)
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, folder)
            assert name == "sentencepiece" or now.columns == docs.columns, name
            now = now.persist()
        got = sorted((r.doc_id is None, r.doc_id or 0, r.lossless) for r in now.collect())
        assert got == ([(False, 1, True), (False, 4, True), (True, 0, True)] if given is docs else [])
