"""The pipeline against the same stages in plain Python, and its parts together."""

import random

import corpus_pipeline as C
from tests.llm.test_llm_operators import _components, check_lines, words
from tidewright.llm import packing, quality


def by_hand(spark, sf_dir, made):
    """Documents after each filtering stage; the classifier's verdicts are taken as they are, and the second stage's texts once they are found right."""
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in C.table(spark, sf_dir, "documents").collect()]
    table = C.table(spark, sf_dir, "documents")
    bad = {r.doc_id for r in quality.classify(table, quality.fit(table, C.table(spark, sf_dir, "labels"))).where("rejected").collect()}
    docs = [d for d in docs if d[0] not in bad]
    yield docs
    kept = {r.doc_id: r.text for r in made["lines"].collect()}
    check_lines([(d[0], d[1]) for d in docs], {(d[0], d[1] or ""): kept.get(d[0], "") or "" for d in docs}, 1)
    docs = [(d[0], kept[d[0]], d[2], d[3], d[4] if kept[d[0]] == d[1] else len(kept[d[0]])) for d in docs if d[0] in kept]
    yield docs
    lead = {(i, c) for i, _, c in _components([(d[0], d[1]) for d in docs])}
    docs = [d for d in docs if (d[0], d[0]) in lead]
    yield docs
    sets = lambda t: {tuple(w[i : i + 5]) for w in [words((t or "").lower())] for i in range(max(1, len(w) - 4)) if w}
    items = [s for s in (sets(r.text) for r in C.table(spark, sf_dir, "benchmark").collect()) if s]
    docs = [d for d in docs if not any(100 * len(s & sets(d[1])) >= 80 * len(s) for s in items)]
    yield docs


def test_stages(spark, small, tmp_path):
    docs = C.table(spark, small, "documents")
    made = {}
    for name, stage in C.STAGES[:-1]:
        left = stage(spark, docs, small)
        assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.write.parquet(str(tmp_path / name))
        docs = made[name] = spark.read.parquet(str(tmp_path / name))
    for name, want in zip(made, by_hand(spark, small, made), strict=True):
        assert sorted(map(repr, map(tuple, made[name].collect()))) == sorted(map(repr, want)), name
    pieces = C.run(spark, small).collect()
    enc = packing.encoder(*_public())
    assert {(r.doc_id, r.doc_tokens) for r in pieces} == {(d[0], len(enc.ids(d[1] or "")) + 1) for d in want}
    assert sum(r.length for r in pieces) == sum(len(enc.ids(d[1] or "")) + 1 for d in want)


def _public():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), None, None


def test_awkward_rows_pass_through(spark, tmp_path):
    """Nulls, empty and repeated rows, extra columns, and an empty table."""
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(300)}" for _ in range(120))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "some words of no id", None, None, None), (4, text + " tail", "en", "s", 9)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tables = {"labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, "unheard of benchmark item in these documents")], "item_id long, text string")}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (made, made.where("false")):
        docs = docs.selectExpr("*", "1 AS chunk", "'x' AS digest", "2 AS evidence")
        columns = docs.columns
        for _, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns
        C.STAGES[-1][1](spark, docs, str(tmp_path)).count()
        left = {r.doc_id for r in docs.collect()}
    assert left == set()
