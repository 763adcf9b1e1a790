"""Queries against their SQL, and the pipeline's stages on the small tables."""

import math
import random

import pytest

import corpus_pipeline
from kelpie.llm import decontaminate, queries, simhash, substrings
from tests.test_entry import DIR, same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    same(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{DIR}/benchmark.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, DIR)
        if k < 4:
            assert got.columns == columns, name
        got.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k == 1:
            assert simhash.similar(docs).where("doc_id <> component_id").count() == 0
        if k == 3:
            assert decontaminate.overlaps(docs, benchmark).count() == 0 and 0 < docs.count() <= before.count()
            assert substrings.removals(docs).count() == 0
    kept = {r.doc_id for r in before.select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
    assert corpus_pipeline.run(spark, DIR).count() == docs.count()


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_odd_rows(spark, stage):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, th int, covered int, failure_bits int, `x.y` int"
    words = " ".join(f"word{k}" for k in range(90))
    texts = [None, "", " \n", words, words, "One. Two. Three.", f"{words}. " * 40, "\x00 \x1c é"]
    rows = [(k if k % 3 else None, x, None if k % 2 else "en", None, k, "d", 1, 2, 3, 4) for k, x in enumerate(texts)] + [(4, words, None, None, None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, schema)
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, df, DIR)
    assert got.columns == df.columns, name
    assert 0 < got.count() <= len(rows) and run(spark, df.limit(0), DIR).count() == 0


def plain_stages(docs, benchmark):
    """What the first four stages leave, stage by stage, one document after the other: (id, text)."""
    from kelpie.llm import quality
    from tests.llm.test_operators import components_of, plain_removals

    names = [f.split()[0] for f in quality.MEASURES.split(", ")]
    fails = lambda x: any(eval(r.fails, {}, dict(zip(names, quality.measure(x), strict=True))) for k, r in enumerate(quality.RULES) if quality.POLICIES["v1"].mask >> k & 1)  # noqa: E731, S307
    kept = [(i, x) for i, x in docs if not fails(x or "")]
    yield kept
    runs = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, x in kept for w in [x.encode().lower().split()]}
    near = [(i, j) for i in runs for j in runs if i < j and 5 * len(runs[i] & runs[j]) >= 4 * len(runs[i] | runs[j])]
    least = components_of(runs, near)
    kept = [(i, x) for i, x in kept if least[i] == i]
    yield kept
    gone = plain_removals(kept)
    kept = [(i, gone[k][1] if k in gone else x) for k, (i, x) in enumerate(kept)]
    yield kept
    tokens = lambda x: "".join(c.lower() if c.isalnum() else " " for c in (x if isinstance(x, str) else " ".join(x))).split()

    def overlaps(a, b):
        places = {}
        for k, w in enumerate(b):
            places.setdefault(w, []).append(k)
        met = {}
        for p, w in enumerate(a):
            for q in places.get(w, ()):
                met.setdefault(p - q, []).append(q)
        need = math.ceil(min(13, len(b)) * 0.8)
        return any(sum(q <= x < q + 13 for x in s) >= need for s in met.values() if len(s) >= need for q in s)

    items = [w for x in benchmark if len(w := tokens(x or "")) >= 5]
    yield [(i, x) for i, x in kept if not any(overlaps(tokens(x), b) for b in items)]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on all that its predecessor kept, and the pieces of the last."""
    from tests.llm.test_operators import TOKENIZER, check_packing

    rng = random.Random(8)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    words = [w for _, x in docs[:40] for w in (x or "").split()]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = some(60)
    docs += [(10_000 + k, f"{some(80)} {passage} {some(70)}") for k in range(4)]
    docs += [(20_000 + k, f"{some(90)} {items[k]} {some(60)}") for k in range(3)]
    docs += [(30_000 + k, docs[k][1]) for k in range(5)] + [(30_010, docs[200][1].replace(" ", "  ")), (30_011, docs[201][1] + " and more")]
    rows = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    changed = 0
    for k, expected in enumerate(plain_stages(docs, items)):
        corpus_pipeline.STAGES[k][1](spark, rows, DIR).write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
        got = {r.doc_id: r.text for r in rows.collect()}
        assert set(got) == {i for i, _ in expected}, corpus_pipeline.STAGES[k][0]
        changed += len(docs) - len(got)
        for i, x in expected:
            assert got[i] == x if isinstance(x, str) else [w.lower() for w in got[i].split()] == x
    assert changed > 20
    pieces = corpus_pipeline.STAGES[4][1](spark, rows, DIR).collect()
    assert check_packing(pieces, list(got.items()), 1024) > 0.8 and {p.doc_id for p in pieces} == set(got)
