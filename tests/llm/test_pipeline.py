from pyspark.sql import functions as F

import corpus_pipeline as p


def test_stages(spark, sf_dir, edge_docs, no_docs):
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    columns = docs.columns
    for name, stage in p.STAGES:
        out = p.written(stage(spark, docs, sf_dir), "test-stage")
        if name != "bpe":
            assert out.columns == columns
            assert out.count() > 0.8 * docs.count()
        if name in ("personal", "bpe"):
            assert out.count() == docs.count()
        before, docs = docs, out
    assert docs.count() == before.count()
    assert [n for n, _ in p.STAGES] == ["language", "simhash", "benchmark", "personal", "bpe"]


def _like(df, **extra):
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")} | extra)


def test_clashing_names(spark, sf_dir):
    """Columns of other names pass through all stages but the last, whatever they are called."""
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) between 200 and 400").orderBy("doc_id").first().text
    names = ["_lang", "_score", "_known", "__gone", "__id", "nameless", "h1", "node", "item_id", "_pii_email", "_PII_all", "odd `name.x"]
    docs = _like(spark.createDataFrame([(1, text), (2, text), (None, f"{text} mail me@example.org")], "doc_id long, text string"), **{n: F.lit(n) for n in names})
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = p.written(out, "test-stage")
        rows = docs.collect()
        assert rows and all(r[n] == n for r in rows for n in names)
    assert sorted((r.doc_id or 0, "[EMAIL]" in r.text) for r in rows) in ([(1, False)], [(0, True), (1, False)])
    assert p.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)


def test_two_texts_of_one_id(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) between 200 and 400 and lang = 'en'").orderBy("doc_id").limit(60).collect()]
    a, b = next((x, y) for x in texts for y in texts if not set(x.split()[:30]) & set(y.split()[:30]) or x.split()[:3] != y.split()[:3])
    docs = _like(spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in p.near_duplicates(spark, docs, sf_dir).collect()) == [(1, a), (5, b)]


def test_stages_on_edges(spark, sf_dir, edge_docs, no_docs):
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, edge_docs, sf_dir).columns == edge_docs.columns, name
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert p.language(spark, edge_docs, sf_dir).where("text is null or text = ''").count() == 0
    kept = p.benchmark(spark, edge_docs, sf_dir)
    assert kept.count() == edge_docs.count()
    for df in (edge_docs, no_docs):
        assert p.tokens(spark, df, sf_dir).count() == df.count()


def test_language_keeps_mixtures_and_drops_unlearned_scripts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    langs = sorted(r.lang for r in docs.where("lang is not null").select("lang").distinct().collect())
    own = [docs.where(f"lang = '{x}' and length(text) > 300").orderBy("doc_id").first().text.split()[:40] for x in langs[:3]]
    mixed = " ".join(w for words in own for w in words)
    unlearned = "ქართული ენა არის ლამაზი " * 10
    made = [(-1, mixed, None), (-2, unlearned, None), (-3, f"{unlearned} {' '.join(own[0][:10])}", None), (-4, f"{' '.join(own[0])} {unlearned[:40]}", None)]
    got = {r.doc_id: r.lang for r in p.language(spark, docs.union(spark.createDataFrame(made, docs.schema)), sf_dir).where("doc_id < 0").collect()}
    assert set(got) == {-1, -4} and all(got.values())
