"""The pipeline against a brute-force version, stage by stage, and the registered queries' columns."""

import duckdb
import pytest
from brute import groups, lines, phrases, text_stats
from pyspark.sql import functions as F

import corpus_pipeline
from veingraph.llm.queries import QUERIES, SQL
from veingraph.llm.quality import FEATURES, Condition, _covers, fit_quality, text_stats as stats

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages", "labels")
COLUMNS = {
    "op1_recompression": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op2_poisson_mixing": ["doc_id", "text", "lang", "source", "n_chars", "copy", "mix_key"],
    "op3_positional_index": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"],
    "op4_dart_minhash": ["doc_id", "class_id", "n_links", "kept"],
    "op5_token_counts": ["doc_id", "n_chars", "n_tokens"],
    "op6_decision_list": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_suffix_arrays": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"],
    "op8_url_language_model": ["page_id", "host", "path", "rule", "verdict", "score"],
    "op9_log_templates": ["doc_id", "n_lines", "n_dropped", "text"],
    "op10_diagonal_voting": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    found = QUERIES[name](spark, DATA)
    assert found.columns == COLUMNS[name]
    rows = sorted(map(repr, (tuple(r) for r in found.collect())))
    if name not in SQL:
        assert len(rows) == spark.read.parquet(f"{DATA}/{'pages' if name.startswith('op8') else 'documents'}.parquet").count()
        return
    duck = duckdb.connect()
    for table in TABLES:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    expected = duck.sql(SQL[name])
    at = [expected.columns.index(c) for c in COLUMNS[name]]
    assert rows == sorted(map(repr, (tuple(r[i] for i in at) for r in expected.fetchall())))


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS)


def test_stages_by_brute_force(spark, corpus, tmp_path):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in corpus]
    bench = [(1, " ".join(corpus[28][1].split()[40:60]))]
    labels = [(i, 1 if i % 4 else 0, 0) for i, _ in corpus if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    features = {(r["doc_id"], r["text"]): r.asDict() for r in stats(docs).collect()}
    want = [(i, t) for i, t in corpus if not text_stats(t)[5] and not any(_covers(r, features[i, t]) for r in rules)]
    want = [(i, t) for (i, _), (_, dropped, t) in zip(want, lines(want)) if not dropped or t.strip(" \t\n\r\x0b\x0c")]
    by_class = {}
    for row, g in zip(want, groups(want)):
        by_class.setdefault(g, []).append(row)
    hit = phrases(want, bench)

    got = corpus_pipeline.quality_rules(spark, docs, sf)
    got = corpus_pipeline.line_dedup(spark, got, sf)
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, want))
    assert got.columns == docs.columns
    near = corpus_pipeline.near_dedup(spark, got, sf)
    kept = [(r["doc_id"], r["text"]) for r in near.collect()]
    assert all(sum(k in members for k in kept) == 1 for members in by_class.values())
    clean = corpus_pipeline.decontamination(spark, near, sf)
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in clean.collect()))) == sorted(repr(k) for k in kept if not hit[k][4])
    mixed = corpus_pipeline.mixing(spark, clean, sf)
    assert mixed.columns == [*docs.columns, "copy", "mix_key"]
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, mixed.collect()))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.col("doc_id") < 0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_conditions():
    assert Condition(FEATURES[0], True, 0.5).holds({FEATURES[0]: 0.6}) and Condition(FEATURES[0], False, 0.5).holds({FEATURES[0]: 0.5})
