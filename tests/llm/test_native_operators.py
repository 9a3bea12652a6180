"""Mixing, decontamination, quality, URLs, lines, licenses and token counts against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from brute import LOWER, lines, phrases, plain_words, text_stats
from pyspark.sql import functions as F

from veingraph.llm import common, decontam, licenses, mixing, quality, tokens, url_filter
from veingraph.llm import lines as line_dedup
from veingraph.plans.iteration import small


def test_mixing_counts_follow_the_distribution(spark, docs_of):
    docs = docs_of([(i, "t") for i in range(3000)])
    weights = {"s0": 0.7, "s1": 0.3}
    out = mixing.mix(docs, weights).collect()
    by_source = Counter(r["source"] for r in out)
    assert set(by_source) == {"s0", "s1"}
    assert by_source["s0"] == pytest.approx(2100, rel=0.1) and by_source["s1"] == pytest.approx(900, rel=0.15)
    counts = Counter(r["doc_id"] for r in out if r["source"] == "s0")
    sizes = Counter(counts.get(i, 0) for i in range(0, 3000, 3))
    for k in range(5):
        assert sizes[k] / 1000 == pytest.approx(math.exp(-2.1) * 2.1**k / math.factorial(k), abs=0.045)
    copies = defaultdict(list)
    for r in out:
        copies[r["doc_id"]].append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())
    assert {tuple(r) for r in mixing.mix(docs, weights).collect()} == {tuple(r) for r in out}
    assert len({r["mix_key"] for r in out}) == len(out)


def test_mixing_reaches_large_means(spark, docs_of):
    """40 of 4,000 documents take half of the output: 50 copies each in the mean, with a Poisson count's spread."""
    docs = docs_of([(i, "t") for i in range(4000)]).withColumn("source", F.when(F.col("doc_id") < 40, "rare").otherwise("rest"))
    counts = Counter(r["doc_id"] for r in mixing.mix(docs, {"rare": 0.5, "rest": 0.5}).select("doc_id").collect())
    rare = [counts.get(i, 0) for i in range(40)]
    assert sum(rare) == pytest.approx(2000, rel=0.1)
    assert sum(counts.values()) == pytest.approx(4000, rel=0.1)
    assert 20 < sum((n - 50) ** 2 for n in rare) / 40 < 110


def test_mixing_as_its_sql_for_any_mean(spark, tmp_path):
    """One document beside 40,000 has a mean of 200."""
    import duckdb

    rows = spark.range(40_001).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") == 7, "rare").otherwise("rest").alias("source"), F.lit(1).cast("long").alias("n_chars")
    )
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    found = mixing.op2_poisson_mixing(spark, str(tmp_path)).select("doc_id", "copy", "mix_key")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(f"SELECT doc_id, copy, mix_key FROM ({mixing.mixing_sql()})").fetchall()
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted(want) and 150 < sum(i == 7 for i, _, _ in got) < 250


def test_very_long_texts(spark, docs_of):
    """Texts of a few megabytes, with a passage of the benchmark, a license and repeated lines far inside."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(3000)] + ["Alpha", "été", "x-y"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, common_line = line(30), "subscribe to our newsletter now please"
    body = [line(rng.randint(5, 40)) for _ in range(20_000)]
    body[15_000:15_000] = [passage, common_line, dict(licenses.TEXTS)["isc"].replace("\n", " ")]
    docs = [(1, "\n".join(body)), (2, f"{common_line}\n{line(50)}"), (3, f"{line(9)}\n{common_line}"), (4, "x" * 3_000_000)]
    assert len(docs[0][1]) > 2_000_000
    table = docs_of(docs).cache()
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(table).collect()}
    assert [(rows[i]["n_lines"], rows[i]["n_dropped"], rows[i]["text"]) for i, _ in docs] == lines(docs)
    stats = {r["doc_id"]: r for r in quality.text_stats(table).withColumn("failed", quality.base_failed()).collect()}
    for i, t in docs:
        assert tuple(stats[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed")) == text_stats(t)
    bench = [(9, passage)]
    want = phrases(docs, bench)
    for r in decontam.phrase_matches(table, spark.createDataFrame(bench, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "text").collect():
        assert (r["n_words"], r["n_hit"]) == want[r["doc_id"], r["text"]][:2]
    spans = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in licenses.scan_licenses(table).collect()}
    assert spans == {1: {"isc"}, 2: set(), 3: set(), 4: set()}
    vocabulary = tokens.read_vocabulary(TOKENIZER)
    exact = reference(vocabulary)
    assert all(r["n_tokens"] == exact(r["text"]) for r in tokens.count_tokens(table.filter("doc_id < 4"), vocabulary).collect())
    assert mixing.mix(table).count() >= 0
    table.unpersist()


def test_url_of_a_megabyte(spark):
    pages = spark.createDataFrame([(1, "http://a.net/" + "x" * 1_000_000), (2, "http://b.org/fr/a"), (3, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_labels_that_repeat(spark, docs_of):
    """Repeated and contradicting labels, extra columns and clashing names change nothing but the verdicts' teachers."""
    texts = [(i, ("### " if i % 3 == 0 else "") + " ".join(f"w{(i * 7 + k) % 400}" for k in range(60)) + (" &&&" * 30 if i % 3 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] * 2 + [(1, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    rows = quality.judge_quality(docs_of(texts), labels).collect()
    assert len(rows) == 120 and {r["doc_id"] for r in rows if not r["kept"]} == {i for i in range(120) if i % 3 == 0}


def test_mixing_odd_rows(spark, docs_of):
    assert mixing.mix(docs_of([(1, "x")]).filter("doc_id = 2")).count() == 0
    assert mixing.mix(docs_of([(1, "x")]), {"other": 1.0}).count() == 0
    odd = docs_of([(None, None), (1, None), (1, None)]).withColumn("source", F.lit(None).cast("string"))
    out = mixing.mix(odd)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() >= 0


def test_phrases(docs_of, corpus, spark):
    rng = random.Random(3)
    words = plain_words(corpus[29][1])
    items = [(0, " ".join(words[5:30])), (1, "SHORT Item, here"), (2, ""), (3, None), (4, "never seen words at all in here " * 3), (5, " ".join(words[5:30]))]
    items += [(k, " ".join(plain_words(t)[2:14])) for k, (_, t) in enumerate(corpus[:9], 10)]
    more = [(200, "x short item! here y"), (201, "ONE"), (202, "item here short")]
    items.append((30, "one"))
    del rng
    docs = corpus + more
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.phrase_matches(docs_of(docs), bench)
    rows = found.select("doc_id", "text", F.col("n_words").alias("nw"), "n_hit", F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("it")).collect()
    want = phrases(docs, items)
    for r in rows:
        assert (r["nw"], r["n_hit"], len(r["it"])) == want[r["doc_id"], r["text"]][:3]
    assert len(rows) == len(docs) and any(r["n_hit"] for r in rows)


def test_phrases_without_items_or_documents(docs_of, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontam.phrase_matches(docs_of([(1, "a b"), (2, None)]), none).collect()] == [0, 0]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.phrase_matches(docs_of([(1, "x")]).filter("doc_id = 2"), some).count() == 0


def test_proximity(docs_of, spark):
    bench = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    docs = docs_of([(1, "alpha x beta gamma delta"), (2, "alpha"), (3, "beta " * 9 + "alpha"), (4, "delta alpha beta")])
    found = {r["doc_id"] for r in decontam.proximity_matches(docs, bench, slack=1).collect()}
    assert 1 in found and 2 not in found


def test_text_stats(docs_of, corpus):
    rows = quality.text_stats(docs_of(corpus)).withColumn("failed", quality.base_failed()).collect()
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["failed"])
        assert got == text_stats(r["text"]), r["text"]
    assert len(rows) == len(corpus)


def test_learned_list_on_held_out_rows(spark, docs_of):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    texts, bad = [], {}
    for i in range(900):
        words = [word() for _ in range(rng.randint(30, 90))]
        bad[i] = i % 5 == 0
        texts.append((i, " ".join(w.upper() + "!" if bad[i] and i % 2 else w + ("###" if bad[i] else "") for w in words) + ("&" if not bad[i] and i % 50 == 1 else "")))
    docs = docs_of(texts)
    labels = spark.createDataFrame([(i, int(not bad[i]), 0) for i in range(600)] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge_quality(docs, labels).collect()
    held = [r for r in rows if r["doc_id"] >= 600]
    assert sum(r["kept"] != (not bad[r["doc_id"]]) for r in held) <= 3
    assert all(r["kept"] for r in held if not bad[r["doc_id"]])


def test_quality_without_labels(spark, docs_of, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judge_quality(docs_of(corpus), none).collect()
    assert len(rows) == len(corpus) and all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality.judge_quality(docs_of([(1, "x")]).filter("doc_id = 2"), none).count() == 0
    assert quality.learn_rules([]) == []


URLS = [
    ("http://Tion.EXAMPLE.net/en/7?x", "tion.example.net", "/en/7", "example.net/en/", "allow"),
    ("https://a.net", "a.net", "", None, None), ("https://a.net/", "a.net", "/", "net/", "block"),
    ("http://xnet/", "xnet", "/", None, None), ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
    ("http://www.example.org/fr/?q", "www.example.org", "/fr/", "org/fr/", "allow"), ("http://example.org/fr", "example.org", "/fr", None, None),
    ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("x://y://z/p", "y:", "//z/p", None, None),
    ("http://h#f/a", "h", "", None, None), ("://q/p#x", "q", "/p", None, None), ("http://net/en/", "net", "/en/", "net/", "block"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], 1.5) for i, u in enumerate(URLS)] * 2, "page_id long, url string, score double")
    rows = url_filter.filter_urls(pages).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(pages.filter("page_id < 0")).count() == 0


def test_url_models_on_held_out_urls(spark):
    rng = random.Random(4)
    good = [f"http://{rng.choice(['lib', 'edu', 'docs'])}{rng.randrange(99)}.example.net/en/{rng.choice(['paper', 'lesson'])}-{rng.randrange(999)}" for _ in range(300)]
    bad = [f"http://{rng.choice(['xxx', 'cazz'])}{rng.randrange(99)}.spam.net/{rng.choice(['zzwin', 'qqbet'])}?q={rng.randrange(999)}" for _ in range(300)]
    held = [(u.replace(".net", ".info"), g) for u, g in [(u, True) for u in good[:60]] + [(u, False) for u in bad[:60]]]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + [u for u, _ in held])], "page_id long, url string")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages).collect()}
    right = sum((verdicts[600 + k] == "allow") == g for k, (_, g) in enumerate(held))
    assert right / len(held) > 0.95


def test_lines(docs_of, corpus):
    docs = corpus + [(300 + k, f"{line}\nown {k} line of text here") for k, line in enumerate(["Read more about this here now"] * 4 + ["a b"] * 3)]
    rows = line_dedup.dedup_lines(docs_of(docs)).collect()
    want = defaultdict(list)
    for (i, t), w in zip(docs, lines(docs)):
        want[i].append(w)
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_lines"], r["n_dropped"], r["text"]))
    assert {k: sorted(map(repr, v)) for k, v in got.items()} == {k: sorted(map(repr, v)) for k, v in want.items()}
    assert any(r["n_dropped"] for r in rows)
    assert line_dedup.dedup_lines(docs_of([(1, "x")]).filter("doc_id = 2")).count() == 0


def test_lines_of_one_leaf(docs_of, monkeypatch):
    """Variable words behind the leading tokens are generalised up to a fifth; other lines of the leaf stay."""
    head = "this page was last edited by"
    docs = [(i, f"{head} {name} on our old and very friendly server") for i, name in enumerate(["ann", "bob", "cid", "dan"])]
    docs += [(10 + i, f"{head} x{i}y some q{'abc'[i]} r{'abc'[i]} s t{'abc'[i]} u v {'klm'[i]}") for i in range(3)]
    docs += [(20 + i, f"All rights reserved.\nown text {'abcdef'[i]}\n{i} {i}\n") for i in range(4)]
    for rows_limit in (200_000, 0):  # with broadcast tables, and by salted joins
        monkeypatch.setattr(line_dedup, "small", lambda df, n=rows_limit: small(df, n))
        monkeypatch.setattr(common, "small", lambda df, n=rows_limit: small(df, n))
        rows = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs_of(docs)).collect())
        assert rows == [(i, *w) for (i, _), w in zip(docs, lines(docs))]
    dropped = {r[0]: r[2] for r in rows}
    assert [dropped[i] for i in (0, 1, 2, 3, 10, 11, 12, 20, 21, 22, 23)] == [0, 1, 1, 1, 0, 0, 0, 0, 1, 1, 1]


def base_places(text):
    w = plain_words(text)
    return [(k, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]


def found_by_sliding(text):
    """Labels of the templates that have a place where four fifths of their words follow in order, a few words apart at most."""
    w, labels = plain_words(text), set()
    for label, template in licenses.TEMPLATES:
        t = plain_words(template)
        if not {*zip(w, w[1:], w[2:])} & {*zip(t, t[1:], t[2:])}:
            continue
        for start in range(len(w)):
            n, at, end = 0, start, min(len(w), start + len(t) + 2 * licenses.DRIFT)
            for x in t:
                near = w[at : min(end, at + 2 * licenses.DRIFT + 3)]
                if x in near:
                    n, at = n + 1, at + near.index(x) + 1
            if n >= licenses.MIN_SHARE * len(t):
                labels.add(label)
                break
    return labels


def test_licenses(docs_of, corpus):
    mit = dict(licenses.TEXTS)["mit"]
    gap = " ".join(w for k, w in enumerate(mit.split()) if k % 17 != 5)
    docs = corpus + [
        (400, "Released under the MIT License. And under THE mit license!"), (401, f"code\n{mit}\nmore"), (402, f"text {gap} end"),
        (403, "This work is licensed under the GNU General Public License, version 3."), (404, "License of the work is the public version."),
        (405, "cc by nc cc-by-nc"), (406, "Apache License, Version 2.0"), (407, "Permission is hereby granted, free of charge"),
    ]
    rows = licenses.scan_licenses(docs_of(docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["n_words"] == len(plain_words(r["text"]))
        assert sorted((p["at"], p["label"]) for p in r["places"]) == sorted(base_places(r["text"]))
    spans = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in rows}
    assert spans == {i: found_by_sliding(t) for i, t in docs}
    assert spans[401] == {"mit"} and spans[402] == {"mit"} and "gpl-3" in spans[403]
    assert not spans[404] and not spans[407] and not any(spans[i] for i, _ in corpus if i is not None)
    share = next(s["share"] for r in rows if r["doc_id"] == 402 for s in r["spans"])
    assert 0.8 <= share < 1.0
    assert licenses.scan_licenses(docs_of([(1, "x")]).filter("doc_id = 2")).count() == 0


TOKENIZER = tokens.VOCABULARY


def reference(vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(list(zip(vocabulary.pieces, vocabulary.scores)), unk_id=vocabulary.unknown, byte_fallback=vocabulary.byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.SPACE, prepend_scheme="always", split=False)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_tokens_of_an_empty_table_and_clashing_names(docs_of):
    vocabulary = tokens.read_vocabulary(TOKENIZER)
    table = docs_of([(1, "some words")]).withColumn("n_tokens", F.lit("clash"))
    assert tokens.count_tokens(table.filter("doc_id = 2"), vocabulary).count() == 0
    assert isinstance(tokens.count_tokens(table, vocabulary).first()["n_tokens"], int)


def test_token_counts(docs_of, corpus):
    vocabulary = tokens.read_vocabulary(TOKENIZER)
    exact = reference(vocabulary)
    rng = random.Random(6)
    odd = [(500 + k, "".join(rng.choice(["a", " ", "  ", "\n", "é", "執", "😀", "<s>", "<0x0A>", "▁", "the", "\t", "\u0000"]) for _ in range(rng.randint(1, 40)))) for k in range(300)]
    rows = tokens.count_tokens(docs_of(corpus + odd), vocabulary).collect()
    assert len(rows) == len(corpus) + 300
    for r in rows:
        assert r["n_tokens"] == (exact(r["text"]) if r["text"] else 0), r["text"]


@pytest.mark.parametrize("fallback", [False])
def test_token_ties_and_unknown_runs(fallback):
    vocabulary = tokens.Vocabulary(("<unk>", "a", "b", "ab", "▁a", "▁", "aba", "ba", "abab"), (0.0, -1.5, -1.25, -2.75, -2.0, -0.5, -4.25, -2.75, -5.5), 0, fallback)
    count, exact = tokens.token_counter(vocabulary), reference(vocabulary)
    rng = random.Random(2)
    for _ in range(800):
        text = "".join(rng.choice("ab zé") for _ in range(rng.randint(1, 20)))
        assert count(text) == exact(text), text


def test_lower_casing_is_of_ascii_only(spark):
    from veingraph.llm.common import plain_words as column

    texts = ["ÉCOLE Été STRASSE ẞ İ", "ABC-Def_9 ~x", "Ünder\u007fDEL"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]
    assert got == [plain_words(t) for t in texts] and LOWER
