"""Substring, byte and near-duplicate operators against brute force."""

import random

import numpy as np
import pytest

from brute import byte_strings, classes, plain_words, sha, similarity, shingles, substrings
from veingraph.llm import neardup, rolling, substrings as sub, suffixes


def expected_rows(docs, results):
    return sorted(repr((i, *results[i, t])) for i, t in docs)


def ordered(corpus, spark):
    """Documents in the operators' order: by id, nulls last, then by the hash of the row."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(corpus, "doc_id long, text string").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    return [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))]


@pytest.mark.parametrize("hot", [False, True])
def test_substrings(spark, docs_of, corpus, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(sub, "HOT_ROWS", 1)
    docs = ordered(corpus, spark)
    found = sub.dedup_substrings(docs_of(docs).repartition(5)).collect()
    got = sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept"]))) for r in found)
    assert got == expected_rows(docs, substrings(docs))
    assert any(r["n_removed"] for r in found)


@pytest.mark.parametrize("hot", [False, True])
def test_bytes(docs_of, corpus, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(sub, "HOT_ROWS", 1)
    found = suffixes.dedup_bytes(docs_of(corpus).repartition(5)).collect()
    got = sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"])))) for r in found)
    assert got == expected_rows(corpus, byte_strings(corpus))
    assert any(0 < r["n_removed"] < r["n_bytes"] for r in found)


@pytest.mark.parametrize("module", [sub, suffixes])
def test_groups_that_are_rare_in_each_chunk(spark, docs_of, monkeypatch, module):
    """A passage of 60 documents, of which a chunk holds about three, is dealt out by window."""
    seen, search = [], module.common_groups
    monkeypatch.setattr(sub, "HOT_ROWS", 30)
    monkeypatch.setattr(module, "common_groups", lambda found: seen.append(search(found)) or seen[-1])
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(90)
    docs = ordered([(i, f"{text(30)} {passage} {text(30)}") for i in range(60)], spark)
    rows = docs_of(docs).repartition(20)
    if module is sub:
        got = sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept"]))) for r in sub.dedup_substrings(rows).collect())
        assert got == expected_rows(docs, substrings(docs))
    else:
        found = suffixes.dedup_bytes(rows).collect()
        got = sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"])))) for r in found)
        assert got == expected_rows(docs, byte_strings(docs))
    assert len(seen) == 1 and len(seen[0])


def test_random_byte_passages(docs_of):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.randint(300, 900))) for _ in range(6)]
    docs = []
    for i in range(40):
        a, b = rng.choice(pool), rng.choice(pool)
        docs.append((i, a[rng.randint(0, 200) :] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 300))) + b[: rng.randint(0, len(b))]))
    found = suffixes.dedup_bytes(docs_of(docs)).collect()
    got = sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"])))) for r in found)
    assert got == expected_rows(docs, byte_strings(docs))


def test_random_word_passages(spark, docs_of):
    rng = random.Random(6)
    docs = []
    for i in range(40):
        docs.append((i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))))
        docs.append((100 + i, " ".join(f"w{(i * 7 + k * (1 + i % 2)) % 50}" for k in range(rng.randint(0, 90)))))
    docs = ordered(docs, spark)
    found = sub.dedup_substrings(docs_of(docs).repartition(3)).collect()
    got = sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept"]))) for r in found)
    assert got == expected_rows(docs, substrings(docs))


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_arrays(letters):
    rng = random.Random(letters)
    for n in (1, 2, 3, 7, 40, 300):
        text = [rng.randint(1, letters) for _ in range(n)]
        text += text[: n // 2] + [0]
        order = suffixes.suffix_array(np.array(text)).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        longest = suffixes.common_prefixes(np.array(text), np.array(order), 9)
        for i in range(0, len(text), 11):
            best = 0
            for j in range(len(text)):
                k = 0
                while j != i and k < 9 and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            assert longest[i] == best


def test_recursion_of_names():
    """Strings whose names repeat for several levels, and whose alphabets are large."""
    rng = random.Random(1)
    for letters in (2, 3, 900, 70_000):
        text = [rng.randint(1, letters) for _ in range(1500)]
        used = {c: k for k, c in enumerate(sorted(set(text)), 1)}
        text = [used[c] for c in text]
        text = text + text + text[:700] + [0]
        assert suffixes.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    periodic = [1, 2, 1, 2, 2] * 300 + [0]
    assert suffixes.suffix_array(np.array(periodic)).tolist() == sorted(range(len(periodic)), key=lambda i: periodic[i:])


def test_claimed_prefixes_are_compared_symbol_by_symbol():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 3, 400).astype(np.uint16)
    text[200:300] = text[50:150]
    a, b = rng.integers(0, 180, 300), rng.integers(0, 180, 300) + 190
    a[:60], b[:60] = np.arange(50, 110), np.arange(200, 260)
    claimed = rng.integers(1, 30, 300)
    for x, y, n, true in zip(a, b, claimed, suffixes.exact_prefixes(text, a, b, claimed)):
        differs = np.flatnonzero(text[x : x + n] != text[y : y + n])
        assert true == (differs[0] if len(differs) else n)


def test_suffix_arrays_decide_about_different_runs(docs_of, corpus, monkeypatch):
    """Without them, strings that only different runs of windows share stay."""
    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(600)
    docs = [(i, text(300) + passage + text(300)) for i in range(3)]
    whole = sum(r["n_removed"] for r in suffixes.dedup_bytes(docs_of(docs)).collect())
    monkeypatch.setattr(suffixes, "shard_matches", lambda pieces, sizes, length: np.zeros(len(pieces), bool))
    without = sum(r["n_removed"] for r in suffixes.dedup_bytes(docs_of(docs)).collect())
    assert 1800 <= whole <= 1820 and without < whole


def test_shared_passages_that_are_too_short_to_go(docs_of):
    """A passage of 320 bytes in two documents is told of; what one document repeats by itself is not."""
    rng = random.Random(16)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [text(320) for _ in range(20)]
    docs = [(i, text(500) + passages[i % 20] + text(500)) for i in range(40)]
    own = text(320)
    docs += [(50, text(800)), (51, text(200) + own + text(200) + own), (52, None), (53, "short")]
    rows = {r["doc_id"]: r for r in suffixes.dedup_bytes(docs_of(docs)).collect()}
    assert all(100 <= rows[i]["n_shared"] <= 330 and not rows[i]["n_removed"] for i in range(40))
    assert not any(rows[i]["n_shared"] for i in range(50, 54))


@pytest.mark.parametrize("size", [2, 5, 13, 20, 40, 100])
def test_parse_depends_on_the_window_alone(size):
    """A window's core is the same in any context, runs at its ends included, and lies inside it."""
    rng = random.Random(2)
    for letters in ("ab", "abcd", [f"w{k}" for k in range(500)]):
        for _ in range(100):
            inner = [rng.choice(letters) for _ in range(size)]
            seen = set()
            for _ in range(4):
                left, right = ([rng.choice(letters) for _ in range(rng.randint(0, 40))] for _ in range(2))
                _, pos, anchor, group, match, span = sub.parsed_windows([" ".join(left + inner + right).encode()], size)
                k = int(np.flatnonzero(pos == len(left))[0])
                at = int(anchor[k]) - len(left)
                assert 0 <= at and at + span[k] <= size
                seen.add((at, int(group[k]), int(match[k]), int(span[k])))
            assert len(seen) == 1


def test_symbols_span_much_of_a_window(monkeypatch):
    """Cores are symbols of high levels; a recompression that joins nothing leaves single words."""
    rng = random.Random(3)
    text = [" ".join(f"w{rng.randrange(4000)}" for _ in range(4000)).encode()]
    for size, least in ((20, 4), (40, 8), (100, 18)):
        assert sub.parsed_windows(text, size)[5].mean() >= least
    monkeypatch.setattr(sub, "recompress", lambda names, starts, first, k: (names, np.zeros(len(names), bool), np.zeros(len(names), np.int8)))
    assert sub.parsed_windows(text, 20)[5].mean() == 1


@pytest.mark.parametrize("module", [sub, suffixes])
def test_dealing_hardly_depends_on_the_number_of_buckets(module):
    import time

    import pyarrow as pa

    rng = random.Random(4)
    words = [f"word{k}" for k in range(20_000)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array(texts)], ["id", "h", "text"])
    none, seconds, size = np.zeros(0, np.uint64), {}, {}
    for n in (128, 7_500, 250_000, 128, 250_000):
        began = time.process_time()
        out = list(module._deal(iter([batch]), 400 if module is suffixes else 20, n, none))
        seconds[n], size[n] = time.process_time() - began, sum(b.nbytes for b in out)
    assert size[250_000] < 1.6 * size[128]
    assert seconds[250_000] < 2.5 * seconds[128] + 0.2


@pytest.mark.parametrize("kind", ["string", "long"])
def test_long_texts_and_other_ids(spark, corpus, monkeypatch, kind):
    """Texts of many segments, a null id and ids that are no numbers, or the largest one."""
    monkeypatch.setattr(rolling, "CHUNK_BYTES", 700)
    monkeypatch.setattr(sub, "CHUNK_BYTES", 700)
    docs = [((2**63 - 1 if i == 5 else i), t) for i, t in dict(corpus).items()]
    docs = [(i if i is None or kind == "long" else f"{i:020d}", t) for i, t in docs]
    rows = spark.createDataFrame(docs, f"doc_id {kind}, text string").repartition(3)
    found = sub.dedup_substrings(rows).collect()
    ranked = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept"]))) for r in found) == expected_rows(ranked, substrings(ranked))
    found = suffixes.dedup_bytes(rows).collect()
    got = sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"])))) for r in found)
    assert got == expected_rows(docs, byte_strings(docs))


def test_word_segments():
    rng = random.Random(5)
    for _ in range(200):
        text = b"".join(rng.choice([b"a", b"bb", b" ", b"\n ", b"ccc"]) for _ in range(rng.randint(0, 60)))
        size, overlap = rng.randint(1, 12), rng.randint(0, 4)
        words, seen = text.split(), set()
        for offset, part in rolling.word_segments(text, size, overlap):
            own = part.split()
            assert own == words[offset : offset + len(own)]
            seen |= {(offset + k) for k in range(len(own) - overlap)}
        assert seen >= set(range(len(words) - overlap))


@pytest.mark.parametrize("small", [64, 2])
def test_near_duplicates(docs_of, corpus, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    found = neardup.near_duplicates(docs_of(corpus)).collect()
    got = sorted(repr((r["doc_id"], r["text"], r["class_id"])) for r in found)
    assert got == sorted(repr((i, t, c)) for (i, t), c in zip(corpus, classes(corpus)))
    by_class = {}
    for r in found:
        key = r["class_id"] if r["class_id"] is not None else r["text"]
        by_class.setdefault(key, []).append(r["kept"])
    same_id = {3}  # two texts of one id are in two classes of that id
    assert all(sum(k) == 1 for c, k in by_class.items() if c not in same_id)
    links = {}
    for r in found:
        links.setdefault(r["class_id"], []).append(r["n_links"])
    texts = {c: {tuple(plain_words(r["text"])) for r in found if r["class_id"] == c} for c in links}
    assert all((max(n) > 0) == (len(texts[c]) > 1) and max(n) < len(texts[c]) for c, n in links.items() if c not in same_id | {None})
    assert all(r["lang"] == "en" and r["node"] == "n" for r in found)


def test_chain_of_near_copies(docs_of):
    """Neighbours are similar, the ends are not: links connect them all."""
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(30):
        docs.append((i, " ".join(words)))
        words = [*words[6:], *(f"v{i}_{k}" for k in range(6))]
    assert similarity(shingles(docs[0][1]), shingles(docs[1][1])) >= 0.8 > similarity(shingles(docs[0][1]), shingles(docs[9][1]))
    found = neardup.near_duplicates(docs_of(docs)).collect()
    assert {r["class_id"] for r in found} == {0} and sum(r["kept"] for r in found) == 1


@pytest.mark.parametrize("large", [4096, 12])
def test_large_buckets_within_a_task(docs_of, monkeypatch, large):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 1)
    monkeypatch.setattr(neardup, "LARGE_BUCKET", large)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(150)] = f"x{i}_{rng.randrange(99)}"
        docs.append((i, " ".join(words)))
    found = neardup.near_duplicates(docs_of(docs)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == sorted(zip(range(60), classes(docs)))


def test_oversized_buckets_in_blocks(docs_of, monkeypatch):
    """Pairs that are similar to each other alone, in buckets that no split makes fit and whose centres link none of them."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 1)
    monkeypatch.setattr(neardup, "LARGE_BUCKET", 6)
    base, docs = [f"w{i}" for i in range(400)], []
    for i in range(40):
        docs.append((i, " ".join(base + [f"p{i // 2}q{k}" for k in range(8)] + [f"x{i}y{k}" for k in range(46)])))
    bags = [shingles(t) for _, t in docs]
    assert similarity(bags[0], bags[1]) >= 0.8 > similarity(bags[1], bags[2])
    found = neardup.near_duplicates(docs_of(docs)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == sorted(zip(range(40), classes(docs)))


def test_near_copies_of_a_very_long_text(docs_of):
    rng = random.Random(31)
    words = [f"w{rng.randrange(10**5)}" for _ in range(400_000)]
    near = [w if k % 97 else "other" for k, w in enumerate(words)]
    docs = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:200_000])), (4, "x" * 3_000_000)]
    assert len(docs[0][1]) > 2 * rolling.CHUNK_BYTES
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(docs)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    found = {r["doc_id"]: r for r in sub.dedup_substrings(docs_of(docs)).collect()}
    assert (found[1]["n_removed"], found[3]["n_removed"], found[3]["n_words"], found[4]["n_words"]) == (0, 200_000, 200_000, 1)
    cut = {r["doc_id"]: r for r in suffixes.dedup_bytes(docs_of(docs)).collect()}
    assert cut[3]["n_removed"] == cut[3]["n_bytes"] and cut[4]["kept"] == b"" and cut[1]["n_removed"] >= cut[3]["n_bytes"]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    a = {int(e): int(w) for e, w in zip(rng.integers(1, 1 << 62, 400), rng.integers(1, 5, 400))}
    b = {e: (w if k % 3 else max(1, w - 1)) for k, (e, w) in enumerate(a.items()) if k % 7}
    truth = sum(min(a.get(e, 0), b.get(e, 0)) for e in a) / sum(max(a.get(e, 0), b.get(e, 0)) for e in a)
    doc = np.repeat([0, 1], [len(a), len(b)])
    signature = neardup.signatures(doc, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2)
    assert (signature != 0).all()
    assert abs((signature[0] == signature[1]).mean() - truth) < 0.13


def test_empty_tables(docs_of, spark):
    none = docs_of([(1, "x")]).filter("doc_id = 2")
    assert sub.dedup_substrings(none).count() == 0
    assert suffixes.dedup_bytes(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    nulls = docs_of([(None, None), (1, None), (2, "")])
    assert {(r["n_words"], r["n_removed"], r["kept"]) for r in sub.dedup_substrings(nulls).collect()} == {(0, 0, "")}
    assert {(r["n_bytes"], r["n_spans"]) for r in suffixes.dedup_bytes(nulls).collect()} == {(0, 0)}
    assert sorted(repr(r["class_id"]) for r in neardup.near_duplicates(nulls).collect()) == ["1", "2", "None"]


def test_limits_are_checked(docs_of):
    with pytest.raises(ValueError):
        sub.dedup_substrings(docs_of([]), 1)
    with pytest.raises(ValueError):
        suffixes.dedup_bytes(docs_of([]), 100)


def test_sliding_argmin_takes_the_leftmost():
    values = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64) << np.uint64(20)
    assert rolling.sliding_argmin(values, 3).tolist() == [1, 1, 4, 4, 4]
