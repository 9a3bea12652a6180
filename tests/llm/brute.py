"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substrings(docs, size=20):
    """{(id, text): (n_words, n_removed, sha)}; rows of one id are taken in the order given."""
    seen, out = {}, {}
    for doc_id, text in docs:
        words = blank_words(text)
        gone = set()
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            if seen.setdefault(window, (doc_id, text, k)) != (doc_id, text, k):
                gone.update(range(k, k + size))
        out[doc_id, text] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def byte_strings(docs, size=400):
    places = Counter()
    unique = {(i, t or "") for i, t in docs}
    for _, text in unique:
        data = text.encode()
        places.update(data[k : k + size] for k in range(len(data) - size + 1))
    out = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - size + 1):
            if places[data[k : k + size]] > 1:
                gone[k : k + size] = [True] * size
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[doc_id, text] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return out


def phrases(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(item)
    out = {}
    for doc_id, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (items_ := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= items_
        out[doc_id, text] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def text_stats(text):
    words = blank_words(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    repeated = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if blank_words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def shingles(text, size=5):
    w = plain_words(text)
    n = min(size, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else None


def similarity(a, b):
    if not a or not b:
        return 0.0
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def groups(docs, threshold=0.8):
    """A number for each row: that of its class."""
    bags = [shingles(t) for _, t in docs]
    sizes = [sum(b.values()) if b else 0 for b in bags]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i] == docs[j]:
                parent[find(i)] = find(j)
            elif min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]) and similarity(bags[i], bags[j]) >= threshold - 1e-9:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(docs))]


def classes(docs, threshold=0.8):
    """The smallest id of each row's class."""
    of, ids = groups(docs, threshold), defaultdict(list)
    for g, (doc_id, _) in zip(of, docs):
        ids[g].append(doc_id)
    least = {g: min((x for x in v if x is not None), default=None) for g, v in ids.items()}
    return [least[g] for g in of]


def lines(docs, depth=6, min_docs=3):
    """[(n_lines, n_dropped, text)] row by row, by comparing every line of a leaf with its commonest one."""
    masked = lambda line: tuple("<*>" if re.search("[0-9]", t) else t for t in blank_words(line))
    name = lambda w: hashlib.md5(f"{len(w)} {' '.join(w)}".encode()).hexdigest()[:16]
    has_template = lambda w: any(t != "<*>" for t in w)
    held = Counter(w for _, text in docs if text is not None for w in set(map(masked, text.split("\n"))) if has_template(w))
    commonest = {}
    for w in sorted(held, key=lambda w: (-held[w], name(w))):
        commonest.setdefault((len(w), w[:depth]), w)

    def template(w):
        top = commonest[len(w), w[:depth]]
        return top if 10 * sum(a == b for a, b in zip(w, top)) >= 8 * len(w) else w

    owners = defaultdict(set)
    for doc_id, text in docs:
        for w in set(map(masked, (text or "").split("\n"))):
            if has_template(w):
                owners[template(w)].add((doc_id, text))
    first = {t: min((i for i, _ in ids if i is not None), default=None) for t, ids in owners.items() if len(ids) >= min_docs}
    out = []
    for doc_id, text in docs:
        if text is None:
            out.append((0, 0, None))
            continue
        every = text.split("\n")
        kept = [x for x in every if not has_template(masked(x)) or template(masked(x)) not in first or first[template(masked(x))] == doc_id]
        out.append((len(every), len(every) - len(kept), "\n".join(kept)))
    return out
