import random
import re

import pytest

from sessionledger.llm import jaccard


def shingles(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    """(id, n_shingles, least id of the class) per row."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return [(k, len(s), least.get(top(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def order(rows):
    return sorted(rows, key=repr)


def copies(seed, n):
    """A chain of edits, clusters of near copies, and a passage that every text shares."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    out = []
    for c in range(n):
        w = [word() for _ in range(r.choice([8, 40, 120]))]
        for _ in range(r.choice([1, 2, 12])):
            v = list(w)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                v[r.randrange(len(v))] = word()
            out.append(" ".join(v) + (" " + passage if c % 2 else ""))
            if r.random() < 0.5:
                w = v
    r.shuffle(out)
    return out


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_same_as_brute_force(spark, monkeypatch, blocks, size, percent):
    if blocks:  # groups cut into many blocks, visitors dealt to several tasks, joins without broadcast
        monkeypatch.setattr(jaccard, "BLOCK_NODES", 3)
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
        monkeypatch.setattr(jaccard, "SENT_ROWS", 0)
    monkeypatch.setattr(jaccard, "LOCAL_DOCS", 50)
    rows = list(enumerate(copies(size + blocks, 25)))
    rows += [(9000, rows[0][1]), (9000, rows[0][1]), (None, rows[1][1]), (None, "only null ids in this class of nine words here"), (9001, "a b"), (9002, "A  b"), (9003, ""), (9004, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in jaccard.linked(df, size=size, percent=percent).collect()]
    assert order(got) == order(brute(rows, size, percent))


def test_awkward_rows(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert order(tuple(r) for r in jaccard.linked(docs).collect()) == order(brute(rows, 4, 85))
    assert jaccard.linked(empty).count() == 0


def test_one_row_of_each_class(docs, empty):
    out = jaccard.representatives(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = brute(rows, 4, 85)
    classes = {c for k, n, c in wanted if n}
    assert len(kept) == len(classes) + sum(n == 0 for _, n, _ in wanted)
    assert {k for k, t in kept if (t or "").strip()} == classes
    assert jaccard.representatives(empty).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50, 90)] + [(3, 1), (9, 3), (9, 9), (1, 3), (7, 5), (20, 10), (10, 15), (15, 90)]
    got = {r.k: r.root for r in jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 10} == {1: 1, 3: 1, 9: 1, 5: 5, 7: 5}
    assert {v for k, v in got.items() if k >= 10} == {10} and len(got) == 5 + 41 + 3
