import re
from collections import Counter
from fractions import Fraction

import pytest

from sessionledger.llm import collocations


def brute(rows, least=10, top=2000, longest=3):
    n, f = Counter(), {}
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            c = f.setdefault(lang or "und", Counter())
            for k in range(1, longest + 1):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p for q, b in cands.items() if len(q) == 3 for p in (q[:2], q[1:]) if p in cands and 100 * b >= 50 * cands[p]}
        best = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((Fraction(1_000_000 * a * a, c[p[:k]] * c[p[k:]]).__floor__(), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def rows_of(df):
    return [(r.lang, r.text) for r in df.select("lang", "text").collect()]


@pytest.mark.parametrize("top", [2000, 7])
def test_brute_force(spark, docs, empty, small, top):
    part = small.limit(120).unionByName(docs.select("doc_id", "text", "lang", "source"))
    assert found(collocations.collocations(part, top=top)) == brute(rows_of(part), top=top)
    assert collocations.collocations(empty).count() == 0


def test_slices(monkeypatch, texts):
    """A text cut into hundreds of slices has the same phrases as a whole one."""
    words = [collocations.normal(t or "") for t in texts] + [b"a" * 5_000 + b" b " + b"c" * 700 + b",d e f" * 300]
    hasher = collocations.Hasher()
    whole = {n: Counter(collocations.phrases([(x, len(x)) for x in words], n, hasher)[0].tolist()) for n in (1, 2, 3)}
    monkeypatch.setattr(collocations, "SLICE", 300)
    for n in (1, 2, 3):
        cut = Counter()
        for x in words:
            for _, data, own in collocations.slices(x, n):
                cut.update(collocations.phrases([(data, own)], n, hasher)[0].tolist())
        assert cut == whole[n] and cut


def test_collisions(spark):
    """With small primes most fingerprints stand for several phrases; the counts stay exact as long as the check tells them apart."""
    vocab = [f"w{i}" for i in range(40)]
    text = " ".join(vocab[(i * i + i // 7) % 40] for i in range(4000)) + ". " + "one two three. " * 30
    df = spark.createDataFrame([(1, text, "en"), (2, text[::-1], "en"), (3, text, None)], "doc_id long, text string, lang string").repartition(3)
    got = found(collocations.collocations(df, primes=(13, 11, collocations.PRIMES[2])))
    assert got == brute(rows_of(df)) and len(got) > 50


def test_exact_score(spark):
    rows = [(123456789012345, 123456789012346, 123456789012345), (10, 10, 10), (10, 3_000_000_000, 4_000_000_000), (3, 7, 11)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.exact_score().alias("score"))
    assert all(r.score == 1_000_000 * r.a * r.a // (r.l * r.r) for r in df.collect())


def test_ties_and_other_blanks(spark):
    text = "a b c\td\x0bc  d, A B; a b\nA b! " * 12 + "no.end"
    df = spark.createDataFrame([(None, text, "x"), (None, text, "x")], "doc_id long, text string, lang string")
    assert found(collocations.collocations(df)) == brute(rows_of(df))
