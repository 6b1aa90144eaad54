import re
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sessionledger.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, divisor=None, length=6, least=5):
    n = {}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if divisor and key is not None and (h := zlib.crc32(f"{key}:{run}".encode())) % divisor == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= least}


def brute(n, ratio=5):
    out, form = {}, {}
    for w in n:
        near = sorted((-n[x], x) for x in n if x != w and one_edit(w, x))
        form[w] = near[0][1] if near and -near[0][0] >= ratio * n[w] else None
        out[w] = [n[w], len(near), form[w], n.get(form[w])]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return out


def found(df):
    return {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in df.collect()}


@pytest.mark.parametrize("pairs", [20_000, 2])
def test_pairs(spark, monkeypatch, pairs):
    """Every pair once, with small keys and with every key refined down to its rest."""
    monkeypatch.setattr(spelling, "PAIRS", pairs)

    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=2, max_size=60))
    def check(words):
        words |= {w + "a" for w in list(words)[:20]} | {"common" + w for w in list(words)[:20]}
        got = [(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in words for b in words if one_edit(a, b) and (len(a), a) < (len(b), b)}

    check()


def test_forms(spark):
    words = {"harbour": 1000, "harbor": 100, "harbr": 10, "harbur": 100, "harbours": 200, "barbour": 200, "études": 5, "etudes": 25, "alone": 7, "x" * 70_000: 9, "x" * 70_001: 45}
    got = found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words)
    assert got["harbr"][2:] == ["harbor", 100, "harbour"] and got["études"][2] == "etudes" and got["barbour"][4] == "harbour"


def test_awkward_rows(spark, docs, empty, texts):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for divisor in (None, 3):
        counted = spelling.count_words(docs, least_length=4, least_count=2, edit=spelling.without_every(divisor) if divisor else None)
        want = brute_words(rows, divisor, 4, 2)
        assert {r.word: r.n for r in counted.collect()} == want and want
    assert found(spelling.variants(counted)) == brute(want)
    assert spelling.variants(spelling.count_words(empty)).count() == 0
