import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionledger.llm import language


def test_held_out_accuracy(small):
    held = language.held_out(F.col("doc_id"))
    model = language.train(small.filter(~held))
    told = language.identify(small.filter(held), model).collect()
    right = sum(r.language.lang_pred == r.lang for r in told)
    assert right >= 0.95 * len(told)
    assert all(0 <= r.language.score <= 1 for r in told)


def by_hand(langs, tables):
    rows = [(n, language.token_keys([t])[0], i, x) for n, table in tables.items() for t, scores in table.items() for i, x in enumerate(scores)]
    return language.packed(langs, *(np.array(c) for c in zip(*rows)))


def test_backs_off_to_shorter_grams():
    model = by_hand(["a", "b"], {0: {"known": [-1.0, -7.0]}, 1: {"z": [-7.0, -1.0]}, 3: {"abc": [-2.0, -3.0]}})
    assert language.word_scores(model, ["known", "xabcx", "zq", "qq"]).tolist() == [[-1.0, -7.0, 1.0], [-2.0, -3.0, 1.0], [-7.0, -1.0, 1.0], [0.0, 0.0, 0.0]]
    one = language.predictor(model)
    assert one("known known")[0] == "a" and one("z")[0] == "b"
    assert one(None) == one("") == one("12 -- _") == ("und", 0.0)


def test_hashes_are_those_of_the_engine(spark):
    tokens = ["the", " a", "na\u00efve", "\u65e5\u672c", "\U0001d4b3", "x" * 100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    assert [r.k for r in df.select("i", F.xxhash64("t").alias("k")).orderBy("i").collect()] == language.token_keys(tokens).tolist()


def brute(rows, langs):
    """The model by its definition: dicts of scores per language over all of the texts, most frequent entries first."""
    tables = {}
    for k in langs:
        words = Counter(w for t in sorted({t for t, x in rows if x == k and t}) for w in language.words_of(t))
        for n in range(language.MAX_N + 1):
            c = Counter()
            for w, m in words.items():
                for g in [w] if n == 0 else language.grams(w, n):
                    c[g] += m
            total = sum(c.values())
            top = sorted(c.items(), key=lambda e: (-e[1], e[0].encode()))[:language.TABLE_ROWS]
            tables[k, n] = {g: max(-language.PENALTY, math.log10(m / total)) for g, m in top}

    def score(word):
        for n in (0, *range(language.MAX_N, 0, -1)):
            known = [g for g in ([word] if n == 0 else language.grams(word, n)) if g != " " and any(g in tables[k, n] for k in langs)]
            if known:
                return [sum(tables[k, n].get(g, -language.PENALTY) for g in known) / len(known) for k in langs]

    def predict(text):
        rows = [s for s in map(score, language.words_of(text or "")) if s]
        if not rows:
            return None
        means = [sum(c) / len(rows) for c in zip(*rows)]
        return langs[means.index(max(means))], 1 / sum(10 ** (m - max(means)) for m in means)

    return predict


@pytest.mark.parametrize("table_rows", [40, 30_000])
def test_same_as_brute_force(small, monkeypatch, table_rows):
    monkeypatch.setattr(language, "TABLE_ROWS", table_rows)
    rows = [(r.text, r.lang) for r in small.filter("doc_id % 3 != 0").select("text", "lang").collect()]
    assert max(Counter(k for _, k in rows).values()) <= language.TRAIN_ROWS
    predict = brute(rows, sorted({k for _, k in rows if k}))
    told = language.identify(small, language.train(small.filter("doc_id % 3 != 0"))).select("text", "language.*").collect()
    for r in told:
        want = predict(r.text)
        assert want is None or (r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-4)


def test_many_languages_and_a_text_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_ROWS", 20)
    monkeypatch.setattr(language, "MODEL_ROWS", 600 * 6 * 50)
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: letters[i // 26] + letters[i % 26]
    rows = [(f"{name(i)}{name(i)}{letters[j]} of{name(i)}", f"l{i:03}") for i in range(600) for j in range(4)]
    rows += [("one text that many share", "l007")] * 1200
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language.train(df)
    assert len(model["langs"]) == 600 and all(len(model[n][3]) <= 600 * 50 for n in range(language.MAX_N + 1))
    told = language.identify(df.distinct(), model).collect()
    assert sum(r.language.lang_pred == r.lang for r in told) >= 0.99 * len(told)


def test_long_texts_go_in_slices(monkeypatch, small):
    model = language.train(small)
    text = " ".join(r.text for r in small.select("text").collect() if r.text)
    whole = language.predictor(model)(text)
    monkeypatch.setattr(language, "SLICE", 7)
    monkeypatch.setattr(language, "WORDS_KEPT", 10)
    sliced = language.predictor(model)(text)
    assert whole[0] == sliced[0] and abs(whole[1] - sliced[1]) < 1e-9


def test_awkward_rows(docs, empty):
    model = language.train(docs)
    told = {(r.doc_id, r.text): r.language for r in language.identify(docs, model).collect()}
    assert told[0, None].lang_pred == told[1, ""].lang_pred == told[6, "1234 567 --"].lang_pred == "und"
    assert told[3, "one"].lang_pred in ("en", "fr")
    assert language.identify(docs, model).count() == docs.count()
    assert language.train(empty) == {"langs": []}
    assert {r.language.lang_pred for r in language.identify(docs, {"langs": []}).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
