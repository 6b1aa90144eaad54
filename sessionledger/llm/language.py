"""Language ID by words first, backing off to ever shorter character n-grams.

The model holds, per language, the relative frequencies of words and of character n-grams (of words with
a blank at either end). A word that any language knows scores by its log frequency in each; a language
that does not know it takes a penalty. An unknown word is cut into its longest n-grams; those that any
language knows are averaged, and if none is known the next shorter n-grams are tried. A document's score
per language is the mean over its words; ``score`` is the share of the best language among all after
raising 10 to those means.

Training reads about ``TRAIN_ROWS`` different labelled texts per language, drawn by a hash of the text, so a text in
many rows counts once. It keeps the ``TABLE_ROWS`` most frequent words and n-grams of each length per language. If
there are so many languages that this passes ``MODEL_ROWS`` entries, the tables of all are shorter; no language is
left out. These numbers bound the model that is sent to the workers: sorted 64-bit hashes of the tokens, and for
each the languages that know it with their scores. One row per language reaches the driver besides. Prediction reads
the whole of every text, and nothing but the text; a very long text is summed over slices of its distinct words.

``und`` (score 0) is the answer for a null text and for one without a letter. If nothing could be learned, all texts
are ``und``. Repeated rows get the same answer. A column named ``language`` is replaced; others pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
TRAIN_ROWS = 1_500
TABLE_ROWS = 30_000
MODEL_ROWS = 6_000_000
MAX_N = 5
PENALTY = 7.0
WORDS_KEPT, CELLS_KEPT = 120_000, 2_000_000  # of a worker's memory of scored words
SLICE = 1_000  # distinct words of a text scored at a time
MIN_SCORE = 0.4
SEED = 42  # of the hash that the engine's xxhash64 computes

_runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters (with number forms that are no digits); none if there is no letter at all."""
    out = _runs(text.lower())
    return out if any(w.isalpha() or any(map(str.isalpha, w)) for w in out) else []


def grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def token_keys(tokens: list[str]) -> np.ndarray:
    """What ``xxhash64`` gives for the tokens in a query."""
    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), SEED) for t in tokens], dtype=np.uint64).view(np.int64)


def packed(langs: list[str], n: np.ndarray, key: np.ndarray, place: np.ndarray, score: np.ndarray) -> dict:
    """A model of entries: length (0 for words), hash of the token, place of the language in ``langs``, log frequency.

    ``{"langs": [...], n: (keys, offsets, places, scores)}``: entries ``offsets[i]`` to ``offsets[i + 1]`` belong to ``keys[i]``.
    """
    model: dict = {"langs": langs}
    for k in range(MAX_N + 1):
        at = np.flatnonzero(n == k)
        at = at[np.lexsort((place[at], key[at]))]
        keys, first = np.unique(key[at], return_index=True)
        model[k] = (keys, np.append(first, len(at)).astype(np.int64), place[at].astype(np.int32), score[at].astype(np.float32))
    return model


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """Tables of log frequencies, as ``packed`` makes them; ``{"langs": []}`` if there is nothing to learn from."""
    labelled = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    known = rows.sparkSession.createDataFrame([(k, i, min(1.0, TRAIN_ROWS / max(1, sizes[k]))) for i, k in enumerate(langs)], "lang string, place int, share double")
    draw = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # copies of a text are drawn together and meet in the task already
    sample = labelled.join(F.broadcast(known), "lang").filter(draw < F.col("share")).select("lang", "text").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for pdf in batches:
            for k, t in zip(pdf["lang"], pdf["text"]):
                words.setdefault(k, Counter()).update(words_of(t))
        for k in list(words):
            c = words.pop(k)
            for n in range(MAX_N + 1 if c else 0):  # one table at a time: a worker does not give memory back
                t = c if n == 0 else Counter()
                for w, m in c.items() if n else ():
                    for g in grams(w, n):
                        t[g] += m
                yield pd.DataFrame({"lang": k, "n": n, "token": list(t), "m": list(t.values())})

    counts = sample.mapInPandas(count, "lang string, n int, token string, m long").groupBy("lang", "n", "token").agg(F.sum("m").alias("m"))
    order = Window.partitionBy("lang", "n").orderBy(F.desc("m"), "token")
    total = F.sum("m").over(Window.partitionBy("lang", "n"))
    most = max(1, min(TABLE_ROWS, MODEL_ROWS // (len(langs) * (MAX_N + 1))))
    top = counts.select("*", total.alias("total"), F.row_number().over(order).alias("k")).filter(F.col("k") <= most).join(F.broadcast(known), "lang")
    score = F.greatest(F.lit(-PENALTY), F.log10(F.col("m") / F.col("total")))
    got = top.select("n", F.xxhash64("token").alias("key"), "place", score.cast("float").alias("score")).toArrow()  # at most MODEL_ROWS
    return packed(langs, *(got[c].to_numpy() for c in ("n", "key", "place", "score")))


def _found(model: dict, n: int, tokens: list[str], owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner below ``size`` the number of its tokens that any language knows, and the sums of their scores by language."""
    keys, offsets, places, scores = model[n]
    wide = len(model["langs"])
    if not len(keys) or not tokens:
        return np.zeros(size), np.zeros((size, wide))
    key = token_keys(tokens)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys[at] == key
    at, owner = at[hit], owner[hit]
    many = np.bincount(owner, minlength=size).astype(float)
    each = offsets[at + 1] - offsets[at]
    entry = np.repeat(offsets[at] - (each.cumsum() - each), each) + np.arange(each.sum())
    cell = np.repeat(owner, each) * wide + places[entry]
    above = np.bincount(cell, weights=scores[entry] + PENALTY, minlength=size * wide).reshape(size, wide)
    return many, above - PENALTY * many[:, None]


def word_scores(model: dict, words: list[str]) -> np.ndarray:
    """Log scores of words by language, and a last column that is 1, or 0 if not even a letter of the word is known."""
    out = np.zeros((len(words), len(model["langs"]) + 1))
    left = np.arange(len(words))
    for n in (0, *range(MAX_N, 0, -1)):
        pieces = [[words[i]] if n == 0 else [g for g in grams(words[i], n) if g != " "] for i in left]
        owner = np.repeat(np.arange(len(left)), [len(p) for p in pieces])
        many, sums = _found(model, n, [g for p in pieces for g in p], owner, len(left))
        has = many > 0
        out[left[has], :-1] = sums[has] / many[has, None]
        out[left[has], -1] = 1.0
        left = left[~has]
        if not len(left):
            break
    return out


def predictor(model: dict):
    """text -> (language, score). Scores of words seen are kept as rows of a matrix of bounded size."""
    langs = model["langs"]
    room = max(1_000, min(WORDS_KEPT, CELLS_KEPT // (len(langs) + 1)))
    rows, scores = {}, np.zeros((1_000, len(langs) + 1))  # the last column tells words that count

    def learn(new: list[str]) -> None:
        nonlocal scores
        while len(rows) + len(new) > len(scores):
            scores = np.vstack([scores, np.zeros_like(scores)])
        scores[len(rows):len(rows) + len(new)] = word_scores(model, new)
        rows.update(zip(new, range(len(rows), len(rows) + len(new))))

    def predict(text: str | None) -> tuple[str, float]:
        counted = Counter(words_of(text)) if text else {}
        if not counted or not langs:
            return UNDETERMINED, 0.0
        words, sums = list(counted), np.zeros(len(langs) + 1)
        for i in range(0, len(words), SLICE):
            part = words[i:i + SLICE]
            new = [w for w in part if w not in rows]
            if new and len(rows) + len(new) > room:
                rows.clear()
                new = part
            if new:
                learn(new)
            sums += np.array([counted[w] for w in part], dtype=float) @ scores[[rows[w] for w in part]]
        if not sums[-1]:
            return langs[0], 1 / len(langs)
        means = sums[:-1] / sums[-1]
        best = int(means.argmax())
        return langs[best], float(1 / (10 ** (means - means[best])).sum())

    return predict


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``language``: lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = predictor(sent.value)
        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=["lang_pred", "score"])

    return docs.withColumn("language", F.pandas_udf(predict, "lang_pred string, score double")(F.col(text)))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 3 == 1
