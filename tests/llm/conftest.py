import random

import pytest

SMALL = "/root/testdata/sf0.001"

#: names that operators use inside
CLASHING = ("h", "k", "d", "m", "w", "n", "block", "label", "quality", "licence", "language", "shard", "slot", "offset", "sequence_id", "n_removed", "parts", "ids", "rank", "text_crc32")


@pytest.fixture(scope="session")
def texts():
    """Awkward texts: null, empty, blanks, ties, repeats, near copies and one very long text."""
    r = random.Random(3)
    vocab = ["the", "of", "and", "river", "stone", "harbour", "Window", "ladder", "MIT", "License,", "étude", "naïve", "42", "—", "x.y", "it's"]
    base = [" ".join(r.choice(vocab) for _ in range(40)) for _ in range(4)]
    near = [b.rsplit(" ", 1)[0] + " changed" for b in base]
    lines = "\n".join(f"line {i} of a passage that many share" for i in range(12))
    out = [None, "", " \t\n", "one", "two words", "a b c", "1234 567 --", *base, *near, base[0], base[0].upper(), lines, "intro\n" + lines + "\noutro", "start\n\n" + lines,
           "same line here\n" * 9, "tab\tand\x0bfeed\x0c end ", "a  b", "日本語 テキスト", " ".join(r.choice(vocab) for _ in range(30_000))]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids, a null id, a repeated row and columns of clashing names."""
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [(None, "a row without an id", "en", None), (3, "one", "en", "s1"), (3, "one", "en", "s1")]
    full = [(*row, *range(len(CLASHING))) for row in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` long" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
