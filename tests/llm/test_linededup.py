from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sessionledger.llm import linededup


def brute(rows):
    """rows of (id, text, chunks): the texts that are left."""
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    places = defaultdict(set)
    for r in rows:
        for i, c in enumerate(r[2] or []):
            if "\n" in c and c.strip():
                places[c].add((*order(r), i))
    out = []
    for r in rows:
        kept = [c for i, c in enumerate(r[2] or []) if c not in places or min(places[c]) == (*order(r), i)]
        out.append((r[0], "\n".join(kept) if r[1] is not None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [0, 400_000])
def test_same_as_brute_force(docs, small, empty, monkeypatch, sent):
    monkeypatch.setattr(linededup, "SENT_ROWS", sent)
    for df in (docs, small):
        cut = df.select("doc_id", "text", linededup.chunks_of(F.col("text")).alias("c")).collect()
        assert all(r.text is None or "\n".join(r.c) == r.text for r in cut)
        got = linededup.drop_repeats(df)
        assert sorted(((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()), key=repr) == brute([tuple(r) for r in cut])
        assert got.filter("n_removed > 0").count() > 0
    assert linededup.drop_repeats(empty).count() == 0


def test_boundaries_do_not_shift(spark):
    body = [f"line number {i} of a long passage" for i in range(200)]
    rows = [(0, "\n".join(body)), (1, "\n".join(["new", "lines", "in front", *body])), (2, "\n".join(body[:100] + ["put in between"] + body[100:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text.split("\n") for r in linededup.drop_repeats(df).collect()}
    assert left[0] == body
    assert {"new", "lines", "in front"} <= set(left[1]) and len(left[1]) < 15
    assert "put in between" in left[2] and len(left[2]) < 20


def test_single_lines_stay(spark):
    df = spark.createDataFrame([(i, f"same line\nown {i}") for i in range(5)] + [(9, "lone"), (10, "lone")], "doc_id long, text string")
    assert {r.text for r in linededup.drop_repeats(df).collect()} == {f"same line\nown {i}" for i in range(5)} | {"lone"}


def passages(rows, cuts):
    """rows of (id, text), chunks per text: the texts left when runs of repeated chunks, neighbouring lines and long lines go that have words enough."""
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")

    def seeds(text):
        lines, at = text.split("\n"), 0
        out = [(i, 2, "\n".join(lines[i:i + 2])) for i in range(len(lines) - 1)] + [(i, 1, x) for i, x in enumerate(lines) if len(x.split()) > 50]
        for c in cuts[text]:
            n = c.count("\n") + 1
            out += [(at, n, c)] if n > 2 else []
            at += n
        return [s for s in out if s[2].strip()]

    first = {}
    for r in sorted((r for r in rows if r[1] is not None), key=order):
        for at, n, piece in sorted(seeds(r[1])):
            first.setdefault(piece, (*order(r), at))
    out = []
    for r in rows:
        if r[1] is None:
            out.append((*r, 0, 0))
            continue
        lines = r[1].split("\n")
        again = [(at, n) for at, n, piece in seeds(r[1]) if first[piece] != (*order(r), at)]
        gone = {i for at, n in again for i in range(at, at + n)}
        for i in sorted(gone):
            if i - 1 in gone or i not in gone:
                continue
            run = list(range(i, next(j for j in range(i, len(lines) + 1) if j not in gone)))
            chunk = any(n > 2 and at in run for at, n in again)
            words = len(" ".join(lines[j] for j in run).replace("日本語", "日 本 語 ").replace("テキスト", "テ キ ス ト").split())
            if words < (linededup.CHUNK_WORDS if chunk else linededup.RUN_WORDS):
                gone -= set(run)
        out.append((r[0], "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return [x[:2] for x in out]


@pytest.mark.parametrize("length", [2, 3, 4, 5, 6, 8, 20])
def test_passages_go_from_end_to_end(spark, length):
    rows = []
    for n in range(8):
        body = [f"passage {length} {n} line {i}" for i in range(length)]
        rows += [(100 * n + d, "\n".join([f"own {n} {d} above", *body, f"own {n} {d} below"])) for d in range(3)]
    left = {r.doc_id: r.text for r in linededup.drop_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in range(8):
        assert left[100 * n] == rows[3 * n][1]
        assert all(left[100 * n + d] == f"own {n} {d} above\nown {n} {d} below" for d in (1, 2))


@pytest.mark.parametrize("sent", [0, 400_000])
def test_passages_by_brute_force(docs, small, empty, monkeypatch, sent):
    monkeypatch.setattr(linededup, "SENT_ROWS", sent)
    for df in (docs, small):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = [tuple(r) for r in linededup.drop_passages(df).select("doc_id", "text").collect()]
        bare = lambda rs: sorted(((k, None if t is None else [x for x in t.split("\n") if x.strip()]) for k, t in rs), key=repr)
        cuts = {r.text: r.c for r in df.select("text", linededup.chunks_of(F.col("text")).alias("c")).collect()}
        assert bare(got) == bare(passages(rows, cuts))
        lines = lambda rs: {x for _, t in rs if t for x in t.split("\n") if x.strip()}
        assert lines(got) == lines(rows)
    assert linededup.drop_passages(empty).count() == 0


def test_short_single_lines_stay_in_passages(spark):
    df = spark.createDataFrame([(i, f"same line\nown {i}") for i in range(5)] + [(9, "lone"), (10, "lone")], "doc_id long, text string")
    assert {r.text for r in linededup.drop_passages(df).collect()} == {f"same line\nown {i}" for i in range(5)} | {"lone"}


@pytest.mark.parametrize("blank", [" ", ""])
def test_long_single_lines_go(spark, blank):
    word = "word" if blank else "\u8a9e"
    long, short = blank.join([word] * 51), blank.join([word] * 50)
    rows = [(i, f"own {i} above\n{long}\nown {i} between\n{short}\nown {i} below") for i in range(3)] + [(7, long), (8, short), (9, short)]
    left = {r.doc_id: r.text for r in linededup.drop_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[0] == rows[0][1] and left[7] == "" and left[8] == left[9] == short
    assert all(left[i] == f"own {i} above\nown {i} between\n{short}\nown {i} below" for i in (1, 2))


def test_lines_that_say_nothing_stay(spark):
    rows = [(0, "def a():\n  x = 1\n  }\n}\ncall a"), (1, "def b():\n  y = 2\n  }\n}\ncall b"), (2, "def c():\n  }\n}\n\nend")]
    got = linededup.drop_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == set(rows)
    assert all(r.n_removed == r.n_by_chunks == 0 for r in got)


def test_chunks_decide_on_short_runs(spark, monkeypatch):
    """Passages of 5 to 9 words go only where a chunk finds them."""
    rows = []
    for n in range(40):
        body = [f"p{n}", f"q{n}", f"r{n}", f"s{n}", f"t{n}", f"u{n}", f"v{n}", f"w{n}"]
        rows += [(10 * n + d, "\n".join([f"above {n} {d}", *body, f"below {n} {d}"])) for d in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.drop_passages(df).collect()
    with_chunks = [r for r in got if r.n_removed]
    assert 20 <= len(with_chunks) < 40
    assert all(r.n_removed == r.n_by_chunks == 8 for r in with_chunks)
    monkeypatch.setattr(linededup, "_chunks", lambda lines: F.expr("cast(array() as array<struct<at: int, size: int, piece: string>>)"))
    assert all(r.n_removed == 0 for r in linededup.drop_passages(df).collect())
