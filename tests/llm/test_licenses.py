import re

from sessionledger.llm import licenses


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w, found = words(text), []
    for label, phrase in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return (len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found})))


CASES = [
    "Released under the MIT License. More text, then the MIT\nlicense again: mit-license MITlicense mit  License",
    "This work is licensed under the GNU General Public License, version 3.", "GNU general public LICENSE version 2", "general public general public license",
    "Licensed under the Apache License, Version 2.0.", "apache license", "Licensed under CC BY-NC 4.0.", "cc by 4.0 and CC-BY-SA 4.0", "All rights reserved.", "rights reserved all",
    "KMIT License İ mitK license", "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit", "license mit", "é mit license é", "mit license",
    "filler " * 5000 + "mit license", None, "", "123 456",
]
LABELS = {1: "gpl,gpl-3.0", 2: "gpl,gpl-2.0", 4: "apache,apache-2.0", 5: "apache", 6: "cc-by-nc-4.0", 7: "cc-by-4.0,cc-by-sa-4.0", 8: "all-rights-reserved", 9: "", 11: "mit", 17: "", 18: ""}


def test_base_and_labels(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licenses.scan(df).collect()}
    for i, t in enumerate(CASES):
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == base(t), t
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
        assert x.labels == ",".join(sorted(filter(None, set(x.labels.split(",")))))
    for i, labels in LABELS.items():
        assert got[i].labels == labels, CASES[i]
    assert got[1].score == got[4].score == got[6].score == 1.0 and got[17].score == 0.0


def test_awkward_rows(docs, empty, small):
    for df in (docs, small):
        rows = licenses.scan(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            x = r.licence
            assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == base(r.text)
    assert licenses.scan(empty).count() == 0
