"""License scans against a comparison of every line with every template."""

from __future__ import annotations

import re
import textwrap

from plain import lower

from shelfmark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall(lower(text))
    base = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    best, labels = 0.0, {x for _, x in base}
    for line in lower(text).split("\n"):
        held = set(WORD.findall(line))
        for label, t in licenses.TEMPLATES:
            share = len(held & set(t.split())) / len(set(t.split()))
            if share >= licenses.THRESHOLD:
                best, labels = max(best, share), labels | {label}
    starts = [i for i, _ in base]
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({x for _, x in base})),
        ",".join(sorted(labels)),
        1.0 if base else best,
    )


MORE = [
    "See MIT\nLicense, mit  license; the MIT-licensed and summit license",
    "cc by CC BY cc-by ccby Apache License gnu general public license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "use and redistribution in binary and source forms with modification are permitted",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Licensed under CC BY-NC 4.0.",
    " ".join(w for _, t in licenses.TEMPLATES for w in t.split()),
]


def test_against_plain(spark, docs):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(MORE)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    texts = every.collect()
    got = licenses.scan(every).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r.doc_id, *plain(r.text)) for r in texts), key=key)


def runs(text):
    """Labels and the best score of all runs of words as long as a template."""
    words, found = WORD.findall(lower(text)), {}
    for label, t in licenses.TEMPLATES:
        known, size = set(t.split()), len(t.split())
        score = max(len(known & set(words[i : i + size])) / len(known) for i in range(len(words) or 1))
        if score >= licenses.THRESHOLD:
            found[label] = max(score, found.get(label, 0.0))
    return found


def wrap(text, width, before):
    return "\n".join(before + x for x in textwrap.wrap(text, width))


def test_wrapped_notices(spark):
    made, want = [], []
    own = "Some other words stand here and have nothing to do with any notice of the list."
    for label, t in licenses.TEMPLATES:
        for width, before in ((72, ""), (40, "# "), (24, " * ")):
            made.append(f"{own}\n{wrap(t.capitalize(), width, before)}\n{own}")
            want.append(label)
    scattered = " ".join("permission is hereby granted free of charge to any person obtaining a copy of this software".split()[::-1]).replace(" ", " or\nnot ")
    made += [scattered, f"{own}\n{own}", "\n\n", "permission is hereby granted free of charge\nto any person obtaining a copy"]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    for i, text in enumerate(made):
        found, by_line = runs(text), plain(text)
        assert got[i].labels == ",".join(sorted({*found, *filter(None, by_line[5].split(","))})), text
        assert got[i].score == max([by_line[6], *found.values()])
    assert all(label in got[i].labels.split(",") for i, label in enumerate(want))
    assert not any(got[i].labels for i in range(len(want), len(made)))


def test_nothing(no_docs):
    assert licenses.scan(no_docs).count() == 0
