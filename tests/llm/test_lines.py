"""Line deduplication against a plain version, and what it catches and leaves."""

from __future__ import annotations

import re

from plain import LICENSE

from shelfmark.llm import lines


def keys(line):
    words = re.split(r"\s+", re.sub("[^ ]*[0-9][^ ]*", "<*>", line.strip(" ")))
    n, rest = len(words), words[lines.LEADING :]
    if n < lines.LEAST:
        return []
    bounds = [len(rest) * k // 3 for k in range(4)]
    parts = [tuple(rest[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    if n < lines.LONG:
        return [(n, *words[:2], *parts)]
    return [(n, *words[:2], *(None if k == j else p for k, p in enumerate(parts))) for j in range(3)]


def plain(rows):
    rank = lambda i: (i is None, i or 0)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            for k in keys(line):
                held.setdefault(k, set()).add(i)
    out = []
    for i, text in rows:
        found = [] if text is None else text.split("\n")
        sets = [[held[k] for k in keys(x) if len(held[k]) > 1] for x in found]
        drop = [any(min(s, key=rank) != i for s in several) for several in sets]
        left = None if text is None else "\n".join(x for x, d in zip(found, drop, strict=True) if not d)
        out.append((i, len(found), sum(map(bool, sets)), sum(drop), left))
    return sorted(out, key=str)


LONG = "the first words of this passage are followed by many more words of the same passage until it ends {} here at last"
MORE = [
    (50, f"Some own words of this text stand here first.\n{LONG.format('now')}"),
    (51, f"Other words of another text stand here instead.\n{LONG.format('now')}\nand an end of its own"),
    (52, f"{LONG.format('then')}\nWords that no other document has at all."),
    (53, "Only words that no other document of them has.\na b\na b"),
    (54, f"{LICENSE}\nOnly words that stand in no other document."),
    (55, "On 2024-01-02 at 10:11 user 17 logged in"),
    (56, "On 2023-11-30 at 09:00 user 4 logged in"),
]


def test_against_plain(spark, docs):
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(MORE, "doc_id long, text string"))
    rows = [tuple(r) for r in every.collect()]
    assert sorted((tuple(r) for r in lines.report(every).collect()), key=str) == plain(rows)


def test_passages_templates_and_clean_lines(spark):
    got = {r.doc_id: r for r in lines.report(spark.createDataFrame(MORE, "doc_id long, text string")).collect()}
    assert got[50].n_dropped == 0  # the first keeps the passage
    assert got[51].text == "Other words of another text stand here instead.\nand an end of its own"
    assert got[52].text == "Words that no other document has at all."
    assert got[53].n_recurring == 0
    assert got[55].text
    assert got[56].text == ""


def test_columns_stay(docs, no_docs):
    out = lines.dedup(docs)
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    assert lines.report(no_docs).count() == 0
    assert lines.dedup(no_docs).columns == no_docs.columns


def test_short_lines_that_recur_exactly_go_from_the_stage(spark):
    han = "漢字之書不用空格故一行即一詞也然其文甚長而屢見於諸書之中"
    made = [
        (1, f"All rights reserved.\n{han}\nwords of one\n}}"),
        (2, f"  All rights reserved. \nwords of two\n{han}\n}}"),
        (3, f"All rights reserved!\n{han}書\nwords of three, 3 at least\n}}"),
        (4, "All rights reserved!\nAll rights reserved!\nVersion 1.2 of January\nVersion 1.3 of January"),
    ]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[1] == made[0][1]
    assert got[2] == "words of two\n}"
    assert got[3] == made[2][1]
    assert got[4] == "Version 1.2 of January\nVersion 1.3 of January"
