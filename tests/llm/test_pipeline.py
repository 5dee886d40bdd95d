"""The pipeline: columns, each stage on what the one before kept, and the whole against its parts."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import pytest
from plain import sha, simhash

from shelfmark.llm import bpe, toxicity
from shelfmark.llm.queries import vocabulary
from shelfmark.plans.registry import table
from shelfmark.session import cut

SF = "/root/testdata/sf0.001"
FIXED = ["toxicity", "line_dedup", "simhash_near_dedup", "mix_sources", "encode_bpe"]


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and what each stage made of them."""
    docs = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut(stage(spark, docs[-1], SF)))
    return docs


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == FIXED
    for made in steps[1:-1]:
        assert made.columns == steps[0].columns
        assert [f.dataType for f in made.schema] == [f.dataType for f in steps[0].schema]


def test_toxic_documents_go(spark, steps):
    got = {r.doc_id for r in steps[1].collect()}
    scores = toxicity.predictions(steps[0], table(spark, SF, "labels")).collect()
    assert got == {r.doc_id for r in scores if not r.predicted}


def test_repeated_lines_go_and_nothing_else(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[1:3])
    assert before.keys() == after.keys()
    lines = Counter(x for r in after.values() for x in set(r.text.split("\n")) if len(x.split()) >= 5 and not re.search(r"\d", x))
    assert max(lines.values()) == 1
    for i, r in before.items():
        kept = iter(r.text.split("\n"))
        assert after[i].text == "" or all(x in kept for x in after[i].text.split("\n"))
        assert after[i].n_chars == (r.n_chars if r.text == after[i].text else len(after[i].text))


def test_one_of_each_group_stays(steps):
    before, after = steps[2].collect(), {r.doc_id for r in steps[3].collect()}
    fps = {r.doc_id: simhash(r.text) for r in before}
    kept = sorted(after)
    assert all((fps[a] ^ fps[b]).bit_count() > 2 for a in kept for b in kept if a < b)
    for i, f in fps.items():  # what went has a copy with a smaller id
        assert i in after or any((f ^ g).bit_count() <= 2 for j, g in fps.items() if j < i)


def test_the_mix_repeats_and_drops_whole_documents(steps):
    before, after = Counter(steps[3].collect()), Counter(steps[4].collect())
    assert set(after) <= set(before)
    assert max(after.values()) <= 2
    words = [sum(n * len((r.text or "").split()) for r, n in c.items()) for c in (before, after)]
    assert 1.2 * words[0] < words[1] < 1.8 * words[0]


def test_ids_are_the_tokenizers(steps):
    tokenizer = bpe.load(vocabulary())
    want = Counter()
    for r in steps[4].collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text))] += 1
    assert Counter(tuple(r) for r in steps[5].collect()) == want


def test_stages_get_along_with_odd_rows(spark, docs, no_docs):
    for rows in (docs, no_docs):
        made = rows.withColumnRenamed("rid", "n_chars").withColumn("row", rows["size"])
        made = made.withColumn("n_chars", made["size"].cast("long"))
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, made, SF))
            assert name == "encode_bpe" or out.columns == made.columns
            made = out
        assert made.count() > 0 or rows is no_docs


def test_run(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[-1].collect()))
