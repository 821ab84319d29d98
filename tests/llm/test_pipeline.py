"""The stages of the pipeline on the smallest tables, each against a plain version on its own input."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from engram.llm import sstable, toxicity
from engram.llm.common import read_table
from engram.llm.queries import vocabulary_path

DATA = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark):
    docs, out = read_table(spark, DATA, "documents"), []
    for name, stage in pipeline.STAGES:
        out.append((name, docs.collect()))
        done = stage(spark, docs, DATA)
        rows = done.collect()
        docs = spark.createDataFrame(rows, done.schema)
    return [*out, ("end", rows)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_filtering_stages_keep_whole_rows(tables):
    for (_, before), (name, after) in zip(tables[:3], tables[1:4]):
        assert after and after[0].__fields__ == NAMES, name
        assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_toxicity_stage_rejects_by_score(spark, tables):
    scored = toxicity.toxicity(read_table(spark, DATA, "documents"), read_table(spark, DATA, "labels"))
    want = sorted(r.doc_id for r in scored.where("score < 0.3").collect())
    assert sorted(r.doc_id for r in tables[1][1]) == want


def test_near_duplicate_stage_keeps_one_of_each_group(tables):
    sets = {r.doc_id: shingles(r.text) for r in tables[1][1]}
    up = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if a < b and up[a] != up[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
                    moved = True
    assert sorted(r.doc_id for r in tables[2][1]) == sorted(i for i in up if up[i] == i)


def test_decontamination_stage_rejects_whole_items(spark, tables):
    items = [r.text for r in read_table(spark, DATA, "benchmark").collect()]
    hold = {r.doc_id for r in tables[2][1] if any(t in (r.text or "") for t in items if t and len(t.split()) >= 10)}
    kept = {r.doc_id for r in tables[3][1]}
    assert not hold & kept and len(kept) > 0.8 * len(tables[2][1])


def test_mixing_stage_takes_whole_documents(tables):
    before, after = tables[3][1], tables[4][1]
    assert after[0].__fields__ == NAMES and {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert max(np.unique([r.doc_id for r in after], return_counts=True)[1]) <= 2


def test_token_stage_encodes_every_row(tables):
    tok = sstable.Encoder(vocabulary_path(), 0).tokenizer
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = sorted((r.doc_id, len(x := ids(r.text)), zlib.crc32(x.tobytes())) for r in tables[4][1])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in tables[5][1]) == want
    at = 0
    for r in sorted(tables[5][1], key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_gives_the_rows_of_the_stages(spark, tables):
    assert sorted(map(tuple, pipeline.run(spark, DATA).collect())) == sorted(map(tuple, tables[5][1]))


CLASHES = "score _text target size key block h copies shards row n spot shard place source_size taken component_id kept th t p".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, one id with two texts, and columns with the operators' own names."""
    items = [r.text for r in read_table(spark, DATA, "benchmark").limit(2).collect()]
    texts = [(1, "a first text of its own"), (1, "quite another text under the same id"), (1, "a first text of its own"), (2, "a first text of its own"), (3, None), (4, ""), (None, "no id here"), (None, None)]
    texts += [(5, "word " * 200_000), (6, f"so {items[0]} and more"), (7, " \n ")]
    rows = [(i, t, "en", "s" if k % 3 else None, 0, *(f"{c}{k}" for c in CLASHES)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


@pytest.mark.parametrize(("name", "stage"), pipeline.STAGES[:-1])
def test_stages_carry_odd_rows_and_any_column(spark, odd, name, stage):
    before, done = odd.collect(), stage(spark, odd, DATA)
    after = done.collect()
    assert done.columns == odd.columns and {tuple(r) for r in after} <= {tuple(r) for r in before}
    ids = sorted((str(r.doc_id), str(r.text)[:12]) for r in after)
    if name == "near_duplicates":
        whole = [(str(r.doc_id), str(r.text)[:12]) for r in before]
        whole.remove(("1", "a first text"))
        whole.remove(("2", "a first text"))
        assert ids == sorted(whole)
    if name == "decontamination":
        assert ids == sorted((str(r.doc_id), str(r.text)[:12]) for r in before if r.doc_id != 6)
    empty = stage(spark, odd.limit(0), DATA)
    assert empty.columns == odd.columns and empty.count() == 0


def test_token_stage_takes_odd_rows(spark, odd):
    got = pipeline.token_stage(spark, odd, DATA).collect()
    assert len(got) == odd.count() and sorted(r.n_tokens for r in got)[:3] == [1, 1, 1]
    assert pipeline.token_stage(spark, odd.limit(0), DATA).count() == 0
