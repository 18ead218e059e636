"""The corpus pipeline stage by stage, and the registered queries of the subpackage."""

import hashlib

import pytest

import __spark_entry__
import corpus_pipeline
from lorebase.llm import packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"passage{i} of words" for i in range(40))
DIGESTS = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(40)]
# Neighbouring sentences end in different characters, so that no byte before the passage repeats with it.
SENTENCES = [f"the quick brown animal number {i} walks over the old stone bridge near village {i % 7} in the morning {DIGESTS[i]}{chr(97 + i % 26)}" for i in range(40)]


@pytest.fixture(scope="module")
def table(spark):
    texts = [" ".join(SENTENCES[i : i + 3]) for i in range(0, 30, 3)]
    texts += [texts[0], texts[1] + " extra", f"{SENTENCES[31]} {PASSAGE}", f"{SENTENCES[32]} {PASSAGE} {SENTENCES[33]}", "password = hunter2222 " + SENTENCES[34], "123 456", None]
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS)


def test_stages(spark, table):
    docs, seen = table, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == table.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(range(17)) - set(seen["language"]) == {15, 16}
    assert set(seen["language"]) - set(seen["near_duplicates"]) == {10, 11}
    assert "passage7 of words" not in seen["repeats"][12].text + seen["repeats"][13].text
    assert (seen["repeats"][12].text, seen["repeats"][13].text) == (SENTENCES[31], f"{SENTENCES[32]} {SENTENCES[33]}")
    assert seen["repeats"][3].text == seen["language"][3].text
    assert "hunter2222" not in seen["secrets"][14].text and seen["secrets"][14].text.startswith("[SECRET]")
    assert all(r.n_chars == len(r.text) for r in seen["secrets"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(seen["secrets"])
    assert sum(r.length for r in packed) == sum(r.length for r in packing.pack(docs).collect())


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{i}_" for i in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names
