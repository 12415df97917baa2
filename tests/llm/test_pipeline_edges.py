"""The stages together on nulls, empty and long texts, repeated rows, no rows and clashing column names."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rid long, near_id long, k_id long, k_hash string, n_copies int, length int, bucket string, rule_bits long"
SF = "/root/testdata/sf0.001"
EXTRA = ("x", 1, 2, 3, "h", 7, 4, "b", 9)
NAMES = "the and of to a in that it is was for on with as his they at be this from".split()


def prose(seed, n):
    """Sentences of plain words that pass the rules, most of their words of their own."""
    rng = random.Random(seed)
    said = []
    for k in range(n // 10):
        words = [rng.choice(NAMES) if j % 2 else "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(4, 8))) for j in range(10)]
        said.append(" ".join(words).capitalize() + ".")
    return " ".join(said)


@pytest.fixture(scope="module")
def data():
    one, two, key = prose(1, 200), prose(2, 200), prose(3, 200) + " password = hunter2hunter2Z and no more."
    texts = {0: None, 1: "", 2: " \n\t ", 3: prose(4, 40_000), 4: one, 5: one, 6: one + " One more sentence stands here.", 7: two, 8: key}
    rows = [(i, t, "en", "s", None if t is None else len(t), *EXTRA) for i, t in texts.items()]
    bare = (None,) * len(EXTRA)
    return [*rows, rows[7], (9, prose(5, 200), None, None, None, *bare), (None, prose(6, 200), "en", "s", 5, *bare)]


def stages(spark, docs):
    out, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, SF))
        assert name == "pack" or docs.columns == columns
        out[name] = docs.collect()
    return out


def test_edge_rows(spark, data):
    out = stages(spark, spark.createDataFrame(data, SCHEMA))
    # Texts without words go; long texts, null ids, null sources and languages stay.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out["quality_rules"]) == [(False, k) for k in (3, 4, 5, 6, 7, 7, 8, 9)] + [(True, 0)]
    # Copies, near copies and repeated rows leave the one of the least id.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out["near_duplicates"]) == [(False, k) for k in (3, 4, 7, 8, 9)] + [(True, 0)]
    before = {r.doc_id: r for r in out["near_duplicates"]}
    after = {r.doc_id: r for r in out["secret_scan"]}
    assert before.keys() == after.keys()
    assert "hunter2hunter2Z" not in after[8].text and "[SECRET]" in after[8].text
    assert all(after[k] == before[k] for k in before if k != 8)
    assert all(r == after[r.doc_id] for r in out["mix_sources"])
    assert sorted(str(r.doc_id) for r in out["pack"]) == sorted(str(r.doc_id) for r in out["mix_sources"])
    assert len({(r.bucket, r.batch, r.slot) for r in out["pack"]}) == len(out["pack"])


def test_no_rows(spark):
    assert all(rows == [] for rows in stages(spark, spark.createDataFrame([], SCHEMA)).values())
