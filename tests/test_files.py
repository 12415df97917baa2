import gzip
import json

import pytest

from hyperloom.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    put = lambda name, text: gzip.open(d / name, "wt").write(text)
    put("nodes (1).csv.gz", "id,date-created,active,status\n1,2024-01-02,True,ok\n2,,,\n")
    put("packs.json.gz", json.dumps({"pack-id": 1, "creator-id": 2, "date-created": "2024-03-01", "members": [{"id": 1, "date-added": "2024-03-02"}, {"id": 1, "date-added": "2024-03-02"}]}) + "\n" + json.dumps({"pack-id": 2, "creator-id": 2, "date-created": "2024-03-01", "members": []}) + "\n")
    put("packs.txt.gz", "1,2,3\n4\nx,1\n")
    put("follows.csv.gz", "1,2,2024-01-05\n2,1,2024-01-06\n")
    (d / "labels.json").write_text('{"1": 0, "2": 5}')
    (d / "list.csv").write_text("3\n3\n1\n")
    return str(d)


def test_resolve_and_inventory(spark, folder):
    assert files.resolve(spark, folder, "nodes_csv").endswith(".csv.gz")
    got = {r.dataset: r.bytes for r in files.inventory(spark, folder).collect()}
    assert got["nodes_csv"] > 0 and got["follows_parquet"] is None and set(got) == set(files.DATASETS)


def test_readers(spark, folder):
    nodes = files.read_nodes(spark, files.resolve(spark, folder, "nodes_csv")).orderBy("node_id").collect()
    assert nodes[0].active is True and str(nodes[0].date_created) == "2024-01-02" and nodes[1].active is None and nodes[1].date_created is None
    packs, members = files.read_packs(spark, files.resolve(spark, folder, "packs_jsonl"))
    assert {r.pack_id: r.member_count for r in packs.collect()} == {1: 2, 2: 0} and members.count() == 2
    assert files.read_follows(spark, files.resolve(spark, folder, "follows_csv"), csv=True).count() == 2
    assert {r.node_id: r.community for r in files.read_labels(spark, f"{folder}/labels.json").collect()} == {1: 0, 2: 5}
    assert {r.value: r["count"] for r in files.read_value_list(spark, f"{folder}/list.csv").collect()} == {3: 2, 1: 1}


def test_validate_and_doctor(spark, folder):
    got = {r.dataset: r.ok for r in files.validate(spark, folder).collect()}
    assert got == {"nodes_csv": True, "nodes_jsonl": False, "packs_jsonl": True, "pack_edgelist": False, "follows_csv": True, "follows_parquet": False}
    assert files.doctor(spark).where("setting = 'version'").first().value == spark.version


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    files.write_result(df, f"{tmp_path}/r", ["a"])
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2
    files.write_summary(spark, f"{tmp_path}/s", "t", 1.5, {"n": 2})
    assert json.loads(spark.read.text(f"{tmp_path}/s").first().value)["summary"] == {"n": 2}
    with pytest.raises(ValueError):
        files.write_adjacency(df, "x", buckets=8)
    diff = files.compare_distributions(df, df.where("a = 1"))
    assert [(r.a, r.side) for r in diff.collect()] == [(3, "left")]
