import json

import numpy as np
import pytest

from tallyforge.sources import files, schemas
from tallyforge import session


def run(i, **times):
    part = {"name": "model-training", "type": "training", "state": "SUCCEEDED", "node": "n1", "platform": "amd64",
            "start_time": "2025-01-02 03:04:05.678901+00:00", "end_time": None, "duration": None}
    return {"id": f"r{i}", "name": "p", "kfp_id": None, "state": "SUCCEEDED", "submitted_at": "2025-01-02 03:04:05.678901+00:00",
            "scheduled_at": "2025-01-02T03:04:06Z", "finished_at": None, "duration": None, "components": {"model-training": part}, **times}


def test_dumps_in_folders_of_strategy_and_seed(spark, tmp_path):
    for strategy, seed, n in (("random_random", 42, 2), ("fifo_random", 0, 1)):
        folder = tmp_path / "output" / strategy / str(seed)
        folder.mkdir(parents=True)
        (folder / "pipelines.json").write_text(json.dumps([run(i) for i in range(n)], indent=4))
    runs = files.read_run_dumps(spark, str(tmp_path / "output"))
    got = sorted((r["strategy"], r["seed"], r["id"]) for r in runs.collect())
    assert got == [("fifo_random", "0", "r0"), ("random_random", "42", "r0"), ("random_random", "42", "r1")]
    row = runs.filter("id = 'r1'").first()
    assert str(row["submitted_at"]) == "2025-01-02 03:04:05.678901" and row["finished_at"] is None
    tasks = files.explode_components(runs, ("id", "strategy"))
    assert tasks.count() == 3 and tasks.first()["node"] == "n1"


def test_external_runs(spark, tmp_path):
    task = {"display_name": "model-training", "start_time": "2025-01-01T00:00:00Z", "end_time": "2025-01-01T00:00:02.5Z", "state": "SUCCEEDED"}
    document = {"runs": [{"run_id": "1", "display_name": " adult-income-dt 2025-01-01 10-00", "state": "SUCCEEDED", "created_at": "2025-01-01T00:00:00Z",
                          "scheduled_at": "2025-01-01T00:00:01Z", "finished_at": "2025-01-01T00:00:02.900Z", "run_details": {"task_details": [task]}}]}
    (tmp_path / "run_1.json").write_text(json.dumps(document, indent=2))
    runs = files.read_external_runs(spark, str(tmp_path))
    row = runs.first()
    assert (row["name"], row["duration"]) == ("adult_income_dt", 1.9)
    assert files.external_task_details(runs).first()["component"] == "model-training"


def test_csv_forms(spark, tmp_path):
    (tmp_path / "wine.csv").write_text('"fixed acidity";"quality"\n7.0;6\n;5\n')
    wine = files.read_csv(spark, str(tmp_path / "wine.csv"), "`fixed acidity` double, quality bigint", sep=";")
    assert [tuple(r) for r in wine.collect()] == [(7.0, 6), (None, 5)]
    fields = ["0", "tcp", "http", "SF"] + ["1"] * 37 + ["normal."]
    (tmp_path / "log.csv").write_text(",".join(fields) + "\n")
    log = files.read_csv(spark, str(tmp_path / "log.csv"), schemas.CONNECTION_LOG, header=False)
    row = log.first()
    assert (row["service"], row["serror_rate"], row["label"]) == ("http", 1.0, "normal.")


def test_npy_shards_align_by_position(spark, tmp_path):
    for folder, shape in (("x", (5, 2, 3)), ("y", (5,))):
        (tmp_path / folder).mkdir()
        for shard in range(2):
            np.save(tmp_path / folder / f"{shard}.npy", np.arange(np.prod(shape)).reshape(shape) + 100 * shard)
    x, y = files.read_npy(spark, str(tmp_path / "x")), files.read_npy(spark, str(tmp_path / "y"))
    both = {(r["file"], r["pos"]): (r["values"], r["label"]) for r in
            x.join(y.withColumnRenamed("values", "label"), ["file", "pos"]).collect()}
    assert len(both) == 10
    assert both["1.npy", 4] == ([124.0, 125.0, 126.0, 127.0, 128.0, 129.0], [104.0])


def test_counter_log_is_only_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1.5, "update", 1, 2)], schemas.COUNTER_LOG)
    files.append_counter_log(rows, path)
    files.append_counter_log(rows.withColumn("type", rows.type), path)
    assert files.read_counter_log(spark, path).count() == 2


def test_dump_hides_private_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "s", 2.0, "m")], "id string, seed int, strategy string, effort double, metadata string")
    files.write_run_dump(df, str(tmp_path / "d"))
    assert set(spark.read.json(str(tmp_path / "d")).columns) == {"id", "seed", "strategy"}


def test_settled_frames_and_broadcast_bound(spark):
    df = spark.range(20).selectExpr("id", "id % 3 AS k")
    assert session.settle(df).count() == 20
    size = session.stored_bytes(session.settle(df))
    small, large = session.bounded_broadcast(df, size), session.bounded_broadcast(df, size - 1)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


def test_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "a.csv"), "a int, b int").collect()


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default):
        return self.value or default


class Session:
    """Just what the scratch folder is chosen from."""

    def __init__(self, master, folder):
        self.conf = Conf(folder)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_scratch_folder_is_the_shared_one():
    assert session.scratch_root(Session("yarn", "/shared")) == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session("yarn", None))
    local = Session("local[2]", None)
    assert session.scratch_root(local) == session.scratch_root(local)
