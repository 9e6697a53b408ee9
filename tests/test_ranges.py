"""Files of many blocks read the same as whole ones."""

import json
import random

import numpy as np
import pytest

from tallyforge.plans import q_sources
from tallyforge.sources import ranges

DRAW, RNG = np.random.default_rng(3), random.Random(3)


@pytest.fixture(params=[64, 999, 20_000, 1 << 27])
def cut_at(spark, request):
    """Blocks of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    if request.param == 64:
        keys["spark.sql.files.maxPartitionBytes"] = "350"
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_array_files(spark, tmp_path, cut_at):
    made = {"a": DRAW.normal(size=(301, 7)), "b": DRAW.integers(0, 256, (90, 4, 5)).astype(np.uint8), "c": np.arange(40, dtype=np.int32), "d": np.zeros((3, 0)),
            "e": np.full((50, 3), 10, np.uint8), "f": DRAW.normal(size=(2, 300)).astype(np.float32), "g": np.zeros((0, 4))}
    for name, data in made.items():
        np.save(tmp_path / f"{name}.npy", data)
    df = ranges.npy_rows(spark, str(tmp_path))
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rsplit("/", 1)[1][0], {})[r.pos] = r["values"]
    for name, data in made.items():
        if data.size:
            assert sorted(got[name]) == list(range(len(data)))
            assert all(got[name][i] == data[i].ravel().astype(float).tolist() for i in range(len(data)))
    assert set(got) == {n for n, d in made.items() if d.size}
    if cut_at == 64:
        assert ranges.file_blocks(spark, str(tmp_path), "\n", "a.npy").select("start").distinct().count() > 10


def thing(depth=0):
    kinds = [lambda: RNG.choice(["", "}", "{", "\"", "\\", "\\\"}", "é}{", "a\nb", "],[", "x" * 50]), lambda: RNG.randint(-9, 9), lambda: None]
    if depth < 3:
        kinds += [lambda: {f"k{i}": thing(depth + 1) for i in range(RNG.randint(0, 3))}, lambda: [thing(depth + 1) for _ in range(RNG.randint(0, 3))]]
    return RNG.choice(kinds)()


def test_json_arrays(spark, tmp_path, cut_at):
    made = {}
    for name, indent, ascii_ in (("a", None, True), ("b", 2, False), ("c", None, False)):
        made[name] = [{"id": i, "of": thing(), "more": {"s": "}" * (i % 3), "t": thing()}} for i in range(60)]
        (tmp_path / f"{name}.json").write_text(json.dumps(made[name], indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    made["long"] = [{"id": 1, "s": "{" * 3000}, {"id": 2, "of": [{"d": i} for i in range(300)]}]
    (tmp_path / "long.json").write_text(json.dumps(made["long"]))
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "lines.json").write_text("".join(json.dumps(x) + "\n" for x in made["a"]))
    made["lines"] = made["a"]
    got = {}
    for r in ranges.json_elements(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1].split(".")[0], []).append(json.loads(r.text))
    assert set(got) == set(made)
    for name in made:
        assert sorted(map(json.dumps, got[name])) == sorted(map(json.dumps, made[name]))


def test_objects_inside_a_document(spark, tmp_path, cut_at):
    runs = [{"run_id": str(i), "run_details": {"task_details": [{"display_name": "a}"}] * (i % 4)}} for i in range(80)]
    (tmp_path / "runs.json").write_text(json.dumps({"runs": runs, "next": "}"}))
    df = ranges.read_json_elements(spark, str(tmp_path), "run_id string, run_details struct<task_details: array<struct<display_name: string>>>", level=1)
    got = sorted(((r.run_id, len(r.run_details.task_details)) for r in df.collect()), key=str)
    assert got == sorted(((str(i), i % 4) for i in range(80)), key=str)


def test_other_files_are_an_error(spark, tmp_path):
    (tmp_path / "x.npy").write_bytes(b"no array")
    with pytest.raises(ValueError):
        ranges.npy_rows(spark, str(tmp_path))


def test_dumps_of_arrays_hold_about_a_thousand_runs(spark):
    """Files follow the runs of a strategy and seed, not those of the whole table once for each of them."""
    runs = q_sources._array_dumps(spark, "/root/testdata/sf0.01")
    groups = runs.select("strategy", "seed").distinct().count()
    assert len(runs.inputFiles()) <= groups + runs.count() / 1000
