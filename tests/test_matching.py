import random

from pyspark.sql import functions as F

from tallyforge.operators import matching as ops

NODE = ("node_id bigint, node string, memory_kb bigint, memory_usage double, worker_type string, architecture string, "
        "cpu_cores bigint, n_cpu_flags bigint, accelerator string, load bigint")
TASK = "pipeline_id string, component string, phase string, model string, size_kb bigint"


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODE)


def node(i, free=100, worker="low", load=0, cores=2, flags=10, arch="amd64", acc="none", usage=0.0):
    return (i, f"n{i}", free, usage, worker, arch, cores, flags, acc, load)


def pick(df):
    return {(r["pipeline_id"], r["component"]): r["node"] for r in df.collect()}


def test_exact_memory_is_not_enough(spark):
    tasks = spark.createDataFrame([("p", "a", "x", "svm", 50), ("p", "b", "x", "svm", 49)], TASK)
    found = {r["component"]: r["n_feasible"] for r in ops.memory_feasible(tasks, nodes(spark, node(1), node(2, 200, usage=0.5))).collect()}
    assert found == {"a": 0, "b": 2}
    assert pick(ops.greedy_top1(tasks, nodes(spark, node(1)))) == {("p", "a"): None, ("p", "b"): "n1"}


def test_order_of_ties(spark):
    rules = ops.heuristics_table(spark)
    task = spark.createDataFrame([("p", "t", "training", "random_forest", 1)], TASK)
    # Least load first, then cpu flags, then cores, then name; `low` nodes are not allowed.
    pool = nodes(spark, node(1, worker="low"), node(2, worker="med", load=1, flags=1), node(5, worker="med", flags=10, cores=4),
                 node(4, worker="high-cpu", flags=10, cores=2), node(3, worker="med", flags=10, cores=2))
    assert pick(ops.least_loaded_top1(task, ops.heuristic_candidates(pool, rules))) == {("p", "t"): "n3"}


def test_affinity_before_load_and_fallback(spark):
    rules = ops.heuristics_table(spark)
    pool = nodes(spark, node(1, load=5), node(2), node(3, worker="high-cpu", load=2, free=1), node(4, worker="high-cpu", load=1, free=1))
    tasks = spark.createDataFrame([("p", "e", "evaluation", "svm", 1), ("q", "e", "evaluation", "svm", 1), ("r", "e", "evaluation", "svm", 10**6),
                                   ("p", "f", "evaluation", "svm", 10**6)], TASK)
    used = spark.createDataFrame([("p", "d", 1)], "pipeline_id string, component string, node_id bigint")
    chosen = ops.affinity_top1(tasks, ops.heuristic_candidates(pool, rules), used)
    assert pick(chosen) == {("p", "e"): "n1", ("q", "e"): "n2", ("r", "e"): None, ("p", "f"): None}
    # r has no assignments and falls back; p has, and stays without a node.
    assert pick(ops.fallback_node(chosen, pool, used)) == {("p", "e"): "n1", ("q", "e"): "n2", ("r", "e"): "n4", ("p", "f"): None}


def test_accelerator_against_load(spark):
    rules = ops.heuristics_table(spark)
    task = spark.createDataFrame([("p", "t", "training", "cnn", 10**9)], TASK)
    pool = nodes(spark, node(1, worker="high-gpu", acc="gpu", load=2), node(2, worker="high-cpu"), node(3, worker="high-gpu", acc="gpu", arch="arm64"))
    row = ops.accelerator_score_top1(task, ops.heuristic_candidates(pool, rules)).first()
    assert (row["node"], row["score"]) == ("n1", 1)
    busy = nodes(spark, node(1, worker="high-gpu", acc="gpu", load=4), node(2, worker="high-cpu"))
    assert ops.accelerator_score_top1(task, ops.heuristic_candidates(busy, rules)).first()["node"] == "n2"


def test_random_node_fits_and_is_spread(spark):
    pool = nodes(spark, *[node(i, 10 * i) for i in range(1, 21)])
    tasks = spark.createDataFrame([("p", f"c{i}", "x", "svm", random.Random(i).randrange(0, 110)) for i in range(400)], TASK)
    rows = ops.random_feasible(tasks, pool, ["pipeline_id", "component"]).collect()
    assert len(rows) == 400
    for r in rows:
        fits = [f"n{i}" for i in range(1, 21) if 10 * i > 2 * r["size_kb"]]
        assert (r["node"] in fits) if fits else r["node"] is None
        assert r["n_feasible"] == len(fits)
    assert len({r["node"] for r in rows}) > 15


def test_load_and_ready(spark):
    held = spark.createDataFrame([("p", "a", 1), ("q", "a", 1)], "pipeline_id string, component string, node_id bigint")
    got = {r["node"]: r["load"] for r in ops.load_snapshot(nodes(spark, node(1), node(2)).drop("load"), held).collect()}
    assert got == {"n1": 2, "n2": 0}
    order = ops.random_order(spark.range(50).withColumnRenamed("id", "k"), "k")
    assert sorted(r["position"] for r in order.collect()) == list(range(1, 51))
    assert [r["k"] for r in order.orderBy("position").collect()] != list(range(50))
    assert ops.placement_summary(nodes(spark).withColumns({"size_kb": F.lit(1), "effort": F.lit(1.0)}), ["node"]).count() == 0


def test_rules_without_architecture_and_for_any_model(spark):
    rules = ops.heuristics_table(spark)
    pool = nodes(spark, node(1, arch="riscv64"), node(2, worker="high-gpu", arch="riscv64"))
    tasks = spark.createDataFrame([("p", "a", "preprocessing", "linear_regression", 1), ("p", "b", "preprocessing", None, 1),
                                   ("p", "c", "training", "svm", 1), ("p", "d", "training", "nn", 1)], TASK)
    assert pick(ops.least_loaded_top1(tasks, ops.heuristic_candidates(pool, rules))) == {("p", "a"): "n1", ("p", "b"): "n1", ("p", "c"): None, ("p", "d"): None}


def test_steps_equal_the_merge(spark, monkeypatch):
    rng = random.Random(4)
    pool = nodes(spark, *[node(i, free=rng.randint(1, 60), load=rng.randint(0, 5), worker=rng.choice(["low", "med"])) for i in range(80)])
    tasks = spark.createDataFrame([("p", str(i), rng.choice(["training", "preprocessing"]), rng.choice(["svm", "decision_tree"]), i % 35) for i in range(120)], TASK)
    candidates = ops.heuristic_candidates(pool, ops.heuristics_table(spark))
    steps = pick(ops.least_loaded_top1(tasks, candidates)), pick(ops.greedy_top1(tasks, pool))
    monkeypatch.setattr(ops, "STEP_OFFERS", 0)
    assert steps == (pick(ops.least_loaded_top1(tasks, candidates)), pick(ops.greedy_top1(tasks, pool)))
    assert None in steps[0].values() and len(set(steps[0].values())) > 5


def test_offers_do_not_move_with_assignments(spark):
    """An offer is looked up behind the one shuffle by pipeline; repeated tasks stay."""
    rules = ops.heuristics_table(spark)
    pool = nodes(spark, *[node(i, load=i % 3, worker="med" if i % 2 else "low") for i in range(1, 41)])
    tasks = spark.createDataFrame([(f"p{i % 20}", "e", "evaluation", "svm", 1) for i in range(40)], TASK)
    used = spark.createDataFrame([(f"p{i % 20}", str(i), 1 + i % 40) for i in range(200)], "pipeline_id string, component string, node_id bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = ops.affinity_top1(tasks, ops.heuristic_candidates(pool, rules), used)
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(node_id" not in plan and plan.count("hashpartitioning(pipeline_id") + plan.count("hashpartitioning(_pipeline") == 2
        rows = chosen.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 40 and all(r["affine"] for r in rows)
    own = {f"p{p}": min((i % 3, 2, f"n{i}") for i in (1 + k % 40 for k in range(200) if k % 20 == p))[2] for p in range(20)}
    assert pick(chosen) == {(p, "e"): n for p, n in own.items()}
