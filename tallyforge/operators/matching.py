"""Matching tasks to nodes over a snapshot of load.

Feasibility is an inequality (free memory against need) and "best feasible node" a
top-1 over it. Neither is planned as a tasks x nodes join: nodes and needs are merged
and scanned once along the memory axis (`above_threshold`), so a task meets its answer
without meeting the other nodes. Ties end with the node name, which makes every choice
deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyforge.functions.hashing import hash32
from tallyforge.functions.ordered import above_threshold, exact_rank
from tallyforge.functions.timing import micros
from tallyforge.session import bounded_broadcast, settle

# Node classes and sort orders allowed per phase and model, the weight of
# an accelerator, the memory overhead and the fallback class.
HEURISTICS = {
    "training": {
        "logistic_regression": {"worker_type": ["low", "med"], "architecture": ["amd64", "arm64"], "sorting": ["cpu_cores"]},
        "decision_tree": {"worker_type": ["low", "med"], "architecture": ["amd64", "arm64"], "sorting": ["cpu_cores"]},
        "random_forest": {"worker_type": ["med", "high-cpu"], "architecture": ["amd64", "arm64"], "sorting": ["n_cpu_flags", "cpu_cores"]},
        "svm": {"worker_type": ["med", "high-cpu"], "architecture": ["amd64", "arm64"], "sorting": ["n_cpu_flags", "cpu_cores"]},
        "nn": {"worker_type": ["high-cpu", "high-gpu"], "architecture": ["amd64"]},
        "cnn": {"worker_type": ["high-cpu", "high-gpu"], "architecture": ["amd64"]},
    },
    "evaluation": {
        "logistic_regression": {"worker_type": ["low"], "architecture": ["amd64", "arm64"], "sorting": ["cpu_cores"]},
        "decision_tree": {"worker_type": ["low"], "architecture": ["amd64", "arm64"], "sorting": ["cpu_cores"]},
        "random_forest": {"worker_type": ["low", "med"], "architecture": ["amd64", "arm64"], "sorting": ["cpu_cores"]},
        "svm": {"worker_type": ["low", "med"], "architecture": ["amd64", "arm64"], "sorting": ["cpu_cores"]},
        "nn": {"worker_type": ["med", "high-cpu"], "architecture": ["amd64", "arm64"], "sorting": ["cpu_cores"]},
        "cnn": {"worker_type": ["med", "high-cpu"], "architecture": ["amd64", "arm64"], "sorting": ["cpu_cores"]},
    },
}
PREPROCESSING_CLASSES = ["low", "med", "high-cpu"]
PREPROCESSING_SORTING = ["memory"]
ACCELERATOR_WEIGHT = 3
MEMORY_FACTOR = 2
FALLBACK_CLASS = "high-cpu"
ACCELERATED_MODELS = ["nn", "cnn"]

# The column behind each sort name.
SORT_COLUMNS = {"memory": "memory_kb", "cpu_cores": "cpu_cores", "n_cpu_flags": "n_cpu_flags"}


ANY_MODEL = "*"
MODEL_FREE_PHASES = ("preprocessing",)


def heuristics_table(spark: SparkSession, rules=HEURISTICS) -> DataFrame:
    """(phase, model, worker_type[], architecture[], sorting[]); a NULL architecture list allows any, the model `*` stands for all."""
    rows = [(phase, model, r["worker_type"], r.get("architecture"), r.get("sorting", []))
            for phase, models in rules.items() for model, r in models.items()]
    rows += [(phase, ANY_MODEL, PREPROCESSING_CLASSES, None, PREPROCESSING_SORTING) for phase in MODEL_FREE_PHASES]
    return spark.createDataFrame(
        rows, "phase string, model string, worker_type array<string>, architecture array<string>, sorting array<string>"
    )


def _ruled(tasks: DataFrame) -> DataFrame:
    """Adds `_rule`, the model whose rules a task follows; phases without models follow the rule for all."""
    return tasks.withColumn("_rule", F.when(F.col("phase").isin(*MODEL_FREE_PHASES), ANY_MODEL).otherwise(F.col("model")))


def load_snapshot(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """Nodes with their number of assigned tasks, 0 when idle."""
    counts = assignments.groupBy("node_id").agg(F.count(F.lit(1)).alias("_n"))
    return nodes.join(counts, "node_id", "left").withColumn("load", F.coalesce("_n", F.lit(0))).drop("_n")


def free_memory(nodes: DataFrame) -> DataFrame:
    memory = F.col("memory_kb").cast("double")
    return nodes.withColumn("free_kb", memory - memory * F.col("memory_usage"))


def required_memory(tasks: DataFrame, size: str = "size_kb") -> DataFrame:
    return tasks.withColumn("need_kb", (F.col(size) * MEMORY_FACTOR).cast("double"))


def memory_feasible(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds to every task how many nodes have strictly more free memory than it needs."""
    needs = required_memory(tasks)
    counts = above_threshold(free_memory(nodes), needs, [], "free_kb", "need_kb", F.lit(1), "n_feasible", total=True)
    return needs.join(counts, "need_kb", "left")


def preprocessing_size(original: Column, preprocessed: Column) -> Column:
    return F.greatest(original, preprocessed)


def phase_size(size: Column, share: Column) -> Column:
    return (size * share).cast("bigint")


def heuristic_candidates(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(phase, model, node columns.., sort1, sort2) of the nodes each rule allows.

    Classes become rows, so this is an equi join on worker_type; a rule with
    architectures holds a node to its list, one without takes any.
    """
    flat = rules.select("phase", "model", "sorting", F.explode("worker_type").alias("_class"), F.col("architecture").alias("_archs"))
    values = F.map_from_arrays(F.array(*[F.lit(k) for k in SORT_COLUMNS]),
                               F.array(*[F.col(c).cast("bigint") for c in SORT_COLUMNS.values()]))
    allowed = (F.col("worker_type") == F.col("_class")) & (F.col("_archs").isNull() | F.array_contains("_archs", F.col("architecture")))
    joined = nodes.withColumn("_values", values).join(flat, allowed)

    def sort_value(i: int) -> Column:
        return F.coalesce(F.element_at("_values", F.get("sorting", F.lit(i))), F.lit(0))

    return joined.select("phase", "model", *nodes.columns, sort_value(0).alias("sort1"), sort_value(1).alias("sort2"))


def _least_loaded() -> Column:
    return F.struct("load", "sort1", "sort2", "node")


# Offers beyond this many rows are merged with the needs instead of being kept as steps.
STEP_OFFERS = 1_000_000


def best_above(offers: DataFrame, needs: DataFrame, part: dict[str, str], payload: Column, out: str) -> DataFrame:
    """`needs` with `out`, the least `payload` of the offers of its part with free_kb > need_kb; NULL if none.

    `part` maps key columns of the offers to those of the needs. Only the offers that are best
    from their free memory downward matter: per part they form one short sorted array of steps,
    which is joined by equality and searched in a projection, so needs aren't shuffled for
    it. Where there are more offers than one sort should hold, both sides are merged and
    scanned along the memory axis instead; the result is the same.
    """
    keys = list(part)
    offers = settle(offers.groupBy(*keys, "free_kb").agg(F.min(payload).alias("_pay")).where("free_kb IS NOT NULL"))
    if offers.count() > STEP_OFFERS:
        wanted = needs.select(*[F.col(n).alias(k) for k, n in part.items()], "need_kb").distinct()
        found = above_threshold(offers, wanted, keys, "free_kb", "need_kb", F.col("_pay"), "_found")
        found = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("need_kb").alias("_k_need"), "_found")
        same = F.col("need_kb") == F.col("_k_need")
        for k, n in part.items():
            same = same & F.col(n).eqNullSafe(F.col(f"_k_{k}"))
        return needs.join(found, same, "left").select(*needs.columns, F.col("_found").alias(out))
    down = Window.partitionBy(*keys).orderBy(F.desc("free_kb")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*keys).orderBy(F.desc("free_kb"))
    best = offers.withColumn("_best", F.min("_pay").over(down))
    steps = best.withColumn("_before", F.lag("_best").over(above)).where("_before IS NULL OR _best <> _before")
    listed = steps.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("free_kb")).alias("down"), F.col("_best").alias("best")))).alias("_steps"))
    same = F.lit(True)
    for k, n in part.items():
        same = same & F.col(n).eqNullSafe(F.col(f"_k_{k}"))
    joined = needs.join(bounded_broadcast(listed), same, "left")
    # Steps run from much free memory to little and get better: the last one that is large enough is the answer.
    hops, hop = [], 1 << 20
    while hop:
        hops.append(F.lit(hop))
        hop >>= 1
    fits = F.aggregate(F.array(*hops), F.lit(0), lambda at, h: at + F.when(-F.get("_steps", at + h - 1)["down"] > F.col("need_kb"), h).otherwise(0))
    return joined.withColumn("_fits", fits).select(*needs.columns, F.get("_steps", F.col("_fits") - 1)["best"].alias(out))


def least_loaded_top1(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Feasible candidate with the least load, ties by the rule's sort order, then name; NULL if none."""
    needs = _ruled(required_memory(tasks))
    best = best_above(free_memory(candidates), needs, {"phase": "phase", "model": "_rule"}, _least_loaded(), "_best")
    return best.select(*tasks.columns, F.col("_best.node").alias("node"), F.col("_best.load").alias("load"))


def affinity_top1(tasks: DataFrame, candidates: DataFrame, assignments: DataFrame) -> DataFrame:
    """As `least_loaded_top1`, but a feasible candidate the pipeline already uses comes first.

    A pipeline's own nodes are few: their numbers are gathered by pipeline, and what each offers is looked up behind that
    shuffle, so that offers never move with the assignments. An offer there is its rule, its free memory and its rank among
    all payloads; the best feasible one is the least rank.
    """
    needs = _ruled(required_memory(tasks))
    offers = settle(free_memory(candidates))
    pays = settle(exact_rank(offers.select("load", "sort1", "sort2", "node").distinct(), [], ["load", "sort1", "sort2", "node"], "_place"))
    listed = _paid(offers, pays).groupBy(F.col("node_id").alias("_node")).agg(
        F.collect_set(F.struct("phase", "model", "free_kb", "_place")).alias("_offers"))
    used = assignments.groupBy(F.col("pipeline_id").alias("_pipeline")).agg(F.collect_set("node_id").alias("_nodes"))
    own = used.select("_pipeline", F.explode("_nodes").alias("_node")).join(bounded_broadcast(listed), "_node") \
        .groupBy("_pipeline").agg(F.flatten(F.collect_list("_offers")).alias("_own"))
    fits = F.filter("_own", lambda o: (o["phase"] == F.col("phase")) & (o["model"] == F.col("_rule")) & (o["free_kb"] > F.col("need_kb")))
    near = F.array_min(F.transform(fits, lambda o: o["_place"]))
    # The tasks move as they came; what follows from a row is computed again behind the shuffle.
    with_own = _ruled(required_memory(tasks.join(own, F.col("pipeline_id") == F.col("_pipeline"), "left"))).select(*needs.columns, near.alias("_near"))
    best = best_above(offers, with_own, {"phase": "phase", "model": "_rule"}, _least_loaded(), "_any")
    named = best.join(bounded_broadcast(pays.select(F.col("_place").alias("_near"), F.col("node").alias("_own_node"))), "_near", "left")
    return named.select(*tasks.columns, F.coalesce("_own_node", "_any.node").alias("node"), F.col("_near").isNotNull().alias("affine"))


def _paid(offers: DataFrame, pays: DataFrame) -> DataFrame:
    """`offers` with the rank `_place` of their payload."""
    named = pays.select("_place", *(F.col(c).alias(f"_p_{c}") for c in ("load", "sort1", "sort2", "node")))
    same = F.lit(True)
    for c in ("load", "sort1", "sort2", "node"):
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return offers.join(named, same)


def fallback_node(chosen: DataFrame, nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """Gives tasks without a node, of pipelines without assignments, the least loaded fallback node."""
    spare = nodes.filter(F.col("worker_type") == FALLBACK_CLASS).agg(
        F.min(F.struct("load", "node")).alias("m")).select("m.node").scalar()
    active = assignments.select("pipeline_id").distinct().withColumn("_active", F.lit(True))
    joined = chosen.join(active, "pipeline_id", "left")
    node = F.when(F.col("node").isNull() & F.col("_active").isNull(), spare).otherwise(F.col("node"))
    return joined.select(*[node.alias(c) if c == "node" else F.col(c) for c in chosen.columns])


def accelerator_score_top1(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Network training: 3 for an accelerator minus the load; best score, less load, name. No memory check.

    The choice depends on (phase, model) alone, so it is one row per rule.
    """
    score = F.when(F.col("accelerator") != "none", ACCELERATOR_WEIGHT).otherwise(0) - F.col("load")
    best = candidates.groupBy(F.col("phase").alias("_phase"), F.col("model").alias("_model")).agg(F.min(F.struct((-score).alias("s"), "load", "node")).alias("_best"))
    joined = _ruled(tasks).join(best, (F.col("phase") == F.col("_phase")) & (F.col("_rule") == F.col("_model")), "left")
    return joined.select(*tasks.columns, F.col("_best.node").alias("node"), (-F.col("_best.s")).alias("score"))


def greedy_top1(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Feasible node by least load, most cores, most memory, name."""
    order = F.struct("load", (-F.col("cpu_cores")).alias("cores"), (-F.col("memory_kb")).alias("memory"), "node")
    offers = free_memory(nodes).withColumn("_all", F.lit(1))
    needs = required_memory(tasks).withColumn("_all", F.lit(1))
    return best_above(offers, needs, {"_all": "_all"}, order, "_best").select(*tasks.columns, F.col("_best.node").alias("node"))


def random_feasible(tasks: DataFrame, nodes: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A uniformly drawn feasible node, reproducible from the task key and seed; NULL if none fits.

    Feasible nodes are a prefix of the nodes by free memory, so a draw is a rank:
    hash(task) modulo the number of feasible nodes, looked up by equi join.
    """
    ordered = free_memory(nodes).withColumn("_down", -F.col("free_kb"))
    ranked = exact_rank(ordered, [], ["_down", "node_id"], "_rank").select((F.col("_rank") - 1).alias("_pick"), "node")
    counted = memory_feasible(tasks, nodes)
    draw = F.when(F.col("n_feasible") > 0, hash32(*[F.col(k) for k in key], F.lit(seed)) % F.col("n_feasible"))
    joined = counted.withColumn("_pick", draw).join(ranked, "_pick", "left")
    return joined.select(*tasks.columns, "n_feasible", "node")


def random_order(batch: DataFrame, key: str, seed: int = 42, out: str = "position") -> DataFrame:
    """Seeded shuffle of a batch: position by hash, then key."""
    hashed = batch.withColumn("_h", hash32(F.col(key), F.lit(seed)))
    return exact_rank(hashed, [], ["_h", key], out).drop("_h")


def fifo_order(batch: DataFrame, window: str, submitted: str, key: str, out: str = "position") -> DataFrame:
    """Arrival order within each submission window."""
    timed = batch.withColumn("_us", micros(F.col(submitted)))
    return exact_rank(timed, [window], ["_us", key], out).drop("_us")


def placement_summary(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks, size and effort per node, platform or strategy."""
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tasks"), F.sum("size_kb").alias("size_kb"), F.sum("effort").alias("effort")
    )
