"""Queries that prepare, oversample, train and score."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from tallyforge.operators import margins, metrics, models, nets, prep, recipes, trees
from tallyforge.operators.smote import partners, smote_oversample
from tallyforge.plans.q_prep import TAB_NULLS_SQL, XS, encode_sql, md5_part, tab_with_nulls
from tallyforge.plans.q_runlog import rounded
from tallyforge.plans.registry import query
from tallyforge.plans.views import view
from tallyforge.session import bounded_broadcast, scratch_path, settle
from tallyforge.sources.tables import table


def clean_tab(df):
    """The steps of the census recipe on the test table."""
    df = prep.iqr_clip(settle(prep.drop_duplicates(df)), XS)
    df = prep.map_values(df, "c2", {"O": "open", "F": "filled"})
    return prep.label_encode(df, ["c1", "c2"])


LIMIT_COLUMNS = ", ".join(
    f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
    f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}" for c in XS)


@query("prep_recipe", f"""WITH d AS (SELECT DISTINCT * FROM ({TAB_NULLS_SQL}) AS a), limits AS (SELECT {LIMIT_COLUMNS} FROM d),
    src AS (SELECT row_key, c1, CASE c2 WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS c2,
        {', '.join(f'round(greatest(least({c}, hi_{c}), lo_{c}), 6) AS {c}' for c in XS)}, label FROM d, limits)
    SELECT row_key, {encode_sql('src', 'c1')}, {encode_sql('src', 'c2')}, {', '.join(XS)}, label FROM src AS t""")
def prep_recipe(spark, folder):
    """Every row twice in the input; copies go first."""
    once = tab_with_nulls(spark, folder)
    return rounded(clean_tab(once.unionByName(once)), *XS)


@query("prep_recipe_images", """SELECT vec_id, split, CAST(i // 8 AS INTEGER) AS row, CAST(i % 8 AS INTEGER) AS col,
    CAST(embedding[i + 1] AS DOUBLE) / 255.0 AS pixel
    FROM (SELECT *, CASE WHEN CAST('0x' || substr(md5(concat(vec_id, '|42')), 1, 8) AS BIGINT) < 858993459 THEN 'test' ELSE 'train' END
          AS split FROM embeddings) AS e, unnest(range(0, len(embedding))) AS t(i)""")
def prep_recipe_images(spark, folder):
    source = table(spark, folder, "embeddings").withColumnRenamed("embedding", "pixels")
    nested = recipes.images(source, (8, 8, 1), "vec_id").select("vec_id", "split", F.posexplode("pixels").alias("row", "line"))
    cells = nested.select("vec_id", "split", "row", F.posexplode("line").alias("col", "channels"))
    return cells.select("vec_id", "split", "row", "col", F.get("channels", F.lit(0)).alias("pixel"))


@query("smote_oversample", """WITH n AS (SELECT label, count(*) AS n FROM v_tab GROUP BY label)
    SELECT label, n AS n_original, max(n) OVER () - n AS n_synthetic, max(n) OVER () - n AS n_inside FROM n""")
def smote_oversample_counts(spark, folder):
    """New rows per class, and how many lie within their class's value ranges (all must)."""
    source = view(spark, folder, "v_tab")
    rows = smote_oversample(source, "label", XS)
    ranges = source.groupBy("label").agg(*[f(c).alias(f"{p}_{c}") for c in XS for p, f in (("lo", F.min), ("hi", F.max))])
    inside = F.lit(True)
    for c in XS:
        inside = inside & F.col(c).between(F.col(f"lo_{c}") - 1e-9, F.col(f"hi_{c}") + 1e-9)
    # A row per class: were it not broadcast, all rows would be dealt out by class, to a task each.
    counted = rows.join(bounded_broadcast(ranges), "label").groupBy("label").agg(
        F.count_if(~F.col("synthetic")).alias("n_original"), F.count_if("synthetic").alias("n_synthetic"),
        F.count_if(F.col("synthetic") & inside).alias("n_inside"))
    return counted


# Whole prices name the vectors that are looked at; they are searched among all of their class.
ASKED = "CAST(round({x} * 100) AS BIGINT) % 100 = 0"


@query("smote_partners", f"""WITH sizes AS (SELECT label, count(*) AS n FROM v_tab GROUP BY label),
    r AS (SELECT DISTINCT label, x1, x2, x3, x4 FROM v_tab JOIN sizes USING (label) WHERE n < (SELECT max(n) FROM sizes)),
    d AS (SELECT a.*, sqrt((a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2 + (a.x3 - b.x3) ** 2 + (a.x4 - b.x4) ** 2) AS dist
          FROM r AS a JOIN r AS b ON a.label = b.label AND (a.x1, a.x2, a.x3, a.x4) <> (b.x1, b.x2, b.x3, b.x4) WHERE {ASKED.format(x='a.x2')})
    SELECT label, x1, x2, x3, x4, CAST(row_number() OVER (PARTITION BY label, x1, x2, x3, x4 ORDER BY dist) - 1 AS INTEGER) AS place, round(dist, 6) AS dist
    FROM d QUALIFY place < 5""")
def smote_partners(spark, folder):
    """The five nearest that new rows are drawn toward, for every vector of a whole price, equal to all distances in SQL."""
    found = partners(view(spark, folder, "v_tab"), "label", XS)
    asked = found.where(ASKED.format(x="vec[1]")).select("label", *(F.get("vec", F.lit(i)).alias(c) for i, c in enumerate(XS)), F.posexplode("near").alias("place", "of"))
    return asked.select("label", *XS, "place", F.round("of.dist", 6).alias("dist"))


WIDE = {**{c: c for c in XS}, **{f"{a}_{b}": f"({a} + 1) * ({b} + 1)" for n, a in enumerate(XS) for b in XS[n + 1:]}, "y1": "x1 * x1", "y2": "x4 * 100"}


@query("smote_oversample_wide", """WITH n AS (SELECT label, count(*) AS n FROM v_tab GROUP BY label)
    SELECT label, max(n) OVER () - n AS n_synthetic, max(n) OVER () - n AS n_on_segment, max(n) OVER () - n AS n_between_rows FROM n""")
def smote_oversample_wide(spark, folder):
    """Twelve features, neighbours by cells: every new row lies between two rows of its class."""
    source = view(spark, folder, "v_tab").select("label", *[F.expr(e).cast("double").alias(c) for c, e in WIDE.items()])
    vec = F.array(*WIDE)
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    on_segment = gap(vec, F.col("start")) + gap(vec, F.col("other")) <= gap(F.col("start"), F.col("other")) * (1 + 1e-9) + 1e-6
    # Rows are looked at once; what is kept of a vector is the digest that it is compared by.
    digest = lambda v: F.unhex(F.md5(F.to_json(F.struct(F.transform(v, lambda x: x + 0.0).alias("v"))).cast("binary")))
    rows = smote_oversample(source, "label", list(WIDE), neighbours="cells", trace=True)
    rows = settle(rows.select("label", "synthetic", F.when(F.col("synthetic"), on_segment).alias("seg"),
                              *(F.when(F.col("synthetic"), digest(F.col(c))).alias(c) for c in ("start", "other"))), tidy=True)
    counted = rows.groupBy("label").agg(F.count_if("synthetic").alias("n_synthetic"))
    new = rows.filter("synthetic").groupBy("label", "start", "other").agg(F.count(F.lit(1)).alias("n"), F.count_if("seg").alias("n_seg"))
    grown = counted.filter("n_synthetic > 0").select("label")
    real = source.join(F.broadcast(grown), "label", "left_semi").select("label", digest(vec).alias("end")).distinct()
    between = new.join(real.withColumnRenamed("end", "start"), ["label", "start"], "left_semi").join(
        real.withColumnRenamed("end", "other"), ["label", "other"], "left_semi").groupBy("label").agg(F.sum("n").alias("n_between_rows"))
    segments = new.groupBy("label").agg(F.sum("n_seg").alias("n_on_segment"))
    whole = counted.join(segments, "label", "left").join(between, "label", "left")
    return whole.na.fill(0, ["n_on_segment", "n_between_rows"])


def prepared(spark, folder):
    """Encoded, split and scaled test table as (row_key, features, label, split)."""
    encoded = prep.label_encode(view(spark, folder, "v_tab"), ["c1", "c2"])
    columns = ["c1", "c2", *XS]
    scaled = prep.standard_scale(prep.random_split(encoded, "row_key"), columns, F.col("split") == "train")
    return prep.features_target(scaled, "label", keep=["row_key", "split"], features=columns)


def signs(spark, folder):
    """Vectors in four classes, by the signs of their first two values."""
    sign = lambda i: (F.get("embedding", F.lit(i)) > 0).cast("int")
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), (sign(0) + 2 * sign(1)).alias("label"))
    return prep.random_split(rows, "vec_id")


def _outcome(predictions):
    """Test rows per label, and whether the model beats the guess of the commonest label.

    Predictions differ between solvers; these figures don't.
    """
    counts = metrics.pair_counts(predictions.select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")))
    # The few counts are used twice, the predictions are made once.
    sizes = settle(counts).groupBy("label").agg(F.sum("n").alias("n_test"), F.sum(F.when(F.expr("label = prediction"), F.col("n")).otherwise(0)).alias("_right"))
    # One row of scalars, never a row per prediction.
    beats = sizes.agg((F.sum("_right") > F.max("n_test")).alias("beats_majority"))
    return sizes.select("label", "n_test", beats.scalar().alias("beats_majority"))


def _outcome_sql(rows: str, key: str) -> str:
    return f"""SELECT CAST(label AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n_test, true AS beats_majority
    FROM {rows} WHERE {md5_part(f"concat({key}, '|42')")} < 858993459 GROUP BY label"""


TAB_OUTCOME = _outcome_sql("v_tab", "row_key")


@query("train_logistic", TAB_OUTCOME)
def train_logistic(spark, folder):
    return _outcome(models.train_and_score(prepared(spark, folder), lambda t: models.train_logistic(t, c=0.1)))


@query("train_tree_ml", TAB_OUTCOME)
def train_tree_ml(spark, folder):
    return _outcome(models.train_and_score(prepared(spark, folder), models.train_tree))


@query("train_forest_ml", TAB_OUTCOME)
def train_forest_ml(spark, folder):
    return _outcome(models.train_and_score(prepared(spark, folder), models.train_forest))


def _with_flags(predictions, **flags):
    """`_outcome` and figures about the model that must hold."""
    return _outcome(predictions).withColumns({name: F.lit(bool(value)) for name, value in flags.items()})


def _flags_sql(sql, *flags):
    return f"SELECT *, {', '.join(f'true AS {f}' for f in flags)} FROM ({sql})"


def hinge_slope(train, machine, c):
    """Norm of the squared-hinge objective's gradient at `machine`, by plain aggregation over all rows of `train`."""
    sign = F.when(F.col("label") > 0, 1.0).otherwise(-1.0)
    pull = F.greatest(F.lit(0.0), 1 - sign * F.col("margin")) * sign
    sums = machine.score(train).select(pull.alias("pull"), F.posexplode(F.concat("features", F.array(F.lit(1.0)))).alias("j", "x")).groupBy("j").agg(F.sum(F.col("pull") * F.col("x")).alias("s"))
    weights = dict(enumerate([*machine.coefficients, machine.intercept]))
    return sum((weights[j] - 2 * c * s) ** 2 for j, s in sums.collect()) ** 0.5


@query("train_tree", _flags_sql(TAB_OUTCOME, "leaves_recounted", "sizes_hold"))
def train_tree(spark, folder):
    """Depth 10, splits of 10 rows, leaves of 4; SQL over the rows counts every leaf again."""
    rows = settle(prepared(spark, folder))
    train = rows.filter("split = 'train'")
    tree = trees.train_tree(train, "row_key")
    again = train.groupBy(F.expr(tree.leaf_sql()).alias("leaf"), "label").count().collect()
    counted = {(r["leaf"], int(r["label"])): float(r["count"]) for r in again}
    kept = {(leaf, y): n for leaf in tree.leaves() for y, n in enumerate(tree.counts[leaf].tolist()) if n}
    large = all(tree.counts[i].sum() >= (4 if tree.feature[i] < 0 else 10) for i in tree.reached())
    return _with_flags(trees.score_tree(tree, rows.filter("split = 'test'")), leaves_recounted=counted == kept, sizes_hold=large and max(tree.depth) <= 10)


SPLIT_COLUMNS = ["c1", "c2", "x1", "x3", "x4"]


def _splits_sql(levels, min_split, min_leaf):
    """A brute-force grower: per level the counts of all values, the gain of every cut, the best cut, and the rows moved on."""
    def entropy(n, k):
        return f"-(CASE WHEN {k} IN (0, {n}) THEN 0 ELSE {k} / {n} * log2({k} / {n}) + ({n} - {k}) / {n} * log2(({n} - {k}) / {n}) END)"

    text = f"""WITH l0 AS (SELECT 1 AS node, label, [CASE c1 WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END, CASE c2 WHEN 'F' THEN 0.0 ELSE 1.0 END, x1, x3, x4]::DOUBLE[] AS xs FROM v_tab),
    v0 AS (SELECT DISTINCT unnest(range(5)) AS f, unnest(xs) AS v FROM l0), cuts AS (SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut FROM v0)"""
    for k in range(levels):
        text += f""",
    c{k} AS (SELECT node, f, v, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS k FROM (SELECT node, label, unnest(range(5)) AS f, unnest(xs) AS v FROM l{k}) GROUP BY node, f, v),
    s{k} AS (SELECT node, c.f, cut, sum(n) OVER (w ORDER BY c.v) AS a, sum(k) OVER (w ORDER BY c.v) AS ak, sum(n) OVER w AS n, sum(k) OVER w AS k
             FROM c{k} AS c JOIN cuts USING (f, v) WINDOW w AS (PARTITION BY node, c.f)),
    g{k} AS (SELECT *, round({entropy('n', 'k')} - a / n * ({entropy('a', 'ak')}) - (n - a) / n * ({entropy('(n - a)', '(k - ak)')}), 9) AS gain
             FROM s{k} WHERE a >= {min_leaf} AND n - a >= {min_leaf} AND n >= {min_split}),
    b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) AS r FROM g{k}) WHERE r = 1 AND gain > 0),
    l{k + 1} AS (SELECT 2 * l.node + (CASE WHEN xs[f + 1] <= cut THEN 0 ELSE 1 END) AS node, label, xs FROM l{k} AS l JOIN b{k} USING (node))"""
    return text + " " + " UNION ALL ".join(f"SELECT node::INTEGER AS node, f::INTEGER AS feature, round(cut, 6) AS cut, n, a AS n_left, round(gain, 6) AS gain FROM b{k}" for k in range(levels))


@query("tree_splits", _splits_sql(4, 10, 4))
def tree_splits(spark, folder):
    """Four levels of splits over five columns of few values, equal to a brute-force search in SQL. Children of node i are 2i and 2i + 1."""
    coded = prep.label_encode(view(spark, folder, "v_tab"), ["c1", "c2"])
    rows = prep.features_target(coded, "label", keep=["row_key"], features=SPLIT_COLUMNS)
    tree = trees.train_tree(rows, "row_key", max_depth=4)
    found, stack = [], [(0, 1)]
    while stack:
        node, name = stack.pop()
        if tree.feature[node] >= 0:
            found.append((name, tree.feature[node], round(tree.cut[node], 6), float(tree.counts[node].sum()), float(tree.counts[tree.left[node]].sum()), round(tree.gain[node], 6)))
            stack += [(tree.left[node], 2 * name), (tree.right[node], 2 * name + 1)]
    return spark.createDataFrame(found, "node int, feature int, cut double, n double, n_left double, gain double")


@query("train_forest", _flags_sql(TAB_OUTCOME, "leaves_are_pure"))
def train_forest(spark, folder):
    """A hundred trees without a limit of depth: every leaf holds one label."""
    rows = settle(prepared(spark, folder))
    forest = trees.train_forest(rows.filter("split = 'train'"), "row_key")
    mixed = trees.forest_leaves(forest).where("array_min(counts) > 0").isEmpty()
    test = rows.filter("split = 'test'")
    scored = trees.score_forest(forest, test, "row_key").join(test.select("row_key", "label"), "row_key")
    return _with_flags(scored, leaves_are_pure=mixed)


@query("train_linear_svm", _flags_sql(TAB_OUTCOME, "slope_is_zero"))
def train_linear_svm(spark, folder):
    """Squared hinge loss; the gradient at the result vanishes over all training rows."""
    rows = settle(prepared(spark, folder))
    machine, scored = margins.linear_svm(rows)
    return _with_flags(scored, slope_is_zero=hinge_slope(rows.filter("split = 'train'"), machine, 1.0) < 1e-6)


@query("train_linear_svm_hinge", TAB_OUTCOME)
def train_linear_svm_hinge(spark, folder):
    return _outcome(models.train_and_score(prepared(spark, folder), models.train_linear_svm))


@query("train_rbf_svm", _flags_sql(TAB_OUTCOME, "kernel_is_near"))
def train_rbf_svm(spark, folder):
    """Nystrom features; their products differ from the kernel by less than 0.02 on average over a thousand pairs."""
    rows = settle(prepared(spark, folder))
    features, _, scored = margins.gaussian_svm(rows)
    return _with_flags(scored, kernel_is_near=margins.kernel_error(rows, "row_key", features) < 0.02)


@query("train_rbf_svm_fourier", TAB_OUTCOME)
def train_rbf_svm_fourier(spark, folder):
    return _outcome(models.rbf_svm(prepared(spark, folder)))


SIGNS_SQL = "(SELECT vec_id, (embedding[1] > 0)::INTEGER + 2 * (embedding[2] > 0)::INTEGER AS label FROM embeddings) AS e"


@query("train_dense_net_sigmoid", _outcome_sql(SIGNS_SQL, "vec_id"))
def train_dense_net_sigmoid(spark, folder):
    """The three hidden layers of the flow-record network."""
    return _outcome(models.train_and_score(signs(spark, folder), lambda t: models.train_dense_net(t, [64, 128, 96, 64, 4])))


CURVED_SQL = "(SELECT row_key, CASE WHEN (x1 >= 25) <> (x3 >= 0.05) THEN 1 ELSE 0 END AS label FROM v_tab) AS t"


def curved(spark, folder):
    """(row_key, features, label, split) with a label that no line through the features tells."""
    rows = view(spark, folder, "v_tab").withColumn("label", F.expr("CASE WHEN (x1 >= 25) <> (x3 >= 0.05) THEN 1 ELSE 0 END"))
    columns = ["x1", "x3", "x4"]
    scaled = prep.standard_scale(prep.random_split(rows, "row_key"), columns, F.col("split") == "train")
    return prep.features_target(scaled, "label", keep=["row_key", "split"], features=columns)


@query("train_dense_net", _flags_sql(_outcome_sql(CURVED_SQL, "row_key"), "beats_linear"))
def train_dense_net(spark, folder):
    """The flow-record network: ReLU, dropout before the last layer, Adam in mini-batches; right more often than a linear model."""
    rows = settle(curved(spark, folder))
    train, test = (rows.filter(F.col("split") == part) for part in ("train", "test"))
    net = nets.DenseNet((3, 128, 96, 64, 2), (0.0, 0.0, 0.25))
    nets.train_dense(train, net, "row_key", batches=10, epochs=6, rate=0.005)
    scored = settle(nets.score_dense(net, test).select("label", "prediction"))
    line = models.train_and_score(rows, models.train_logistic)
    ours, theirs = (metrics.accuracy(part.select("label", "prediction")).first()[0] for part in (scored, line))
    return _with_flags(scored, beats_linear=ours > theirs)


def _reloaded(spark, folder):
    """Every row of the prepared table with the predictions of a model and of its saved copy."""
    vectors = models.as_vectors(settle(prepared(spark, folder)))
    model = models.train_logistic(vectors.filter("split = 'train'").select("features", "label"))
    path = scratch_path(spark, "model")
    models.save_model(model, path)
    first = models.score(model, vectors).select("row_key", "features", "label", "split", F.col("prediction").alias("before"))
    return models.score(models.load_model(LogisticRegressionModel, path), first)


@query("persist_model", "SELECT count(*) AS n, count(*) AS n_equal FROM v_tab")
def persist_model(spark, folder):
    return _reloaded(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") == F.col("prediction")).alias("n_equal"))


@query("batch_score_model", f"""SELECT CASE WHEN {md5_part("concat(row_key, '|42')")} < 858993459 THEN 'test' ELSE 'train' END AS split,
    count(*) AS n, count(*) AS n_argmax, true AS beats_majority FROM v_tab GROUP BY 1""")
def batch_score_model(spark, folder):
    """A loaded model scores every row; its prediction is the arg-max of its class probabilities."""
    scored = _reloaded(spark, folder)
    right = F.count_if(F.col("prediction") == F.col("label"))
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(metrics.argmax(F.col("probability")) == F.col("prediction")).alias("n_argmax"),
        (right > F.greatest(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0))).alias("beats_majority"))
