"""Training-table profiling, encoding, splitting, scaling, models and metrics.

Profiling and metrics are single-pass aggregates.  Fitted parameters (means,
deviations, category codes) are small by construction — one value per
feature or per category — and are applied as literals or via a join on the
category value.  Models are ``pyspark.ml`` estimators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.sources import dims

SPLIT_SEED = 42


def dataset_report(df: DataFrame, label: str, expected: list[str] | None = None) -> DataFrame:
    """Rows, columns, null cells, class counts, minority share, oversampling flag.

    Two aggregation levels (per class, then over the classes), no join."""
    cols = df.columns
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in cols])
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), nulls.cast("bigint").alias("nulls"))
    missing = sorted(set(expected or []) - set(cols))
    j = per_class.agg(F.sum("n").cast("bigint").alias("n_rows"), F.sum("nulls").cast("bigint").alias("null_cells"),
                      F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_class"), F.sum("n").alias("total"))
    share = F.col("min_class") / F.col("total")
    return j.select("n_rows", F.lit(len(cols)).alias("n_cols"), "null_cells", "n_classes",
                    F.col("min_class").cast("bigint").alias("min_class_rows"),
                    share.alias("min_class_share"),
                    (share < dims.OVERSAMPLE_MIN_SHARE).alias("needs_oversampling"),
                    F.lit(",".join(missing)).alias("missing_columns"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return c.select(label, "n", (F.col("n") * 100.0 / total).alias("pct"))


def exact_median(df: DataFrame, value: str, by: list[str], partitions: int | None = None) -> DataFrame:
    """Exact median (midpoint of the two middle values) per group.

    Values are counted per (group, value), so a hot group spreads over tasks
    by value.  The distinct pairs are range-partitioned by (group, value);
    each partition's share of a group gets an offset from a small
    (group × partition) table, and cumulative counts are computed inside
    the partition.  No task ever holds a whole group."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vc = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    from vigil.session import materialize
    p = materialize(vc.repartitionByRange(n, *by, value).withColumn("_pid", F.spark_partition_id()))
    gp = p.groupBy(*by, "_pid").agg(F.sum("c").alias("_pc"))
    gp = (gp.withColumn("_off", F.sum("_pc").over(Window.partitionBy(*by).orderBy("_pid")) - F.col("_pc"))
            .withColumn("n", F.sum("_pc").over(Window.partitionBy(*by))).drop("_pc"))
    wl = Window.partitionBy("_pid", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = (p.withColumn("_local", F.sum("c").over(wl)).join(gp, [*by, "_pid"])
             .withColumn("hi", F.col("_off") + F.col("_local")).withColumn("lo", F.col("hi") - F.col("c") + 1))
    lo_pos = F.floor((F.col("n") + 1) / 2)
    hi_pos = F.ceil((F.col("n") + 1) / 2)
    picks = cum.select(*by, F.col(value).cast("double").alias("v"),
                       ((F.col("lo") <= lo_pos) & (lo_pos <= F.col("hi"))).alias("is_lo"),
                       ((F.col("lo") <= hi_pos) & (hi_pos <= F.col("hi"))).alias("is_hi")) \
        .where(F.col("is_lo") | F.col("is_hi"))
    return picks.groupBy(*by).agg(((F.max(F.when(F.col("is_lo"), F.col("v"))) +
                                    F.max(F.when(F.col("is_hi"), F.col("v")))) / 2.0).alias("median"))


def fit_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact median per numeric column (one value each reaches the driver).

    All columns are one selection: values are counted per (column, value), so the
    number of shuffles and checkpoints does not depend on the number of columns."""
    if not cols:
        return {}
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols]))
    found = exact_median(df.select(named.alias("x")).select("x.feature", "x.value").where("not isnan(value)"), "value", ["feature"])
    medians = {r["feature"]: r["median"] for r in found.collect()}
    return {c: medians.get(c) for c in cols}


def impute_medians(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    for c, m in medians.items():
        if m is not None:
            df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(m)))
    return df


def fit_standardizer(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (zero deviation → 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = row[f"{c}__m"], row[f"{c}__s"]
        out[c] = (m or 0.0, s if s else 1.0)
    return out


def standardize(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    for c, (m, s) in params.items():
        df = df.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(m)) / F.lit(s))
    return df


def category_codes(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """Alphabetical code per category value (0-based), as a table.

    A distributed dense rank: distinct values are range-partitioned (equal
    values share a partition, partitions are ordered), each partition is
    counted, and a code is the partition's offset plus the rank inside it.
    Only the per-partition counts (one row per partition) are combined, so no
    task ever holds the whole vocabulary."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from vigil.session import materialize
    d = materialize(df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
                      .repartitionByRange(n, "value").withColumn("_pid", F.spark_partition_id()))
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    local = d.withColumn("_r", F.row_number().over(Window.partitionBy("_pid").orderBy("value")) - 1)
    return (local.join(F.broadcast(offsets), "_pid")
                 .select(F.lit(col).alias("feature"), "value", (F.col("_off") + F.col("_r")).cast("int").alias("code")))


def hash_fraction(key: Column, seed: int = SPLIT_SEED) -> Column:
    """Deterministic uniform [0, 1) from md5 of the key and seed."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def split_column(key: Column, train: float = 0.70, val: float = 0.85, seed: int = SPLIT_SEED) -> Column:
    """70 / 15 / 15 assignment by hash fraction: every class keeps its share in
    expectation, with no per-class sort (a large class never lands in one task)."""
    f = hash_fraction(key, seed)
    return F.when(f < train, F.lit("train")).when(f < val, F.lit("validation")).otherwise(F.lit("test"))


def _hash_uniform(*cols: Column, salt: str) -> Column:
    """Deterministic uniform in (0, 1) from a 64-bit hash (independent of partitioning)."""
    h = F.pmod(F.xxhash64(*cols, F.lit(salt)), F.lit(2147483647).cast("bigint"))
    return (h.cast("double") + 1.0) / 2147483648.0


def single_class_augment(train: DataFrame, key: str, numeric: list[str], label: str,
                         share: float = 0.05, minimum: int = 10, noise_sd: float = 0.1,
                         seed: int = SPLIT_SEED) -> DataFrame:
    """Fallback when the training split holds one class: draw max(int(share·n),
    minimum) rows with replacement, add N(0, noise_sd) to the numeric
    features, label them 1 and append them.

    Rows get a global ordinal (distributed, no single-partition window); each
    draw is a hashed ordinal joined back on equality; the noise is Box-Muller
    over hash-derived uniforms, so the result does not depend on partitioning."""
    from vigil.functions.ordered import running_totals
    spark = train.sparkSession
    n = train.count()
    n_syn = max(int(n * share), minimum)
    indexed = running_totals(train, key, [])
    draws = spark.range(n_syn).select(F.col("id").alias("_draw"),
                                      F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)).alias("idx"))
    syn = draws.join(indexed, "idx")
    for c in numeric:
        u1 = _hash_uniform(F.col("_draw"), salt=f"{seed}:{c}:1")
        u2 = _hash_uniform(F.col("_draw"), salt=f"{seed}:{c}:2")
        z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)
        syn = syn.withColumn(c, F.col(c).cast("double") + F.lit(noise_sd) * z)
    syn = syn.withColumn(label, F.lit(1).cast(dict(train.dtypes)[label]))
    out_cols = train.columns
    return (train.select(*[F.col(c).cast("double") if c in numeric else F.col(c) for c in out_cols])
                 .unionByName(syn.select(*out_cols)))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.30, seed: int = SPLIT_SEED) -> DataFrame:
    """Exact per-class 70 / 15 / 15 split: rows are ordered inside their class
    by md5(key, seed); the first n_c − ⌈0.3·n_c⌉ are train, of the rest
    ⌈half⌉ are test and the others validation.  Class ordinals come from a
    distributed per-class ranking (no per-class single task)."""
    from vigil.functions.ordered import running_totals
    ranked = running_totals(df.withColumn("_hk", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))),
                            "_hk", [], index_col="_pos", by=[label])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    j = ranked.join(sizes, label)
    n_temp = F.ceil(F.col("_n") * F.lit(test_share))
    n_train = F.col("_n") - n_temp
    n_test = F.ceil(n_temp / 2.0)
    split = (F.when(F.col("_pos") < n_train, F.lit("train"))
             .when(F.col("_pos") < n_train + (n_temp - n_test), F.lit("validation"))
             .otherwise(F.lit("test")))
    return j.withColumn("split", split).drop("_hk", "_pos", "_n")


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per-class precision / recall / F1 / support plus accuracy, macro and
    weighted averages (one row each), from one confusion aggregation."""
    from vigil.session import materialize
    # the confusion table has at most classes² rows; it is written once so the
    # derivations below do not re-run the upstream plan
    conf = materialize(df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p"))
                         .agg(F.count(F.lit(1)).alias("n")))
    classes = conf.select(F.col("y").alias("cls")).unionByName(conf.select(F.col("p").alias("cls"))).distinct()
    per = (classes.join(conf, F.col("y") == F.col("cls"), "left")
           .groupBy("cls").agg(F.sum(F.when(F.col("p") == F.col("cls"), F.col("n")).otherwise(0)).alias("tp"),
                               F.sum(F.coalesce("n", F.lit(0))).alias("support")))
    pred = conf.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    m = per.join(pred, "cls", "left").fillna(0, ["predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    m = m.withColumn("precision", prec).withColumn("recall", rec)
    m = m.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(0.0))
    total = F.sum("support").over(Window.partitionBy())
    rows = m.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                    F.col("support").cast("bigint").alias("support"), F.col("tp").cast("bigint").alias("tp"),
                    (F.col("support") / total).alias("_w"))
    summary = rows.groupBy(F.lit(1).alias("_k")).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("_w")).alias("wp"), F.sum(F.col("recall") * F.col("_w")).alias("wr"),
        F.sum(F.col("f1") * F.col("_w")).alias("wf"), F.sum("support").alias("n"), F.sum("tp").alias("tp"))
    macro = summary.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                           F.col("mf").alias("f1"), F.col("n").cast("bigint").alias("support"), F.col("tp").cast("bigint").alias("tp"))
    weighted = summary.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                              F.col("wf").alias("f1"), F.col("n").cast("bigint").alias("support"), F.col("tp").cast("bigint").alias("tp"))
    acc = summary.select(F.lit("accuracy").alias("class"), (F.col("tp") / F.col("n")).alias("precision"),
                         (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                         F.col("n").cast("bigint").alias("support"), F.col("tp").cast("bigint").alias("tp"))
    return rows.drop("_w").unionByName(macro).unionByName(weighted).unionByName(acc)


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label).pivot(prediction).count().fillna(0)


def select_model(metrics: DataFrame) -> DataFrame:
    """metrics(model, macro_f1, recall_1) → tier by F1 bar, best recall_1 wins."""
    tier = (F.when(F.col("macro_f1") > dims.MODEL_F1_BAR, 0)
            .when(F.col("macro_f1") > dims.MODEL_F1_FALLBACK_BAR, 1).otherwise(2))
    m = metrics.withColumn("tier", tier)
    best_tier = F.min("tier").over(Window.partitionBy())
    m = m.withColumn("eligible", F.col("tier") == best_tier)
    rank = F.row_number().over(Window.partitionBy("eligible").orderBy(F.col("recall_1").desc(), F.col("model")))
    return m.withColumn("selected", F.col("eligible") & (rank == 1))


def train_candidates(train: DataFrame, validation: DataFrame, numeric: list[str], categorical: list[str],
                     label: str, seed: int = SPLIT_SEED, key_col: str | None = None):
    """Fit random forest (100 trees), gradient boosting (30 rounds, depth 4) and
    logistic regression (≤ 3000 iterations) on scaled numerics + category codes.

    Each fitted pipeline holds the whole path from raw columns: medians for
    nulls, scaling, codes (unseen values get a code of their own) and the model,
    so that loading and ``transform`` is all that serving needs."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler

    med = fit_medians(train, numeric)
    if train.select(label).distinct().limit(2).count() < 2 and key_col is not None:
        train = single_class_augment(impute_medians(train, med), key_col, numeric, label, seed=seed)
    train = train.persist()
    params = fit_standardizer(impute_medians(train, med), numeric)
    scaled = ", ".join(f"(coalesce(cast(`{c}` as double), {float(med[c] or 0.0)!r}D) - {params[c][0]!r}D) / {float(params[c][1])!r}D AS `{c}_z`"
                       for c in numeric)
    prepare = SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__" if numeric else "SELECT * FROM __THIS__")
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_code", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
           for c in categorical]
    bins = max([32, *(len(m.labels) + 1 for m in idx)])  # a tree needs a bin for each category
    feats = [f"{c}_z" for c in numeric] + [f"{c}_code" for c in categorical]
    asm = VectorAssembler(inputCols=feats, outputCol="features")
    models = {
        "random_forest": RandomForestClassifier(labelCol=label, numTrees=100, seed=seed, maxBins=bins),
        "gradient_boosting": GBTClassifier(labelCol=label, maxIter=30, maxDepth=4, seed=seed, maxBins=bins),
        "logistic_regression": LogisticRegression(labelCol=label, maxIter=3000),
    }
    fitted, scored = {}, {}
    for name, est in models.items():
        model = Pipeline(stages=[prepare, *idx, asm, est]).fit(train)
        fitted[name] = PipelineModel(model.stages)
        scored[name] = model.transform(validation)
    train.unpersist()
    return fitted, scored, feats
