"""Every operator as a query over the given tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixture import LABELS, SPEC, survey
from surveyloom import census
from surveyloom.functions import columns as C
from surveyloom.operators import certificates, copula, design, features, groups, labels, metrics, models, profile
from surveyloom.operators.sparse_design import fit_sparse
from surveyloom.session import scratch_path, written
from surveyloom.sources import dictionary, readers, runs, writers
from surveyloom.spec import TableSpec

RECODES = {
    "SEX": {"1": "male", "2": "female"},
    "RAC1P": {"1": "white", "2": "black", "6": "asian"},
}
COPULA_COLUMNS = list(SPEC.sequence)
STATE_LABELS = {fips: usps for usps, fips in census.STATES.items()}
DESIGN_LABELS = {**LABELS, "ST": STATE_LABELS}
WANTED = ["CA", "NY", "TX"]
GRADIENT_LIMIT = 1e-8


def fixed(col: Column, digits: int = 6) -> Column:
    """Round by the same arithmetic in both engines."""
    scale = float(10**digits)
    return F.floor(col * scale + 0.5) / scale


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[
        (fixed(C.quoted(c), digits) if c in doubles else C.quoted(c)).alias(c) for c in df.columns
    ])


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return features.build_features(survey(spark, sf), SPEC)


def _cast(spark: SparkSession, sf: str) -> DataFrame:
    sp = features.select_required(survey(spark, sf), SPEC)
    return features.cast_lenient(features.adjust(sp, SPEC), SPEC)


def _population(spark: SparkSession, sf: str) -> DataFrame:
    return groups.group_population(_features(spark, sf), "ST", "PWGTP")


def _training(spark: SparkSession, sf: str) -> DataFrame:
    return groups.partition_training(_features(spark, sf), SPEC, census.state_dim(spark))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Label, two scores, and the total of the row's group as its weight."""
    sp = survey(spark, sf).select(
        "ST", (F.col("DIS") == "1").cast("tinyint").alias("label"), "SCORE_A", "SCORE_B"
    )
    population = written(_population(spark, sf), "population")
    return groups.with_group_value(sp, population, "ST", "state_population")


SCORES = {"standard": "SCORE_A", "survey_weighted": "SCORE_B"}


def _synthetic_like(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the synthetic table with the group total, from the feature table."""
    table = _features(spark, sf).select("ST", *SPEC.sequence)
    return groups.with_group_value(table, written(_population(spark, sf), "population"), "ST", "state_population")


# sources and sinks


def csv_union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Two CSV layouts with different columns and orders, read back by name with inferred types."""
    code = F.lpad(F.col("nation").cast("string"), 2, "0").alias("nation")
    customer = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    supplier = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
    )
    paths = []
    for name, df in (("customer", customer), ("supplier", supplier)):
        paths.append(scratch_path(spark, f"csv-{name}"))
        df.withColumn("nation", code).write.option("header", True).csv(paths[-1])
    return readers.read_csv_by_name(spark, paths, text_columns=["nation"]).select(
        F.col("id").cast("bigint").alias("id"), "name", "nation", "segment", "balance"
    )


def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    supplier = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")
    )
    return readers.union_by_name([customer, supplier])


def parquet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """One table through the three codecs and back through one multi-path scan."""
    table = survey(spark, sf).select("SERIALNO", "ST", "WAGP")
    paths = []
    for codec in (writers.EXTRACT_CODEC, writers.TABLE_CODEC, writers.DESIGN_CODEC):
        paths.append(scratch_path(spark, f"codec-{codec}"))
        writers.write_parquet(table, paths[-1], codec)
    return readers.read_parquet(spark, *paths, columns=["ST", "WAGP"])


def partition_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Training table written one folder per group; the codes come back with their leading zero."""
    table = writers.write_by_group(_training(spark, sf), scratch_path(spark, "training"), "ST")
    return groups.rows_per_group(table, "ST")


def partition_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """One group of the partitioned table; the filter prunes folders."""
    table = writers.write_by_group(_training(spark, sf), scratch_path(spark, "training"), "ST")
    return _rounded(table.where(F.col("ST") == "06").select("ST", "AGEP", "SEX", "WAGP"))


def population_json(spark: SparkSession, sf: str) -> DataFrame:
    return writers.write_group_values(_population(spark, sf), scratch_path(spark, "population-json"), "ST")


def run_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Lineage rows of a features step and of an extract, the latter once built and once from the cache."""
    layout = runs.RunLayout(scratch_path(spark, "run"), "check")
    for _ in range(2):
        key = runs.extract_cache_key(2023, "5-Year", WANTED)
        table, source = runs.cached_extract(spark, layout, key, lambda: survey(spark, sf), {"states": WANTED})
        runs.record_step(layout, "extract", table, layout.raw, {"source": source})
    table = writers.write_parquet(features.build_features(table, SPEC), layout.features)
    runs.record_step(layout, "features", table, layout.features)
    return runs.run_metadata(spark, layout).select(
        "step", "rows", "cols", F.coalesce(F.col("params")["source"], F.lit("")).alias("source")
    )


def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    states = nation.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("states"))
    key = C.extract_key(F.lit(2023), F.lit("5-Year"), F.col("states"))
    return states.select("n_regionkey", key.alias("cache_key"))


def latest_model(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    found = runs.latest_models(orders, name="o_orderpriority", created="o_orderdate", uri="o_orderkey")
    return found.select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("uri"))


# features


def exclude_rename(spark: SparkSession, sf: str) -> DataFrame:
    return features.exclude_rename(survey(spark, sf), {"ST": "STATE"})


def schema_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shape(survey(spark, sf))


def select_columns(spark: SparkSession, sf: str) -> DataFrame:
    return features.select_required(survey(spark, sf), SPEC)


def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return features.drop_columns(survey(spark, sf), ["OCCP", "SCORE_A", "SCORE_B"])


def relabel(spark: SparkSession, sf: str) -> DataFrame:
    numeric, other = features.split_by_type(survey(spark, sf))
    return features.relabel(survey(spark, sf).select(*other), census.COLUMN_LABELS)


def recode(spark: SparkSession, sf: str) -> DataFrame:
    spec = TableSpec(
        tuple(
            type(c)(c.name, c.kind, c.role, RECODES.get(c.name), c.adjusted) for c in SPEC.columns
        ),
        group="ST",
        weight="PWGTP",
    )
    return features.recode(survey(spark, sf), spec).select("SERIALNO", "SEX", "RAC1P", "SCHL")


def income_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.adjust(survey(spark, sf), SPEC).select("SERIALNO", "ADJINC", "PINCP", "WAGP"))


def lenient_cast(spark: SparkSession, sf: str) -> DataFrame:
    return features.cast_lenient(survey(spark, sf), SPEC).select("SERIALNO", "SPORDER", "ADJINC", "PWGTP", "AGEP", "WKHP")


def impute(spark: SparkSession, sf: str) -> DataFrame:
    cast = features.cast_lenient(features.select_required(survey(spark, sf), SPEC), SPEC)
    return _rounded(features.impute(cast, SPEC))


def build_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_features(spark, sf))


def synth_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The table with its nulls, filled from the means of each group in the feature table."""
    gaps = _cast(spark, sf).select("ST", "SCHL", "AGEP", "WKHP", "PINCP", "WAGP")
    return _rounded(features.fill_from_groups(gaps, _features(spark, sf), "ST"))


# groups


def group_population(spark: SparkSession, sf: str) -> DataFrame:
    return _population(spark, sf)


def supported_groups(spark: SparkSession, sf: str) -> DataFrame:
    return groups.supported_groups(survey(spark, sf), "ST", census.state_dim(spark))


def requested_groups(spark: SparkSession, sf: str) -> DataFrame:
    return groups.supported_groups(
        survey(spark, sf), "ST", census.state_dim(spark), wanted=census.state_codes(WANTED)
    )


def state_lookup(spark: SparkSession, sf: str) -> DataFrame:
    dim = census.state_dim(spark)
    counts = groups.rows_per_group(survey(spark, sf), "ST")
    return counts.join(dim, F.col("ST") == F.col("fips"), "left").select("ST", "usps", "n_rows")


def training_rows_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return groups.rows_per_group(_training(spark, sf), "ST")


def sample_size(spark: SparkSession, sf: str) -> DataFrame:
    return groups.sample_size(_population(spark, sf), "state_population", None, 10)


def group_value(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("ST", "label", "state_population")


def group_seed(spark: SparkSession, sf: str) -> DataFrame:
    present = survey(spark, sf).select("ST").distinct()
    return present.select("ST", C.group_seed(42, F.col("ST")).alias("seed"))


# copula


def group_means(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.group_means(_training(spark, sf), "ST", ["AGEP", "WKHP", "WAGP", "PINCP"]))


def copula_marginals(spark: SparkSession, sf: str) -> DataFrame:
    marginals = copula.column_marginals(_training(spark, sf), "ST", ["AGEP", "WKHP", "WAGP", "PINCP"])
    return _rounded(marginals.withColumn("digits", F.col("digits").cast("bigint")))


def category_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return copula.category_intervals(_training(spark, sf), "ST", ["SEX", "RAC1P", "SCHL", "DIS", "INDP", "OCCP"])


def copula_correlation(spark: SparkSession, sf: str) -> DataFrame:
    training = written(_training(spark, sf), "training")
    return _rounded(copula.fit_copula(training, "ST", COPULA_COLUMNS).correlations)


def _drawn(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    training = written(_training(spark, sf), "training")
    model = copula.fit_copula(training, "ST", SPEC.synthesised(training.columns))
    sizes = groups.sample_size(_population(spark, sf), "state_population", None, 10)
    sizes = groups.keep_supported(sizes, "ST", census.state_dim(spark))
    return training, copula.sample_copula(model, written(sizes, "sizes"), 42, carry=["state_population"])


def copula_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _drawn(spark, sf)[1]


def copula_sample_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn rows per group, and whether all numbers stay in the range and all texts in the vocabulary of the training rows.

    A text is looked up by a join with the values of its column and group, whose cost does not grow with the number of values.
    """
    training, drawn = _drawn(spark, sf)
    numeric, _ = features.split_by_type(training)
    columns = SPEC.synthesised(training.columns)
    cells = [x for c in columns if c in numeric for x in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))]
    joined = drawn.join(written(training.groupBy("ST").agg(*cells), "seen"), "ST")
    texts = [c for c in columns if c not in numeric]
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).alias("value")) for i, c in enumerate(texts)])
    values = written(training.select("ST", F.inline(pairs)).distinct(), "seen-values", "place")
    inside = F.lit(True)
    for c in columns:
        if c in numeric:
            inside &= F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high"))
            continue
        known = values.where(F.col("place") == texts.index(c)).select(F.col("ST").alias(f"{c}_of"), F.col("value").alias(f"{c}_known"))
        joined = joined.join(known, (F.col("ST") == F.col(f"{c}_of")) & (F.col(c) == F.col(f"{c}_known")), "left")
        inside &= F.col(f"{c}_known").isNotNull()
    return joined.groupBy("ST", "state_population").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(inside).alias("n_inside")
    )


# design matrix


def one_hot_labels(spark: SparkSession, sf: str) -> DataFrame:
    table = survey(spark, sf).select(*LABELS)
    return design.DesignSpec(LABELS, census.COLUMN_LABELS).fit_transform(table)


def one_hot_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return design.DesignSpec({}, census.COLUMN_LABELS).fit_transform(survey(spark, sf).select("INDP"))


def observed_values(spark: SparkSession, sf: str) -> DataFrame:
    return design.distinct_values(survey(spark, sf), ["SCHL", "INDP", "OCCP", "WKHP"])


def _floats(df: DataFrame) -> DataFrame:
    """Floats as doubles with five decimals."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType)}
    return df.select(*[
        (fixed(C.quoted(c).cast("double"), 5) if c in floats else C.quoted(c)).alias(c) for c in df.columns
    ])


def min_max(spark: SparkSession, sf: str) -> DataFrame:
    table = _features(spark, sf).select("AGEP", "WKHP", "PINCP", "WAGP")
    return _floats(design.DesignSpec({}).fit_transform(table))


def _design(spark: SparkSession, sf: str) -> tuple[design.DesignModel, DataFrame]:
    table = written(_synthetic_like(spark, sf), "synthetic-like")
    spec = design.DesignSpec(DESIGN_LABELS, census.COLUMN_LABELS, ["OCCP"], "state_population")
    return spec.fit(table), table


def design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    model, table = _design(spark, sf)
    return _floats(model.transform(table))


def design_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on one half of the table (SEX 1), applied to the other: bounds and columns come from the first."""
    table = _features(spark, sf).select("SEX", "AGEP", "WAGP", "INDP")
    model = design.DesignSpec({"SEX": LABELS["SEX"]}).fit(table.where("SEX = '1'"))
    return _floats(model.transform(table.where("SEX = '2'")))


SPARSE_COLUMNS = ["AGEP", "WAGP", "SEX", "INDP", "OCCP", "SERIALNO"]


def sparse_design(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and total per column of the sparse matrix; one of its text columns has a value of its own in every row."""
    table = written(_features(spark, sf).select(*SPARSE_COLUMNS), "sparse-input")
    model = fit_sparse(design.DesignSpec({"SEX": LABELS["SEX"]}), table)
    cells = model.transform(table).select(F.inline(F.arrays_zip("indices", "values")))
    totals = cells.groupBy(F.col("indices").alias("position")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("values").alias("total"))
    return _rounded(totals.join(model.names(spark), "position"), 3)


def labelled_values(spark: SparkSession, sf: str) -> DataFrame:
    dim = labels.value_labels(spark, LABELS)
    long = labels.labelled_values(survey(spark, sf), list(LABELS), dim)
    return long.groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("n"))


def dictionary_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A data dictionary written from the table's own codes and decades, read back, and the labels of all rows by code and range."""
    table = survey(spark, sf).select("SEX", "RAC1P", "AGEP")
    decade = F.floor(F.col("AGEP") / 10) * 10
    codes = [
        table.select(F.lit(c).alias("col"), F.lit("C").alias("kind"), F.col(c).alias("low"), F.col(c).alias("high"), F.concat(F.lit(f'{c}, "code" '), c).alias("label")).distinct()
        for c in ("SEX", "RAC1P")
    ]
    ages = table.where("AGEP IS NOT NULL").select(decade.alias("d")).distinct()
    ages = ages.select(F.lit("AGEP"), F.lit("N"), F.col("d").cast("string"), (F.col("d") + 9).cast("string"), F.concat(F.col("d").cast("string"), F.lit(" and on")))
    blank = ages.limit(1).select(F.lit("AGEP"), F.lit("N"), F.lit("bb"), F.lit("bb"), F.lit("not known"))
    lines = codes[0].unionAll(codes[1]).unionAll(ages).unionAll(blank)
    path = scratch_path(spark, "dictionary")
    lines.select(F.lit("VAL"), "col", "kind", F.lit(2), "low", "high", "label").write.option("quoteAll", True).option("escape", '"').csv(path)
    found = dictionary.label_values(table, ["SEX", "RAC1P", "AGEP"], dictionary.read_dictionary(spark, path))
    return found.groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("n"))


# profile


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The numeric columns with their nulls as a table on disk, which is what gets profiled."""
    table = _cast(spark, sf)
    return written(table.select(*features.split_by_type(table)[0]), "numbers")


def describe(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(profile.describe(_numbers(spark, sf)), 4)


def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(profile.correlation_matrix(_numbers(spark, sf)))


def unique_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.unique_counts(survey(spark, sf), labels=census.COLUMN_LABELS)


def value_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_frequencies(survey(spark, sf), labels=census.COLUMN_LABELS)


# metrics


def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    label = survey(spark, sf).select((F.col("DIS") == "1").cast("tinyint").alias("label"))
    return _rounded(metrics.class_balance(label, "label"))


def threshold_labels(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.threshold_labels(_scored(spark, sf), "label", SCORES, 0.45, keep=("ST",), prefix="predicted_disability_")


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.binary_metrics(_scored(spark, sf), "label", SCORES, "state_population", 0.45))


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_scored(spark, sf), "label", SCORES, "state_population"))


def weighted_bce(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf)
    logits = scored.select("label", "state_population", *[((F.col(p) - 0.5) * 4.0).alias(p) for p in SCORES.values()])
    return _rounded(metrics.weighted_cross_entropy(logits, "label", SCORES, "state_population"))


def variant_report(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.evaluate(_scored(spark, sf), "label", SCORES, "state_population")
    return _rounded(metrics.variant_report(written(found, "metrics")))


# models


def _problem(spark: SparkSession, sf: str) -> models.Problem:
    model, table = _design(spark, sf)
    matrix = written(model.transform(table), "design")
    return models.Problem.split(matrix, census.TARGET, census.COMPLEMENT, census.WEIGHT)


def _fit_score(kind: str, settings: dict | None = None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        problem = _problem(spark, sf)
        fitted = models.fit_variants(problem, kind, settings)
        scored = models.score_variants(problem, fitted)
        return metrics.threshold_labels(scored, "label", {v: f"p_{v}" for v in fitted}, prefix="predicted_disability_")

    return run


def _fit_profile(kind: str, settings: dict | None = None):
    """What holds for a good fit, per variant; see ``certificates``."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        problem = _problem(spark, sf)
        found = certificates.fit_certificate(problem, models.fit_variants(problem, kind, settings))
        flat = F.coalesce(F.col("gradient") < GRADIENT_LIMIT, F.lit(True))
        return _rounded(
            found.select("variant", "n_rows", "n_inside", "base_loss", (F.col("loss") < F.col("base_loss")).alias("beats_base"), flat.alias("flat"))
        )

    return run


QUERIES = {
    "group_population": group_population,
    "csv_union_by_name": csv_union_by_name,
    "union_by_name": union_by_name,
    "parquet_round_trip": parquet_round_trip,
    "partition_round_trip": partition_round_trip,
    "partition_pruned": partition_pruned,
    "population_json": population_json,
    "run_metadata": run_metadata,
    "cache_key": cache_key,
    "latest_model": latest_model,
    "exclude_rename": exclude_rename,
    "schema_profile": schema_profile,
    "select_columns": select_columns,
    "drop_columns": drop_columns,
    "relabel": relabel,
    "recode": recode,
    "income_adjust": income_adjust,
    "lenient_cast": lenient_cast,
    "impute": impute,
    "features": build_features,
    "synth_fill": synth_fill,
    "supported_groups": supported_groups,
    "requested_groups": requested_groups,
    "state_lookup": state_lookup,
    "training_rows_per_group": training_rows_per_group,
    "sample_size": sample_size,
    "group_value": group_value,
    "group_seed": group_seed,
    "group_means": group_means,
    "copula_marginals": copula_marginals,
    "category_intervals": category_intervals,
    "copula_correlation": copula_correlation,
    "copula_sample": copula_sample,
    "copula_sample_profile": copula_sample_profile,
    "one_hot_labels": one_hot_labels,
    "one_hot_vocab": one_hot_vocab,
    "observed_values": observed_values,
    "min_max": min_max,
    "design_matrix": design_matrix,
    "design_transform": design_transform,
    "sparse_design": sparse_design,
    "labelled_values": labelled_values,
    "dictionary_labels": dictionary_labels,
    "describe": describe,
    "correlation_matrix": correlation_matrix,
    "unique_counts": unique_counts,
    "value_frequencies": value_frequencies,
    "class_balance": class_balance,
    "threshold_labels": threshold_labels,
    "binary_metrics": binary_metrics,
    "roc_auc": roc_auc,
    "weighted_bce": weighted_bce,
    "variant_report": variant_report,
    "lr_fit_score": _fit_score("logistic_regression"),
    "gbt_fit_score": _fit_score("boosted_trees"),
    "mlp_fit_score": _fit_score("neural_network"),
    "lr_fit_profile": _fit_profile("logistic_regression"),
    "gbt_fit_profile": _fit_profile("boosted_trees", {"trees": 20}),
    "mlp_fit_profile": _fit_profile("neural_network", {"epochs": 20}),
}
