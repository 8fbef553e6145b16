"""The same queries in SQL for DuckDB, written from the definitions, not from the Spark plans."""

from __future__ import annotations

from itertools import combinations

from checks.fixture import LABELS, SURVEY_COLUMNS, SURVEY_SQL
from checks.queries import COPULA_COLUMNS, DESIGN_LABELS, RECODES, SCORES, WANTED
from surveyloom import census


def fixed(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _name(value: str) -> str:
    return '"' + value.replace('"', '""') + '"'


STATE_DIM = "SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{f}')" for u, f in census.STATES.items()) + ") t(usps, fips)"
FACTOR = "(CAST(ADJINC AS DOUBLE) / 1e6)"
CAST = f"""
SELECT SERIALNO, CAST(SPORDER AS BIGINT) AS SPORDER, PUMA, CAST(ADJINC AS DOUBLE) AS ADJINC,
  CAST(PWGTP AS DOUBLE) AS PWGTP, ST, CAST(AGEP AS BIGINT) AS AGEP, SEX, RAC1P, SCHL, INDP, OCCP,
  TRY_CAST(WKHP AS BIGINT) AS WKHP, PINCP * {FACTOR} AS PINCP, WAGP * {FACTOR} AS WAGP, DIS
FROM sp"""


def _filled(source: str) -> str:
    text = ["SERIALNO", "PUMA", "ST", "SEX", "RAC1P", "SCHL", "INDP", "OCCP", "DIS"]
    longs = ["SPORDER", "AGEP", "WKHP"]
    doubles = ["ADJINC", "PWGTP", "PINCP", "WAGP"]
    parts = [f"coalesce({c}, 'NA') AS {c}" for c in text]
    parts += [f"coalesce({c}, CAST(round((SELECT avg({c}) FROM {source})) AS BIGINT)) AS {c}" for c in longs]
    parts += [f"coalesce({c}, (SELECT avg({c}) FROM {source})) AS {c}" for c in doubles]
    return f"SELECT {', '.join(parts)} FROM {source}"


def _with(sql: str, **extra: str) -> str:
    """Put the shared CTEs in front; unused ones cost nothing."""
    ctes = {
        "sp": SURVEY_SQL,
        "casted": CAST,
        "feat": _filled("casted"),
        "dim": STATE_DIM,
        "pop": "SELECT ST, CAST(sum(CAST(trunc(PWGTP) AS BIGINT)) AS BIGINT) AS state_population FROM feat GROUP BY ST",
        "training": "SELECT * FROM feat WHERE ST IN (SELECT fips FROM dim)",
        "scored": "SELECT sp.ST, CASE WHEN DIS = '1' THEN 1 ELSE 0 END AS label, SCORE_A, SCORE_B, state_population "
        "FROM sp JOIN pop ON sp.ST = pop.ST",
        **extra,
    }
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in ctes.items()) + " " + sql


def _long(source: str, columns: list[str], label: bool = False) -> str:
    return " UNION ALL ".join(
        f"SELECT {_text(census.COLUMN_LABELS.get(c, c) if label else c)} AS feature, CAST({c} AS VARCHAR) AS value "
        f"FROM {source}"
        for c in columns
    )


# sources and sinks

CUSTOMER = "SELECT c_custkey AS id, c_name AS name, {n}c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer"
SUPPLIER = "SELECT s_suppkey AS id, s_name AS name, {n}CAST(NULL AS VARCHAR) AS segment, s_acctbal AS balance FROM supplier"


def _codes() -> str:
    nation = "lpad(CAST({} AS VARCHAR), 2, '0') AS nation, "
    return CUSTOMER.format(n=nation.format("c_nationkey")) + " UNION ALL " + SUPPLIER.format(n=nation.format("s_nationkey"))


def _recode() -> str:
    cases = [
        f"CASE {c} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in codes.items()) + f" ELSE {c} END AS {c}"
        for c, codes in RECODES.items()
    ]
    return _with(f"SELECT SERIALNO, {', '.join(cases)}, SCHL FROM sp")


def _features_out(source: str) -> str:
    doubles = ("ADJINC", "PWGTP", "PINCP", "WAGP")
    plain = ["SERIALNO", "SPORDER", "PUMA", "ST", "AGEP", "SEX", "RAC1P", "SCHL", "INDP", "OCCP", "WKHP", "DIS"]
    return f"SELECT {', '.join(plain)}, {', '.join(f'{fixed(c)} AS {c}' for c in doubles)} FROM {source}"


def _synth_fill() -> str:
    numeric = ["AGEP", "WKHP", "PINCP", "WAGP"]
    means = ", ".join(f"avg({c}) AS m_{c}" for c in numeric)
    out = ", ".join(fixed(f"coalesce(CAST(c.{c} AS DOUBLE), m_{c})") + f" AS {c}" for c in numeric)
    return _with(
        f"SELECT c.ST, coalesce(c.SCHL, 'NA') AS SCHL, {out} FROM casted c LEFT JOIN means m ON c.ST = m.ST",
        means=f"SELECT ST, {means} FROM feat GROUP BY ST",
    )


# copula


def _intervals(columns: list[str]) -> str:
    counts = " UNION ALL ".join(
        f"SELECT ST, '{c}' AS feature, {c} AS value, count(*) AS n FROM training GROUP BY ST, {c}" for c in columns
    )
    return f"""
    SELECT ST, feature, value, n,
      CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(n) OVER (PARTITION BY ST, feature) AS DOUBLE) AS lo,
      CAST(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
        / CAST(sum(n) OVER (PARTITION BY ST, feature) AS DOUBLE) AS hi
    FROM ({counts}) WINDOW w AS (PARTITION BY ST, feature ORDER BY n DESC, value)"""


def _digits(x: str) -> str:
    tests = " ".join(f"WHEN round_even({x} * 1e{d}, 0) / 1e{d} = {x} THEN {d}" for d in range(10))
    return f"CASE {tests} ELSE 10 END"


def _marginals() -> str:
    parts = []
    for c in ("AGEP", "WKHP", "WAGP", "PINCP"):
        digits = "0" if c in ("AGEP", "WKHP") else _digits(c)
        parts.append(
            f"SELECT ST, '{c}' AS feature, count({c}) AS n, {fixed(f'avg({c})')} AS mean, "
            f"{fixed(f'stddev_pop({c})')} AS sd, {fixed(f'CAST(min({c}) AS DOUBLE)')} AS low, "
            f"{fixed(f'CAST(max({c}) AS DOUBLE)')} AS high, CAST(max({digits}) AS BIGINT) AS digits "
            "FROM training GROUP BY ST"
        )
    return _with(" UNION ALL ".join(parts))


def _correlation() -> str:
    """Correlation with the uniform draw inside the intervals: covariance of midpoints, variance plus width²/12."""
    categorical = [c for c in COPULA_COLUMNS if c in ("SEX", "RAC1P", "SCHL", "DIS", "OCCP", "INDP")]
    joins = " ".join(
        f"JOIN intervals i{c} ON i{c}.ST = t.ST AND i{c}.feature = '{c}' AND i{c}.value = t.{c}" for c in categorical
    )
    xs = ", ".join(
        f"(i{c}.lo + i{c}.hi) / 2 AS x_{c}, (i{c}.hi - i{c}.lo) ** 2 / 12 AS v_{c}"
        if c in categorical
        else f"CAST(t.{c} AS DOUBLE) AS x_{c}, 0e0 AS v_{c}"
        for c in COPULA_COLUMNS
    )
    pairs = " UNION ALL ".join(
        f"SELECT ST, '{a}' AS x, '{b}' AS y, {fixed(f'coalesce(covar_pop(x_{a}, x_{b}) / nullif(sqrt((var_pop(x_{a}) + avg(v_{a})) * (var_pop(x_{b}) + avg(v_{b}))), 0), 0)')} AS r "
        "FROM encoded GROUP BY ST"
        for a, b in combinations(COPULA_COLUMNS, 2)
    )
    return _with(pairs, intervals=_intervals(categorical), encoded=f"SELECT t.ST, {xs} FROM training t {joins}")


# design matrix


def _scaled(column: str, bounds: str) -> str:
    span = f"(({column} - {bounds}.low_{column}) / CAST({bounds}.high_{column} - {bounds}.low_{column} AS DOUBLE))"
    return fixed(f"CAST(CAST({span} AS FLOAT) AS DOUBLE)", 5)


def _bounds(columns: list[str], source: str) -> str:
    ends = ", ".join(f"min({c}) AS low_{c}, max({c}) AS high_{c}" for c in columns)
    return f"SELECT {ends} FROM {source}"


def _indicators(codes: dict[str, dict[str, str]], labelled: bool = True) -> list[str]:
    return [
        f"CAST({c} = {_text(code)} AS TINYINT) AS {_name((census.COLUMN_LABELS[c] if labelled else c) + '_' + text)}"
        for c, values in codes.items()
        for code, text in values.items()
    ]


INDUSTRIES = {f"{170 + 10 * k:04d}": f"{170 + 10 * k:04d}" for k in range(40)}


def _design_matrix() -> str:
    numeric = ["AGEP", "WKHP", "WAGP", "PINCP"]
    out = [f"state_population AS {_name(census.WEIGHT)}"]
    out += [f"{_scaled(c, 'b')} AS {_name(census.COLUMN_LABELS[c])}" for c in numeric]
    out += _indicators({c: DESIGN_LABELS[c] for c in ("SEX", "RAC1P", "SCHL", "DIS", "ST")})
    out += _indicators({"INDP": INDUSTRIES})
    return _with(
        f"SELECT {', '.join(out)} FROM joined, b",
        joined="SELECT feat.*, state_population FROM feat JOIN pop USING (ST)",
        b=_bounds(numeric, "feat"),
    )


def _design_transform() -> str:
    out = [f"{_scaled(c, 'b')} AS {c}" for c in ("AGEP", "WAGP")]
    out += _indicators({"SEX": LABELS["SEX"], "INDP": INDUSTRIES}, labelled=False)
    return _with(
        f"SELECT {', '.join(out)} FROM feat, b WHERE SEX = '2'",
        b=_bounds(["AGEP", "WAGP"], "feat WHERE SEX = '1'"),
    )


def _sparse_design() -> str:
    def number(c: str, position: int) -> str:
        span = f"CAST(CAST((({c} - low_{c}) / CAST(high_{c} - low_{c} AS DOUBLE)) AS FLOAT) AS DOUBLE)"
        return f"SELECT {position} AS position, '{c}' AS name, {span} AS x FROM feat, b WHERE {span} <> 0"

    texts = ["INDP", "OCCP", "SERIALNO"]
    found = " UNION ALL ".join(f"SELECT {i} AS place, '{t}' AS feature, {t} AS v FROM feat" for i, t in enumerate(texts))
    cells = [number("AGEP", 0), number("WAGP", 1)]
    cells += [f"SELECT {2 + i}, 'SEX_{text}', 1e0 FROM feat WHERE SEX = '{code}'" for i, (code, text) in enumerate(LABELS["SEX"].items())]
    cells.append("SELECT position, feature || '_' || v, 1e0 FROM found JOIN vocabulary USING (place, feature, v)")
    return _with(
        f"SELECT CAST(position AS BIGINT) AS position, name, count(*) AS n_rows, {fixed('sum(x)', 3)} AS total FROM cells GROUP BY ALL",
        b=_bounds(["AGEP", "WAGP"], "feat"),
        found=found,
        vocabulary="SELECT place, feature, v, 3 + row_number() OVER (ORDER BY place, v) AS position FROM (SELECT DISTINCT * FROM found)",
        cells=" UNION ALL ".join(cells),
    )


def _labelled_values() -> str:
    pairs = ", ".join(f"('{c}', '{k}', {_text(v)})" for c, codes in LABELS.items() for k, v in codes.items())
    return _with(
        "SELECT long.feature, long.value, t.label, count(*) AS n FROM long LEFT JOIN t "
        "ON long.feature = t.col AND long.value = t.code GROUP BY ALL",
        long=_long("sp", list(LABELS)),
        t=f"SELECT * FROM (VALUES {pairs}) v(col, code, label)",
    )


# profile

NUMERIC = ["SPORDER", "ADJINC", "PWGTP", "AGEP", "WKHP", "PINCP", "WAGP"]


def _describe() -> str:
    parts = []
    for c in NUMERIC:
        quantiles = ", ".join(
            f"(SELECT {fixed('v', 4)} FROM (SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, "
            f"count(*) OVER () AS n FROM casted WHERE {c} IS NOT NULL) WHERE i = CAST(round((n - 1) * {q}) AS BIGINT)) AS {name}"
            for name, q in (("q25", "0.25e0"), ("q50", "0.5e0"), ("q75", "0.75e0"))
        )
        parts.append(
            f"SELECT '{c}' AS feature, count({c}) AS count, count(*) - count({c}) AS null_count, "
            f"{fixed(f'avg({c})', 4)} AS mean, {fixed(f'stddev_samp({c})', 4)} AS std, "
            f"{fixed(f'CAST(min({c}) AS DOUBLE)', 4)} AS min, {quantiles}, {fixed(f'CAST(max({c}) AS DOUBLE)', 4)} AS max FROM casted"
        )
    return _with(" UNION ALL ".join(parts))


def _correlation_matrix() -> str:
    return _with(" UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {fixed(f'corr({a}, {b})')} AS r FROM casted" for a in NUMERIC for b in NUMERIC
    ))


TEXT = ["SERIALNO", "PUMA", "ST", "SEX", "RAC1P", "SCHL", "INDP", "OCCP", "WKHP", "DIS"]


def _unique_counts() -> str:
    return _with(" UNION ALL ".join(
        f"SELECT {_text(census.COLUMN_LABELS.get(c, c))} AS feature, "
        f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n_unique FROM sp"
        for c in TEXT
    ))


def _value_frequencies() -> str:
    return _with(
        "SELECT feature, value, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM sp) AS proportion "
        "FROM long GROUP BY feature, value",
        long=_long("sp", TEXT, label=True),
    )


# metrics


def _cells(threshold: float) -> str:
    """(variant, weighting, tp, fp, fn, tn)"""
    parts = []
    for v, p in SCORES.items():
        for kind, w in (("unweighted", "1e0"), ("weighted", "CAST(state_population AS DOUBLE)")):
            sums = ", ".join(
                f"coalesce(sum({w}) FILTER (WHERE label = {y} AND ({p} >= {threshold}) = {hit}), 0) AS {name}"
                for name, y, hit in (("tp", 1, "true"), ("fp", 0, "true"), ("fn", 1, "false"), ("tn", 0, "false"))
            )
            parts.append(f"SELECT '{v}' AS variant, '{kind}' AS weighting, {sums} FROM scored")
    return " UNION ALL ".join(parts)


def _metric_rows() -> str:
    formulas = {
        "accuracy": ("tp + tn", "tp + fp + fn + tn"),
        "precision": ("tp", "tp + fp"),
        "recall": ("tp", "tp + fn"),
        "f1": ("2 * tp", "2 * tp + fp + fn"),
    }
    return " UNION ALL ".join(
        f"SELECT variant, weighting, '{m}' AS metric, CASE WHEN {d} = 0 THEN 0 ELSE ({n}) / ({d}) END AS value FROM cells"
        for m, (n, d) in formulas.items()
    )


def _auc_rows() -> str:
    parts = []
    for v, p in SCORES.items():
        for kind, w in (("unweighted", "1e0"), ("weighted", "CAST(state_population AS DOUBLE)")):
            sums = (
                f"SELECT {p} AS p, coalesce(sum({w}) FILTER (WHERE label = 1), 0) AS pos, "
                f"coalesce(sum({w}) FILTER (WHERE label = 0), 0) AS neg FROM scored GROUP BY {p}"
            )
            below = "coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
            parts.append(
                f"SELECT '{v}' AS variant, '{kind}' AS weighting, 'roc_auc' AS metric, "
                f"sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS value "
                f"FROM (SELECT *, {below} AS below FROM ({sums}))"
            )
    return " UNION ALL ".join(parts)


def _fixed_values(rows: str) -> str:
    return f"SELECT variant, weighting, metric, {fixed('value')} AS value FROM ({rows})"


def _report() -> str:
    return _with(
        f"SELECT 'test_' || a.weighting || '_' || a.metric AS metric, {fixed('a.value')} AS standard, "
        f"{fixed('b.value')} AS survey_weighted, {fixed('b.value - a.value')} AS difference "
        "FROM found a JOIN found b ON a.variant = 'standard' AND b.variant = 'survey_weighted' "
        "AND a.weighting = b.weighting AND a.metric = b.metric",
        cells=_cells(0.5),
        found=f"{_metric_rows()} UNION ALL {_auc_rows()}",
    )


def _bce() -> str:
    parts = []
    for v, p in SCORES.items():
        x = f"(({p} - 0.5e0) * 4e0)"
        probability = f"(1 / (1 + exp(-{x})))"
        loss = f"-(label * ln({probability}) + (1 - label) * ln(1 - {probability}))"
        parts.append(
            f"SELECT '{v}' AS variant, {fixed(f'sum({loss} * state_population) / sum(state_population)')} AS loss, "
            f"{fixed(f'avg({probability})')} AS mean_probability FROM scored"
        )
    return _with(" UNION ALL ".join(parts))


def _class_balance() -> str:
    return _with(
        " UNION ALL ".join(
            f"SELECT CAST({k} AS BIGINT) AS label, n{k} AS n_rows, {fixed(f'(n0 + n1) / CAST(2 * n{k} AS DOUBLE)')} AS balanced_weight, "
            f"{fixed('CAST(n0 AS DOUBLE) / greatest(n1, 1)')} AS scale_pos_weight FROM c"
            for k in (0, 1)
        ),
        c="SELECT count(*) FILTER (WHERE DIS <> '1') AS n0, count(*) FILTER (WHERE DIS = '1') AS n1 FROM sp",
    )


REQUESTED = ", ".join(f"'{census.STATES[s]}'" for s in WANTED)
CANONICAL = """'{"horizon": "5-Year", "states": ["' || string_agg(n_name, '", "' ORDER BY n_name) || '"], "year": 2023}'"""
RENAMED = ", ".join(
    f"{c} AS {_name(census.COLUMN_LABELS.get(c, c))}"
    for c in ("SERIALNO", "PUMA", "ST", "SEX", "RAC1P", "SCHL", "INDP", "OCCP", "WKHP", "DIS")
)
N_COLUMNS = len(SURVEY_COLUMNS)

FIT_PROFILE = _with(
    f"SELECT variant, CAST(n0 + n1 AS BIGINT) AS n_rows, CAST(n0 + n1 AS BIGINT) AS n_inside, "
    f"{fixed('-(share * ln(share) + (1 - share) * ln(1 - share))')} AS base_loss, true AS beats_base, true AS flat FROM shares",
    classes="SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, "
    "CAST(sum(state_population) FILTER (label = 0) AS DOUBLE) AS w0, CAST(sum(state_population) FILTER (label = 1) AS DOUBLE) AS w1 FROM scored",
    shares="SELECT 'standard' AS variant, n0, n1, 0.5e0 AS share FROM classes UNION ALL "
    "SELECT 'survey_weighted', n0, n1, (w1 / n1) / (w0 / n0 + w1 / n1) FROM classes",
)

ORACLES = {
    "group_population": _with("SELECT ST, state_population FROM pop"),
    "csv_union_by_name": _codes(),
    "union_by_name": CUSTOMER.format(n="") + " UNION ALL " + SUPPLIER.format(n=""),
    "parquet_round_trip": _with("SELECT ST, WAGP FROM sp, (VALUES (1), (2), (3)) copies(k)"),
    "partition_round_trip": _with("SELECT ST, count(*) AS n_rows FROM training GROUP BY ST"),
    "partition_pruned": _with(f"SELECT ST, AGEP, SEX, {fixed('WAGP')} AS WAGP FROM training WHERE ST = '06'"),
    "population_json": _with("SELECT ST, state_population FROM pop"),
    "run_metadata": f"""
        SELECT step, (SELECT count(*) FROM lineitem) AS "rows", CAST(cols AS INTEGER) AS cols, source
        FROM (VALUES ('extract_cache', {N_COLUMNS}, ''), ('extract', {N_COLUMNS}, 'built'),
                     ('extract', {N_COLUMNS}, 'cache'), ('features', 16, '')) t(step, cols, source)""",
    "cache_key": f"SELECT n_regionkey, substr(sha256({CANONICAL}), 1, 16) AS cache_key FROM nation GROUP BY n_regionkey",
    "latest_model": """
        SELECT o_orderpriority AS name, o_orderkey AS uri FROM (
          SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS i
          FROM orders) WHERE i = 1""",
    "exclude_rename": _with("SELECT * EXCLUDE (ST), ST AS STATE FROM sp"),
    "schema_profile": _with(f"SELECT count(*) AS n_rows, CAST({N_COLUMNS} AS BIGINT) AS n_cols FROM sp"),
    "select_columns": _with("SELECT * EXCLUDE (SCORE_A, SCORE_B) FROM sp"),
    "drop_columns": _with("SELECT * EXCLUDE (OCCP, SCORE_A, SCORE_B) FROM sp"),
    "relabel": _with(f"SELECT {RENAMED} FROM sp"),
    "recode": _recode(),
    "income_adjust": _with(
        f"SELECT SERIALNO, ADJINC, {fixed(f'PINCP * {FACTOR}')} AS PINCP, {fixed(f'WAGP * {FACTOR}')} AS WAGP FROM sp"
    ),
    "lenient_cast": _with("SELECT SERIALNO, SPORDER, ADJINC, PWGTP, AGEP, WKHP FROM casted"),
    "impute": _with(
        _features_out("plain_filled"),
        plain="SELECT casted.* EXCLUDE (PINCP, WAGP) FROM casted",
        unadjusted=CAST.replace(f" * {FACTOR}", ""),
        plain_filled=_filled("unadjusted"),
    ),
    "features": _with(_features_out("feat")),
    "synth_fill": _synth_fill(),
    "supported_groups": _with("SELECT DISTINCT ST FROM sp WHERE ST IN (SELECT fips FROM dim) ORDER BY ST"),
    "requested_groups": _with(f"SELECT DISTINCT ST FROM sp WHERE ST IN ({REQUESTED}) ORDER BY ST"),
    "state_lookup": _with("SELECT ST, usps, count(*) AS n_rows FROM sp LEFT JOIN dim ON ST = fips GROUP BY ST, usps"),
    "training_rows_per_group": _with("SELECT ST, count(*) AS n_rows FROM training GROUP BY ST"),
    "sample_size": _with("SELECT ST, state_population, state_population // 10 AS n FROM pop"),
    "group_value": _with("SELECT ST, CAST(label AS TINYINT) AS label, state_population FROM scored"),
    "group_seed": _with(
        "SELECT DISTINCT ST, CAST('0x' || substr(sha256('42|' || ST), 1, 15) AS BIGINT) AS seed FROM sp"
    ),
    "group_means": _with(
        "SELECT ST, " + ", ".join(f"{fixed(f'avg({c})')} AS {c}" for c in ("AGEP", "WKHP", "WAGP", "PINCP"))
        + " FROM training GROUP BY ST"
    ),
    "copula_marginals": _marginals(),
    "category_intervals": _with(
        "SELECT * FROM intervals", intervals=_intervals(["SEX", "RAC1P", "SCHL", "DIS", "INDP", "OCCP"])
    ),
    "copula_correlation": _correlation(),
    "copula_sample_profile": _with(
        "SELECT ST, state_population, state_population // 10 AS n_rows, state_population // 10 AS n_inside FROM pop "
        "WHERE ST IN (SELECT fips FROM dim) AND state_population >= 10"
    ),
    "one_hot_labels": _with(f"SELECT {', '.join(_indicators(LABELS))} FROM sp"),
    "one_hot_vocab": _with(f"SELECT {', '.join(_indicators({'INDP': INDUSTRIES}))} FROM sp"),
    "observed_values": _with(
        "SELECT DISTINCT feature, value FROM long WHERE value IS NOT NULL", long=_long("sp", ["SCHL", "INDP", "OCCP", "WKHP"])
    ),
    "min_max": _with(
        "SELECT " + ", ".join(f"{_scaled(c, 'b')} AS {c}" for c in ("AGEP", "WKHP", "PINCP", "WAGP")) + " FROM feat, b",
        b=_bounds(["AGEP", "WKHP", "PINCP", "WAGP"], "feat"),
    ),
    "design_matrix": _design_matrix(),
    "design_transform": _design_transform(),
    "labelled_values": _labelled_values(),
    "describe": _describe(),
    "correlation_matrix": _correlation_matrix(),
    "unique_counts": _unique_counts(),
    "value_frequencies": _value_frequencies(),
    "class_balance": _class_balance(),
    "threshold_labels": _with(
        "SELECT ST, CAST(label AS TINYINT) AS label, "
        + ", ".join(f"CAST({p} >= 0.45 AS TINYINT) AS predicted_disability_{v}" for v, p in SCORES.items())
        + " FROM scored"
    ),
    "binary_metrics": _with(_fixed_values(_metric_rows()), cells=_cells(0.45)),
    "roc_auc": _with(_fixed_values(_auc_rows())),
    "weighted_bce": _bce(),
    "variant_report": _report(),
    "sparse_design": _sparse_design(),
    "dictionary_labels": _with(
        """SELECT feature, value, CASE WHEN feature <> 'AGEP' THEN feature || ', "code" ' || value WHEN value IS NULL THEN 'not known'
        ELSE CAST(CAST(value AS INTEGER) // 10 * 10 AS VARCHAR) || ' and on' END AS label, count(*) AS n FROM long GROUP BY ALL""",
        long=_long("sp", ["SEX", "RAC1P", "AGEP"]),
    ),
    "lr_fit_profile": FIT_PROFILE,
    "gbt_fit_profile": FIT_PROFILE,
    "mlp_fit_profile": FIT_PROFILE,
}
