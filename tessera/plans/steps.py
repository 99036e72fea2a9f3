"""Queries of column steps that follow modalities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as pr
from tessera.operators import steps as st
from tessera.sources.tables import table

S = st.Schema((("o_orderstatus", st.CATEGORICAL), ("o_totalprice", st.NUMERICAL), ("o_orderpriority", st.CATEGORICAL), ("o_custkey", st.CATEGORICAL)))
L = st.Schema((("l_quantity", st.NUMERICAL), ("l_discount", st.NUMERICAL), ("l_returnflag", st.CATEGORICAL)))


def _o(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *S.names)


def _l(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *L.names)


def clean_table(spark, sf_dir):
    return st.clean(_o(spark, sf_dir), S, ["P"])


def numeric_encoded(spark, sf_dir):
    df = _o(spark, sf_dir).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    out = st.numeric_encoded(df, st.Schema((*S.features[:3], ("o_custkey", st.TEXT))), ["o_orderkey"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


def _summary(df, columns):
    """Sums of values and of their products with the line's number, so that places matter."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(e for i, c in enumerate(columns) for e in (F.round(F.sum(c), 3).alias(f"s{i}"), F.round(F.sum(F.col(c) * F.col("l_linenumber")), 3).alias(f"w{i}"))))


def reshape_log1p(spark, sf_dir):
    df, schema, _ = st.reshaped(_l(spark, sf_dir), L, "1_plus_log")
    return _summary(df, schema.of(st.NUMERICAL))


def reshape_exp_appended(spark, sf_dir):
    df, schema, ancestors = st.reshaped(_l(spark, sf_dir).withColumn("l_quantity", F.col("l_quantity") / 50), L, "exp", append=True)
    assert [ancestors[c] for c in schema.names[3:]] == ["l_quantity", "l_discount"]
    return _summary(df, schema.of(st.NUMERICAL))


def _reshaped(preset):
    def query(spark, sf_dir):
        df, schema, _ = st.reshaped(_l(spark, sf_dir), st.Schema(L.features[:1]), preset)
        return _summary(df, schema.names)

    return query


reshape_quantile = _reshaped("quantile_uni_coarse")
reshape_quantile_plain = _reshaped("quantile_uni")
reshape_quantile_fine = _reshaped("quantile_uni_fine")


def reshape_quantile_beyond(spark, sf_dir):
    """Fitted on quantities of 10 to 40, applied to all."""
    df = _l(spark, sf_dir)
    f = st.PRESETS["quantile_uni_extrapolate"](df.where("l_quantity between 10 and 40"), ["l_quantity"])
    return _summary(f.transform(df), ["l_quantity"])


def clean_modalities(spark, sf_dir):
    """Dates, moments, booleans and dates as categories of events, by its sums."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), "ts", (F.col("value") > 50).alias("high"), F.to_date("ts").alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("said"))
    out = st.clean(e, st.Schema((("day", st.DATE), ("ts", st.DATE), ("high", st.CATEGORICAL), ("kind", st.CATEGORICAL), ("said", st.DATE))))
    return out.select("event_id", "day", F.round("ts", 3).alias("ts"), "high", "kind", "said")


def reshape_adaptive(spark, sf_dir):
    df, schema, _ = st.reshaped(_l(spark, sf_dir), L, "adaptive")
    return _summary(df, schema.of(st.NUMERICAL))


def reshape_kernel_integral(spark, sf_dir):
    df, schema, _ = st.reshaped(_l(spark, sf_dir), L, "norm_and_kdi")
    return _summary(df, schema.of(st.NUMERICAL))


def modal_pipeline(spark, sf_dir):
    """Means for missing numbers, then deviations of the standard."""
    from tessera.operators import transforms as t

    p = st.ModalPipeline([("impute", (st.NUMERICAL,), lambda d, c: t.imputed(d, c, "mean")), ("scale", (st.NUMERICAL,), t.standard)])
    df = _l(spark, sf_dir).withColumn("l_discount", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")))
    p.fit_transform(df, L)
    return _summary(p.transform(df).withColumns({c: F.abs(c) for c in L.names[:2]}), L.names[:2])


def schema_algebra(spark, sf_dir):
    """Two columns appended, one of them under a name in use, one removed, and one merged back; each with its distinct values over the table."""
    s = L.append(st.NUMERICAL, ["svd_0", "l_discount"]).remove([0]).merged([1], st.Schema((("l_returnflag", st.NUMERICAL),)))
    lines = _l(spark, sf_dir).withColumns({"svd_0": F.col("l_quantity") + F.col("l_linenumber"), s.names[3]: 1 - F.col("l_discount"), "l_returnflag": F.ascii("l_returnflag")})
    counted = lines.agg(*(F.count_distinct(n).alias(n) for n in s.names))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.lit(m).alias("modality"), F.col(n).alias("n")) for i, (n, m) in enumerate(s.features)))).alias("x")
    return counted.select(rows).select("x.*")


def rows_without_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("b"))
    both = st.without_nulls(df, ["a", "b"]).agg(F.count(F.lit(1)).alias("any"))
    return both.join(st.without_nulls(df, ["a", "b"], "all").agg(F.count(F.lit(1)).alias("all")))  # a row each


def legacy_categories(spark, sf_dir):
    p = pr.profile(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_returnflag", "l_quantity", "l_linestatus", "l_tax"])
    return st.legacy_categories(p, ["l_linenumber", "l_quantity"], max_category=10, min_numeric=4)


def integer_categories(spark, sf_dir):
    p = pr.profile(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_quantity", "l_tax", "l_discount"])
    return st.integer_categories(p)


def padded_features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("v"))
    return e.select("vec_id", *(F.round(F.get(st.padded("v", 5, True), F.lit(i)), 6).alias(f"x{i}") for i in range(5)))


def nearest_point(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("v"))
    return e.select("vec_id", st.nearest_point(F.col("v"), [[0.0, 0.0], [0.1, 0.1], [-0.1, 0.2]]).alias("point"))


QUERIES = {"reshape_quantile": reshape_quantile, "reshape_quantile_plain": reshape_quantile_plain, "reshape_quantile_fine": reshape_quantile_fine} | {f.__name__: f for f in (clean_table, clean_modalities, numeric_encoded, reshape_log1p, reshape_exp_appended, reshape_quantile_beyond, reshape_adaptive, reshape_kernel_integral, modal_pipeline, schema_algebra, rows_without_nulls, legacy_categories, integer_categories, padded_features, nearest_point)}


def _sums(columns):
    return "count(*) AS n, " + ", ".join(f"round(sum({c}), 3) AS s{i}, round(sum(({c}) * l_linenumber), 3) AS w{i}" for i, c in enumerate(columns))


def _code(c, further=""):
    return f"(SELECT {c} AS v, (row_number() OVER (ORDER BY {c}) - 1)::DOUBLE AS k FROM (SELECT DISTINCT {c} FROM orders WHERE {c} IS NOT NULL{further}))"


_NOT_P = " AND o_orderstatus <> 'P'"
_CODED = f"LEFT JOIN {_code('o_orderpriority')} p ON o_orderpriority = p.v"
_P = "(embedding[1]::DOUBLE - {a}) * (embedding[1]::DOUBLE - {a}) + (embedding[2]::DOUBLE - {b}) * (embedding[2]::DOUBLE - {b})"
_D = [_P.format(a=a, b=b) for a, b in (("0", "0"), ("0.1", "0.1"), ("(-0.1)", "0.2"))]
_STANDARD = "(SELECT *, (l_quantity - avg(l_quantity) OVER ()) / (stddev_pop(l_quantity) OVER () + 1e-6) AS q, (d - avg(d) OVER ()) / (stddev_pop(d) OVER () + 1e-6) AS z FROM (SELECT l_linenumber, l_quantity, coalesce(CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END, avg(CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END) OVER ()) AS d FROM lineitem))"


def _empirical(per, where="true", beyond=None):
    """Shares below by quantiles as rows (i, v), for each distinct quantity, then joined back; equal quantiles share the middle of theirs."""
    below, above = (f"greatest(-{beyond}, (x - least_v) / (most_v - least_v))", f"least(1 + {beyond}, (x - least_v) / (most_v - least_v))") if beyond else ("0.0", "1.0")
    return f"""
WITH fitted AS (
  SELECT list_sort(list(l_quantity)) AS s, count(*) AS n, greatest(1, least(greatest(count(*) // {per}, {2 if per > 1 else 1}), count(*), 20000)) AS k FROM lineitem WHERE {where}
), numbers AS (
  SELECT unnest(range(k)) AS i, s, n, k FROM fitted
), levels AS (
  SELECT i, k, s[i * (n - 1) // (k - 1) + 1] + (i * (n - 1) % (k - 1)) / (k - 1.0) * (s[least(n, i * (n - 1) // (k - 1) + 2)] - s[i * (n - 1) // (k - 1) + 1]) AS v FROM numbers
), found AS (
  SELECT x, any_value(k) AS k, count(*) FILTER (v < x) AS lo, count(*) FILTER (v <= x) AS le, max(v) FILTER (v < x) AS left_v, min(v) FILTER (v > x) AS right_v, min(v) AS least_v, max(v) AS most_v
  FROM (SELECT DISTINCT l_quantity AS x FROM lineitem), levels GROUP BY x
), shares AS (
  SELECT x, CASE WHEN x < least_v THEN {below} WHEN x > most_v THEN {above} WHEN x = least_v THEN 0.0 WHEN x = most_v THEN 1.0 WHEN le > lo THEN (lo + le - 1) / (2.0 * (k - 1)) ELSE (lo - 1 + (x - left_v) / (right_v - left_v)) / (k - 1.0) END AS u FROM found
)
SELECT count(*) AS n, round(sum(u), 3) AS s0, round(sum(u * l_linenumber), 3) AS w0 FROM lineitem JOIN shares ON x = l_quantity
"""


ORACLES = {
    "clean_table": "SELECT o_orderkey, s.k AS o_orderstatus, o_totalprice, p.k AS o_orderpriority, c.k AS o_custkey FROM orders "
    + f"LEFT JOIN {_code('o_orderstatus', _NOT_P)} s ON o_orderstatus = s.v {_CODED} LEFT JOIN {_code('o_custkey')} c ON o_custkey = c.v",
    "numeric_encoded": f"SELECT o_orderkey, coalesce(s.k, -1) AS o_orderstatus, round(coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END, (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 7 <> 0)), 4) AS o_totalprice, coalesce(p.k, -1) AS o_orderpriority FROM orders LEFT JOIN {_code('o_orderstatus')} s ON o_orderstatus = s.v {_CODED}",
    "reshape_log1p": f"SELECT {_sums(['ln(1 + l_quantity)', 'ln(1 + l_discount)'])} FROM lineitem",
    "reshape_exp_appended": f"SELECT {_sums(['l_quantity / 50', 'l_discount', 'exp(l_quantity / 50)', 'exp(l_discount)'])} FROM lineitem",
    "reshape_quantile": _empirical(10),
    "reshape_quantile_plain": _empirical(5),
    "reshape_quantile_fine": _empirical(1),
    "reshape_quantile_beyond": _empirical(5, "l_quantity BETWEEN 10 AND 40", 1.0),
    "clean_modalities": "SELECT event_id, epoch(ts::DATE)::DOUBLE AS day, round(epoch(ts)::DOUBLE, 3) AS ts, CASE WHEN value > 50 THEN 1.0 WHEN value <= 50 THEN 0.0 END AS high, (dense_rank() OVER (ORDER BY ts::DATE) - 1)::DOUBLE AS kind, epoch(date_trunc('second', ts))::DOUBLE AS said FROM events",
    "modal_pipeline": f"SELECT {_sums(['abs(q)', 'abs(z)'])} FROM {_STANDARD}",
    "schema_algebra": "SELECT unnest([0, 1, 2, 3])::INT AS place, unnest(['l_discount', 'l_returnflag', 'svd_0', 'l_discount_1']) AS name, unnest(['numerical', 'numerical', 'numerical', 'numerical']) AS modality, unnest([count(DISTINCT l_discount), count(DISTINCT l_returnflag), count(DISTINCT l_quantity + l_linenumber), count(DISTINCT l_discount)]) AS n FROM lineitem",
    "rows_without_nulls": 'SELECT count(*) FILTER (event_id % 3 <> 0 AND event_id % 4 <> 0 AND value IS NOT NULL AND user_id IS NOT NULL) AS "any", count(*) FILTER ((event_id % 3 <> 0 AND value IS NOT NULL) OR (event_id % 4 <> 0 AND user_id IS NOT NULL)) AS "all" FROM events',
    "legacy_categories": 'SELECT unnest(list_filter([CASE WHEN count(DISTINCT l_linenumber) <= 10 THEN \'l_linenumber\' END, CASE WHEN count(*) > 100 AND count(DISTINCT l_returnflag) < 4 THEN \'l_returnflag\' END, CASE WHEN count(DISTINCT l_quantity) <= 10 THEN \'l_quantity\' END, CASE WHEN count(*) > 100 AND count(DISTINCT l_linestatus) < 4 THEN \'l_linestatus\' END, CASE WHEN count(*) > 100 AND count(DISTINCT l_tax) < 4 THEN \'l_tax\' END], lambda v: v IS NOT NULL)) AS "column" FROM lineitem',
    "integer_categories": 'SELECT unnest(list_filter([CASE WHEN count(DISTINCT l_linenumber) <= 10 THEN \'l_linenumber\' END, CASE WHEN count(DISTINCT l_quantity) <= 10 AND bool_and(l_quantity = floor(l_quantity)) THEN \'l_quantity\' END, CASE WHEN count(DISTINCT l_tax) <= 10 AND bool_and(l_tax = floor(l_tax)) THEN \'l_tax\' END, CASE WHEN count(DISTINCT l_discount) <= 10 AND bool_and(l_discount = floor(l_discount)) THEN \'l_discount\' END], lambda v: v IS NOT NULL)) AS "column" FROM lineitem',
    "padded_features": "SELECT vec_id, " + ", ".join(f"round(embedding[{i}]::DOUBLE / 0.6, 6) AS x{i - 1}" for i in (1, 2, 3)) + ", 0.0 AS x3, 0.0 AS x4 FROM embeddings",
    "nearest_point": f"SELECT vec_id, CASE WHEN {_D[0]} <= {_D[1]} AND {_D[0]} <= {_D[2]} THEN 0 WHEN {_D[1]} <= {_D[2]} THEN 1 ELSE 2 END AS point FROM embeddings",
}
