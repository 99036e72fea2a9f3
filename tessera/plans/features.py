"""Queries of fitted transforms and fingerprints on lineitem, part, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import transforms as t
from tessera.sources.tables import table

C = ["l_quantity", "l_extendedprice", "l_discount"]
K = ["l_orderkey", "l_linenumber"]


def _l(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*K, *C, "l_tax", "l_returnflag")


def _holes(spark, sf_dir):
    """Extended price, null for every fifth order."""
    return _l(spark, sf_dir).withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")))


def _shown(df, digits=6, columns=C):
    return df.select(*K, *(F.round(c, digits).alias(c) for c in columns))


def scale_standard_clip(spark, sf_dir):
    df = _l(spark, sf_dir)
    return _shown(t.standard(df, C, 1.5).transform(df), 5)


def scale_sample_standard(spark, sf_dir):
    df = _holes(spark, sf_dir)
    return _shown(t.sample_standard(df, C).transform(df), 5)


B = {"l_quantity": (1, 50), "l_discount": (0.0, 0.0)}


def scale_minmax_metadata(spark, sf_dir):
    return _shown(t.minmax(B).transform(_l(spark, sf_dir)), 6, list(B))


def scale_minmax_round_trip(spark, sf_dir):
    return _shown(t.minmax_inverse(B).transform(t.minmax(B).transform(_l(spark, sf_dir))), 6, list(B))


def outlier_soft_clip(spark, sf_dir):
    df = _l(spark, sf_dir)
    return _shown(t.soft_clip(df, C, 1.2).transform(df), 4)


def outlier_hard_clip(spark, sf_dir):
    df = _l(spark, sf_dir)
    return _shown(t.hard_clip(df, C, 1.2).transform(df), 4)


def squashing_scaler(spark, sf_dir):
    df = _holes(spark, sf_dir)
    return _shown(t.squash(df, C).transform(df), 5)


def robust_scale(spark, sf_dir):
    df = _l(spark, sf_dir)
    return _shown(t.robust(df, C).transform(df), 5)


def quantile_uniform(spark, sf_dir):
    df = _holes(spark, sf_dir)
    return _shown(t.quantile_uniform(df, ["l_extendedprice"], 11).transform(df), 5, ["l_extendedprice"])


def quantile_extrapolate(spark, sf_dir):
    df = _l(spark, sf_dir)
    fitted = t.quantile_uniform(df.where("l_extendedprice between 10000 and 50000"), ["l_extendedprice"], 5, 0.2)
    return _shown(fitted.transform(df), 5, ["l_extendedprice"])


def quantile_normal(spark, sf_dir):
    df = _l(spark, sf_dir)
    return _shown(t.quantile_normal(df, ["l_extendedprice"], 11).transform(df), 4, ["l_extendedprice"])


def yeo_johnson_fixed(spark, sf_dir):
    df = _l(spark, sf_dir)
    x = F.col("l_quantity") - 25
    return df.select(*K, F.round(t.yeo_johnson(x, 0.5), 6).alias("y"), F.round(t.yeo_johnson(x, 0), 6).alias("y0"), F.round(t.yeo_johnson(x, 2), 6).alias("y2"))


def box_cox_fixed(spark, sf_dir):
    return _l(spark, sf_dir).select(*K, F.round(t.box_cox(F.col("l_quantity"), 0.3), 6).alias("y"), F.round(t.box_cox(F.col("l_quantity"), 0), 6).alias("y0"))


def yeo_johnson_mle(spark, sf_dir):
    df = _l(spark, sf_dir)
    return df.limit(1).select(F.lit(round(t.yeo_johnson_powers(df, ["l_quantity"])["l_quantity"], 3)).alias("power"))


def log_transforms(spark, sf_dir):
    q = F.col("l_quantity")
    return _l(spark, sf_dir).select(*K, F.round(F.ln(q), 6).alias("ln"), F.round(F.log1p(q), 6).alias("ln1p"), F.round(F.exp(F.col("l_discount")), 6).alias("exp"))


def ordinal_encode(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return t.ordinal(df.where("o_orderstatus <> 'P'"), ["o_orderstatus", "o_orderpriority"]).transform(df).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def ordinal_encode_large(spark, sf_dir):
    return t.ordinal_join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "code").select("p_partkey", F.col("code").cast("long").alias("code"))


def onehot(spark, sf_dir):
    df = t.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    return df.select("o_orderkey", *(F.col(c).alias(c.lower()) for c in df.columns[1:]))


def constant_drop(spark, sf_dir):
    df = _l(spark, sf_dir).withColumns({"same": F.lit(1), "empty": F.lit(None).cast("int"), "holes": F.when(F.col("l_linenumber") > 1, 3)})
    kept = t.varying_columns(df, ["same", "empty", "holes", "l_tax"])
    return df.limit(1).select(F.explode(F.array(*map(F.lit, kept))).alias("kept"))


def unique_filter(spark, sf_dir):
    df = _l(spark, sf_dir)
    return df.limit(1).select(F.explode(F.array(*map(F.lit, t.unique_filter(df, [*C, "l_returnflag"], 11)))).alias("kept"))


def impute_median(spark, sf_dir):
    df = _holes(spark, sf_dir)
    return _shown(t.imputed(df, ["l_extendedprice"]).transform(df), 4, ["l_extendedprice"])


def impute_finite_mean(spark, sf_dir):
    df = _holes(spark, sf_dir).withColumn("l_extendedprice", F.when(F.col("l_linenumber") == 2, F.lit(float("inf"))).otherwise(F.col("l_extendedprice")))
    return _shown(t.finite_or_mean(df, ["l_extendedprice"]).transform(df), 4, ["l_extendedprice"])


def poly_pairs(spark, sf_dir):
    df = t.polynomial(_l(spark, sf_dir), [("l_quantity", "l_discount"), ("l_tax", "l_tax")])
    return _shown(df, 5, ["l_quantity_x_l_discount", "l_tax_x_l_tax"])


def pearson2_skew(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(F.round(t.pearson_skew(F.col(c)), 6).alias(c) for c in C))


def svd_features(spark, sf_dir):
    df = _l(spark, sf_dir).withColumn("row", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return t.svd_features(df, [*C, "l_tax"], 2, "row").select("row", F.round("svd_0", 4).alias("svd_0"), F.round("svd_1", 4).alias("svd_1"))


def fingerprint_rows(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", t.fingerprint(df, ["o_custkey", "o_orderstatus", "o_orderpriority"]).alias("fp"))


def fingerprint_dedup(spark, sf_dir):
    """The first row of each content stays."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    one = Window.partitionBy(t.fingerprint(df, ["text", "lang"])).orderBy("doc_id")
    return df.withColumn("k", F.row_number().over(one)).where("k = 1").select("doc_id", "lang")


def fingerprint_counter(spark, sf_dir):
    """The k-th copy of a row has a fingerprint of its own."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    base = t.fingerprint(df, ["o_orderstatus", "o_orderpriority"])
    k = F.row_number().over(Window.partitionBy("o_orderstatus", "o_orderpriority").orderBy("o_orderkey")) - 1
    return df.select("o_orderkey", F.sha2(F.concat_ws("|", base, k.cast("string")), 256).alias("fp"))


def reserved_exclusion(spark, sf_dir):
    """Rows whose content is reserved go."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    fp = t.fingerprint(df, ["o_custkey", "o_orderstatus"])
    kept = df.withColumn("fp", fp)
    return kept.join(kept.where("o_orderkey % 10 = 0").select("fp").distinct(), "fp", "left_anti").select("o_orderkey")


def contradictory_rows(spark, sf_dir):
    """Rows whose features occur with more than one label."""
    one = Window.partitionBy("l_quantity", "l_discount", "l_tax")
    df = table(spark, sf_dir, "lineitem")
    return df.withColumn("bad", F.min("l_returnflag").over(one) < F.max("l_returnflag").over(one)).groupBy("bad").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (scale_standard_clip, scale_sample_standard, scale_minmax_metadata, scale_minmax_round_trip, outlier_soft_clip, outlier_hard_clip, squashing_scaler, robust_scale, quantile_uniform, quantile_extrapolate, quantile_normal, yeo_johnson_fixed, box_cox_fixed, yeo_johnson_mle, log_transforms, ordinal_encode, ordinal_encode_large, onehot, constant_drop, unique_filter, impute_median, impute_finite_mean, poly_pairs, pearson2_skew, svd_features, fingerprint_rows, fingerprint_dedup, fingerprint_counter, reserved_exclusion, contradictory_rows)}
_KS = "l_orderkey, l_linenumber"
_HOLES = "(SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice END AS l_extendedprice, l_discount FROM lineitem)"


def _over(form, rows="lineitem", digits=6, columns=C):
    return f"SELECT {_KS}, " + ", ".join(f"round({form.format(c=c)}, {digits}) AS {c}" for c in columns) + f" FROM {rows}"


def _two_stage(inside):
    ctes = ", ".join(f"a{i} AS (SELECT avg({c}) AS m, greatest(stddev_samp({c}), 1e-6) AS s FROM lineitem), b{i} AS (SELECT avg({c}) - 1.2 * greatest(stddev_samp({c}), 1e-6) AS lo, avg({c}) + 1.2 * greatest(stddev_samp({c}), 1e-6) AS hi FROM lineitem, a{i} WHERE {c} BETWEEN m - 1.2 * s AND m + 1.2 * s)" for i, c in enumerate(C))
    return f"WITH {ctes} SELECT {_KS}, " + ", ".join(f"round({inside.format(c=c, lo=f'b{i}.lo', hi=f'b{i}.hi')}, 4) AS {c}" for i, c in enumerate(C)) + " FROM lineitem, " + ", ".join(f"b{i}" for i in range(len(C)))


_U = f"""WITH q AS (SELECT quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q FROM {_HOLES}),
r AS (SELECT *, CASE WHEN l_extendedprice <= q[1] THEN 0 WHEN l_extendedprice >= q[11] THEN 1 ELSE len(list_filter(q, lambda v: v < l_extendedprice)) END AS k FROM {_HOLES}, q)
SELECT {_KS}, round(CASE WHEN l_extendedprice IS NULL THEN NULL WHEN l_extendedprice <= q[1] THEN 0 WHEN l_extendedprice >= q[11] THEN 1 ELSE (k - 1 + (l_extendedprice - q[k::INT]) / (q[k::INT + 1] - q[k::INT])) / 10 END, 5) AS l_extendedprice FROM r"""
_X = f"""WITH q AS (SELECT quantile_cont(l_extendedprice, [0, .25, .5, .75, 1]) AS q FROM lineitem WHERE l_extendedprice BETWEEN 10000 AND 50000),
r AS (SELECT *, least(greatest(len(list_filter(q, lambda v: v < l_extendedprice)), 1), 4)::INT AS k FROM lineitem, q)
SELECT {_KS}, round(least(1.2, greatest(-0.2, (k - 1 + (l_extendedprice - q[k]) / (q[k + 1] - q[k])) / 4)), 5) AS l_extendedprice FROM r"""
_FP = "sha256(o_custkey || chr(1) || o_orderstatus || chr(1) || o_orderpriority)"
ORACLES = {
    "scale_standard_clip": _over("least(1.5, greatest(-1.5, ({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-6)))", digits=5),
    "scale_sample_standard": _over("({c} - avg({c}) OVER ()) / greatest(stddev_samp({c}) OVER (), 1e-6)", _HOLES, 5),
    "scale_minmax_metadata": f"SELECT {_KS}, round((l_quantity - 1) / 49.0, 6) AS l_quantity, round(l_discount, 6) AS l_discount FROM lineitem",
    "scale_minmax_round_trip": f"SELECT {_KS}, round(l_quantity, 6) AS l_quantity, round(l_discount, 6) AS l_discount FROM lineitem",
    "outlier_soft_clip": _two_stage("least({hi} + ln(1 + abs({c})), greatest({lo} - ln(1 + abs({c})), {c}))"),
    "outlier_hard_clip": _two_stage("least({hi}, greatest({lo}, {c}))"),
    "squashing_scaler": f"SELECT {_KS}, " + ", ".join(f"round(z{i} / sqrt(1 + pow(z{i} / 3, 2)), 5) AS {c}" for i, c in enumerate(C)) + f" FROM (SELECT {_KS}, " + ", ".join(f"({c} - q{i}[2]) / (q{i}[3] - q{i}[1]) AS z{i}" for i, c in enumerate(C)) + f" FROM {_HOLES}, (SELECT " + ", ".join(f"quantile_cont({c}, [.25, .5, .75]) AS q{i}" for i, c in enumerate(C)) + f" FROM {_HOLES}))",
    "robust_scale": f"SELECT {_KS}, " + ", ".join(f"round(({c} - q{i}[2]) / ((q{i}[3] - q{i}[1]) / 1.3489795003921634), 5) AS {c}" for i, c in enumerate(C)) + " FROM lineitem, (SELECT " + ", ".join(f"quantile_cont({c}, [.25, .5, .75]) AS q{i}" for i, c in enumerate(C)) + " FROM lineitem)",
    "quantile_uniform": _U,
    "quantile_extrapolate": _X,
    "yeo_johnson_fixed": f"SELECT {_KS}, round(CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END, 6) AS y, round(CASE WHEN x >= 0 THEN ln(1 + x) ELSE -(pow(1 - x, 2) - 1) / 2 END, 6) AS y0, round(CASE WHEN x >= 0 THEN (pow(x + 1, 2) - 1) / 2 ELSE -ln(1 - x) END, 6) AS y2 FROM (SELECT *, l_quantity - 25 AS x FROM lineitem)",
    "box_cox_fixed": f"SELECT {_KS}, round((pow(l_quantity, 0.3) - 1) / 0.3, 6) AS y, round(ln(l_quantity), 6) AS y0 FROM lineitem",
    "log_transforms": f"SELECT {_KS}, round(ln(l_quantity), 6) AS ln, round(ln(1 + l_quantity), 6) AS ln1p, round(exp(l_discount), 6) AS exp FROM lineitem",
    "ordinal_encode": "SELECT o_orderkey, (list_position((SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus) FROM orders WHERE o_orderstatus <> 'P'), o_orderstatus) - 1)::DOUBLE AS o_orderstatus, (list_position((SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FROM orders WHERE o_orderstatus <> 'P'), o_orderpriority) - 1)::DOUBLE AS o_orderpriority FROM orders",
    "ordinal_encode_large": "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part",
    "onehot": "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS o_orderstatus_f, (o_orderstatus = 'O')::INT AS o_orderstatus_o, (o_orderstatus = 'P')::INT AS o_orderstatus_p FROM orders",
    "constant_drop": "SELECT unnest(['holes', 'l_tax']) AS kept",
    "unique_filter": "SELECT kept FROM (SELECT count(DISTINCT l_quantity) AS a, count(DISTINCT l_extendedprice) AS b, count(DISTINCT l_discount) AS c FROM lineitem), (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS kept) WHERE CASE kept WHEN 'l_quantity' THEN a WHEN 'l_extendedprice' THEN b ELSE c END > 11",
    "impute_median": f"SELECT {_KS}, round(coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM {_HOLES})), 4) AS l_extendedprice FROM {_HOLES}",
    "impute_finite_mean": f"SELECT {_KS}, round(coalesce(x, avg(x) OVER ()), 4) AS l_extendedprice FROM (SELECT {_KS}, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS x FROM {_HOLES})",
    "poly_pairs": f"SELECT {_KS}, round(l_quantity / stddev_pop(l_quantity) OVER () * l_discount / stddev_pop(l_discount) OVER (), 5) AS l_quantity_x_l_discount, round(pow(l_tax / stddev_pop(l_tax) OVER (), 2), 5) AS l_tax_x_l_tax FROM lineitem",
    "pearson2_skew": "SELECT l_returnflag, " + ", ".join(f"round(3 * (avg({c}) - quantile_cont({c}, 0.5)) / stddev_pop({c}), 6) AS {c}" for c in C) + " FROM lineitem GROUP BY 1",
    "fingerprint_rows": f"SELECT o_orderkey, {_FP} AS fp FROM orders",
    "fingerprint_dedup": "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY text, lang",
    "fingerprint_counter": "SELECT o_orderkey, sha256(sha256(o_orderstatus || chr(1) || o_orderpriority) || '|' || (row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) - 1)) AS fp FROM orders",
    "reserved_exclusion": "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) NOT IN (SELECT (o_custkey, o_orderstatus) FROM orders WHERE o_orderkey % 10 = 0)",
    "contradictory_rows": "SELECT bad, count(*) AS n_rows FROM (SELECT min(l_returnflag) OVER w < max(l_returnflag) OVER w AS bad FROM lineitem WINDOW w AS (PARTITION BY l_quantity, l_discount, l_tax)) GROUP BY 1",
}
