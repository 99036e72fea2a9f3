"""Queries of summaries, intervals, battles, bootstraps and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.keys import key
from tessera.operators import profile as pf
from tessera.operators import reports as rp
from tessera.operators.ranks import averaged, numbered
from tessera.operators.sampling import replayed
from tessera.sources.tables import table


def _trials(spark, sf_dir):
    """A trial a user (run) and event type (part); its metric is the mean value."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("part")).agg(F.avg("value").alias("m"), F.max("value").alias("x"))


_TR = "(SELECT user_id AS run, event_type AS part, avg(value) AS m, max(value) AS x FROM events GROUP BY 1, 2)"


def _errors(spark, sf_dir):
    """Entries (supplier modulo 6) on tasks (part modulo 12) with their mean price as error."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy((F.col("l_partkey") % 12).alias("task"), F.concat(F.lit("m"), (F.col("l_suppkey") % 6).cast("string")).alias("entry")).agg(F.round(F.avg("l_quantity"), 0).alias("error"))


_ER = "(SELECT l_partkey % 12 AS task, 'm' || (l_suppkey % 6) AS entry, round(avg(l_quantity), 0) AS error FROM lineitem GROUP BY 1, 2)"


def trial_summary_grouping_sets(spark, sf_dir):
    found = rp.trial_summary(_trials(spark, sf_dir), "run", "part", "m")
    return found.select("level", "key", "n", *(F.round(c, 9).alias(c) for c in ("mean", "std", "low", "high")))


def best_trial_per_run(spark, sf_dir):
    return rp.best_per(_trials(spark, sf_dir), "run", "x", "part").select("run", "part", F.round("x", 6).alias("x"))


def metric_unpivot(spark, sf_dir):
    return rp.unpivot(_trials(spark, sf_dir), ["run", "part"], ["m", "x"]).select("run", "part", "metric", F.round("value", 9).alias("value"))


def pooled_t_interval(spark, sf_dir):
    return rp.t_interval(_trials(spark, sf_dir), ["part"], "m").select("part", "n", F.round("mean", 9).alias("mean"), F.round("half", 9).alias("half"))


def per_seed_interval(spark, sf_dir):
    """Means over the parts of a run first, then the interval over runs modulo 3."""
    means = _trials(spark, sf_dir).groupBy("run").agg(F.avg("m").alias("m")).withColumn("g", F.col("run") % 3)
    return rp.t_interval(means, ["g"], "m").select("g", "n", F.round("mean", 9).alias("mean"), F.round("half", 9).alias("half"))


def relative_change(spark, sf_dir):
    return _trials(spark, sf_dir).select("run", "part", F.round(rp.relative_change(F.col("x"), F.col("m")), 9).alias("change"))


def pivot_entry_error(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("task").pivot("entry", [f"m{i}" for i in range(6)]).agg(F.first("error"))


def melt_pivot_report(spark, sf_dir):
    long = rp.unpivot(_trials(spark, sf_dir).select(F.col("part"), "m", "x"), ["part"], ["m", "x"])
    wide = long.groupBy("part").pivot("metric", ["m", "x"]).agg(F.avg("value"))
    return wide.select("part", F.round("m", 9).alias("m"), F.round("x", 9).alias("x"))


def paired_difference(spark, sf_dir):
    return rp.paired_difference(_errors(spark, sf_dir), "task", "entry", "error", "m0")


def anchor_imputation(spark, sf_dir):
    """Missing errors take the anchor's of the task."""
    e = _errors(spark, sf_dir).withColumn("error", F.when((F.col("task") % 4 != 0) | (F.col("entry") == "m0"), F.col("error")))
    anchor = e.where("entry = 'm0'").select("task", F.col("error").alias("a"))
    return e.join(anchor, "task", "left").select("task", "entry", F.coalesce("error", "a").alias("error"))


def battles(spark, sf_dir):
    return rp.battles(_errors(spark, sf_dir), "task", "entry", "error")


def win_rate(spark, sf_dir):
    return rp.win_rates(rp.battles(_errors(spark, sf_dir), "task", "entry", "error")).select("entry", F.round("rate", 6).alias("rate"))


def mean_rank(spark, sf_dir):
    return rp.mean_ranks(_errors(spark, sf_dir), "task", "entry", "error").select("entry", F.round("mean_rank", 6).alias("mean_rank"))


def regret(spark, sf_dir):
    return rp.regret(_errors(spark, sf_dir), "task", "error").select("task", "entry", F.round("regret", 6).alias("regret"))


def improvability(spark, sf_dir):
    return rp.improvability(_errors(spark, sf_dir), "task", "entry", "error").select("entry", F.round("improvability", 6).alias("improvability"))


def spearman(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("h", F.hour("ts"))
    return rp.spearman(e, "value", "h", "event_id", ["event_type"]).select("event_type", F.round("rho", 6).alias("rho"))


def elo(spark, sf_dir):
    found = rp.elo(rp.battles(_errors(spark, sf_dir), "task", "entry", "error"), "m0")
    return spark.createDataFrame([(e, round(r, 4)) for e, r in sorted(found.items())], "entry string, rating double")


def paired_bootstrap(spark, sf_dir):
    d = rp.paired_difference(_errors(spark, sf_dir).where("entry in ('m0', 'm1')"), "task", "entry", "error", "m0")
    return rp.bootstrap_mean(d, "task", "difference", 2000).select(*(F.round(c, 9).alias(c) for c in ("mean", "low", "high", "p")))


def cluster_bootstrap(spark, sf_dir):
    return rp.bootstrap_mean(_trials(spark, sf_dir), "part", "m", 200, 1).select(*(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


def win_tie_loss(spark, sf_dir):
    d = rp.paired_difference(_errors(spark, sf_dir), "task", "entry", "error", "m0")
    x = F.col("difference")
    return d.groupBy("entry").agg(F.count_if(x < 0).alias("win"), F.count_if(x == 0).alias("tie"), F.count_if(x > 0).alias("loss"))


def rank_average(spark, sf_dir):
    """The mean of two methods' average-tie ranks; the 30 lowest go."""
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_id") * 37 % 101).alias("b"))
    ranked = averaged(averaged(e, "value", "ra"), "b", "rb")
    return ranked.select("event_id", ((F.col("ra") + F.col("rb")) / 2).alias("r")).orderBy("r", "event_id").limit(30)


def rank_blend(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_id") * 37 % 101).alias("b"))
    ranked = averaged(averaged(e, "value", "ra"), "b", "rb")
    return ranked.select("event_id", F.round((F.col("ra") * 0.7 + F.col("rb") * 0.3) / F.lit(e.count()), 6).alias("score"))


def removal_rules(spark, sf_dir):
    """Rows that each rule marks, the bottom 40 among them."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda v: F.round(F.abs(v.cast("double")), 6)).alias("p"))
    marked = rp.removal_rules(s, "p", "label", 10, 40, "vec_id").drop("vec_id")
    return marked.agg(*(F.count_if(F.col(n)).alias(n) for n in marked.columns))


def mask_vote(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("row"), (F.col("value") > 50).alias("mark"), F.rank().over(Window.partitionBy("user_id").orderBy("value")).alias("r"))
    return rp.mask_vote(e, "row", "mark", "r", 10).select("row", F.col("votes").cast("long").alias("votes"), F.round("mean_rank", 6).alias("mean_rank"))


def audit_totals(spark, sf_dir):
    """Reported order totals, one of them changed, against themselves."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rp.audit(o.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 100 == 0, 1).otherwise(0)), o, ["o_orderkey"], "o_totalprice").select("o_orderkey")


P = ["l_quantity", "l_discount", "l_linenumber", "l_returnflag", "l_shipdate"]


def table_profile(spark, sf_dir):
    found = pf.profile(table(spark, sf_dir, "lineitem"), P)
    return found.select("column", "n", "nulls", "distinct", "whole", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def modality_profile(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*P, F.lit(1).alias("same"), F.col("l_orderkey").cast("string").alias("digits"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return pf.modality(pf.profile(df, [*P, "same", "digits", "day"]), ["l_linenumber"])


def integral_type_tag(spark, sf_dir):
    return pf.type_tag(pf.profile(table(spark, sf_dir, "lineitem"), P[:4]))


def sign_class(spark, sf_dir):
    return pf.sign_class(pf.profile(table(spark, sf_dir, "lineitem").withColumn("m", F.col("l_quantity") - 25).withColumn("z", -F.col("l_discount")), ["l_quantity", "l_discount", "m", "z"]))


def sentinel_census(spark, sf_dir):
    return pf.sentinel_census(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], [0, 1, 50]).select("sentinel", "cells", F.col("columns").cast("long").alias("columns"))


def violation_census(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("t", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_tax")))  # noqa: E741
    return l.agg(pf.violated(F.col("t") <= F.col("l_discount")).alias("tax_above"), pf.violated((F.col("l_quantity") > 25) == (F.col("l_discount") > 0.05)).alias("biconditional"))


def class_balance(spark, sf_dir):
    return pf.class_balance(table(spark, sf_dir, "lineitem"), "l_returnflag").select("l_returnflag", "n", F.round("share", 6).alias("share"), F.round("ratio", 6).alias("ratio"), "grade")


def transition_matrix(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("after", F.when(F.substring(key(0, "flip", "l_orderkey", "l_linenumber"), 1, 1) == "0", "X").otherwise(F.col("l_returnflag")))  # noqa: E741
    return pf.transitions(l, "l_returnflag", "after")


def distinct_ordered(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct().orderBy("o_orderstatus", "o_orderpriority")


def null_census(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("p"))
    rows = o.groupBy("o_orderstatus", "p").agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count_distinct("o_orderstatus").alias("statuses"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"))


def success_rate(spark, sf_dir):
    """Share of orders with a line that meets each objective and their conjunction."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") > 0.05).alias("m"), (F.col("l_quantity") < 20).alias("d"))  # noqa: E741
    per = l.groupBy("l_orderkey").agg(F.max("m").alias("m"), F.max("d").alias("d"), F.max(F.col("m") & F.col("d")).alias("md"))
    return per.agg(*(F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("m", "d", "md")))


def best_candidates(spark, sf_dir):
    """Per order the two cheapest lines that pass a filter."""
    one = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber")
    return table(spark, sf_dir, "lineitem").where("l_discount > 0.03").withColumn("r", F.row_number().over(one)).where("r <= 2").select("l_orderkey", "l_linenumber")


def json_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def instance_tags(spark, sf_dir):
    """Packed keys taken apart from the right."""
    tag = F.concat(F.lit("ds_"), F.col("event_type"), F.lit("_R"), (F.col("user_id") % 30).cast("string"), F.lit("_c"), (F.col("event_id") % 5).cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", tag.alias("tag"))
    part = lambda i: F.regexp_extract("tag", r"^(.*)_R(\d+)_c(\d+)$", i)
    return e.select("event_id", part(1).alias("ds"), part(2).cast("int").alias("r"), part(3).cast("int").alias("c"))


def cutmix(spark, sf_dir):
    """Quantity from one row, discount and tax from its partner in a shuffled order."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_partkey", "l_suppkey")  # noqa: E741
    same = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    l = l.withColumn("k", key(0, "mix", "l_orderkey", "l_linenumber")).withColumn("u", F.conv(F.substring("k", 1, 8), 16, 10).cast("double"))  # noqa: E741
    placed = numbered(l, same, "a")
    other = numbered(l, ["u", "k", *same], "a").select("a", F.col("l_discount").alias("d"))
    return placed.join(other.hint("merge"), "a").select("l_orderkey", "l_linenumber", "l_quantity", "d")  # both sides have all rows, which an estimate may take for few


def batched_replay(spark, sf_dir):
    """Batches of 64 rows in order of their numbers, the last one filled from the first rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return replayed(e, "vec_id", 64).select("vec_id", "batch", "place")


_NAMES = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
QUERIES = {n: globals()[n] for n in _NAMES}
_ST = "round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std, round(min({c}), 5) AS low, round(max({c}), 5) AS high, count({c}) AS n"
_TQ = f"(CASE WHEN n - 1 <= 30 THEN {rp.T_975}[greatest(1, n - 1)::INT] ELSE {rp.NORMAL_975} END)"
_BAT = f"(SELECT x.entry AS a, y.entry AS b, sum(CASE WHEN x.error < y.error THEN 1.0 WHEN x.error = y.error THEN 0.5 ELSE 0.0 END)::DOUBLE AS wins, count(*) AS n FROM {_ER} x JOIN {_ER} y ON x.task = y.task AND x.entry < y.entry GROUP BY 1, 2)"
_DIFF = f"(SELECT x.task, x.entry, x.error - y.error AS difference FROM {_ER} x JOIN {_ER} y ON x.task = y.task AND y.entry = 'm0' WHERE x.entry <> 'm0')"


def _boot(rows, unit, value, rounds, seed):
    return f"""u AS (SELECT {unit} AS unit, sum({value}) AS s, count({value}) AS n, row_number() OVER (ORDER BY {unit}) - 1 AS place, count(*) OVER () AS k FROM {rows} GROUP BY 1),
w AS (SELECT round, floor(('0x' || substr(md5('{seed}|boot|' || round || '|' || slot), 1, 8))::BIGINT / 4294967296.0 * k)::INT AS place FROM (SELECT unnest(range({rounds})) AS round), (SELECT place AS slot, k FROM u)),
m AS (SELECT round, sum(s) / sum(n) AS m FROM w JOIN u USING (place) GROUP BY 1)"""


_RULES = {f"abs_{round(100 * t):03d}": f"p < {t}::DOUBLE" for t in (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)}
_RULES |= {f"chance_{round(100 * a):03d}": f"p < {a / 10}::DOUBLE" for a in (0.25, 0.5, 0.75, 1.0, 1.25)}
_RULES |= {f"top_{round(100 * b):03d}": f"p < {b}::DOUBLE * t" for b in (0.5, 0.75, 1.0)} | {f"class_{round(100 * c):03d}": f"p < {c}::DOUBLE * m" for c in (0.5, 0.75, 1.0)}
_AVG = lambda c, by="": f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
ORACLES = {
    # the fixed point of wins over expected games, 500 rounds from equal strengths
    "elo": f"""
WITH RECURSIVE bat AS (SELECT * FROM {_BAT}), names AS (
  SELECT list(e ORDER BY e) AS e FROM (SELECT a AS e FROM bat UNION SELECT b FROM bat)
), sides AS (
  SELECT a AS x, b AS y, wins, n FROM bat UNION ALL SELECT b, a, n - wins, n FROM bat
), entries AS (
  SELECT x, sum(wins) AS w, list(n ORDER BY y) AS games, list(y ORDER BY y) AS others FROM sides GROUP BY x
), fixed AS (
  SELECT list(w ORDER BY x) AS w, list(games ORDER BY x) AS games, list(list_transform(others, lambda o: list_position(names.e, o)) ORDER BY x) AS spots FROM entries, names
), rounds(k, p) AS (
  SELECT 0, list_transform(w, lambda v: 1.0::DOUBLE) FROM fixed
  UNION ALL
  SELECT k + 1, list_transform(q, lambda v: v / exp(list_avg(list_transform(q, lambda u: ln(u))))) FROM (
    SELECT k, list_transform(range(1, len(w) + 1), lambda i: w[i] / list_sum(list_transform(range(1, len(games[i]) + 1), lambda j: games[i][j] / (p[i] + p[spots[i][j]])))) AS q FROM rounds, fixed WHERE k < 500)
)
SELECT unnest(e) AS entry, unnest(list_transform(p, lambda v: round(400 * (log10(v) - log10(p[list_position(e, 'm0')])) + 1000, 4))) AS rating FROM rounds, names WHERE k = 500
""",
    "trial_summary_grouping_sets": f"WITH f AS (SELECT CASE WHEN grouping(run) = 1 AND grouping(part) = 1 THEN 'overall' WHEN grouping(run) = 0 THEN 'by_run' ELSE 'by_part' END AS level, coalesce(run::VARCHAR, part) AS key, avg(m) AS a, stddev_pop(m) AS s, min(m) AS lo, max(m) AS hi, count(m) AS n FROM {_TR} GROUP BY GROUPING SETS ((), (run), (part))) SELECT level, key, n, round(a, 9) AS mean, round(s, 9) AS std, round(lo, 9) AS low, round(hi, 9) AS high FROM f UNION ALL SELECT 'across_' || substr(level, 4), NULL, count(a), round(avg(a), 9), round(stddev_pop(a), 9), round(min(a), 9), round(max(a), 9) FROM f WHERE level <> 'overall' GROUP BY 1",
    "best_trial_per_run": f"SELECT run, part, round(x, 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY x DESC, part) AS r FROM {_TR}) WHERE r = 1",
    "metric_unpivot": f"SELECT run, part, 'm' AS metric, round(m, 9) AS value FROM {_TR} UNION ALL SELECT run, part, 'x', round(x, 9) FROM {_TR}",
    "pooled_t_interval": f"SELECT part, n, round(a, 9) AS mean, round(CASE WHEN n > 1 THEN {_TQ} * s / sqrt(n) END, 9) AS half FROM (SELECT part, avg(m) AS a, stddev_samp(m) AS s, count(m) AS n FROM {_TR} GROUP BY 1)",
    "per_seed_interval": f"SELECT g, n, round(a, 9) AS mean, round(CASE WHEN n > 1 THEN {_TQ} * s / sqrt(n) END, 9) AS half FROM (SELECT run % 3 AS g, avg(m) AS a, stddev_samp(m) AS s, count(m) AS n FROM (SELECT run, avg(m) AS m FROM {_TR} GROUP BY 1) GROUP BY 1)",
    "relative_change": f"SELECT run, part, round(CASE WHEN abs(m) >= 1e-12 THEN 100 * (x - m) / abs(m) END, 9) AS change FROM {_TR}",
    "pivot_entry_error": "SELECT task, " + ", ".join(f"max(error) FILTER (entry = 'm{i}') AS m{i}" for i in range(6)) + f" FROM {_ER} GROUP BY 1",
    "melt_pivot_report": f"SELECT part, round(avg(m), 9) AS m, round(avg(x), 9) AS x FROM {_TR} GROUP BY 1",
    "paired_difference": f"SELECT task, entry, difference FROM {_DIFF}",
    "anchor_imputation": f"SELECT x.task, x.entry, CASE WHEN x.task % 4 <> 0 OR x.entry = 'm0' THEN x.error ELSE y.error END AS error FROM {_ER} x LEFT JOIN {_ER} y ON x.task = y.task AND y.entry = 'm0'",
    "battles": f"SELECT * FROM {_BAT}",
    "win_rate": f"SELECT entry, round(sum(wins) / sum(n), 6) AS rate FROM (SELECT a AS entry, wins, n FROM {_BAT} UNION ALL SELECT b, n - wins, n FROM {_BAT}) GROUP BY 1",
    "mean_rank": f"SELECT entry, round(avg(r), 6) AS mean_rank FROM (SELECT entry, rank() OVER (PARTITION BY task ORDER BY error) + (count(*) OVER (PARTITION BY task, error) - 1) / 2 AS r FROM {_ER}) GROUP BY 1",
    "regret": f"SELECT task, entry, round(CASE WHEN hi <> lo THEN abs(hi - error) / abs(hi - lo) ELSE 0 END, 6) AS regret FROM (SELECT *, max(error) OVER (PARTITION BY task) AS hi, min(error) OVER (PARTITION BY task) AS lo FROM {_ER})",
    "improvability": f"SELECT entry, round(avg(CASE WHEN error <> 0 THEN 1 - lo / error ELSE 0 END), 6) AS improvability FROM (SELECT *, min(error) OVER (PARTITION BY task) AS lo FROM {_ER}) GROUP BY 1",
    "spearman": "SELECT event_type, round(corr(a, b), 6) AS rho FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)::DOUBLE AS a, row_number() OVER (PARTITION BY event_type ORDER BY hour(ts), event_id)::DOUBLE AS b FROM events) GROUP BY 1",
    "paired_bootstrap": f"WITH d AS (SELECT * FROM {_DIFF} WHERE entry = 'm1'), {_boot('d', 'task', 'difference', 2000, 0)} SELECT round((SELECT avg(difference) FROM d), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, round(avg((m <= 0)::INT), 9) AS p FROM m",
    "cluster_bootstrap": f"WITH d AS (SELECT part, m AS v FROM {_TR}), {_boot('d', 'part', 'v', 200, 1)} SELECT round((SELECT avg(v) FROM d), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m",
    "win_tie_loss": f"SELECT entry, count(*) FILTER (difference < 0) AS win, count(*) FILTER (difference = 0) AS tie, count(*) FILTER (difference > 0) AS loss FROM {_DIFF} GROUP BY 1",
    "rank_average": f"SELECT event_id, (a + b) / 2 AS r FROM (SELECT event_id, {_AVG('value')} AS a, {_AVG('event_id * 37 % 101')} AS b FROM events) ORDER BY r, event_id LIMIT 30",
    "rank_blend": f"SELECT event_id, round((a * 0.7 + b * 0.3) / n, 6) AS score FROM (SELECT event_id, {_AVG('value')} AS a, {_AVG('event_id * 37 % 101')} AS b, count(*) OVER () AS n FROM events)",
    "removal_rules": "SELECT count(*) FILTER (low) AS bottom, " + ", ".join(f"count(*) FILTER ({c}) AS {n}, count(*) FILTER (({c}) OR low) AS {n}_or_bottom" for n, c in _RULES.items()) + " FROM (SELECT *, row_number() OVER (ORDER BY p, vec_id) <= 40 AS low, avg(p) OVER (PARTITION BY label) AS m FROM (SELECT vec_id, label, x[label + 1] AS p, list_max(x) AS t FROM (SELECT vec_id, label, list_transform(embedding[1:10], lambda v: round(abs(v::DOUBLE), 6)) AS x FROM embeddings)))",
    "mask_vote": "SELECT row, votes::BIGINT AS votes, round(mr, 6) AS mean_rank FROM (SELECT event_id % 50 AS row, sum((value > 50)::INT) AS votes, avg(r) AS mr FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value) AS r FROM events) GROUP BY 1 ORDER BY votes DESC, mr, row LIMIT 10)",
    "audit_totals": "SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 0",
    "table_profile": " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct, {w} AS whole, round({lo}, 4) AS low, round({hi}, 4) AS high FROM lineitem" for c, w, lo, hi in (("l_quantity", "bool_and(l_quantity = floor(l_quantity))", "min(l_quantity)", "max(l_quantity)"), ("l_discount", "bool_and(l_discount = floor(l_discount))", "min(l_discount)", "max(l_discount)"), ("l_linenumber", "true", "min(l_linenumber)::DOUBLE", "max(l_linenumber)::DOUBLE"), ("l_returnflag", "false", "NULL::DOUBLE", "NULL::DOUBLE"), ("l_shipdate", "false", "NULL::DOUBLE", "NULL::DOUBLE"))),
    "modality_profile": "SELECT unnest(['l_quantity', 'l_discount', 'l_linenumber', 'l_returnflag', 'l_shipdate', 'same', 'digits', 'day']) AS column, unnest(['numerical', 'numerical', 'categorical', 'categorical', 'date', 'constant', 'numerical', 'date']) AS modality",
    "integral_type_tag": "SELECT unnest(['l_quantity', 'l_discount', 'l_linenumber', 'l_returnflag']) AS column, unnest([CASE WHEN bool_and(l_quantity = floor(l_quantity)) THEN 'int' ELSE 'real' END, CASE WHEN bool_and(l_discount = floor(l_discount)) THEN 'int' ELSE 'real' END, 'int', 'cat']) AS tag FROM lineitem",
    "sign_class": "SELECT unnest(['l_quantity', 'l_discount', 'm', 'z']) AS column, unnest([CASE WHEN min(l_quantity) > 0 THEN 'positive' ELSE '?' END, CASE WHEN min(l_discount) > 0 THEN 'positive' ELSE 'non-negative' END, 'mixed', CASE WHEN min(l_discount) > 0 THEN 'negative' ELSE 'non-positive' END]) AS sign FROM lineitem",
    "sentinel_census": " UNION ALL ".join(f"SELECT {s}::DOUBLE AS sentinel, sum((l_quantity = {s})::INT + (l_discount = {s})::INT + (l_tax = {s})::INT)::BIGINT AS cells, (max((l_quantity = {s})::INT) + max((l_discount = {s})::INT) + max((l_tax = {s})::INT))::BIGINT AS columns FROM lineitem" for s in (0, 1, 50)),
    "violation_census": "SELECT count(*) FILTER (NOT coalesce(t <= l_discount, false)) AS tax_above, count(*) FILTER ((l_quantity > 25) <> (l_discount > 0.05)) AS biconditional FROM (SELECT *, CASE WHEN l_orderkey % 10 <> 0 THEN l_tax END AS t FROM lineitem)",
    "class_balance": "SELECT l_returnflag, n, round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / min(n) OVER (), 6) AS ratio, CASE WHEN max(n) OVER () / min(n) OVER () <= 2 THEN 'balanced' WHEN max(n) OVER () / min(n) OVER () <= 4 THEN 'moderate' ELSE 'imbalanced' END AS grade FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)",
    "transition_matrix": "SELECT l_returnflag, CASE WHEN substr(md5('0|flip|' || l_orderkey || '|' || l_linenumber), 1, 1) = '0' THEN 'X' ELSE l_returnflag END AS after, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "distinct_ordered": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "null_census": "SELECT count(*) FILTER (p IS NULL) AS missing, count(DISTINCT s) AS statuses, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END FROM orders)) AS repeated FROM (SELECT o_orderstatus AS s, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS p FROM orders)",
    "success_rate": "SELECT round(avg(m), 6) AS m, round(avg(d), 6) AS d, round(avg(md), 6) AS md FROM (SELECT max((l_discount > 0.05)::INT) AS m, max((l_quantity < 20)::INT) AS d, max((l_discount > 0.05 AND l_quantity < 20)::INT) AS md FROM lineitem GROUP BY l_orderkey)",
    "best_candidates": "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS r FROM lineitem WHERE l_discount > 0.03) WHERE r <= 2",
    "json_fields": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events",
    "instance_tags": "SELECT event_id, 'ds_' || event_type AS ds, (user_id % 30)::INT AS r, (event_id % 5)::INT AS c FROM events",
    "cutmix": "WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS a, row_number() OVER (ORDER BY md5('0|mix|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS b FROM lineitem) SELECT x.l_orderkey, x.l_linenumber, x.l_quantity, y.l_discount AS d FROM p x JOIN p y ON x.a = y.b",
    "batched_replay": "WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS a, count(*) OVER () AS n FROM embeddings) SELECT vec_id, place // 64 AS batch, place FROM (SELECT vec_id, n, unnest([a, a + n]) AS place FROM p) WHERE place < ((n + 63) // 64) * 64",
}
