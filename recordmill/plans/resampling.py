"""Queries on bootstrap and permutation."""

from pyspark.sql import functions as F

from recordmill.functions.hashing import sql_hash
from recordmill.operators import metrics, resample, splits
from recordmill.plans.common import GROUP, MEMBERS_SQL, members
from recordmill.plans.registry import Tables, query
from recordmill.plans.scores import MULTI_SQL, _r, sql_auc
from recordmill.session import materialize, materialize_only

B = 50
# Records with a score and a group-constant label: the group ever had an order above 480000.
BASE_SQL = f"""
    select domain, group_id, record_id, price as score, cast(yr as double) as score_b,
           max(cast(price > 480000 as int)) over (partition by domain, group_id) as label from ({MEMBERS_SQL})"""
UNITS_SQL = f"""
    select domain, group_id, round(cast(sum(cast(round(score * 100) as bigint)) as double) / count(*) / 100, 6) as score,
           max(score_b) as score_b, max(label) as label
    from ({BASE_SQL}) group by all"""


def base(t: Tables):
    m = members(t)
    labels = m.groupBy(*GROUP).agg(F.max((F.col("price") > 480000).cast("int")).alias("label"))
    return m.select(*GROUP, "record_id", F.col("price").alias("score"), F.col("yr").cast("double").alias("score_b")).join(labels, GROUP)


def units(t: Tables):
    m = members(t)
    return m.groupBy(*GROUP).agg(
        F.round(F.avg(F.round(F.col("price") * 100).cast("bigint")) / 100, 6).alias("score"),
        F.max("yr").cast("double").alias("score_b"),
        F.max((F.col("price") > 480000).cast("int")).alias("label"),
    )


def sql_weights(unit_src: str, cells: str, key: str, n_boot: int, seed: int) -> str:
    """Weights per (cells, b, key); ``cells`` and ``key`` are comma-separated lists."""
    c = f"{cells}, " if cells else ""
    part = f"partition by {cells}" if cells else ""
    using = f"using ({c}idx)"
    return f"""
    select {c}b, {key}, w from (
      select {c}b, {sql_hash(seed, 'b', 'idx')} % n_units as idx, count(*) as w
      from (select {c}row_number() over ({part} order by {key}) - 1 as idx, count(*) over ({part}) as n_units
            from (select distinct {c}{key} from ({unit_src}))), range({n_boot}) r(b) group by all)
    join (select {c}{key}, row_number() over ({part} order by {key}) - 1 as idx from (select distinct {c}{key} from ({unit_src}))) {using}"""


def sql_interval(src: str, cells: str, v: str, low: float, high: float, against: float = 0.5) -> str:
    c = f"{cells}, " if cells else ""
    g = f"group by {cells}" if cells else ""
    return f"""
    select {c}count(*) as n_valid, round(avg({v}), 6) as mean, round(quantile_cont({v}, {low}), 6) as ci_low,
           round(quantile_cont({v}, {high}), 6) as ci_high, round(avg(cast({v} > {against} as int)), 6) as p_above
    from ({src}) where {v} is not null {g}"""


def rounded(df):
    return _r(df, "mean", "ci_low", "ci_high", "p_above")


BOOT_GROUPS_SQL = sql_auc(
    f"select * from ({UNITS_SQL}) join ({sql_weights(UNITS_SQL, 'domain', 'group_id', B, 101)}) using (domain, group_id)",
    "domain, b", weight="w",
)


@query("bootstrap_groups", sql_interval(BOOT_GROUPS_SQL, "domain", "auc", 0.025, 0.975))
def bootstrap_groups(t: Tables):
    draws = resample.bootstrap_auc(units(t), ["domain"], ["group_id"], "score", "label", B, 101)
    return rounded(resample.interval(draws, ["domain"], "auc"))


BOOT_MEMBERS_SQL = sql_auc(
    f"select * from ({BASE_SQL}) join ({sql_weights(BASE_SQL, 'domain', 'group_id', B, 102)}) using (domain, group_id)",
    "domain, b", weight="w",
)


@query("bootstrap_members", sql_interval(BOOT_MEMBERS_SQL, "domain", "auc", 0.05, 0.95))
def bootstrap_members(t: Tables):
    draws = resample.bootstrap_auc(base(t), ["domain"], ["group_id"], "score", "label", B, 102)
    return rounded(resample.interval(draws, ["domain"], "auc", 0.05, 0.95))


# One class prediction per order; every order issues one draw per replicate.
ORDER_PRED_SQL = """
    select o_orderkey, o_orderstatus as y, case when o_totalprice < 150000 then 'F' when o_totalprice < 320000 then 'O' else 'P' end as q
    from orders"""
BOOT_CLASS_SQL = f"""
    with o as ({ORDER_PRED_SQL}),
    m as (select y, q, count(*) as n from o group by all),
    iv as (select y, q, sum(n) over (order by y, q) as upto, sum(n) over (order by y, q) - n as lo, sum(n) over () as total from m),
    d as (select b, cast({sql_hash(103, 'b', 'o_orderkey')} % (select max(total) from iv) as bigint) as idx from o, range(20) r(b))
    select b, y, q, count(*) as w from d join iv on idx >= lo and idx < upto group by all"""


@query(
    "bootstrap_metrics",
    f"""
    with per as ({MULTI_SQL.format(src=BOOT_CLASS_SQL, c='b, ', ck='m.b, ', y='y', q='q', on='m.b = k.b', gb='group by 1')}),
    long as (select 'accuracy' as metric, accuracy as v from per union all select 'balanced_accuracy', balanced_accuracy from per
             union all select 'macro_f1', macro_f1 from per)
    select metric, count(*) as n_valid, round(avg(v), 5) as mean, round(quantile_cont(v, 0.025), 5) as ci_low,
           round(quantile_cont(v, 0.975), 5) as ci_high from long group by 1
    """,
)
def bootstrap_metrics(t: Tables):
    p = F.col("o_totalprice")
    rows = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("y"),
        F.when(p < 150000, "F").when(p < 320000, "O").otherwise("P").alias("q"),
    )
    counts = resample.bootstrap_classes(rows, ["o_orderkey"], "y", "q", 20, 103)
    per = _r(metrics.multiclass_metrics(counts, ["b"], "y", "q", weight="w"), "accuracy", "balanced_accuracy", "macro_f1")
    long = per.unpivot("b", ["accuracy", "balanced_accuracy", "macro_f1"], "metric", "v")
    out = resample.interval(long, ["metric"], "v").drop("p_above")
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "ci_low", "ci_high")})


BOOT_REG_SQL = f"""
    with u as (select o_orderkey, o_totalprice / 1000 as y, 250.0 + (year(o_orderdate) - 1998) * 0.5 as q from orders),
    w as ({sql_weights('select o_orderkey from orders', '', 'o_orderkey', 10, 104)})
    select b, sum(w * abs(q - y)) / sum(w) as mae, sqrt(sum(w * (q - y) * (q - y)) / sum(w)) as rmse from u join w using (o_orderkey) group by 1"""


@query(
    "bootstrap_regression",
    f"""
    with long as (select 'mae' as metric, mae as v from ({BOOT_REG_SQL}) union all select 'rmse', rmse from ({BOOT_REG_SQL}))
    select metric, count(*) as n_valid, round(avg(v), 5) as mean, round(quantile_cont(v, 0.025), 5) as ci_low,
           round(quantile_cont(v, 0.975), 5) as ci_high from long group by 1
    """,
)
def bootstrap_regression(t: Tables):
    rows = t.orders.select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("y"), (250.0 + (F.year("o_orderdate") - 1998) * 0.5).alias("q")
    )
    weights = resample.draw_weights(rows.select("o_orderkey"), [], ["o_orderkey"], 10, 104)
    err, w = F.col("q") - F.col("y"), F.col("w")
    per = rows.join(weights, "o_orderkey").groupBy("b").agg(
        (F.sum(w * F.abs(err)) / F.sum(w)).alias("mae"), F.sqrt(F.sum(w * err * err) / F.sum(w)).alias("rmse")
    )
    out = resample.interval(per.unpivot("b", ["mae", "rmse"], "metric", "v"), ["metric"], "v").drop("p_above")
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "ci_low", "ci_high")})


def sql_paired(unit_src: str, cells: str, key: str, n_boot: int, seed: int, a: str = "score", b: str = "score_b") -> str:
    src = f"select * from ({unit_src}) join ({sql_weights(unit_src, cells, key, n_boot, seed)}) using ({cells}, {key})"
    return f"""
    select {cells}, b, x.auc as auc_a, y.auc as auc_b, x.auc - y.auc as delta
    from ({sql_auc(src, cells + ', b', a, weight='w')}) x join ({sql_auc(src, cells + ', b', b, weight='w')}) y using ({cells}, b)
    where x.auc is not null and y.auc is not null"""


def sql_paired_summary(src: str, cells: str) -> str:
    return f"""
    select {cells}, count(*) as n_valid, round(avg(delta), 6) as delta_mean, round(quantile_cont(delta, 0.025), 6) as ci_low,
           round(quantile_cont(delta, 0.975), 6) as ci_high, round(avg(cast(delta > 0 as int)), 6) as p_gt_0,
           round(avg(cast(delta < 0 as int)), 6) as p_lt_0 from ({src}) group by {cells}"""


def paired_summary(draws, cells):
    d = F.col("delta")
    out = draws.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n_valid"), F.avg(d).alias("delta_mean"),
        F.percentile(d, F.lit(0.025)).alias("ci_low"), F.percentile(d, F.lit(0.975)).alias("ci_high"),
        F.avg((d > 0).cast("int")).alias("p_gt_0"), F.avg((d < 0).cast("int")).alias("p_lt_0"),
    )
    return _r(out, "delta_mean", "ci_low", "ci_high", "p_gt_0", "p_lt_0")


@query("paired_bootstrap", sql_paired_summary(sql_paired(UNITS_SQL, "domain", "group_id", B, 105), "domain"))
def paired_bootstrap(t: Tables):
    draws = resample.paired_difference(units(t), ["domain"], ["group_id"], "score", "score_b", "label", B, 105)
    return paired_summary(draws, ["domain"])


def sql_permutation(unit_src: str, cells: str, key: str, n_perm: int, seed: int) -> str:
    """``cells`` must not be empty."""
    return f"""
    with u as ({unit_src}),
    r as (select *, rank() over (partition by {cells} order by score) + (count(*) over (partition by {cells}, score) - 1) / 2.0 as rk,
                 sum(label) over (partition by {cells}) as np, sum(1 - label) over (partition by {cells}) as nn from u),
    o as (select {cells}, np, nn, round((sum(rk) filter (label = 1) - np * (np + 1) / 2) / nullif(np * nn, 0), 12) as obs from r group by {cells}, np, nn),
    h as (select r.*, b, row_number() over (partition by {cells}, b order by {sql_hash(seed, 'b', *key.split(', '))}, b, {key}) as pos from r, range({n_perm}) x(b)),
    p as (select {cells}, b, round((sum(rk) filter (pos <= np) - np * (np + 1) / 2) / nullif(np * nn, 0), 12) as perm from h group by {cells}, b, np, nn)
    select {cells}, cast(np as bigint) as n_pos, cast(nn as bigint) as n_neg, round(obs, 6) as auc,
           count(*) filter (perm >= obs) as n_reached, count(*) as n_perm, round(count(*) filter (perm >= obs) / count(*), 6) as p_plain,
           round((1 + count(*) filter (perm >= obs)) / (1 + count(*)), 6) as p_value
    from p join o using ({cells}) group by {cells}, np, nn, obs"""


@query("permutation_auc", sql_permutation(UNITS_SQL, "domain", "group_id", 40, 106))
def permutation_auc(t: Tables):
    out = resample.permutation_auc(units(t), ["domain"], ["group_id"], "score", "label", 40, 106)
    return _r(out, "auc", "p_plain", "p_value")


@query(
    "set_permutation",
    f"""
    with p as (select p_partkey, p_retailprice as v, p_brand in ('Brand#1', 'Brand#2') as s from part),
    k as (select count(*) filter (s) as k from p),
    h as (select p.*, b, row_number() over (partition by b order by {sql_hash(107, 'b', 'p_partkey')}, b, p_partkey) as pos from p, range(40) x(b)),
    g as (select b, avg(v) filter (pos <= k) - avg(v) filter (pos > k) as null_stat, avg(v) filter (s) - avg(v) filter (not s) as stat from h, k group by 1)
    select round(max(stat), 6) as stat, round(avg(null_stat), 6) as null_mean,
           count(*) filter (abs(round(null_stat, 9)) >= abs(round(stat, 9))) as n_reached, count(*) as n_perm,
           round(count(*) filter (abs(round(null_stat, 9)) >= abs(round(stat, 9))) / count(*), 6) as p_value from g
    """,
)
def set_permutation(t: Tables):
    items = t.part.select("p_partkey", F.col("p_retailprice").alias("v"), F.col("p_brand").isin("Brand#1", "Brand#2").alias("s"))
    return _r(resample.set_permutation(items, ["p_partkey"], "s", "v", 40, 107), "stat", "null_mean", "p_value")


SHUFFLES = 40
_PROFILE_SQL = """
    select o_orderkey, year(o_orderdate) as yr, case when o_orderpriority = '1-URGENT' then 1 else 0 end as label,
           o_totalprice as price, cast(dayofyear(o_orderdate) as double) as day from orders"""
SHUFFLED_NULL_SQL = f"""
    with r as ({_PROFILE_SQL}), b as (select unnest(range({SHUFFLES})) as b),
    x as (select *, row_number() over (partition by b, yr order by {sql_hash(108, 'b', 'o_orderkey')}, b, o_orderkey) as k from r, b),
    y as (select b, yr, label as shuffled, row_number() over (partition by b, yr order by {sql_hash(109, 'b', 'o_orderkey')}, b, o_orderkey) as k from r, b),
    a as (select -1 as b, yr, label as shuffled, price, day from r
          union all select x.b, yr, y.shuffled, price, day from x join y using (b, yr, k)),
    l as (select b, yr, shuffled, 'price' as candidate, price as v from a union all select b, yr, shuffled, 'day', day from a),
    u as ({sql_auc('l', 'b, candidate, yr', 'v', 'shuffled')}),
    w as (select b, yr, max(auc) filter (candidate = 'price') as x, max(auc) filter (candidate = 'day') as y from u group by all),
    k as (select b, rank() over (partition by b order by x) + (count(*) over (partition by b, x) - 1) / 2.0 as rx,
                 rank() over (partition by b order by y) + (count(*) over (partition by b, y) - 1) / 2.0 as ry from w),
    c as (select b, round(corr(rx, ry), 9) as rho from k group by b),
    o as (select rho as observed from c where b = -1)
    select round(any_value(observed), 6) as observed, round(avg(rho), 6) as null_mean, round(stddev_pop(rho), 6) as null_sd,
           round(min(rho), 6) as null_min, round(max(rho), 6) as null_max,
           round((1 + count(*) filter (rho >= observed)) / (count(*) + 1.0), 6) as p_value
    from c, o where b >= 0"""


@query("shuffled_null", SHUFFLED_NULL_SQL)
def shuffled_null(t: Tables):
    """Rank correlation of the yearly AUC profiles of two scores beside its distribution under shuffled labels.

    Replicates go in turns of bounded size, and what a turn wrote is deleted after it: only AUCs stay.
    """
    rows = t.orders.select(
        "o_orderkey", F.year("o_orderdate").alias("yr"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"),
        F.col("o_totalprice").alias("price"), F.dayofyear("o_orderdate").cast("double").alias("day"),
    )
    aucs = None
    for some in resample.turns(rows.count(), SHUFFLES):

        def turn(some: range = some):
            spread = resample.replicates(rows, len(some), ["o_orderkey"], first=some[0])
            shuffled = splits.shuffle_values(spread, ["b", "yr"], ["b", "o_orderkey"], "label", 108, "shuffled")
            both = shuffled.select("b", "yr", "shuffled", "price", "day")
            if some[0] == 0:
                real = rows.select(F.lit(-1).alias("b"), "yr", F.col("label").alias("shuffled"), "price", "day")
                both = real.unionByName(both)
            long = both.unpivot(["b", "yr", "shuffled"], ["price", "day"], "candidate", "v")
            return metrics.auc(long, ["b", "candidate", "yr"], "v", "shuffled")

        found = materialize_only(t.spark, turn, "aucs")
        aucs = found if aucs is None else aucs.unionByName(found)
    wide = aucs.groupBy("b", "yr").agg(
        F.max(F.when(F.col("candidate") == "price", F.col("auc"))).alias("x"),
        F.max(F.when(F.col("candidate") == "day", F.col("auc"))).alias("y"),
    )
    rho = metrics.spearman(wide, ["b"], "x", "y").select("b", F.round("spearman", 9).alias("rho"))
    rho = materialize(rho, "rho")
    observed = rho.where("b = -1").select("rho").scalar()
    null = rho.where("b >= 0").withColumn("observed", observed).agg(
        F.max("observed").alias("observed"), F.avg("rho").alias("null_mean"), F.stddev_pop("rho").alias("null_sd"),
        F.min("rho").alias("null_min"), F.max("rho").alias("null_max"),
        ((1 + F.count(F.when(F.col("rho") >= F.col("observed"), 1))) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )
    return _r(null, *null.columns)
