"""Queries on selection protocols and forward validation."""

from pyspark.sql import functions as F

from recordmill.functions.hashing import hash_key, sql_hash
from recordmill.operators import calibrate, metrics, protocols, resample, timeline
from recordmill.plans.common import FIRST_SQL, GROUP, MEMBERS_SQL, TARGET, members
from recordmill.plans.joining import LABELS_SQL
from recordmill.plans.registry import Tables, query
from recordmill.plans.resampling import (
    UNITS_SQL, paired_summary, sql_interval, sql_paired, sql_paired_summary, sql_permutation, sql_weights, units,
)
from recordmill.plans.scores import _r, sql_auc
from recordmill.plans.splitting import GROUPED_SQL, RANDOM_ARM_SQL, grouped_arm, inherited, random_arm
from recordmill.plans.splitting import INHERITED_SQL
from recordmill.session import materialize

# Candidate scores of a record. The label is the label of its group.
CANDIDATES_SQL = f"""
    select record_id, target_plus_other as label, 'price' as candidate, price as score from ({INHERITED_SQL})
    union all select record_id, target_plus_other, 'recency', yr::double from ({INHERITED_SQL})
    union all select record_id, target_plus_other, 'noise', ({sql_hash(31, 'record_id')} % 1000)::double from ({INHERITED_SQL})
    union all select record_id, target_plus_other, 'density', ({sql_hash(32, 'domain', 'group_id')} % 1000)::double from ({INHERITED_SQL})"""
ARMS_SQL = f"""
    select 'grouped' as arm, seed, domain, record_id, split from ({GROUPED_SQL})
    union all select 'random', seed, domain, record_id, split from ({RANDOM_ARM_SQL})"""
CELLS = ["arm", "seed", "domain"]
ARM_AUC_SQL = sql_auc(
    f"select * from ({ARMS_SQL}) join ({CANDIDATES_SQL}) using (record_id)", "arm, seed, domain, split, candidate"
)


def arm_aucs(t: Tables):
    rows = materialize(inherited(t), "inherited")
    own = ["target_plus_other", "price", "yr"]
    arms = grouped_arm(rows, *own).withColumn("arm", F.lit("grouped")).unionByName(
        random_arm(rows, *own).withColumn("arm", F.lit("random"))
    )
    scores = F.struct(
        F.col("target_plus_other").alias("label"), "price", F.col("yr").cast("double").alias("recency"),
        F.pmod(hash_key(31, "record_id"), F.lit(1000)).cast("double").alias("noise"),
        F.pmod(hash_key(32, *GROUP), F.lit(1000)).cast("double").alias("density"),
    )
    # A record has its scores at hand; only one that repeats meets the scores of all its rows.
    repeated = rows.where("record_id is not null").groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialize(repeated.select("record_id"), "repeated")
    every = rows.join(repeated, "record_id").groupBy("record_id").agg(F.collect_list(scores).alias("every"))
    found = arms.where("record_id is not null").join(materialize(every, "scores"), "record_id", "left")
    wide = found.select(*CELLS, "split", F.explode(F.coalesce("every", F.array(scores))).alias("s")).select(*CELLS, "split", "s.*")
    long = wide.unpivot([*CELLS, "split", "label"], ["price", "recency", "noise", "density"], "candidate", "score")
    out = metrics.auc(long, [*CELLS, "split", "candidate"], "score", "label")
    return materialize(_r(out, "auc"), "aucs")


def _picks_sql(pool: str = "") -> str:
    return f"""
    with a as (select arm, seed, domain, split, candidate, round(auc, 6) as auc from ({ARM_AUC_SQL}) {pool}),
    v as (select arm, seed, domain, candidate as selected, auc as val_value from a where split = 'val' and auc is not null
          qualify row_number() over (partition by arm, seed, domain order by auc desc, candidate) = 1)
    select v.*, a.auc as test_value from v left join a on a.arm = v.arm and a.seed = v.seed and a.domain = v.domain
      and a.candidate = v.selected and a.split = 'test'"""


SUMMARY_SQL = """
    with p as ({picks}), f as (select arm, domain, selected, count(*) as c from p group by all)
    select p.arm, p.domain, count(*) as n_seeds, round(avg(test_value), 6) as test_mean, round(stddev_pop(test_value), 6) as test_sd,
           max(m.top_pick) as top_pick, max(m.top_freq) as top_freq
    from p join (select arm, domain, arg_min(selected, struct_pack(n := -c, s := selected)) as top_pick, max(c) as top_freq from f group by all) m
      on p.arm = m.arm and p.domain = m.domain group by p.arm, p.domain"""


@query("select_on_val", _picks_sql())
def select_on_val(t: Tables):
    return protocols.select_then_test(arm_aucs(t), CELLS)


@query("select_then_test", SUMMARY_SQL.format(picks=_picks_sql()))
def select_then_test(t: Tables):
    picked = protocols.select_then_test(arm_aucs(t), CELLS)
    return _r(protocols.summarise_seeds(picked, ["arm", "domain"]), "test_mean", "test_sd")


@query(
    "leakage_delta",
    f"""
    with s as ({SUMMARY_SQL.format(picks=_picks_sql())})
    select domain, round(max(test_mean) filter (arm = 'random'), 6) as random_mean,
           round(max(test_mean) filter (arm = 'grouped'), 6) as grouped_mean,
           round(max(test_mean) filter (arm = 'random') - max(test_mean) filter (arm = 'grouped'), 6) as delta from s group by 1
    """,
)
def leakage_delta(t: Tables):
    picked = protocols.select_then_test(arm_aucs(t), CELLS)
    summary = _r(protocols.summarise_seeds(picked, ["arm", "domain"]), "test_mean")
    out = protocols.arm_delta(summary, ["domain"], "arm", "random", "grouped", "test_mean")
    return _r(out, "random_mean", "grouped_mean", "delta")


POOL = "where candidate in ('price', 'noise')"


def _budgeted(t: Tables, aucs=None):
    aucs = arm_aucs(t) if aucs is None else aucs
    pool = t.spark.createDataFrame([("price",), ("noise",)], "candidate string")
    return protocols.select_then_test(protocols.restrict_pool(aucs, pool), CELLS)


@query("select_budgeted", _picks_sql(POOL))
def select_budgeted(t: Tables):
    return _budgeted(t)


@query(
    "result_delta",
    f"""
    with a as ({_picks_sql()}), b as ({_picks_sql(POOL)})
    select arm, seed, domain, a.selected as base_choice, b.selected as other_choice, a.selected <> b.selected as changed,
           round(b.test_value - a.test_value, 6) as delta from a join b using (arm, seed, domain)
    """,
)
def result_delta(t: Tables):
    aucs = arm_aucs(t)
    base = protocols.select_then_test(aucs, CELLS)
    return _r(protocols.result_delta(base, _budgeted(t, aucs), CELLS, "selected", "test_value"), "delta")


@query("baseline_vs_model", sql_paired_summary(sql_paired(
    f"select 'all' as cell, domain || '/' || group_id as unit, score, score_b, label from ({UNITS_SQL})", "cell", "unit", 60, 109), "cell"))
def baseline_vs_model(t: Tables):
    pooled = units(t).select(
        F.lit("all").alias("cell"), F.concat_ws("/", *GROUP).alias("unit"), "score", "score_b", "label"
    )
    draws = resample.paired_difference(pooled, ["cell"], ["unit"], "score", "score_b", "label", 60, 109)
    return paired_summary(draws, ["cell"])


@query(
    "reconcile_scores",
    """
    with a as (select l_orderkey as k, sum(cast(round(l_extendedprice * 100) as bigint)) / 100 as v from lineitem group by 1),
    b as (select o_orderkey as k, o_totalprice as v from orders),
    j as (select a.v as x, b.v as y from a join b using (k)),
    r as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx,
                 rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from j)
    select count(*) as n, round(max(abs(x - y)), 4) as max_abs_diff, round(corr(rx, ry), 6) as spearman from r
    """,
)
def reconcile_scores(t: Tables):
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg((cents / 100).alias("v"))
    b = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    out = protocols.reconcile(a, b, ["k"], "v")
    return out.select("n", F.round("max_abs_diff", 4).alias("max_abs_diff"), F.round("spearman", 6).alias("spearman"))


# Forward validation: labels and thresholds from the past of each cutoff, scores of what follows.

YEARS = [1996, 1998, 2000]
FORWARD_PARTS = {
    "m": f"select * from ({MEMBERS_SQL}) mm, (select unnest({YEARS}) as cutoff)",
    "fs": FIRST_SQL,
    "now_labels": LABELS_SQL.format(g="domain, group_id", first=FIRST_SQL),
    "pre": f"""
      select domain, group_id, cutoff,
             cast(count(*) filter (category = '{TARGET}') > 0 and count(*) filter (category not in ('unknown', '{TARGET}')) > 0 as int) as pre
      from fs, (select unnest({YEARS}) as cutoff) where year(first_ym) <= cutoff group by all""",
    "rec": """
      select m.*, coalesce(n.target_plus_other, 0) as now_label, coalesce(p.pre, 0) as pre_label
      from m left join now_labels n using (domain, group_id) left join pre p using (domain, group_id, cutoff)""",
    "grp": """
      select cutoff, domain, group_id, round(cast(sum(cast(round(price * 100) as bigint)) as double) / count(*) / 100, 6) as score,
             max(now_label) as label, max(pre_label) as pre_label from rec where yr > cutoff group by all""",
    "thr": """
      select cutoff, quantile_cont(price, 0.5) filter (pre_label = 1) as high, quantile_cont(price, 0.95) filter (pre_label = 0) as mid
      from rec where yr <= cutoff group by 1""",
    "tiers": """
      select cutoff, count(*) filter (price >= high) as n_high, count(*) filter (price >= high and now_label = 1) as tp_high,
             count(*) as n_eval from rec join thr using (cutoff) where yr > cutoff group by 1""",
    "boot": sql_interval(
        sql_auc(
            f"select * from grp join ({sql_weights('select * from grp', 'cutoff', 'domain, group_id', 30, 110)}) using (cutoff, domain, group_id)",
            "cutoff, b", weight="w",
        ), "cutoff", "auc", 0.025, 0.975,
    ),
    "perm": sql_permutation("select * from grp", "cutoff", "domain, group_id", 20, 111),
    "ga": sql_auc("select * from grp", "cutoff"),
    "gp": sql_auc("select * from grp", "cutoff", label="pre_label"),
    "ra": sql_auc("select * from rec where yr > cutoff", "cutoff", "price", "now_label"),
    "cnt": """
      select cutoff, count(*) as n_groups, cast(sum(label) as bigint) as n_pos, cast(sum(pre_label) as bigint) as n_pos_pre,
             count(*) filter (label = 1 and pre_label = 0) as n_first from grp group by 1""",
}
FORWARD_SQL = "with " + ",\n".join(f"{k} as ({v})" for k, v in FORWARD_PARTS.items()) + """
    select cutoff, n_groups, cnt.n_pos, n_pos_pre, n_first, round(ra.auc, 6) as auc_record, round(ga.auc, 6) as auc_group,
           round(gp.auc, 6) as auc_group_pre, boot.ci_low, boot.ci_high, boot.p_above, perm.p_value,
           round(high, 6) as thr_high, round(mid, 6) as thr_mid, high < mid as degenerate, n_eval, n_high,
           round(tp_high / nullif(n_high, 0), 6) as precision_high
    from cnt join ga using (cutoff) join gp using (cutoff) join ra using (cutoff) join boot using (cutoff)
    join perm using (cutoff) join thr using (cutoff) join tiers using (cutoff)"""


@query("forward_validation", FORWARD_SQL)
def forward_validation(t: Tables):
    m = materialize(members(t), "members")
    first = timeline.first_seen(m, GROUP, "category", "ym")
    now = timeline.group_labels(first, GROUP, "category", TARGET).select(
        *GROUP, F.col("target_plus_other").alias("now_label")
    )
    pre = timeline.labels_as_of(first, GROUP, "category", TARGET, {y: f"{y}-12-31" for y in YEARS})
    pre = pre.select(*GROUP, "cutoff", F.col("target_plus_other").alias("pre_label"))
    rec = m.withColumn("cutoff", F.explode(F.array(*[F.lit(y) for y in YEARS])))
    rec = rec.join(now, GROUP, "left").join(pre, [*GROUP, "cutoff"], "left").select(
        "cutoff", *GROUP, "price", "yr", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("now_label", "pre_label")]
    )
    rec = materialize(rec, "labelled")
    ev, cell = rec.where("yr > cutoff"), ["cutoff"]
    groups = ev.groupBy("cutoff", *GROUP).agg(
        F.round(F.avg(F.round(F.col("price") * 100).cast("bigint")) / 100, 6).alias("score"),
        F.max("now_label").alias("label"), F.max("pre_label").alias("pre_label"),
    )
    groups = materialize(groups, "groups")
    counts = groups.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("label").alias("n_pos"), F.sum("pre_label").alias("n_pos_pre"),
        F.count(F.when((F.col("label") == 1) & (F.col("pre_label") == 0), 1)).alias("n_first"),
    )

    def auc(df, score, label, name):
        return metrics.auc(df, cell, score, label).select("cutoff", F.col("auc").alias(name))

    boot = resample.interval(resample.bootstrap_auc(groups, cell, GROUP, "score", "label", 30, 110), cell, "auc")
    perm = resample.permutation_auc(groups, cell, GROUP, "score", "label", 20, 111)
    thr = calibrate.tier_thresholds(rec.where("yr <= cutoff"), cell, "price", "pre_label")
    high = F.col("price") >= F.col("high")
    tiers = ev.join(thr, cell).groupBy("cutoff").agg(
        F.count(F.when(high, 1)).alias("n_high"), F.count(F.when(high & (F.col("now_label") == 1), 1)).alias("tp_high"),
        F.count(F.lit(1)).alias("n_eval"),
    )
    out = counts
    for part in (
        auc(ev, "price", "now_label", "auc_record"), auc(groups, "score", "label", "auc_group"),
        auc(groups, "score", "pre_label", "auc_group_pre"), boot.select("cutoff", "ci_low", "ci_high", "p_above"),
        perm.select("cutoff", "p_value"), thr, tiers,
    ):
        out = out.join(part, cell)
    out = out.withColumn("precision_high", F.col("tp_high") / F.nullif(F.col("n_high"), F.lit(0)))
    out = out.withColumnsRenamed({"high": "thr_high", "mid": "thr_mid"}).drop("tp_high")
    return _r(
        out, "auc_record", "auc_group", "auc_group_pre", "ci_low", "ci_high", "p_above", "p_value", "thr_high",
        "thr_mid", "precision_high",
    )
