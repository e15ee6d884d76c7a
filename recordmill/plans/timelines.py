"""Queries on timelines, labels, group aggregates, ranks and sets."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recordmill.functions.hashing import hash_key, sql_hash
from recordmill.operators import ranks, timeline
from recordmill.plans.common import CATEGORIES, FIRST_SQL, GROUP, MEMBERS_SQL, TARGET, members
from recordmill.plans.joining import LABELS_SQL
from recordmill.session import materialize
from recordmill.plans.registry import Tables, query

EVENT_FIRST_SQL = "select user_id, event_type, min(ts) as first_ym from events where value > 150 group by all"


def _event_first(t: Tables):
    return timeline.first_seen(t.events.where("value > 150"), ["user_id"], "event_type", "ts")


def _first(t: Tables):
    return timeline.first_seen(members(t), GROUP, "category", "ym")


@query(
    "group_size",
    f"select domain, group_id, count(*) as group_size, count(ym) as n_dated from ({MEMBERS_SQL}) group by all",
)
def group_size(t: Tables):
    dated = members(t).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("group_size"), F.count("ym").alias("n_dated"))
    return dated


@query("first_seen", EVENT_FIRST_SQL)
def first_seen(t: Tables):
    return _event_first(t)


@query(
    "first_seen_pivot",
    "select domain, group_id, "
    + ", ".join(f"min(first_ym) filter (category = '{v}') as first_{n}" for v, n in CATEGORIES.items())
    + f" from ({FIRST_SQL}) group by all",
)
def first_seen_pivot(t: Tables):
    return timeline.first_seen_wide(_first(t), GROUP, "category", CATEGORIES)


@query(
    "group_mode",
    f"""
    with c as (select domain, group_id, category, count(*) as n from ({MEMBERS_SQL}) group by all)
    select domain, group_id, arg_min(category, struct_pack(a := -n, b := category)) as mode, max(n) as mode_n
    from c group by all
    """,
)
def group_mode(t: Tables):
    return timeline.group_mode(members(t), GROUP, "category")


@query(
    "category_list",
    f"""
    select domain, group_id, string_agg(category, '|' order by category) as categories, count(*) as n
    from ({FIRST_SQL}) group by all
    """,
)
def category_list(t: Tables):
    lists = timeline.category_list(_first(t), GROUP, "category")
    return lists.select(
        *GROUP, F.array_join("categories", "|").alias("categories"), F.size("categories").cast("bigint").alias("n")
    )


@query("group_labels", LABELS_SQL.format(g="domain, group_id", first=FIRST_SQL))
def group_labels(t: Tables):
    return timeline.group_labels(_first(t), GROUP, "category", TARGET)


def _sql_days(a: str, b: str) -> str:
    return f"cast((year({b}) - year({a})) * 365 + (month({b}) - month({a})) * 30 as integer)"


def _sql_bin(d: str, signed: bool) -> str:
    neg = f"when {d} < 0 then 'negative' " if signed else ""
    y = f"{d} / 365.25" if signed else f"abs({d}) / 365.25"
    return (
        f"coalesce(case {neg}when {y} < 1 then '<1yr' when {y} < 3 then '1-3yr' when {y} < 5 then '3-5yr' "
        f"when {d} is not null then '5yr+' end, '')"
    )


INTERVAL_SQL = f"""
    with f as ({FIRST_SQL}),
    g as (
      select domain, group_id,
             cast(count(*) filter (category <> 'unknown') >= 2 as int) as multi_category,
             cast(bool_or(category = '{TARGET}') and bool_or(category not in ('unknown', '{TARGET}')) as int) as target_plus_other,
             min(first_ym) filter (category <> 'unknown') as fa, max(first_ym) filter (category <> 'unknown') as la,
             min(first_ym) filter (category = '{TARGET}') as ft,
             min(first_ym) filter (category not in ('unknown', '{TARGET}')) as fo,
             arg_min(category, struct_pack(y := first_ym, c := category)) filter (category not in ('unknown', '{TARGET}')) as src
      from f group by all),
    d as (
      select *, case when multi_category = 1 then {_sql_days('fa', 'la')} end as span_days,
             case when target_plus_other = 1 then {_sql_days('fo', 'ft')} end as signed_days from g)"""


@query(
    "group_interval",
    f"""{INTERVAL_SQL}
    select domain, group_id, span_days, {_sql_bin('span_days', False)} as span_bin,
           signed_days, {_sql_bin('signed_days', True)} as signed_bin from d
    """,
)
def group_interval(t: Tables):
    out = timeline.group_intervals(_first(t), GROUP, "category", TARGET)
    return out.select(*GROUP, "span_days", "span_bin", "signed_days", "signed_bin")


@query(
    "group_source",
    f"{INTERVAL_SQL} select domain, group_id, src as source_category from d where target_plus_other = 1",
)
def group_source(t: Tables):
    out = timeline.group_intervals(_first(t), GROUP, "category", TARGET)
    return out.where("target_plus_other = 1").select(*GROUP, "source_category")


RECORD_INTERVAL_SQL = f"""
    with m as ({MEMBERS_SQL}), f as ({FIRST_SQL}),
    g as (select domain, group_id, min(first_ym) filter (category = '{TARGET}') as ft,
                 min(first_ym) filter (category not in ('unknown', '{TARGET}')) as fo from f group by all),
    d as (select record_id, case when ym is null or ft is null or fo is null then null
                 when category = '{TARGET}' then {_sql_days('fo', 'ym')} else {_sql_days('ym', 'ft')} end as days
          from m left join g using (domain, group_id))"""


def _record_interval(t: Tables, signed: bool):
    c = F.col("category")
    anchors = _first(t).groupBy(*GROUP).agg(
        F.min(F.when(c == TARGET, F.col("first_ym"))).alias("ft"),
        F.min(F.when((c != "unknown") & (c != TARGET), F.col("first_ym"))).alias("fo"),
    )
    days = timeline.record_interval(F.col("ym"), c, TARGET, F.col("ft"), F.col("fo"), signed)
    return members(t).join(anchors, GROUP, "left").select("record_id", days.alias("days"))


@query(
    "record_interval",
    f"{RECORD_INTERVAL_SQL} select record_id, case when days < 0 then 0 else days end as days from d",
)
def record_interval(t: Tables):
    return _record_interval(t, signed=False)


@query("record_interval_signed", f"{RECORD_INTERVAL_SQL} select record_id, days from d")
def record_interval_signed(t: Tables):
    return _record_interval(t, signed=True)


CUTOFFS = {y: f"{y}-12-31" for y in (1996, 1998, 2000)}
AS_OF_SQL = f"""
    with f as ({FIRST_SQL}), cut as (select unnest([1996, 1998, 2000]) as cutoff)
    select domain, group_id, cutoff,
           cast(count(*) filter (category <> 'unknown' and year(first_ym) <= cutoff) >= 2 as int) as multi_category,
           cast(count(*) filter (category = '{TARGET}' and year(first_ym) <= cutoff) > 0 and
                count(*) filter (category not in ('unknown', '{TARGET}') and year(first_ym) <= cutoff) > 0 as int) as target_plus_other
    from f, cut group by all"""


@query("labels_as_of", AS_OF_SQL)
def labels_as_of(t: Tables):
    return timeline.labels_as_of(_first(t), GROUP, "category", TARGET, CUTOFFS)


@query(
    "merge_pools",
    """
    with p as (
      select o_custkey as key, 1 as ord, o_orderpriority as name, o_orderkey as k, true as in_a, false as in_b
      from orders where o_totalprice > 200000
      union all
      select o_custkey, 2, o_orderstatus, o_orderkey, false, true from orders where o_orderstatus = 'F')
    select key, arg_min(name, struct_pack(o := ord, k := k)) as name, bool_or(in_a) as in_a, bool_or(in_b) as in_b
    from p group by 1
    """,
)
def merge_pools(t: Tables):
    def pool(df, ord_, name, a, b):
        return df.select(
            F.col("o_custkey").alias("key"), F.lit(ord_).alias("ord"), F.col(name).alias("name"),
            F.col("o_orderkey").alias("k"), F.lit(a).alias("in_a"), F.lit(b).alias("in_b"),
        )

    both = pool(t.orders.where("o_totalprice > 200000"), 1, "o_orderpriority", True, False).unionAll(
        pool(t.orders.where("o_orderstatus = 'F'"), 2, "o_orderstatus", False, True)
    )
    return timeline.merge_pools(both, ["key"], {"name": F.struct("ord", "k")}, ["in_a", "in_b"])


@query(
    "first_positive_groups",
    f"""
    with a as ({AS_OF_SQL}), m as ({MEMBERS_SQL}),
    now as ({LABELS_SQL.format(g='domain, group_id', first=FIRST_SQL)}),
    sc as (select domain, group_id, cast(sum(cast(round(price * 100) as bigint)) as bigint) as score from m group by all),
    r as (select *, row_number() over (order by score desc, domain, group_id) as position from sc)
    select r.domain, r.group_id, r.score, r.position from r
    join now using (domain, group_id) left join (select * from a where cutoff = 1998) b using (domain, group_id)
    where now.target_plus_other = 1 and coalesce(b.target_plus_other, 0) = 0
    """,
)
def first_positive_groups(t: Tables):
    first = _first(t)
    now = timeline.group_labels(first, GROUP, "category", TARGET).where("target_plus_other = 1")
    past = timeline.labels_as_of(first, GROUP, "category", TARGET, {1998: "1998-12-31"})
    past = past.where("target_plus_other = 1")
    score = members(t).groupBy(*GROUP).agg(F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("score"))
    ranked = ranks.positions(score, [], "score", GROUP)
    return (
        ranked.join(now.select(*GROUP), GROUP, "left_semi")
        .join(past.select(*GROUP), GROUP, "left_anti")
        .select(*GROUP, "score", "position")
    )


GROUP_SCORES_SQL = f"""
    select domain, group_id, round(cast(sum(cast(round(price * 100) as bigint)) as double) / count(*) / 100, 6) as score,
           max(cast(category = '{TARGET}' as int)) as label, count(*) as n
    from ({MEMBERS_SQL}) group by all"""


def _group_scores(t: Tables):
    """Mean price per group from exact sums of cents; label: any target member."""
    m = members(t).select(
        *GROUP, F.round(F.col("price") * 100).cast("bigint").alias("cents"),
        (F.col("category") == TARGET).cast("int").alias("label"),
    )
    scores = timeline.group_scores(m, GROUP, "cents", "label")
    return scores.withColumn("score", F.round(F.col("score") / 100, 6))


@query("group_scores", GROUP_SCORES_SQL)
def group_scores(t: Tables):
    return _group_scores(t)


@query(
    "group_profile",
    f"""
    select domain, group_id, count(*) as n, count(distinct category) as n_categories,
           cast(min(yr) as integer) as min_year, cast(max(yr) as integer) as max_year, min(record_id) as example
    from ({MEMBERS_SQL}) group by all
    """,
)
def group_profile(t: Tables):
    return members(t).groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("n_categories"),
        F.min("yr").alias("min_year"), F.max("yr").alias("max_year"), F.min("record_id").alias("example"),
    )


@query(
    "split_audit",
    f"""
    with s as (select domain, case when yr <= 1998 then 'train' else 'eval' end as split,
                      cast(category = '{TARGET}' as int) as label from ({MEMBERS_SQL}))
    select coalesce(split, 'all') as split, coalesce(domain, 'all') as domain, count(*) as n,
           cast(sum(label) as bigint) as n_pos, round(avg(label), 6) as pos_rate
    from s group by rollup (split, domain)
    """,
)
def split_audit(t: Tables):
    s = members(t).select(
        "domain", F.when(F.col("yr") <= 1998, "train").otherwise("eval").alias("split"),
        (F.col("category") == TARGET).cast("int").alias("label"),
    )
    out = s.rollup("split", "domain").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.round(F.avg("label"), 6).alias("pos_rate")
    )
    return out.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("split", "domain")})


@query(
    "tier_crosstab",
    """
    select case when o_totalprice > 400000 then 'high' when o_totalprice > 200000 then 'mid' else 'low' end as tier,
           count(*) filter (o_orderstatus <> 'F') as label_0, count(*) filter (o_orderstatus = 'F') as label_1
    from orders group by 1
    """,
)
def tier_crosstab(t: Tables):
    p = F.col("o_totalprice")
    tier = F.when(p > 400000, "high").when(p > 200000, "mid").otherwise("low")
    rows = t.orders.select(tier.alias("tier"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    wide = rows.groupBy("tier").pivot("label", [0, 1]).count()
    return wide.select(
        "tier", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"label_{i}") for i in (0, 1)]
    )


@query(
    "seed_summary",
    f"""
    with s as (
      select l_returnflag as arm, cast({sql_hash(3, 'l_orderkey')} % 5 as integer) as seed, l_linenumber as candidate,
             avg(l_quantity) as value, from lineitem group by all),
    best as (select arm, seed, arg_max(candidate, struct_pack(v := value, c := -candidate)) as pick, max(value) as value
             from s group by all)
    select arm, count(*) as n_seeds, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd,
           max(freq) as top_freq
    from best join (select arm, max(c) as freq from (select arm, pick, count(*) as c from best group by all) group by 1)
    using (arm) group by 1
    """,
)
def seed_summary(t: Tables):
    s = t.lineitem.groupBy(
        F.col("l_returnflag").alias("arm"),
        F.pmod(hash_key(3, "l_orderkey"), F.lit(5)).cast("int").alias("seed"),
        F.col("l_linenumber").alias("candidate"),
    ).agg(F.avg("l_quantity").alias("value"))
    best = s.groupBy("arm", "seed").agg(
        F.max_by("candidate", F.struct("value", -F.col("candidate"))).alias("pick"), F.max("value").alias("value")
    )
    freq = best.groupBy("arm", "pick").count().groupBy("arm").agg(F.max("count").alias("top_freq"))
    out = best.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_pop("value"), 6).alias("sd"),
    )
    return out.join(freq, "arm")


@query(
    "score_quantiles",
    """
    select l_returnflag as cell, round(quantile_cont(l_extendedprice, 0.05), 6) as p05,
           round(quantile_cont(l_extendedprice, 0.5), 6) as p50, round(quantile_cont(l_extendedprice, 0.95), 6) as p95
    from lineitem group by 1
    """,
)
def score_quantiles(t: Tables):
    rows = t.lineitem.select(F.col("l_returnflag").alias("cell"), "l_extendedprice")
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    out = ranks.exact_quantiles(rows, ["cell"], "l_extendedprice", probs)
    return out.withColumns({p: F.round(p, 6) for p in probs})


@query(
    "score_quantiles_sketch",
    """
    select l_returnflag as cell, p, count(*) as n, true as within from lineitem, (values (0.05::double), (0.25), (0.5), (0.75), (0.95)) v(p)
    where l_extendedprice is not null group by all
    """,
)
def score_quantiles_sketch(t: Tables):
    """Quantiles from sketches of every month, merged by cell; ``within``: the exact rank is within the stated error of p."""
    rows = t.lineitem.select(F.col("l_returnflag").alias("cell"), F.trunc("l_shipdate", "month").alias("month"), F.col("l_extendedprice").alias("v"))
    monthly = ranks.quantile_sketches(rows, ["cell", "month"], "v")
    found = ranks.sketch_quantiles(ranks.merged_sketches(monthly, ["cell"]), ["cell"], [0.05, 0.25, 0.5, 0.75, 0.95])
    found = materialize(found, "quantiles")
    # exact ranks of the few estimates, all in one aggregate
    wanted = found.groupBy("cell").agg(F.collect_list(F.struct("p", "value", "n")).alias("qs"))
    seen = rows.where("v is not null").join(wanted, "cell").select("cell", "v", F.explode("qs").alias("q"))
    ranked = seen.groupBy("cell", "q.p", "q.n").agg(
        F.avg((F.col("v") < F.col("q.value")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("q.value")).cast("int")).alias("upto")
    )
    error = ranks.SKETCH_ERROR
    return ranked.select("cell", "p", "n", ((F.col("below") <= F.col("p") + error) & (F.col("upto") >= F.col("p") - error)).alias("within"))


@query(
    "class_weights",
    """
    with c as (select o_orderpriority as cls, count(*) as n from orders group by 1)
    select o_orderkey, o_orderpriority, round((select sum(n) from c) / ((select count(*) from c) * n), 6) as weight
    from orders join c on cls = o_orderpriority
    """,
)
def class_weights(t: Tables):
    out = timeline.size_weights(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "balanced")
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "cell_weights",
    f"""
    with m as ({MEMBERS_SQL}), c as (select domain, category, count(*) as n from m group by all)
    select record_id, domain, category, round((select sum(n) from c) / ((select count(*) from c) * n), 6) as weight
    from m join c using (domain, category)
    """,
)
def cell_weights(t: Tables):
    m = members(t).select("record_id", "domain", "category")
    out = timeline.size_weights(m, ["domain", "category"], "balanced")
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "group_weights",
    f"""
    with m as (select * from ({MEMBERS_SQL}) where yr <= 1998),
    c as (select domain, group_id, count(*) as n from m group by all)
    select record_id, domain, group_id, round(1.0 / n, 6) as weight from m join c using (domain, group_id)
    """,
)
def group_weights(t: Tables):
    train = members(t).where("yr <= 1998").select("record_id", *GROUP)
    return timeline.size_weights(train, GROUP, "inverse").withColumn("weight", F.round("weight", 6))


@query(
    "composition_subset",
    f"""
    with m as (select *, cast(price > 450000 as int) as label from ({MEMBERS_SQL})),
    g as (select domain, group_id, max(label) as l, bool_or(category in ('1-URGENT', '5-LOW') and status = 'F') as touch
          from m group by all)
    select record_id, domain, group_id, label from m join g using (domain, group_id) where l = 0 or touch
    """,
)
def composition_subset(t: Tables):
    final = F.when(F.col("status") == "F", F.col("category"))
    m = members(t).select(
        "record_id", *GROUP, (F.col("price") > 450000).cast("int").alias("label"), final.alias("final_category")
    )
    out = timeline.composition_subset(m, GROUP, "final_category", "label", ["1-URGENT", "5-LOW"])
    return out.select("record_id", *GROUP, "label")


@query(
    "compare_methods",
    """
    with m as (
      select 'price' as method, l_returnflag as cell, avg(l_extendedprice / 1000) as v from lineitem group by all
      union all select 'quantity', l_returnflag, avg(l_quantity) from lineitem group by all
      union all select 'discount', l_returnflag, avg(l_discount) from lineitem group by all)
    select method, round(max(v) filter (cell = 'A'), 5) as "A", round(max(v) filter (cell = 'N'), 5) as "N",
           round(max(v) filter (cell = 'R'), 5) as "R" from m group by 1
    """,
)
def compare_methods(t: Tables):
    # One scan and one aggregate; the methods become rows of a long metric table, then columns.
    wide = t.lineitem.groupBy(F.col("l_returnflag").alias("cell")).agg(
        F.avg(F.col("l_extendedprice") / 1000).alias("price"), F.avg("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"),
    )
    long = wide.unpivot("cell", ["price", "quantity", "discount"], "method", "v")
    out = long.groupBy("method").pivot("cell", ["A", "N", "R"]).agg(F.max("v"))
    return out.select("method", *[F.round(c, 5).alias(c) for c in ("A", "N", "R")])


# Ranks and sets


@query(
    "positive_ranks",
    """
    with r as (select o_orderkey, o_totalprice, o_orderstatus,
                      row_number() over (order by o_totalprice desc, o_orderkey) as position from orders)
    select o_orderkey, position from r where o_orderstatus = 'P'
    """,
)
def positive_ranks(t: Tables):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    out = ranks.positions(rows, [], "o_totalprice", ["o_orderkey"])
    return out.where("o_orderstatus = 'P'").select("o_orderkey", "position")


@query(
    "group_ranks",
    f"""
    with g as ({GROUP_SCORES_SQL}),
    r as (select *, rank() over (order by n desc) as rk, count(*) over (partition by n) as ties from g)
    select domain, group_id, n, cast(floor(rk + (ties - 1) / 2) as bigint) as size_rank from r where label = 1
    """,
)
def group_ranks(t: Tables):
    out = ranks.average_ranks(_group_scores(t), [], "n", "avg_rank", descending=True)
    return out.where("label = 1").select(*GROUP, "n", F.floor("avg_rank").alias("size_rank"))


@query(
    "rank_both_ways",
    """
    select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as down,
           row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) as up
    from orders
    """,
)
def rank_both_ways(t: Tables):
    rows = t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice")
    down = ranks.positions(rows, ["o_orderstatus"], "o_totalprice", ["o_orderkey"], "down")
    both = ranks.row_numbers(down, ["o_orderstatus"], [F.asc("o_totalprice"), F.asc("o_orderkey")], "up")
    return both.select("o_orderstatus", "o_orderkey", "down", "up")


@query(
    "train_percentile",
    """
    with tr as (select l_returnflag as cell, l_extendedprice as s from lineitem where l_shipdate < timestamp '1999-01-01'),
    d as (select cell, s, count(*) as n from tr group by all),
    c as (select cell, s, sum(n) over (partition by cell order by s) as upto, sum(n) over (partition by cell) as total from d),
    ev as (select distinct l_returnflag as cell, l_extendedprice as s from lineitem where l_shipdate >= timestamp '1999-01-01'),
    j as (select ev.cell, ev.s, c.upto, c.total,
                 row_number() over (partition by ev.cell, ev.s order by c.s desc) as rn
          from ev asof left join c on ev.cell = c.cell and ev.s > c.s)
    select j.cell, j.s as score,
           round(coalesce(j.upto, 0) / (select count(*) from tr where tr.cell = j.cell), 6) as train_pct
    from j
    """,
)
def train_percentile(t: Tables):
    rows = t.lineitem.select(F.col("l_returnflag").alias("cell"), F.col("l_extendedprice").alias("score"), "l_shipdate")
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    train = rows.where(F.col("l_shipdate") < cut).drop("l_shipdate")
    ev = rows.where(F.col("l_shipdate") >= cut).select("cell", "score").distinct()
    out = ranks.train_percentile(train, ev, ["cell"], "score")
    return out.select("cell", "score", F.round("train_pct", 6).alias("train_pct"))


@query(
    "topk_orders",
    """
    select o_custkey, o_orderkey, rank from (
      select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as integer) as rank
      from orders) where rank <= 3
    """,
)
def topk_orders(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return ranks.top_k(rows, ["o_custkey"], 3, [F.desc("o_totalprice"), F.asc("o_orderkey")]).drop("o_totalprice")


PROFILE_SQL = """
    select l_returnflag as candidate, cast(year(l_shipdate) * 12 + month(l_shipdate) as integer) as axis,
           avg(l_discount) - 0.05 as value, count(*) as n from lineitem group by all"""


@query(
    "sign_flips",
    f"""
    with p as ({PROFILE_SQL}),
    s as (select *, sign(value) as sg, lag(sign(value)) over (partition by candidate order by axis) as prev from p)
    select candidate, axis, round(value, 6) as value, abs(value) < 0.0005 as near_zero
    from s where prev is not null and sg <> prev
    """,
)
def sign_flips(t: Tables):
    # The profile has one row per candidate and month, so a plain window is enough.
    p = t.lineitem.groupBy(
        F.col("l_returnflag").alias("candidate"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("axis"),
    ).agg((F.avg("l_discount") - 0.05).alias("value"))
    sign = F.signum("value")
    prev = F.lag(sign).over(W.partitionBy("candidate").orderBy("axis"))
    return p.withColumn("prev", prev).withColumn("sg", sign).where("prev is not null and sg <> prev").select(
        "candidate", "axis", F.round("value", 6).alias("value"), (F.abs("value") < 0.0005).alias("near_zero")
    )


@query(
    "group_best_tier",
    f"""
    with m as (select domain, group_id, case when price > 450000 then 2 when price > 350000 then 1 else 0 end as tier
               from ({MEMBERS_SQL}))
    select domain, group_id, case max(tier) when 2 then 'high' when 1 then 'mid' else 'low' end as best_tier
    from m group by all
    """,
)
def group_best_tier(t: Tables):
    p = F.col("price")
    tier = F.when(p > 450000, 2).when(p > 350000, 1).otherwise(0)
    best = members(t).select(*GROUP, tier.alias("tier")).groupBy(*GROUP).agg(F.max("tier").alias("tier"))
    names = F.when(F.col("tier") == 2, "high").when(F.col("tier") == 1, "mid").otherwise("low")
    return best.select(*GROUP, names.alias("best_tier"))


@query(
    "topn_groups",
    f"select * from ({GROUP_SCORES_SQL}) order by n desc, domain, group_id limit 20",
)
def topn_groups(t: Tables):
    return _group_scores(t).orderBy(F.desc("n"), "domain", "group_id").limit(20)


@query(
    "percent_rank_score",
    "select o_orderkey, round(percent_rank() over (order by o_totalprice), 6) as percent_rank from orders",
)
def percent_rank_score(t: Tables):
    out = ranks.percent_ranks(t.orders.select("o_orderkey", "o_totalprice"), [], "o_totalprice")
    return out.select("o_orderkey", F.round("percent_rank", 6).alias("percent_rank"))


@query(
    "key_sets",
    """
    with a as (select o_custkey as k from orders where o_orderstatus = 'F'),
    b as (select o_custkey as k from orders where o_orderpriority = '1-URGENT')
    select 'union' as op, k from (select k from a union select k from b)
    union all select 'intersect', k from (select k from a intersect select k from b)
    union all select 'except', k from (select k from a except select k from b)
    """,
)
def key_sets(t: Tables):
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    # One aggregate serves all three set operations.
    flags = a.withColumn("in_a", F.lit(True)).unionByName(b.withColumn("in_a", F.lit(False))).groupBy("k").agg(
        F.bool_or("in_a").alias("a"), F.bool_or(~F.col("in_a")).alias("b")
    )
    ops = F.filter(
        F.array(
            F.lit("union"),
            F.when(F.col("a") & F.col("b"), "intersect"),
            F.when(F.col("a") & ~F.col("b"), "except"),
        ),
        lambda x: x.isNotNull(),
    )
    return flags.select(F.explode(ops).alias("op"), "k")


@query(
    "topk_jaccard",
    f"""
    with m as ({MEMBERS_SQL}),
    g as (select domain, group_id, count(*) as n, cast(sum(cast(round(price * 100) as bigint)) as bigint) as cents from m group by all),
    a as (select domain, group_id from g qualify row_number() over (partition by domain order by n desc, group_id) <= 50),
    b as (select domain, group_id from g qualify row_number() over (partition by domain order by cents desc, group_id) <= 50)
    select coalesce(a.domain, b.domain) as domain, count(*) filter (a.group_id is not null and b.group_id is not null) as n_both,
           count(*) as n_any,
           round(count(*) filter (a.group_id is not null and b.group_id is not null) / count(*), 6) as jaccard
    from a full outer join b on a.domain = b.domain and a.group_id = b.group_id group by 1
    """,
)
def topk_jaccard(t: Tables):
    g = members(t).groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("cents")
    )
    a = ranks.top_k(g, ["domain"], 50, [F.desc("n"), F.asc("group_id")])
    b = ranks.top_k(g, ["domain"], 50, [F.desc("cents"), F.asc("group_id")])
    out = ranks.set_overlap(a, b, ["group_id"], ["domain"])
    return out.withColumn("jaccard", F.round("jaccard", 6))
