"""Queries on splits, folds and samples."""

from pyspark.sql import functions as F

from recordmill.functions.hashing import sql_hash
from recordmill.operators import splits, timeline
from recordmill.plans.common import FIRST_SQL, GROUP, MEMBERS_SQL, TARGET, members
from recordmill.plans.joining import LABELS_SQL
from recordmill.plans.registry import Tables, query

SEEDS = [42, 43, 44]
REC_SQL = f"""
    select domain, group_id, record_id, cast(category = '{TARGET}' as int) as label from ({MEMBERS_SQL})"""
# Records with the label of their group.
INHERITED_SQL = f"""
    select m.domain, m.group_id, m.record_id, g.multi_category, g.target_plus_other, m.price, m.yr
    from ({MEMBERS_SQL}) m join ({LABELS_SQL.format(g='domain, group_id', first=FIRST_SQL)}) g using (domain, group_id)"""


def records(t: Tables):
    return members(t).select(*GROUP, "record_id", (F.col("category") == TARGET).cast("int").alias("label"))


def inherited(t: Tables):
    m = members(t)
    labels = timeline.group_labels(timeline.first_seen(m, GROUP, "category", "ym"), GROUP, "category", TARGET)
    return m.join(labels, GROUP).select(*GROUP, "record_id", "multi_category", "target_plus_other", "price", "yr")


@query(
    "split_stratified",
    f"""
    with r as ({REC_SQL}),
    a as (select *, row_number() over (partition by domain, label order by {sql_hash(42, 'record_id')}, record_id) as pos,
                 count(*) over (partition by domain, label) as n from r where domain not in ('BUILDING', 'MACHINERY')),
    b as (select *, row_number() over (partition by label order by {sql_hash(43, 'record_id')}, record_id) as pos2,
                 count(*) over (partition by label) as n2 from a where pos > floor(n * 0.7 + 0.5))
    select record_id, domain, label, lower(domain) || '_holdout' as split from r where domain in ('BUILDING', 'MACHINERY')
    union all select record_id, domain, label, 'train' from a where pos <= floor(n * 0.7 + 0.5)
    union all select record_id, domain, label, case when pos2 <= floor(n2 * 0.5 + 0.5) then 'val' else 'test' end from b
    """,
)
def split_stratified(t: Tables):
    out = splits.split_stratified(
        records(t).drop("group_id"), "domain", "label", ["record_id"], ["BUILDING", "MACHINERY"]
    )
    return out.select("record_id", "domain", "label", "split")


SEED_CTE = "s as (select unnest([42, 43, 44]) as seed)"
GROUPED_SQL = f"""
    with i as ({INHERITED_SQL}), {SEED_CTE},
    g as (select domain, group_id, max(multi_category) as mc, max(target_plus_other) as tp from i group by all),
    p as (select *, row_number() over (partition by seed, domain, mc, tp order by {sql_hash('seed', 'domain', 'group_id')}, domain, group_id) as pos,
                 count(*) over (partition by seed, domain, mc, tp) as n from g, s)
    select p.seed, domain, group_id, i.record_id, case when pos <= floor(n * 0.5 + 0.5) then 'val' else 'test' end as split
    from p join i using (domain, group_id)"""
RANDOM_ARM_SQL = f"""
    with i as ({INHERITED_SQL}), {SEED_CTE},
    p as (select *, row_number() over (partition by seed, domain, multi_category, target_plus_other
                      order by {sql_hash('seed', 'record_id')}, record_id) as pos,
                 count(*) over (partition by seed, domain, multi_category, target_plus_other) as n from i, s)
    select seed, domain, group_id, record_id, case when pos <= floor(n * 0.5 + 0.5) then 'val' else 'test' end as split from p"""
STRATA = ["domain", "multi_category", "target_plus_other"]


def grouped_arm(df, *keep):
    return splits.split_grouped(df, GROUP, STRATA, SEEDS).select("seed", *GROUP, "record_id", "split", *keep)


def random_arm(df, *keep):
    return splits.split_halves(df, STRATA, ["record_id"], SEEDS).select("seed", *GROUP, "record_id", "split", *keep)


@query("split_grouped", GROUPED_SQL)
def split_grouped(t: Tables):
    return grouped_arm(inherited(t))


@query("split_random_arm", RANDOM_ARM_SQL)
def split_random_arm(t: Tables):
    return random_arm(inherited(t))


BALANCED_SQL = f"""
    with m as (select domain, group_id, case when price < 150000 then 0 when price < 300000 then 1 else 2 end as cls from ({MEMBERS_SQL})),
    g as (select domain, group_id, count(*) filter (cls = 0) as c0, count(*) filter (cls = 1) as c1, count(*) filter (cls = 2) as c2,
                 {sql_hash(42, 'domain', 'group_id')} % 2147483647 as h from m group by domain, group_id),
    t as (select trial, {sql_hash(42, "'scale'", 'trial')} % 2147483646 + 1 as a, {sql_hash(42, "'shift'", 'trial')} % 2147483647 as b
          from (select unnest(range(5000)) as trial)),
    x as (select *, (h * a + b) % 2147483647 as pos from g, t),
    d as (select *, case when pos <= floor(2147483647 * 0.7::double + 0.5) then 'train'
                         when pos <= floor(2147483647 * 0.85::double + 0.5) then 'val' else 'test' end as split from x),
    s as (select trial, split, count(distinct domain) as nd, sum(c0) as c0, sum(c1) as c1, sum(c2) as c2, sum(c0 + c1 + c2) as n from d group by all),
    o as (select count(distinct domain) as nd, sum(c0) as c0, sum(c1) as c1, sum(c2) as c2, sum(c0 + c1 + c2) as n from g),
    v as (select trial, round(sum(abs(s.n / o.n - case split when 'train' then 0.7::double else 0.15::double end)
                   + case when split = 'train' then 0 else abs(s.c0 / s.n - o.c0 / o.n) + abs(s.c1 / s.n - o.c1 / o.n) + abs(s.c2 / s.n - o.c2 / o.n) end), 9) as deviation
          from s, o group by trial
          having bool_and(split = 'train' or (s.c0 >= 5 and s.c1 >= 5 and s.c2 >= 3 and s.nd = o.nd)) and count(*) filter (split <> 'train') = 2),
    w as (select trial from v order by deviation, trial limit 1)
    select split, cls, count(*) as n from (select domain, group_id, split from d join w using (trial)) join m using (domain, group_id) group by split, cls"""


@query("split_balanced_search", BALANCED_SQL)
def split_balanced_search(t: Tables):
    m = members(t).select(*GROUP, F.when(F.col("price") < 150000, 0).when(F.col("price") < 300000, 1).otherwise(2).alias("cls"))
    chosen, _ = splits.balanced_search(
        m, GROUP, "domain", "cls", [0, 1, 2], {"train": 0.7, "val": 0.15, "test": 0.15}, [5, 5, 3], trials=5000
    )
    return m.join(chosen, GROUP).groupBy("split", "cls").agg(F.count(F.lit(1)).alias("n"))


@query(
    "kfold_stratified",
    f"""
    select record_id, domain, label, cast((row_number() over (partition by domain, label order by {sql_hash(9, 'record_id')}, record_id) - 1) % 5 as integer) as fold
    from ({REC_SQL})
    """,
)
def kfold_stratified(t: Tables):
    return splits.kfold_stratified(records(t).drop("group_id"), ["domain", "label"], ["record_id"], 5, 9)


KFOLD_GROUPED_SQL = f"""
    with g as (select domain, group_id, count(*) as group_size from ({MEMBERS_SQL}) group by all),
    r as (select *, (row_number() over (order by group_size desc, domain, group_id) - 1) % 10 as turn from g)
    select domain, group_id, group_size, cast(case when turn < 5 then turn else 9 - turn end as integer) as fold from r"""


@query("kfold_grouped", KFOLD_GROUPED_SQL)
def kfold_grouped(t: Tables):
    return splits.kfold_grouped(members(t).select(*GROUP), GROUP, 5)


@query(
    "temporal_split",
    """
    select o_orderkey, case when year(o_orderdate) <= 1998 then 'train' else 'eval' end as split from orders
    where year(o_orderdate) between 1996 and 2000
    """,
)
def temporal_split(t: Tables):
    # Bounds on the date column itself, so that the scan can skip row groups.
    d = F.col("o_orderdate")
    inside = t.orders.where((d >= F.lit("1996-01-01").cast("timestamp_ntz")) & (d < F.lit("2001-01-01").cast("timestamp_ntz")))
    return inside.select("o_orderkey", F.when(F.year(d) <= 1998, "train").otherwise("eval").alias("split"))


@query(
    "domain_combinations",
    f"""
    with d as (select domain, count(*) as n, cast(sum(label) as bigint) as n_pos from ({REC_SQL}) group by 1),
    n as (select distinct c_mktsegment as d from customer),
    c as (select [a.d] as ts from n a union all select [a.d, b.d] from n a, n b where a.d < b.d
          union all select [a.d, b.d, c.d] from n a, n b, n c where a.d < b.d and b.d < c.d)
    select array_to_string(ts, '+') as train_set, case when list_contains(ts, domain) then 'train' else 'eval' end as role,
           count(*) as n_domains, cast(sum(n) as bigint) as n, cast(sum(n_pos) as bigint) as n_pos
    from c, d group by 1, 2
    """,
)
def domain_combinations(t: Tables):
    per = records(t).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"))
    # one row per segment: the list of segments is metadata
    names = [r["domain"] for r in per.select("domain").where("domain is not null").collect()]
    combos = splits.domain_combinations(names, [1, 2, 3])
    return splits.train_roles(per, "domain", combos).groupBy("train_set", "role").agg(
        F.count(F.lit(1)).alias("n_domains"), F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos")
    )


@query(
    "split_leakage",
    f"""
    with a as ({RANDOM_ARM_SQL})
    select seed, domain, group_id, min(split) as low, max(split) as high from a group by 1, 2, 3 having min(split) <> max(split)
    """,
)
def split_leakage(t: Tables):
    return splits.leaking_groups(random_arm(inherited(t)), ["seed", *GROUP])


@query(
    "sample_per_stratum",
    f"""
    select doc_id, lang, source from documents
    qualify row_number() over (partition by lang, source order by {sql_hash(13, 'doc_id')}, doc_id) <= 3
    """,
)
def sample_per_stratum(t: Tables):
    return splits.sample_per_stratum(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"], 3, 13)


@query(
    "shuffle_labels",
    f"""
    with r as ({REC_SQL}),
    a as (select record_id, domain, label, row_number() over (partition by domain order by {sql_hash(21, 'record_id')}, record_id) as k from r),
    b as (select domain, label as shuffled, row_number() over (partition by domain order by {sql_hash(22, 'record_id')}, record_id) as k from r)
    select record_id, domain, label, shuffled from a join b using (domain, k)
    """,
)
def shuffle_labels(t: Tables):
    out = splits.shuffle_values(records(t), ["domain"], ["record_id"], "label", 21, "shuffled")
    return out.select("record_id", "domain", "label", "shuffled")
