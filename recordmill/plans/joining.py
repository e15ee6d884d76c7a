"""Queries on joins and data-quality gates."""

from pyspark.sql import functions as F

from recordmill.functions import text
from recordmill.functions.hashing import hash_key, hash_unit, sql_hash
from recordmill.operators import gates, joins, timeline
from recordmill.operators.ordering import row_numbers
from recordmill.plans.cleaning import TIER1, TIER2, _sql_class
from recordmill.plans.common import FIRST_SQL, GROUP, MEMBERS_SQL, TARGET, members
from recordmill.plans.registry import Tables, query

LABELS_SQL = """
    select {g}, cast(count(*) filter (category <> 'unknown') >= 2 as int) as multi_category,
           cast(count(*) filter (category = '1-URGENT') > 0
                and count(*) filter (category not in ('unknown', '1-URGENT')) > 0 as int) as target_plus_other
    from ({first}) group by all"""


@query("join_validated", "select doc_id, lang, quality, toxic from documents join labels using (doc_id)")
def join_validated(t: Tables):
    docs = t.documents.select("doc_id", "lang")
    return joins.join_validated(docs, t.labels, ["doc_id"])


@query(
    "inherit_group_labels",
    """
    with first as (
      select user_id, event_type, min(ts) as first_ts from events where value > 100 group by all),
    lab as (
      select user_id, cast(count(*) >= 2 as int) as multi_category,
             cast(bool_or(event_type = 'purchase') and count(*) >= 2 as int) as target_plus_other
      from first group by 1)
    select event_id, e.user_id, coalesce(c_mktsegment, 'none') as domain,
           coalesce(multi_category, 0) as multi_category, coalesce(target_plus_other, 0) as target_plus_other
    from events e left join customer on c_custkey = e.user_id left join lab on lab.user_id = e.user_id
    """,
)
def inherit_group_labels(t: Tables):
    first = timeline.first_seen(
        t.events.where("value > 100"), ["user_id"], "event_type", "ts"
    )
    labels = timeline.group_labels(first, ["user_id"], "event_type", "purchase")
    groups = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("domain"))
    out = joins.lookup(t.events.select("event_id", "user_id"), groups, ["user_id"], {"domain": "none"})
    return joins.lookup(out, labels, ["user_id"], {"multi_category": 0, "target_plus_other": 0}).select(
        "event_id", "user_id", "domain", "multi_category", "target_plus_other"
    )


@query(
    "join_drop_report",
    """
    select count(*) filter (l.doc_id is not null) as n_kept, count(*) filter (l.doc_id is null) as n_dropped
    from documents d left join labels l using (doc_id)
    """,
)
def join_drop_report(t: Tables):
    return joins.drop_report(t.documents, t.labels, ["doc_id"])


@query(
    "semi_join",
    "select doc_id, source from documents where doc_id in (select doc_id from labels where toxic = 1)",
)
def semi_join(t: Tables):
    docs = t.documents.select("doc_id", "source")
    return docs.join(t.labels.where("toxic = 1"), "doc_id", "left_semi")


@query(
    "order_by_reference",
    """
    select c_custkey, c_name, ord from customer
    join (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as ord from customer)
    using (c_custkey)
    """,
)
def order_by_reference(t: Tables):
    ref = row_numbers(
        t.customer.select("c_custkey", "c_acctbal"), [], [F.desc("c_acctbal"), F.asc("c_custkey")], "ord"
    )
    return t.customer.select("c_custkey", "c_name").join(ref.select("c_custkey", "ord"), "c_custkey").orderBy("ord")


@query(
    "upsert_fill_missing",
    """
    with s as (select doc_id, case when quality = 1 then 'good' else 'unknown' end as category from labels),
    n as (select doc_id, case when n_chars > 2000 then 'auto' else 'unknown' end as category
          from documents where lang = 'en')
    select coalesce(s.doc_id, n.doc_id) as doc_id,
           case when s.doc_id is null then n.category
                when s.category = 'unknown' and coalesce(n.category, 'unknown') <> 'unknown' then n.category
                else s.category end as category,
           case when s.doc_id is null then 'insert'
                when s.category = 'unknown' and coalesce(n.category, 'unknown') <> 'unknown' then 'replace'
                else 'keep' end as action
    from s full outer join n on s.doc_id = n.doc_id
    """,
)
def upsert_fill_missing(t: Tables):
    stored = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("unknown").alias("category"))
    incoming = t.documents.where("lang = 'en'").select(
        "doc_id", F.when(F.col("n_chars") > 2000, "auto").otherwise("unknown").alias("category")
    )
    return joins.upsert_fill_missing(stored, incoming, ["doc_id"], "category")


CLASS_SQL = f"""
    select doc_id, source, coalesce({_sql_class('text', TIER1, True)}, 'unknown') as old_category,
           coalesce({_sql_class('text', TIER2, False)}, 'unknown') as new_category
    from documents"""


def _classes(t: Tables):
    return t.texts.select(
        "doc_id", "source", text.tiered_class(text.keyword_class("text", TIER1)).alias("old_category"),
        text.tiered_class(text.keyword_class("text", TIER2, plural=False)).alias("new_category"),
    )


@query(
    "improve_only",
    f"""
    select doc_id, case when new_category is distinct from old_category
           and (new_category <> 'unknown' or source in ('src2', 'src3')) then new_category
           else old_category end as category
    from ({CLASS_SQL})
    """,
)
def improve_only(t: Tables):
    garbage = F.col("source").isin("src2", "src3")
    out = text.improve_only(F.col("old_category"), F.col("new_category"), garbage)
    return _classes(t).select("doc_id", out.alias("category"))


@query(
    "preference_pairs",
    f"""
    with r as (
      select o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) as months,
             row_number() over (order by {sql_hash(7, 'o_orderkey')}, o_orderkey) as rn
      from orders),
    b as (select *, cast(floor((rn - 1) / 16.0) as bigint) as batch from r)
    select a.batch, a.o_orderkey as o_orderkey_i, b2.o_orderkey as o_orderkey_j,
           case when a.months > b2.months then 1 else -1 end as preference
    from b a join b b2 on a.batch = b2.batch and a.o_orderkey < b2.o_orderkey and a.months <> b2.months
    """,
)
def preference_pairs(t: Tables):
    rows = t.orders.select(
        "o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("months"),
        hash_key(7, "o_orderkey").alias("h"),
    )
    rows = row_numbers(rows, [], [F.asc("h"), F.asc("o_orderkey")])
    rows = rows.withColumn("batch", joins.batch_number(F.col("rn"), 16))
    return joins.batch_pairs(rows, "batch", "o_orderkey", "months").select(
        "batch", "o_orderkey_i", "o_orderkey_j", "preference"
    )


@query(
    "table_diff",
    f"""
    with a as (select doc_id, old_category as category from ({CLASS_SQL}) where source <> 'src4'),
    b as (select doc_id, new_category as category from ({CLASS_SQL}) where source <> 'src5')
    select coalesce(a.doc_id, b.doc_id) as doc_id,
           case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' else 'changed' end as change,
           a.category as old_category, b.category as new_category
    from a full outer join b on a.doc_id = b.doc_id
    where a.doc_id is null or b.doc_id is null or a.category is distinct from b.category
    """,
)
def table_diff(t: Tables):
    c = _classes(t)
    old = c.where("source <> 'src4'").select("doc_id", F.col("old_category").alias("category"))
    new = c.where("source <> 'src5'").select("doc_id", F.col("new_category").alias("category"))
    return joins.table_diff(old, new, ["doc_id"], ["category"])


# A correction sets the category of expensive pending orders back to unknown.
REVERTED_SQL = f"""
    select * replace (case when status = 'P' and price > 100000 then 'unknown' else category end as category)
    from ({MEMBERS_SQL})"""
REVERTED_FIRST_SQL = f"""
    select domain, group_id, category, min(ym) as first_ym from ({REVERTED_SQL})
    where ym is not null group by all"""
FLIPS_SQL = f"""
    select domain, group_id, 'changed' as change, a.multi_category as old_multi_category,
           a.target_plus_other as old_target_plus_other, b.multi_category as new_multi_category,
           b.target_plus_other as new_target_plus_other
    from ({LABELS_SQL.format(g='domain, group_id', first=FIRST_SQL)}) a
    join ({LABELS_SQL.format(g='domain, group_id', first=REVERTED_FIRST_SQL)}) b using (domain, group_id)
    where a.multi_category <> b.multi_category or a.target_plus_other <> b.target_plus_other"""


def _flips(m):
    reverted = m.withColumn(
        "category", F.when(F.expr("status = 'P' and price > 100000"), "unknown").otherwise(F.col("category"))
    )
    old, new = [
        timeline.group_labels(timeline.first_seen(x, GROUP, "category", "ym"), GROUP, "category", TARGET)
        for x in (m, reverted)
    ]
    return joins.table_diff(old, new, GROUP, ["multi_category", "target_plus_other"])


@query("label_flips", FLIPS_SQL)
def label_flips(t: Tables):
    m = members(t)
    return _flips(m)


@query(
    "audit_impact",
    f"""
    with f as ({FLIPS_SQL}), m as ({MEMBERS_SQL})
    select domain, count(distinct group_id) as n_flipped_groups, count(*) as n_records,
           count(*) filter (status = 'P' and price > 100000) as n_reverted,
           bool_or(group_id < 10) as touches_protected
    from m join f using (domain, group_id) group by 1
    """,
)
def audit_impact(t: Tables):
    m = members(t)
    flips = _flips(m).select(*GROUP, F.lit(1).alias("flip"))
    per_group = m.join(flips, GROUP).groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when((F.col("status") == "P") & (F.col("price") > 100000), 1)).alias("r"),
    )
    return per_group.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_flipped_groups"),
        F.sum("n").alias("n_records"),
        F.sum("r").alias("n_reverted"),
        F.bool_or(F.col("group_id") < 10).alias("touches_protected"),
    )


@query(
    "gate_unique",
    "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
)
def gate_unique(t: Tables):
    return gates.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "key_set_diff",
    """
    select count(*) filter (a.k is not null and b.k is not null) as n_both,
           count(*) filter (b.k is null) as n_left_only, count(*) filter (a.k is null) as n_right_only
    from (select distinct c_custkey as k from customer) a
    full outer join (select distinct o_custkey + 3 as k from orders) b on a.k = b.k
    """,
)
def key_set_diff(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("k"))
    b = t.orders.select((F.col("o_custkey") + 3).alias("k"))
    return gates.key_set_diff(a, b, ["k"])


@query(
    "gate_group_constant",
    """
    select l_orderkey, min(l_returnflag) as low, max(l_returnflag) as high, count(*) as n
    from lineitem group by 1 having min(l_returnflag) <> max(l_returnflag)
    """,
)
def gate_group_constant(t: Tables):
    return gates.varying_groups(t.lineitem, ["l_orderkey"], "l_returnflag")


@query(
    "gate_domain",
    """
    select count(*) as n, count(*) filter (quality is null) as n_null,
           count(*) filter (quality not in (1)) as n_outside
    from documents left join labels using (doc_id)
    """,
)
def gate_domain(t: Tables):
    return gates.allowed_values(t.documents.join(t.labels, "doc_id", "left"), "quality", [1])


@query(
    "gate_implication",
    f"""
    select count(*) filter (target_plus_other = 1) as n_premise,
           count(*) filter (target_plus_other = 1 and multi_category <> 1) as n_violation
    from ({LABELS_SQL.format(g='domain, group_id', first=FIRST_SQL)})
    """,
)
def gate_implication(t: Tables):
    first = timeline.first_seen(members(t), GROUP, "category", "ym")
    labels = timeline.group_labels(first, GROUP, "category", TARGET)
    return gates.implication(labels, F.col("target_plus_other") == 1, F.col("multi_category") == 1)


@query(
    "gate_equal_length",
    """
    select cast(min(length(c_name)) as integer) as min_len, cast(max(length(c_name)) as integer) as max_len,
           min(length(c_name)) = max(length(c_name)) as equal from customer
    """,
)
def gate_equal_length(t: Tables):
    return gates.equal_length(t.customer, "c_name")


@query(
    "gate_complete",
    """
    select count(*) as n, count(*) filter (l.doc_id is null) as n_unassigned
    from documents d left join labels l using (doc_id)
    """,
)
def gate_complete(t: Tables):
    marked = t.labels.select("doc_id", F.lit("labelled").alias("status"))
    return gates.unassigned(t.documents.join(marked, "doc_id", "left"), "status")


BANDS = {"mean_discount": (0.045, 0.055), "returned_share": (0.3, 0.4), "mean_tax": (0.05, 0.06)}


@query(
    "gate_band",
    """
    with m as (
      select 'mean_discount' as metric, l_linestatus as cell, avg(l_discount) as value from lineitem group by 2
      union all select 'returned_share', l_linestatus, avg((l_returnflag = 'R')::int) from lineitem group by 2
      union all select 'mean_tax', l_linestatus, avg(l_tax) from lineitem group by 2),
    b(metric, low, high) as (values ('mean_discount', 0.045::double, 0.055::double), ('returned_share', 0.3, 0.4), ('mean_tax', 0.05, 0.06))
    select metric, cell, round(value, 6) as value, low, high, coalesce(value between low and high, false) as inside from b left join m using (metric)
    """,
)
def gate_band(t: Tables):
    """Metrics of every line status against the bands they are expected in."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in BANDS]))
    found = t.lineitem.groupBy(F.col("l_linestatus").alias("cell")).agg(
        F.avg("l_discount").alias("mean_discount"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("returned_share"), F.avg("l_tax").alias("mean_tax")
    )
    out = gates.in_band(found.select("cell", cells.alias("c")).select("cell", "c.metric", "c.value"), BANDS)
    return out.withColumn("value", F.round("value", 6))


@query(
    "verify_sample",
    f"""
    with s as (select doc_id, n_chars, length(text) as again from documents
               where {sql_hash(11, 'doc_id')} / {float(1 << 60)!r} < 0.1)
    select count(*) as n_sampled, count(*) filter (n_chars <> again) as n_different,
           cast(max(abs(n_chars - again)) as bigint) as max_diff from s
    """,
)
def verify_sample(t: Tables):
    sample = t.documents.where(hash_unit(11, "doc_id") < 0.1)
    diff = F.abs(F.col("n_chars") - F.length("text"))
    return sample.agg(
        F.count(F.lit(1)).alias("n_sampled"), F.count(F.when(diff != 0, 1)).alias("n_different"),
        F.max(diff).alias("max_diff"),
    )
