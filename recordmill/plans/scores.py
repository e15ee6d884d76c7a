"""Queries on score metrics."""

from pyspark.sql import functions as F

from recordmill.functions import text
from recordmill.functions.hashing import sql_hash
from recordmill.operators import metrics, ranks
from recordmill.plans.registry import Tables, query

# Scored rows: one per line item. ``score`` has few ties, ``coarse`` has eleven distinct values.
SCORED_SQL = """
    select l_orderkey, l_linestatus as domain, cast(year(l_shipdate) as integer) as yr, l_returnflag as flag,
           l_extendedprice as score, l_discount as coarse, l_quantity as quantity,
           cast(l_returnflag = 'R' as int) as label from lineitem"""


def scored(t: Tables):
    return t.lineitem.select(
        "l_orderkey",
        F.col("l_linestatus").alias("domain"),
        F.year("l_shipdate").alias("yr"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_discount").alias("coarse"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def sql_auc(src: str, cells: str, score: str = "score", label: str = "label", weight: str = "1") -> str:
    """AUC per cell as SQL; ``cells`` is a comma-separated list (may be empty)."""
    c = f"{cells}, " if cells else ""
    part = f"partition by {cells}" if cells else ""
    group = f"group by {cells}" if cells else ""
    return f"""
    select {c}sum(p * (upto - n / 2.0)) / nullif(cast(sum(p) as double) * sum(n), 0) as auc,
           cast(sum(p) as bigint) as n_pos, cast(sum(n) as bigint) as n_neg
    from (select *, sum(n) over ({part} order by s) as upto from (
      select {c}{score} as s, cast(sum({label} * {weight}) as double) as p, cast(sum((1 - {label}) * {weight}) as double) as n
      from ({src}) where {score} is not null and {label} is not null group by all)) {group}"""


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("auc", f"select round(auc, 6) as auc, n_pos, n_neg from ({sql_auc(SCORED_SQL, '')})")
def auc(t: Tables):
    return _r(metrics.auc(scored(t), [], "score", "label"), "auc")


@query(
    "auc_both",
    f"""
    select domain, round(auc, 6) as auc, n_pos, n_neg, round(1 - auc, 6) as auc_flipped,
           round(greatest(auc, 1 - auc), 6) as auc_best from ({sql_auc(SCORED_SQL, 'domain', 'coarse')})
    """,
)
def auc_both(t: Tables):
    return _r(metrics.auc_both(scored(t), ["domain"], "coarse", "label"), "auc", "auc_flipped", "auc_best")


@query(
    "auc_by_cell",
    f"""
    with c as (select domain, yr, 'price' as candidate, score as v, label from ({SCORED_SQL})
               union all select domain, yr, 'quantity', quantity, label from ({SCORED_SQL})
               union all select domain, yr, 'discount', coarse, label from ({SCORED_SQL}))
    select domain, yr, candidate, round(auc, 6) as auc, n_pos, n_neg
    from ({sql_auc('select * from c', 'domain, yr, candidate', 'v')})
    """,
)
def auc_by_cell(t: Tables):
    long = scored(t).select("domain", "yr", "label", F.col("score").alias("price"), "quantity", F.col("coarse").alias("discount"))
    long = long.unpivot(["domain", "yr", "label"], ["price", "quantity", "discount"], "candidate", "v")
    return _r(metrics.auc(long, ["domain", "yr", "candidate"], "v", "label"), "auc")


@query(
    "binary_metrics",
    f"""
    with c as (
      select domain, count(*) as n, count(*) filter (p and label = 1) as tp, count(*) filter (p and label = 0) as fp,
             count(*) filter (not p and label = 1) as fn, count(*) filter (not p and label = 0) as tn
      from (select *, score >= 40000 as p from ({SCORED_SQL})) group by 1)
    select *, round((tp + tn) / n, 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as "precision",
           round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round((tp + fn) / n, 6) as positive_rate,
           round(coalesce((tp * 1.0 * tn - fp * 1.0 * fn) /
             nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) as mcc
    from c
    """,
)
def binary_metrics(t: Tables):
    out = metrics.binary_metrics(scored(t), ["domain"], F.col("score") >= 40000, "label")
    return _r(out, "accuracy", "precision", "recall", "f1", "positive_rate", "mcc")


CURVE_SQL = """
    select {c}s, p, n, sum(p) over ({part} order by s desc) as tp, sum(n) over ({part} order by s desc) as fp,
           sum(p) over ({part}) as n_pos, sum(n) over ({part}) as n_neg
    from (select {c}{score} as s, sum(label) as p, sum(1 - label) as n from ({src}) group by all)"""


@query(
    "average_precision",
    f"""
    select domain, round(sum(p * tp / (tp + fp)) / sum(p), 6) as average_precision, cast(sum(p) as bigint) as n_pos
    from ({CURVE_SQL.format(c='domain, ', part='partition by domain', score='score', src=SCORED_SQL)}) group by 1
    """,
)
def average_precision(t: Tables):
    return _r(metrics.average_precision(scored(t), ["domain"], "score", "label"), "average_precision")


@query(
    "youden_mcc",
    f"""
    with v as (select * from ({SCORED_SQL}) where yr <= 1998),
    pts as (select domain, s, tp / n_pos - fp / n_neg as j
            from ({CURVE_SQL.format(c='domain, ', part='partition by domain', score='quantity', src='select * from v')})),
    thr as (select domain, arg_max(s, struct_pack(j := round(j, 12), s := s)) as threshold, max(j) as j from pts group by 1),
    c as (
      select domain, threshold, j, count(*) filter (quantity >= threshold and label = 1) as tp,
             count(*) filter (quantity >= threshold and label = 0) as fp,
             count(*) filter (quantity < threshold and label = 1) as fn, count(*) filter (quantity < threshold and label = 0) as tn
      from ({SCORED_SQL}) join thr using (domain) where yr > 1998 group by all)
    select domain, threshold, round(j, 6) as youden_j,
           round(coalesce((tp * 1.0 * tn - fp * 1.0 * fn) /
             nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) as test_mcc
    from c
    """,
)
def youden_mcc(t: Tables):
    val, test = scored(t).where("yr <= 1998"), scored(t).where("yr > 1998")
    threshold = metrics.youden_threshold(val, ["domain"], "quantity", "label")
    joined = test.join(threshold, "domain")
    out = metrics.binary_metrics(
        joined, ["domain", "threshold", "youden_j"], F.col("quantity") >= F.col("threshold"), "label"
    )
    return _r(out.select("domain", "threshold", "youden_j", F.col("mcc").alias("test_mcc")), "youden_j", "test_mcc")


@query(
    "roc_points",
    f"""
    select domain, s as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(n_pos as bigint) as n_pos,
           cast(n_neg as bigint) as n_neg, round(tp / n_pos, 6) as tpr, round(fp / n_neg, 6) as fpr
    from ({CURVE_SQL.format(c='domain, ', part='partition by domain', score='quantity', src=SCORED_SQL)})
    """,
)
def roc_points(t: Tables):
    return _r(metrics.roc_points(scored(t), ["domain"], "quantity", "label"), "tpr", "fpr")


PRED_SQL = f"""
    select *, case when coarse < 0.03 then 'A' when coarse < 0.07 then 'N' else 'R' end as pred from ({SCORED_SQL})"""
MULTI_SQL = """
    with m as ({src}),
    k as (select distinct {c}unnest([{y}, {q}]) as cls from m),
    g as (
      select {ck}k.cls, sum(w) filter (m.{y} = k.cls) as nt, sum(w) filter (m.{q} = k.cls) as nq,
             sum(w) filter (m.{y} = k.cls and m.{q} = k.cls) as h
      from m join k on {on} group by all)
    select {c}round(sum(coalesce(h, 0)) / sum(nt), 6) as accuracy,
           round(avg(coalesce(h, 0) / nt) filter (nt > 0), 6) as balanced_accuracy,
           round(avg(2 * coalesce(h, 0) / (coalesce(nt, 0) + coalesce(nq, 0))), 6) as macro_f1,
           cast(sum(nt) as bigint) as n, count(*) filter (nt > 0) as n_classes
    from g {gb}"""


def with_pred(t: Tables):
    c = F.col("coarse")
    return scored(t).withColumn("pred", F.when(c < 0.03, "A").when(c < 0.07, "N").otherwise("R"))


@query(
    "multiclass_metrics",
    MULTI_SQL.format(
        src=f"select *, 1 as w from ({PRED_SQL})", c="domain, ", ck="m.domain, ", y="flag", q="pred",
        on="m.domain = k.domain", gb="group by 1",
    ),
)
def multiclass_metrics(t: Tables):
    out = metrics.multiclass_metrics(with_pred(t), ["domain"], "flag", "pred")
    return _r(out, "accuracy", "balanced_accuracy", "macro_f1")


@query(
    "class_recall",
    f"""
    select domain, flag as cls, count(*) as n_true, count(*) filter (flag = pred) as hits,
           round(count(*) filter (flag = pred) / count(*), 6) as recall from ({PRED_SQL}) group by all
    """,
)
def class_recall(t: Tables):
    table = metrics.class_table(with_pred(t), ["domain"], "flag", "pred").where("n_true > 0")
    recall = F.round(F.col("hits") / F.col("n_true"), 6)
    return table.select("domain", "cls", "n_true", "hits", recall.alias("recall"))


@query(
    "regression_metrics",
    f"""
    select domain, count(*) as n, round(avg(abs(q - y)), 4) as mae, round(sqrt(avg((q - y) * (q - y))), 4) as rmse,
           round(1 - avg((q - y) * (q - y)) / var_pop(y), 6) as r2, round(corr(y, q), 6) as pearson
    from (select domain, score as y, quantity * 1500 as q from ({SCORED_SQL})) group by 1
    """,
)
def regression_metrics(t: Tables):
    rows = scored(t).select("domain", F.col("score").alias("y"), (F.col("quantity") * 1500).alias("q"))
    out = metrics.regression_metrics(rows, ["domain"], "y", "q")
    return out.withColumns(
        {"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "r2": F.round("r2", 6), "pearson": F.round("pearson", 6)}
    )


@query(
    "spearman",
    f"""
    with r as (
      select domain, rank() over (partition by domain order by score) + (count(*) over (partition by domain, score) - 1) / 2.0 as rx,
             rank() over (partition by domain order by quantity) + (count(*) over (partition by domain, quantity) - 1) / 2.0 as ry
      from ({SCORED_SQL}))
    select domain, count(*) as n, round(corr(rx, ry), 6) as spearman from r group by 1
    """,
)
def spearman(t: Tables):
    return _r(metrics.spearman(scored(t), ["domain"], "score", "quantity"), "spearman")


@query(
    "kendall_tau",
    """
    with p as (
      select o_orderstatus as cell, cast(year(o_orderdate) * 12 + month(o_orderdate) as integer) as x,
             floor(o_totalprice / 5000) as y, count(*) as w from orders group by all),
    pr as (select a.cell, sum(case when b.y > a.y then a.w * b.w else 0 end) as c,
                  sum(case when b.y < a.y then a.w * b.w else 0 end) as d
           from p a join p b on a.cell = b.cell and a.x < b.x group by 1),
    t0 as (select cell, sum(w) as t from p group by 1), tx as (select cell, x, sum(w) as t from p group by all),
    ty as (select cell, y, sum(w) as t from p group by all)
    select pr.cell, cast(c as double) as concordant, cast(d as double) as discordant,
           round((c - d) / (sqrt(max(t0.t * (t0.t - 1) / 2) - (select sum(t * (t - 1) / 2) from tx where tx.cell = pr.cell)) *
                      sqrt(max(t0.t * (t0.t - 1) / 2) - (select sum(t * (t - 1) / 2) from ty where ty.cell = pr.cell))), 6) as tau_b
    from pr join t0 on t0.cell = pr.cell group by pr.cell, c, d
    """,
)
def kendall_tau(t: Tables):
    rows = t.orders.select(
        F.col("o_orderstatus").alias("cell"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("x"),
        F.floor(F.col("o_totalprice") / 5000).alias("y"),
    )
    return _r(metrics.kendall_tau(rows, ["cell"], "x", "y"), "tau_b")


@query(
    "baseline_majority",
    MULTI_SQL.format(
        src=f"""select flag, 1 as w, (select flag from ({SCORED_SQL}) where yr <= 1998 group by flag
                order by count(*) desc, flag limit 1) as pred from ({SCORED_SQL}) where yr > 1998""",
        c="", ck="", y="flag", q="pred", on="true", gb="",
    ),
)
def baseline_majority(t: Tables):
    modal = metrics.majority_class(scored(t).where("yr <= 1998"), "flag")
    test = scored(t).where("yr > 1998").withColumn("pred", modal.scalar())
    return _r(metrics.multiclass_metrics(test, [], "flag", "pred"), "accuracy", "balanced_accuracy", "macro_f1")


RANDOM_SQL = f"""
    with tr as (select o_orderpriority as c, count(*) as n from orders where year(o_orderdate) <= 1998 group by 1),
    sh as (select c, sum(n) over (order by c) / sum(n) over () as upto from tr),
    te as (select o_orderkey, o_orderpriority as y, run from orders, range(10) r(run) where year(o_orderdate) > 1998),
    u as (select run, y, {sql_hash(5, 'run', 'o_orderkey')} / {float(1 << 60)!r} as u from te)
    select run, y, (select min(c) from sh where upto > u) as q, 1 as w from u"""


@query(
    "baseline_random",
    f"""
    with per as ({MULTI_SQL.format(src=RANDOM_SQL, c='run, ', ck='m.run, ', y='y', q='q', on='m.run = k.run', gb='group by 1')})
    select count(*) as n_runs, round(avg(accuracy), 5) as accuracy_mean, round(stddev_pop(accuracy), 5) as accuracy_sd,
           round(avg(macro_f1), 5) as macro_f1_mean, round(stddev_pop(macro_f1), 5) as macro_f1_sd from per
    """,
)
def baseline_random(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("y"), F.year("o_orderdate").alias("yr"))
    drawn = metrics.random_baseline(rows.where("yr <= 1998"), rows.where("yr > 1998"), "y", ["o_orderkey"], 10, 5)
    per = _r(metrics.multiclass_metrics(drawn, ["run"], "y", "drawn"), "accuracy", "macro_f1")
    return per.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.round(F.avg("accuracy"), 5).alias("accuracy_mean"), F.round(F.stddev_pop("accuracy"), 5).alias("accuracy_sd"),
        F.round(F.avg("macro_f1"), 5).alias("macro_f1_mean"), F.round(F.stddev_pop("macro_f1"), 5).alias("macro_f1_sd"),
    )


@query("rank_biserial", f"select domain, round(2 * auc - 1, 6) as rank_biserial from ({sql_auc(SCORED_SQL, 'domain')})")
def rank_biserial(t: Tables):
    out = metrics.auc(scored(t), ["domain"], "score", "label")
    return out.select("domain", F.round(2 * F.col("auc") - 1, 6).alias("rank_biserial"))


@query(
    "sign_test",
    f"""
    with a as ({sql_auc(SCORED_SQL, 'domain, yr')}),
    c as (select domain, count(*) filter (auc < 0.5) as k, count(*) as n from a group by 1)
    select domain, k, n, round(least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1),
           lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 6) as p from c
    """,
)
def sign_test(t: Tables):
    a = metrics.auc(scored(t), ["domain", "yr"], "score", "label")
    c = a.groupBy("domain").agg(F.count(F.when(F.col("auc") < 0.5, 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.round(metrics.sign_test_p(F.col("k"), F.col("n")), 6))


# p values per part: two-sided sign test of its prices against the median price.
PART_SIGN_SQL = """
    with med as (select median(l_extendedprice) as m from lineitem),
    c as (select l_partkey, count(*) filter (l_extendedprice > m) as k, count(*) as n from lineitem, med group by 1),
    p as (select *, least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1),
           lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) as p from c)"""


@query(
    "bh_adjust",
    f"""{PART_SIGN_SQL},
    r as (select *, round(p, 9) as pr from p),
    s as (select *, row_number() over (order by pr, l_partkey) as rk, count(*) over () as m from r)
    select l_partkey, k, n, round(pr, 6) as p, round(min(least(pr * m / rk, 1.0)) over (order by rk desc), 6) as q from s
    """,
)
def bh_adjust(t: Tables):
    rows = t.lineitem.select("l_partkey", "l_extendedprice")
    median = ranks.exact_quantiles(rows, [], "l_extendedprice", {"m": 0.5})
    c = rows.withColumn("m", median.scalar()).groupBy("l_partkey").agg(
        F.count(F.when(F.col("l_extendedprice") > F.col("m"), 1)).alias("k"), F.count(F.lit(1)).alias("n")
    )
    p = c.withColumn("p", F.round(metrics.sign_test_p(F.col("k"), F.col("n")), 9))
    return _r(metrics.bh_adjust(p, [], "p", ["l_partkey"]), "p", "q")


@query(
    "fisher_2x2",
    """
    with c as (
      select yr, count(*) filter (hit and late) as a, count(*) filter (hit and not late) as b,
             count(*) filter (not hit and late) as c, count(*) filter (not hit and not late) as d
      from (select year(o_orderdate) as yr, o_totalprice > 450000 as hit, o_orderstatus = 'P' as late from orders) group by 1),
    x as (select *, list_transform(range(greatest(0, (a + b) + (a + c) - (a + b + c + d)), least(a + b, a + c) + 1),
             lambda k: lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1)
                       - lgamma(a + c - k + 1) - lgamma(c + d - (a + c - k) + 1)
                       - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1))) as lw,
             lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + lgamma(c + d + 1) - lgamma(c + 1) - lgamma(d + 1)
               - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1)) as seen from c)
    select cast(yr as integer) as yr, a, b, c, d, round(a * d / nullif(b * c, 0), 6) as odds,
           round(least(1.0, list_sum(list_transform(list_filter(lw, lambda w: w <= seen + 1e-7), lambda w: exp(w)))), 6) as p from x
    """,
)
def fisher_2x2(t: Tables):
    hit, late = F.col("o_totalprice") > 450000, F.col("o_orderstatus") == "P"
    counts = t.orders.groupBy(F.year("o_orderdate").alias("yr")).agg(
        F.count(F.when(hit & late, 1)).alias("a"), F.count(F.when(hit & ~late, 1)).alias("b"),
        F.count(F.when(~hit & late, 1)).alias("c"), F.count(F.when(~hit & ~late, 1)).alias("d"),
    )
    a, b, c, d = [F.col(x) for x in "abcd"]
    odds = a * d / F.nullif(b * c, F.lit(0))
    return _r(counts.withColumn("odds", odds).withColumn("p", metrics.fisher_p(a, b, c, d)), "odds", "p")


@query(
    "js_divergence",
    r"""
    with w as (select lang, unnest(regexp_extract_all(lower(text), '\p{L}')) as ch from documents),
    n as (select lang, ch, count(*) as c from w group by all),
    g as (select l.lang as part, n.ch, coalesce(sum(c) filter (n.lang = l.lang), 0) as a, coalesce(sum(c) filter (n.lang <> l.lang), 0) as b
          from n, (select distinct lang from documents) l group by all),
    s as (select part, ch, a, b, sum(a) over (partition by part) as na, sum(b) over (partition by part) as nb from g)
    select part as lang, cast(max(na) as bigint) as n_a, cast(max(nb) as bigint) as n_b,
           round(sqrt(sum(case when a > 0 then a / na * log2((a / na) / ((a / na + b / nb) / 2)) else 0 end +
                          case when b > 0 then b / nb * log2((b / nb) / ((a / na + b / nb) / 2)) else 0 end) / 2), 6) as js_distance
    from s group by 1
    """,
)
def js_divergence(t: Tables):
    # Characters are counted in the texts' batches; what a letter is and lower case stay with Spark.
    low = t.texts.select("lang", F.lower("text").alias("low")).where("low is not null")
    chars = low.mapInArrow(text.count_characters, f"lang {dict(low.dtypes)['lang']}, ch string, n bigint")
    counts = chars.groupBy("lang", "ch").agg(F.sum("n").alias("n")).where(F.col("ch").rlike(r"^\p{L}$"))
    # One side per language: its own letters against those of all other languages.
    total = counts.groupBy("ch").agg(F.sum("n").alias("all_n"))
    langs = counts.agg(F.collect_set("lang")).scalar()
    grid = total.withColumn("lang", F.explode(langs)).join(counts, ["lang", "ch"], "left")
    grid = grid.select("lang", "ch", F.coalesce("n", F.lit(0)).alias("a"), "all_n").withColumn("b", F.col("all_n") - F.col("a"))
    out = metrics.js_from_counts(grid, ["lang"], "a", "b", min_count=100)
    return _r(out, "js_distance")


@query(
    "score_geometry",
    f"""
    select domain, round(avg(cast(s < 0 as int)), 6) as share_below_0, round(avg(s) filter (label = 1), 6) as mean_pos,
           round(avg(s) filter (label = 0), 6) as mean_neg,
           round(avg(cast(s < 0 as int)) filter (label = 1), 6) as share_below_0_pos
    from (select domain, label, quantity - 25.5 as s from ({SCORED_SQL})) group by 1
    """,
)
def score_geometry(t: Tables):
    s, below = F.col("s"), (F.col("s") < 0).cast("int")
    rows = scored(t).select("domain", "label", (F.col("quantity") - 25.5).alias("s"))
    out = rows.groupBy("domain").agg(
        F.avg(below).alias("share_below_0"), F.avg(F.when(F.col("label") == 1, s)).alias("mean_pos"),
        F.avg(F.when(F.col("label") == 0, s)).alias("mean_neg"),
        F.avg(F.when(F.col("label") == 1, below)).alias("share_below_0_pos"),
    )
    return _r(out, "share_below_0", "mean_pos", "mean_neg", "share_below_0_pos")


@query(
    "profile_spearman",
    f"""
    with p as (select flag, yr, avg(quantity) as v from ({SCORED_SQL}) group by all),
    j as (select a.flag as candidate_a, b.flag as candidate_b, a.v as x, b.v as y from p a join p b on a.yr = b.yr and a.flag < b.flag),
    r as (select candidate_a, candidate_b, rank() over (partition by candidate_a, candidate_b order by x) as rx,
                 rank() over (partition by candidate_a, candidate_b order by y) as ry from j)
    select candidate_a, candidate_b, count(*) as n, round(corr(rx, ry), 6) as spearman from r group by all
    """,
)
def profile_spearman(t: Tables):
    # Profiles are aggregates: one row per candidate and year.
    p = scored(t).groupBy("flag", "yr").agg(F.avg("quantity").alias("v"))
    a = p.select("yr", F.col("flag").alias("candidate_a"), F.col("v").alias("x"))
    b = p.select("yr", F.col("flag").alias("candidate_b"), F.col("v").alias("y"))
    pairs = a.join(b, "yr").where("candidate_a < candidate_b")
    return _r(metrics.spearman(pairs, ["candidate_a", "candidate_b"], "x", "y"), "spearman")
