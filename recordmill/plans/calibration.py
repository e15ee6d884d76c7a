"""Queries on calibration and tiers."""

from pyspark.sql import functions as F

from recordmill.operators import calibrate
from recordmill.plans.registry import Tables, query
from recordmill.plans.scores import _r

# A probability and its logit per line item; the truth is a returned item.
PROB_SQL = """
    select l_linestatus as cell, l_quantity / 50.5 as p, ln((l_quantity / 50.5) / (1 - l_quantity / 50.5)) as z,
           cast(l_returnflag = 'R' as int) as y from lineitem"""


def probs(t: Tables):
    p = F.col("l_quantity") / 50.5
    return t.lineitem.select(
        F.col("l_linestatus").alias("cell"), p.alias("p"), F.log(p / (1 - p)).alias("z"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


NLL = "-(y * ln(least(greatest({p}, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest({p}, 1e-7), 1 - 1e-7)))"


@query(
    "nll_brier",
    f"select cell, count(*) as n, round(avg({NLL.format(p='p')}), 6) as nll, round(avg((p - y) * (p - y)), 6) as brier from ({PROB_SQL}) group by 1",
)
def nll_brier(t: Tables):
    return _r(calibrate.nll_brier(probs(t), ["cell"], F.col("p"), F.col("y")), "nll", "brier")


# Discounts reach only a part of the unit interval, so some bins stay empty.
DISC_SQL = "select l_linestatus as cell, l_discount * 5 + 0.01 as p, cast(l_returnflag = 'R' as int) as y from lineitem"
BINS_SQL = f"""
    with b as (select cell, cast(least(floor(p * 15), 14) as integer) as bin, count(*) as n, avg(p) as mc, avg(y) as ef from ({DISC_SQL}) group by all),
    g as (select distinct cell, x.bin from b, (select cast(unnest(range(15)) as integer) as bin) x)
    select g.cell, g.bin, coalesce(n, 0) as n, mc, ef from g left join b on g.cell = b.cell and g.bin = b.bin"""


def discounts(t: Tables):
    return t.lineitem.select(
        F.col("l_linestatus").alias("cell"), (F.col("l_discount") * 5 + 0.01).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


@query(
    "reliability_bins",
    f"select cell, bin, round(bin / 15, 6) as lo, round((bin + 1) / 15, 6) as hi, n, round(mc, 6) as mean_conf, round(ef, 6) as emp_freq from ({BINS_SQL})",
)
def reliability_bins(t: Tables):
    out = calibrate.reliability_bins(discounts(t), ["cell"], F.col("p"), F.col("y"))
    return _r(out, "lo", "hi", "mean_conf", "emp_freq")


@query("ece", f"select cell, round(sum(n * abs(ef - mc)) / sum(n), 6) as ece from ({BINS_SQL}) group by 1")
def ece(t: Tables):
    bins = calibrate.reliability_bins(discounts(t), ["cell"], F.col("p"), F.col("y"))
    return _r(calibrate.ece_from_bins(bins, ["cell"]), "ece")


def _temperature_sql(points: int = 24, rounds: int = 3) -> str:
    half, parts, prev = 4.6, [f"s as ({PROB_SQL})", "c0 as (select distinct cell, 0.0::double as log_t from s)"], "c0"
    for r in range(1, rounds + 1):
        nll = NLL.format(p="(1 / (1 + exp(-z / exp(lt))))")
        parts.append(
            f"""g{r} as (select cell, lt, avg({nll}) as nll from (
              select s.cell, z, y, least(greatest(round(log_t + round({half!r}::double * (2 * i / {points} - 1), 12), 9), -4.6::double), 4.6::double) as lt
              from s join {prev} using (cell), range({points + 1}) x(i)) group by all),
            c{r} as (select cell, arg_min(lt, struct_pack(n := round(nll, 12), a := abs(lt))) as log_t, min(nll) as nll from g{r} group by 1)"""
        )
        half, prev = 2 * half / points, f"c{r}"
    return f"with {', '.join(parts)} select cell, round(exp(log_t), 5) as temperature, round(nll, 6) as nll from {prev}"


@query("fit_temperature", _temperature_sql())
def fit_temperature(t: Tables):
    out = calibrate.fit_temperature(probs(t), ["cell"], "z", "y")
    return out.select("cell", F.round("temperature", 5).alias("temperature"), F.round("nll", 6).alias("nll"))


@query(
    "calibration_report",
    f"""
    with v as (select cell, y, 'raw' as version, 1 / (1 + exp(-z)) as p from ({PROB_SQL})
               union all select cell, y, 'scaled', 1 / (1 + exp(-z / 4.0)) from ({PROB_SQL})),
    b as (select cell, version, least(floor(p * 15), 14) as bin, count(*) as n, avg(p) as mc, avg(y) as ef,
                 sum({NLL.format(p='p')}) as nll, sum((p - y) * (p - y)) as br from v group by all)
    select cell, version, cast(sum(n) as bigint) as n, round(sum(nll) / sum(n), 6) as nll, round(sum(br) / sum(n), 6) as brier,
           round(sum(n * abs(ef - mc)) / sum(n), 6) as ece from b group by all
    """,
)
def calibration_report(t: Tables):
    z = F.col("z")
    versions = {"raw": calibrate.sigmoid(z), "scaled": calibrate.sigmoid(z / 4.0)}
    return _r(calibrate.calibration_report(probs(t), ["cell"], versions, F.col("y")), "nll", "brier", "ece")


TIER_BASE_SQL = """
    select l_orderkey, l_linestatus as cell, year(l_shipdate) as yr, l_extendedprice as score,
           cast(l_quantity > 40 and l_discount > 0.02 as int) as label from lineitem"""
THRESHOLD_SQL = f"""
    select cell, quantile_cont(score, 0.5) filter (label = 1) as high, quantile_cont(score, 0.95) filter (label = 0) as mid
    from ({TIER_BASE_SQL}) where yr <= 1998 group by 1"""
TIERED_SQL = f"""
    select b.*, case when score >= high then 'high' when score >= mid then 'mid' else 'low' end as tier
    from ({TIER_BASE_SQL}) b join ({THRESHOLD_SQL}) using (cell) where yr > 1998"""


def tier_base(t: Tables):
    return t.lineitem.select(
        "l_orderkey", F.col("l_linestatus").alias("cell"), F.year("l_shipdate").alias("yr"),
        F.col("l_extendedprice").alias("score"),
        ((F.col("l_quantity") > 40) & (F.col("l_discount") > 0.02)).cast("int").alias("label"),
    )


def tiered(t: Tables):
    rows = tier_base(t)
    thresholds = calibrate.tier_thresholds(rows.where("yr <= 1998"), ["cell"], "score", "label")
    joined = rows.where("yr > 1998").join(thresholds, "cell")
    return joined.withColumn("tier", calibrate.tier(F.col("score"), F.col("high"), F.col("mid")))


@query(
    "tier_thresholds",
    f"select cell, round(high, 6) as high, round(mid, 6) as mid, high < mid as degenerate from ({THRESHOLD_SQL})",
)
def tier_thresholds(t: Tables):
    out = calibrate.tier_thresholds(tier_base(t).where("yr <= 1998"), ["cell"], "score", "label")
    return _r(out, "high", "mid")


@query(
    "assign_tiers",
    f"""
    select l_orderkey, cell, score, tier, case when cell = 'O' then 'validated' else 'unvalidated' end as domain_status
    from ({TIERED_SQL})
    """,
)
def assign_tiers(t: Tables):
    status = calibrate.domain_status(F.col("cell"), ["O"], ["X"])
    return tiered(t).select("l_orderkey", "cell", "score", "tier", status.alias("domain_status"))


@query(
    "tier_metrics",
    f"""
    with x as (select cell, label, 'high' as tier_set, tier = 'high' as hit from ({TIERED_SQL})
               union all select cell, label, 'mid_plus', tier <> 'low' from ({TIERED_SQL}))
    select cell, tier_set, count(*) filter (hit) as n, count(*) filter (hit and label = 1) as tp,
           round(count(*) filter (hit and label = 1) / nullif(count(*) filter (hit), 0), 6) as "precision",
           round(count(*) filter (hit and label = 1) / greatest(count(*) filter (label = 1), 1), 6) as recall,
           round(count(*) filter (hit and label = 0) / greatest(count(*) filter (label = 0), 1), 6) as fpr
    from x group by all
    """,
)
def tier_metrics(t: Tables):
    return _r(calibrate.tier_metrics(tiered(t), ["cell"], "tier", "label"), "precision", "recall", "fpr")
