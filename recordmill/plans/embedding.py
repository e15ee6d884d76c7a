"""Queries on vectors, reference sets and linear models."""

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from recordmill.functions import text
from recordmill.functions import vectors as V
from recordmill.functions.hashing import sql_hash
from recordmill.operators import metrics, probes, vectors
from recordmill.plans.registry import Tables, query
from recordmill.plans.scores import _r, sql_auc

# Fixed weights: two readout directions of 64 numbers.
W_A = [((j * 37) % 11 - 5) / 10 for j in range(64)]
W_B = [((j * 23) % 13 - 6) / 10 for j in range(64)]

# domain: label modulo 5; positive: label 5 and above; train: domains 0 to 2.
E_SQL = """
    select vec_id, label, cast(label % 5 as integer) as domain, cast(label >= 5 as int) as y,
           embedding::double[] as x from embeddings"""
LONG_SQL = f"""
    select vec_id, label, domain, y, unnest(x) as v, cast(generate_subscripts(x, 1) - 1 as integer) as dim from ({E_SQL})"""


def emb(t: Tables):
    return t.embeddings.select(
        "vec_id", "label", F.pmod("label", F.lit(5)).alias("domain"), (F.col("label") >= 5).cast("int").alias("y"),
        V.doubles("embedding").alias("x"),
    )


def _arr(w) -> str:
    return "[" + ", ".join(repr(float(x)) for x in w) + "]::double[]"


def _sql_dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


@query(
    "standardize_dims",
    f"""
    with l as ({LONG_SQL}), s as (select dim, avg(v) as m, stddev_pop(v) as sd from l where domain <= 2 group by 1)
    select vec_id, dim, round((v - m) / sd, 5) as z from l join s using (dim)
    """,
)
def standardize_dims(t: Tables):
    e = emb(t)
    z = vectors.standardize(e.where("domain <= 2"), e, "x")
    return z.select("vec_id", F.posexplode("z").alias("dim", "z")).withColumn("z", F.round("z", 5))


@query("linear_score", f"select vec_id, round({_sql_dot('x', _arr(W_A))} + 0.25, 6) as score from ({E_SQL})")
def linear_score(t: Tables):
    return emb(t).select("vec_id", F.round(V.dot(F.col("x"), V.literal(W_A)) + 0.25, 6).alias("score"))


def _sims_sql(ref: str, noself: bool = False) -> str:
    where = "where q.vec_id <> r.vec_id" if noself else ""
    return f"""
    select q.vec_id, list_cosine_similarity(q.x, r.x) as sim from ({E_SQL}) q join (select * from ({E_SQL}) where {ref}) r on true {where}"""


@query(
    "ref_max_similarity",
    f"""
    select vec_id, round(max(sim), 6) as max_sim, round(avg(sim) filter (rn <= 5), 6) as topk_mean
    from (select *, row_number() over (partition by vec_id order by sim desc) as rn from ({_sims_sql('label = 3')})) group by 1
    """,
)
def ref_max_similarity(t: Tables):
    e = emb(t)
    return _r(vectors.reference_similarity(e, e.where("label = 3"), "vec_id", "x", k=5), "max_sim", "topk_mean")


@query("ref_max_similarity_noself", f"select vec_id, round(max(sim), 6) as max_sim from ({_sims_sql('label = 3', True)}) group by 1")
def ref_max_similarity_noself(t: Tables):
    e = emb(t)
    out = vectors.reference_similarity(e, e.where("label = 3"), "vec_id", "x", exclude_self=True)
    return _r(out.select("vec_id", "max_sim"), "max_sim")


@query(
    "ref_similarity_diff",
    f"""
    select vec_id, round(a.m - b.m, 6) as diff from (select vec_id, max(sim) as m from ({_sims_sql('label = 3')}) group by 1) a
    join (select vec_id, max(sim) as m from ({_sims_sql('label <> 3')}) group by 1) b using (vec_id)
    """,
)
def ref_similarity_diff(t: Tables):
    e = emb(t)
    near = vectors.reference_similarity(e, e.where("label = 3"), "vec_id", "x").select("vec_id", F.col("max_sim").alias("a"))
    rest = vectors.reference_similarity(e, e.where("label <> 3"), "vec_id", "x").select("vec_id", F.col("max_sim").alias("b"))
    return near.join(rest, "vec_id").select("vec_id", F.round(F.col("a") - F.col("b"), 6).alias("diff"))


@query(
    "topk_mean_similarity",
    f"""
    select vec_id, round(avg(sim), 6) as topk_mean from (
      select * from ({_sims_sql('y = 1', True)}) qualify row_number() over (partition by vec_id order by sim desc) <= 10) group by 1
    """,
)
def topk_mean_similarity(t: Tables):
    e = emb(t)
    out = vectors.reference_similarity(e, e.where("y = 1"), "vec_id", "x", k=10, exclude_self=True)
    return _r(out.select("vec_id", "topk_mean"), "topk_mean")


@query(
    "positional_identity",
    """
    select c_custkey, round(len(list_filter(range(1, 19), lambda i: substr(c_name, i, 1) = substr(s_name, i, 1) and substr(c_name, i, 1) <> '0')) /
           nullif(len(list_filter(range(1, 19), lambda i: substr(c_name, i, 1) <> '0' and substr(s_name, i, 1) <> '0')), 0), 6) as identity
    from customer join supplier on s_nationkey = c_nationkey and s_suppkey = c_custkey % (select count(*) from supplier)
    """,
)
def positional_identity(t: Tables):
    suppliers = t.supplier.agg(F.count(F.lit(1))).scalar()
    pairs = t.customer.withColumn("s_suppkey", F.pmod(F.col("c_custkey"), suppliers)).join(t.supplier, "s_suppkey").where("s_nationkey = c_nationkey")
    share = text.positional_identity(F.col("c_name"), F.col("s_name"), gap="0")
    return pairs.select("c_custkey", F.round(share, 6).alias("identity"))


@query("centroids", f"select domain, y, dim, round(avg(v), 6) as value from ({LONG_SQL}) group by all")
def centroids(t: Tables):
    return _r(vectors.dimensions(vectors.moments(emb(t), ["domain", "y"], "x"), ["domain", "y"], "mean", "value"), "value")


# Direction: mean of positives minus mean of negatives over the training domains.
DIRECTION_SQL = f"""
    select list(d order by dim) as dir from (
      select dim, avg(v) filter (y = 1) - avg(v) filter (y = 0) as d from ({LONG_SQL}) where domain <= 2 group by 1)"""


def direction(e):
    m = vectors.moments(e.where("domain <= 2"), ["y"], "x").groupBy().agg(
        F.max(F.when(F.col("y") == 1, F.col("mean"))).alias("p"), F.max(F.when(F.col("y") == 0, F.col("mean"))).alias("n")
    )
    return m.select(V.subtract(F.col("p"), F.col("n")).alias("dir"))


@query(
    "cosine_to_direction",
    f"select vec_id, round(list_cosine_similarity(x, dir), 6) as cos from ({E_SQL}), ({DIRECTION_SQL})",
)
def cosine_to_direction(t: Tables):
    e = emb(t)
    d = e.withColumn("dir", direction(e).scalar())
    return d.select("vec_id", F.round(V.cosine(F.col("x"), F.col("dir")), 6).alias("cos"))


@query(
    "project_direction",
    f"select vec_id, round({_sql_dot('x', 'dir')} / sqrt({_sql_dot('dir', 'dir')}), 6) as projection from ({E_SQL}), ({DIRECTION_SQL})",
)
def project_direction(t: Tables):
    e = emb(t)
    d = e.withColumn("dir", direction(e).scalar())
    along = V.dot(F.col("x"), F.col("dir")) / V.norm(F.col("dir"))
    return d.select("vec_id", F.round(along, 6).alias("projection"))


@query(
    "gap_decomposition",
    f"""
    with s as (select domain, y, {_sql_dot('x', _arr(W_A))} as s from ({E_SQL})),
    tr as (select avg(s) as m from s where domain <= 2)
    select domain, round(avg(s) - max(m), 6) as "offset", round(avg(s) filter (y = 1) - avg(s), 6) as within_pos,
           round(avg(s) filter (y = 0) - avg(s), 6) as within_neg, round(avg(s) filter (y = 1) - avg(s) filter (y = 0), 6) as gap
    from s, tr group by 1
    """,
)
def gap_decomposition(t: Tables):
    # The score of a centroid is the mean score, so the decomposition needs means of scores only.
    s = emb(t).select("domain", "y", V.dot(F.col("x"), V.literal(W_A)).alias("s"))
    base = s.where("domain <= 2").agg(F.avg("s")).scalar()
    per = s.groupBy("domain").agg(
        F.avg("s").alias("m"), F.avg(F.when(F.col("y") == 1, F.col("s"))).alias("p"),
        F.avg(F.when(F.col("y") == 0, F.col("s"))).alias("n"),
    )
    out = per.withColumn("base", base).select(
        "domain", (F.col("m") - F.col("base")).alias("offset"), (F.col("p") - F.col("m")).alias("within_pos"),
        (F.col("n") - F.col("m")).alias("within_neg"), (F.col("p") - F.col("n")).alias("gap"),
    )
    return _r(out, "offset", "within_pos", "within_neg", "gap")


@query(
    "variance_ratio",
    f"""
    with l as ({LONG_SQL}), a as (select dim, avg(v) as m from l group by 1),
    d as (select domain, dim, avg(v) as md, var_pop(v) as vd from l group by all),
    g as (select domain, sum((md - m) * (md - m)) as b, sum(vd) as w from d join a using (dim) group by 1)
    select round(avg(b), 6) as "between", round(avg(w), 6) as within, round(avg(b) / (avg(w) + 1e-12), 6) as ratio from g
    """,
)
def variance_ratio(t: Tables):
    return _r(vectors.variance_ratio(emb(t), "domain", "x"), "between", "within", "ratio")


# Axes: the label axis of every domain, then the difference of each domain's centre to the next; made orthogonal in this order.
def _axes_sql() -> str:
    """Energy of W_A along nine orthogonal axes and the rest, by Gram-Schmidt written out."""
    steps = [f"""
    c as (select domain, y, list(v order by dim) as m from (select domain, y, dim, avg(v) as v from ({LONG_SQL}) group by all) group by all),
    p as (select domain, max(m) filter (y = 1) as pos, max(m) filter (y = 0) as neg from c group by 1),
    a as (
      select domain as k, list_transform(range(1, 65), lambda i: pos[i] - neg[i]) as a from p
      union all
      select 5 + x.domain, list_transform(range(1, 65), lambda i: (x.pos[i] + x.neg[i]) / 2 - (y.pos[i] + y.neg[i]) / 2)
      from p x join p y on y.domain = x.domain + 1),
    q0 as (select list_transform(a, lambda v: v / sqrt(list_inner_product(a, a))) as q from a where k = 0)"""]
    for k in range(1, 9):
        steps.append(f"""
    o{k} as (select {"list_transform(range(1, 65), lambda i: a[i] - " + " - ".join(f"list_inner_product(a, q{j}.q) * q{j}.q[i]" for j in range(k)) + ")"} as o
           from a, {", ".join(f"q{j}" for j in range(k))} where k = {k}),
    q{k} as (select list_transform(o, lambda v: v / sqrt(list_inner_product(o, o))) as q from o{k})""")
    names = [f"label_axis_{d}" for d in range(5)] + [f"domain_axis_{d}_{d + 1}" for d in range(4)]
    parts = " union all ".join(f"select '{n}' as axis, pow(list_inner_product(q, {_arr(UNIT_A)}), 2) as share from q{k}" for k, n in enumerate(names))
    return f"""
    with {",".join(steps)}, s as ({parts})
    select axis, round(share, 6) as share from s union all select 'rest', round(1 - sum(share), 6) from s"""


UNIT_A = [w / sum(x * x for x in W_A) ** 0.5 for w in W_A]


@query("axis_shares", _axes_sql())
def axis_shares(t: Tables):
    """Shares of a readout direction along the label axis of every domain, the steps between domain centres, and the rest."""
    m = {(r.domain, r.y): np.array(r.mean) for r in vectors.moments(emb(t), ["domain", "y"], "x").collect()}
    domains = sorted({d for d, _ in m})
    centre = {d: (m[d, 1] + m[d, 0]) / 2 for d in domains}
    axes = {f"label_axis_{d}": m[d, 1] - m[d, 0] for d in domains}
    axes |= {f"domain_axis_{a}_{b}": centre[a] - centre[b] for a, b in zip(domains, domains[1:])}
    shares = probes.axis_shares(list(axes.values()), W_A)
    return _r(t.spark.createDataFrame(list(zip([*axes, "rest"], shares)), "axis string, share double"), "share")


@query(
    "erase_direction",
    f"""
    with p as (select vec_id, x, {_sql_dot('x', _arr(UNIT_A))} as k from ({E_SQL})),
    r as (select vec_id, k, list_transform(range(1, 65), lambda i: x[i] - k * ({_arr(UNIT_A)})[i]) as x2 from p)
    select vec_id, round(k, 6) as along, round(sqrt({_sql_dot('x2', 'x2')}), 6) as rest_norm,
           round(abs({_sql_dot('x2', _arr(UNIT_A))}), 6) as left_over from r
    """,
)
def erase_direction(t: Tables):
    u = V.literal(UNIT_A)
    rest = V.erase(F.col("x"), u)
    out = emb(t).select(
        "vec_id", V.dot(F.col("x"), u).alias("along"), V.norm(rest).alias("rest_norm"),
        F.abs(V.dot(rest, u)).alias("left_over"),
    )
    return _r(out, "along", "rest_norm", "left_over")


@query("pca2")
def pca2(t: Tables):
    """Two principal components of vectors standardised on the training domains, and their share of the variance.

    The largest loading of a component is positive.
    """
    e = emb(t).select("vec_id", "domain", "x")
    train = e.where("domain <= 2")
    z = vectors.standardize(train, e, "x")
    model = PCA(k=2, inputCol="v", outputCol="p").fit(z.where("domain <= 2").select(array_to_vector("z").alias("v")))
    axes = model.pc.toArray().T
    axes = [[float(x) * (1 if max(a, key=abs) > 0 else -1) for x in a] for a in axes.tolist()]
    shares = [float(x) for x in model.explainedVariance]
    return z.select(
        "vec_id", *[V.dot(F.col("z"), V.literal(a)).alias(f"pc{i + 1}") for i, a in enumerate(axes)],
        *[F.lit(x).alias(f"share{i + 1}") for i, x in enumerate(shares)],
    )


@query(
    "participation_ratio",
    f"""
    with l as ({LONG_SQL}),
    c as (select a.dim as i, b.dim as j, covar_samp(a.v, b.v) as c from l a join l b using (vec_id) group by all)
    select round(pow(sum(c) filter (i = j), 2) / sum(c * c), 5) as participation_ratio from c
    """,
)
def participation_ratio(t: Tables):
    out = vectors.participation_ratio(emb(t), "x")
    return out.select(F.round("participation_ratio", 5).alias("participation_ratio"))


@query(
    "anisotropy",
    f"""
    with e as (select *, row_number() over (order by vec_id) - 1 as idx, count(*) over () as n from ({E_SQL})),
    p as (select a.x as x, cast({sql_hash(51, 'draw', 'idx')} % n as bigint) as other from e a, range(5) r(draw))
    select count(*) as n_pairs, round(avg(list_cosine_similarity(p.x, b.x)), 6) as mean_cosine from p join e b on b.idx = p.other
    """,
)
def anisotropy(t: Tables):
    return _r(vectors.random_pair_cosine(emb(t), ["vec_id"], "x", 5, 51), "mean_cosine")


@query(
    "mean_pool",
    f"""
    with l as ({LONG_SQL}), k as (select vec_id from l where dim = 0 and v > 0)
    select label, dim, round(avg(v), 6) as value, count(*) as n from l semi join k using (vec_id) group by all
    """,
)
def mean_pool(t: Tables):
    masked = emb(t).where(F.col("x")[0] > 0)
    pooled = vectors.moments(masked, ["label"], "x")
    return _r(vectors.dimensions(pooled, ["label", "n"], "mean", "value"), "value").select("label", "dim", "value", "n")


@query(
    "feature_views",
    f"""
    select vec_id, 'mean_of_halves' as view, 32 as size, round(list_sum(list_transform(range(1, 33), lambda i: (x[i] + x[i + 32]) / 2 * i)), 6) as checksum from ({E_SQL})
    union all
    select vec_id, 'first_and_last_quarter', 32, round(list_sum(list_transform(range(1, 33), lambda i: (x[1:16] || x[49:64])[i] * i)), 6) from ({E_SQL})
    """,
)
def feature_views(t: Tables):
    x = F.col("x")
    halves = V.mean_view([F.slice(x, 1, 32), F.slice(x, 33, 32)])
    ends = F.concat(F.slice(x, 1, 16), F.slice(x, 49, 16))
    views = F.explode(F.array(*[
        F.struct(F.lit(n).alias("view"), v.alias("a")) for n, v in (("mean_of_halves", halves), ("first_and_last_quarter", ends))
    ]))
    weighted = V.total(F.transform("v.a", lambda a, i: a * (i + 1)))
    return emb(t).select("vec_id", views.alias("v")).select(
        "vec_id", "v.view", F.size("v.a").alias("size"), F.round(weighted, 6).alias("checksum")
    )


READ_SQL = f"""
    select vec_id, y, w.name as weights, vw.name as view, {_sql_dot("case vw.name when 'raw' then x else list_transform(x, lambda a: abs(a)) end", 'w.w')} as s
    from ({E_SQL}), (values ('a', {_arr(W_A)}), ('b', {_arr(W_B)})) w(name, w), (values ('raw'), ('abs')) vw(name)"""


@query(
    "cross_readout",
    f"""
    select a.weights, a.view, round(a.auc, 6) as auc, round(g.gap, 6) as gap
    from ({sql_auc(READ_SQL, 'weights, "view"', 's', 'y')}) a
    join (select weights, view, avg(s) filter (y = 1) - avg(s) filter (y = 0) as gap from ({READ_SQL}) group by all) g
      on a.weights = g.weights and a.view = g.view
    """,
)
def cross_readout(t: Tables):
    x = F.col("x")
    views = {"raw": x, "abs": F.transform(x, F.abs)}
    cells = F.explode(F.array(*[
        F.struct(F.lit(w).alias("weights"), F.lit(v).alias("view"), V.dot(vec, V.literal(ws)).alias("s"))
        for w, ws in (("a", W_A), ("b", W_B)) for v, vec in views.items()
    ]))
    long = emb(t).select("y", cells.alias("c")).select("y", "c.weights", "c.view", "c.s")
    auc = metrics.auc(long, ["weights", "view"], "s", "y").select("weights", "view", "auc")
    gap = long.groupBy("weights", "view").agg(
        (F.avg(F.when(F.col("y") == 1, F.col("s"))) - F.avg(F.when(F.col("y") == 0, F.col("s")))).alias("gap")
    )
    return _r(auc.join(gap, ["weights", "view"]), "auc", "gap")


# Votes: each voter scores every class by a slice of the vector.
VOTE_SQL = f"""
    select vec_id, voter, cls, round(x[cls * 4 + voter + 1], 9) as s from ({E_SQL}), range(3) v(voter), range(10) c(cls)"""


def votes(t: Tables):
    grid = F.explode(F.array(*[
        F.struct(F.lit(v).alias("voter"), F.lit(c).alias("cls"), F.round(F.col("x")[c * 4 + v], 9).alias("s"))
        for v in range(3) for c in range(10)
    ]))
    return emb(t).select("vec_id", grid.alias("g")).select("vec_id", "g.voter", "g.cls", "g.s")


@query(
    "soft_vote",
    f"""
    with m as (select vec_id, cls, round(avg(s), 9) as m from ({VOTE_SQL}) group by all)
    select vec_id, cast(cls as integer) as cls, round(m, 6) as score from m
    qualify row_number() over (partition by vec_id order by m desc, cls) = 1
    """,
)
def soft_vote(t: Tables):
    mean = votes(t).groupBy("vec_id", "cls").agg(F.round(F.avg("s"), 9).alias("m"))
    best = mean.groupBy("vec_id").agg(F.max_by(F.struct("cls", "m"), F.struct("m", -F.col("cls"))).alias("b"))
    return best.select("vec_id", "b.cls", F.round("b.m", 6).alias("score"))


@query(
    "majority_vote",
    f"""
    with p as (select vec_id, voter, cls from ({VOTE_SQL}) qualify row_number() over (partition by vec_id, voter order by s desc, cls) = 1),
    c as (select vec_id, cls, count(*) as n from p group by all)
    select vec_id, cast(cls as integer) as cls, n as votes from c qualify row_number() over (partition by vec_id order by n desc, cls) = 1
    """,
)
def majority_vote(t: Tables):
    picks = votes(t).groupBy("vec_id", "voter").agg(F.max_by("cls", F.struct("s", -F.col("cls"))).alias("cls"))
    n = picks.groupBy("vec_id", "cls").agg(F.count(F.lit(1)).alias("votes"))
    best = n.groupBy("vec_id").agg(F.max_by(F.struct("cls", "votes"), F.struct("votes", -F.col("cls"))).alias("b"))
    return best.select("vec_id", "b.cls", "b.votes")
