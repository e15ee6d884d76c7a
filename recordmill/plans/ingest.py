"""Queries on sources and sinks."""

from pyspark.sql import functions as F

from recordmill.plans.registry import Tables, query
from recordmill.session import new_path
from recordmill.sources import delimited, tables, versions


@query("scan_typed", "select * from customer")
def scan_typed(t: Tables):
    path = new_path(t.spark, "csv")
    tables.write_delimited(t.customer, path)
    return tables.read_delimited(t.spark, path, t.customer.schema)


@query(
    "scan_group_map",
    "select cast(o_orderkey as varchar) as member, cast(o_custkey as varchar) as group_id from orders",
)
def scan_group_map(t: Tables):
    path = new_path(t.spark, "tsv")
    pairs = t.orders.select(F.col("o_orderkey").alias("member"), F.col("o_custkey").alias("group_id"))
    tables.write_delimited(pairs, path, sep="\t")
    return tables.read_delimited(t.spark, path, "member string, group_id string", sep="\t")


@query(
    "scan_pruned",
    "select event_id, user_id from events where event_type = 'purchase' and value > 50",
)
def scan_pruned(t: Tables):
    return t.events.where("event_type = 'purchase' and value > 50").select("event_id", "user_id")


@query(
    "ingest_delimited",
    """
    with lines as (
      select doc_id, lang, list_transform(string_split(text, chr(10)),
             lambda x: regexp_replace(x, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')) as ls
      from documents)
    select cast(doc_id as varchar) as id, lang as tag,
           cast(length(array_to_string(ls, '')) as integer) as n_body,
           md5(array_to_string(ls, '')) as body_md5
    from lines
    """,
)
def ingest_delimited(t: Tables):
    path = new_path(t.spark, "records")
    delimited.write_records(t.documents, path, "doc_id", F.col("lang"), F.col("text"))
    return delimited.read_records(t.spark, path).select(
        "id", "tag", F.length("body").alias("n_body"), F.md5("body").alias("body_md5")
    )


@query(
    "ingest_listing",
    """
    with top as (
      select o_custkey, max_by(o_orderkey, struct_pack(p := o_totalprice, k := -o_orderkey)) as rep
      from orders group by 1)
    select cast(o_orderkey as varchar) as member, cast(o.o_custkey as varchar) as "group",
           cast(floor(o_totalprice) as bigint) as size, o_orderkey = rep as is_representative
    from orders o join top using (o_custkey)
    """,
)
def ingest_listing(t: Tables):
    rep = t.orders.groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("rep")
    )
    members = t.orders.join(rep, "o_custkey").select(
        F.col("o_custkey").alias("group"),
        F.col("o_orderkey").alias("pos"),
        F.floor("o_totalprice").alias("size"),
        F.col("o_orderkey").alias("member"),
        (F.col("o_orderkey") == F.col("rep")).alias("is_representative"),
    )
    path = new_path(t.spark, "listing")
    delimited.write_listing(members, path)
    return delimited.read_listing(t.spark, path)


@query(
    "text_table_extract",
    """
    with lines as (
      select doc_id, unnest(string_split(text, chr(10))) as line,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no
      from documents)
    select doc_id, cast(line_no as integer) as line_no,
           trim(regexp_extract(line, '^([^|]*)\\|', 1)) as first_cell,
           trim(regexp_extract(line, '\\|([^|]*)\\|', 1)) as second_cell,
           regexp_extract(line, '\\| *([a-z]{3})[a-z]*', 1) as code,
           cast(length(line) - length(replace(line, '|', '')) as integer) as n_bars,
           contains(line, 'the') as has_flag
    from lines where contains(line, ' | ')
    """,
)
def text_table_extract(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").contains(" | ")).select(
        "doc_id",
        "line_no",
        F.trim(F.regexp_extract("line", "^([^|]*)\\|", 1)).alias("first_cell"),
        F.trim(F.regexp_extract("line", "\\|([^|]*)\\|", 1)).alias("second_cell"),
        F.regexp_extract("line", "\\| *([a-z]{3})[a-z]*", 1).alias("code"),
        (F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit("")))).alias("n_bars"),
        F.col("line").contains("the").alias("has_flag"),
    )


@query(
    "union_domains",
    """
    select c_custkey as record_id, c_nationkey as nation, c_acctbal as balance, 'customer' as domain
    from customer
    union all select s_suppkey, s_nationkey, s_acctbal, 'supplier' from supplier
    """,
)
def union_domains(t: Tables):
    def side(df, p, key):
        return df.select(
            F.col(key).alias("record_id"),
            F.col(f"{p}_nationkey").alias("nation"),
            F.col(f"{p}_acctbal").alias("balance"),
        )

    return tables.union_tagged(
        {"customer": side(t.customer, "c", "c_custkey"), "supplier": side(t.supplier, "s", "s_suppkey")}
    )


@query(
    "sink_roundtrip",
    """
    select f as format, o_orderstatus as status, count(*) as n,
           cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents,
           max(o_orderdate) as last_date
    from orders, (values ('csv'), ('json'), ('parquet')) as v(f)
    group by 1, 2
    """,
)
def sink_roundtrip(t: Tables):
    parts = {}
    for fmt in ("csv", "json", "parquet"):
        path = new_path(t.spark, fmt)
        t.orders.write.partitionBy("o_orderstatus").format(fmt).save(path)
        fields = [f for f in t.orders.schema if f.name != "o_orderstatus"]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        parts[fmt] = t.spark.read.schema(schema + ", o_orderstatus string").format(fmt).load(path)
    return (
        tables.union_tagged(parts, tag="format")
        .groupBy("format", F.col("o_orderstatus").alias("status"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
            F.max("o_orderdate").alias("last_date"),
        )
    )


@query(
    "resume_pending",
    """
    select doc_id, lang from documents d
    where not exists (select 1 from labels l where l.doc_id = d.doc_id)
    """,
)
def resume_pending(t: Tables):
    return tables.pending(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query(
    "versioned_rewrite",
    """
    with v as (
      select 0 as version, o_orderkey, o_orderstatus as status, o_totalprice from orders where o_orderkey % 3 > 0
      union all select 1, o_orderkey, o_orderstatus, o_totalprice from orders
      union all select 2, o_orderkey, case o_orderstatus when 'P' then 'O' else o_orderstatus end, o_totalprice from orders)
    select version, status, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents from v group by all
    """,
)
def versioned_rewrite(t: Tables):
    """A table, the rows that were pending appended, and a corrected rewrite: all three versions can be read."""
    base = new_path(t.spark, "orders")
    orders = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    versions.rewrite(orders.where("o_orderkey % 3 > 0"), base)
    versions.append_pending(orders, base, ["o_orderkey"])
    versions.update(base, t.spark, lambda last: last.withColumn("status", F.when(F.col("status") == "P", "O").otherwise(F.col("status"))))
    every = [versions.read(t.spark, base, n).withColumn("version", F.lit(n)) for n in versions.history(t.spark, base)]
    rows = every[0].unionByName(every[1]).unionByName(every[2])
    return rows.groupBy("version", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    )
