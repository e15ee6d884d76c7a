"""Queries on filters, cleaning rules and scalar functions."""

from pyspark.sql import functions as F

from recordmill.functions import dates, text
from recordmill.operators import curate
from recordmill.plans.registry import Tables, query

# Rules as data: first tier (plural allowed), second tier (exact words).
TIER1 = [("legal", ["license", "licensed", "copyright"]), ("software", ["token", "version", "key"]),
         ("contact", ["email", "phone", "example"])]
TIER2 = [("german", ["der", "und", "nicht"]), ("french", ["les", "des", "avec"]),
         ("spanish", ["los", "una", "para"]), ("english", ["the", "and", "of"])]


def _sql_class(col: str, rules, plural: bool) -> str:
    s = "s?" if plural else ""
    whens = " ".join(
        f"when regexp_matches(lower({col}), '(^|[^0-9A-Za-z_])(?:{'|'.join(ws)}){s}($|[^0-9A-Za-z_])')"
        f" then '{cat}'"
        for cat, ws in rules
    )
    return f"case {whens} end"


REJECT_SQL = """
    select doc_id, case when regexp_matches(source, '^src1[37]$') then 'bad_id'
           when n_chars < 200 or n_chars > 6000 then 'length'
           when contains(text, ' | ') then 'marker' else 'kept' end as reject_reason
    from documents"""


def _with_reason(t: Tables):
    rules = [
        ("bad_id", F.col("source").rlike("^src1[37]$")),
        ("length", curate.out_of_range(F.col("n_chars").cast("string"), 200, 6000)),
        ("marker", F.col("text").contains(" | ")),
    ]
    return t.documents.withColumn("reject_reason", curate.reject_reason(rules))


@query("curate_reject_reason", REJECT_SQL)
def curate_reject_reason(t: Tables):
    return _with_reason(t).select("doc_id", "reject_reason")


@query("curate_funnel", f"select reject_reason, count(*) as n from ({REJECT_SQL}) group by 1")
def curate_funnel(t: Tables):
    return curate.funnel(_with_reason(t))


@query(
    "filter_bad_cast",
    """
    select doc_id, source from documents
    where not coalesce(try_cast(substr(source, 4) as double) between 3 and 15, false)
    """,
)
def filter_bad_cast(t: Tables):
    number = F.substring("source", 4, 10)
    return t.documents.where(curate.out_of_range(number, 3, 15)).select("doc_id", "source")


@query(
    "filter_any_match",
    """
    select page_id, url from pages
    where regexp_matches(url, '/(de|es)/') or regexp_matches(html, '/(de|es)/')
    """,
)
def filter_any_match(t: Tables):
    return t.pages.where(curate.any_match(["url", "html"], "/(de|es)/")).select("page_id", "url")


@query(
    "route_by_period",
    """
    select event_id, event_type, case when ts < timestamp '2024-01-20' then 'base' else 'forward' end as route
    from events where event_type <> 'error'
    """,
)
def route_by_period(t: Tables):
    known = curate.known(F.col("event_type"), ["error", ""])
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return t.events.where(known.isNotNull()).select(
        "event_id", "event_type", F.when(F.col("ts") < cut, "base").otherwise("forward").alias("route")
    )


@query(
    "nonstandard_chars",
    """
    with c as (
      select doc_id, source,
             list_sort(list_distinct(regexp_extract_all(text, '[^A-Za-z0-9 .,\\n]'))) as chars
      from documents)
    select doc_id, source, array_to_string(chars, '') as chars, cast(len(chars) as integer) as n_kinds
    from c where len(chars) > 0
    """,
)
def nonstandard_chars(t: Tables):
    chars = text.chars_outside("text", "A-Za-z0-9 .,\\n")
    return (
        t.texts.select("doc_id", "source", chars.alias("c"))
        .where(F.size("c") > 0)
        .select("doc_id", "source", F.array_join("c", "").alias("chars"), F.size("c").alias("n_kinds"))
    )


@query(
    "nonstandard_rate",
    """
    select source, count(*) as n,
           cast(sum(cast(regexp_matches(text, '[^A-Za-z0-9 .,\\n]') as int)) as bigint) as n_skipped,
           round(avg(cast(regexp_matches(text, '[^A-Za-z0-9 .,\\n]') as int)), 6) as rate
    from documents group by 1
    """,
)
def nonstandard_rate(t: Tables):
    hit = F.col("text").rlike("[^A-Za-z0-9 .,\\n]").cast("int")
    return t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("n_skipped"), F.round(F.avg(hit), 6).alias("rate")
    )


@query(
    "pool_flags",
    """
    select event_id, ts < timestamp '2024-01-11' as in_train,
           ts >= timestamp '2024-01-11' and event_type = 'purchase' as in_target,
           ts >= timestamp '2024-01-11' and event_type <> 'purchase' as in_background
    from events
    """,
)
def pool_flags(t: Tables):
    late = F.col("ts") >= F.lit("2024-01-11").cast("timestamp_ntz")
    target = F.col("event_type") == "purchase"
    return t.events.select(
        "event_id", (~late).alias("in_train"), (late & target).alias("in_target"),
        (late & ~target).alias("in_background"),
    )


@query(
    "coarse_category",
    """
    select event_id, case when event_type in ('purchase', 'signup') then 'convert'
           when event_type in ('click', 'view') then 'browse' else 'other' end as coarse,
           case when event_type in ('purchase', 'signup') then 1 else 0 end as is_convert
    from events
    """,
)
def coarse_category(t: Tables):
    e = F.col("event_type")
    coarse = F.when(e.isin("purchase", "signup"), "convert").when(e.isin("click", "view"), "browse")
    out = t.events.select("event_id", coarse.otherwise("other").alias("coarse"))
    return out.withColumn("is_convert", F.when(F.col("coarse") == "convert", 1).otherwise(0))


@query(
    "classify_keywords",
    f"select doc_id, coalesce({_sql_class('text', TIER1, True)}, 'unknown') as category from documents",
)
def classify_keywords(t: Tables):
    category = text.tiered_class(text.keyword_class("text", TIER1))
    return t.texts.select("doc_id", category.alias("category"))


@query(
    "classify_tiered",
    f"""
    select doc_id, coalesce({_sql_class('text', TIER1, True)}, {_sql_class('text', TIER2, False)},
           case when source in ('src0', 'src1') then 'fallback' end, 'unknown') as category
    from documents
    """,
)
def classify_tiered(t: Tables):
    third = F.when(F.col("source").isin("src0", "src1"), "fallback")
    category = text.tiered_class(
        text.keyword_class("text", TIER1), text.keyword_class("text", TIER2, plural=False), third
    )
    return t.texts.select("doc_id", category.alias("category"))


@query(
    "extract_embedded",
    """
    select page_id, starts_with(url, 'http://') or trim(url) in ('', '-') as is_garbage,
           regexp_extract(html, '<title>([^<]+)</title>', 1) as title,
           regexp_extract(url, '/([a-z]{2})/', 1) as lang
    from pages
    """,
)
def extract_embedded(t: Tables):
    garbage = F.col("url").startswith("http://") | F.trim("url").isin("", "-")
    return t.pages.select(
        "page_id", garbage.alias("is_garbage"),
        F.regexp_extract("html", "<title>([^<]+)</title>", 1).alias("title"),
        F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"),
    )


@query(
    "parse_partial_date",
    """
    with k as (select o_orderkey, o_orderkey % 9 as f, cast(o_orderdate as date) as dt from orders)
    select o_orderkey,
           case when f <= 5 then cast(year(dt) as integer) end as y,
           case when f in (0, 1, 2, 3, 4) then cast(month(dt) as integer) end as m,
           case when f in (0, 2, 3) then cast(day(dt) as integer) end as d,
           case when f in (0, 2, 3) then 'day' when f in (1, 4) then 'month'
                when f = 5 then 'year' else 'none' end as "precision"
    from k
    """,
)
def parse_partial_date(t: Tables):
    f, d = F.pmod("o_orderkey", F.lit(9)), F.col("o_orderdate")
    formats = ["dd-MMM-yyyy", "MMM-yyyy", "yyyy-MM-dd", "yyyy/M/d", "yyyy-M", "yyyy", "yyyy/yyyy"]
    raw = F.when(f == 7, "n/a").when(f == 8, "")
    for i, fmt in enumerate(formats):
        raw = raw.when(f == i, F.date_format(d, fmt))
    raw_table = t.orders.select("o_orderkey", raw.alias("raw"))
    return raw_table.select("o_orderkey", dates.parse_partial_date("raw").alias("p")).select(
        "o_orderkey", "p.y", "p.m", "p.d", "p.precision"
    )


@query(
    "ym_default",
    """
    select o_orderkey, strftime(o_orderdate, '%Y') || '-' ||
           case when o_orderstatus = 'P' then '06' else strftime(o_orderdate, '%m') end as ym
    from orders
    """,
)
def ym_default(t: Tables):
    month = F.when(F.col("o_orderstatus") != "P", F.month("o_orderdate"))
    return t.orders.select("o_orderkey", dates.ym_string(F.year("o_orderdate"), month).alias("ym"))


DAYS_SQL = """
    select c_custkey, o_orderkey,
           cast((year(o_orderdate) - 1998) * 365 + (month(o_orderdate) - 6) * 30 as integer) as days
    from orders join customer on o_custkey = c_custkey"""


def _days(t: Tables):
    start = F.lit("1998-06-01").cast("date")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", "o_orderkey", dates.approx_days(start, F.col("o_orderdate")).alias("days")
    )


@query("days_between_ym", DAYS_SQL)
def days_between_ym(t: Tables):
    return _days(t)


@query(
    "interval_category",
    f"""
    select o_orderkey, days,
           case when days < 0 then 'negative' when days / 365.25 < 1 then '<1yr'
                when days / 365.25 < 3 then '1-3yr' when days / 365.25 < 5 then '3-5yr' else '5yr+' end as signed_bin,
           case when abs(days) / 365.25 < 1 then '<1yr' when abs(days) / 365.25 < 3 then '1-3yr'
                when abs(days) / 365.25 < 5 then '3-5yr' else '5yr+' end as abs_bin
    from ({DAYS_SQL})
    """,
)
def interval_category(t: Tables):
    return _days(t).select(
        "o_orderkey", "days", dates.interval_bin(F.col("days"), allow_negative=True).alias("signed_bin"),
        dates.interval_bin(F.col("days")).alias("abs_bin"),
    )


@query(
    "interval_digitize",
    f"""
    select o_orderkey,
           case when abs(days) < 365 then 0 when abs(days) < 1095 then 1 else 2 end as class3,
           case when days < 0 then 0 when days < 365 then 1 when days < 1095 then 2 else 3 end as class4
    from ({DAYS_SQL})
    """,
)
def interval_digitize(t: Tables):
    days = F.col("days")
    return _days(t).select(
        "o_orderkey", dates.digitize(F.abs(days), [365, 1095]).alias("class3"),
        dates.digitize(days, [0, 365, 1095]).alias("class4"),
    )


@query(
    "first_nonempty",
    """
    select page_id, coalesce(nullif(trim(regexp_extract(url, '\\?page=([0-9]+)', 1)), ''),
           nullif(trim(regexp_extract(url, '#([a-z]+)$', 1)), ''),
           nullif(trim(regexp_extract(html, '<title>([^,;<]+)', 1)), '')) as name
    from pages
    """,
)
def first_nonempty(t: Tables):
    name = text.first_nonempty(
        F.regexp_extract("url", "\\?page=([0-9]+)", 1), F.regexp_extract("url", "#([a-z]+)$", 1),
        F.regexp_extract("html", "<title>([^,;<]+)", 1),
    )
    return t.pages.select("page_id", name.alias("name"))


@query(
    "split_prefix",
    "select c_custkey, trim(split_part(c_name, '#', 1)) as prefix, split_part(c_name, '#', 2) as suffix from customer",
)
def split_prefix(t: Tables):
    return t.customer.select(
        "c_custkey", text.before("c_name", "#").alias("prefix"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("suffix"),
    )


@query(
    "normalize_tokens",
    """
    select item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as norm,
           array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))), ' ') as tokens
    from benchmark
    union all
    select doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g'),
           array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))), ' ')
    from documents
    """,
)
def normalize_tokens(t: Tables):
    def side(df, key):
        tokens = F.array_join(F.array_sort(text.name_tokens("text")), " ")
        return df.select(
            F.col(key).alias("item_id"), text.normalize_name("text").alias("norm"), tokens.alias("tokens")
        )

    return side(t.benchmark, "item_id").unionAll(side(t.texts, "doc_id"))


@query(
    "char_ratio",
    """
    select doc_id, cast(length(text) as integer) as n, cast(length(text) - length(replace(text, '|', '')) as integer) as n_bar,
           round((length(text) - length(replace(text, '|', ''))) / nullif(length(text), 0), 4) as ratio
    from documents
    """,
)
def char_ratio(t: Tables):
    return t.documents.select(
        "doc_id", F.length("text").alias("n"), text.char_count("text", "|").alias("n_bar"),
        text.char_ratio("text", "|").alias("ratio"),
    )
