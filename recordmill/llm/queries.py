"""Queries of the operators of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


JACCARD_SQL = r"""
with recursive tokens as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [w]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) end as s from tokens
), parts as (select doc_id, len(s) as n, unnest(s) as g from sets),
common as (
  select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as c
  from parts a join parts b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by all
), links as (select x, y from common where 100 * c >= 90 * (nx + ny - c)),
reach(doc_id, root) as (
  select doc_id, doc_id from sets union
  select l.y, r.root from reach r join links l on l.x = r.doc_id
)
select doc_id, len(any_value(s))::bigint as n_shingles, min(root) as component_id
from reach join sets using (doc_id) group by doc_id
"""


@query("op8_jaccard_join", JACCARD_SQL)
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, folder, "documents"), size=3, num=90, den=100)


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from recordmill.llm.byte_bpe import decode, encode

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = decode(encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_token_files")
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from recordmill.llm.token_files import read_token_files, token_folder, write_token_files

    docs = table(spark, folder, "documents")
    files = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 49_408, 1, token_folder(docs))
    return read_token_files(files).drop("ids")


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, folder, "documents")).select("doc_id", "text", "lines_removed")


CONTAINMENT_SQL = r"""
with doc_words as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), item_words as (
  select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from benchmark
), item_parts as (
  select item_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]))) as g from item_words
), sizes as (select item_id, count(*) as n_item from item_parts group by item_id),
doc_parts as (
  select doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]))) as g from doc_words
)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item
from doc_parts join item_parts using (g) join sizes using (item_id)
group by doc_id, item_id having count(*) * 10 >= any_value(n_item) * 8
"""


@query("op5_decontaminate", CONTAINMENT_SQL)
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.decontaminate import contained_items

    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_compression_quality")
def op2_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.compression_quality import fit, held_out, score

    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _joined(spans, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the spans, comma-joined in their order."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("spans"), kinds), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query("op3_secret_linking")
def op3_secret_linking(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.secrets import KINDS, find_secrets

    return _span_digest(find_secrets(table(spark, folder, "documents")), KINDS)


@query("op4_disclosure")
def op4_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.disclosure import KINDS, find_personal

    return _span_digest(find_personal(table(spark, folder, "documents")), KINDS)


REVISIT_SQL = r"""
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages
), best as (select h, max(page_id) as best from p group by h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as payload_digest,
  case when page_id = best then 'response' else 'revisit' end as record_type,
  case when page_id <> best then best end as refers_to
from p join best using (h)
"""


@query("op7_warc", REVISIT_SQL)
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.common import new_path
    from recordmill.llm.warc import base32_digest, read_warc, register, write_pages

    register(spark)
    path = new_path(spark, "warc")
    write_pages(table(spark, folder, "pages"), path)

    def number(column: str):
        return F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1).cast("bigint")

    # payloads of responses are read, decoded and measured; a revisit has its header only
    kept = read_warc(spark, path).where("record_type = 'response'")
    kept = kept.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": base32_digest(F.sha1("payload"))})
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return kept.unionByName(again).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"),
    )


TOPK_SQL = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 5
"""


@query("op10_topk", TOPK_SQL)
def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.topk_search import top_k

    return top_k(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


COLLOCATION_SQL = r"""
with pieces as (
  select row_number() over () as piece, lang, p from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents)
), split as (select piece, lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from split),
grams as (
  select lang, w[i] as g, null as x, null as y from starts
  union all select lang, w[i] || ' ' || w[i + 1], null, null from starts where i < len(w)
  union all select lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], w[i] || ' ' || w[i + 1], w[i + 1] || ' ' || w[i + 2] from starts where i + 1 < len(w)
), f as (select lang, g, count(*)::hugeint as a, any_value(x) as x, any_value(y) as y from grams group by lang, g having count(*) >= 10),
total as (select lang, sum(len(w))::bigint as n from split group by lang),
parts as (
  select lang, g, a, 1 as k, split_part(g, ' ', 1) as p, coalesce(y, split_part(g, ' ', 2)) as q from f where contains(g, ' ')
  union all select lang, g, a, 2, x, split_part(g, ' ', 3) from f where x is not null
), cuts as (
  select c.lang, c.g, c.a, k, l.a as l, r.a as r, (1000000 * c.a * c.a) // (l.a * r.a) as score
  from parts c join f l on l.lang = c.lang and l.g = c.p join f r on r.lang = c.lang and r.g = c.q
), scored as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
inside as (
  select lang, g, max(a) as longer from (select lang, x as g, a from f where x is not null union all select lang, y, a from f where x is not null) group by all
), named as (
  select s.lang, s.g as phrase, s.a, l, r, score from scored s left join inside i on s.lang = i.lang and s.g = i.g
  where i.longer is null or 100 * i.longer < 50 * s.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
  a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from named join total using (lang) qualify rank <= 2000
"""


@query("op11_collocations", COLLOCATION_SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"))


MANIFEST_SQL = r"""
with recursive fields as (
  select doc_id, source, text,
    concat(coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-')) as head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered,
    xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: [ascii(substr(doc_id::varchar, i, 1)), 0, 0, 0, 0, 0, 0, 0])),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) as crc
  from documents
), leaves as (
  select doc_id, source, sha256(concat(head, coalesce(octet_length(encode(text)) || ':' || text, '-'))) as leaf,
    case when crc % 5 = 0 then sha256(concat(head, coalesce(octet_length(encode(lowered)) || ':' || lowered, '-'))) end as changed
  from fields
), placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from leaves),
nodes(source, lvl, pos, h, cnt) as (
  select source, 0, pos, leaf, count(*) over (partition by source) from placed
  union all
  select source, lvl, pos, h, count(*) over (partition by source) from (
    select source, lvl + 1 as lvl, pos // 16 as pos, sha256(string_agg(h, '' order by pos)) as h from nodes where cnt > 1 group by source, lvl + 1, pos // 16)
), subroots as (select source, lvl as height, h as subroot, row_number() over (order by source nulls first) - 1 as place from nodes where cnt = 1),
upper(lvl, pos, h, cnt) as (
  select 0, place, subroot, count(*) over () from subroots
  union all
  select lvl, pos, h, count(*) over () from (
    select lvl + 1 as lvl, pos // 16 as pos, sha256(string_agg(h, '' order by pos)) as h from upper where cnt > 1 group by lvl + 1, pos // 16)
), top as (select h as root, lvl as height from upper where cnt = 1),
tree as (
  select source is null as no_source, coalesce(source, '') as s, lvl, pos, h from nodes where cnt > 1
  union all
  select n.source is null, coalesce(n.source, ''), n.height + u.lvl, u.pos, u.h from subroots n, upper u where u.cnt > 1
), runs as (
  select no_source, s, lvl, pos // 16 as run, list(h order by pos) as hs from tree group by all
), fold(doc_id, source, leaf, lvl, pos, h, proof) as (
  select p.doc_id, p.source, leaf, 0, case when n.height = 0 then n.place else p.pos end, coalesce(changed, leaf), ''
  from placed p join subroots n on n.source is not distinct from p.source
  union all
  select f.doc_id, f.source, f.leaf, f.lvl + 1, case when f.lvl + 1 = n.height then n.place else f.pos // 16 end,
    sha256(concat(array_to_string(hs[:f.pos % 16], ''), f.h, array_to_string(hs[f.pos % 16 + 2:], ''))),
    concat(f.proof, array_to_string(hs[:f.pos % 16], ''), array_to_string(hs[f.pos % 16 + 2:], ''))
  from fold f join subroots n on n.source is not distinct from f.source
  join runs r on r.no_source = (f.source is null) and r.s = coalesce(f.source, '') and r.lvl = f.lvl and r.run = f.pos // 16
), ended as (select * from fold qualify row_number() over (partition by doc_id, leaf order by lvl desc) = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, e.h as folded_root, e.h = root as verified
from ended e join subroots n on n.source is not distinct from e.source, top
"""


@query("op12_merkle", MANIFEST_SQL)
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.merkle import manifest

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = manifest(
        table(spark, folder, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", tampered, {"text": lowered}
    )
    return rows.drop("copied")


EXACT_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""


@query("op13_exact_dedup", EXACT_SQL)
def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from recordmill.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, folder, "documents"))
