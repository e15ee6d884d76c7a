"""Personal data and the terms that give it away (operator 4).

Base patterns find emails, addresses of machines, cards and phone numbers: the protected entities.
The corpus then tells how strongly a word reveals one: of all occurrences of term ``t``, the share
``P(e | t)`` stands within ``NEAR`` words of a mention of entity ``e``. After seeing ``t``, ``-log2 P(e | t)``
bits of doubt about ``e`` are left. A term that leaves at most ``REMOVE_BITS`` about any entity is removed wherever it stands, one that
leaves at most ``GENERALISE_BITS`` is replaced by its shape, if it was seen beside
the entity at least ``SUPPORT`` times (fewer tell too little to estimate a share). Counts cover all documents. Terms and entities travel as 64-bit hashes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import bit_filter, map_batches, materialize
from recordmill.llm.shingles import word_hashes

NEAR = 10
SUPPORT = 3
REMOVE_BITS = 1.0
GENERALISE_BITS = 2.0

# fixed values of the base scan
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
TERMS = ("remove", "generalise")
_WORD = re.compile(r"[^\W\d_]{3,}")

_NEAR = "row bigint, kind string, e bigint, t bigint, start int, stop int"


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def entities(text: str) -> list[tuple[str, int, int]]:
    """Base spans, ordered by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Base spans (no term), and the words near them with the entity they stand beside."""
    rows = []
    for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found = entities(text) if text else []
        if not found:
            continue
        rows += [(row, k, None, None, a, b) for k, a, b in found]
        taken = sorted((a, b) for _, a, b in found)
        spans, at = [], 0
        for m in _WORD.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                spans.append(m.span())
        starts = np.array([a for a, _ in spans])
        seen = set()
        for kind, a, b in found:
            e = _signed(xxhash.xxh3_64_intdigest(f"{kind}:{text[a:b].lower()}".encode()))
            i = int(np.searchsorted(starts, a))
            for k in range(max(0, i - NEAR), min(len(spans), i + NEAR)):
                if (e, k) not in seen:
                    seen.add((e, k))
                    x, y = spans[k]
                    rows.append((row, None, e, _signed(xxhash.xxh3_64_intdigest(text[x:y].lower().encode())), x, y))
    if not rows:
        return None
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["row", "kind", "e", "t", "start", "stop"])


def _occurrences(batch: pa.RecordBatch, keep) -> pa.RecordBatch | None:
    """All occurrences of the terms that may be asked for; ``inside`` a base span they are counted only."""
    rows = []
    for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found = _WORD.findall(text) if text else []
        if not found:
            continue
        h = word_hashes([w.lower().encode() for w in found]).view(np.int64)
        hits = np.flatnonzero(keep(h))
        if not len(hits):
            continue
        spans = [m.span() for m in _WORD.finditer(text)]
        taken = sorted((a, b) for _, a, b in entities(text))
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for k, t in zip(hits.tolist(), h[hits].tolist()):
            a, b = spans[k]
            before = bisect_left(starts, b)
            rows.append((row, t, a, b, bool(before) and reach[before - 1] > a))
    if not rows:
        return None
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["row", "t", "start", "stop", "inside"])


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, stop) in code points.

    Kinds are those of ``KINDS``, then ``TERMS``; spans are ordered by kind, then start. Null and
    empty texts have none. Rows are told apart by a hash of id and text: rows that repeat both have the same
    spans, and a null id is a value like any other. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    found = materialize(map_batches(rows.select("row", "text"), _scan, _NEAR), "mentions")
    near = found.where("kind is null")
    joint = near.groupBy("e", "t").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT)
    # a term occurs at least as often as it stands near any entity, so common words are ruled out before all texts are read
    around = near.select("row", "start", "t").distinct().groupBy("t").agg(F.count("*").alias("around"))
    doubt = lambda n: -F.log2(F.col("both") / F.col(n))
    joint = materialize(joint.join(around, "t").where(doubt("around") <= GENERALISE_BITS + 1e-9).select("e", "t", "both"), "joint")
    text = rows.select("row", "text")
    seen = materialize(map_batches(text, _occurrences, "row bigint, t bigint, start int, stop int, inside boolean", bit_filter(joint.select("t"))), "occurrences")
    totals = seen.groupBy("t").agg(F.count("*").alias("n"))
    bits = doubt("n")
    flagged = joint.join(totals, "t").select(
        "t", F.when(bits <= REMOVE_BITS, "remove").when(bits <= GENERALISE_BITS, "generalise").alias("kind")
    ).where("kind is not null")
    # a word that tells of two entities is treated by the one that it reveals more, wherever it stands
    flagged = flagged.groupBy("t").agg(F.max("kind").alias("kind"))
    terms = seen.where("not inside").join(flagged, "t").select("row", "start", "stop", "kind").distinct()
    spans = found.where("kind is not null").select("row", "kind", "start", "stop").distinct()
    spans = spans.unionByName(terms.select("row", "kind", "start", "stop"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS + TERMS]), F.col("kind"))
    grouped = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "stop", "kind"))).alias("spans"))
    grouped = grouped.select("row", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,stop:int>>)")
    return rows.select("id", "row").join(grouped, "row", "left").select(F.col("id").alias(id_col), "row", F.coalesce("spans", empty).alias("spans"))


def _sanitise(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        if text and spans:
            parts, at = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                if s["start"] < at:
                    at = max(at, s["stop"])
                    continue
                parts.append(text[at : s["start"]])
                word, at = text[s["start"] : s["stop"]], s["stop"]
                parts.append("" if s["kind"] == "remove" else f"[word {len(word)}]" if s["kind"] == "generalise" else f"[{s['kind']}]")
            text = "".join(parts) + text[at:]
        out.append(text)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], batch.schema.names[:2])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text of every row with entities named by kind only, and revealing terms removed or generalised.

    Null and empty texts stay as they are, repeated rows stay repeated.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = find_personal(slim, "id").select("row", "spans").dropDuplicates(["row"])
    rows = slim.withColumn("row", F.xxhash64("id", "text")).join(spans, "row")
    kind = docs.schema[id_col].dataType.simpleString()
    clean = map_batches(rows.select("id", "text", "spans"), _sanitise, f"id {kind}, text string")
    return clean.select(F.col("id").alias(id_col), F.col("text").alias(text_col))
