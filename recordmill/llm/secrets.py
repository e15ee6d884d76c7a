"""Secrets in texts, with multipart credentials linked by interval joins (operator 3).

Strong patterns are reported wherever they stand. Weak candidates are parts of a credential: an
access identifier (a user, account or client name), a secret (a long token of mixed characters),
an endpoint (a host or address). Each part has a scope, ``REACH`` code points to either side. A weak
candidate is reported only if parts of both other kinds stand within its scope; a strong span counts as
the part it stands for. The join is by cells of the scope's width, so a part meets parts of its own and
the two neighbouring cells only, however long the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import map_batches, materialize

#: Code points to either side within which complementary parts are looked for.
REACH = 200

# fixed values of the base scan
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")

# parts of credentials: weak alone
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9_])(?:user(?:name)?|account|client_?id|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"(?<![A-Za-z0-9])(?:[a-z][a-z0-9+]{1,9}://[^\s\"'<>]{4,}|(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,})", re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
WEAK = ("account", "endpoint", "opaque")
_PART = {"assign": "secret", "access": "id", "hex": "secret", "account": "id", "endpoint": "endpoint", "opaque": "secret"}

_SPANS = "row bigint, kind string, part string, start int, stop int, weak boolean"


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, each leftmost and without overlap within its kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    """Parts that count only beside the other parts."""
    out = []
    if "=" in text or ":" in text:
        out += [("account", m.start(), m.end()) for m in ACCOUNT.finditer(text)]
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    for m in OPAQUE.finditer(text):
        token = m[0]
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            out.append(("opaque", m.start(), m.end()))
    return out


def apart(spans: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of ``found``, which are ordered by start."""
    starts = [a for _, a, _ in found]
    reach = list(accumulate((b for _, _, b in found), max))
    out = []
    for span in spans:
        before = bisect_left(starts, span[2])
        if not before or reach[before - 1] <= span[1]:
            out.append(span)
    return out


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    rows = []
    for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if not text:
            continue
        found = strong_spans(text)
        rows += [(row, k, _PART[k], a, b, False) for k, a, b in found]
        rows += [(row, k, _PART[k], a, b, True) for k, a, b in apart(weak_spans(text), found)]
    if not rows:
        return None
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["row", "kind", "part", "start", "stop", "weak"])


def scan_parts(docs: DataFrame, row_col: str, text_col: str = "text") -> DataFrame:
    """Every strong span and every weak candidate: ``row, kind, part, start, stop, weak``."""
    return map_batches(docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text")), _scan, _SPANS)


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Strong spans, and the weak ones with both other parts in their scope."""
    weak = parts.where("weak").withColumn("cell", F.floor(F.col("start") / reach).cast("int"))
    cells = F.explode(F.sequence(F.floor(F.col("start") / reach).cast("int"), F.floor((F.col("stop") - 1) / reach).cast("int")))
    held = parts.select("row", F.col("part").alias("other"), "start", "stop", cells.alias("at"))
    spots = held.groupBy("row", "at", "other").agg(F.collect_set(F.struct("start", "stop")).alias("spots"))
    near = weak.withColumn("at", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach).cast("int"), F.floor((F.col("stop") + reach) / reach).cast("int"))))
    met = near.join(spots, ["row", "at"]).where(
        (F.col("part") != F.col("other"))
        & F.exists("spots", lambda s: (s["start"] < F.col("stop") + reach) & (s["stop"] > F.col("start") - reach))
    )
    linked = met.groupBy("row", "kind", "start", "stop").agg(F.count_distinct("other").alias("kinds")).where("kinds = 2")
    return parts.where("not weak").select("row", "kind", "start", "stop").unionByName(linked.select("row", "kind", "start", "stop"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, stop) in code points.

    Null and empty texts have no spans. Rows are told apart by a hash of id and text, so rows
    that repeat both have the same spans, and a null id is a value like any other. Other columns
    are ignored. Spans are ordered by start, then kind in the order of ``KINDS + WEAK``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    found = link_parts(materialize(scan_parts(rows, "row"), "parts"), reach).distinct()
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS + WEAK]), F.col("kind"))
    spans = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "stop", "kind"))).alias("spans"))
    spans = spans.select("row", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,stop:int>>)")
    return rows.select("id", "row").join(spans, "row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans"))
