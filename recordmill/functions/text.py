"""String expressions: keyword rules, tokens, character counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill.functions.bind import let
from recordmill.functions.hashing import _col

Rule = tuple[str, Sequence[str]]

# ASCII word edges: the same in every regex engine, also next to accented letters.
EDGE_LEFT = "(?<![0-9A-Za-z_])"
EDGE_RIGHT = "(?![0-9A-Za-z_])"
SPACE = "[ \\t\\r\\n\\f]"


def keyword_pattern(words: Sequence[str], plural: bool = True) -> str:
    body = "|".join(re.escape(w) for w in words)
    return f"{EDGE_LEFT}(?:{body}){'s?' if plural else ''}{EDGE_RIGHT}"


def keyword_class(text: Column | str, rules: Sequence[Rule], plural: bool = True) -> Column:
    """First category in rule order whose keywords occur as words; null if none does.

    A plain substring test comes first: it is a byte scan, and most texts need no regex after it.
    """
    lowered = F.lower(_col(text))

    def occurs(words: Sequence[str]) -> Column:
        some = reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])
        return some & lowered.rlike(keyword_pattern(words, plural))

    return F.coalesce(*[F.when(occurs(ws), F.lit(cat)) for cat, ws in rules])


def tiered_class(*tiers: Column, default: str = "unknown") -> Column:
    """First tier that gives a category, else ``default``."""
    return F.coalesce(*tiers, F.lit(default))


def improve_only(old: Column, new: Column, garbage: Column, unknown: str = "unknown") -> Column:
    """Take ``new`` where it says something, or where ``old`` came from a garbage value."""
    change = (~new.eqNullSafe(old)) & (
        (new != F.lit(unknown)) | F.coalesce(garbage, F.lit(False))
    )
    return F.when(F.coalesce(change, F.lit(False)), new).otherwise(old)


def first_nonempty(*cols: Column | str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in cols])


def before(text: Column | str, delimiter: str) -> Column:
    return F.trim(F.split_part(_col(text), F.lit(delimiter), F.lit(1)))


def normalize_name(text: Column | str) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]", "")


def name_tokens(text: Column | str, min_len: int = 4) -> Column:
    """Distinct lower-case alphanumeric runs of at least ``min_len`` characters."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(_col(text)), F.lit(f"[a-z0-9]{{{min_len},}}"), F.lit(0))
    )


def char_count(text: Column | str, char: str) -> Column:
    c = _col(text)
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def char_ratio(text: Column | str, char: str) -> Column:
    """Share of one character, rounded to 4 digits; null for the empty string."""
    c = _col(text)
    return F.round(char_count(c, char) / F.nullif(F.length(c), F.lit(0)), 4)


def chars_outside(text: Column | str, allowed: str) -> Column:
    """Sorted distinct characters outside the regex character class ``allowed``."""
    rest = F.regexp_replace(_col(text), f"[{allowed}]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(rest, ""), lambda c: c != "")))


def positional_identity(a: Column, b: Column, gap: str = "-") -> Column:
    """Share of equal characters over the positions where neither side has a gap."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    valid = F.filter(pairs, lambda p: (p["x"] != gap) & (p["y"] != gap))
    same = F.size(F.filter(valid, lambda p: p["x"] == p["y"]))
    return same / F.nullif(F.size(valid), F.lit(0))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """``1 - distance / longer length``; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def shingle_hashes(text: Column | str, k: int = 3) -> Column:
    """Distinct 64-bit hashes of runs of ``k`` words; a shorter text gives one shingle."""
    words = F.filter(F.split(F.lower(_col(text)), f"{SPACE}+"), lambda w: w != "")

    def runs(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws) - (k - 1))
        return F.when(
            F.size(ws) >= k,
            F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", F.slice(ws, i, k)))),
        ).otherwise(F.array(F.xxhash64(F.concat_ws(" ", ws))))

    # Bound, so that the text is split once and not once per run.
    return F.array_distinct(let(lambda v: runs(v["words"]), words=words))


_A, _B, _C, _WORD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0x9FB21C651E98DF25))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


#: Characters whose words are hashed at once.
HASHED = 1 << 16


def shingle_sets(texts: Sequence[str], seeds: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of runs of ``k`` words of every text, ascending, one after the other, and how many each text has.

    A shorter text gives one shingle. Texts with different seeds have none in common. The same sets as those
    of :func:`shingle_hashes` for lower-case texts, by arrays.
    """
    ends = np.cumsum([len(t) for t in texts])
    cuts = [0, *(np.flatnonzero(np.diff(ends // HASHED)) + 1).tolist(), len(texts)]
    parts = [_shingle_sets(texts[i:j], seeds[i:j], k) for i, j in zip(cuts, cuts[1:]) if i < j]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _shingle_sets(texts: Sequence[str], seeds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = ~((codes == 32) | (codes == 9) | (codes == 10) | (codes == 12) | (codes == 13))
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first = np.flatnonzero(edge == 1)
    sizes = np.flatnonzero(edge == -1) - first
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
    words = np.empty(0, np.uint64)
    if len(first):
        at = np.cumsum(sizes) - sizes
        power = np.cumprod(np.full(sizes.max(), _WORD))
        values = mix(codes[inside] + _C) * power[np.arange(sizes.sum()) - np.repeat(at, sizes)]
        words = mix(np.add.reduceat(values, at))
    per = np.bincount(doc, minlength=len(texts))
    runs = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :]) if len(doc) >= k else np.empty(0, np.int64)
    short = np.flatnonzero(per < k)
    start = (np.cumsum(per) - per)[short]
    long, rest = np.zeros(len(runs), np.uint64), np.zeros(len(short), np.uint64)
    for i in range(k):
        long = mix(long * _B + words[runs + i])
        some = per[short] > i
        rest[some] = mix(rest[some] * _B + words[start[some] + i])
    owner = np.concatenate([doc[runs], short])
    found = mix(np.concatenate([long, rest]) + np.minimum(per[owner], k).astype(np.uint64) ^ mix(seeds[owner]))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.bincount(owner[new], minlength=len(texts))


#: Characters counted at once; a table of counts has a place for every code point.
COUNTED = 1 << 20


def count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(name, ch, n)``: how often each character stands in the texts of a name, from rows ``(name, text)``."""

    def count(found: dict, name, texts: list[str]) -> None:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        for at in range(0, len(codes), COUNTED):
            times = np.bincount(codes[at : at + COUNTED])
            found.setdefault(name, Counter()).update({c: int(times[c]) for c in np.flatnonzero(times).tolist()})

    for batch in batches:
        found: dict = {}
        held: dict = {}
        for name, one in zip(batch.column(0).to_pylist(), batch.column(1)):
            texts, size = held.pop(name, ([], 0))
            texts.append(one.as_py())
            size += len(texts[-1])
            if size >= COUNTED:
                count(found, name, texts)
            else:
                held[name] = texts, size
        for name, (texts, _) in held.items():
            count(found, name, texts)
        rows = [(name, chr(c), n) for name, mine in found.items() for c, n in mine.items()]
        columns = [[r[k] for r in rows] for k in range(3)]
        types = [batch.schema.field(0).type, pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "ch", "n"])
