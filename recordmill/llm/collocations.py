"""Phrase collocations by three-way quicksort of suffix pointers (operator 11).

Every word of a piece of text begins a suffix; phrases are prefixes of suffixes. One pass counts the words of each
language. A second one sends suffixes, cut to the longest phrase and added up where a task sees one again, to a route
chosen by their leading word; words that occur too seldom begin and continue nothing. In a route an array of pointers is
sorted by multikey three-way quicksort: a part is split around a pivot word into smaller, equal and larger, all parts
of a route at once. The size of an equal part is the count of its phrase, and it goes on with the next word; parts
smaller than the least count are abandoned.

Suffixes of a leading word that is itself too frequent for a route are sent once for every length of phrase, cut to it and routed
by all their words, so no word, pair or passage gathers in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import bit_filter, materialize
from recordmill.llm.shingles import WordHashes, mix

#: Suffixes that a route holds on average, and that a task adds up before it sends them on.
ROUTE, CHUNK = 1 << 20, 1 << 20
#: Words that a task counts before it sends them on.
VOCABULARY = 400_000
#: Width of a band of scores, of which there are 1001.
BAND = 1000
#: A word goes by several routes from this share of a route on; at most ``MOST_HOT`` words are as frequent.
HOT, MOST_HOT = ROUTE // 4, 1 << 16

# fixed values: upper case, the ends of pieces and the white space inside them
_BYTES = bytearray(range(256))
_BYTES[65:91] = range(97, 123)
_BYTES[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _BYTES[_c] = 10
_BYTES = bytes(_BYTES)

_A = np.uint64(0x94D049BB133111EB)
_hashes = WordHashes()
_END, _NONE = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n", b""))


def words(text: str | None) -> list[bytes]:
    """Words in order, empty strings, and a line feed wherever a piece ends."""
    return text.encode("utf-8").translate(_BYTES).replace(b"\n", b" \n ").split(b" ") if text else []


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text:
            held = out.setdefault(lang, [])
            held += words(text)
            held.append(b"\n")
    return out


def _ids(hashes: np.ndarray, lang: str) -> np.ndarray:
    """Words of different languages have different ids; 0 stands for no word."""
    out = mix(hashes + np.uint64(xxhash.xxh3_64_intdigest(b"lang " + lang.encode("utf-8"))))
    out[out == 0] = 1
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            counts.pop(b"", None), counts.pop(b"\n", None)
            keys = list(counts)
            h = _ids(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), lang).view(np.int64)
            text = pa.array([k.decode("utf-8") for k in keys], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([lang] * len(keys), pa.string()), text, pa.array(list(counts.values()), pa.int64())], ["h", "lang", "word", "n"])
        seen.clear()

    for batch in batches:
        for lang, found in _by_lang(batch).items():
            seen.setdefault(lang, Counter()).update(found)
        if sum(map(len, seen.values())) > VOCABULARY:
            yield from flush()
    yield from flush()


def _routes(batches: Iterator[pa.RecordBatch], keep, hot, routes: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Suffixes by route: packed ids of their words and the number of times they were seen."""
    held: list[np.ndarray] = []
    seen = 0

    def flush() -> Iterator[pa.RecordBatch]:
        w = np.concatenate(held, axis=1)
        key = w[0].copy()
        keys = []
        for row in w[1:]:
            key = mix(key * _A + row)
            keys.append(key)
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        w, n = w[:, first], n.astype(np.uint64)
        often = hot.value[np.minimum(np.searchsorted(hot.value, w[0]), len(hot.value) - 1)] == w[0] if len(hot.value) else np.zeros(len(n), bool)
        p = np.uint64(routes)
        parts = [(mix(w[0, ~often]) % p, w[:, ~often], n[~often])]
        for size in range(2, longest + 1 if often.any() else 0):
            long = np.flatnonzero(often & (w[size - 1] > 0))
            _, at, inverse = np.unique(keys[size - 2][first[long]], return_index=True, return_inverse=True)
            cols = w[:, long[at]].copy()
            cols[size:] = 0
            times = np.bincount(inverse, n[long].astype(float), len(at)).astype(np.uint64)
            parts.append((mix(keys[size - 2][first[long[at]]]) % p + p * np.uint64(size - 1), cols, times))
        for route, cols, times in parts:
            order = np.argsort(route, kind="stable")
            route, cols, times = route[order], cols[:, order], times[order]
            names, at = np.unique(route, return_index=True)
            ends = [*at[1:].tolist(), len(route)]
            blobs = [np.vstack([cols[:, a:b], times[None, a:b]]).tobytes() for a, b in zip(at.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blobs, pa.binary())], ["route", "suffixes"])

    for batch in batches:
        for lang, found in _by_lang(batch).items():
            h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
            h = h[h != _NONE]
            w = np.append(_ids(h, lang), np.zeros(longest, np.uint64))
            w[: len(h)][h == _END] = 0
            live = w != 0
            live[live] = keep(w[live].view(np.int64))
            w[~live] = 0
            n = len(h)
            begin = np.flatnonzero(live[:n] & live[1 : n + 1])
            if not len(begin):
                continue
            rows = np.stack([w[begin + k] for k in range(longest)])
            for k in range(3, longest):
                rows[k][rows[k - 1] == 0] = 0
            held.append(rows)
            seen += len(begin)
        if seen >= CHUNK:
            yield from flush()
            held, seen = [], 0
    if seen:
        yield from flush()


def count_prefixes(w: np.ndarray, n: np.ndarray, least: int) -> list[tuple[np.ndarray, int]]:
    """Prefixes of at least two words that occur ``least`` times or more: (words, count).

    ``w`` has a row per position and a column per suffix, 0 after its end; ``n`` counts each.
    """
    out: list[tuple[np.ndarray, int]] = []
    pointers = np.arange(w.shape[1])
    starts, depth = np.zeros(1, np.int64), np.zeros(1, np.int64)
    flat, width = w.ravel(), w.shape[1]
    while len(pointers):
        sizes = np.diff(np.append(starts, len(pointers)))
        part = np.repeat(np.arange(len(starts)), sizes)
        words_here = flat[depth[part] * width + pointers]
        pivot = words_here[starts + sizes // 2][part]
        side = np.where(words_here == pivot, 1, np.where(words_here < pivot, 0, 2))
        place = part * 3 + side
        counts = np.bincount(place, n[pointers], 3 * len(starts)).astype(np.int64)
        rows = np.bincount(place, minlength=3 * len(starts))
        # move the pointers: parts in order, in each the smaller, the equal and the larger ones
        to = np.empty(len(pointers), np.int64)
        begin = np.cumsum(rows) - rows
        for s in range(3):
            here = np.flatnonzero(side == s)
            own = place[here]
            # places within one part are consecutive in ``here``
            new = np.ones(len(here), bool)
            new[1:] = own[1:] != own[:-1]
            at = np.flatnonzero(new)
            rank = np.arange(len(here)) - np.repeat(at, np.diff(np.append(at, len(here))))
            to[begin[own] + rank] = pointers[here]
        level = np.repeat(depth, 3)
        equal = np.arange(len(rows)) % 3 == 1
        level[equal] += 1
        alive = (rows > 0) & (counts >= least)
        first = to[np.minimum(begin, len(to) - 1)]
        ended = equal & alive & (flat[np.minimum(level - 1, w.shape[0] - 1) * width + first] == 0)
        alive &= ~ended
        for k in np.flatnonzero(alive & equal & (level >= 2)):
            out.append((w[: level[k], first[k]], int(counts[k])))
        alive &= level < w.shape[0]
        keep = np.repeat(alive, rows)
        pointers = to[keep]
        depth, rows = level[alive], rows[alive]
        starts = np.cumsum(rows) - rows
    return out


def _sort(key: tuple, held: pa.Table, least: int, routes: int, longest: int) -> pa.Table:
    blobs = [np.frombuffer(b, np.uint64).reshape(longest + 1, -1) for b in held.column(1).to_pylist()]
    both = np.concatenate(blobs, axis=1)
    w, n = both[:longest], both[longest].astype(np.float64)
    mixed = np.random.default_rng(0).permutation(w.shape[1])
    found = count_prefixes(np.ascontiguousarray(w[:, mixed]), n[mixed], least)
    if key[0].as_py() >= routes:
        found = [(p, c) for p, c in found if len(p) == key[0].as_py() // routes + 1]
    columns = [pa.array([p.view(np.int64).tolist() for p, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.int64())]
    return pa.table(columns, ["ids", "a"])


def vocabulary(docs: DataFrame, text_col: str, lang: str) -> DataFrame:
    """``h, lang, word, n``: every word of every language with its count; written."""
    counted = docs.select(lang, text_col).mapInArrow(_count, "h bigint, lang string, word string, n bigint")
    return materialize(counted.groupBy("h").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n")), "vocabulary")


def phrases(docs: DataFrame, vocab: DataFrame, text_col: str, lang: str, longest: int, least: int) -> DataFrame:
    """``ids, a``: every phrase of 2 to ``longest`` words that occurs at least ``least`` times."""
    spark = docs.sparkSession
    total = vocab.agg(F.sum("n")).first()[0] or 0
    routes = max(1, -(-total // ROUTE))
    limit = max(HOT, total // MOST_HOT)
    # all counts add up to the total, so at most MOST_HOT words reach the limit
    hot = np.sort(np.array([r.h for r in vocab.where(F.col("n") > limit).select("h").collect()], np.int64).view(np.uint64))
    args = (bit_filter(vocab.where(F.col("n") >= least).select("h")), spark.sparkContext.broadcast(hot), routes, longest)
    sent = docs.select(lang, text_col).mapInArrow(lambda batches: _routes(batches, *args), "route bigint, suffixes binary")
    found = sent.repartition(max(2 * routes, 8), "route").groupBy("route").applyInArrow(lambda key, held: _sort(key, held, least, routes, longest), "ids array<bigint>, a bigint")
    return materialize(found, "phrases")


def score(a: str, left: str, right: str) -> Column:
    """``floor(1000000 a a / (left right))`` by exact decimals; counts have up to 15 digits and are at least ``a``."""
    x, y, z = (f"cast({c} as decimal(15,0))" for c in (a, left, right))
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({x} * {x})) div ({y} * {z})")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10,
    cover: int = 50, best: int = 2000, unknown: str = "und",
) -> DataFrame:
    """The ``best`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of ``a`` occurrences cut after its first words into parts of ``l`` and ``r`` occurrences scores
    ``floor(1000000 a a / (l r))``; the cut with the lowest score counts, the first of equal ones. A phrase inside a longer
    one that has at least ``cover`` percent of its occurrences is left out. Phrases do not cross ends of
    sentences or lines; null and empty texts have none, texts without a language count as ``unknown``. Ties
    are ordered by count, then bytewise by phrase. Repeated rows count repeatedly; other columns are ignored.
    Words are told apart by 64-bit hashes.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(unknown)).alias("lang"), F.col(text_col).alias("text"))
    vocab = vocabulary(rows, "text", "lang")
    found = phrases(rows, vocab, "text", "lang", longest, least)
    # counts of all frequent sequences, single words too: every part of a frequent phrase is among them
    counts = found.unionByName(vocab.where(F.col("n") >= least).select(F.array("h").alias("ids"), F.col("n").alias("a")))
    counts = materialize(counts, "counts")
    cuts = found.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("x"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("y"))
    cuts = cuts.join(counts.select(F.col("ids").alias("x"), F.col("a").alias("l")), "x").join(counts.select(F.col("ids").alias("y"), F.col("a").alias("r")), "y")
    cuts = cuts.withColumn("score", score("a", "l", "r"))
    scored = cuts.groupBy("ids").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("s")).select("ids", "s.*")
    inside = found.where(F.size("ids") > 2).select(
        F.col("a").alias("longer"), F.explode(F.expr(
            "flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), i -> slice(ids, i, m))))"
        )).alias("ids"),
    ).groupBy("ids").agg(F.max("longer").alias("longer"))
    free = scored.join(inside, "ids", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    names = vocab.where(F.col("n") >= least).select("h", "lang", "word")
    free = materialize(free.select("ids", F.element_at("ids", 1).alias("h"), "a", "l", "r", "score").join(names, "h").drop("h", "word"), "scored")
    order = [F.col("score").desc(), F.col("a").desc()]
    # scores in bands: the bands that hold the best are known from their counts, so no task orders all phrases of a language
    banded = free.withColumn("band", F.expr(f"score div {BAND}"))
    above = Window.partitionBy("lang").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = banded.groupBy("lang", "band").agg(F.count("*").alias("m")).withColumn("above", F.coalesce(F.sum("m").over(above), F.lit(0)))
    lowest = counted.where(F.col("above") < best).groupBy("lang").agg(F.min("band").alias("lowest"))
    near = banded.join(lowest, "lang").where(F.col("band") >= F.col("lowest"))
    near = near.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at") <= best)
    near = near.select(F.monotonically_increasing_id().alias("row"), "ids", "lang", "a", "l", "r", "score")
    near = materialize(near, "near-best")
    spelt = near.select("row", F.posexplode("ids").alias("at", "h")).join(names.select("h", "word"), "h")
    spelt = spelt.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w")).select("row", F.array_join("w.word", " ").alias("phrase"))
    total = vocab.groupBy("lang").agg(F.sum("n").alias("n"))
    top = near.join(spelt, "row").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.col("phrase"))))
    top = top.where(F.col("rank") <= best).join(total, "lang")
    return top.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
