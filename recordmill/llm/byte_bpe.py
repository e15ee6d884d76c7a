"""Byte-level BPE encoding and decoding by a global shuffle of distinct words (operator 6).

Texts are cut into pre-tokens with the given pattern. The most frequent words, at most
``FREQUENT`` of them, are encoded once and their ids given to every task (a table of bounded
size; without it a few words would be the hot keys of the shuffle). Every other distinct word of a
batch of documents travels to the task that owns it, which encodes each distinct word once; the
ids travel back and are put in place by position. Words travel packed, a batch and an owner to a
row, because one row per pre-token would shuffle several times the corpus. Decoding joins ids with
the table of token bytes.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids are given to every task; 65,535 marks any other word in the 16-bit codes.
FREQUENT = 65_535
#: Rows on average from which the frequent words are taken. The choice decides how fast the rest goes, not what comes out.
SAMPLE_ROWS = 20_000
#: Words a task counts at once; beyond, it forgets the rarest.
COUNTED = 4 * FREQUENT


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in a row, and start and length of each id (0 for ids not in the file)."""
    ranks = load_ranks(path)
    n = max(ranks.values()) + 1
    by_id: list[bytes] = [b""] * n
    for token, i in ranks.items():
        by_id[i] = token
    lens = np.fromiter(map(len, by_id), np.int64, n)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lens) - lens, lens


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the slices ``starts[i] : starts[i] + lens[i]``, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def _pack(parts: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, parts), np.uint32, len(parts))
    return zstandard.compress(np.uint32(len(parts)).tobytes() + lens.tobytes() + b"".join(parts), 3)


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, n, 4).astype(np.int64), raw[4 + 4 * n :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(text.split(" ") if text else ())
            if len(counts) > COUNTED:
                counts = Counter(dict(counts.most_common(COUNTED // 2)))
    top = [(w, n) for w, n in counts.most_common(2 * FREQUENT) if w]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])


def frequent_words(texts: DataFrame, pattern: str) -> list[str]:
    """The pre-tokens of the words most frequent between spaces in a sample of the column of ``texts``."""
    share = min(1.0, SAMPLE_ROWS / max(1, texts.count()))
    if share < 1:
        texts = texts.sample(share, 1)
    counted = texts.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").collect()
    cut = regex.compile(pattern)
    found: dict[str, None] = {}
    for (word,) in rows:
        for token in cut.findall(" " + word):
            found.setdefault(token)
    return list(found)[:FREQUENT]


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        return FREQUENT


def _skeletons(batches: Iterator[pa.RecordBatch], shared, pattern: str, owners: int) -> Iterator[pa.RecordBatch]:
    """One row for a batch (owner -1: codes and references by position) and one per owner of its other words."""
    cut = regex.compile(pattern)
    code = _Codes((w, i) for i, w in enumerate(shared.value))
    task = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [cut.findall(t) for t in texts]
        ends = np.cumsum([len(t) for t in tokens])
        words = [w for t in tokens for w in t]
        codes = np.fromiter(map(code.__getitem__, words), np.uint16, len(words))
        rare = [words[i] for i in np.flatnonzero(codes == FREQUENT).tolist()]
        distinct = sorted({w.encode("utf-8") for w in rare}, key=lambda w: (xxhash.xxh32_intdigest(w) % owners, w))
        place = {w: i for i, w in enumerate(distinct)}
        refs = np.fromiter((place[w.encode("utf-8")] for w in rare), np.uint32, len(rare))
        h = xxhash.xxh3_128(f"{task} {number}")
        h.update(codes.tobytes()), h.update(refs.tobytes())
        key = h.digest()
        ids = batch.column(0)
        owner, blob = [-1], [_pack([ends.astype(np.int64).tobytes(), codes.tobytes(), refs.tobytes()])]
        part = np.fromiter((xxhash.xxh32_intdigest(w) % owners for w in distinct), np.int64, len(distinct))
        for o in np.unique(part).tolist():
            owner.append(o)
            blob.append(_pack(distinct[np.searchsorted(part, o) : np.searchsorted(part, o, "right")]))
        docs = pa.array([ids.to_pylist()] + [None] * (len(owner) - 1), pa.list_(ids.type))
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(owner)), pa.array(owner, pa.int32()), docs, pa.array(blob, pa.binary())], ["key", "owner", "ids", "blob"])


def _encode_words(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = _encoding(path, pattern)._encode_single_piece
    known: dict[bytes, bytes] = {}
    for batch in batches:
        out = []
        for blob in batch.column(2).to_pylist():
            lens, raw = _unpack(blob)
            ends = np.cumsum(lens).tolist()
            reply, at = [], 0
            for end in ends:
                word, at = raw[at:end], end
                ids = known.get(word)
                if ids is None:
                    if len(known) >= 1 << 20:
                        known.clear()
                    ids = known[word] = np.array(encode(word), np.uint32).tobytes()
                reply.append(ids)
            out.append(_pack(reply))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["key", "owner", "blob"])


def _assemble(batches: Iterator[pa.RecordBatch], shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    common_lens, common_ids = shared.value
    for batch in batches:
        for ids, blob, replies in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lens, raw = _unpack(blob)
            cut = np.cumsum(lens)
            ends = np.frombuffer(raw[: cut[0]], np.int64)
            codes = np.frombuffer(raw[cut[0] : cut[1]], np.uint16).astype(np.int64)
            refs = np.frombuffer(raw[cut[1] :], np.uint32)
            got = [_unpack(r["blob"]) for r in sorted(replies or (), key=lambda r: r["owner"])]
            word_lens = np.concatenate([*[x[0] for x in got], np.empty(0, np.int64)]) // 4
            if len(refs) and int(refs.max()) >= len(word_lens):
                raise RuntimeError("words of a batch are missing: its rows were computed twice in another order")
            table_lens = np.concatenate([common_lens, word_lens])
            table_ids = np.concatenate([common_ids, np.frombuffer(b"".join(x[1] for x in got), np.uint32)])
            starts = np.cumsum(table_lens) - table_lens
            codes[codes == FREQUENT] = refs.astype(np.int64) + len(common_lens)
            each = table_lens[codes]
            all_ids = table_ids[gather(starts[codes], each)]
            upto = np.concatenate([[0], np.cumsum(each)])[ends] * 4
            bounds = pa.array(np.concatenate([[0], upto]).astype(np.int64))
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, bounds.buffers()[1], pa.py_buffer(all_ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([ids.values, blobs.cast(pa.binary())], names)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: the id column and ``ids``, little-endian unsigned 32-bit integers.

    ``ranks`` is a file of base64 tokens and ranks that every executor can open. Null and empty
    texts have no ids. Repeated rows and rows with a null id are encoded like any other; other
    columns are ignored. ``docs`` must give the same rows in the same order if it is computed
    again (a scan or written table does); otherwise the job fails rather than mix batches.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    frequent = frequent_words(rows.select("text"), pattern)
    common = [np.array(_encoding(ranks, pattern)._encode_single_piece(w.encode("utf-8")), np.uint32) for w in frequent]
    shared = spark.sparkContext.broadcast(frequent)
    shared_ids = spark.sparkContext.broadcast((np.fromiter(map(len, common), np.int64, len(common)), np.concatenate([*common, np.empty(0, np.uint32)])))
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(
        lambda it: _skeletons(it, shared, pattern, owners), f"key binary, owner int, ids array<{kind}>, blob binary"
    )
    words = packed.where("owner >= 0").select("key", "owner", "blob").repartition(owners, "owner")
    replies = words.mapInArrow(lambda it: _encode_words(it, ranks, pattern), "key binary, owner int, blob binary")
    replies = replies.groupBy("key").agg(F.collect_list(F.struct("owner", "blob")).alias("replies"))
    both = packed.where("owner < 0").join(replies, "key", "left").select("ids", "blob", "replies")
    return both.mapInArrow(lambda it: _assemble(it, shared_ids, [id_col, "ids"]), f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """Bytes of every row's ``ids``: the id column, ``ids`` and ``decoded``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, starts, lens = _token_bytes(ranks)
        for batch in batches:
            out = []
            for blob in batch.column(1):
                if not blob.is_valid:
                    out.append(None)
                    continue
                ids = np.frombuffer(blob.as_buffer(), "<u4")
                out.append(raw[gather(starts[ids], lens[ids])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")
