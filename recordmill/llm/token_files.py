"""Token ids in fixed-width bit-packed files (operator 9).

A file holds the ids of consecutive documents. Each id takes the fewest bits that can name every id of the
vocabulary; ``BLOCK`` ids form a block of whole 64-bit words, so a block's ids come back by a few
numpy shifts. The layout, little-endian::

    "TOKPACK1"                                magic
    packed blocks
    int64[blocks + 1]                         byte offset of each block
    int64[documents] ids, valid bytes         document ids; a zero byte marks a null id
    int64[documents + 1]                      first id of each document, in this file
    int64: bits, block size, ids, documents, offset of the block table; magic
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import materialize, new_path

MAGIC = b"TOKPACK1"
BLOCK = 4096
#: Words a worker remembers with their ids.
REMEMBERED = 400_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each; padded with zeros to whole blocks."""
    rows = -(-len(ids) // BLOCK) * (BLOCK // 64)
    padded = np.zeros(rows * 64, np.uint64)
    padded[: len(ids)] = ids
    cells = padded.reshape(rows, 64)
    out = np.zeros((rows, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= cells[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= cells[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(raw: bytes, bits: int) -> np.ndarray:
    """All ids of whole blocks."""
    words = np.frombuffer(raw, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.reshape(-1)


class Reader:
    """Random access to one file: ``ids(first, last)`` reads only the blocks that hold this range."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(48, size - 48)
        if tail[40:] != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        self.bits, self.block, self.n_ids, n, at = np.frombuffer(tail[:40], "<i8").tolist()
        blocks = -(-self.n_ids // self.block)
        index = self.file.read_at(at, size - 48 - at)
        self.offsets = np.frombuffer(index, "<i8", blocks + 1)
        cut = 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(index, "<i8", n, cut)
        self.valid = np.frombuffer(index, np.uint8, n, cut + 8 * n).astype(bool)
        self.starts = np.frombuffer(index, "<i8", n + 1, cut + 9 * n)

    def ids(self, first: int, last: int) -> np.ndarray:
        if first >= last:
            return np.empty(0, np.uint64)
        low, high = first // self.block, (last - 1) // self.block + 1
        raw = self.file.read_at(int(self.offsets[high] - self.offsets[low]), int(self.offsets[low]))
        return unpack(raw, self.bits)[first - low * self.block : last - low * self.block]

    def close(self) -> None:
        self.file.close()


#: Marks that end a word and are pre-tokens of their own.
_MARKS = b".,;:!?*#$%&"


@functools.lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordIds:
    """Ids of words between ASCII white space, remembered; equal to the library's for the whole text.

    Pre-tokens of these tokenizers never hold white space, so words are encoded apart. A word of
    letters only is one pre-token and goes to the model directly; anything else to the library.
    """

    def __init__(self, path: str, dtype):
        from tokenizers import Tokenizer

        self.whole, self.dtype = Tokenizer.from_file(path), dtype
        self.model = self.whole.model
        self.known: dict[bytes, bytes] = {}

    def _library(self, word: bytes) -> bytes:
        return np.array(self.whole.encode(word.decode("utf-8"), add_special_tokens=False).ids, self.dtype).tobytes()

    def _letters(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        low = text.lower()
        # a final sigma depends on its neighbours for Python, not for the library
        if not (text.isalpha() and low.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text)):
            return self._library(word)
        names = _byte_letters()
        return np.array([t.id for t in self.model.tokenize("".join([names[b] for b in low.encode("utf-8")]))], self.dtype).tobytes()

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        for word in words:
            if word in self.known:
                continue
            core = word.rstrip(_MARKS)
            tail = word[len(core) :]
            ids = self.known.get(core)
            if ids is None:
                ids = self.known[core] = self._letters(core) if core else b""
            if tail:
                if not core or core.decode("utf-8").isalpha():
                    if tail not in self.known:
                        self.known[tail] = self._library(tail)
                    ids = ids + self.known[tail]
                else:
                    ids = self._library(word)
                self.known[word] = ids

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        split = []
        for text in texts:
            raw = (text or "").encode("utf-8")
            # the names of special tokens are told apart by case
            split.append((raw if b"<|" in raw else raw.lower()).split())
        every = {w for words in split for w in words}
        self.learn({w for w in every if w not in self.known})
        if not every <= self.known.keys():
            self.learn(every)
        tail = np.array([end], self.dtype).tobytes()
        return [b"".join([*map(self.known.__getitem__, words), tail]) for words in split]


@functools.lru_cache(maxsize=2)
def _word_ids(path: str, dtype) -> WordIds:
    return WordIds(path, dtype)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, bits: int, end: int) -> Iterator[pa.RecordBatch]:
    dtype = np.uint16 if bits <= 16 else np.uint32
    part = TaskContext.get().partitionId()
    # every attempt writes a file of its own; only files of attempts that succeed are listed
    uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
    fs, name = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    doc_ids, valid, counts, offsets = [], [], [], [len(MAGIC)]
    left = np.empty(0, dtype)
    with fs.open_output_stream(name) as out:

        def put(ids: np.ndarray) -> None:
            out.write(pack(ids, bits))
            for _ in range(-(-len(ids) // BLOCK)):
                offsets.append(offsets[-1] + BLOCK * bits // 8)

        out.write(MAGIC)
        for batch in batches:
            texts = _word_ids(path, dtype).encode(batch.column(1).to_pylist(), end)
            for i in batch.column(0).to_pylist():
                doc_ids.append(i or 0), valid.append(i is not None)
            counts += [len(t) // dtype().itemsize for t in texts]
            ids = np.concatenate([left, np.frombuffer(b"".join(texts), dtype)])
            whole = len(ids) // BLOCK * BLOCK
            put(ids[:whole])
            left = ids[whole:].copy()
        put(left)
        starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        index = b"".join([
            np.array(offsets, "<i8").tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(valid, np.uint8).tobytes(), starts.astype("<i8").tobytes(),
        ])
        out.write(index)
        out.write(np.array([bits, BLOCK, starts[-1], len(counts), len(index)], "<i8").tobytes() + MAGIC)
    yield pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([uri]), pa.array([len(counts)], pa.int64()), pa.array([int(starts[-1])], pa.int64())],
        ["part", "uri", "n_docs", "n_ids"],
    )


def write_token_files(docs: DataFrame, tokenizer: str, vocab_size: int, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the texts in ascending id order into files below ``folder``, a URI all executors reach.

    Returns the list of files: ``part, uri, n_docs, n_ids, start``, where ``start`` counts the ids of all
    files before. Null and empty texts give the end id only; null document ids come first;
    rows with the same id are ordered by a hash of their text. Other columns are ignored.
    """
    bits = max(1, int(vocab_size - 1).bit_length())
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    files = ordered.mapInArrow(lambda it: _write(it, folder, tokenizer, bits, end_id), "part bigint, uri string, n_docs bigint, n_ids bigint")
    files = materialize(files, "token-files").where("n_docs > 0")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # one row per file


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader = Reader(uri)
            n, at = len(reader.doc_ids), 0
            while at < n:
                # documents of about a million ids at a time, one at least
                to = max(at + 1, int(np.searchsorted(reader.starts, reader.starts[at] + (1 << 20), "right")) - 1)
                to = min(to, n)
                first = int(reader.starts[at])
                ids = reader.ids(first, int(reader.starts[to])).astype("<u4")
                cuts = reader.starts[at : to + 1] - first
                blobs = [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids[at:to], pa.int64(), mask=~reader.valid[at:to]),
                        pa.array(reader.starts[at:to] + base),
                        pa.array(np.diff(cuts)),
                        pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )
                at = to
            reader.close()


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents of listed files: ``doc_id, start, n_tokens, ids_crc32, ids`` (unsigned 32-bit, little-endian)."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.select("uri", "start").repartition(parts, "uri")
    return spread.mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def token_folder(docs: DataFrame) -> str:
    """A new folder below the shared one, as a URI."""
    path = new_path(docs.sparkSession, "tokens")
    return path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1)
