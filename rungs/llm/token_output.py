"""Token ids of documents as bit-plane files: fixed-size blocks of ids, cut into byte or bit planes, each compressed."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions

BLOCK_IDS = 16_384
#: Ids after which a chunk is closed; a document is never cut, so that one chunk may hold a longer document.
CHUNK_IDS = 262_144
#: Characters of the longest piece of text, and bytes of pieces and ids, about, that a Python worker remembers.
LONGEST, MEMORY = 64, 96 << 20
#: Bytes that an entry takes besides its text and ids.
_ENTRY = 200

_FILES = "shard int, chunk int, n_docs int, n_ids long, doc_ids array<long>, n_tokens array<int>, planes array<binary>, plane_kind string, block_ids int"
_ROWS = "doc_id long, shard int, chunk int, offset long, n_tokens long, ids_crc32 long"


class Encoder:
    """Ids of a text, as little-endian bytes, from the tokenizers library, which is asked once for each piece of text.

    A byte-level BPE never joins a token over a space that follows something else than white space, so that a text
    may be cut before such spaces. Pieces that are not remembered are cut into words by the library's own
    pre-tokenizer (one of letters alone is one word) and these go through its model. Texts that hold an added token,
    and tokenizers of another kind, are encoded whole.
    """

    _known: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.added = [a.content for a in t.get_added_tokens_decoder().values()]
        self.by_piece = isinstance(t.model, models.BPE) and isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) and t.normalizer is None and not t.pre_tokenizer.add_prefix_space
        self.model, self.split = t.model, t.pre_tokenizer and t.pre_tokenizer.pre_tokenize_str
        self.memory: dict[str, bytes] = {}  # of what stands after a space
        self.words: dict[str, bytes] = {}  # of words as the model sees them
        self.size = [0, 0]  # bytes of both
        # the letters that byte-level models have for bytes: printable ones stay, the others follow after 255
        odd = iter(range(256, 512))
        self.letters = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else chr(next(odd)) for b in range(256)}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One for each worker process and file."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = self._cut.split(text) if any(s in text for s in self._doubtful) else text.split(" ")
        memory = self.memory
        try:
            after = b"".join(map(memory.__getitem__, rest))
        except KeyError:
            after = b"".join([self.remembered(x) for x in rest])
        return self.piece(first, first) + after

    #: White space before a space, as the library sees it; and cuts before a space that follows anything else.
    _doubtful = [chr(c) + " " for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    _cut = re.compile(r"(?<=\S) ")

    #: The pattern of byte-level BPE, for Latin letters; the library's own is asked about everything else.
    _latin = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\t-\r \x85\xa0\p{L}\p{N}]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")

    def remembered(self, x: str) -> bytes:
        ids = self.memory.get(x)
        if ids is None:
            ids = self.piece(" " + x, x)
            self.keep(0, self.memory, x, ids)
        return ids

    def keep(self, which: int, memory: dict[str, bytes], x: str, ids: bytes) -> None:
        """Remembers the ids of x, unless x is long; forgets everything first where there is no room."""
        if len(x) <= LONGEST:
            if self.size[which] > MEMORY // 2:
                memory.clear()
                self.size[which] = 0
            memory[x] = ids
            self.size[which] += len(x) + len(ids) + _ENTRY

    def piece(self, piece: str, core: str) -> bytes:
        if piece and max(piece) < "\u0250":
            words = [piece] if core.isalpha() else self._latin.findall(piece)
            return b"".join([self.words.get(w) or self.word(w, w.encode().decode("latin-1").translate(self.letters)) for w in words])
        return b"".join([self.word("", w) for w, _ in self.split(piece)])

    def word(self, word: str, mapped: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if word:
            self.keep(1, self.words, word, ids)
        return ids


def planes_of(ids: np.ndarray, kind: str, level: int = 3) -> bytes:
    """A block of ids, transposed to bit or byte planes and compressed plane by plane: count, plane lengths, planes."""
    flat = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "bit":
        flat = np.packbits(np.unpackbits(flat.reshape(4, -1, 1), axis=2, bitorder="little").transpose(0, 2, 1).reshape(32, -1), axis=1)
    squeeze = zstandard.ZstdCompressor(level=level)
    parts = [squeeze.compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in flat]
    return np.array([len(ids), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def ids_of(block: bytes, kind: str) -> np.ndarray:
    """The ids that planes_of() was given."""
    n_planes = 32 if kind == "bit" else 4
    head = np.frombuffer(block, "<u4", n_planes + 1)
    n, at = int(head[0]), 4 * (n_planes + 1)
    width = (n + 7) // 8 if kind == "bit" else n
    flat = np.zeros((n_planes, width), np.uint8)
    for k, size in enumerate(map(int, head[1:])):
        if size:
            flat[k] = np.frombuffer(zstandard.decompress(block[at : at + size]), np.uint8)
        at += size
    if kind == "bit":
        bits = np.unpackbits(flat, axis=1)[:, :n].reshape(4, 8, n)
        flat = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(4, n)
    return np.ascontiguousarray(flat.T).view("<u4").reshape(-1)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, kind: str = "byte", block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS) -> str:
    """Writes the ids of docs (doc_id, text) to path, in ascending doc_id order, and returns path.

    Each document is followed by end_id. A file holds chunks (rows): whole documents, their ids and lengths, and the
    ids in blocks of block_ids as zstandard-compressed byte (or bit) planes; the columns before the planes are the
    chunk index. Spark's writer commits the files, so that lost or repeated tasks leave no half-written ones. Null
    and empty texts have the end id alone; null ids come first; rows of one id follow in order of text; repeated
    rows are kept; no rows, no chunks. Other columns are not read.
    """
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, chunk, held = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0, []
        end, size = np.array([end_id], "<u4").tobytes(), 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            blocks = [planes_of(ids[i : i + block_ids], kind) for i in range(0, len(ids), block_ids)]
            row = [shard, chunk, len(held), len(ids), [d for d, _ in held], [len(x) // 4 for _, x in held], blocks, kind, block_ids]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.string(), pa.int32()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _FILES.split(", ")])

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    held.append((d, encoder.encode(t) + end))
                    size += len(held[-1][1]) // 4
                    if size >= chunk_ids:
                        yield close()
                        held, size, chunk = [], 0, chunk + 1
        if held:
            yield close()

    rows.mapInArrow(chunks, _FILES).write.option("compression", "none").parquet(path)
    return path


def chunk_index(spark, path: str) -> DataFrame:
    """shard, chunk, n_docs, n_ids, start: the chunk index, with the number of ids before each chunk."""
    index = spark.read.schema(_FILES).parquet(path).select("shard", "chunk", "n_docs", "n_ids")
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    before = lambda w: F.coalesce(F.sum("_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before(W.orderBy("shard")).alias("_start"))  # a row a shard
    index = index.withColumn("_ids", F.col("n_ids")).withColumn("_before", before(W.partitionBy("shard").orderBy("chunk")))
    return index.join(shards, "shard").select("shard", "chunk", "n_docs", "n_ids", (F.col("_start") + F.col("_before")).alias("start"))


def read_tokens(spark, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or, as a digest, ids_crc32) of each document in the files at path.

    start: ids of all documents before it. The CRC-32 is that of the ids as little-endian unsigned 32-bit integers.
    """
    out = _ROWS if digest else _ROWS.replace("ids_crc32 long", "ids array<long>")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in out.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.concatenate([ids_of(b, r["plane_kind"]) for b in r["planes"]])
                counts = np.array(r["n_tokens"], np.int64)
                ends = counts.cumsum()
                starts = ends - counts
                last = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64()) if digest else pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64()))
                n = len(counts)
                yield pa.record_batch([pa.array(r["doc_ids"], pa.int64()), pa.array(np.full(n, r["shard"], np.int32)), pa.array(np.full(n, r["chunk"], np.int32)), pa.array(starts), pa.array(counts), last], names=names)

    rows = spark.read.schema(_FILES).parquet(path).mapInArrow(documents, out)
    index = chunk_index(spark, path).select("shard", "chunk", F.col("start").alias("_start"))
    return rows.join(index, ["shard", "chunk"]).select("doc_id", (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32" if digest else "ids")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, new_path(spark, "tokens"), tokenizer), digest=True)
