"""Token ids of documents in compressed files that give single short documents without reading the rest.

Layout of a folder: ``dictionary`` holds one row with the zstandard dictionary, its SHA-256 and the bytes per id;
``blocks`` holds rows of neighbouring documents in ascending id order: shard and block number, the ids and token
counts of their documents, where each document's frame begins in the payload, the hash of the dictionary, the tokens
before the block in its shard, and the payload of frames, one per document. Both are Parquet, so any store that Spark
reaches can hold them, a lost task leaves nothing behind, and the index columns are read without the payload.

Ids are serialized little-endian, in two bytes where the vocabulary allows, else four. The dictionary is trained on
at most ``SAMPLE_DOCS`` documents, of each at most ``SAMPLE_PIECES`` pieces of ``PIECE_BYTES``; it changes sizes
only, never contents.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playtrail.llm.pieces import LONGEST_KEPT, pieces_of
from playtrail.llm.shared import process_cache

SAMPLE_DOCS = 600
SAMPLE_PIECES = 8
PIECE_BYTES = 4096
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
BLOCK_BYTES = 2_000_000
GROUP_DOCS = 256
PIECES_TOGETHER = 4096
KEPT_PIECES = 500_000
BROADCAST_SHARDS = 500_000

_BLOCKS = (
    "shard int, block int, first_id bigint, last_id bigint, dictionary string, doc_ids array<bigint>, "
    "counts array<bigint>, offsets array<bigint>, before bigint, tokens bigint, payload binary")


class _Recent(dict):
    """Pieces seen lately; those of the generation before come over when they are asked for."""

    def __init__(self, older):
        super().__init__({"": b""})
        self.older = older

    def __missing__(self, piece):
        value = self[piece] = self.older[piece]
        return value


class BatchCoder:
    """Texts to bytes by way of ``encode(pieces) -> list of bytes``, new pieces being sought in all texts of a call at once.

    Two generations of pieces are remembered, of ``KEPT_PIECES`` or the pieces of one call each; very long ones are not.
    """

    def __init__(self, encode):
        self.encode, self.known = encode, _Recent({})

    def code(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > KEPT_PIECES:
            self.known.older = {}
            self.known = _Recent(self.known)
        known, cut = self.known, [(pieces_of(t) or [t]) if t else [] for t in texts]
        new = [p for p in set().union(*cut).difference(known) if p not in known.older]
        known.update(zip(new, self.encode(new) if new else ()))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > LONGEST_KEPT:
                del known[p]
        return out


class Encoder:
    """A tokenizer of the tokenizers library; texts are encoded piece by piece where its pre-tokenizer allows."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(content)
        before = made.get("pre_tokenizer") or {}
        local = (before.get("type") == "ByteLevel" and before.get("use_regex", True)
                 and not before.get("add_prefix_space") and not made.get("normalizer"))
        self.coder = BatchCoder(self._encode_pieces)
        self.code = self.coder.code if local else lambda texts: self._encode([t or "" for t in texts])
        # A byte-level entry has a character for each byte.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size() if local else 0, np.int64)
        if local:
            for entry, i in made["model"]["vocab"].items():
                self.sizes[i] = len(entry)

    def _encode(self, texts: list[str]) -> list[bytes]:
        from array import array

        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces of a space and what is no white space are encoded as one text, since no token reaches across such a space;
        the ends of their tokens tell them apart. Others are encoded one by one."""
        found, together, others = {}, [], []
        for p in pieces:
            (together if p[0] == " " and p.split() == [p[1:]] else others).append(p)
        for start in range(0, len(together), PIECES_TOGETHER):
            some = together[start:start + PIECES_TOGETHER]
            (data,) = self._encode(["".join(some)])
            ends = np.cumsum(self.sizes[np.frombuffer(data, "<u4")])
            wanted = np.cumsum([len(p.encode()) for p in some])
            at = np.searchsorted(ends, wanted, "right")
            if ends[-1] != wanted[-1] or not np.array_equal(ends[at - 1], wanted):
                others += some
                continue
            to = (4 * at).tolist()
            found.update(zip(some, [data[a:b] for a, b in zip([0, *to], to)]))
        found.update(zip(others, self._encode(others)))
        return [found[p] for p in pieces]


def _encoder(shared) -> Encoder:
    content = shared.value
    return process_cache(f"tokenizer:{hash(content)}", lambda: Encoder(content))


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the raw samples where they are too few to train on; nothing without samples."""
    import zstandard

    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False),
            zstandard.ZstdDecompressor(dict_data=shared))


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = None,
                 id_col="doc_id", text_col="text") -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the ids in ascending id order.

    Rows of one id lie together, in the order of their texts' hash; null ids come first. The tokenizer file is a
    vocabulary of fixed size. Texts move in one range shuffle; each task then writes its range as one shard.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as file:
        content = file.read()
    tokenizer = spark.sparkContext.broadcast(content)
    vocabulary = json.loads(content)
    ids = [*vocabulary["model"]["vocab"].values(), *[t["id"] for t in vocabulary.get("added_tokens", [])], end_id or 0]
    width = 2 if max(ids) < 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(_samples(rows, tokenizer, width))
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, dictionary, width)], "hash string, dictionary binary, width int").coalesce(1).write.parquet(
        f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def write(batches):
        from pyspark import TaskContext

        encoder, (compressor, _) = _encoder(tokenizer), _codec(shared.value)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, offsets, frames, size = [], [], [], [], 0

        def row():
            known = [d for d in doc_ids if d is not None] or [None]
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([known[0]], pa.int64()),
                pa.array([known[-1]], pa.int64()), pa.array([name]), pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                pa.array([before], pa.int64()), pa.array([sum(counts)], pa.int64()),
                pa.array([b"".join(frames)], pa.binary())], names)

        for batch in batches:
            for start in range(0, batch.num_rows, GROUP_DOCS):
                part = batch.slice(start, GROUP_DOCS)
                for doc, coded in zip(part.column(0).to_pylist(), encoder.code(part.column(1).to_pylist())):
                    coded += end
                    frame = compressor.compress(_narrow(coded, width))
                    doc_ids.append(doc), counts.append(len(coded) // 4), offsets.append(size), frames.append(frame)
                    size += len(frame)
                    if size >= BLOCK_BYTES:
                        yield row()
                        block, before = block + 1, before + sum(counts)
                        doc_ids, counts, offsets, frames, size = [], [], [], [], 0
        if doc_ids:
            yield row()

    names = [f.split()[0] for f in _BLOCKS.split(", ")]
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(write, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _samples(rows: DataFrame, tokenizer, width: int) -> list[bytes]:
    def pieces(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for coded in encoder.code(batch.column(1).to_pylist()):
                data = _narrow(coded, width)
                step = max(1, len(data) // PIECE_BYTES // SAMPLE_PIECES) * PIECE_BYTES
                found = [data[i:i + PIECE_BYTES] for i in range(0, len(data), step)][:SAMPLE_PIECES]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["piece"])

    total = rows.count()
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = rows.where(F.col("text").isNotNull() & (place < SAMPLE_DOCS / max(1, total)))
    # An id with very many rows is cut down to those of least hash, the same in every run.
    chosen = chosen.orderBy(F.xxhash64("id", "text"), "text").limit(2 * SAMPLE_DOCS)
    found = chosen.mapInArrow(pieces, "piece binary").collect()
    return sorted(bytes(r["piece"]) for r in found)


def _opened(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(tuple(spark.read.parquet(f"{path}/dictionary").first()))


def _frames(opened, dictionary: str, offsets: list, payload):
    """The ids of each frame, as little-endian unsigned 32-bit numbers."""
    name, content, width = opened.value
    if dictionary != name:
        raise ValueError(f"block needs dictionary {dictionary}, the folder has {name}")
    decompressor = process_cache(f"frames:{name}", lambda: _codec(bytes(content))[1])
    view = memoryview(payload)
    for a, b in offsets:
        yield np.frombuffer(decompressor.decompress(view[a:b]), f"<u{width}").astype("<u4").tobytes()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit). The running sum over shards has one row per shard, that is per write task.
    """
    blocks, opened = spark.read.parquet(f"{path}/blocks"), _opened(spark, path)
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("shard_start"))

    def unpack(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard, before, name, docs, counts, offsets = [batch.column(i)[row].as_py() for i in range(6)]
                payload = batch.column(6)[row].as_buffer()
                spans = list(zip(offsets, [*offsets[1:], payload.size]))
                starts = before + np.cumsum(counts) - np.array(counts)
                for start in range(0, len(docs), GROUP_DOCS):
                    part = slice(start, start + GROUP_DOCS)
                    ids = list(_frames(opened, name, spans[part], payload))
                    if [len(i) // 4 for i in ids] != counts[part]:
                        raise ValueError("token counts of the index and the payload differ")
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard] * n, pa.int32()), pa.array(docs[part], pa.int64()), pa.array(starts[part], pa.int64()),
                        pa.array(counts[part], pa.int64()), pa.array(ids, pa.binary())],
                        ["shard", "doc_id", "in_shard", "n_tokens", "ids"])

    unpacked = blocks.select("shard", "before", "dictionary", "doc_ids", "counts", "offsets", "payload").mapInArrow(
        unpack, "shard int, doc_id bigint, in_shard bigint, n_tokens bigint, ids binary")
    # A row of two numbers per write task; beyond this many, which no write has, they are joined like anything else.
    few = blocks.select("shard").distinct().count() <= BROADCAST_SHARDS
    return unpacked.join(F.broadcast(starts) if few else starts, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id`` and ``ids`` of some documents: only blocks whose id range holds one are read, and of those only the
    frames asked for are decompressed."""
    opened, wanted = _opened(spark, path), set(doc_ids)
    near = F.lit(False)
    for doc in sorted(wanted):
        near = near | F.lit(doc).between(F.col("first_id"), F.col("last_id"))

    def unpack(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                name, docs, offsets = [batch.column(i)[row].as_py() for i in range(3)]
                payload = batch.column(3)[row].as_buffer()
                spans = zip(docs, offsets, [*offsets[1:], payload.size])
                found = [(d, (a, b)) for d, a, b in spans if d in wanted]
                ids = list(_frames(opened, name, [s for _, s in found], payload))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in found], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").where(near)
    return blocks.select("dictionary", "doc_ids", "offsets", "payload").mapInArrow(unpack, "doc_id bigint, ids binary")
