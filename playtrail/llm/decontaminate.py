"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. A seed is a running hash of ``MIN_MATCH`` words. Documents are
joined with test items on shared seeds; for each pair so found the longest common runs of words are marked again and
again, none overlapping, by Karp-Rabin passes of falling length. Tiles may lie in any order, so a passage whose
parts were moved is still covered. A document is contaminated by an item if its tiles cover at least
``THRESHOLD`` of the item's words.

Items of fewer than ``MIN_MATCH`` words cannot be tiled and never count. Null texts have no words.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.shared import free_name, process_cache

MIN_MATCH = 5
THRESHOLD = 0.5
# The seeds of all items fold into a bitmap of fixed size, which is what documents are first held against.
BITMAP_BITS = 24
WORDS_KEPT = 300_000
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(r"[^\W_]+")


class _WordHashes(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def seeds_of(text: str | None, size: int = MIN_MATCH) -> np.ndarray:
    """The running hash of each ``size`` words, as unsigned 64-bit numbers."""
    words = _WORD.findall(text.lower()) if text else []
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    memo = process_cache("word_hashes", _WordHashes)
    values = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + values[i:i + n]
    return total ^ (total >> np.uint64(31))


class _Marked:
    """Positions taken by tiles, as sorted intervals."""

    def __init__(self):
        self.starts, self.stops = [], []

    def free(self, start: int, n: int) -> bool:
        i = bisect_left(self.starts, start + n)
        return i == 0 or self.stops[i - 1] <= start

    def add(self, start: int, n: int):
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.stops.insert(i, start + n)


def _places(doc: dict[int, int], copies: int) -> list[int]:
    """The positions of ``doc``, rising, without all but the first ``copies`` of its equal stretches.

    A tile lies in one stretch of consecutive positions, and earlier ones go first. So with more copies than there can be
    tiles, one of those before is always untouched, and the later ones get none.
    """
    kept, seen, stretch = [], {}, []

    def close():
        content = tuple(doc[p] for p in stretch)
        seen[content] = seen.get(content, 0) + 1
        if seen[content] <= copies:
            kept.extend(stretch)

    for p in sorted(doc):
        if stretch and p != stretch[-1] + 1:
            close()
            stretch = []
        stretch.append(p)
    close()
    return kept


def tiles_of(doc: dict[int, int], item: list[int], size: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (document word, item word, words) of seeds at document positions and an item's seeds.

    A run of n equal seeds is a run of n + size - 1 equal words. Passes look for runs of at least s words by their
    running hash, extend them, and mark the longest first; s falls by halves to ``size``, and the last pass repeats
    until it marks nothing. A pass that meets a run of more than twice s words ends there, and s rises to the longest run.
    """
    total = len(item) + size - 1
    used_doc, used_item = _Marked(), _Marked()
    tiles = []
    item_at, doc_places = dict(enumerate(item)), _places(doc, total // size + 1)

    def extended(p, q, words):
        while (q + words < total and used_item.free(q + words, 1) and used_doc.free(p + words, 1)
               and doc.get(p + words - size + 1) == item[q + words - size + 1]):
            words += 1
        return words

    def scan(s):
        n = s - size + 1
        at: dict[int, list[int]] = {}
        for q, h in _windows(item_at, range(len(item)), n):
            if used_item.free(q, s):
                at.setdefault(h, []).append(q)
        found, longest = [], 0
        for p, h in _windows(doc, doc_places, n) if at else ():
            if h not in at or not used_doc.free(p, s):
                continue
            for q in at[h]:
                if (q and doc.get(p - 1) == item[q - 1] and used_doc.free(p - 1, 1) and used_item.free(q - 1, 1)):
                    continue  # part of a longer run
                words = extended(p, q, s)
                if words > 2 * s:
                    return found, words
                found.append((words, p, q))
                longest = max(longest, words)
        return found, longest

    s, risen = max(size, min(20, total)), False
    while True:
        found, longest = scan(s)
        if longest > 2 * s or risen and longest > s:
            s, risen = longest, True
            continue
        risen, marked = False, 0
        for words, p, q in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if (used_doc.free(p, words) and used_item.free(q, words)
                    and all(doc[p + i] == item[q + i] for i in range(words - size + 1))):
                tiles.append((p, q, words))
                used_doc.add(p, words)
                used_item.add(q, words)
                marked += 1
        if s > size:
            s = max(size, s // 2)
        elif not marked:
            return sorted(tiles)


def _windows(seeds: dict[int, int], places, n: int):
    """Running hash of each n seeds at consecutive positions; ``places`` are all positions, rising."""
    modulus, base = (1 << 61) - 1, 911382323
    top = pow(base, n - 1, modulus)
    run, value, before = 0, 0, None
    for p in places:
        if before is None or p != before + 1:
            run, value = 0, 0
        if run == n:
            value = (value - seeds[p - n] * top) % modulus
            run -= 1
        value = (value * base + seeds[p]) % modulus
        run += 1
        before = p
        if run == n:
            yield p - n + 1, value


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _seed_rows(rows: DataFrame, size: int, bitmap=None) -> DataFrame:
    """``(id, key, pos, seed)`` of ``rows (id, key, text)``; with a bitmap only seeds that may be an item's."""
    kind = dict(rows.dtypes)["id"]

    def found(batches):
        import pyarrow as pa

        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            places, positions, seeds = [], [], []
            for i, text in enumerate(batch.column(2)):
                values = seeds_of(text.as_py(), size)
                pos = np.arange(len(values))
                if bits is not None and len(values):
                    slot = (values >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    pos = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                if len(pos):
                    places.append(np.full(len(pos), i))
                    positions.append(pos)
                    seeds.append(_signed(values)[pos])
            if places:
                take = pa.array(np.concatenate(places))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take),
                     pa.array(np.concatenate(positions), pa.int64()), pa.array(np.concatenate(seeds), pa.int64())],
                    ["id", "key", "pos", "seed"])

    return rows.mapInArrow(found, f"id {kind}, key bigint, pos bigint, seed bigint")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """2 MB at most, whatever the number of items."""
    slot = F.shiftrightunsigned("seed", 64 - BITMAP_BITS)
    parts = (
        seeds.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect())
    whole = np.zeros(((1 << BITMAP_BITS) // 8) + 4096 * 2, np.uint8)
    for part in parts:
        # Spark counts slot s as bit (s - 1) mod 32768 of bucket (s - 1) / 32768 + 1, and slot 0 apart.
        bits = np.unpackbits(np.frombuffer(bytes(part["bits"]), np.uint8), bitorder="little")
        start = _first_slot(part["bucket"])
        slots = np.flatnonzero(bits) + start
        np.bitwise_or.at(whole, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return whole


def _first_slot(bucket: int) -> int:
    return (bucket - 1) * 32768 + 1 if bucket > 0 else 0


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = MIN_MATCH, threshold: float = THRESHOLD,
                 id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text") -> DataFrame:
    """One row per contaminated (document, item): ids, ``coverage``, ``tiles`` (start in the document, start in the
    item, words), ``text_key`` (hash of the document's text). Repeated rows count once; null ids are kept.
    """
    items = _keyed(benchmark, item_id_col, item_text_col).where("text IS NOT NULL").distinct()
    item_seeds = _seed_rows(items, size).withColumnsRenamed({"id": "item", "key": "item_key", "pos": "item_pos"})
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(item_seeds))
    seeds = _seed_rows(_keyed(docs, id_col, text_col), size, bitmap)
    pairs = (
        seeds.join(item_seeds.select("item", "item_key", "seed").distinct(), "seed")
        .groupBy("id", "key", "item", "item_key")
        .agg(F.collect_set(F.struct("pos", "seed")).alias("found")))
    texts = items.withColumnsRenamed({"id": "item", "key": "item_key", "text": "item_text"})
    same = pairs["item"].eqNullSafe(texts["item"]) & (pairs["item_key"] == texts["item_key"])
    full = pairs.join(texts, same).select(pairs["id"], pairs["key"], texts["item"], "found", "item_text")
    kinds = dict(full.dtypes)

    def tile_batches(batches):
        import pyarrow as pa

        for batch in batches:
            covers, tiles = [], []
            for found, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                item = _signed(seeds_of(text, size)).tolist()
                got = tiles_of({f["pos"]: f["seed"] for f in found}, item, size)
                covers.append(sum(t[2] for t in got) / (len(item) + size - 1))
                tiles.append([{"doc_word": p, "item_word": q, "words": n} for p, q, n in got])
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_word", "item_word", "words")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(covers, pa.float64()), pa.array(tiles, kind)],
                ["id", "key", "item", "coverage", "tiles"])

    schema = (f"id {kinds['id']}, key bigint, item {kinds['item']}, coverage double, "
              "tiles array<struct<doc_word:bigint,item_word:bigint,words:bigint>>")
    return full.mapInArrow(tile_batches, schema).where(F.col("coverage") >= threshold).select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "coverage", "tiles", F.col("key").alias("text_key"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents that no item contaminates, with all their columns; a sort-merge join by id and text, whatever the sizes."""
    hits = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    hits = hits.select(F.col("doc_id").alias("hit_id"), "text_key").distinct()
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    same = keyed[id_col].eqNullSafe(hits["hit_id"]) & (keyed[key] == hits["text_key"])
    return keyed.join(hits.hint("merge"), same, "left_anti").drop(key)
