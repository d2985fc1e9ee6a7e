"""Byte-level BPE in DuckDB, inside Spark tasks: merges by a recursive query, decoding by an ordered aggregate.

Encoding. The words of a batch (matches of the pattern) that are no token themselves become rows (word, position,
token), one per byte. Each round of the recursion joins neighbouring tokens to the merge table, takes each word's
minimum rank, and contracts its leftmost pair of that rank, until no word has a pair left. In words of more than
``LONG`` bytes, where no merge that contains the new token ranks below it, the word's further pairs of that rank must
follow at once, and the round contracts them too, left to right and without overlap; the result is the same, and a long
word takes a round per rank instead of one per token.

Decoding. The ids of all texts of a batch, in stretches of equal length, become rows (stretch, position, token), joined to the bytes
of each token and gathered in order; the bytes are cut into texts again by the lengths of their tokens.

Spark partitions the texts; DuckDB sees blocks of bounded size, and pieces encoded before are remembered.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrail.llm.pieces import PieceCoder, word_and_marks
from playtrail.llm.shared import process_cache

# Texts are worked on in groups of about so many characters, words and pieces in blocks of so many bytes or tokens.
GROUP_CHARS = 2_000_000
BLOCK_ROWS = 400_000
STRETCH = 4096
LONG = 64

# One contraction per word and round; places are those of all words one after another.
_ENCODE = """
WITH RECURSIVE state(w, pos, tok) USING KEY (pos) AS (
  SELECT w, pos, tok FROM seed
  UNION ALL
  (WITH live AS (
     SELECT w, pos, tok, lead(tok) OVER s AS nxt, lead(pos) OVER s AS nxt_pos, lead(w) OVER s AS nxt_w
     FROM state WHERE tok IS NOT NULL WINDOW s AS (ORDER BY pos)),
   pairs AS (
     SELECT w, pos, tok, nxt_pos, rank::BIGINT * 16777216 + pos AS place
     FROM live LEFT JOIN merges ON pair = CASE WHEN nxt_w = w THEN tok::BIGINT * 16777216 + nxt END),
   least AS (SELECT w, min(place) AS place, arg_min(nxt_pos, place) AS gone FROM pairs WHERE place IS NOT NULL GROUP BY w)
   SELECT w, pos, CASE WHEN p.place = l.place THEN (l.place // 16777216)::INTEGER WHEN pos <> gone THEN tok END
   FROM pairs p JOIN least l USING (w))
)
SELECT w, tok FROM state WHERE tok IS NOT NULL ORDER BY pos
"""

# All contractions of a round that must follow one another at once, for long words.
_ENCODE_LONG = """
WITH RECURSIVE state(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM seed
  UNION ALL
  (WITH live AS (
     SELECT w, pos, tok, lead(tok) OVER s AS nxt, lead(pos) OVER s AS nxt_pos, row_number() OVER s AS place
     FROM state WHERE tok IS NOT NULL WINDOW s AS (PARTITION BY w ORDER BY pos)),
   pairs AS (SELECT live.*, rank, alone FROM live LEFT JOIN merges ON pair = tok::BIGINT * 16777216 + nxt),
   least AS (SELECT w, min(rank) AS rank FROM pairs GROUP BY w HAVING min(rank) IS NOT NULL),
   hits AS (
     SELECT w, pos, nxt_pos, rank, alone, row_number() OVER h AS nth, place - row_number() OVER h AS run
     FROM pairs JOIN least USING (w, rank) WINDOW h AS (PARTITION BY w ORDER BY pos)),
   taken AS (
     SELECT w, pos, nxt_pos, rank
     FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS k FROM hits)
     WHERE CASE WHEN alone THEN nth = 1 ELSE k % 2 = 1 END)
   SELECT p.w, p.pos, CASE WHEN t.w IS NOT NULL THEN t.rank WHEN d.w IS NULL THEN p.tok END
   FROM pairs p JOIN least USING (w)
   LEFT JOIN taken t ON t.w = p.w AND t.pos = p.pos
   LEFT JOIN taken d ON d.w = p.w AND d.nxt_pos = p.pos)
)
SELECT w, tok FROM state WHERE tok IS NOT NULL ORDER BY w, pos
"""

_DECODE = """
SELECT w, string_agg(piece, '' ORDER BY pos) AS text FROM seed JOIN vocabulary USING (tok) GROUP BY w ORDER BY w
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def merge_rows(ranks: dict[bytes, int]) -> dict[str, list[int]]:
    """Every way to join two tokens into a third: left, right, the third's rank, and whether pairs of that rank must
    be contracted one by one, because a merge with the new token ranks below it."""
    left, right, rank = [], [], []
    for token, value in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), rank.append(value)
    below = {part for a, b, r in zip(left, right, rank) for part in (a, b) if r < part}
    return {"left": left, "right": right, "rank": rank, "alone": [r in below for r in rank]}


class DuckBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.words = ranks, regex.compile(pattern).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = merge_rows(ranks)
        self.con.register("given", pa.table({
            "pair": np.array(merges["left"], np.int64) * 16777216 + np.array(merges["right"], np.int64),
            "rank": pa.array(merges["rank"], pa.int32()), "alone": merges["alone"]}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        tokens = {value: token for token, value in ranks.items()}
        # A byte is written as the character 256 places above it, so that DuckDB handles texts without byte 0.
        self.con.register("given", pa.table({
            "tok": pa.array(list(tokens), pa.int32()),
            "piece": ["".join(chr(256 + b) for b in token) for token in tokens.values()]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.con.unregister("given")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.sizes = np.full(max(tokens) + 1, -1, np.int64)
        self.sizes[list(tokens)] = [len(token) for token in tokens.values()]
        self.coder = PieceCoder(self._encode_pieces, self.words)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        return self.coder.code(texts)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        cut = [word_and_marks(p) or self.words(p) for p in pieces]
        known, short, long = {}, [], []
        for word in dict.fromkeys(w for words in cut for w in words):
            content = word.encode()
            rank = self.ranks.get(content)
            if rank is not None:
                known[word] = rank.to_bytes(4, "little")
            else:
                (short if len(content) <= LONG else long).append((word, content))
        for sql, some in ((_ENCODE, short), (_ENCODE_LONG, long)):
            for block in _blocks(some, lambda w: len(w[1])):
                known.update(zip([w for w, _ in block], self._merge([c for _, c in block], sql)))
        return [known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words)) for words in cut]

    def _merge(self, words: list[bytes], sql: str) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        seed = pa.table({
            "w": w, "pos": np.arange(len(w), dtype=np.int32),
            "tok": self.single[np.frombuffer(b"".join(words), np.uint8)]})
        self.con.register("seed", seed)
        found = self.con.execute(sql).fetchnumpy()
        self.con.unregister("seed")
        ends = np.cumsum(np.bincount(np.asarray(found["w"]), minlength=len(words))) * 4
        ids = np.asarray(found["tok"]).astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids. An id that is no token is an error."""
        tokens = np.frombuffer(b"".join(coded), "<u4")
        if len(tokens) and (tokens.max() >= len(self.sizes) or self.sizes[tokens].min() < 0):
            raise ValueError("ids that are no tokens")
        plain = b"".join(self._gather(tokens[i:i + BLOCK_ROWS]) for i in range(0, len(tokens), BLOCK_ROWS))
        places = np.concatenate([[0], np.cumsum(self.sizes[tokens])])
        edges = places[np.cumsum([0, *[len(ids) // 4 for ids in coded]])].tolist()
        return [plain[a:b] for a, b in zip(edges, edges[1:])]

    def _gather(self, tokens: np.ndarray) -> bytes:
        pos = np.arange(len(tokens), dtype=np.int32)
        self.con.register("seed", pa.table({"w": pos // STRETCH, "pos": pos, "tok": tokens.astype(np.int32)}))
        texts = self.con.sql(_DECODE).to_arrow_table().column("text").combine_chunks()
        self.con.unregister("seed")
        # Every character is two bytes of UTF-8: 110000xx or 110001xx, then 10xxxxxx.
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        pairs = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, 2)
        return ((pairs[:, 0] << 6) | (pairs[:, 1] & 63)).tobytes()


def _blocks(items: list, size):
    block, total = [], 0
    for item in items:
        if block and total + size(item) > BLOCK_ROWS:
            yield block
            block, total = [], 0
        block.append(item)
        total += size(item)
    if block:
        yield block


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, text_col="text", decode=True) -> DataFrame:
    """All rows and columns, with ``ids`` (little-endian unsigned 32-bit) and, if asked, ``decoded`` bytes.

    Null texts count as empty. Older columns of these names are replaced. The rank file is read once on the driver
    and sent to the executors; it is a vocabulary of fixed size.
    """
    with open(rank_file, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), pattern, rank_file))
    names = ["ids", "decoded"] if decode else ["ids"]
    kept = [c for c in docs.columns if c.lower() not in names]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    position = kept.index(text_col)

    def work(batches):
        content, wanted, name = shared.value
        coder = process_cache(f"bpe:{name}:{hash((content, wanted))}", lambda: DuckBpe(read_ranks(content), wanted))
        for batch in batches:
            start = 0
            texts = batch.column(position)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0))
            while start < batch.num_rows:
                reach = int(np.searchsorted(np.cumsum(sizes[start:]), GROUP_CHARS)) + 1
                part = batch.slice(start, reach)
                start += reach
                ids = coder.encode(part.column(position).to_pylist())
                extra = [pa.array(ids, pa.binary())]
                if decode:
                    extra.append(pa.array(coder.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, *names])

    added = [T.StructField(n, T.BinaryType()) for n in names]
    return plain.mapInArrow(work, T.StructType([*plain.schema.fields, *added]))
