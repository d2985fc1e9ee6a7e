"""Alignment of two tokenizers' tokens by the byte offsets where both end.

Both tokenizers see a space and the text. The offsets where a token of each ends are found by galloping: the shorter list of
ends drives exponential steps and then a binary search into the longer one. These common ends cut both token lists into groups;
the differences of their ranks are the groups' sizes. Every token of one side is linked with every token of the other in its group.

Texts are cut where neither tokenizer can join what lies on both sides, and every distinct piece is encoded and aligned once in a
block of neighbouring documents. A block writes its documents as lists of pieces, and once the tables of its pieces and of
its pairs of ids, with the number of documents that hold each pair. Pair counts are summed over the blocks, and each block is given
those of its own pairs, so the corpus-wide counts never have to fit one place.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.shared import process_cache, written

BLOCK_CHARS = 12_000_000
GROUP_DOCS = 256
# What a document counts for besides its text, so that blocks of empty texts end too.
DOC_CHARS = 16
# New pieces encoded as one text, and links listed together when the pairs of ids are counted.
PIECES_TOGETHER = 4096
COUNTED_TOGETHER = 2_000_000

# A full stop or comma that does not follow a letter or digit, and so may belong to the token before it.
_AFTER_MARK = re.compile(r"[.,](?<=[\W_].)")
# One space or line feed between other characters, and no white space beside it.
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def gallop(values: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each value, the first place in ``target[low:high]`` that is not smaller, else ``high``.

    Exponential steps from ``low`` until a target is not smaller, then a binary search of the last step; all values at once.
    """
    low, high, step = low.copy(), high.copy(), np.ones(len(low), np.int64)
    going = np.flatnonzero(low < high)
    while len(going):
        probe = np.minimum(low[going] + step[going], high[going]) - 1
        behind = target[probe] < values[going]
        low[going[behind]] = probe[behind] + 1
        high[going[~behind]] = probe[~behind]
        going = going[behind]
        step[going] *= 2
        going = going[low[going] < high[going]]
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        behind = target[middle] < values[going]
        low[going[behind]] = middle[behind] + 1
        high[going[~behind]] = middle[~behind]
        going = going[low[going] < high[going]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray):
    """Masks of ``a`` and of ``b``, the ends that occur in the other list of the same pair of lists.

    The lists lie one after another; ``a_starts`` and ``b_starts`` hold where each begins, and the total.
    """
    masks = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_sizes, b_sizes = np.diff(a_starts), np.diff(b_starts)
    for driver, other, mask, hit, starts, into, chosen in (
            (a, b, masks[0], masks[1], a_starts, b_starts, a_sizes <= b_sizes),
            (b, a, masks[1], masks[0], b_starts, a_starts, a_sizes > b_sizes)):
        sizes = np.diff(starts)
        places = np.flatnonzero(np.repeat(chosen, sizes))
        lists = np.repeat(np.arange(len(sizes)), sizes)[places]
        values, high = driver[places], into[lists + 1]
        at = gallop(values, into[lists], high, other)
        found = at < high
        found[found] = other[at[found]] == values[found]
        mask[places[found]] = True
        hit[at[found]] = True
    return masks


def _crossed(sizes_a: np.ndarray, sizes_b: np.ndarray):
    """Places of all pairs of a token of one side and a token of the other in the same group, and their group."""
    links = sizes_a * sizes_b
    group = np.repeat(np.arange(len(links)), links)
    inside = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    first_a, first_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    return first_a[group] + inside // sizes_b[group], first_b[group] + inside % sizes_b[group], group


class Numbered(dict):
    """Numbers things in the order in which they are first asked for; ``new`` lists those not yet seen to."""

    def __init__(self):
        self.new = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number


class Pair:
    """Two tokenizers: one of the tokenizers library, byte level (A), and one of sentencepiece (B)."""

    def __init__(self, a_content: str, b_content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_content)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_content)
        made = json.loads(a_content)
        # Bytes stand for themselves where they are visible, in order; the others follow from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [i for i in range(256) if i not in visible]
        byte_of = {chr(i): i for i in visible} | {chr(256 + n): i for n, i in enumerate(hidden)}
        entries = {**made["model"]["vocab"], **{t["content"]: t["id"] for t in made.get("added_tokens", [])}}
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in names], np.int64) for names in (self.a_bytes, self.b_bytes)]
        self.decimal = [pa.array([str(i) for i in range(len(names))]) for names in (self.a_bytes, self.b_bytes)]
        before = made.get("pre_tokenizer") or {}
        a_local = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not made.get("normalizer")
                   and not before.get("add_prefix_space"))
        # No piece of B reaches across the front of a word or a line feed, and B takes texts as they are.
        odd = "q\ufb01  x "
        b_local = (not any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in pieces)
                   and b"".join(self.b_bytes[i] for i in self.b.encode(odd)) == f" {odd}".encode())
        self.local = a_local and b_local
        # Letters or digits that B can join with a full stop or comma behind them.
        self.kept = sorted({p[i:i + 2] for p in pieces for i in range(len(p) - 1) if p[i].isalnum() and p[i + 1] in ".,"})

    def pieces(self, text: str) -> list[str]:
        """A space and the text, cut where no token of either tokenizer can reach across."""
        whole = " " + text
        if not self.local:
            return [whole]
        plain = not ("  " in whole or " \n" in whole or "\n " in whole or "\n\n" in whole or whole.endswith(" "))
        if not plain or not text.replace("\n", "").isprintable():
            return _CUT.split(whole)
        cut = whole.replace(" ", "\0 ").replace("\n", "\0\n\0")
        if not _AFTER_MARK.search(whole):
            cut = cut.replace(".", "\0.").replace(",", "\0,")
            for both in self.kept:
                cut = cut.replace(f"{both[0]}\0{both[1]}", both)
        return cut.strip("\0").split("\0")

    def _b_ids(self, pieces: list[str]) -> list[list[int]]:
        """B puts a space before what it is given; a piece without one follows a line feed, which stands alone in B."""
        found = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
        return [ids if p[0] == " " else ids[2:] for p, ids in zip(pieces, found)]

    def _a_ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]

    def _given_back(self, texts, a_ids, b_ids) -> list[bool]:
        a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        contents = [t.encode() for t in texts]
        return [b"".join(map(a_of, a)) == c == b"".join(map(b_of, b)) for c, a, b in zip(contents, a_ids, b_ids)]

    def align(self, pieces: list[str]):
        """The pieces in the order of their alignment, and it. Words with a space before them are encoded as one text, since no
        token crosses from one to the next; others one by one, and those that are not given back have no tokens."""
        words, others = [], []
        for p in pieces:
            (words if self.local and p[0] == " " and p.split() == [p[1:]] else others).append(p)
        groups = [words[i:i + PIECES_TOGETHER] for i in range(0, len(words), PIECES_TOGETHER)]
        texts = ["".join(g) for g in groups]
        a_ids, b_ids = self._a_ids(texts), self._b_ids(texts)
        whole = self._given_back(texts, a_ids, b_ids)
        arranged = [p for g, w in zip(groups, whole) if w for p in g]
        sizes = [len(p.encode()) for p in arranged]
        others += [p for g, w in zip(groups, whole) if not w for p in g]
        a_ids, b_ids = ([i for i, w in zip(ids, whole) if w] for ids in (a_ids, b_ids))
        more_a, more_b = self._a_ids(others), self._b_ids(others)
        whole = self._given_back(others, more_a, more_b)
        a_ids += [i for i, w in zip(more_a, whole) if w]
        b_ids += [i for i, w in zip(more_b, whole) if w]
        sizes += [len(p.encode()) if w else 0 for p, w in zip(others, whole)]
        flat_a, flat_b = (np.fromiter((t for some in ids for t in some), np.int64) for ids in (a_ids, b_ids))
        return arranged + others, Aligned(flat_a, flat_b, np.array(sizes, np.int64), self)


class Aligned:
    """For each piece: whether it can be aligned, its numbers of tokens, groups and links, its groups as text, and the
    pairs of linked ids (as one number) with how often each is linked, all pieces' pairs one after another."""

    def __init__(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, tokenizers: Pair):
        self.good = sizes > 0
        pieces_end = np.cumsum(sizes)

        def placed(ids, of):
            ends = np.cumsum(of[ids])
            starts = np.concatenate([[0], np.searchsorted(ends, pieces_end, "right")])
            if len(sizes) and not np.array_equal(np.concatenate([[0], ends])[starts[1:]], pieces_end):
                raise AssertionError("a token reaches across the end of a piece")
            return ends, starts

        (a_ends, a_starts), (b_ends, b_starts) = placed(a, tokenizers.sizes[0]), placed(b, tokenizers.sizes[1])
        in_a, in_b = common_ends(a_ends, b_ends, a_starts, b_starts)
        self.n_a, self.n_b = np.diff(a_starts), np.diff(b_starts)
        # The last token of a group ends at a common end: differences of ranks give the sizes.
        last_a, last_b = np.flatnonzero(in_a), np.flatnonzero(in_b)
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        piece = np.searchsorted(a_starts, last_a, "right") - 1
        self.n_groups = np.bincount(piece, minlength=len(sizes))
        self.n_links = np.bincount(piece, weights=sizes_a * sizes_b, minlength=len(sizes)).astype(np.int64)
        sides = [joined(names.take(pa.array(ids)), of, ",") for names, ids, of in zip(tokenizers.decimal, (a, b), (sizes_a, sizes_b))]
        self.text = joined(pc.binary_join_element_wise(*sides, "|"), self.n_groups, ";")
        self._count_pairs(a, b, sizes_a, sizes_b, piece, len(sizes))

    def _count_pairs(self, a, b, sizes_a, sizes_b, piece, count):
        links = np.cumsum(sizes_a * sizes_b)
        bounds = np.searchsorted(links, np.arange(0, int(links[-1]) + 1 if len(links) else 1, COUNTED_TOGETHER))
        bounds = np.unique(np.concatenate([bounds, [len(sizes_a)]]))
        from_a, from_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
        parts = []
        for low, high in zip(bounds[:-1], bounds[1:]):
            some = slice(low, high)
            if high == low + 1 and int(sizes_a[low]) * int(sizes_b[low]) > COUNTED_TOGETHER:
                # One great group: pairs of its distinct ids, each linked as often as both occur.
                ids_a, many_a = np.unique(a[from_a[low]:from_a[low] + sizes_a[low]], return_counts=True)
                ids_b, many_b = np.unique(b[from_b[low]:from_b[low] + sizes_b[low]], return_counts=True)
                pairs = (ids_a[:, None] << 32 | ids_b[None, :]).ravel()
                parts.append((np.full(len(pairs), piece[low]), pairs, (many_a[:, None] * many_b[None, :]).ravel()))
                continue
            i, j, group = _crossed(sizes_a[some], sizes_b[some])
            pairs, owner = a[from_a[low] + i] << 32 | b[from_b[low] + j], piece[low:high][group]
            parts.append(_summed(owner, pairs, np.ones(len(pairs), np.int64)))
        owner, pairs, many = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(3))
        if len(parts) > 1:
            # A piece's groups may have been counted in several parts.
            owner, pairs, many = _summed(owner, pairs, many)
        self.pairs, self.many, self.n_pairs = pairs, many, np.bincount(owner, minlength=count)


def joined(strings: pa.Array, sizes: np.ndarray, mark: str) -> pa.Array:
    """Runs of strings, as long as ``sizes`` say, each joined to one."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), strings), mark)


def _summed(owner, pairs, many):
    """Equal (owner, pair) as one, ``many`` summed."""
    order = np.lexsort((pairs, owner))
    owner, pairs = owner[order], pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], pairs[first], np.add.reduceat(many[order], first) if len(first) else many


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)


def sums_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values."""
    total, ends = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(sizes)])
    return total[ends[1:]] - total[ends[:-1]]


_COLUMNS = ("good", "n_a", "n_b", "n_groups", "n_links")


class Block:
    """The distinct pieces of some neighbouring documents, aligned, and the documents as lists of places among them."""

    def __init__(self, tokenizers: Pair):
        self.tokenizers, self.known, self.chars = tokenizers, Numbered(), 0
        self.place = np.zeros(0, np.int64)
        self.columns = {name: np.zeros(0, np.int64) for name in _COLUMNS}
        self.found: list[Aligned] = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[str | None]):
        """The documents' lists of pieces, one after another, their sizes, and the documents' totals."""
        cut = [self.tokenizers.pieces(t) if t else [] for t in texts]
        self.chars += sum(DOC_CHARS + len(t or "") for t in texts)
        sizes = np.array([len(c) for c in cut], np.int64)
        numbers = np.fromiter(map(self.known.__getitem__, [p for c in cut for p in c]), np.int64, int(sizes.sum()))
        if self.known.new:
            arranged, aligned = self.tokenizers.align(self.known.new)
            places = np.zeros(len(arranged), np.int64)
            places[[self.known[p] - len(self.place) for p in arranged]] = np.arange(len(self.place), len(self.place) + len(arranged))
            self.place = np.concatenate([self.place, places])
            self.columns = {n: np.concatenate([c, getattr(aligned, n)]) for n, c in self.columns.items()}
            self.found.append(aligned)
            self.known.new = []
        places = self.place[numbers]
        whole = sums_of(~self.columns["good"][places].astype(bool), sizes) == 0
        places, sizes = places[np.repeat(whole, sizes)], np.where(whole, sizes, 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        once = np.unique(owner * max(1, len(self.place)) + places)
        self.held.append((once // max(1, len(self.place)), once % max(1, len(self.place))))
        return places, sizes, {n: sums_of(self.columns[n][places], sizes) for n in _COLUMNS[1:]}

    def tables(self):
        """The pairs of ids and the number of this block's documents that hold each; and, as an Arrow stream, each piece's groups as
        text, the places of its pairs among the former, and how often each is linked."""
        texts = pa.concat_arrays([f.text for f in self.found] or [pa.array([], pa.string())])
        pairs, many, n_pairs = (np.concatenate([getattr(f, n) for f in self.found] or [np.zeros(0, np.int64)])
                                for n in ("pairs", "many", "n_pairs"))
        pairs, pair = np.unique(pairs, return_inverse=True)
        starts, docs = np.cumsum(n_pairs) - n_pairs, np.zeros(len(pairs), np.int64)
        for owner, places in self.held:
            keys = np.repeat(owner * len(pairs), n_pairs[places]) + pair[_spread(starts[places], n_pairs[places])]
            keys.sort()
            once = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
            docs += np.bincount(once % max(1, len(pairs)), minlength=len(pairs))
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_pairs)]).astype(np.int32))
        batch = pa.RecordBatch.from_arrays(
            [texts, pa.ListArray.from_arrays(offsets, pa.array(pair.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(many))],
            ["texts", "pair", "many"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        return pairs >> 32, pairs & 0xFFFFFFFF, docs, sink.getvalue().to_pybytes()


_PARTS = ("block string, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, size bigint, pieces binary, "
          "closes boolean, a array<int>, b array<int>, docs array<bigint>, tables binary")


def align(docs: DataFrame, a_file: str, b_file: str, id_col="doc_id", text_col="text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` for every row.

    ``groups`` lists the ids of both sides, ``a1,a2|b1;a3|b2``, in order. The count of a pair of ids is the number of rows that hold
    it linked; ``n_best`` counts the links whose pair has the highest count of its A id, and ``count_sum`` sums the counts
    over the links. Texts that are null, empty, or not given back byte for byte by the tokens of either side have zeros and
    empty groups, and count for nothing. Repeated rows and ids count each; an empty table gives no rows; other columns
    are not looked at. A very long text is a block of its own, so a task holds one such text or ``block_chars`` and the tables of its
    pieces. Strings of special tokens are ordinary text.
    """
    spark = docs.sparkSession
    with open(a_file, encoding="utf-8") as file:
        a_content = spark.sparkContext.broadcast(file.read())
    with open(b_file, "rb") as file:
        b_content = spark.sparkContext.broadcast(file.read())
    names = [f.split()[0] for f in _PARTS.split(", ")]

    def encode(batches):
        import zstandard
        from pyspark import TaskContext

        tokenizers = process_cache(f"pair:{a_file}:{b_file}", lambda: Pair(a_content.value, b_content.value))
        number, block, part = 0, Block(tokenizers), TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=1).compress

        def rows(ids, places, sizes, totals):
            n, ends = len(ids), np.cumsum(sizes)
            content = places.astype(np.int32)
            packed = [pack(content[e - s:e].tobytes()) for e, s in zip(ends.tolist(), sizes.tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{number}"] * n), ids, *[pa.array(totals[k], pa.int64()) for k in _COLUMNS[1:]],
                 pa.array(sizes), pa.array(packed, pa.binary()), pa.array([False] * n), pa.nulls(n, pa.list_(pa.int32())),
                 pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], names)

        def closing():
            a, b, held, tables = block.tables()
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{number}"]), *[pa.nulls(1, pa.int64())] * 6, pa.nulls(1, pa.binary()), pa.array([True]),
                 pa.array([a], pa.list_(pa.int32())), pa.array([b], pa.list_(pa.int32())), pa.array([held], pa.list_(pa.int64())),
                 pa.array([tables], pa.binary())], names)

        for batch in batches:
            for start in range(0, batch.num_rows, GROUP_DOCS):
                some = batch.slice(start, GROUP_DOCS)
                yield rows(some.column(0), *block.add(some.column(1).to_pylist()))
                if block.chars >= block_chars:
                    yield closing()
                    number, block = number + 1, Block(tokenizers)
        if block.chars:
            yield closing()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    parts = written(rows.mapInArrow(encode, _PARTS), "aligned")

    pairs = parts.where("closes").select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "pair"))
    pairs = pairs.select("block", "place", "pair.a", "pair.b", "pair.docs")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    counts = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    counted = pairs.join(counts, ["a", "b"]).select("block", "place", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        closes = left.column("closes")
        given, closed = left.filter(pc.invert(closes)), left.filter(closes)
        order = np.argsort(right.column("place").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order]
        with pa.ipc.open_stream(closed.column("tables")[0].as_buffer()) as stream:
            tables = stream.read_all().combine_chunks()
        texts, pair, many = (tables.column(n).combine_chunks() for n in ("texts", "pair", "many"))
        n_pairs, pair, many = (np.diff(pair.offsets.to_numpy()), *(x.flatten().to_numpy() for x in (pair, many)))
        open_up = zstandard.ZstdDecompressor().decompress
        places = np.frombuffer(b"".join([open_up(x.as_buffer()) for x in given.column("pieces")]), np.int32)
        sizes = given.column("size").to_numpy()
        out = {k: given.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        for name, values in (("n_best", best), ("count_sum", count)):
            out[name] = pa.array(sums_of(sums_of(many * values[pair], n_pairs)[places], sizes), pa.int64())
        return pa.table({**out, "groups": joined(texts.take(pa.array(places)), sizes, ";")})

    given = parts.drop("a", "b", "docs")
    given = given.select(*[F.col(c).alias(c) for c in given.columns])
    return given.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        finish, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")
