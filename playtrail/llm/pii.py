"""Personal data in texts: fixed patterns, and spans that a character-level BiLSTM with CRF transitions adds.

The network is trained in numpy from labelled spans. Texts are cut into overlapping windows, each is decoded, and the
spans of all windows of a text are reconciled: overlapping spans of one kind join, of different kinds the longer
stays. Spans of the patterns always stay; the network adds only what overlaps none of them and holds the signs its kind
cannot do without (``_SIGNS``). As each of these contains a digit or an @, windows without either cannot add anything
and are not decoded.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.shared import free_name

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base kinds.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

WINDOW = 96
STRIDE = 48
HIDDEN = 16
EMBEDDED = 12
TAGS = 1 + 2 * len(KINDS)
# The sample that the network learns from, and how long.
SAMPLE_DOCS = 4000
SAMPLE_WINDOWS = 900
STEPS = 160
BATCH = 64
DECODED_AT_ONCE = 1024


def _digits(text: str) -> list[str]:
    return _DIGITS.findall(text)


def _address(text: str) -> bool:
    parts = [p.lstrip("0") for p in re.findall("[0-9]+", text)]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


_SIGNS = {
    "email": lambda s: "@" in s and "." in s[s.find("@"):],
    "ip": _address,
    "card": lambda s: 13 <= len(_digits(s)) <= 19 and _luhn(_digits(s)),
    "phone": lambda s: 9 <= len(_digits(s)) <= 15,
}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that do not overlap; a match that fails its test is dropped, not retried.

    An address is sought from its @: its local part reaches left as far as its characters do or to the end of the
    match before, which is where a search from the left would start too. All searches take linear time.
    """
    found = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                found.append(("email", start, end))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = _DIGITS.findall(m.group()) if m.end() - m.start() <= 37 else []
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.findall(m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return in_order(found)


def in_order(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _luhn(digits: list[str]) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


# Symbols: 0 padding, 1 other, 2 other white space, 3 letters beyond ASCII, then printable ASCII.
SYMBOLS = 4 + 95


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ascii_ = (codes >= 32) & (codes < 127)
    out = np.where(ascii_, codes - 28, np.where((codes >= 0xC0) & (codes < 0x3000), 3, 1))
    return np.where((codes >= 9) & (codes <= 13), 2, out)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """The weights and the passes; everything in float32 and in whole batches of equally long windows."""

    def __init__(self, seed=17):
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        h, self.p = HIDDEN, {}
        self.p["embed"] = normal(SYMBOLS, EMBEDDED) * np.float32(np.sqrt(SYMBOLS) * 0.3)
        for side in "fb":
            self.p[f"x{side}"], self.p[f"h{side}"] = normal(EMBEDDED, 4 * h), normal(h, 4 * h)
            self.p[f"g{side}"] = np.zeros(4 * h, np.float32)
            self.p[f"g{side}"][h:2 * h] = 1
        self.p["out"], self.p["bias"] = normal(2 * h, TAGS), np.zeros(TAGS, np.float32)
        self.p["bias"][0] = 2
        self.p["moves"] = np.zeros((TAGS, TAGS), np.float32)
        for tag in range(2, TAGS, 2):  # an inner tag follows its own first or inner tag only
            for before in range(TAGS):
                if before not in (tag, tag - 1):
                    self.p["moves"][before, tag] = -6

    def _run(self, x, side, keep):
        """Hidden states of one direction, (time, batch, hidden), in reading order of the text."""
        p, h = self.p, HIDDEN
        given = (p["embed"] @ p[f"x{side}"] + p[f"g{side}"])[x.T]
        state = np.zeros((x.shape[0], h), np.float32)
        cell = np.zeros_like(state)
        times = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
        out = np.empty((x.shape[1], x.shape[0], h), np.float32)
        kept = {}
        for t in times:
            z = given[t] + state @ p[f"h{side}"]
            gates = _sigmoid(z[:, :3 * h])
            new = np.tanh(z[:, 3 * h:])
            before, old = cell, state
            cell = gates[:, h:2 * h] * cell + gates[:, :h] * new
            squashed = np.tanh(cell)
            state = gates[:, 2 * h:] * squashed
            out[t] = state
            if keep:
                kept[t] = (gates, new, before, squashed, old)
        return out, kept

    def emissions(self, x, keep=False):
        ahead, kept_f = self._run(x, "f", keep)
        back, kept_b = self._run(x, "b", keep)
        both = np.concatenate([ahead, back], axis=2)
        return both @ self.p["out"] + self.p["bias"], both, kept_f, kept_b

    def decode(self, x) -> np.ndarray:
        """The best tag path of each window, (batch, time)."""
        scores, moves = self.emissions(x)[0], self.p["moves"]
        best, pointers = scores[0], []
        for t in range(1, len(scores)):
            options = best[:, :, None] + moves
            pointers.append(options.argmax(axis=1))
            best = np.take_along_axis(options, pointers[-1][:, None, :], 1)[:, 0] + scores[t]
        path = [best.argmax(axis=1)]
        for pointer in reversed(pointers):
            path.append(np.take_along_axis(pointer, path[-1][:, None], 1)[:, 0])
        return np.stack(path[::-1], axis=1)

    def gradients(self, x, y):
        """Mean negative log likelihood of the tag paths ``y``, and its gradients."""
        p, h, (n, length) = self.p, HIDDEN, x.shape
        scores, both, kept_f, kept_b = self.emissions(x, keep=True)
        moves, rows = p["moves"], np.arange(n)
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        for t in range(1, length):
            alpha[t] = scores[t] + _logsum(alpha[t - 1][:, :, None] + moves, 1)
        for t in range(length - 2, -1, -1):
            beta[t] = _logsum(moves + (beta[t + 1] + scores[t + 1])[:, None, :], 2)
        total = _logsum(alpha[-1], 1)
        d_scores = np.exp(alpha + beta - total[None, :, None])
        d_moves = np.zeros_like(moves)
        gold = scores[0, rows, y[:, 0]].copy()
        for t in range(length):
            d_scores[t, rows, y[:, t]] -= 1
            if t:
                pair = alpha[t - 1][:, :, None] + moves + (beta[t] + scores[t])[:, None, :] - total[:, None, None]
                d_moves += np.exp(pair).sum(axis=0)
                np.subtract.at(d_moves, (y[:, t - 1], y[:, t]), 1)
                gold += scores[t, rows, y[:, t]] + moves[y[:, t - 1], y[:, t]]
        d_scores /= n
        grad = {"moves": d_moves / n, "out": np.einsum("tbh,tbk->hk", both, d_scores),
                "bias": d_scores.sum(axis=(0, 1)), "embed": np.zeros_like(p["embed"])}
        d_both = d_scores @ p["out"].T
        for side, kept, d_out in (("f", kept_f, d_both[:, :, :h]), ("b", kept_b, d_both[:, :, h:])):
            d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            d_hidden = np.zeros_like(p[f"h{side}"])
            d_given = np.zeros((SYMBOLS, 4 * h), np.float32)
            for t in range(length - 1, -1, -1) if side == "f" else range(length):
                gates, new, before, squashed, old = kept[t]
                inp, forget, show = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
                d_state = d_state + d_out[t]
                d_cell = d_cell + d_state * show * (1 - squashed ** 2)
                d_z = np.concatenate([
                    d_cell * new * inp * (1 - inp), d_cell * before * forget * (1 - forget),
                    d_state * squashed * show * (1 - show), d_cell * inp * (1 - new ** 2)], axis=1)
                d_hidden += old.T @ d_z
                np.add.at(d_given, x[:, t], d_z)
                d_state, d_cell = d_z @ p[f"h{side}"].T, d_cell * forget
            grad[f"h{side}"], grad[f"g{side}"] = d_hidden, d_given.sum(axis=0)
            grad[f"x{side}"] = p["embed"].T @ d_given
            grad["embed"] += d_given @ p[f"x{side}"].T
        return float((total - gold).mean()), grad


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(windows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = STEPS) -> Network | None:
    """A network from windows of text and their spans, by Adam; None without any span. Depends on nothing else.

    Phone numbers are also shown without their plus, so that the network learns their shape and not the sign.
    """
    if not any(spans for _, spans in windows):
        return None
    shown = list(windows)
    for text, spans in windows:
        for kind, a, b in spans:
            if kind == "phone" and text[a] == "+":
                moved = [(k, s - (s > a), e - (e > a)) for k, s, e in spans]
                shown.append((text[:a] + text[a + 1:], moved))
    x = np.zeros((len(shown), WINDOW), np.int64)
    y = np.zeros_like(x)
    for i, (text, spans) in enumerate(shown):
        symbols = _symbols(text[:WINDOW])
        x[i, :len(symbols)] = symbols
        for kind, a, b in spans:
            tag = 1 + 2 * KINDS.index(kind)
            if 0 <= a < b <= WINDOW:
                y[i, a], y[i, a + 1:b] = tag, tag + 1
    net, rng = Network(), np.random.default_rng(23)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        rows = rng.choice(len(shown), min(BATCH, len(shown)), replace=False)
        _, grad = net.gradients(x[rows], y[rows])
        norm = np.sqrt(sum(float((g ** 2).sum()) for g in grad.values()))
        rate = 0.02 * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            move = rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
            net.p[k] = (net.p[k] - move).astype(np.float32)
    return net


def windows_of(text: str):
    """Starts of the overlapping windows that hold a digit or an @."""
    last = max(0, len(text) - WINDOW + STRIDE - 1) // STRIDE * STRIDE
    seen = -1
    for m in _TRIGGER.finditer(text):
        at = m.start()
        low = max(0, -(-(at - WINDOW + 1) // STRIDE) * STRIDE)
        for start in range(max(low, seen + STRIDE) if seen >= 0 else low, min(at, last) + 1, STRIDE):
            yield start
            seen = start


def _decoded(tags: np.ndarray) -> list[tuple[str, int, int]]:
    spans, kind, start = [], None, 0
    for i, tag in enumerate([*tags.tolist(), 0]):
        if kind is not None and tag != 2 * kind + 2:
            spans.append((KINDS[kind], start, i))
            kind = None
        if tag and kind is None:
            kind, start = (tag - 1) // 2, i
    return spans


def reconcile(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of all windows of a text: those of one kind that overlap join; of others the longer stays, then the earlier."""
    joined = []
    for kind in KINDS:
        end = None
        for k, a, b in sorted(s for s in spans if s[0] == kind):
            if end is not None and a < end:
                end = max(end, b)
                joined[-1] = (k, joined[-1][1], end)
            else:
                joined.append((k, a, b))
                end = b
    kept = []
    for span in sorted(joined, key=lambda s: s[1]):
        while kept and kept[-1][2] > span[1] and _rank(span) < _rank(kept[-1]):
            kept.pop()
        if not kept or kept[-1][2] <= span[1]:
            kept.append(span)
    return in_order(kept)


def _rank(span):
    return (span[1] - span[2], span[1], KINDS.index(span[0]))


def added_spans(net: Network | None, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list]:
    """What the network adds to each text. Windows of many texts are decoded together, a bounded number at once."""
    raw: list[list] = [[] for _ in texts]
    if net is None:
        return raw
    waiting: list[tuple[int, int]] = []

    def flush():
        x = np.zeros((len(waiting), WINDOW), np.int64)
        for row, (i, start) in enumerate(waiting):
            symbols = _symbols(texts[i][start:start + WINDOW])
            x[row, :len(symbols)] = symbols
        paths = net.decode(x)
        for row in np.flatnonzero(paths.any(axis=1)).tolist():
            i, start = waiting[row]
            size = len(texts[i]) - start
            raw[i].extend((k, a + start, min(b, size) + start) for k, a, b in _decoded(paths[row]) if a < size)
        waiting.clear()

    for i, text in enumerate(texts):
        for start in windows_of(text):
            waiting.append((i, start))
            if len(waiting) >= DECODED_AT_ONCE:
                flush()
    if waiting:
        flush()
    out = []
    for text, spans, fixed in zip(texts, raw, base):
        free, place = [], 0
        fixed = sorted(fixed, key=lambda s: s[1])
        for kind, a, b in sorted(reconcile(spans), key=lambda s: s[1]):
            while place < len(fixed) and fixed[place][2] <= a:
                place += 1
            if any(s[1] < b and s[2] > a for s in fixed[place:place + len(KINDS) + 1]):
                continue
            if _SIGNS[kind](text[a:b]):
                free.append((kind, a, b))
        out.append(in_order(free))
    return out


def fit(docs: DataFrame, id_col="doc_id", text_col="text", steps: int = STEPS) -> Network | None:
    """A network trained on windows of about ``SAMPLE_DOCS`` documents, chosen by the hash of their id.

    The labels are the spans of the patterns; the sample has at most ``SAMPLE_WINDOWS`` windows, the smallest by hash,
    at most 20 of one document. Windows that hold a digit or an @ and no span teach what is none.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    rows = rows.where(F.col("t").rlike("[0-9@]"))
    total = rows.count()
    place = F.pmod(F.xxhash64("i", F.lit(9)), F.lit(1_000_003)) / F.lit(1_000_003.0)

    @F.pandas_udf("array<struct<text:string,spans:array<struct<kind:string,a:int,b:int>>>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([_labelled(t) for t in texts])

    chosen = rows.where(place < SAMPLE_DOCS / max(1, total)).select(F.explode(cut("t")).alias("w")).select("w.*")
    found = chosen.distinct().orderBy(F.xxhash64("text"), "text").limit(SAMPLE_WINDOWS).collect()
    return train([(r["text"], [(s["kind"], s["a"], s["b"]) for s in r["spans"]]) for r in found], steps)


def _labelled(text: str) -> list[dict]:
    spans, out = base_spans(text), []
    for start in list(windows_of(text))[:20]:
        inside = [s for s in spans if s[1] < start + WINDOW and s[2] > start]
        if all(s[1] >= start and s[2] <= start + WINDOW for s in inside):
            labels = [{"kind": k, "a": a - start, "b": b - start} for k, a, b in inside]
            out.append({"text": text[start:start + WINDOW], "spans": labels})
    return out


_SPAN = "array<struct<kind:string,start:bigint,stop:bigint>>"


def find(docs: DataFrame, net: Network | None, text_col="text") -> DataFrame:
    """All rows and columns, with ``base`` and ``added``: arrays of (kind, start, stop) in code points, in order of start.

    Null texts count as empty. Older columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(None if net is None else net.p)

    @F.pandas_udf(f"base {_SPAN}, added {_SPAN}")
    def search(column: pd.Series) -> pd.DataFrame:
        model = None
        if shared.value is not None:
            model = Network()
            model.p = shared.value
        texts = [t if isinstance(t, str) else "" for t in column]
        base = [base_spans(t) for t in texts]
        more = added_spans(model, texts, base)
        rows = [[[{"kind": k, "start": a, "stop": b} for k, a, b in spans] for spans in part] for part in (base, more)]
        return pd.DataFrame({"base": rows[0], "added": rows[1]})

    name = free_name(docs, "found")
    return (docs.withColumn(name, search(F.col(text_col)))
            .withColumns({"base": F.col(f"{name}.base"), "added": F.col(f"{name}.added")}).drop(name))


def all_spans(base: str = "base", added: str = "added"):
    """Both arrays as one, by start and then by kind as listed."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def before(x, y):
        return (F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
                .otherwise(F.array_position(kinds, x["kind"]) - F.array_position(kinds, y["kind"])).cast("int"))

    return F.array_sort(F.concat(base, added), before)


def redact(docs: DataFrame, net: Network | None, text_col="text") -> DataFrame:
    """All rows and columns; in the text each span is replaced by its kind in brackets. Overlapping spans, such as an
    address inside a card number, become one replacement named by the first."""
    shared = docs.sparkSession.sparkContext.broadcast(None if net is None else net.p)

    @F.pandas_udf("string")
    def hide(column: pd.Series) -> pd.Series:
        model = None
        if shared.value is not None:
            model = Network()
            model.p = shared.value
        texts = [t if isinstance(t, str) else "" for t in column]
        base = [base_spans(t) for t in texts]
        out = []
        for given, text, spans, more in zip(column, texts, base, added_spans(model, texts, base)):
            out.append(replaced(text, in_order([*spans, *more])) if isinstance(given, str) else None)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, hide(F.col(text_col)))


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            parts += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*parts, text[end:]])
