"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its subwords: the 2- to 4-letter pieces of each word with its
borders, hashed to a fixed number of buckets. As the classifier is linear, embeddings and weights multiply into
one score per bucket and language before prediction, so a text costs one lookup per subword.

Only text and language of sampled labelled documents are learned. ``SAMPLE_DOCS`` bounds the sample, shared evenly by the
languages, and ``MAX_LANGUAGES`` those (the most frequent ones). Part of the sample is kept from the training and
sets the temperature of the scores and the score below which a document is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.shared import free_name, process_cache

BUCKET_BITS = 16
DIMENSIONS = 16
SIZES = (2, 3, 4)
BLOCK = 1 << 16
SAMPLE_DOCS = 2400
MAX_LANGUAGES = 200
EPOCHS = 12
# Share of rightly recognised calibration documents that the rejection may cost at most.
REJECTED_SHARE = 0.001
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subwords(text: str):
    """Blocks of bucket numbers of the subwords of a text; nothing for a text without letters."""
    letters = process_cache("letters", _letters)
    text = text.lower()
    for start in range(0, len(text), BLOCK):
        # A block overlaps the next by the longest subword less one; the border of a text counts as a space.
        part = text[max(0, start - 1):start + BLOCK + max(SIZES) - 2]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        if start == 0:
            codes = np.concatenate([np.zeros(1, np.uint32), codes])
        if start + BLOCK + max(SIZES) - 2 >= len(text):
            codes = np.concatenate([codes, np.zeros(1, np.uint32)])
        kept = letters[codes]
        codes = np.where(kept, codes, 0).astype(np.uint32)
        gaps = np.concatenate([[0], np.cumsum(~kept)])
        found, value = [], codes
        for size in range(2, max(SIZES) + 1):
            n = len(codes) - size + 1
            if n <= 0:
                break
            value = value[:n] * np.uint32(0x01000193) + codes[size - 1:]
            inner = gaps[size - 1:size - 1 + n] == gaps[1:1 + n]
            whole = inner & (kept[:n] | kept[size - 1:]) if size == 2 else inner
            if size in SIZES:
                mixed = (value[whole] + np.uint32(size)) * np.uint32(0x9E3779B1)
                limit = BLOCK if start + BLOCK < len(text) else n
                first = np.flatnonzero(whole) < limit
                found.append((mixed >> np.uint32(32 - BUCKET_BITS))[first])
        if found:
            yield np.concatenate(found).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares in a text; at most one entry per bucket whatever its length."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for block in subwords(text):
        total += np.bincount(block, minlength=1 << BUCKET_BITS)
    buckets = np.flatnonzero(total)
    return buckets.astype(np.int32), (total[buckets] / max(1, total.sum())).astype(np.float32)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> dict | None:
    """The model from (language, buckets, shares); None without samples. The result depends on nothing else."""
    samples = [s for s in samples if len(s[1])]
    if not samples:
        return None
    languages = sorted({s[0] for s in samples})
    number = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(11)
    order = rng.permutation(len(samples))
    held = set(order[: len(samples) // 5].tolist())
    embedding = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    fit = [i for i in order.tolist() if i not in held] or order.tolist()
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            name, buckets, shares = samples[i]
            rate = 0.5 * (1 - done / steps)
            done += 1
            mean = shares @ embedding[buckets]
            wrong = _softmax(mean @ weights + bias)
            wrong[number[name]] -= 1
            back = weights @ wrong
            weights -= rate * np.outer(mean, wrong)
            bias -= rate * 0.1 * wrong
            embedding[buckets] -= (rate * 8) * shares[:, None] * back
    table = (embedding @ weights).astype(np.float32)
    check = [samples[i] for i in sorted(held)] or samples
    raw = np.stack([shares @ table[buckets] + bias for _, buckets, shares in check]).astype(np.float64)
    truth = np.array([number[name] for name, _, _ in check])
    grid = np.geomspace(0.05, 20, 120)
    # Smoothed targets (n + 1) / (n + 2) keep the temperature finite where every calibration document is right.
    goal = np.full(raw.shape, 1 / (len(truth) + 2) / max(1, raw.shape[1] - 1))
    goal[np.arange(len(truth)), truth] = (len(truth) + 1) / (len(truth) + 2)
    loss = [-(goal * np.log(np.maximum(_softmax(raw / t), 1e-12))).sum(axis=1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    scores = _softmax(raw / temperature)
    right = scores.argmax(axis=1) == truth
    accepted = scores.max(axis=1)[right] if right.any() else np.ones(1)
    threshold = min(0.5, float(np.quantile(accepted, REJECTED_SHARE)))
    return {"languages": languages, "table": table, "bias": bias, "temperature": temperature,
            "threshold": threshold, "calibration_accuracy": float(right.mean())}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def predict_text(model: dict | None, text: str | None) -> tuple[str, float]:
    """The language and its calibrated score; ``und`` and 0 for a text that is null or has no letter."""
    if model is None or not text:
        return UNKNOWN, 0.0
    total, n = np.zeros(len(model["languages"]), np.float64), 0
    for block in subwords(text):
        if len(block) > 1 << BUCKET_BITS:
            total += np.bincount(block, minlength=1 << BUCKET_BITS) @ model["table"]
        else:
            total += model["table"][block].sum(axis=0, dtype=np.float64)
        n += len(block)
    if not n:
        return UNKNOWN, 0.0
    scores = _softmax((total / n + model["bias"]) / model["temperature"])
    best = int(scores.argmax())
    return model["languages"][best], float(scores[best])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id, which is not learned either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang",
        sample: int = SAMPLE_DOCS, max_languages: int = MAX_LANGUAGES) -> dict | None:
    """The model of the labelled documents outside the held-out fold.

    The languages give about equally many documents, ``sample`` in sum, chosen by the hash of their id, and never more than
    twice that. Whole sampled texts are counted on the executors; the driver gets bucket shares.
    """
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(
        F.col("i").isNotNull() & F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("i")))
    sizes = (known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_languages).collect())
    if not sizes:
        return None
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["l"]), F.lit(min(1.0, sample / len(sizes) / r["count"])))])
    place = F.pmod(F.xxhash64(F.col("i"), F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = known.where(place < F.coalesce(F.try_element_at(share, F.col("l")), F.lit(0.0)))

    def count_batches(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = [counted(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([b.tobytes() for b, _ in pairs], pa.binary()),
                 pa.array([s.tobytes() for _, s in pairs], pa.binary())], ["i", "l", "b", "s"])

    rows = chosen.mapInArrow(count_batches, f"i {dict(known.dtypes)['i']}, l string, b binary, s binary")
    rows = sorted(rows.limit(2 * sample).collect(), key=lambda r: (str(r["i"]), r["l"], bytes(r["b"])))
    return train([(r["l"], np.frombuffer(r["b"], np.int32), np.frombuffer(r["s"], np.float32)) for r in rows])


def identify(docs: DataFrame, model: dict | None, text_col="text") -> DataFrame:
    """All rows and columns, with ``lang_pred``, ``score`` and ``rejected`` (calibrated score below the threshold).

    Older columns of these names are replaced. Null texts and texts without letters are ``und``, score 0, and
    rejected; without any labelled document all are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        found = [predict_text(shared.value, t if isinstance(t, str) else None) for t in texts]
        return pd.DataFrame(found, columns=["lang", "score"])

    name = free_name(docs, "guess")
    threshold = model["threshold"] if model else 1.0
    rejected = (F.col("lang_pred") == UNKNOWN) & (F.col("score") == 0) | (F.col("score") < threshold)
    return (
        docs.withColumn(name, guess(F.col(text_col)))
        .withColumns({"lang_pred": F.col(f"{name}.lang"), "score": F.col(f"{name}.score")})
        .withColumn("rejected", rejected).drop(name))


def keep_identified(docs: DataFrame, **names) -> DataFrame:
    """The documents whose language is recognised, with their own columns."""
    text = names.get("text_col", "text")
    plain = docs.select(F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return identify(plain, fit(docs, **names)).where("NOT rejected").select("row.*")
