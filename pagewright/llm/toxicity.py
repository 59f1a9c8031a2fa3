"""Toxicity: a classifier that swapping group names must not move."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Learning looks at this many labelled rows of each class at most, those with
# the least hash of their doc_id.
SAMPLE_PER_CLASS = 3_000
# A feature is a word or a beginning of this many letters of a longer word.
PREFIXES = (4, 5, 6)
BUCKETS = 1 << 18
# Features that enter the model: seen in this many sampled rows at least, and
# of those the most telling ones.
LEAST_ROWS, FEATURES = 3, 4_096
STEPS = 300
LASSO, RIDGE = 2e-4, 1e-4
# Weight of the squared score changes under swaps.
SWAP_PENALTY = 1.0
HELD_OUT_MOD = 5
# Words remembered by a scoring task.
CACHE_WORDS = 1 << 20

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")

# Names of groups of people; those of one row can stand for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("ausländer", "einheimische"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


def features_of(word: str) -> tuple[int, ...]:
    marks = (word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n))
    return tuple(dict.fromkeys(zlib.crc32(m.encode("utf-8", "surrogatepass")) % BUCKETS for m in marks))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def bag(words) -> set[int]:
    return {f for w in set(words) for f in features_of(w)}


def swaps(text: str | None, terms=IDENTITY_TERMS) -> list[list[str]]:
    """Word lists of a text with its group names swapped, sentence by sentence.

    One has every name replaced by the next of its row, one has them left out,
    which is what a neutral mention amounts to. Texts without a name have none.
    """
    following = {t: row[(i + 1) % len(row)] for row in terms for i, t in enumerate(row)}
    renamed, without, found = [], [], False
    for sentence in SENTENCE.findall(text or ""):
        words = words_of(sentence)
        named = [w for w in words if w in following]
        found = found or bool(named)
        renamed += [following.get(w, w) for w in words] if named else words
        without += [w for w in words if w not in following] if named else words
    return [renamed, without] if found else []


@dataclass
class Model:
    """Bias and non-zero weights by feature; at most FEATURES of them."""

    bias: float
    weights: dict[int, float]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == 0, F.lit(False))


def packed(features: set[int]) -> bytes:
    """Feature numbers in order, four bytes each: small on their way and kept."""
    return np.array(sorted(features), dtype="<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """A view of the bytes: the sample's features are not copied one by one."""
    return np.frombuffer(data, dtype="<u4")


def _bags(terms):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, gained, lost = [], [], []
            for text in batch["text"]:
                here = bag(words_of(text))
                own.append(packed(here))
                others = [bag(words) for words in swaps(text, terms)]
                gained.append([packed(o - here) for o in others])
                lost.append([packed(here - o) for o in others])
            yield pd.DataFrame({"toxic": batch["toxic"], "own": own, "gained": gained, "lost": lost})

    return run


def training_rows(docs: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS) -> DataFrame:
    """Bounded sample: (toxic, own, gained, lost) features of labelled texts.

    Rows that are held out, have no doc_id or no label 0 or 1 do not count. Of
    several labels of a document 1 wins; of several texts the least does.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(SAMPLE_PER_CLASS).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(SAMPLE_PER_CLASS)
    )
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * SAMPLE_PER_CLASS rows
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
        .repartition("doc_id")
        .mapInPandas(_bags(terms), "toxic int, own binary, gained array<binary>, lost array<binary>")
    )


def _columns(rows, column: np.ndarray):
    """Row numbers and column numbers of the known features of each row."""
    sizes = [len(r) for r in rows]
    flat = column[np.concatenate(rows)] if sum(sizes) else np.zeros(0, np.int32)
    at = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    return at[flat >= 0], flat[flat >= 0]


def learn(rows: pd.DataFrame, swap_penalty: float = SWAP_PENALTY) -> Model:
    """Logistic regression with a lasso and a penalty on score changes.

    Minimises the class-balanced log loss plus ``swap_penalty`` times the mean
    squared change of the log-odds between a text and its swapped versions, by
    accelerated proximal gradient steps. Without rows of both classes the
    model is a constant, low without any label.
    """
    y = rows["toxic"].to_numpy(dtype=float)
    n, toxic = len(y), y.sum()
    if not 0 < toxic < n:
        share = (toxic + 0.1) / (n + 1.0)
        return Model(float(np.log(share / (1 - share))), {})
    own = [unpacked(r) for r in rows["own"]]
    seen = np.bincount(np.concatenate(own), minlength=BUCKETS)
    in_toxic = np.bincount(np.concatenate([r for r, label in zip(own, y) if label]), minlength=BUCKETS)
    expected = seen * toxic / n
    telling = np.where(seen >= LEAST_ROWS, (in_toxic - expected) ** 2 / np.maximum(expected, 1e-9), 0)
    chosen = np.lexsort((np.arange(BUCKETS), -telling))[:FEATURES]
    chosen = np.sort(chosen[telling[chosen] > 0])
    column = np.full(BUCKETS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    row, col = _columns(own, column)
    gained = [unpacked(g) for r in rows["gained"] for g in r]
    lost = [unpacked(g) for r in rows["lost"] for g in r]
    pairs = len(gained)
    more_row, more_col = _columns(gained, column)
    less_row, less_col = _columns(lost, column)
    d_row, d_col = np.concatenate((more_row, less_row)), np.concatenate((more_col, less_col))
    d_sign = np.concatenate((np.ones(len(more_row)), -np.ones(len(less_row))))
    balance = np.where(y == 1, 0.5 / toxic, 0.5 / (n - toxic))

    def times(w):
        return np.bincount(row, weights=w[col], minlength=n), np.bincount(d_row, weights=d_sign * w[d_col], minlength=pairs)

    def back(r, d):
        k = len(chosen)
        return np.bincount(col, weights=r[row], minlength=k) + np.bincount(d_col, weights=d_sign * d[d_row], minlength=k)

    # The step is the inverse of the curvature's largest eigenvalue.
    probe = np.ones(len(chosen))
    largest = 1.0
    for _ in range(30):
        x, d = times(probe)
        probe = back(0.25 * balance * x, 2 * swap_penalty * d / max(pairs, 1))
        largest = float(np.linalg.norm(probe)) or 1.0
        probe /= largest
    step = 1 / (1.1 * largest + 0.25 + RIDGE)
    w, bias, momentum = np.zeros(len(chosen)), 0.0, 1.0
    ahead, ahead_bias = w, bias
    for _ in range(STEPS):
        x, d = times(ahead)
        gap = balance * (1 / (1 + np.exp(-np.clip(x + ahead_bias, -500, 500))) - y)
        slope = back(gap, 2 * swap_penalty * d / max(pairs, 1)) + RIDGE * ahead
        moved = ahead - step * slope
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
        new_bias = ahead_bias - step * gap.sum()
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_bias = new + (momentum - 1) / nxt * (new - w), new_bias + (momentum - 1) / nxt * (new_bias - bias)
        w, bias, momentum = new, new_bias, nxt
    return Model(float(bias), {int(f): float(v) for f, v in zip(chosen, w) if v})


def fit(docs: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS, swap_penalty: float = SWAP_PENALTY) -> Model:
    return learn(training_rows(docs, labels, terms).toPandas(), swap_penalty)


def score_texts(texts, model: Model, cache: dict[str, tuple[int, ...]]) -> list[float]:
    """Scores of whole texts. Weights are summed in feature order, so reruns agree."""
    out, weights = [], model.weights
    for text in texts:
        active: set[int] = set()
        for word in set(words_of(text)):
            known = cache.get(word)
            if known is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                known = cache[word] = tuple(f for f in features_of(word) if f in weights)
            active.update(known)
        out.append(float(1 / (1 + np.exp(-np.clip(_summed(weights, active) + model.bias, -500, 500)))))
    return out


def _summed(weights: dict[int, float], active: set[int]) -> float:
    return float(np.sum([weights[f] for f in sorted(active)])) if active else 0.0


def score(text: Column, model: Model) -> Column:
    """Score column of whole texts, 0 to 1; null texts score as empty ones."""
    shared = F.pandas_udf(_scorer(model), "double")
    return shared(text)


def _scorer(model: Model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            yield pd.Series(score_texts(texts, model, cache), dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per document row.

    The score sees the text alone. Null and empty texts get the score of a text
    without features; a null doc_id is scored and counts as not held out.
    """
    model = fit(docs, labels)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score is below one half, with all their columns."""
    return docs.where(score(F.col("text"), fit(docs, labels)) < 0.5)
