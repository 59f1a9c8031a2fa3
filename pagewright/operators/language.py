"""Language profiles from labelled text, and detection with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewright.functions.base import as_col, find_all
from pagewright.operators.skew import broadcast_if_small
from pagewright.session import cut_lineage

GRAM = 3
DEFAULT_LANGUAGE = "en"
# Profile entries (gram and language) up to which profiles are broadcast: some
# forty bytes each.
BROADCAST_ENTRIES = 2_000_000
# Cells (gram by language, eight bytes each) up to which profiles are a table
# that every task looks grams up in.
TABLE_CELLS = 4_000_000
# Characters worked on at a time, which bounds the memory of a slice.
SLICE_CHARS = 1_000_000
# A code point needs so many bits; three of them make one whole number.
POINT_BITS = 21


def grams(text: Column | str, n: int = GRAM) -> Column:
    """All overlapping character n-grams of the lowered text.

    One non-overlapping pass per start offset keeps the work linear.
    """
    t = F.lower(as_col(text))
    return F.concat(*[find_all(F.substr(t, F.lit(i + 1)), f"(?s).{{{n}}}") for i in range(n)])


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every gram of the texts as a whole number, and how many each text has."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    windows = max(len(points) - GRAM + 1, 0)
    codes = np.zeros(windows, dtype=np.int64)
    for i in range(GRAM):
        codes = (codes << POINT_BITS) | points[i : i + windows]
    # Windows that reach into the next text are no grams.
    left = np.repeat(np.cumsum(lengths), lengths)[:windows] - np.arange(windows)
    return codes[left >= GRAM], np.maximum(lengths - GRAM + 1, 0)


def gram_texts(codes: np.ndarray) -> list[str]:
    points = [(codes >> (POINT_BITS * (GRAM - 1 - i))) & ((1 << POINT_BITS) - 1) for i in range(GRAM)]
    whole = np.stack(points, axis=1).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + GRAM] for i in range(0, len(whole), GRAM)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of rows, SLICE_CHARS characters at a time."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            keys.append(key.as_py())
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= SLICE_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _counted(kind: pa.DataType):
    """Rows (lang, gram, n) of the slices of rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _slices(batches):
            by_lang: dict = {}
            for lang, text in zip(langs, texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                codes, counts = np.unique(gram_codes(own)[0], return_counts=True)
                same = pa.repeat(pa.scalar(lang, kind), len(codes))
                yield pa.RecordBatch.from_arrays(
                    [same, pa.array(gram_texts(codes), pa.string()), pa.array(counts, pa.int64())], ["lang", "gram", "n"]
                )

    return run


def _gained(spread, key_kind: pa.DataType, lang_kind: pa.DataType):
    """Rows (key, total, lang, gain) of rows (key, text): one per text and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gains, langs = spread.value
        for keys, texts in _slices(batches):
            codes, totals = gram_codes(texts)
            distinct, index = np.unique(codes, return_inverse=True)
            at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
            found = np.where((known[at] == distinct)[:, None], gains[at], 0.0)
            present = np.flatnonzero(totals)
            if not len(present):
                continue
            starts = np.concatenate([[0], np.cumsum(totals[present])[:-1]])
            sums = [np.add.reduceat(found[index, i], starts) for i in range(len(langs))]
            own = pa.array([keys[i] for i in present], key_kind)
            for lang, gain in zip(langs, sums):
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(totals[present], pa.int32()), pa.repeat(pa.scalar(lang, lang_kind), len(own)), pa.array(gain)],
                    ["key", "total", "lang", "gain"],
                )

    return run


def language_profiles(corpus: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Counts per (lang, gram) and the add-one log probability.

    The grams of a slice of texts are counted before anything is shuffled.
    """
    rows = corpus.select(F.col(lang).alias("lang"), F.lower(text).alias("text")).where("text IS NOT NULL")
    kind = rows.schema["lang"].dataType
    counts = (
        rows.mapInArrow(_counted(to_arrow_type(kind)), f"lang {kind.simpleString()}, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    # One row per language.
    return counts.join(broadcast_if_small(totals), "lang").select(
        "lang",
        "gram",
        "n",
        F.log((F.col("n") + 1.0) / (F.col("total") + F.col("kinds") + 1.0)).alias("logp"),
        F.log(1.0 / (F.col("total") + F.col("kinds") + 1.0)).alias("floor"),
    )


def gains_by_table(df: DataFrame, entries: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, total, lang, gain) from few entries (lang, gram, gain)."""
    told = entries.toArrow()
    letters = told.column("gram").to_pylist()
    grams_known, gram_at = np.unique(gram_codes(letters)[0], return_inverse=True)
    listed = told.column("lang").combine_chunks().dictionary_encode()
    langs = listed.dictionary.to_pylist()
    gains = np.zeros((len(grams_known), len(langs)))
    gains[gram_at, listed.indices.to_numpy()] = told.column("gain").to_numpy()
    spread = df.sparkSession.sparkContext.broadcast((grams_known, gains, langs))
    rows = df.select(F.col(key).alias("key"), F.lower(text).alias("text")).where("text IS NOT NULL")
    key_kind, lang_kind = rows.schema["key"].dataType, entries.schema["lang"].dataType
    return rows.mapInArrow(
        _gained(spread, to_arrow_type(key_kind), to_arrow_type(lang_kind)),
        f"key {key_kind.simpleString()}, total int, lang {lang_kind.simpleString()}, gain double",
    ).withColumnRenamed("key", key)


def gains_by_join(df: DataFrame, entries: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, total, lang, gain) per gram of a text; lang null for unknown grams."""
    per_gram = entries.groupBy("gram").agg(F.collect_list(F.struct("lang", "gain")).alias("gains"))
    if entries.count() <= BROADCAST_ENTRIES:
        per_gram = F.broadcast(per_gram)
    split = df.select(key, grams(text).alias("_grams")).select(
        key, F.size("_grams").alias("total"), F.explode("_grams").alias("gram")
    )
    return (
        split.join(per_gram, "gram", "left")
        .select(key, "total", F.explode_outer("gains").alias("g"))
        .select(key, "total", F.col("g.lang").alias("lang"), F.col("g.gain").alias("gain"))
    )


def language_scores(df: DataFrame, profiles: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, langs): per language the loss, the negative mean log probability.

    A gram adds its gain over an unseen gram, so unknown grams add nothing.
    Profiles of up to TABLE_CELLS cells are a table in which tasks look up the
    grams of whole texts; larger ones are folded to one row per gram and
    joined, broadcast while their entries are few. No list of languages is
    capped.
    """
    entries = cut_lineage(profiles.select("lang", "gram", (F.col("logp") - F.col("floor")).alias("gain")))
    cells = entries.agg(F.count_distinct("gram") * F.count_distinct("lang")).first()[0]
    if 0 < cells <= TABLE_CELLS:
        gained = gains_by_table(df, entries, key, text)
    else:
        gained = gains_by_join(df, entries, key, text)
    gained = (
        gained.groupBy(key, "total", "lang")
        .agg(F.sum("gain").alias("gain"))
        # One small row per language a text shares a gram with.
        .groupBy(key, "total")
        .agg(F.map_from_entries(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "gain")))).alias("gains"))
    )
    floors = profiles.groupBy("lang").agg(F.max("floor").alias("floor")).agg(F.collect_list(F.struct("lang", "floor")))
    gain = lambda f: F.coalesce(F.try_element_at("gains", f["lang"]), F.lit(0.0))
    langs = F.transform(
        F.col("floors"), lambda f: F.struct((-(f["floor"] + gain(f) / F.col("total"))).alias("loss"), f["lang"].alias("lang"))
    )
    return gained.withColumn("floors", floors.scalar()).select(key, langs.alias("langs"))


def detect_language(df: DataFrame, profiles: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Best language per row; ``en`` when the text gives nothing to judge."""
    best = language_scores(df, profiles, key, text).select(key, F.array_min("langs")["lang"].alias("language"))
    return df.join(best, key, "left").withColumn(
        "language", F.coalesce("language", F.lit(DEFAULT_LANGUAGE))
    )


def detect_languages(
    df: DataFrame, profiles: DataFrame, key: str, text: str = "text", sharpness: float = 20.0
) -> DataFrame:
    """All candidates with a probability: a softmax of the scores per row."""
    # Scores are read twice, for rows that have some and for rows without.
    found = cut_lineage(language_scores(df, profiles, key, text))
    least = F.array_min("langs")["loss"]
    weights = F.transform(
        "langs",
        lambda c: F.struct(c["lang"].alias("lang"), F.exp((least - c["loss"]) * sharpness).alias("w")),
    )
    known = (
        found.select(key, weights.alias("ws"))
        .withColumn("sum", F.aggregate("ws", F.lit(0.0), lambda acc, c: acc + c["w"]))
        .select(key, "sum", F.inline("ws"))
        .select(key, "lang", (F.col("w") / F.col("sum")).alias("prob"))
    )
    missing = df.join(found, key, "left_anti").select(
        key, F.lit(DEFAULT_LANGUAGE).alias("lang"), F.lit(1.0).alias("prob")
    )
    return known.unionByName(missing)
