"""Record shapes: exports, media and JSON profiles, vectors, joined texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.base import as_col, is_json, strip
from pagewright.functions.pages import content_route, header
from pagewright.operators.skew import top_per_group
from pagewright.session import cut_lineage

# Leading bytes of image formats, in hex.
IMAGE_MAGIC = [("89504E47", "PNG"), ("FFD8FF", "JPEG"), ("47494638", "GIF"), ("424D", "BMP"), ("52494646", "WEBP")]
JSON_SAMPLE = 500


def upsert_latest(existing: DataFrame, updates: DataFrame, key: str = "url", ts: str = "ts") -> DataFrame:
    """Last write per key. On equal times an update beats what is stored."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in (key, ts)]
    latest = both.groupBy(key).agg(F.max(F.struct(ts, "_new", *rest)).alias("_row"))
    return latest.select(key, *[F.col(f"_row.{c}").alias(c) for c in [ts, *rest]]).select(*existing.columns)


def collect_text(
    df: DataFrame, group: str, order: str, text: str = "text", part_span: int = 1000
) -> DataFrame:
    """Non-empty texts, trimmed and joined by a blank line, in bounded parts.

    The texts of one group fill as many parts as it needs: part p joins the
    rows whose ``order`` lies in its span, and the parts in order joined by a
    blank line are the whole. ``order`` is a non-negative, unique number per
    group, so no part outgrows its span.
    """
    kept = df.filter(F.coalesce(F.col(text), F.lit("")) != "").select(
        group, (F.col(order) / part_span).cast("long").alias("part"), order, strip(F.col(text)).alias("_t")
    )
    ordered = F.array_sort(F.collect_list(F.struct(order, "_t")))
    return kept.groupBy(group, "part").agg(
        F.array_join(F.transform(ordered, lambda x: x["_t"]), "\n\n").alias("text")
    )


def vector_table(records: DataFrame, vectors: DataFrame, key: str = "url", embedding: str = "embedding") -> DataFrame:
    """id, document, metadata and vector per record; no vector is an error."""
    joined = records.join(vectors.select(key, embedding), key, "left")
    checked = F.when(F.col(embedding).isNull(), F.raise_error(F.lit("record without vector"))).otherwise(
        F.col(embedding)
    )
    return joined.select(
        F.col(key).cast("string").alias("id"),
        F.to_json(F.struct(*records.columns)).alias("document"),
        F.create_map(F.lit(key), F.col(key).cast("string")).alias("metadata"),
        checked.alias("embedding"),
    )


# Shards by space: at most so many centres, each drawn from the vectors by hash.
MOST_CENTRES = 512
# Rows, and copies of queries, that a task works on and gives out at once.
ROUTED_ROWS = 2_048
# Room for rounding in sums of squares, as a share of them.
ROUNDING = 1e-9
# The same for single precision, for each dimension.
ROUNDING_SHORT = 2.0**-21
# Points and rows whose distances stand in one matrix, and rows near enough to
# be looked at again at once, in all and as a multiple of those wanted.
POINTS_AT_ONCE, ROWS_AT_ONCE = 256, 2_048
MET_AT_ONCE, FEW_MET = 32_768, 4
# Bytes of vectors in a group of shards, and in a block of queries that meets it.
GROUP_BYTES = 32 << 20
# Cells of groups and blocks that a core is given at least, where there are rows enough.
CELLS_PER_CORE = 4
# Tasks that a search is dealt to at most; beyond that, a task has several cells.
MOST_TASKS = 2_000


def _pieces(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows]


def _place(centres: np.ndarray):
    """Centre next to each vector, and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches, ROUTED_ROWS):
            points = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            distance = _distances(points, centres)
            near = distance.argmin(axis=1)
            yield batch.assign(centre=near.astype(np.int32), off=distance[np.arange(len(points)), near])

    return run


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty((len(points), len(centres)))
    for i, centre in enumerate(centres):
        out[:, i] = np.sqrt(np.square(points - centre).sum(axis=1))
    return out


def _route(
    centres: np.ndarray, radius: np.ndarray, counts: np.ndarray, k: int, home: bool, groups: np.ndarray | None = None
):
    """Shards each query has to search: its own, or all others within its bound.

    No vector of a shard is nearer than the distance to its centre less its
    radius, and none farther than that plus the radius. The k-th nearest is
    therefore no farther than the least such sum that k vectors lie within.
    With ``groups``, the group of each shard, the groups of all shards within
    the bound are given, the own one too, in place of the shards.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches, ROUTED_ROWS):
            points = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            distance = _distances(points, centres)
            own = distance.argmin(axis=1)
            if home:
                yield batch.drop(columns=["bound"]).assign(centre=own.astype(np.int32), bound=np.inf)
                continue
            far = distance + radius
            order = far.argsort(axis=1)
            within = np.cumsum(counts[order], axis=1) >= k
            enough = np.where(within.any(axis=1), within.argmax(axis=1), -1)
            sums = np.where(enough < 0, np.inf, far[np.arange(len(far)), order[np.arange(len(far)), enough]])
            bound = np.minimum(sums, np.sqrt(batch["bound"].fillna(np.inf).to_numpy())) * (1 + ROUNDING)
            needed = ~(np.maximum(distance - radius, 0) * (1 - ROUNDING) > bound[:, None]) & (counts > 0)
            if groups is None:
                needed[np.arange(len(own)), own] = False
            else:
                held = np.zeros((len(needed), groups.max() + 1), dtype=bool)
                for shard, group in enumerate(groups):
                    held[:, group] |= needed[:, shard]
                needed = held
            row, centre = np.nonzero(needed)
            # A query may need every shard: its copies are given out in bounded pieces.
            for i in range(0, len(row), ROUTED_ROWS):
                rows = row[i : i + ROUTED_ROWS]
                out = batch.drop(columns=["bound"]).iloc[rows]
                yield out.assign(centre=centre[i : i + ROUTED_ROWS].astype(np.int32), bound=bound[rows])

    return run


def _least(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, distance, name) the first k of each query, by distance and name."""
    query, distance, name = found
    order = np.lexsort((name, distance, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    first = order[place < k]
    return [column[first] for column in found]


def nearest_of(
    points: np.ndarray, bound: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, distance, name) of the k rows nearest to each point, equal ones by name.

    Rows farther than the square ``bound`` of a point may be left out. A matrix
    product rules out all rows but a few, with room for its rounding; only
    distances of these are summed up as differences.
    """
    square, weight = np.square(points).sum(axis=1), np.square(rows).sum(axis=1)
    heaviest = np.fmax.reduce(weight, initial=0)
    # Half of what a point's square exceeds a distance by is its product with a row, less half that row's square.
    left = np.hstack([points, np.ones((len(points), 1))])
    right = np.hstack([rows, -weight[:, None] / 2])
    slack = ROUNDING * (square + heaviest)
    # Single precision is tried first where it holds these sums.
    short = max(heaviest, np.fmax.reduce(square, initial=0)) < 1e30
    if short:
        left_short, right_short = left.astype(np.float32), right.astype(np.float32)
        slack_short = ROUNDING_SHORT * left.shape[1] * (square + heaviest) + 1e-30
    out = []
    for start in range(0, len(points), POINTS_AT_ONCE):
        some = slice(start, start + POINTS_AT_ONCE)
        own, base, top = points[some], square[some], bound[some].copy()
        best = [np.empty(0, dtype=np.int64), np.empty(0), names[:0]]
        for first in range(0, len(rows), ROWS_AT_ONCE):
            those = slice(first, first + ROWS_AT_ONCE)
            part, met = rows[those], None
            if short:
                floor = ((base - top - slack_short[some]) / 2).astype(np.float32)
                # What is not a number is not ruled out.
                met = np.flatnonzero(~(left_short[some] @ right_short[those].T < floor[:, None]))
            if met is None or len(met) > FEW_MET * k * len(own):
                score = left[some] @ right[those].T
                if len(part) >= k:
                    # No bound yet, or a wide one: the k-th nearest of this part is one.
                    kth = np.partition(score, -k, axis=1)[:, -k]
                    top = np.fmin(top, base - 2 * kth + slack[some])
                met = np.flatnonzero(~(score < ((base - top - slack[some]) / 2)[:, None]))
            # Equal distances may be many: they are looked at in bounded pieces.
            for i in range(0, len(met), MET_AT_ONCE):
                x, y = np.divmod(met[i : i + MET_AT_ONCE], len(part))
                distance = np.square(part[y] - own[x]).sum(axis=1)
                best = _least([np.concatenate(pair) for pair in zip(best, (x, distance, names[first + y]))], k)
            query, distance, _ = best
            full = np.flatnonzero(np.bincount(query, minlength=len(own)) >= k)
            last = np.searchsorted(query, full, "right") - 1
            top[full] = np.fmin(top[full], distance[last])
        out.append((best[0] + start, best[1], best[2]))
    return tuple(np.concatenate(column) for column in zip(*out))


def _nearest(k: int, key: str):
    """The k nearest rows of a shard for each query that is sent to it."""

    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shard):
            return pd.DataFrame({"query_id": [], key: [], "distance": []}).astype({"query_id": "int64", key: "int64"})
        rows, names = np.stack(shard["embedding"].to_numpy()).astype(np.float64), shard[key].to_numpy()
        points = np.stack(queries["embedding"].to_numpy()).astype(np.float64)
        # Bounds are distances, with room for rounding; here squares are compared.
        bound = np.square(queries["bound"].fillna(np.inf).to_numpy(dtype=np.float64))
        at, distance, found = nearest_of(points, bound, rows, names, k)
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[at], key: found, "distance": distance})

    return run


def space_shards(vectors: DataFrame, key: str, shard_rows: int) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Vectors with their shard, the centres, and (centre, radius, rows, pieces).

    A vector belongs to the nearest of at most MOST_CENTRES centres, a sample
    drawn by hash that decides what is skipped, never what is found. A shard
    of more than ``shard_rows`` vectors is cut into pieces.
    """
    wanted = max(1, min(MOST_CENTRES, -(-vectors.count() // shard_rows) * 4))
    drawn = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(wanted).collect()
    centres = np.unique(np.array([r["embedding"] for r in drawn], dtype=np.float64), axis=0)
    fields = ", ".join(f"{name} {dtype}" for name, dtype in vectors.select(key, "embedding").dtypes)
    placed = cut_lineage(vectors.select(key, "embedding").mapInPandas(_place(centres), f"{fields}, centre int, off double"))
    sizes = placed.groupBy("centre").agg(F.max("off").alias("radius"), F.count("*").alias("rows"))
    return placed, centres, sizes.withColumn("pieces", F.ceil(F.col("rows") / shard_rows).cast("int"))


def routed_queries(
    asked: DataFrame, centres: np.ndarray, sizes: DataFrame, k: int, home: bool, groups: np.ndarray | None = None
) -> DataFrame:
    """Rows (query_id, embedding, bound, centre): a row per shard, or group of shards, to search."""
    radius, counts = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    # One row per centre, of which there are MOST_CENTRES at most.
    for row in sizes.collect():
        radius[row["centre"]], counts[row["centre"]] = row["radius"], row["rows"]
    dtype = dict(asked.dtypes)["embedding"]
    return asked.mapInPandas(
        _route(centres, radius, counts, k, home, groups), f"query_id long, embedding {dtype}, centre int, bound double"
    )


def shard_groups(centres: np.ndarray, sizes: DataFrame, group_rows: int) -> np.ndarray:
    """Group of each shard: neighbours along the widest direction, about ``group_rows`` vectors in each."""
    counts = np.zeros(len(centres), dtype=np.int64)
    for row in sizes.collect():
        counts[row["centre"]] = row["rows"]
    middle = centres - centres.mean(axis=0)
    order = (middle @ np.linalg.svd(middle, full_matrices=False)[2][0]).argsort(kind="stable")
    groups = np.empty(len(centres), dtype=np.int64)
    # A shard lies in the group in which its vectors begin.
    groups[order] = (np.cumsum(counts[order]) - counts[order]) // group_rows
    return np.unique(groups, return_inverse=True)[1]


def knn_l2(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "vec_id",
    block_rows: int | None = None,
    shard_rows: int = 2_048,
) -> DataFrame:
    """Exact k nearest vectors per query by squared L2 distance.

    Vectors lie in shards by space. Every query first searches the shard of its
    centre; the k-th distance found there rules out all shards that lie
    farther away, by the triangle inequality. Where many dimensions leave most
    shards, a copy of the query for each would be many times the table, so
    shards are searched in groups: a query is sent once to each group that has a
    shard within its bound. Groups and blocks of queries are of bounded size
    (``block_rows``, by default by GROUP_BYTES), and one task holds one of each.
    Of equal vectors the first k are enough. A missing vector has no distance
    (null) and comes after all others. ``key`` is a number.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(key, "embedding")
    queries = cut_lineage(queries.select(F.col(key).cast("long").alias("query_id"), "embedding"))
    blank = vectors.where("embedding IS NULL").select(key).orderBy(key).limit(k)
    live = cut_lineage(top_per_group(vectors.where("embedding IS NOT NULL"), ["embedding"], [F.col(key)], k))
    lone = queries.where("embedding IS NULL").select("query_id")
    first = vectors.select(key).orderBy(key).limit(k)
    # At most k rows are broadcast. A query takes missing vectors only if it finds too few others.
    unmeasured = lone.crossJoin(F.broadcast(first))
    rows = live.count()
    if rows < k:
        unmeasured = unmeasured.unionByName(queries.where("embedding IS NOT NULL").select("query_id").crossJoin(F.broadcast(blank)))
    unmeasured = unmeasured.select("query_id", F.col(key).cast("long").alias(key), F.lit(None).cast("double").alias("distance"))
    nearest_first = [F.col("distance").asc_nulls_last(), F.col(key)]
    if not rows:
        return top_per_group(unmeasured, ["query_id"], nearest_first, k, rank="rank")
    asked = queries.where("embedding IS NOT NULL").withColumn("bound", F.lit(None).cast("double"))
    placed, centres, sizes = space_shards(live, key, shard_rows)
    sizes = cut_lineage(sizes)
    # Large tables are cut by bytes, small ones so that all cores have cells.
    most = max(1, GROUP_BYTES // (8 * centres.shape[1]))
    spread = math.ceil(math.sqrt(CELLS_PER_CORE * spark.sparkContext.defaultParallelism))
    group_rows = max(shard_rows, min(most, -(-rows // spread)))
    block_rows = block_rows or max(shard_rows, min(most, -(-queries.count() // spread)))

    def search(routed: DataFrame, held: DataFrame, size: int, most_tasks: int) -> DataFrame:
        # ``held`` has a place, a shard or group, as ``centre``. Of a place with far
        # more than ``size`` vectors, pieces of about that size are searched on their own.
        pieces = held.groupBy("centre").agg(F.greatest(F.lit(1), F.round(F.count("*") / size)).cast("int").alias("pieces"))
        # Queries of one place are cut into blocks; vectors go to each block once.
        block_count = routed.groupBy("centre").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        wanted = cut_lineage(pieces.join(block_count, "centre"))
        sent = routed.join(F.broadcast(wanted), "centre").select(
            "query_id",
            "embedding",
            "bound",
            "centre",
            F.pmod(F.xxhash64("query_id"), F.col("blocks").cast("long")).alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
        )
        met = held.join(F.broadcast(wanted), "centre").select(
            key,
            "embedding",
            "centre",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"),
            F.pmod(F.xxhash64(key), F.col("pieces")).cast("int").alias("piece"),
        )
        where = ["centre", "block", "piece"]
        # Cells are much work on few bytes: their tasks are not merged by size.
        cells = wanted.agg(F.sum(F.col("blocks") * F.col("pieces"))).first()[0] or 1
        tasks = min(cells, most_tasks)
        pairs = sent.repartition(tasks, *where).groupBy(*where).cogroup(met.repartition(tasks, *where).groupBy(*where))
        return pairs.applyInPandas(_nearest(k, key), f"query_id long, {key} long, distance double")

    near = search(routed_queries(asked, centres, sizes, k, home=True), placed, shard_rows, 2 * spread * spread)
    found = cut_lineage(top_per_group(near, ["query_id"], nearest_first, k))
    bounds = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))
    groups = shard_groups(centres, sizes, group_rows)
    group_of = F.get(F.lit(groups.tolist()), F.col("centre")).cast("int")
    others = routed_queries(asked.drop("bound").join(bounds, "query_id", "left"), centres, sizes, k, home=False, groups=groups)
    scored = search(cut_lineage(others), placed.withColumn("centre", group_of), group_rows, MOST_TASKS)
    return top_per_group(scored.unionByName(unmeasured), ["query_id"], nearest_first, k, rank="rank")


def media_profile(df: DataFrame) -> DataFrame:
    """Size, content type and, for images, format of media responses."""
    magic = F.hex(F.substr("content", F.lit(1), F.lit(8)))
    fmt = None
    for prefix, name in IMAGE_MAGIC:
        test = F.startswith(magic, F.lit(prefix))
        fmt = F.when(test, name) if fmt is None else fmt.when(test, name)
    routed = df.withColumn("media", content_route("headers", "url"))
    return routed.filter(F.col("media").isin("image", "video", "audio")).select(
        "url",
        "media",
        F.octet_length("content").alias("size"),
        header("headers", "content-type").alias("content_type"),
        F.when(F.col("media") == "image", fmt).alias("format"),
    )


def json_profile(payload: Column | str) -> Column:
    """Type, object keys and sample of a JSON text; null when not JSON."""
    p = as_col(payload)
    kind = F.schema_of_variant(F.try_parse_json(p))
    name = (
        F.when(F.startswith(kind, F.lit("OBJECT")), "dict")
        .when(F.startswith(kind, F.lit("ARRAY")), "list")
        .when(kind == "STRING", "str")
        .when(kind == "BIGINT", "int")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "VOID", "NoneType")
        .otherwise("float")
    )
    keys = F.coalesce(F.json_object_keys(p), F.array().cast("array<string>"))
    return F.when(
        is_json(p),
        F.struct(
            name.alias("type"),
            F.when(name == "dict", keys).otherwise(F.array().cast("array<string>")).alias("keys"),
            F.left(p, F.lit(JSON_SAMPLE)).alias("sample"),
        ),
    )


def export_records(pages: DataFrame) -> DataFrame:
    """Flat export record of processed pages."""
    return pages.select(
        "url",
        F.to_json(F.struct(F.col("text_info").alias("text"))).alias("content"),
        F.to_json("structured").alias("structured_data"),
        "status_code",
        "headers",
        F.col("text_info.text").alias("text"),
    )

