"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import fresh, prefix_sums, stored, word_count

# A source gives at most this many passes over its documents.
MAX_PASSES = 3
# Leading hex digits of the order key that cut a source into slices.
SLICE_DIGITS = 3


@dataclass(frozen=True)
class Schedule:
    """Weight of a source over training time 0..1, linear between knots."""

    knots: tuple[tuple[float, float], ...]

    def __post_init__(self) -> None:
        times = [t for t, _ in self.knots]
        if times != sorted(set(times)) or (times[0], times[-1]) != (0.0, 1.0):
            raise ValueError("knots have to rise from time 0 to time 1")
        if min(w for _, w in self.knots) < 0 or self.total <= 0:
            raise ValueError("weights must not be negative, and some must be positive")

    @property
    def segments(self) -> list[tuple[float, float, float, float]]:
        return [(t0, w0, t1, w1) for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:])]

    @property
    def total(self) -> float:
        """The schedule's integral: the source's weight over the whole training."""
        return sum((t1 - t0) * (w0 + w1) / 2 for t0, w0, t1, w1 in self.segments)

    def time_of(self, share: Column) -> Column:
        """Inverse of the integral: when ``share`` of the demand has been met."""
        out, done = F.lit(1.0), self.total
        for t0, w0, t1, w1 in reversed(self.segments):
            done -= (t1 - t0) * (w0 + w1) / 2
            need = F.greatest(share * self.total - done, F.lit(0.0))
            root = w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * (w1 - w0) / (t1 - t0) * need, F.lit(0.0)))
            here = F.lit(t0) + F.when(root > 0, F.least(2 * need / root, F.lit(t1 - t0))).otherwise(0.0)
            out = here if (t1, w1) == self.knots[-1] else F.when(share * self.total < done + (t1 - t0) * (w0 + w1) / 2, here).otherwise(out)
        return out


# Sources in code point order take these in turn. Their integrals are 1, 2
# and 3: the first kind fades out, the third grows towards the end.
CURRICULUM = (
    Schedule(((0.0, 1.5), (1.0, 0.5))),
    Schedule(((0.0, 2.0), (1.0, 2.0))),
    Schedule(((0.0, 2.0), (0.5, 3.0), (1.0, 4.0))),
)


def source_targets(sizes: DataFrame, curriculum: tuple[Schedule, ...] = CURRICULUM) -> DataFrame:
    """Add kind, target to one row per source (no_source, name, source_size).

    Weights share the sum of all sizes; a target stops at MAX_PASSES times its
    source's size and the excess goes to the others by weight. That is the one
    level at which every source gets the smaller of its cap and level * weight,
    so it is read off prefix sums over the sources in order of cap / weight.
    """
    ranked = prefix_sums(sizes, ["no_source", "name"], {"rank": F.lit(1)})
    kind = ((F.col("rank") - 1) % len(curriculum)).cast("int")
    weight = F.element_at(F.array(*[F.lit(s.total) for s in curriculum]), F.col("kind") + 1)
    capped = ranked.withColumn("kind", kind).select(
        "*", weight.alias("weight"), (F.col("source_size") * MAX_PASSES).cast("double").alias("cap")
    )
    filled = prefix_sums(
        capped.withColumn("fill", F.col("cap") / F.col("weight")),
        ["fill", "no_source", "name"],
        {"caps": F.col("cap"), "weights": F.col("weight")},
    )
    total, weights = filled.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    is_full = F.col("cap") * (F.lit(weights) - F.col("weights") + F.col("weight")) <= F.col("weight") * (
        F.lit(total) - F.col("caps") + F.col("cap")
    )
    filled = stored(filled.withColumn("full", is_full), "targets")
    caps, free = filled.agg(
        F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0.0)),
        F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0)),
    ).first()
    share = F.col("weight") * F.lit((total or 0.0) - caps) / F.lit(free or 1.0)
    return filled.select(
        "no_source", "name", "source_size", "kind", F.when(F.col("full"), F.col("cap")).otherwise(share).alias("target")
    )


def plan_mix(
    docs: DataFrame,
    size: Column | None = None,
    curriculum: tuple[Schedule, ...] = CURRICULUM,
    out: str = "mix",
) -> DataFrame:
    """Add the struct ``out``: size, source_size, target, taken, positions.

    ``docs`` needs doc_id and source (and text, unless ``size`` is given).
    Within a source, documents follow in the order of the MD5 of their id; the
    target is met by whole passes and, of the last pass, by the documents whose
    middle lies before its end, so a source ends within half a document of its
    target. ``positions`` has the training time of every copy.

    A null source is a source of its own, ordered last; null texts have size 0;
    a source without words takes nothing; a null doc_id orders first; repeated
    rows count one by one. A column of ``docs`` named ``out`` is replaced.

    No source is gathered: it is cut into slices by the leading digits of the
    order key, slices are summed before they are shuffled, and only within a
    slice rows are numbered.
    """
    if out in docs.columns:
        docs = docs.drop(out)
    key, no_source, name, part, tie, length, before, start, info = fresh(
        docs, "_key", "_no_source", "_name", "_slice", "_tie", "_length", "_before", "_start", "_info"
    )
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    keyed = docs.withColumns(
        {
            length: (word_count(F.col("text")) if size is None else size).cast("long"),
            key: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
            no_source: F.col("source").isNull(),
            name: F.coalesce("source", F.lit("")),
        }
    ).withColumns({part: F.substring(key, 1, SLICE_DIGITS), tie: F.xxhash64(*plain)})
    slices = stored(
        keyed.groupBy(F.col(no_source).alias("no_source"), F.col(name).alias("name"), F.col(part).alias("part")).agg(
            F.sum(length).alias("words")
        ),
        "slices",
    )
    sizes = slices.groupBy("no_source", "name").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, curriculum)
    earlier = Window.partitionBy("no_source", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slices.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(targets, ["no_source", "name"])
        .select(
            F.col("no_source").alias(no_source),
            F.col("name").alias(name),
            F.col("part").alias(part),
            F.col("start").alias(start),
            F.struct("source_size", "target", "kind").alias(info),
        )
    )
    order = Window.partitionBy(no_source, name, part).orderBy(key, length, tie)
    placed = keyed.join(starts, [no_source, name, part]).withColumn(
        before, F.col(start) + F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length)
    )
    whole, target = F.col(info)["source_size"], F.col(info)["target"]
    passes = F.when(whole > 0, F.floor(target / whole)).otherwise(F.lit(0)).cast("long")
    left = target - passes * whole
    copies = passes + (2 * F.col(before) + F.col(length) < 2 * left).cast("long")

    def position(k: Column) -> Column:
        share = (k * whole + F.col(before) + F.col(length) / 2) / target
        found = curriculum[-1].time_of(share)
        for i, schedule in enumerate(curriculum[:-1]):
            found = F.when(F.col(info)["kind"] == i, schedule.time_of(share)).otherwise(found)
        return found

    numbers = F.filter(F.array(*[F.lit(i).cast("long") for i in range(MAX_PASSES)]), lambda k: k < copies)
    mix = F.struct(
        F.col(length).alias("size"),
        whole.alias("source_size"),
        target.alias("target"),
        (copies * F.col(length)).alias("taken"),
        F.transform(numbers, position).alias("positions"),
    )
    return placed.select(*docs.columns, mix.alias(out))


def training_order(planned: DataFrame, mix: str = "mix") -> DataFrame:
    """One row per copy in order of training time: range-sorted by position.

    ``mix`` becomes the copy's position. Copies at one position are ordered by
    document id. Documents that the mix leaves out have no row.
    """
    return (
        planned.withColumn(mix, F.explode(F.col(f"`{mix}`.positions")))
        .repartitionByRange(F.col(f"`{mix}`"), F.col("doc_id"))
        .sortWithinPartitions(F.col(f"`{mix}`"), F.col("doc_id"))
    )


def mix_report(planned: DataFrame, mix: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, position, in training order.

    ``position`` is the first copy's; documents left out come last.
    """
    first = F.when(F.size(F.col(f"`{mix}`.positions")) > 0, F.get(F.col(f"`{mix}`.positions"), F.lit(0))).otherwise(2.0)
    return (
        planned.select("doc_id", *[f"{mix}.{c}" for c in ("size", "source_size", "target", "taken")], first.alias("position"))
        .repartitionByRange("position", "doc_id")
        .sortWithinPartitions("position", "doc_id")
        .withColumn("position", F.when(F.col("position") <= 1, F.col("position")))
    )
