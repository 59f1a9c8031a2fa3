"""Line dedup by an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import forget, stored

# Lines are alike from this Jaccard similarity of their word sets on: 4 / 5.
# The filters below follow from it in whole numbers.
SIMILAR_OF, SIMILAR = 5, 4
# Sets of fewer words are alike only when equal, and meet no other set.
JOINED_WORDS = 4
# Words fall into this many slots, whose counts order them by rarity. The order
# decides how fast the join is, never what it finds.
SLOT_BITS = 18
# A table of places has 2^(MARK_BITS - 1) to 2^MARK_BITS bits for each place.
MARK_BITS = 5
# Rarest words by which a line meets the first line that has them.
HUB_WORDS = 6

WHITE, OTHER_WHITE = r"[\x20\x09-\x0D]+", r"[\x09-\x0D]"
# What stands for a word set: a hash of it, the parity of its words over 128
# slots, and its size. With 64 slots, pairs that are not alike pass in numbers
# that grow with the square of the input.
KEYS = ["key", "even", "odd", "n"]


def least_overlap(a: Column, b: Column) -> Column:
    """Words that sets of sizes a and b have to share: ceil(4 / 9 * (a + b))."""
    return F.floor((SIMILAR * (a + b) + SIMILAR + SIMILAR_OF - 1) / (SIMILAR + SIMILAR_OF)).cast("long")


def prefix_length(n: Column) -> Column:
    """n - ceil(4 / 5 * n) + 1: similar sets share a word of these rarest ones."""
    return (n - F.floor((SIMILAR * n + SIMILAR_OF - 1) / SIMILAR_OF) + 1).cast("int")


def joined_prefix(n: Column) -> Column:
    return F.when(n >= JOINED_WORDS, prefix_length(n)).otherwise(0)


def may_be_alike(x_n: Column, y_n: Column, x: str, y: str) -> Column:
    """A word of one set only flips at most one bit of the parities' difference.

    ``x`` and ``y`` are column prefixes of the two sets.
    """
    flipped = sum(F.bit_count(F.col(f"{x}{half}").bitwiseXOR(F.col(f"{y}{half}"))) for half in ("even", "odd"))
    return flipped <= x_n + y_n - 2 * least_overlap(x_n, y_n)


def words_of(text: Column) -> Column:
    """Lower-cased words; plain blanks are cut without a pattern."""
    lowered = F.lower(text)
    cut = F.when(lowered.rlike(OTHER_WHITE), F.split(lowered, WHITE)).otherwise(F.split(lowered, " "))
    return F.array_remove(cut, "")


def word_hashes(line: Column) -> Column:
    """64-bit hashes of the different words of a line, lower-cased."""
    return F.array_distinct(F.transform(words_of(line), lambda w: F.xxhash64(w)))


def slot_table(slots: DataFrame, value: Column) -> bytes:
    """One byte per slot, from rows (slot): the largest ``value``, else zero.

    Its size is fixed; the slots are brought into text row by row on executors.
    """
    half = SLOT_BITS // 2
    every = slots.sparkSession.range(1 << SLOT_BITS).select(F.col("id").alias("slot"), F.lit(0).alias("value"))
    rows = (
        slots.select("slot", value.cast("int").alias("value"))
        .unionByName(every)
        .groupBy("slot")
        .agg(F.max("value").alias("value"))
        .groupBy(F.shiftright("slot", half).alias("row"))
        .agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("cells"))
        .select("row", F.array_join(F.transform("cells", lambda c: F.char(c["value"] + 1)), "").alias("text"))
        .orderBy("row")
        .collect()
    )
    return bytes(code - 1 for code in "".join(r.text for r in rows).encode("ascii"))


def slot_of(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - SLOT_BITS)


def in_table(table: bytes, slot: Column) -> Column:
    """The slot's byte; the array is made of the text once, when the query is planned."""
    cells = F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")
    return F.get(cells, slot.cast("int"))


def rarity_table(docs: DataFrame) -> bytes:
    """Class of every slot by how often its words occur in all texts.

    Four classes for each doubling of the count; class 1 is a single occurrence.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), WHITE)).alias("word")).where("word <> ''")
    counts = words.groupBy(slot_of(F.xxhash64("word")).alias("slot")).count()
    return slot_table(counts, F.least(F.lit(120), F.floor(4 * F.log2("count")) + 1))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, line_no, line); ``mark`` is a hash of the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_marks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, line_no, KEYS, prefix) of lines with words.

    Words are ordered by rarity class and then hash. ``prefix`` has the rarest
    words as 32-bit hashes, null for words that occur nowhere else; it is empty
    for sets of fewer than JOINED_WORDS words.
    """
    rarity = rarity_table(docs)
    low = (1 << 56) - 1

    def ordered(h: Column) -> Column:
        return F.shiftleft(in_table(rarity, slot_of(h)).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit(low)))

    def short(word: Column) -> Column:
        return F.when(F.shiftright(word, 56) > 1, F.shiftright(F.shiftleft(word, 32), 32).cast("int"))

    def parity(words: Column, half: int) -> Column:
        def flip(bits: Column, word: Column) -> Column:
            mine = F.shiftright(word, 6).bitwiseAND(F.lit(1)) == half
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)).cast("int"))
            return F.when(mine, bits.bitwiseXOR(bit)).otherwise(bits)

        return F.aggregate(words, F.lit(0).cast("long"), flip)

    def describe(words: Column) -> Column:
        return F.struct(
            F.xxhash64(words).alias("key"),
            parity(words, 0).alias("even"),
            parity(words, 1).alias("odd"),
            F.size(words).cast("long").alias("n"),
            F.transform(F.slice(words, F.lit(1), joined_prefix(F.size(words))), short).alias("prefix"),
        )

    words = F.sort_array(F.transform(word_hashes(F.col("line")), ordered))
    # Bound in a one-element array, the words are made once for all columns.
    return (
        numbered_lines(docs)
        .select("doc_id", "mark", "line_no", F.inline(F.transform(F.array(words), describe)))
        .where("n > 0")
    )


def word_sets(marks: DataFrame) -> DataFrame:
    """One row per word set: KEYS, prefix, first, copies.

    ``first`` is the place of its first line: by doc_id, null last, then mark
    and line number.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "line_no")
    return marks.groupBy(*KEYS, "prefix").agg(F.min(place).alias("first"), F.count("*").alias("copies"))


def narrow_rows(sets: DataFrame, words: Column, is_open: Column) -> DataFrame:
    """Rows (word, key, even, odd, order, shape), one per word of ``words``.

    ``order`` is the document of the set's first line, null last; ``shape``
    holds size, position of the word, and whether the set is open.
    """
    last = F.lit((1 << 63) - 1)
    shape = F.shiftleft("n", 32).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 1)).bitwiseOR(F.col("open").cast("long"))
    return (
        sets.select(*KEYS, F.coalesce("first.doc_id", last).alias("order"), is_open.alias("open"), F.posexplode(words).alias("at", "word"))
        .where("word IS NOT NULL")
        .select("word", "key", "even", "odd", "order", shape.alias("shape"))
    )


def size_in(shape: Column) -> Column:
    return F.shiftright(shape, 32)


def place_in(shape: Column) -> Column:
    return F.shiftright(shape, 1).bitwiseAND(F.lit((1 << 31) - 1))


def open_in(shape: Column) -> Column:
    return shape.bitwiseAND(F.lit(1)) == 1


def alike_in_size(x_n: Column, y_n: Column) -> Column:
    return SIMILAR_OF * F.least(x_n, y_n) >= SIMILAR * F.greatest(x_n, y_n)


def hub_pairs(sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of each set with the first set of its rare words.

    In a dense group of near copies nearly every member is near the first one;
    settling those here keeps the join below from listing the group's pairs.
    Rows are dealt by word once; first sets and join use that dealing.
    """
    rare = F.slice(F.array_compact("prefix"), 1, HUB_WORDS)
    rows = narrow_rows(sets, rare, F.lit(True)).repartition("word")
    first = F.min(F.struct("order", "key", "even", "odd", "shape"))
    hubs = rows.groupBy("word").agg(first.alias("hub"), F.count("*").alias("size")).where("size > 1")
    hubs = hubs.select("word", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("key", "even", "odd", "shape")])
    n, hub_n = size_in(F.col("shape")), size_in(F.col("hub_shape"))
    return (
        rows.join(hubs, "word")
        .where((F.col("key") != F.col("hub_key")) & alike_in_size(n, hub_n) & may_be_alike(n, hub_n, "", "hub_"))
        .select(F.col("hub_key").alias("a"), F.col("key").alias("b"))
        .distinct()
    )


def prefix_pairs(sets: DataFrame, settled: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of which the later set is not settled.

    Sets meet on a word of both prefixes. Length, position and parity filters
    are part of the join, so pairs that cannot be similar are never put out.
    """
    marked = sets.join(settled.withColumn("settled", F.lit(True)), KEYS, "left")
    rows = narrow_rows(marked, F.col("prefix"), F.col("settled").isNull())
    x, y = rows.alias("x"), rows.alias("y")
    x_shape, y_shape = F.col("x.shape"), F.col("y.shape")
    x_n, y_n = size_in(x_shape), size_in(y_shape)
    shared = 1 + F.least(x_n - place_in(x_shape) - 1, y_n - place_in(y_shape) - 1)
    # Two sets of one document may be in either order.
    useful = (open_in(x_shape) & (F.col("x.order") >= F.col("y.order"))) | (
        open_in(y_shape) & (F.col("y.order") >= F.col("x.order"))
    )
    fits = (
        (F.col("x.word") == F.col("y.word"))
        & (y_n <= x_n)
        & alike_in_size(x_n, y_n)
        & ((y_n < x_n) | (F.col("y.key") < F.col("x.key")))
        & useful
        & may_be_alike(x_n, y_n, "x.", "y.")
        & (shared >= least_overlap(x_n, y_n))
    )
    return x.join(y, fits).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def marked_places(places: DataFrame, bits: int) -> DataFrame:
    """Rows (bucket, marks): a bit map of 2^bits places, from rows (hash)."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    # Dealt by bucket first, a map is made once, not in part by every task.
    return (
        places.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
        .repartition("bucket")
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("marks"))
    )


def at_marked_places(lines: DataFrame, places: DataFrame) -> DataFrame:
    """The lines whose ``hash`` falls on a place that a hash of ``places`` marks.

    There are 16 to 32 bits for each hash, whatever their number, so the same
    small share of other lines comes along at every size of the input.
    """
    bits = max(MARK_BITS, MARK_BITS - 1 + places.count().bit_length())
    place = F.shiftrightunsigned("hash", 64 - bits)
    at = F.bitmap_bit_position(place)
    byte = F.ascii(F.decode(F.substring(F.col("marks"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    is_marked = F.call_function("getbit", byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    # Two to four bytes for each place.
    table = F.broadcast(marked_places(places, bits))
    return lines.join(table, (F.bitmap_bucket_number(place) == F.col("bucket")) & is_marked, "left_semi").drop("hash")


def later_of_similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Verify pairs by their whole word sets; KEYS of the later ones, stored.

    The words are read from the first line of each set again. ``marked_places``
    keeps most other lines from being shuffled; the join decides. It is broadcast:
    as a literal, every plan that the driver prints and keeps while the joins below
    adapt would hold it in hexadecimal digits, several times over.
    """
    pairs = stored(pairs, "pairs")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = stored(sets.select(*KEYS, "first").join(keys, "key"), "wanted")
    places = wanted.select(F.xxhash64("first.doc_id", "first.mark", "first.line_no").alias("hash"))
    lines = (
        at_marked_places(numbered_lines(docs).withColumn("hash", F.xxhash64("doc_id", "mark", "line_no")), places)
        .select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "line_no").alias("first"), "line")
    )
    hash_of = lambda c: F.xxhash64(c)
    known = wanted.withColumn("place", hash_of("first")).join(
        lines.withColumn("place", hash_of("first")).withColumnRenamed("first", "at"), "place"
    )
    known = known.where(F.col("first").eqNullSafe(F.col("at"))).select(*KEYS, "first", word_hashes(F.col("line")).alias("words"))
    # Repeated rows have the same lines.
    known = stored(known.dropDuplicates([*KEYS]), "known")

    def side(name: str) -> DataFrame:
        return known.select(F.col("key").alias(name), F.struct(*KEYS, "first", "words").alias(f"{name}_set"))

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.size("a_set.words") + F.size("b_set.words")
    alike = (SIMILAR + SIMILAR_OF) * F.size(F.array_intersect("a_set.words", "b_set.words")) >= SIMILAR * sizes
    later = F.when(F.col("a_set.first") > F.col("b_set.first"), F.col("a_set")).otherwise(F.col("b_set"))
    found = met.where(alike).select(later.alias("later")).select(*[f"later.{k}" for k in KEYS]).distinct()
    found = stored(found, "later")
    forget(pairs, wanted, known)
    return found


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, removed), stored: numbers of the lines to take out, if any.

    A line goes when an earlier line (by doc_id, then line number) has a
    Jaccard similarity of 4 / 5 or more of word sets, whether or not that line
    goes itself. Case does not count, nor do order and repetition of words.
    Lines without words stay. Rows that repeat doc_id and text count as one
    document and lose the same lines; rows without a doc_id come last; null
    texts have no lines.
    """
    plain = docs.select("doc_id", "text")
    marks = stored(line_marks(plain), "marks")
    sets = stored(word_sets(marks), "sets")
    settled = later_of_similar(hub_pairs(sets), sets, plain)
    rest = later_of_similar(prefix_pairs(sets, settled), sets, plain)
    later = settled.unionByName(rest).distinct().withColumn("later", F.lit(True))
    touched = (
        sets.select(*KEYS, "first", "copies")
        .join(later, KEYS, "left")
        .where("later OR copies > 1")
        .select(*KEYS, "first", F.coalesce("later", F.lit(False)).alias("later"))
    )
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "line_no")
    removed = (
        marks.drop("prefix")
        .join(touched, KEYS)
        .where(F.col("later") | ~place.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "mark")
        .agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    )
    removed = stored(removed, "removed")
    forget(marks, sets, settled, rest)
    return removed


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that ``repeated_lines`` names.

    All rows and columns stay; a text that loses all lines becomes empty. A
    column n_chars follows the new text.
    """
    removed = repeated_lines(docs).select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("removed").alias("_removed")
    )
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_text"))
    joined = rows.join(removed, (F.col("_text") == F.col("_mark")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left")
    kept = F.filter(F.split("_row.text", "\n"), lambda line, i: ~F.array_contains("_removed", i))
    text = F.when(F.col("_removed").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    columns = []
    for name, kind in docs.dtypes:
        old = F.col(f"_row.`{name}`")
        if name == "text":
            columns.append(text.alias(name))
        elif name == "n_chars":
            columns.append(F.when(F.col("_removed").isNull(), old).otherwise(F.length(text)).cast(kind).alias(name))
        else:
            columns.append(old.alias(name))
    return joined.select(*columns)


def line_report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_lines, n_removed, removed), one per document row.

    ``removed`` lists line numbers from 0, joined by commas.
    """
    found = repeated_lines(docs).select(
        F.col("doc_id").alias("id"), F.col("mark").alias("text_mark"), "removed"
    )
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.when(F.col("text").isNotNull(), lines).otherwise(0).alias("n_lines"))
    return rows.join(found, (F.col("mark") == F.col("text_mark")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"),
    )
