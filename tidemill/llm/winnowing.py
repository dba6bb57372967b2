"""Document fingerprints by winnowing, in built-in functions only.

A text's units are hashed, every k neighbours give one k-gram hash, and of every w neighbouring k-grams the
smallest hash is chosen, the rightmost of equal ones. Any run of w + k - 1 units that two texts share
therefore puts at least one common hash into both fingerprints; positions (the number of the k-gram's first
unit) are kept.

Units are words (the pieces between runs of white space); a word of more than LONG_WORD code points, as
texts without blanks have, is as many units as it has code points. A run of (w + k) * (LONG_WORD + 1) code
points therefore holds w + k - 1 whole units. Comparisons of texts of up to SHORT_TEXT code points take the
k-grams of their code points as well, so that w + k - 1 common code points are enough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import let, literal_rows

K, W = 5, 8
LONG_WORD, SHORT_TEXT = 16, 512
#: A chosen k-gram is one long: 39 bits of hash above 24 bits that fall as the position rises.
POSITION_BITS = 24
_POSITIONS = (1 << POSITION_BITS) - 1
_HASH_MASK = (1 << 39) - 1


def units(text: Column) -> Column:
    """Hashes of the words of a text, and of the code points of long words."""
    words = F.split(text, r"\s+")
    cut = F.flatten(F.transform(words, lambda x: F.when(F.char_length(x) > LONG_WORD, F.split(x, "")).otherwise(F.array(x))))
    return F.transform(cut, lambda x: F.xxhash64(x))


def code_points(text: Column) -> Column:
    """Hashes of the code points of a text, other ones than those of words of one letter."""
    return F.transform(F.split(text, ""), lambda x: F.xxhash64(x, F.lit("code point")))


def chosen_grams(text: Column, k: int = K, w: int = W, of: Callable[[Column], Column] = units) -> Column:
    """The chosen k-grams of a text as packed longs, in the order of their positions.

    A text of fewer than k units has one k-gram (all its units); one of fewer than w k-grams has one
    window (all its k-grams). Ties across a multiple of 2**24 units go to the left of it. w is a power of 2.
    """

    def grams(h: Column) -> Column:
        def gram(i: Column) -> Column:
            mixed = F.xxhash64(*[F.get(h, i + j) for j in range(k)])
            at = F.lit(_POSITIONS) - i.cast("long").bitwiseAND(F.lit(_POSITIONS))
            return F.shiftleft(mixed.bitwiseAND(F.lit(_HASH_MASK)), POSITION_BITS).bitwiseOR(at)

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), gram)

    # the smallest of 2, 4, ... w neighbours by doubling; past the end get() is null, which least() skips
    def minima(g: Column, step: int = 1) -> Column:
        if step == w:
            return g
        nearer = F.transform(g, lambda x, i: F.least(x, F.get(g, i + step)))
        return let(nearer, lambda m: minima(m, step * 2))

    def windows(g: Column) -> Column:
        return F.array_distinct(F.slice(minima(g), F.lit(1), F.greatest(F.size(g) - (w - 1), F.lit(1))))

    return let(let(of(F.coalesce(text, F.lit(""))), grams), windows)


def hashes(chosen: Column) -> Column:
    """The distinct hashes of chosen k-grams."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, POSITION_BITS)))


def compared_hashes(text: Column, k: int = K, w: int = W) -> Column:
    """The distinct hashes by which texts are compared: of units, and of code points where the text is short."""
    whole = hashes(chosen_grams(text, k, w))
    both = F.array_union(whole, hashes(chosen_grams(text, k, w, code_points)))
    return F.when(F.char_length(text) <= SHORT_TEXT, both).otherwise(whole)


def positions(chosen: Column) -> Column:
    """Their positions (modulo 2**24)."""
    return F.transform(chosen, lambda x: F.lit(_POSITIONS) - x.bitwiseAND(F.lit(_POSITIONS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two hash sets, neither of which is empty."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: n / (F.size(a) + F.size(b) - n))


def digest(hash_set: Column) -> Column:
    """A short name for a fingerprint: SHA-256 of its hashes."""
    return F.sha2(F.array_join(hash_set.cast("array<string>"), ","), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """One row per row of docs: id, n_chars, fingerprint (array of hash and position).

    Null counts as empty; an empty text has the fingerprint of one empty word. Repeated rows stay.
    """
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.select("id", F.char_length("text").alias("n_chars"), chosen_grams(F.col("text"), k, w).alias("c"))
    pairs = F.transform(
        F.col("c"),
        lambda x: F.struct(
            F.shiftright(x, POSITION_BITS).alias("hash"),
            (F.lit(_POSITIONS) - x.bitwiseAND(F.lit(_POSITIONS))).alias("position"),
        ),
    )
    return out.select(F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), pairs.alias("fingerprint"))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (id, text, hashes), with the text and hashes of the next document by id.

    The ids are cut into ranges at percentiles. Each range is one group of a window; the first document of
    the following range (after the last: of the first) joins it as a guest, so that no window spans the
    table. Nulls come before all ids; rows with equal ids follow each other by text.
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], ranges * 20)).first()[0] or []
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("id")))
    placed = docs.withColumn("place", F.when(F.col("id").isNull() | (F.lit(len(cuts)) == 0), 0).otherwise(place))
    # one row for each range: its number is the parameter's
    first = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", F.xxhash64("text").alias("h")))
    found = sorted(placed.groupBy("place").agg(first.alias("f")).collect(), key=lambda r: r["place"])
    heads = [(r["f"]["id"], found[i - 1]["place"]) for i, r in enumerate(found)]
    guests = literal_rows(spark, heads, ["head_id", "guest_place"], ["bigint", "int"])
    placed = placed.join(F.broadcast(guests), F.col("id").eqNullSafe(F.col("head_id")), "left")
    seats = F.array(F.struct(F.col("place").alias("place"), F.lit(False).alias("guest")))
    with_guest = F.array(
        F.struct(F.col("place").alias("place"), F.lit(False).alias("guest")),
        F.struct(F.col("guest_place").alias("place"), F.lit(True).alias("guest")),
    )
    seated = placed.select(
        "id", "text", "hashes", F.explode(F.when(F.col("guest_place").isNull(), seats).otherwise(with_guest)).alias("seat")
    )
    from pyspark.sql import Window

    order = Window.partitionBy("seat.place").orderBy("seat.guest", F.col("id").asc_nulls_first(), "text")
    following = F.lead(F.struct("text", "hashes")).over(order)
    return (
        seated.withColumn("next", following)
        .where(~F.col("seat.guest"))
        .select("id", "text", "hashes", F.col("next.text").alias("next_text"), F.col("next.hashes").alias("next_hashes"))
    )


def compare_with_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W, ranges: int | None = None
) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and their likeness.

    The edited text replaces the last floor(n_chars / 4) code points by the first as many (or all) of the
    next document's text. Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_chosen. Texts of 16 code points or more keep a hash through the edit. Null texts count as empty; one document alone is its own next.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ready = plain.withColumn("hashes", compared_hashes(F.col("text"), k, w))
    both = with_next(ready, ranges)
    both = both.withColumn("n_chars", F.char_length("text"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("next_text", F.lit(1), cut)
    )
    both = both.withColumn("edited", edited)
    both = both.select(
        "id", "n_chars", "hashes", "next_hashes", F.sha2("edited", 256).alias("edited_sha256"),
        compared_hashes(F.col("edited"), k, w).alias("edited_hashes"),
    )
    return both.select(
        F.col("id").alias(id_col),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        digest(F.col("hashes")).alias("fingerprint"),
        digest(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        F.size("hashes").alias("n_chosen"),
    )
