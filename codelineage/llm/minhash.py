"""One-permutation MinHash fingerprints, packed to a few bits a bin.

Every shingle of ``Sketch.words`` words (the whole sequence, if a text has fewer) is hashed
once. The upper bits of the hash name a bin, the smallest hash of each bin counts, and its low
bits are stored. Empty bins are filled by optimal densification: each bin has its own
fixed order in which it tries the other bins, and takes the value of the first that holds one.
The order is built by rounds of fixed permutations (round t asks the bin that permutation t
names, as filled after round t - 1), so few rounds fill any text. ``likeness`` counts equal
bins and takes off those that agree by chance (2 ** -bits).

Null texts count as empty; without words the fingerprint is the empty string, which
is like itself (1) and unlike any other (0). Equal texts have equal fingerprints. Very long
texts are taken whole, one row in memory. Repeated rows are kept. An empty table gives no rows.
Columns named like a result are replaced by it; others are carried along by ``fingerprint``.
``edited_pairs`` looks at ``doc_id`` and ``text`` only; null ids count as one id before all others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelineage.llm.common import let, word_array
from codelineage.llm.words import mix
from codelineage.session import checkpointed


@dataclass(frozen=True)
class Sketch:
    """``bins`` is a power of two, ``bits`` is 1, 2 or 4; both and the seed must agree for fingerprints to be compared."""

    words: int = 5
    bins: int = 256
    bits: int = 4
    seed: int = 0

    def __post_init__(self):
        if self.bits not in (1, 2, 4) or self.bins < 64 or self.bins & (self.bins - 1):
            raise ValueError("bits must be 1, 2 or 4, bins a power of two from 64")

    @property
    def shift(self) -> int:
        return 65 - self.bins.bit_length()


@lru_cache(maxsize=8)
def rounds(bins: int, seed: int) -> tuple[tuple[int, ...], ...]:
    """Permutations of the bins, so many that one filled bin, whichever it is, fills all."""
    filled, out = np.eye(bins, dtype=bool), []
    while not filled.all():
        order = np.argsort(mix(np.arange(bins, dtype=np.uint64), 1000 * (seed + 1) + len(out)), kind="stable")
        filled |= filled[:, order]
        out.append(tuple(int(x) for x in order))
    return tuple(out)


def _hashes(text: Column, sketch: Sketch) -> Column:
    def each(words: Column) -> Column:
        n = F.size(words)
        slide = F.transform(F.sequence(F.lit(1), n - (sketch.words - 1)), lambda i: F.xxhash64(F.slice(words, i, sketch.words)))
        return F.when(n >= sketch.words, slide).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return let(word_array(text), each)


def _bins(hashes: Column, sketch: Sketch) -> Column:
    """The low bits of the smallest hash of every bin in order, -1 for empty bins.

    Each bin's largest possible hash is added first, so that after sorting every bin
    is there and begins with its smallest.
    """
    rest = (1 << sketch.shift) - 1
    tops = F.expr(f"transform(sequence({-sketch.bins // 2}, {sketch.bins // 2 - 1}), b -> shiftleft(cast(b as bigint), {sketch.shift}) | {rest}L)")
    bin_of = lambda h: F.shiftright(h, sketch.shift)

    def smallest(rows: Column) -> Column:
        return F.filter(rows, lambda h, i: (i == 0) | (bin_of(F.get(rows, i - 1)) != bin_of(h)))

    low = lambda h: F.when(h.bitwiseAND(F.lit(rest)) == rest, -1).otherwise(h.bitwiseAND(F.lit((1 << sketch.bits) - 1)).cast("int"))
    return F.transform(let(F.sort_array(F.concat(hashes, tops)), smallest), low)


def _densified(bins: Column, sketch: Sketch) -> Column:
    table = ", ".join("array(" + ", ".join(map(str, order)) + ")" for order in rounds(sketch.bins, sketch.seed))
    step = lambda g, order: F.when(F.array_min(g) >= 0, g).otherwise(F.zip_with(g, order, lambda v, j: F.when(v >= 0, v).otherwise(F.get(g, j))))
    return F.aggregate(F.expr(f"array({table})"), bins, step)


def _packed(values: Column, sketch: Sketch) -> Column:
    """Hexadecimal digits, each of 4 / bits bins, the first bin lowest."""
    each = 4 // sketch.bits

    def digit(i: Column) -> Column:
        total = F.get(values, i * each)
        for r in range(1, each):
            total = total + F.shiftleft(F.get(values, i * each + r), r * sketch.bits)
        return F.substr(F.lit("0123456789abcdef"), total + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(sketch.bins // each - 1)), digit), "")


def fingerprint_of(text: Column, sketch: Sketch = Sketch()) -> Column:
    """The fingerprint of a text as ``bins * bits / 4`` hexadecimal digits, or the empty string."""

    def from_hashes(hashes: Column) -> Column:
        dense = _densified(_bins(hashes, sketch), sketch)
        return F.when(F.size(hashes) == 0, F.lit("")).otherwise(let(dense, lambda values: _packed(values, sketch)))

    return let(_hashes(text, sketch), from_hashes)


def fingerprint(df: DataFrame, text: str = "text", sketch: Sketch = Sketch(), name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of every text."""
    return df.withColumn(name, fingerprint_of(F.col(text), sketch))


def likeness(a: Column, b: Column, sketch: Sketch = Sketch()) -> Column:
    """Estimated Jaccard similarity of the shingles behind two fingerprints, 0 to 1."""
    differ = F.lit(0)
    ones = int(("0" * (sketch.bits - 1) + "1") * (64 // sketch.bits), 2)
    ones = ones - (1 << 64) if ones >> 63 else ones
    long_at = lambda f, i: F.conv(F.substr(f, F.lit(16 * i + 1), F.lit(16)), 16, -10).cast("long")
    for i in range(sketch.bins * sketch.bits // 64):
        x = long_at(a, i).bitwiseXOR(long_at(b, i))
        any_bit = x
        for s in range(1, sketch.bits):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(ones)))
    chance = 2.0**-sketch.bits
    share = F.greatest(F.lit(0.0), (1 - differ / sketch.bins - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(share)


def following(ids: DataFrame, key: str) -> DataFrame:
    """The distinct rows of ``ids`` with ``next_id``, the key that follows in ascending order (null first, the last is followed by the first).

    The keys are sorted by ranges into the shared folder; each part is then looked through on its
    own. The driver holds the first key of each part, one value a partition.
    """
    up = F.col(key).asc_nulls_first()
    parts = checkpointed(ids.orderBy(up)).withColumn("_part", F.spark_partition_id())
    first = parts.groupBy("_part").agg(F.min(F.struct(F.col(key).isNotNull(), F.col(key).alias("id")))["id"].alias("id"))
    heads = sorted(first.collect(), key=lambda r: r["_part"])
    kind = ids.schema[key].dataType.simpleString()
    after = [(r["_part"], heads[(i + 1) % len(heads)]["id"]) for i, r in enumerate(heads)]
    order = Window.partitionBy("_part").orderBy(up)
    border = ids.sparkSession.createDataFrame(after, f"_part int, _after {kind}")
    own = parts.withColumns({"_next": F.lead(key).over(order), "_last": F.lead(F.lit(1)).over(order).isNull()})
    joined = own.join(F.broadcast(border), "_part", "left")  # one row a partition
    return joined.withColumn("next_id", F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next"))).drop("_part", "_next", "_last", "_after")


def edited_pairs(df: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text ends in the beginning of the next document by ascending id instead of its own last
    quarter. Of several rows with the next id that with the smallest hash of its text counts. Texts are
    dealt by their id once; only the beginnings that are needed, with fingerprints, move again.
    """
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quarter = lambda text: F.floor(F.length(text) / 4).cast("int")
    pairs = following(rows.groupBy("doc_id").agg(F.max(quarter(F.col("text"))).alias("take")), "doc_id")
    own = rows.withColumn("fingerprint", fingerprint_of(F.col("text"), sketch))
    asked = pairs.select(F.col("doc_id").alias("prev_id"), "next_id", "take")
    head = F.struct(F.xxhash64("text").alias("nth"), F.substr("text", F.lit(1), F.col("take")).alias("text"), "fingerprint")
    heads = own.join(asked, F.col("doc_id").eqNullSafe(F.col("next_id"))).select("prev_id", head.alias("head")).groupBy("prev_id").agg(F.min("head").alias("head"))
    both = own.join(heads, F.col("doc_id").eqNullSafe(F.col("prev_id")))
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - quarter(F.col("text"))), F.substr(F.col("head.text"), F.lit(1), quarter(F.col("text"))))
    done = both.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", F.col("head.fingerprint").alias("next_fingerprint"), edited.alias("edited"))
    done = done.withColumn("edited_fingerprint", fingerprint_of(F.col("edited"), sketch))
    return done.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), sketch).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), sketch).alias("near_next"),
    )
