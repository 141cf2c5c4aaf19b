"""Exact Jaccard links between word-shingle sets by partitioning the universe of shingles.

Sets are grouped into size bands. For the pairs a band is responsible for, at most H
shingles can differ. The hash range of shingles is cut into segments; if the segments' allowances add
up to more than H, linked sets must agree in some segment up to its allowance. A segment
has allowance 0 (indexed by its content), 1 (also by its content less any one
shingle), or it is skipped: of the segments with allowance 0, a set leaves out the ``spare``
ones whose content most sets have, by counts over all sets. These are empty or filled by common
passages. Linked sets agree in ``spare + 1`` segments; the rarest of them has ``spare`` more
frequent ones beside it in both sets, so both keep it. The
allowances of a band are the cheapest by a cost model over the number of sets in it.

Sets with equal content are first folded into one representative. Sets that meet in an
index entry are compared with the entry's first set. Of an entry whose sets then still lie in several
components, a short one is looked through in its task with counts of shingles per cell of the hash
range: what these counts differ by is no more than what the sets do, so most pairs need no
comparison. A long entry is resolved by differences: with
d(x) the shingles in which x and the entry's first set differ, x and y can only link
if d(x) and d(y) share about half of their shingles or more, so that the rarer half of
d(y) must meet d(x); only such pairs are compared. Sets that differ too much from the first
set to link with those near it go on to a round with another first set, and entries that such rounds
would not part are looked through like short ones, two blocks of bounded size at a time. All
comparisons are exact on 64-bit shingle hashes, and no pair of an entry is passed over.

Null, empty and wordless texts have empty sets and stand alone; a text with fewer
words than a shingle is one shingle. Rows with a null id stand alone with a null component.
Rows that share an id are one node: links of either count for both. Extra columns are
not carried. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.llm.common import freed_shuffles, kept, map_added, slices, text_bytes
from codelineage.llm.components import components
from codelineage.llm.words import U, find_words, hash_words, mix, runs
from codelineage.session import checkpointed

BAND_GROWTH = 1.4
PAIR_COST = 6.0
SHORT_ENTRY = 256
BLOCK_ROWS = 2_048
CELLS = 64
MET_SETS = 200_000
COMMON_SETS, COMMON_SHARE = 0.1, 0.5  # the cost model's picture: a tenth of the sets, half filled by the same passages
SPARES = (0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128)


BAND, LOOSE = U(127), U(128)  # bits of an index entry: its band, and whether its segment has allowance 1


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link from a Jaccard similarity of ``num / den`` on."""

    words: int = 4
    num: int = 85
    den: int = 100
    lower: bool = True


@dataclass(frozen=True)
class Scheme:
    """How sets are indexed for pairs whose larger set has ``low`` to ``high`` shingles."""

    band: int
    low: int
    high: int
    loose: int  # segments with allowance 1
    exact: int  # segments with allowance 0 that stay in the index
    spare: int  # most common segments with allowance 0, skipped

    @property
    def segments(self) -> int:
        return self.loose + self.exact + self.spare


def bands(largest: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= largest:
        high = max(low, math.ceil(low * BAND_GROWTH) - 1)
        out.append((low, high))
        low = high + 1
    return out


def allocate(band: int, low: int, high: int, sets: int, rule: Rule) -> Scheme | None:
    """The cheapest allowances of a band that ``sets`` sets are indexed in; None if only equal sets can link."""
    differ = 2 * high * (rule.den - rule.num) // (rule.den + rule.num)
    if differ == 0:
        return None
    size, best = (low + high) / 2, None
    most = differ // 2 + 1
    for loose in sorted({0, most // 4, most // 2, most}):
        exact = max(0, differ + 1 - 2 * loose)
        for spare in SPARES if exact else (0,):
            segments = loose + exact + spare
            mean = size / segments
            entries = sets * (exact + spare + loose * (1 + mean))
            chance = 0.0
            if exact:
                alike = segments * math.exp(-mean * (1 - COMMON_SHARE))
                term, over = math.exp(-alike), 0.0
                for i in range(int(alike + 12 * math.sqrt(alike + 1)) + spare + 2):
                    over += max(0, i - spare) * term
                    term *= alike / (i + 1)
                chance += (COMMON_SETS * over) ** 2 / (exact + spare)
            chance += loose * (math.exp(-mean) * (1 + mean)) ** 2
            cost = entries + PAIR_COST * chance * sets * sets / 2
            if best is None or cost < best[0]:
                best = cost, Scheme(band, low, high, loose, exact, spare)
    return best[1]


def shingle_sets(column: pa.Array, rule: Rule) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    raw, borders = text_bytes(column)
    starts, ends, first = find_words(raw, borders)
    hashes = hash_words(raw, starts, ends, rule.lower)
    every = runs(hashes, rule.words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= rule.words:
            out.append(np.unique(every[a : b - rule.words + 1]))
        elif b > a:
            out.append(mix(runs(hashes[a:b], b - a), 1000 + b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U else x


def index_keys(shingles: np.ndarray, scheme: Scheme, borders: np.ndarray) -> np.ndarray:
    """Index entries of one set: its segments are runs of the sorted hashes."""
    at = np.r_[np.searchsorted(shingles, borders), len(shingles)]
    values = mix(shingles, 11)
    sums = np.r_[np.zeros(1, U), np.cumsum(values, dtype=U)]
    content, count = sums[at[1:]] - sums[at[:-1]], np.diff(at).astype(U)
    place = mix(np.arange(scheme.segments, dtype=U), 13 + scheme.low)
    keys = mix(content + place * U(3) + count * U(0xE7037ED1A0B428DB), 17)
    a = scheme.loose
    if a:
        inner = slice(0, at[a])
        of = np.repeat(np.arange(a), np.diff(at[: a + 1]))
        fewer = mix(content[of] - values[inner] + place[of] * U(3) + (count[of] - U(1)) * U(0xE7037ED1A0B428DB), 17)
        keys = np.concatenate([(keys[:a] | LOOSE), (fewer | LOOSE), keys[a:] & ~LOOSE])
    else:
        keys = keys & ~LOOSE
    return (keys & ~BAND) | U(scheme.band)


def segment_borders(scheme: Scheme) -> np.ndarray:
    return np.array([i * 2**64 // scheme.segments for i in range(scheme.segments)], U)


SUMMARY = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("fold_a", T.LongType()), T.StructField("fold_b", T.LongType())])


def summarize(docs: DataFrame, rule: Rule) -> DataFrame:
    """Adds the set size and a 128-bit fingerprint of the set."""

    def work(batch):
        sets = shingle_sets(batch.column("text"), rule)
        fold = lambda seed: pa.array(np.array([mix(s, seed).sum(dtype=U) for s in sets], U).view(np.int64), pa.int64())
        return [pa.array([len(s) for s in sets], pa.int64()), fold(21), fold(22)]

    return map_added(docs, "text", SUMMARY, work)


ENTRY = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", T.LongType())])


def index_entries(docs: DataFrame, schemes: list[Scheme], rule: Rule) -> DataFrame:
    """(key, doc) for every set in the schemes of all bands where it may find a partner.

    Sets equal to one the task has met before are left out: they have the same representative.
    """

    def run(batches):
        borders = {s.low: segment_borders(s) for s in schemes}
        met: set[tuple] = set()
        for batch in slices(batches, "text"):
            keys, ids = [], []
            for doc, shingles in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text"), rule)):
                n = len(shingles)
                fold = n, *(int(mix(shingles, seed).sum(dtype=U)) for seed in (21, 22))
                if n == 0 or fold in met:
                    continue
                if len(met) >= MET_SETS:
                    met.clear()
                met.add(fold)
                for s in schemes:
                    if s.high >= n and rule.den * n >= rule.num * s.low:
                        found = index_keys(shingles, s, borders[s.low])
                        keys.append(found)
                        ids.append(np.full(len(found), doc, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(ids))], names=["key", "doc"])

    return docs.mapInArrow(run, ENTRY)


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with both texts, those of one ``a`` together."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b")


def _compared(batches, rule: Rule):
    """(a, b, set of a, set of b) lists, a batch at a time; the set of ``a`` is made once for rows in a row."""
    name, mine = None, None
    for batch in slices(batches, "text_b", 1 << 20):
        out = []
        theirs = shingle_sets(batch.column("text_b"), rule)
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
            text = batch.column("text_a")[i].as_py()
            if (a, text) != name:
                name, mine = (a, text), shingle_sets(pa.array([text], pa.string()), rule)[0]
            out.append((a, b, mine, theirs[i]))
        yield out


def _links(common: int, a: int, b: int, rule: Rule) -> bool:
    return common > 0 and rule.den * common >= rule.num * (a + b - common)


def verify(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets link, compared whole."""

    def run(batches):
        for rows in _compared(batches, rule):
            out = []
            for a, b, mine, other in rows:
                common = 0
                if len(mine) and len(other):
                    at = np.searchsorted(mine, other)
                    common = int((mine[np.minimum(at, len(mine) - 1)] == other).sum())
                if _links(common, len(mine), len(other), rule):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return _with_texts(pairs, texts).mapInArrow(run, PAIR).distinct()


DIFFERENCE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("a", "b", "n_a", "n_b", "set_a", "set_b", "differ")]
    + [T.StructField("far", T.BooleanType()), T.StructField("shingles", T.ArrayType(T.LongType()))]
)


def differences(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """For each pair of sets of ``a`` and ``b`` the number of shingles only one of both has, and these shingles while a
    link of ``b`` with a set near ``a`` is possible: up to three times what may differ in any link of ``b``. ``set_a`` and
    ``set_b`` tell the sets of one id apart."""

    def run(batches):
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.list_(pa.int64())]
        fold = lambda x: int(mix(x, 21).sum(dtype=U).astype(np.int64))
        for rows in _compared(batches, rule):
            out = []
            for a, b, mine, other in rows:
                only = np.setxor1d(mine, other, assume_unique=True)
                common = (len(mine) + len(other) - len(only)) // 2
                close = rule.num * len(only) <= 3 * (rule.den - rule.num) * len(other)
                out.append((a, b, len(mine), len(other), fold(mine), fold(other), len(only), not _links(common, len(mine), len(other), rule), signed(only) if close else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.name for f in DIFFERENCE])

    return _with_texts(pairs, texts).mapInArrow(run, DIFFERENCE)


def meeting_differences(apart: DataFrame, rule: Rule) -> DataFrame:
    """(doc, n_doc, other, n_other) of all pairs that may link among the sets ``b`` compared with one set of ``a``.

    ``apart`` are rows of ``differences`` that carry their shingles, one for each two sets. Two sets near ``a`` are in
    its component already, so one of a pair, x, is far. With at most q (n_x + n_y) shingles in
    a difference of linked sets, and more than q (n_x + n_a) between x and a, the differences of
    x and y share more than half of d(y) + q (n_a - n_y): one of the rarest others of d(y) is
    in d(x). For a pair at hand the number to share is known better, and the first shingle they share
    stands early in both. If that number is not positive, no shared shingle is needed, and y is near a; then
    the y with the largest q n_y - d(y) links with x if any does.
    """
    q = F.lit(float(rule.den - rule.num)) / F.lit(float(rule.den + rule.num))
    first_set, second_set = ["a", "n_a", "set_a"], ["b", "n_b", "set_b"]
    each = apart.select(*first_set, *second_set, "differ", "far", F.explode("shingles").alias("s"))
    each = each.withColumn("held", F.count("*").over(Window.partitionBy(*first_set, "s")))
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy(*first_set, *second_set).orderBy("held", "s")))
    need = F.greatest(F.lit(1.0), F.ceil((F.col("differ") + q * (F.col("n_a") - F.col("n_b"))) / 2))
    rare = each.where((F.col("held") > 1) & (F.col("nth") <= F.col("differ") - need + 1))
    full = each.where("held > 1 and far")
    side = lambda df, x: df.select(*first_set, "s", F.col("b").alias(x), *[F.col(c).alias(f"{n}_{x}") for c, n in (("n_b", "n"), ("differ", "d"), ("nth", "nth"))])
    shared = F.greatest(F.lit(1.0), F.ceil((F.col("d_doc") + F.col("d_other") - q * (F.col("n_doc") + F.col("n_other"))) / 2))
    first = (F.col("nth_doc") <= F.col("d_doc") - shared + 1) & (F.col("nth_other") <= F.col("d_other") - shared + 1)
    sharing = side(rare, "doc").join(side(full, "other"), [*first_set, "s"]).where((F.col("doc") != F.col("other")) & first)
    gain = q * F.col("n_b") - F.col("differ")
    best = apart.where("not far").groupBy(*first_set).agg(F.max(F.struct(gain.alias("gain"), F.col("b").alias("other"), F.col("n_b").alias("n_other"))).alias("y"))
    sure = apart.where("far").join(best, first_set).where(F.col("y.gain") + gain >= -1e-6)
    columns = ["doc", "n_doc", "other", "n_other"]
    return sharing.select(*columns).distinct().unionByName(sure.select(F.col("b").alias("doc"), F.col("n_b").alias("n_doc"), "y.other", "y.n_other"))


def counted(texts: DataFrame, rule: Rule) -> DataFrame:
    """Adds the size ``n`` of each set, and its shingles per cell of the hash range in ``cells`` and ``fine`` cells:
    one byte each, 255 stands for more too. There are a few shingles to a fine cell."""
    added = T.StructType([T.StructField("n", T.LongType()), T.StructField("cells", T.BinaryType()), T.StructField("fine", T.BinaryType())])
    packed = lambda counts: pa.array([c.clip(max=255).astype(np.uint8).tobytes() for c in counts], pa.binary())

    def work(batch):
        fine = []
        for s in shingle_sets(batch.column("text"), rule):
            bits = min(15, max(8, (len(s) // 4).bit_length()))
            fine.append(np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits))
        return [pa.array([int(c.sum()) for c in fine], pa.int64()), packed([c.reshape(CELLS, -1).sum(axis=1) for c in fine]), packed(fine)]

    return map_added(texts, "text", added, work)


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).astype(np.int16).reshape(-1, CELLS)


def least_difference(x: bytes, y: bytes) -> int:
    """What two sets differ by at least, from their counts per fine cell; the finer ones are added up first."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (x, y))
    if a.max() == 255 or b.max() == 255:
        return 0
    cells = min(len(a), len(b))
    return int(np.abs(a.reshape(cells, -1).sum(axis=1) - b.reshape(cells, -1).sum(axis=1)).sum())


def not_apart(pairs: DataFrame, cells: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose counts per cell do not already differ by too much; texts are fetched for these only."""
    of = lambda x: cells.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}"))

    def run(batches):
        for batch in batches:
            both = zip(batch.column("fine_a").to_pylist(), batch.column("fine_b").to_pylist())
            apart = np.array([least_difference(x, y) for x, y in both], np.int64)
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            may = pa.array((rule.den + rule.num) * apart <= (rule.den - rule.num) * total)
            yield batch.select(["a", "b"]).filter(may)

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(run, PAIR)


def likely_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) across components, among rows (key, doc, n_doc, component, cells) of short entries, that may link."""
    q_num, q_den = rule.den - rule.num, rule.den + rule.num
    names = ["key", "doc", "n_doc", "component", "cells"]

    def within(doc, n, component, cells) -> np.ndarray:
        out = []
        for i in range(len(doc) - 1):
            total = n[i] + n[i + 1 :]
            low, high = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
            may = np.flatnonzero((component[i + 1 :] != component[i]) & (rule.den * low >= rule.num * high) & (doc[i + 1 :] != doc[i]))
            if len(may):
                apart = np.abs(cells[i + 1 + may] - cells[i]).sum(axis=1)
                may = may[q_den * apart <= q_num * total[may]] + i + 1
                out.append(np.stack([np.full(len(may), doc[i]), doc[may]], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def run(batches):
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                cells = unpacked(batch.column("cells"))
                new = [batch.column(c).to_numpy() for c in names[:4]] + [cells]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held is None or not len(held[0]):
                continue
            key = held[0]
            borders = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            whole = len(borders) - (2 if batch is not None else 1)  # the last entry may go on in the next batch
            found = [within(*(x[borders[g] : borders[g + 1]] for x in held[1:])) for g in range(whole)]
            held = [x[borders[whole] :] for x in held]
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            if len(pairs):
                pairs = np.unique(np.sort(pairs, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.select(*names).repartition("key").sortWithinPartitions("key").mapInArrow(run, PAIR).distinct()


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of entries (key, rows, doc, ...) with entries of more than ``BLOCK_ROWS`` rows cut into blocks of about that size.

    Any two blocks of an entry, and a block with itself, make an entry of their own, so no task holds more than two
    blocks of a key and every two rows still meet.
    """
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    mine = F.pmod(F.xxhash64("doc", F.lit(41)), blocks)
    dealt = rows.select("*", blocks.alias("blocks"), mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    both = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return dealt.withColumn("key", F.when(F.col("blocks") > 1, both).otherwise(F.col("key"))).drop("blocks", "mine", "other")


def _and_end(batches):
    """The batches, then None."""
    yield from batches
    yield None


def _pairs(rows: DataFrame, x: str, y: str, rule: Rule) -> DataFrame:
    """Distinct pairs (a < b) whose sizes allow a link."""
    small, large = F.least(f"n_{x}", f"n_{y}"), F.greatest(f"n_{x}", f"n_{y}")
    fits = rows.where((F.col(x) != F.col(y)) & (rule.den * small >= rule.num * large))
    return fits.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def one_row_a_set(texts: DataFrame, repeated: DataFrame, rule: Rule) -> DataFrame:
    """(id, text) with one text for each set of the ids in ``repeated``; the rows of other ids as they are."""
    if repeated.isEmpty():
        return texts
    several = summarize(texts.join(repeated, "id", "left_semi"), rule).dropDuplicates(["id", "n_shingles", "fold_a", "fold_b"])
    return texts.join(repeated, "id", "left_anti").unionByName(several.select("id", "text"))


def links(reps: DataFrame, member: DataFrame, repeated: DataFrame, twice: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(node, component) of the representatives (id, n) that link with another one.

    ``member`` has the representatives ``rep`` of each ``id``, ``repeated`` the ids with several rows, ``twice`` those with several sets.
    """
    spark = reps.sparkSession
    largest = reps.agg(F.max("n")).first()[0] or 0
    all_bands = bands(largest)
    lows = F.array(*[F.lit(low).cast("long") for low, _ in all_bands] or [F.lit(1).cast("long")])
    sizes = {
        r["band"]: r["count"]
        for r in reps.groupBy(F.size(F.filter(lows, lambda x: x <= F.col("n"))).alias("band")).count().collect()
    }
    schemes = []
    for i, (low, high) in enumerate(all_bands):
        expected = sizes.get(i + 1, 0) + sizes.get(i, 0) // 2
        scheme = allocate(i, low, high, expected, rule) if expected else None
        if scheme:
            schemes.append(scheme)
    nothing = spark.createDataFrame([], "node long, component long")
    if not schemes:
        return nothing
    entries = index_entries(docs, schemes, rule).withColumn("count", F.count("*").over(Window.partitionBy("key")))
    shared = entries.where("count > 1").withColumns({"band": F.expr("key & 127"), "loose": F.expr("key & 128 = 128")})
    spare = F.element_at(F.create_map(*[F.lit(x) for s in schemes for x in (s.band, s.spare)]), F.col("band").cast("int"))
    if not twice.isEmpty():  # entries of several sets under one id: none is left out
        several = twice.select(F.col("id").alias("doc"), F.lit(True).alias("several"))
        shared = shared.join(several, "doc", "left").withColumn("loose", F.col("loose") | F.coalesce("several", F.lit(False)))
    common = Window.partitionBy("doc", "band", "loose").orderBy(F.desc("count"), "key")
    ranked = shared.withColumn("at", F.row_number().over(common))
    found = ranked.where(F.col("loose") | (F.col("at") > spare)).select("key", "doc")
    found = found.join(member.select(F.col("id").alias("doc"), "rep"), "doc").select("key", F.col("rep").alias("doc")).distinct()
    by_key = Window.partitionBy("key")
    found = found.withColumns({"low": F.min("doc").over(by_key), "high": F.max("doc").over(by_key)}).where("low < high").drop("high")
    sized = reps.select(F.col("id").alias("doc"), F.col("n").alias("n_doc"))
    met = kept(found.join(sized, "doc"))
    texts = docs.join(met.select(F.col("doc").alias("id")).distinct(), "id", "left_semi")
    partners = kept(one_row_a_set(texts, repeated, rule).transform(counted, rule), 4)
    cells = partners.select(F.col("id").alias("doc"), "n", "cells", "fine").distinct()
    low = sized.select(F.col("doc").alias("low"), F.col("n_doc").alias("n_low"))
    tested = kept(_pairs(met.join(low, "low"), "doc", "low", rule))
    edges = kept(verify(not_apart(tested, cells, rule).distinct(), partners, rule))
    joined, open_, short = components(edges), met.select("key", "doc", "n_doc"), F.col("rows") <= SHORT_ENTRY
    while True:
        label = joined.select(F.col("node").alias("doc"), "component")
        placed = open_.join(label, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        entries = placed.groupBy("key").agg(F.count("*").alias("rows"), F.min("doc").alias("low"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        rest = kept(placed.join(entries.where("c0 < c1").select("key", "rows", "low"), "key"))
        new = likely_pairs(in_blocks(rest.where(short).join(cells.select("doc", "cells"), "doc")), rule)
        long = rest.where(~short)
        more = not long.isEmpty()
        if more:
            apart = checkpointed(differences(long.select(F.col("low").alias("a"), F.col("doc").alias("b")).distinct(), partners, rule))
            new = new.unionByName(_pairs(meeting_differences(apart.where("shingles is not null"), rule), "doc", "other", rule)).distinct()
            near = apart.where("a <> b and not far").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            edges = edges.unionByName(near)
        new = kept(new.join(tested, ["a", "b"], "left_anti"))
        edges = kept(edges.unionByName(verify(not_apart(new, cells, rule).distinct(), partners, rule)))
        joined = components(edges)
        if not more:
            return joined
        tested = tested.unionByName(new)
        # a set so far from the entry's first one that it cannot link with those whose differences were listed
        away = apart.where(F.lit(rule.den) * F.col("differ") >= 2 * (rule.den - rule.num) * F.col("n_b"))
        open_ = kept(
            long.select("key", "doc", "n_doc", "low").join(away.select(F.col("a").alias("low"), F.col("b").alias("doc")), ["low", "doc"], "left_semi").select("key", "doc", "n_doc")
        )
        if 2 * open_.count() > long.count():  # sets with little in common: no round would part them, so look through them by blocks
            short = F.lit(True)


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    with freed_shuffles(df.sparkSession):
        return _near_copies(df, key, text, rule)


def _near_copies(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets = checkpointed(summarize(docs, rule).select("id", F.col("n_shingles").alias("n"), "fold_a", "fold_b"))
    named = sets.where("id is not null and n > 0")
    folds = ["n", "fold_a", "fold_b"]
    first = named.groupBy(*folds).agg(F.min("id").alias("rep"))
    member = named.join(first, folds).select("id", "rep").distinct()
    twice = named.select("id", *folds).distinct().groupBy("id").count().where("count > 1").select("id")
    repeated = named.groupBy("id").count().where("count > 1").select("id")
    joined = links(first.select(F.col("rep").alias("id"), "n"), member, repeated, twice, docs.where("id is not null"), rule)
    # an id with several texts has several representatives: these are one node
    same = member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    shared = same.join(member.groupBy("id").count().where("count > 1").select(F.col("id").alias("a")), "a", "left_semi")
    if not shared.isEmpty():
        joined = components(shared.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    label = joined.select(F.col("node").alias("rep"), "component")
    known = member.join(label, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    return sets.join(known, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
