"""Toxicity scores from gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learnt from labelled texts by their log odds.
Features are densities of lexicon hits, their nearness to second-person words, and
rates of capitals, punctuation and disguised letters. The fit uses at most
``FIT_ROWS`` labelled ids, the first in hash order, in three parts: for the lexicon, the trees
and the calibration, so that no part sees what an earlier one has fitted. Their texts stay
in Spark: words are counted and features taken there, and the driver gets at most
``LEXICON_ENTRIES`` counts per kind of entry and a row of features per id, whatever the lengths of the
texts. Scoring looks at every whole text.

Null and empty texts have no words and get the score of that. Equal texts get equal scores.
Without labels of both kinds the score is a constant. An id with several labels is toxic
if one of them is; an id with several texts is fitted by the first in order of their hashes, and
all are scored. An empty table gives no rows. Columns named like an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.llm.common import list_array, map_added, slices, text_bytes
from codelineage.llm.words import U, find_words, hash_words
from codelineage.session import checkpointed

FIT_ROWS = 8_000
LEXICON_ENTRIES = 3_000
LEAST_WORD, LEAST_START, LEAST_ODDS = 4, 6, 2.0
LEAST_ROWS, LEAST_OF_KIND = 50, 10
PREFIXES = (4, 5, 6)
MARKS = "!\"#%&'()+,-./:;<=>?[\\]^_`{|}~"
NEAR = 5
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32

# Digits and signs written for letters, and second-person words.
DISGUISE = ("013457@$*", "oieastasu")
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "usted", "ustedes", "vosotros", "tus", "ti",
)
FEATURES = (
    "word_density", "word_hits", "word_weight", "start_density", "start_hits", "start_weight", "distinct_hits",
    "near_person", "person_density", "capitals", "exclamations", "punctuation", "disguised", "disguised_hits", "digits", "length",
)


def _hash(words: list[str]) -> np.ndarray:
    raw, borders = text_bytes(pa.array(words, pa.string()))
    starts, ends, _ = find_words(raw, borders)
    return hash_words(raw, starts, ends, lower=True)


@dataclass
class Lexicon:
    """Sorted hashes and weights of words, and of word beginnings by length in bytes."""

    words: np.ndarray
    word_weights: np.ndarray
    starts: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def look_up(keys: np.ndarray, weights: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, weights[at], 0.0)


class Tokens:
    """Words of a batch of texts with their hashes and the text each belongs to."""

    def __init__(self, column: pa.Array):
        self.raw, self.borders = text_bytes(column)
        self.starts, self.ends, self.first = find_words(self.raw, self.borders, MARKS)
        self.hashes = hash_words(self.raw, self.starts, self.ends, lower=True)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n bytes of the words longer than that, and their numbers."""
        which = np.flatnonzero(self.ends - self.starts > n)
        return hash_words(self.raw, self.starts[which], self.starts[which] + n, lower=True), which

    def per_text(self, of_bytes: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(of_bytes)]
        return (sums[self.borders[1:]] - sums[self.borders[:-1]]).astype(float)

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, values, len(self.counts))


def _weight(bad, good, n_bad: int, n_good: int, log=np.log):
    """Log odds of a key in ``bad`` of ``n_bad`` toxic and ``good`` of ``n_good`` other texts; numbers, arrays or columns."""
    return log((bad + 0.5) / (max(n_bad, 1) + 1)) - log((good + 0.5) / (max(n_good, 1) + 1))


def word_counts(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, key, toxic texts, other texts) of whole words (length 0) and of beginnings; a text counts once a key."""
    tokens, parts = Tokens(texts), []
    for n in (0, *PREFIXES):
        hashes, which = (tokens.hashes, slice(None)) if n == 0 else tokens.beginnings(n)
        pairs = np.unique(np.stack([hashes, tokens.text[which].astype(U)], axis=1), axis=0)
        keys, at = np.unique(pairs[:, 0], return_inverse=True)
        bad = np.bincount(at, toxic[pairs[:, 1].astype(np.int64)], len(keys)).astype(np.int64)
        parts.append((np.full(len(keys), n, np.int32), keys, bad, np.bincount(at, minlength=len(keys)) - bad))
    return tuple(np.concatenate(c) for c in zip(*parts))


def choose_entries(n: np.ndarray, keys: np.ndarray, bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> Lexicon:
    """Of each kind the ``LEXICON_ENTRIES`` keys with high log odds that have the most weight times toxic texts."""
    weight = _weight(bad, good, n_bad, n_good)

    def entries(length: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        of = np.flatnonzero((n == length) & (bad >= least) & (weight >= LEAST_ODDS))
        of = of[np.lexsort((keys[of], -(weight * bad)[of]))][:LEXICON_ENTRIES]
        of = of[np.argsort(keys[of])]
        return keys[of], weight[of]

    return Lexicon(*entries(0, LEAST_WORD), {length: entries(length, LEAST_START) for length in PREFIXES})


COUNTS = T.StructType([T.StructField("n", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("key", "bad", "good")])


def learn_lexicon(found: DataFrame, n_bad: int, n_good: int) -> Lexicon:
    """From (text, y) of ``n_bad`` toxic and ``n_good`` other rows: keys of several toxic texts with high log odds.

    Of each kind the ``LEXICON_ENTRIES`` with the most weight times texts are kept; only these reach the driver.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            n, *rest = word_counts(batch.column("text"), batch.column("y").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(n), *(pa.array(c.view(np.int64)) for c in rest)], names=COUNTS.names)

    counts = found.select("text", "y").mapInArrow(run, COUNTS).groupBy("n", "key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weight = _weight(F.col("bad"), F.col("good"), n_bad, n_good, F.log)
    strong = counts.where(F.col("bad") >= F.when(F.col("n") == 0, LEAST_WORD).otherwise(LEAST_START)).withColumn("weight", weight)
    order = Window.partitionBy("n").orderBy(F.desc(F.col("weight") * F.col("bad")), F.col("key") < 0, "key")
    table = strong.where(F.col("weight") >= LEAST_ODDS).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= LEXICON_ENTRIES)
    n, keys, bad, good = (c.to_numpy() for c in table.select(*COUNTS.names).toArrow().columns)
    return choose_entries(n, keys.astype(np.int64).view(U), bad, good, n_bad, n_good)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    t = Tokens(texts)
    n = np.maximum(t.counts, 1)
    size = np.maximum(np.diff(t.borders), 1)
    weight = Lexicon.look_up(lexicon.words, lexicon.word_weights, t.hashes)
    start = np.zeros(len(t.hashes))
    for length, table in lexicon.starts.items():
        hashes, which = t.beginnings(length)
        start[which] = np.maximum(start[which], Lexicon.look_up(*table, hashes))
    hit = np.maximum(weight, start) > 0
    person = np.isin(t.hashes, _hash(list(SECOND_PERSON)))
    places = np.flatnonzero(person)
    near = np.zeros(len(hit), bool)
    if len(places) and hit.any():
        hits = np.flatnonzero(hit)
        right = np.searchsorted(places, hits)
        for side in (np.maximum(right - 1, 0), np.minimum(right, len(places) - 1)):
            other = places[side]
            near[hits] |= (np.abs(other - hits) <= NEAR) & (t.text[other] == t.text[hits])
    raw = t.raw
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    odd = np.isin(raw, np.frombuffer(DISGUISE[0].encode(), np.uint8))
    sums = lambda of: np.r_[0, np.cumsum(of)]
    letters, odds = sums(letter), sums(odd)
    mixed = np.flatnonzero((letters[t.ends] > letters[t.starts]) & (odds[t.ends] > odds[t.starts]))
    plain = hash_words(raw, t.starts[mixed], t.ends[mixed], lower=True, alike=DISGUISE)
    disguised = np.zeros(len(hit))
    disguised[mixed] = Lexicon.look_up(lexicon.words, lexicon.word_weights, plain) > 0
    is_mixed = np.zeros(len(hit))
    is_mixed[mixed] = 1
    marks = (raw >= 33) & (raw <= 126) & ~letter & ~((raw >= 48) & (raw <= 57))
    found = np.unique(np.stack([t.text[hit], t.hashes[hit].astype(np.int64)], axis=1), axis=0)[:, 0] if hit.any() else np.zeros(0, np.int64)
    words, begins = t.per_word(weight > 0), t.per_word(start > 0)
    hits = t.per_word(hit)
    columns = (
        words / n, np.log1p(words), t.per_word(weight) / n, begins / n, np.log1p(begins), t.per_word(start) / n,
        np.bincount(found, minlength=len(n)).astype(float), t.per_word(near) / np.maximum(hits, 1), t.per_word(person) / n,
        t.per_text((raw >= 65) & (raw <= 90)) / np.maximum(t.per_text(letter), 1), t.per_text(raw == 33) / size,
        t.per_text(marks) / size, t.per_word(is_mixed) / n, np.log1p(t.per_word(disguised)),
        t.per_text((raw >= 48) & (raw <= 57)) / size, np.log1p(t.counts),
    )
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Boosted trees of equal depth: a feature and a cut per inner node, a value per leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    raw = np.full(len(y), np.log(share / (1 - share)))
    base, inner = raw[0], 2**DEPTH - 1
    features_, cuts, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for place in range(inner):
            rows = np.flatnonzero(node == place)
            best = 1e-9
            if len(rows) >= 10:
                total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(bins[rows, j], g[rows], len(e) + 1))
                    hl = np.cumsum(np.bincount(bins[rows, j], h[rows], len(e) + 1))
                    gain = gl**2 / (hl + 1) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + 1) - total
                    k = int(np.argmax(gain[:-1]))
                    if gain[k] > best:
                        best, feature[place], cut[place] = gain[k], j, e[k]
            node[rows] = 2 * place + 1 + (x[rows, feature[place]] > cut[place])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        raw = raw + value[leaf]
        features_.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(base, np.array(features_), np.array(cuts), np.array(values))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising means of ``y`` by pooling adjacent violators: block starts and their values."""
    x, at = np.unique(raw, return_inverse=True)
    blocks: list[list[float]] = []
    for start, total, n in zip(x.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist()):
        blocks.append([start, total, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, total, n = blocks.pop()
            blocks[-1][1] += total
            blocks[-1][2] += n
    starts = np.array([b[0] for b in blocks])
    return starts, np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon | None
    trees: Trees | None
    starts: np.ndarray
    values: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """Calibrated score; inside a block the trees' own order shifts it by less than a thousandth."""
        if self.trees is None:
            return np.full(len(texts), self.values[0])
        raw = self.trees.raw(features(texts, self.lexicon))
        at = np.maximum(np.searchsorted(self.starts, raw, side="right") - 1, 0)
        return np.clip(self.values[at] * 0.998 + 0.002 / (1 + np.exp(-raw)), 0, 1)


def constant(n: int, bad: float) -> Model | None:
    """The share of toxic labels as every text's score, where there are too few of a kind to learn from."""
    few = n < LEAST_ROWS or min(bad, n - bad) < LEAST_OF_KIND
    return Model(None, None, np.zeros(1), np.array([bad / n if n else 0.0])) if few else None


def train(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> Model:
    """Trees of the rows outside ``calibrate``, calibrated on the rows inside."""
    trees = fit_trees(x[~calibrate], y[~calibrate])
    return Model(lexicon, trees, *isotonic(trees.raw(x[calibrate]), y[calibrate]))


def fit(texts: pa.Array, toxic: np.ndarray) -> Model:
    """A model from a few labelled texts at hand, dealt to the three parts in their order."""
    plain = constant(len(toxic), toxic.sum())
    if plain:
        return plain
    part = np.arange(len(toxic)) % 5
    of = part < 2
    bad = int(toxic[of].sum())
    lexicon = choose_entries(*word_counts(texts.filter(pa.array(of)), toxic[of]), bad, int(of.sum()) - bad)
    return train(lexicon, features(texts.filter(pa.array(~of)), lexicon), toxic[~of], part[~of] == 4)


def held_out(key: Column) -> Column:
    """True for the third of the ids whose labels are not learnt from."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def fitting_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(k, y, part, text) of the first ``rows`` labelled ids in hash order that are not held out; ``part`` goes round from 0 to 4."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(rows).select(F.col(key).alias("k"), "y")
    # at most ``rows`` rows of three numbers: a bounded sort and a bounded broadcast
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("k"), "k"))
    chosen = chosen.withColumn("part", (nth - 1) % 5)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    found = texts.join(F.broadcast(chosen), "k").groupBy("k", "y", "part")
    return found.agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first")).select("k", "y", "part", F.col("first.text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fits on at most ``rows`` labelled texts: two fifths for the lexicon, two for the trees, one for the calibration."""
    found = checkpointed(fitting_texts(docs, labels, key, text, label, rows))
    of_lexicon = F.col("part") < 2
    n, bad, n_part, bad_part = found.agg(F.count("*"), F.sum("y"), F.count_if(of_lexicon), F.sum(F.when(of_lexicon, F.col("y")))).first()
    plain = constant(n, bad or 0)
    if plain:
        return plain
    lexicon = learn_lexicon(found.where(of_lexicon), bad_part or 0, n_part - (bad_part or 0))
    row = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    work = lambda batch: [list_array(x.ravel(), np.full(len(x), len(FEATURES)), pa.float64()) for x in [features(batch.column("text"), lexicon)]]
    measured = map_added(found.where(~of_lexicon), "text", row, work).select(F.xxhash64("k").alias("h"), "k", "part", "y", "x")
    table = measured.toArrow().sort_by([("h", "ascending"), ("k", "ascending")])
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return train(lexicon, x, table.column("y").to_numpy().astype(float), table.column("part").to_numpy() == 4)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score``."""
    return map_added(
        docs, text, T.StructType([T.StructField("score", T.DoubleType())]), lambda batch: [pa.array(model.score(batch.column(text)), pa.float64())]
    )
