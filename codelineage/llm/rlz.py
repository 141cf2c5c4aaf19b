"""Removal of repeated passages by window lookups in indexed reference blocks, in place of a relative Lempel-Ziv parse.

The references of a document are all documents with a smaller id. Their windows of 13
words are indexed by anchors: the anchor of a window is its lowest-hashed run of four words, so
equal windows have equal anchors at equal places. Windows in a row with the same anchor
form a phrase. A reference block is the part of the index that holds a range of anchors. A
document's phrase that a smaller document has in the same block belongs to a factor as a whole;
where two documents share an anchor but not the phrase, a factor begins or ends there, and its
windows are looked up one by one. Greedy parsing then joins windows in a row with the same
reference into factors, and every factor, 13 words or longer, is a duplicate span.

The parse does not decide what goes: lookups of windows and phrases do, and factors only name
the spans. A word is in a factor of 13 words or more exactly if one of the windows over it is in a
smaller document. A greedy parse, whose factors do not overlap, would leave the end of a match that
begins inside another factor.

Phrases and windows are compared by two 64-bit hashes. Only equality with some smaller document matters, so
that phrases and windows repeated within a batch are resolved before anything is shuffled: a
passage that very many documents share reaches its block once per batch, and so does a window at its borders.

Null, empty and wordless texts have no windows and keep nothing; texts of fewer than 13 words are
kept whole. Rows with a null id are kept whole and are no reference. Of rows that share an id
none is smaller. Equal texts with different ids: all but the smallest lose all windows. An
empty table gives no rows. Columns named like an added one are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.llm.common import freed_shuffles, map_added, slices, text_bytes
from codelineage.llm.words import U, find_words, hash_words, mix, runs
from codelineage.session import checkpointed

WINDOW = 13
RUN = 4
TAG = 1 << 24
BLOCK_BYTES = 2 << 20


def batch_words(column: pa.Array):
    """Raw bytes, word starts and ends, words before each text, word hashes."""
    raw, borders = text_bytes(column)
    starts, ends, first = find_words(raw, borders)
    return raw, borders, starts, ends, first, hash_words(raw, starts, ends)


def tags(column: pa.Array) -> np.ndarray:
    """24 bits of each text, which tell rows with the same id apart."""
    raw, borders = text_bytes(column)
    return np.array([zlib.crc32(raw[a:b]) % TAG for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())], np.int64)


def phrases(hashes: np.ndarray, first: np.ndarray):
    """(text, first window, windows, anchor, content) of all phrases of a batch; windows are word numbers in the batch."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U)] * 2
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = np.flatnonzero(of[:n] == of[WINDOW - 1 :])
    if not len(valid):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U)] * 2
    short = runs(hashes, RUN)
    at = np.lib.stride_tricks.sliding_window_view(short, WINDOW - RUN + 1)[valid].argmin(axis=1) + valid
    text = of[valid]
    begin = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(text) != 0)])
    count = np.diff(np.r_[begin, len(valid)])
    place = np.arange(len(valid)) - np.repeat(begin, count)
    weight = mix(np.arange(WINDOW, dtype=U), 31) | U(1)
    content = np.add.reduceat(runs(hashes, WINDOW)[valid] * weight[place], begin)
    content = mix(content + (at[begin] - valid[begin]).astype(U) * U(64) + count.astype(U), 33)
    return text[begin], valid[begin], count, short[at[begin]], content


PHRASE = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "phrase", "doc", "place", "ref")])


def resolved(one: np.ndarray, two: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """Both keys, the smallest document of the batch with these keys, and whether that settles a row.

    A settled row is spread evenly: under its own keys it would only be met again.
    """
    order = np.lexsort((doc, two, one))
    group = np.flatnonzero(np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
    low = np.empty(len(doc), np.int64)
    low[order] = np.repeat(doc[order][group], np.diff(np.r_[group, len(doc)]))
    known = low < doc
    spread = mix(place.astype(U), 35) + mix(doc.astype(U), 36)
    return np.where(known, spread, one), np.where(known, spread, two), low, known


def index_phrases(docs: DataFrame) -> DataFrame:
    """Every phrase of (id, text); ``ref`` is a smaller document of the same batch with the phrase, if there is one."""

    def run(batches):
        for batch in slices(batches, "text", BLOCK_BYTES):
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            _, _, _, _, first, hashes = batch_words(batch.column("text"))
            text, start, count, anchor, content = phrases(hashes, first)
            if not len(text):
                continue
            doc = ids[text]
            place = ((start - first[text]) * 16 + count) * TAG + tags(batch.column("text"))[text]
            anchor, content, low, known = resolved(anchor, content, doc, place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(place), pa.array(low, mask=~known)],
                names=[f.name for f in PHRASE],
            )

    return docs.mapInArrow(run, PHRASE)


def _grouped(rows: DataFrame) -> DataFrame:
    """Places of each document's rows; a document's list is bounded by its own length."""
    tag = F.pmod("place", F.lit(TAG)).alias("tag")
    return rows.groupBy("doc", tag).agg(F.collect_list(F.struct(F.expr(f"place div {TAG}").alias("at"), "ref")).alias("found"))


WINDOW_ROW = T.StructType([T.StructField(n, T.LongType()) for n in ("window", "check", "doc", "place", "ref")])


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tag", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) % TAG)


def boundary_windows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The windows of the phrases in ``rows``, by two hashes; ``ref`` as in ``index_phrases``."""
    listed = _grouped(rows.withColumn("ref", F.lit(None).cast("long")))
    listed = listed.withColumnRenamed("tag", "tag_")
    joined = _tagged(docs).join(listed, (F.col("id") == F.col("doc")) & (F.col("tag") == F.col("tag_")))

    def run(batches):
        for batch in slices(batches, "text"):
            _, _, _, _, first, hashes = batch_words(batch.column("text"))
            windows, checks = runs(hashes, WINDOW), runs(mix(hashes, 37), WINDOW)
            lists = batch.column("at")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = lists.flatten().to_numpy()
            count = at % 16
            row = np.repeat(np.arange(len(at)), count)
            place = at[row] // 16 + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            text = owner[row]
            tag = batch.column("tag").to_numpy()[text]
            at_word, doc, place = first[text] + place, batch.column("id").to_numpy()[text], (place * 16 + 1) * TAG + tag
            window, check, low, known = resolved(windows[at_word], checks[at_word], doc, place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(window.view(np.int64)), pa.array(check.view(np.int64)), pa.array(doc), pa.array(place), pa.array(low, mask=~known)],
                names=[f.name for f in WINDOW_ROW],
            )

    return joined.select("id", "text", "tag", F.col("found.at").alias("at")).mapInArrow(run, WINDOW_ROW)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc, tag, found): places and references of all windows of (id, text) that a smaller document holds."""
    by_anchor = Window.partitionBy("anchor")
    by_phrase = Window.partitionBy("anchor", "phrase")
    seen = index_phrases(docs).withColumns(
        {
            "first": F.min("doc").over(by_phrase), "low": F.min("phrase").over(by_anchor), "high": F.max("phrase").over(by_anchor),
            "doc_low": F.min("doc").over(by_anchor), "doc_high": F.max("doc").over(by_anchor),
        }
    )
    ref = F.coalesce("ref", F.when(F.col("first") < F.col("doc"), F.col("first")))
    check = F.col("ref").isNull() & (F.col("low") != F.col("high")) & (F.col("doc_low") != F.col("doc_high"))
    rows = checkpointed(seen.select("doc", "place", ref.alias("ref"), check.alias("check")).where("ref is not null or check"))
    open_ = rows.where("check and ref is null").select("doc", "place")
    windows = boundary_windows(docs, open_).withColumn("first", F.min("doc").over(Window.partitionBy("window", "check")))
    single = windows.select("doc", "place", F.coalesce("ref", F.when(F.col("first") < F.col("doc"), F.col("first"))).alias("ref")).where("ref is not null")
    return _grouped(rows.where("ref is not null").select("doc", "place", "ref").unionByName(single))


def factors(at: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (start, words, reference) from phrases (place * 16 + windows) and their references."""
    order = np.argsort(at, kind="stable")
    start, count, ref = at[order] // 16, at[order] % 16, ref[order]
    end = start + count
    begin = np.flatnonzero(np.r_[True, (start[1:] != end[:-1]) | (ref[1:] != ref[:-1])])
    last = np.r_[begin[1:], len(start)] - 1
    return start[begin], end[last] - start[begin] + WINDOW - 1, ref[begin]


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("factors", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "words", "reference")]))),
    ]
)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds word counts, the kept words joined by one space, and the duplicate spans with their references."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    with freed_shuffles(df.sparkSession):
        spans = find_spans(docs)
    spans = spans.withColumnsRenamed({"doc": "_doc", "tag": "_tag", "found": "_found"})
    rows = df.withColumn("_crc", F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")) % TAG)
    joined = rows.join(spans, (F.col(key).cast("long") == F.col("_doc")) & (F.col("_crc") == F.col("_tag")), "left").drop("_doc", "_tag", "_crc")

    def work(batch):
        raw, borders = text_bytes(batch.column(text))
        starts, ends, first = find_words(raw, borders)
        words, removed, kept, parts, counts = [], [], [], [], []
        found = batch.column("_found")
        data = raw.tobytes()
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            covered = np.zeros(b - a, bool)
            spans = found[i]
            if spans.is_valid and len(spans.values):
                at, ref = (spans.values.field(n).to_numpy() for n in ("at", "ref"))
                start, size, ref = factors(at, ref)
                mark = np.zeros(b - a + 1, np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + size, -1)
                covered = np.cumsum(mark[:-1]) > 0
                parts.append(np.stack([start, size, ref]))
                counts.append(len(start))
            else:
                counts.append(0)
            stay = np.flatnonzero(~covered) + a
            kept.append(b" ".join([data[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())]).decode("utf-8", "replace"))
            words.append(b - a)
            removed.append(int(covered.sum()))
        flat = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        inner = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat], names=["start", "words", "reference"])
        border = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.int32())
        return [pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.ListArray.from_arrays(border, inner)]

    return map_added(joined, text, FOUND, work).drop("_found")
