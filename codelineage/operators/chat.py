"""Checks of texts against the assistant's replies of their conversation.

``contents`` has one row per checked text: ``conv_id``, further columns of ``text_keys``
that tell the texts of a conversation apart, and ``content``. Texts are brought to their form once, before
they meet; a pair becomes a row only if lengths, counts or containment leave room for the similarity, and a
conversation with many replies is dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelineage.functions import text as t
from codelineage.operators.files import segments
from codelineage.session import checkpointed

SOURCED_MIN = 0.7
SAME_GROUP_MIN = 0.9
# Characters of a sentence that the queries show, and the difference of lengths from which they take texts as wholly different.
LONGEST_SENTENCE = 300
LONGEST_GAP = 1000
# Replies of a conversation that one task compares with its texts.
TASK_REPLIES = 1024
# First and largest number of portions of a group of texts that one round settles.
ROUND_PORTIONS = (128, 1024)
# Fixed value: fenced code as the chat view reads it (a line break after the language).
CHAT_FENCE = r"(?s)```(\w+)?\n(.*?)```"


def reply_pieces(messages: DataFrame) -> DataFrame:
    """What each assistant reply offers for comparison, in order.

    Replies with code give every block and every segment of the joined blocks;
    replies without code give their whole text.
    """
    replies = messages.where(F.col("role") == "assistant")
    codes = F.transform(F.regexp_extract_all("text", F.lit(CHAT_FENCE), 2), t.js_trim)
    piece = lambda kind, arr: F.transform(arr, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("piece")))
    listed = F.when(
        F.size("codes") > 0,
        F.concat(piece("block", F.col("codes")), piece("segment", segments(F.array_join("codes", "\n\n")))),
    ).otherwise(piece("text", F.array("text")))
    return (
        replies.withColumn("codes", codes)
        .select("conv_id", "turn", F.posexplode_outer(listed).alias("piece_no", "p"))
        .where(F.col("piece_no").isNotNull())
        .select("conv_id", "turn", "piece_no", "p.kind", "p.piece")
    )


def _dealt(left: DataFrame, right: DataFrame, b: str, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """``left`` repeated per part and ``right`` dealt into parts of about ``task_rows`` by the hash of ``b``; a part is ``_part`` of ``conv_id``."""
    parts = right.groupBy("conv_id").agg(F.ceil(F.count("*") / task_rows).cast("int").alias("_parts"))
    dealt = right.join(parts, "conv_id").withColumn("_part", F.pmod(F.xxhash64(b), F.col("_parts")).cast("int")).drop("_parts")
    asked = left.join(parts, "conv_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return asked, dealt


def met(left: DataFrame, right: DataFrame, b: str, task_rows: int = 64) -> DataFrame:
    """Every pair of rows of a conversation, a long conversation by several tasks."""
    asked, dealt = _dealt(left, right, b, task_rows)
    return asked.join(dealt, ["conv_id", "_part"]).drop("_part")


def similar_pairs(left: DataFrame, a: str, right: DataFrame, b: str, floor: float, gap: int | None = None, task_rows: int = TASK_REPLIES) -> DataFrame:
    """Pairs of a conversation whose texts ``a`` and ``b`` are more than ``floor`` similar, with ``similarity``.

    The rows of ``right`` are dealt into parts of about ``task_rows`` by the hash of their text, and
    ``left`` is repeated per part, so that no task holds a whole conversation.
    """
    asked, dealt = _dealt(left, right, b, task_rows)
    asked, dealt = asked.withColumn("_fa", t.chat_form(F.col(a))), dealt.withColumn("_fb", t.chat_form(F.col(b)))
    twice = {c: f"_r_{c}" for c in ("conv_id", "_part")}
    for c, other in twice.items():
        dealt = dealt.withColumnRenamed(c, other)
    same = (F.col("conv_id") == F.col("_r_conv_id")) & (F.col("_part") == F.col("_r__part"))
    pairs = asked.join(dealt, same & t.may_be_similar(F.col("_fa"), F.col("_fb"), floor))
    scored = t.form_similarity(pairs, "_fa", "_fb", floor=floor, gap=gap)
    return scored.where(F.col("similarity") > floor).drop("_fa", "_fb", "_part", *twice.values())


def sentence_forms(text: Column) -> Column:
    """Place, text and form of every sentence of more than 10 characters."""
    found = F.filter(F.split(text, r"[.!?\n]+"), lambda s: F.length(t.js_trim(s)) > 10)
    return F.transform(found, lambda s, i: F.struct(i.alias("pos"), t.js_trim(s).alias("s"), t.chat_form(s, terms=True).alias("form")))


def best_sentence(
    df: DataFrame, keys: list[str], content: str, text: str, longest: int | None = None, gap: int | None = None, forms: tuple[str, str] | None = None
) -> DataFrame:
    """Sentence of ``text`` most similar to ``content``, whole or its first ``longest`` characters.

    Where texts meet several times, ``forms`` names columns with the form of the content (with its terms) and the
    ``sentence_forms`` of the text, made before the texts met.
    """
    c, x = F.col(content), F.col(text)
    made = (t.chat_form(c, terms=True), sentence_forms(x)) if forms is None else tuple(F.col(f) for f in forms)
    told = F.transform(
        made[1], lambda s: F.struct(t.similarity_without_edits(made[0], s["form"], gap).alias("told"), (-s["pos"]).alias("early"), s["s"].alias("s"), s["form"].alias("form"))
    )
    # The best of the sentences that need no edit distance is one row, each of the others one more.
    sure = F.array_max(F.transform(F.filter("_told", lambda e: e["told"] > 0), lambda e: F.struct(e["told"], e["early"], e["s"])))
    first = F.struct("_sure.told", "_sure.early", "_sure.s", F.get("_told", F.lit(-1))["form"].alias("form"))
    each = df.select(*keys, made[0].alias("_fa"), told.alias("_told")).withColumn("_sure", sure)
    each = each.select(*keys, "_fa", F.explode_outer(F.concat(F.array(first), F.filter("_told", lambda e: e["told"].isNull()))).alias("_s"))
    open_ = F.col("_s.told").isNull()
    rows = each.select(*keys, F.when(open_, F.col("_fa")).alias("_fa"), F.col("_s.form").alias("_fb"), F.col("_s.told").alias("told"), F.col("_s.early").alias("early"), F.col("_s.s").alias("s"))
    scored = t.form_similarity(rows, "_fa", "_fb", "sim", gap=gap, terms=True).withColumn("sim", F.coalesce("told", "sim")).drop("_fa", "_fb", "told")
    best = scored.where(F.col("sim") > 0).groupBy(*keys).agg(F.max(F.struct("sim", "early", "s")).alias("b"))
    cut = lambda v: v if longest is None else F.concat(F.left(v, F.lit(longest)), F.lit("..."))
    # Nothing similar: the place of the content inside the text, else its beginning.
    at = F.position(t.norm_line(c), t.norm_line(x))
    prefix = F.call_function("regexp_extract", x, F.concat(F.lit(r"(?s)^(?:\s*\S){"), (at - 1).cast("string"), F.lit("}")), F.lit(0))
    begin = F.when(at == 1, 0).otherwise(F.length(prefix))
    inside = F.concat(F.substr(x, begin + 1, F.length(c) + 50), F.lit("..."))
    fallback = F.when(at > 0, inside).otherwise(cut(x))
    s = F.col("b.s")
    chosen = F.when(s.isNull() | (F.length(s) == 0), fallback)
    chosen = (chosen if longest is None else chosen.when(F.length(s) > longest, cut(s))).otherwise(s)
    return df.join(best, keys, "left").select(*keys, F.coalesce("b.sim", F.lit(0.0)).alias("similarity"), chosen.alias("sentence"))


def sourced_matches(
    contents: DataFrame, messages: DataFrame, text_keys: tuple[str, ...] = ("conv_id",), longest: int | None = None, gap: int | None = None
) -> DataFrame:
    """Pieces more than 70 % similar to the checked text; whole replies are cut to their best sentence.

    The pairs that pass are kept in the shared folder, so that texts are compared once for code and for whole replies.
    """
    keys = [*text_keys, "turn", "piece_no"]
    found = similar_pairs(contents, "content", reply_pieces(messages), "piece", SOURCED_MIN, gap)
    scored = checkpointed(found.select(*keys, "kind", "similarity", "content", "piece"))
    whole = scored.where(F.col("kind") == "text")
    cut = best_sentence(whole.select(*keys, "content", "piece"), keys, "content", "piece", longest, gap)
    portions = whole.join(cut.select(*keys, "sentence"), keys).select(*keys, "similarity", F.col("sentence").alias("portion"))
    code = scored.where(F.col("kind") != "text").select(*keys, "similarity", F.col("piece").alias("portion"))
    return code.unionByName(portions)


def _representatives(block: DataFrame, keys: list[str], gap: int | None) -> DataFrame:
    """Those of the first portions of each text that are similar to no earlier representative.

    Similar pairs of a block are gathered per text, at most a block's portions squared, and settled in order.
    """
    same = [F.col(k) == F.col(f"_e_{k}") for k in keys]
    earlier = block.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.col("nth").alias("before"), F.col("form").alias("_e_form"))
    meet = (F.col("before") < F.col("nth")) & t.may_be_similar(F.col("form"), F.col("_e_form"), SAME_GROUP_MIN)
    for condition in same:
        meet = meet & condition
    near = t.form_similarity(block.join(earlier, meet), "form", "_e_form", "sim", SAME_GROUP_MIN, gap).where(F.col("sim") > SAME_GROUP_MIN)
    links = near.groupBy(*keys, "nth").agg(F.collect_list("before").alias("like"))
    listed = block.select(*keys, "nth").join(links, [*keys, "nth"], "left").select(
        *keys, F.struct("nth", F.coalesce("like", F.array().cast("array<int>")).alias("like")).alias("item")
    )
    items = listed.groupBy(*keys).agg(F.sort_array(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<int>")
    step = lambda reps, item: F.when(F.arrays_overlap(reps, item["like"]), reps).otherwise(F.concat(reps, F.array(item["nth"])))
    chosen = items.select(*keys, F.explode(F.aggregate("items", none, step)).alias("nth"))
    return block.join(chosen, [*keys, "nth"])


def dedupe_matches(matches: DataFrame, keys: tuple[str, ...] = ("conv_id",), gap: int | None = None) -> DataFrame:
    """Group matches by their first representative more than 90 % similar; keep the best per group.

    Equal normalised portions always share a group and are merged first. A round settles the first open
    portions of every text (128, then twice as many each time up to 1 024): those
    similar to no earlier representative become representatives, all at once, and every
    open portion goes to the earliest of them it is similar to. The number of rounds thus follows
    the number of groups divided by hundreds, and no group is gathered in one task.
    """
    keys = list(keys)
    order = F.struct("turn", "piece_no")
    best = F.struct((-F.col("similarity")).alias("low"), "turn", "piece_no", "portion")
    merged = (
        matches.withColumn("norm", t.norm_line(F.col("portion")))
        .groupBy(*keys, "norm")
        .agg(F.min(F.struct("turn", "piece_no", "portion")).alias("first"), F.min(best).alias("best"), F.count("*").alias("copies"))
        .select(*keys, "first.turn", "first.piece_no", t.chat_form(F.col("first.portion")).alias("form"), "best", "copies")
    )
    open_rows, done, (size, largest) = checkpointed(merged), None, ROUND_PORTIONS
    while True:
        first = W.partitionBy(*keys).orderBy("turn", "piece_no")
        block = open_rows.select(*keys, "turn", "piece_no", "form").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= size)
        reps = _representatives(block, keys, gap).select(*[F.col(k).alias(f"_r_{k}") for k in keys], order.alias("rep"), F.col("form").alias("_r_form"))
        like = (order == F.col("rep")) | ((F.col("rep") < order) & t.may_be_similar(F.col("form"), F.col("_r_form"), SAME_GROUP_MIN))
        for k in keys:
            like = like & (F.col(k) == F.col(f"_r_{k}"))
        met = open_rows.select(*keys, "turn", "piece_no", "form").join(reps, like)
        compared = t.form_similarity(met, "form", "_r_form", "to_rep", SAME_GROUP_MIN, gap)
        taken = compared.where((order == F.col("rep")) | (F.col("to_rep") > SAME_GROUP_MIN))
        home = taken.groupBy(*keys, "turn", "piece_no").agg(F.min("rep").alias("rep"))
        tested = checkpointed(open_rows.join(home, [*keys, "turn", "piece_no"], "left"))
        group = tested.where("rep is not null").groupBy(*keys, "rep").agg(F.min("best").alias("best"), F.sum("copies").alias("portions"))
        done = group if done is None else done.unionByName(group)
        open_rows, size = tested.where("rep is null").drop("rep"), min(2 * size, largest)
        if open_rows.isEmpty():
            return done.select(
                *keys, F.col("rep.turn").alias("turn"), F.col("rep.piece_no").alias("piece_no"),
                (-F.col("best.low")).alias("similarity"), F.col("best.portion").alias("portion"), "portions",
            )


def assistant_sourced(contents: DataFrame, messages: DataFrame, text_keys: tuple[str, ...] = ("conv_id",), gap: int | None = None) -> DataFrame:
    """Per checked text: overall similarity (the best group) and whether it came from the assistant."""
    keys = list(text_keys)
    found = similar_pairs(contents, "content", reply_pieces(messages), "piece", SOURCED_MIN, gap)
    best = found.groupBy(*keys).agg(F.max("similarity").alias("best"), F.count("*").alias("matches"))
    overall = F.coalesce("best", F.lit(0.0))
    return contents.join(best, keys, "left").select(
        *keys, overall.alias("overall_similarity"), (overall > SOURCED_MIN).alias("is_assistant_sourced"),
        F.coalesce("matches", F.lit(0)).alias("matches"),
    )


def first_appearance(
    contents: DataFrame,
    snippets: DataFrame,
    similarity: Callable[..., DataFrame] | None = None,
    text_keys: tuple[str, ...] = ("conv_id",),
    gap: int | None = None,
) -> DataFrame:
    """Earliest snippet of the conversation more than 70 % similar to the checked text.

    ``similarity(df, a, b, name, floor)`` adds another measure as a column; it is then asked for every pair.
    """
    if similarity is None:
        near = similar_pairs(contents, "content", snippets, "code", SOURCED_MIN, gap)
    else:
        scored = similarity(snippets.join(contents, "conv_id"), "content", "code", "similarity", floor=SOURCED_MIN)
        near = scored.where(F.col("similarity") > SOURCED_MIN)
    return near.groupBy(*text_keys).agg(F.min(F.struct("turn", "snippet_no", "role")).alias("f")).select(
        *text_keys, F.col("f.turn").alias("first_turn"), F.col("f.role").alias("first_role")
    )
