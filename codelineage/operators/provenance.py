"""Who wrote a line or block first: chat history joined with committed code.

Inputs: ``messages(conv_id, turn, role, text)``, ``snippets(conv_id, turn,
snippet_no, role, code)`` and ``blocks(conv_id, block, content)``.

Repeated lines and repeated snippets are aggregated before they are shuffled or
joined, so a line that fills a third of a conversation travels as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelineage.functions import text as t
from codelineage.session import checkpointed

LLM, PROMPT, HUMAN, MIXED = "LLM_GENERATED", "HUMAN_PROMPT_ORIGIN", "HUMAN_WRITTEN", "MIXED"
FUZZY_MIN = 70.0


def comparable(norm: Column) -> Column:
    """Lines shorter than 3 or without a word character are never looked up."""
    return (F.length(norm) >= 3) & norm.rlike("[a-zA-Z0-9_]")


def norm_lines(text: str) -> Column:
    """Normalised lines of a text: the pattern runs once per line, before the lines become rows."""
    return F.transform(t.split_lines(text), t.norm_line)


def first_lines(messages: DataFrame) -> DataFrame:
    """Earliest message of every normalised line, per conversation.

    Turn and role are packed into one number, so the minimum is kept in a
    hash table on both sides of the shuffle.
    """
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    packed = F.min("said")
    return (
        messages.select("conv_id", (F.col("turn") * 4 + role).alias("said"), F.explode_outer(F.array_distinct(norm_lines("text"))).alias("norm"))
        .where(comparable(F.col("norm")))
        .groupBy("conv_id", "norm")
        .agg(packed.alias("said"))
        .select(
            "conv_id",
            "norm",
            F.floor(F.col("said") / 4).alias("first_turn"),
            F.when(F.col("said") % 4 == 0, "user").when(F.col("said") % 4 == 1, "assistant").otherwise("other").alias("first_role"),
        )
    )


def block_lines(blocks: DataFrame) -> DataFrame:
    """Meaningful lines of each block with their 1-based number."""
    return (
        blocks.select("conv_id", "block", F.posexplode_outer(norm_lines("content")).alias("pos", "norm"))
        .where((F.length("norm") > 0) & ~F.col("norm").rlike(t.TAG_LINE))
        .select("conv_id", "block", (F.col("pos") + 1).alias("line_no"), "norm")
    )


def role_label(role: Column) -> Column:
    return F.when(role == "assistant", LLM).when(role == "user", PROMPT).otherwise(HUMAN)


def line_provenance(blocks: DataFrame, messages: DataFrame) -> DataFrame:
    """Label every block line by the first message that holds it."""
    return label_lines(blocks, first_lines(messages))


def label_lines(blocks: DataFrame, lookup: DataFrame) -> DataFrame:
    """Join block lines with the table of first lines (kept as a table when commits arrive as a stream).

    The lookup side has one row per (conversation, line); a hot line only
    repeats on the block side, which adaptive execution can split.
    """
    # Lines that are never looked up get a key no line can have, spread by line number.
    unmatched = F.concat(F.lit("\n"), F.col("line_no").cast("string"))
    lines = block_lines(blocks).withColumn(
        "key", F.when(comparable(F.col("norm")), F.col("norm")).otherwise(unmatched)
    )
    found = lookup.withColumnRenamed("norm", "key")
    return lines.join(found, ["conv_id", "key"], "left").select(
        "conv_id", "block", "line_no", "first_turn", role_label(F.col("first_role")).alias("label")
    )


def label_from_lines(label: Column) -> Column:
    """Aggregate expression: block label implied by its line labels."""
    llm = F.coalesce(F.bool_or(label == LLM), F.lit(False))
    prompt = F.coalesce(F.bool_or(label == PROMPT), F.lit(False))
    human = F.coalesce(F.bool_or(label.isin(HUMAN, PROMPT)), F.lit(False))
    return F.when(llm & human, MIXED).when(llm, LLM).when(prompt, PROMPT).otherwise(HUMAN)


def line_labels_per_block(lines: DataFrame) -> DataFrame:
    return lines.groupBy("conv_id", "block").agg(label_from_lines(F.col("label")).alias("line_label"))


def previous_user_turn(messages: DataFrame, chunk: int = 65536) -> DataFrame:
    """Nearest earlier user turn for every message.

    Turns are cut into chunks; the latest user turn of each chunk is carried
    forward over the chunk table, so a huge conversation is split over tasks.
    """
    rows = messages.select("conv_id", "turn", "role").withColumn("chunk", F.floor(F.col("turn") / chunk))
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        rows.groupBy("conv_id", "chunk")
        .agg(F.max(user_turn).alias("_last"))
        .select("conv_id", "chunk", F.max("_last").over(before).alias("_carried"))
    )
    inside = W.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("_near", F.max(user_turn).over(inside))
        .join(carried, ["conv_id", "chunk"])
        .select("conv_id", "turn", F.coalesce("_near", "_carried").alias("prev_user_turn"))
    )


LEVELS = ("raw", "ws", "syn", "shape")
RARITY_BUCKETS = 16_384


def _digest(c: Column) -> Column:
    """The first 128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def _prepared(df: DataFrame, code: str) -> DataFrame:
    """Every text with a digest per comparison level and its lines cut into tokens, once, in the shared folder."""
    ids = [c for c in df.columns if c != code]
    cut = df.select(*ids, F.coalesce(code, F.lit("")).alias("code")).withColumn("features", t.line_features(F.col("code")))
    shapes = F.array_join(F.transform("features", lambda f: f["shape"]), "\n")
    lines = F.array_join(t.trimmed_lines(F.col("code")), "\n")
    return checkpointed(
        cut.select(
            *ids, "features", F.size("features").alias("n_lines"),
            _digest(F.col("code")).alias("raw"), _digest(t.norm_ws(F.col("code"))).alias("ws"), _digest(t.norm_syntax(F.col("code"))).alias("syn"),
            _digest(F.concat(F.size("features").cast("string"), F.lit(" "), shapes)).alias("shape"), _digest(lines).alias("line"),
        )
    )


def _texts(prepared: DataFrame) -> DataFrame:
    """Texts of a conversation with the same trimmed lines, once."""
    return prepared.groupBy("conv_id", "line").agg(*[F.first(c).alias(c) for c in ("syn", "shape", "n_lines", "features")])


def _word(line: Column, slot: Column, word: Column) -> Column:
    return F.xxhash64(line, slot, word)


def _line_words(line: Column, f: Column) -> Column:
    """A number per token of a line, made of its place and text."""
    return F.transform(f["tokens"], lambda x, i: _word(line, i, x))


def _rarity(right: DataFrame) -> Column:
    """How often the words of a hash bucket stand in ``right``, an array of ``RARITY_BUCKETS`` counts.

    Counts steer the choice of probes only: any choice finds every pair.
    """
    words = right.select(F.posexplode("features").alias("i", "f")).select(F.explode_outer(_all_words(F.col("i"), F.col("f"))).alias("word"))
    counts = dict(words.groupBy(_bucket(F.col("word")).alias("b")).count().collect())
    return F.split(F.lit(",".join(str(counts.get(b, 0)) for b in range(RARITY_BUCKETS))), ",").cast("array<bigint>")


def _bucket(word: Column) -> Column:
    return F.pmod(word, F.lit(RARITY_BUCKETS)).cast("int")


def _all_words(line: Column, f: Column) -> Column:
    return F.concat(F.array(_word(line, F.lit(-1), f["shape"])), _line_words(line, f))


def _probes(features: Column, rarity: Column) -> Column:
    """The words a text asks for: the rarest of a sufficient choice of its lines.

    Lines are compared by position. A pair with at least 70 % similar lines shares a similar
    line inside ANY ``floor(0.3 n) + 1`` positions of the text, and two similar lines share their
    shape or a token inside ANY ``floor(0.3 m) + 1`` token positions of the line (equal
    squeezed text implies equal tokens). Hash collisions only add candidates.
    """
    share = lambda n: F.floor(n * 3 / 10).cast("int") + 1
    told = lambda w: F.struct(F.get(rarity, _bucket(w)).alias("seen"), w.alias("word"))

    # Lists that are used more than once are bound by ``let``: inside a lambda nothing else keeps them from being made again.
    def line(f: Column, i: Column) -> Column:
        ranked = F.sort_array(F.transform(_line_words(i, f), told))
        chosen = F.concat(F.array(told(_word(i, F.lit(-1), f["shape"]))), F.slice(ranked, 1, share(F.size(f["tokens"]))))
        cost = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + w["seen"])
        return t.let(chosen, lambda words: F.struct(cost(words).alias("cost"), i.alias("line"), words.alias("words")))

    lines = F.sort_array(F.transform(features, line))
    kept = F.slice(lines, 1, share(F.size(features)))
    words = F.filter(F.flatten(F.transform(kept, lambda x: x["words"])), lambda w: w["seen"] > 0)
    return F.array_distinct(F.transform(words, lambda w: w["word"]))


def _fuzzy_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(conv_id, line, other, score) of the texts that match by their lines alone: score of 70 or more, neither equal
    syntax form nor equal shapes, which are refused before they are paired.

    The candidate join carries ids and digests only. Rare words are probed first, and what is left of
    hot words is a join that adaptive execution can split.
    """
    rarity = _rarity(right)
    texts, others = _texts(left), _texts(right)
    keys = ["conv_id", "line", "syn", "shape", "n_lines"]
    # The outer form spares the optimizer's "list is not empty" test, which would make the lists twice; a join drops nulls.
    asked = texts.select(*keys, F.explode_outer(_probes(F.col("features"), rarity)).alias("word"))
    index = others.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.posexplode("features").alias("i", "f")).select(
        *[f"r_{k}" for k in keys], F.explode_outer(_all_words(F.col("i"), F.col("f"))).alias("word")
    )
    same = (F.col("conv_id").eqNullSafe(F.col("r_conv_id"))) & (asked.word == index.word)
    apart = (F.col("syn") != F.col("r_syn")) & (F.col("shape") != F.col("r_shape"))
    near = (F.col("n_lines") >= F.col("r_n_lines") * 0.7 - 1e-9) & (F.col("r_n_lines") >= F.col("n_lines") * 0.7 - 1e-9)
    pairs = asked.join(index, same & apart & near).select("conv_id", "line", F.col("r_line").alias("other")).distinct()
    own = texts.select("conv_id", "line", F.col("features").alias("lf"))
    far = others.select("conv_id", F.col("line").alias("other"), F.col("features").alias("rf"))
    scored = pairs.join(own, ["conv_id", "line"]).join(far, ["conv_id", "other"])
    return scored.withColumn("score", t.fuzzy_score(F.col("lf"), F.col("rf"))).where(F.col("score") >= FUZZY_MIN).select("conv_id", "line", "other", "score")


def _by_level(prepared: DataFrame, levels: tuple[str, ...], *others: str) -> DataFrame:
    """A row per level of every text, under its digest there; ``both`` stands for equal shapes and syntax forms."""
    key = lambda level: F.concat("shape", "syn") if level == "both" else F.col(level)
    each = F.array(*[F.struct(F.lit(level).alias("level"), key(level).alias("key")) for level in levels])
    return prepared.select("conv_id", *others, F.inline(each))


def _kind(own: str, first: Column) -> Column:
    """How a snippet of the same syntax form matches the text of this row."""
    return F.when(first["raw"] == F.col(f"{own}raw"), "exact").when(first["ws"] == F.col(f"{own}ws"), "whitespace").when(first["syn"] == F.col(f"{own}syn"), "normalized")


def _score(kind: Column) -> Column:
    return F.when(kind == "exact", 100.0).when(kind == "whitespace", 95.0).when(kind == "normalized", 85.0)


def match_blocks(blocks: DataFrame, snippets: DataFrame) -> DataFrame:
    """All match levels of every block: counts, best score and first match.

    Equal text implies equal whitespace form implies equal syntax form; texts whose lines have the same shapes are
    fuzzy matches of 100. At these levels snippets are aggregated per digest and a block needs
    one row from each, so no pairs are listed; pairs of other texts come from ``_fuzzy_pairs`` and join the same
    aggregation. The structural level cannot reach its threshold and is left out.
    """
    own, others = _both_prepared(blocks, snippets)
    return _matched(own, others, _fuzzy_pairs(own, others))


def _both_prepared(blocks: DataFrame, snippets: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = _prepared(blocks.select("conv_id", "block", "content"), "content")
    return own, _prepared(snippets.select("conv_id", "turn", "snippet_no", "role", "code"), "code")


def _matched(own: DataFrame, others: DataFrame, pairs: DataFrame) -> DataFrame:
    place = F.struct("turn", "snippet_no", "role", "raw", "ws", "syn")
    said = _by_level(others, (*LEVELS, "both"), "turn", "snippet_no", "role", "raw", "ws", "syn").select(
        "conv_id", "level", "key", F.lit(1).alias("n"), F.lit(None).cast("double").alias("score"), place.alias("at")
    )
    first_of = others.groupBy("conv_id", F.col("line").alias("other")).agg(F.count("*").alias("n"), F.min(place).alias("at"))
    by_lines = pairs.join(first_of, ["conv_id", "other"]).select(
        "conv_id", F.lit("line").alias("level"), F.col("line").alias("key"), F.col("n").cast("int").alias("n"), "score", F.col("at")
    )
    held = said.unionByName(by_lines).groupBy("conv_id", "level", "key").agg(
        F.sum("n").alias("n"), F.max("score").alias("best"), F.min(F.struct("at", "score")).alias("first")
    )
    asked = _by_level(own, (*LEVELS, "both", "line"), "block", "raw", "ws", "syn")
    hits = asked.join(held, ["conv_id", "level", "key"], "left")
    at, level = F.col("first.at"), F.col("level")
    tier = _kind("", at)
    # Of snippets with the same shapes the first may have the block's own syntax form: then the tiers have it.
    kind = F.when(level == "syn", tier).when((level == "line") | ((level == "shape") & (at["syn"] != F.col("syn"))), "fuzzy")
    score = F.when(level == "line", F.col("first.score")).when(level == "shape", 100.0).otherwise(_score(tier))
    first = F.when(
        at.isNotNull() & kind.isNotNull(),
        F.struct(at["turn"].alias("turn"), at["snippet_no"].alias("snippet_no"), at["role"].alias("role"), score.alias("score"), kind.alias("kind")),
    )
    n = lambda name: F.coalesce(F.max(F.when(level == name, F.col("n"))), F.lit(0).cast("long"))
    per_block = hits.withColumn("found", first).groupBy("conv_id", "block").agg(
        *[n(name).alias(f"_{name}") for name in (*LEVELS, "both", "line")], F.max("best").alias("_best"), F.min("found").alias("first")
    )
    count = {
        "n_exact": F.col("_raw"), "n_whitespace": F.col("_ws") - F.col("_raw"), "n_normalized": F.col("_syn") - F.col("_ws"),
        "n_fuzzy": F.col("_shape") - F.col("_both") + F.col("_line"),
    }
    counted = per_block.select("conv_id", "block", *[c.alias(name) for name, c in count.items()], "_best", (F.col("_shape") > F.col("_both")).alias("_shaped"), "first")
    best = F.greatest(
        F.when((F.col("n_exact") > 0) | F.col("_shaped"), 100.0),
        F.when(F.col("n_whitespace") > 0, 95.0),
        F.when(F.col("n_normalized") > 0, 85.0),
        F.col("_best"),
    )
    total = F.col("n_exact") + F.col("n_whitespace") + F.col("n_normalized") + F.col("n_fuzzy")
    return counted.select("conv_id", "block", *count, total.alias("n_matches"), best.alias("best_score"), "first")


def fuzzy_matches(blocks: DataFrame, snippets: DataFrame) -> DataFrame:
    """Blocks with fuzzy matches (score >= 70, syntax forms differ) and their number."""
    return match_blocks(blocks, snippets).where(F.col("n_fuzzy") > 0).select("conv_id", "block", "n_fuzzy")


def ranked_matches(blocks: DataFrame, snippets: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best matching snippets of every block, best score first, then earliest.

    Each digest keeps its first ``k`` snippets (for shapes of each of its first ``k`` + 1 syntax forms) before a
    block meets them, so a text that a whole conversation repeats adds ``k`` rows to a block.
    """
    own, others = _both_prepared(blocks, snippets)
    return _ranked(own, others, _fuzzy_pairs(own, others), k)


def _ranked(own: DataFrame, others: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    rows = _by_level(others, (*LEVELS, "line"), "turn", "snippet_no", "role", "raw", "ws", "syn")
    group, early = ["conv_id", "level", "key"], F.struct("turn", "snippet_no")
    in_form = W.partitionBy(*group, "syn")
    few = rows.withColumn("nth", F.row_number().over(in_form.orderBy("turn", "snippet_no"))).where(F.col("nth") <= k)
    few = few.withColumn("begins", F.min(early).over(in_form)).withColumn("form", F.dense_rank().over(W.partitionBy(*group).orderBy("begins", "syn")))
    few = few.where(F.col("form") <= k + 1).select(*group, "turn", "snippet_no", "role", *[F.col(c).alias(f"s_{c}") for c in ("raw", "ws", "syn")])
    asked = _by_level(own, LEVELS, "block", "raw", "ws", "syn")
    tier = F.when(F.col("s_raw") == F.col("raw"), "exact").when(F.col("s_ws") == F.col("ws"), "whitespace").when(F.col("s_syn") == F.col("syn"), "normalized")
    equal = asked.join(few.where("level <> 'line'"), group).withColumn("kind", F.coalesce(tier, F.lit("fuzzy")))
    found = equal.select("conv_id", "block", "turn", "snippet_no", "role", "kind", F.coalesce(_score(F.col("kind")), F.lit(100.0)).alias("score"))
    lines = few.where("level = 'line'").select("conv_id", F.col("key").alias("other"), "turn", "snippet_no", "role")
    fuzzy = pairs.join(lines, ["conv_id", "other"]).join(own.select("conv_id", "block", "line"), ["conv_id", "line"])
    found = found.distinct().unionByName(fuzzy.select("conv_id", "block", "turn", "snippet_no", "role", F.lit("fuzzy").alias("kind"), "score"))
    order = W.partitionBy("conv_id", "block").orderBy(F.desc("score"), "turn", "snippet_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def confidence(score: Column, exact_or_ws: Column, n_matches: Column) -> Column:
    tier = F.when(score >= 90, 0.4).when(score >= 80, 0.3).when(score >= 70, 0.2).when(score >= 60, 0.1).otherwise(0.0)
    value = 0.5 + tier + F.when(exact_or_ws, 0.1).otherwise(0.0) - F.when(n_matches > 3, 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)


def attribute_blocks(blocks: DataFrame, snippets: DataFrame, messages: DataFrame) -> DataFrame:
    """Label, confidence, reason and first appearance of every block."""
    return _attributed(match_blocks(blocks, snippets), blocks, messages)


def attribute_and_rank(blocks: DataFrame, snippets: DataFrame, messages: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """``attribute_blocks`` and ``ranked_matches`` of the same blocks: forms are made and pairs are found once for both."""
    own, others = _both_prepared(blocks, snippets)
    pairs = checkpointed(_fuzzy_pairs(own, others))
    return _attributed(_matched(own, others, pairs), blocks, messages), _ranked(own, others, pairs, k)


def _attributed(matched: DataFrame, blocks: DataFrame, messages: DataFrame) -> DataFrame:
    lines = line_labels_per_block(line_provenance(blocks, messages))
    text = messages.select("conv_id", F.col("turn").alias("prev_user_turn"), F.col("text").alias("prompt"))
    prev = previous_user_turn(messages).select("conv_id", F.col("turn").alias("first_turn"), "prev_user_turn")
    first = F.col("first")
    base = (
        matched.withColumn("first_turn", first["turn"])
        .join(blocks.select("conv_id", "block", "content"), ["conv_id", "block"])
        .join(lines, ["conv_id", "block"], "left")
        .join(prev, ["conv_id", "first_turn"], "left")
        .join(text, ["conv_id", "prev_user_turn"], "left")
    )
    none, by_user = first.isNull(), first["role"] == "user"
    echoed = ~none & ~by_user & F.coalesce(t.echoed_in(F.col("content"), F.col("prompt")), F.lit(False))
    match_label = F.when(by_user | echoed, PROMPT).otherwise(LLM)
    label = F.coalesce("line_label", F.when(none, HUMAN).otherwise(match_label))
    exact_or_ws = first["kind"].isin("exact", "whitespace")
    score = (
        F.when(none, 0.95)
        .when(echoed, 0.9)
        .otherwise(confidence(first["score"], exact_or_ws, F.col("n_matches")))
    )
    reason = (
        F.when(none, "not found in the conversation")
        .when(by_user, F.concat(F.lit("first seen in user message "), first["turn"]))
        .when(echoed, "taken from the user prompt before the reply")
        .otherwise(F.concat(F.lit("first seen in assistant message "), first["turn"]))
    )
    return base.select(
        "conv_id",
        "block",
        label.alias("label"),
        score.alias("confidence"),
        reason.alias("reason"),
        F.when(echoed, F.col("prev_user_turn")).otherwise(first["turn"]).alias("first_turn"),
        F.when(echoed, F.lit("user")).otherwise(first["role"]).alias("first_role"),
        first["score"].alias("first_score"),
        "best_score",
        "n_matches",
    )


def mixed_authorship(blocks: DataFrame, snippets: DataFrame, messages: DataFrame) -> DataFrame:
    """Blocks of two or more sections with at least one LLM and one human section."""
    from codelineage.operators.files import sections

    cut = blocks.withColumn("sections", sections(F.col("content"))).where(F.size("sections") >= 2)
    parts = cut.select("conv_id", "block", F.posexplode("sections").alias("section", "content"))
    keyed = parts.select("conv_id", F.concat_ws(":", "block", "section").alias("block"), "content")
    labels = attribute_blocks(keyed, snippets, messages).select("conv_id", "block", "label")
    owner = F.split_part("block", F.lit(":"), F.lit(1))
    return labels.groupBy("conv_id", owner.alias("block")).agg(
        F.count("*").alias("sections"),
        (F.bool_or(F.col("label") == LLM) & F.bool_or(F.col("label").isin(HUMAN, PROMPT))).alias("mixed"),
    )
