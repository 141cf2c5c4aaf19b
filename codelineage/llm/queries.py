"""The operators applied to the supplied tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelineage.llm import bpe, chat, jaccard, k2treap, kdtree, minhash, packing, pii, quality, repair, rlz, sql, toxicity, warc
from codelineage.llm.common import table
from codelineage.plans.base import Registry

R = Registry()


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@R.add("op1_quality_rules", sql.QUALITY)
def op1_quality_rules(spark, sf_dir):
    """Measurements and verdict of every document; ``failed_bits`` is the ledger entry."""
    entries = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = ~quality.passes(quality.BASE)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & quality.passes(quality.FULL)).alias("kept"),
        "failed_bits",
    )


@R.add("op2_bpe")
def op2_bpe(spark, sf_dir):
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_file("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@R.add("op3_jaccard_join", sql.JACCARD)
def op3_jaccard_join(spark, sf_dir):
    """Set size and link class of every document, four-word shingles and 85 % Jaccard similarity."""
    return jaccard.near_copies(table(spark, sf_dir, "documents"), rule=jaccard.Rule(words=4, num=85, den=100, lower=True))


@R.add("op4_packing")
def op4_packing(spark, sf_dir):
    """Every piece of every document with its place in a sequence."""
    packed = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))
    return packing.checksum(packed).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@R.add("op5_pii")
def op5_pii(spark, sf_dir):
    """Personal data of every document. The counts and ``base_sha256`` are of the rules' spans, ``spans`` has all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.learn(docs))
    count = lambda kind: F.size(F.filter(F.split("rule_spans", ","), lambda x: x.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2("rule_spans", 256).alias("base_sha256"), "spans")


@R.add("op6_substring_dedup", sql.REPEATS)
def op6_substring_dedup(spark, sf_dir):
    """Words of every document, those removed as repeats of smaller documents, and a digest of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rlz.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@R.add("op7_chat_format", sql.CHAT)
def op7_chat_format(spark, sf_dir):
    """Turns, loss text and length of every conversation, read back from its formatted turns."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    marks = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(probe)))


@R.add("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    """Score and prediction of every document; a third of the ids is held out from the fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@R.add("op9_warc", sql.WARC)
def op9_warc(spark, sf_dir):
    """Every page as its record reads after a round trip through the archives."""
    folder = warc.new_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest, folder, payloads=False).drop("url", "payload")


@R.add("op10_top_k", sql.TOP_K)
def op10_top_k(spark, sf_dir):
    """The 20 highest integer inner products of every twentieth vector."""
    points = kdtree.scaled(table(spark, sf_dir, "embeddings"))
    return kdtree.top_k(points, F.col("vec_id") % 20 == 0, 20)


@R.add("op11_structure_repair", sql.REPAIR)
def op11_structure_repair(spark, sf_dir):
    """Faults, cheapest edits and digest of every conversation after damage and repair."""
    rows = repair.turns(table(spark, sf_dir, "conversations"))
    return repair.repair(rows, repair.damage(rows))


@R.add("op12_ranked_search", sql.RANKED)
def op12_ranked_search(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    return k2treap.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


@R.add("op13_fingerprints")
def op13_fingerprints(spark, sf_dir):
    """Fingerprint of every document, of its edited text, and how alike they and the next document are."""
    pairs = minhash.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@R.add("pipeline")
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
