"""Controlled code mutations: a grid of sources and rules, one seeded edit each.

The parser helper says what stands where in a function. Every rule is an expression over
these facts that gives its options; the pick by a seeded index, splicing, request text, status,
checks, quotas and audits are DataFrame work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelineage.functions.ordering import hash_rank, seeded_indices, stable_digest
from codelineage.functions.pycode import FACT, check_edits, parse_info, syntax_facts
from codelineage.functions.text import normalize_code
from codelineage.session import checkpointed

# Mutation rules, the requirement category of each, and the instruction it is described by.
RULES = {
    "modify_docstring_text": "documentation_edit",
    "remove_output_statement": "statement_removal",
    "replace_literal_value": "literal_path_url_or_config",
    "modify_return_expression": "return_statement_edit",
    "modify_comparison_operator": "condition_or_comparison_edit",
    "modify_exception_handler": "exception_handling_edit",
    "modernize_string_formatting": "string_formatting_edit",
    "modify_type_annotation": "type_annotation_edit",
    "modernize_super_call": "super_call_modernization",
    "rename_local_identifier": "identifier_rename",
}
INSTRUCTIONS = {
    "modify_docstring_text": "update the function docstring text",
    "remove_output_statement": "remove the standalone output statement",
    "replace_literal_value": "replace the selected literal value",
    "modify_return_expression": "replace the return expression",
    "modify_comparison_operator": "modify one comparison operator",
    "modify_exception_handler": "modify the exception handler type",
    "modernize_string_formatting": "convert the selected f-string to equivalent .format syntax",
    "modify_type_annotation": "add a built-in type annotation to the parameter",
    "modernize_super_call": "modernize the explicit super call",
    "rename_local_identifier": "rename the selected local identifier consistently",
}
# Tag of the seed of the pick, the sentence added to docstrings, comparisons and their counterparts.
EDIT_TAG = "fusion-guided-v1"
SENTENCE = " Synthetic clarification added."
FLIPS = [("<", "<="), (">", ">="), ("==", "!="), ("is", "is not"), ("in", "not in")]
DELIMITERS = ("<before>", "</before>", "<after>", "</after>")
REQUEST = (
    "In the old function, %s at function line %d, column %d. "
    "Change the exact fragment <before>%s</before> to <after>%s</after>. "
    "Leave everything else unchanged."
)


def _from(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)


def cohort_grid(sources: DataFrame) -> DataFrame:
    """Every source with every rule, by exploding the ten rule names."""
    return sources.withColumn("mutation_operator", F.explode(F.array(*[F.lit(r) for r in RULES])))


def splice(code: Column, edits: Column) -> Column:
    """Replace character spans, given in text order."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    return F.aggregate(
        edits,
        start,
        lambda acc, e: F.struct(
            F.concat(acc["text"], F.substr(code, acc["at"] + 1, e["start"] - acc["at"]), e["text"]).alias("text"),
            e["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["text"], F.substr(code, acc["at"] + 1)),
    )


def is_faithful(requirement: Column, old: Column, new: Column) -> Column:
    """Each delimiter occurs once and both fragments are embedded exactly."""
    clean = F.lit(True)
    for d in DELIMITERS:
        once = F.length(requirement) - F.length(F.replace(requirement, F.lit(d), F.lit(""))) == len(d)
        clean = clean & ~F.contains(old, F.lit(d)) & ~F.contains(new, F.lit(d)) & once
    embedded = lambda tag, x: F.contains(requirement, F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")))
    return clean & embedded("before", old) & embedded("after", new)


def _option(fact: Column, old: Column, new: Column, edits: Column | None = None) -> Column:
    whole = F.array(_edit(fact, new)) if edits is None else edits
    return F.struct(fact["line"].alias("line"), fact["column"].alias("column"), old.alias("old"), new.alias("new"), whole.alias("edits"))


def _edit(fact: Column, text: Column) -> Column:
    return F.struct(fact["start"].alias("start"), fact["end"].alias("end"), text.alias("text"))


def _has(fact: Column, mark: str) -> Column:
    return F.array_contains(fact["marks"], mark)


def _docstrings(facts):
    new = lambda f: F.concat(F.substr(f["parts"][0], F.lit(1), F.length(f["parts"][0]) - 1), F.lit(SENTENCE), F.right(f["parts"][0], F.lit(1)))
    return F.transform(F.filter(facts("docstring"), lambda f: ~_has(f, "blank")), lambda f: _option(f, f["shown"], new(f)))


def _outputs(facts):
    said = lambda f: F.when(_has(f, "dotted"), f["parts"][0] == "debug").otherwise(f["parts"][0] == "print")
    gone = lambda f: _option(f, f["shown"], F.lit("<deleted>"), F.array(_edit(f, F.lit(""))))
    return F.transform(F.filter(facts("statement"), lambda f: said(f) & ~_has(f, "alone")), gone)


def _literals(facts):
    return F.transform(facts("number"), lambda f: _option(f, f["shown"], f["parts"][0]))


def _returns(facts):
    return F.transform(F.filter(facts("return"), lambda f: ~_has(f, "none")), lambda f: _option(f, f["shown"], F.lit("None")))


def _comparisons(facts):
    """An option for every operator of a comparison that has a counterpart."""
    other = lambda op: F.try_element_at(F.create_map(*[F.lit(x) for a, b in FLIPS for x in (a, b, b, a)]), op)

    def each(f):
        places = F.filter(F.sequence(F.lit(1), F.size(f["parts"]) - 1, F.lit(2)), lambda i: other(F.get(f["parts"], i)).isNotNull())
        new = lambda i: F.array_join(F.transform(f["parts"], lambda p, j: F.when(j == i, other(p)).otherwise(p)), " ")
        return F.transform(places, lambda i: _option(f, f["shown"], new(i)))

    return F.flatten(F.transform(facts("comparison"), each))


def _handlers(facts):
    bare = lambda f: f["shown"].isNull()
    old = lambda f: F.concat_ws(" ", F.lit("except"), f["shown"])
    text = lambda f: F.when(bare(f), "except Exception").otherwise("Exception")
    chosen = F.filter(facts("handler"), lambda f: bare(f) | (f["shown"] != "Exception"))
    return F.transform(chosen, lambda f: _option(f, old(f), F.lit("except Exception"), F.array(_edit(f, text(f)))))


def _formats(facts):
    """A computed format specification is an f-string too, but cannot become a call: picking it changes nothing."""
    new = lambda f: F.concat(f["parts"][0], F.lit(".format("), F.array_join(F.slice(f["parts"], 2, F.size(f["parts"])), ", "), F.lit(")"))
    none = F.expr("cast(array() AS array<struct<start:int,end:int,text:string>>)")
    edits = lambda f: F.when(_has(f, "specification"), none).otherwise(F.array(_edit(f, new(f))))
    return F.transform(F.filter(facts("template"), lambda f: _has(f, "plain")), lambda f: _option(f, f["shown"], new(f), edits(f)))


def _annotations(facts):
    free = F.filter(facts("parameter"), lambda f: ~_has(f, "annotated") & ~f["shown"].isin("self", "cls"))
    return F.transform(free, lambda f: _option(f, f["shown"], F.concat(f["shown"], F.lit(": object"))))


def _supers(facts):
    explicit = lambda f: (F.size(f["parts"]) == 2) & (F.get(f["parts"], F.lit(0)) != "") & F.get(f["parts"], F.lit(1)).isin("self", "cls") & ~_has(f, "keywords")
    return F.transform(F.filter(facts("super"), explicit), lambda f: _option(f, f["shown"], F.lit("super()")))


def _renames(facts):
    """Names stored in the function's own scope, less those used in a nested one and those whose new name is taken."""
    names = facts("name")
    said = lambda keep: F.transform(F.filter(names, keep), lambda f: f["shown"])
    own, stored, nested = said(lambda f: _has(f, "own")), said(lambda f: _has(f, "own") & _has(f, "stored")), said(lambda f: _has(f, "nested"))
    safe = F.array_except(stored, F.concat(nested, F.array(F.lit("self"), F.lit("cls"))))
    new = lambda old: F.concat(old, F.lit("_updated"))
    free = F.array_sort(F.filter(safe, lambda old: ~old.startswith("__") & ~F.array_contains(own, new(old))))

    def each(old):
        uses = F.filter(names, lambda f: f["shown"] == old)
        first = F.filter(uses, lambda f: _has(f, "stored"))[0]
        return _option(first, old, new(old), F.array_sort(F.transform(uses, lambda f: _edit(f, new(old)))))

    return F.transform(free, each)


# Each rule gives its options, in the order of the facts, as an expression over them.
OPTIONS = dict(zip(RULES, (_docstrings, _outputs, _literals, _returns, _comparisons, _handlers, _formats, _annotations, _supers, _renames)))
LIMITED = ("modify_docstring_text", "remove_output_statement", "replace_literal_value", "modify_return_expression", "modify_comparison_operator", "modernize_string_formatting")


def _with_options(sources: DataFrame, longest: int | None, rules: Sequence[str] = tuple(RULES)) -> DataFrame:
    """The canonical text (null unless it is a module), and an array of options per rule."""
    info = sources.withColumn("_code", normalize_code(F.col("code"))).withColumn("_info", parse_info(F.col("_code")))
    # Only whole modules count here; a bare function body is a failure.
    first = info.withColumn("old_code", F.when(F.col("_info.mode") == "module", F.col("_info.canonical"))).withColumn(
        "_facts", F.coalesce(syntax_facts(F.col("old_code")), F.expr(f"cast(array() AS array<{FACT}>)"))
    )
    facts = lambda kind: F.filter("_facts", lambda f: f["kind"] == kind)

    def options(rule):
        found = OPTIONS[rule](facts)
        return found if longest is None or rule not in LIMITED else F.filter(found, lambda o: F.length(o["old"]) <= longest)

    return first.withColumn("_options", F.array(*[options(rule) for rule in rules])).drop("_facts")


def mutation_candidates(sources: DataFrame, longest: int | None = None) -> DataFrame:
    """Every option of every rule as a row: (source_index, split, mutation_operator, nth, line, column, old, new, edits)."""
    named = F.arrays_zip(F.array(*[F.lit(r) for r in RULES]).alias("rule"), F.col("_options").alias("options"))
    rules = _with_options(sources, longest).select("source_index", "split", F.explode(named).alias("r"))
    each = rules.select("source_index", "split", F.col("r.rule").alias("mutation_operator"), F.posexplode("r.options").alias("nth", "o"))
    return each.select("source_index", "split", "mutation_operator", (F.col("nth") + 1).alias("nth"), "o.*")


def mutate(
    sources: DataFrame, prefix: str = "fgm_cohort_v1", longest: int | None = None, rules: Sequence[str] = tuple(RULES), texts: bool = True
) -> DataFrame:
    """All (source, rule) attempts with status valid, inapplicable or failed.

    ``sources(source_index, split, code)``. The text is brought to its canonical form and
    parsed into facts; options, length limit (``longest`` characters of the old fragment, where given),
    pick, splice and request are expressions over them. The edited texts of a source are parsed together, so only
    finished rows are multiplied by the rules. ``rules`` names those to attempt, each as it is among all ten; without ``texts`` the edited texts are
    checked only, and ``expected_mutated_function`` is left out.
    """
    seed = lambda rule: F.substring(F.sha2(F.concat(F.lit(f"{EDIT_TAG}\0{rule}\0"), F.coalesce("old_code", F.lit(""))), 256), 1, 16)
    ready = _with_options(sources, longest, rules)
    sizes = F.transform("_options", lambda o: F.size(o))
    picked = ready.withColumn("_pick", seeded_indices(F.array(*[seed(rule) for rule in rules]), sizes))
    chosen = F.zip_with("_options", "_pick", lambda options, i: F.get(options, i))
    edited = picked.withColumn("_edit", chosen).drop("_options").withColumn(
        "_check", check_edits(F.col("_code"), F.transform("_edit", lambda e: F.when(e.isNotNull(), splice(F.col("old_code"), e["edits"]))), texts)
    )
    zipped = F.arrays_zip(F.array(*[F.lit(r) for r in rules]).alias("rule"), F.col("_edit").alias("edit"), F.col("_check").alias("check"))
    grid = edited.withColumn("_row", F.explode(zipped))
    rule, edit, check = F.col("_row.rule"), F.col("_row.edit"), F.col("_row.check")
    valid = edit.isNotNull() & check["changed"]
    status = F.when(F.col("old_code").isNull(), "failed").when(valid, "valid").otherwise("inapplicable")
    keep = lambda c: F.when(F.col("status") == "valid", c)
    request = F.format_string(REQUEST, _from(INSTRUCTIONS, rule), edit["line"], edit["column"], edit["old"], edit["new"])
    return grid.withColumn("status", status).select(
        F.concat_ws("_", F.lit(prefix), "split", "source_index", rule).alias("id"),
        "source_index",
        F.col("split").alias("source_split"),
        rule.alias("mutation_operator"),
        _from(RULES, rule).alias("taxonomy_category"),
        "status",
        F.coalesce("_info.error", F.when(F.col("status") == "failed", "not a module")).alias("reason"),
        "old_code",
        *([keep(check["canonical"]).alias("expected_mutated_function")] if texts else []),
        keep(request).alias("requirement"),
        keep(edit["old"]).alias("old_fragment"),
        keep(edit["new"]).alias("new_fragment"),
        keep(F.struct(edit["line"].alias("line"), edit["column"].alias("column"))).alias("mutation_location"),
    )


def cohort_audit(attempts: DataFrame) -> DataFrame:
    """Attempts, valid, inapplicable and failed per rule."""
    n = lambda s: F.count_if(F.col("status") == s)
    return attempts.groupBy("mutation_operator").agg(
        F.count("*").alias("attempts"), n("valid").alias("valid"), n("inapplicable").alias("inapplicable"), n("failed").alias("failed")
    )


def mutations_per_source(attempts: DataFrame) -> DataFrame:
    """How many sources have how many valid mutations."""
    per = attempts.groupBy("source_index").agg(F.count_if(F.col("status") == "valid").alias("mutations"))
    return per.groupBy("mutations").agg(F.count("*").alias("sources"))


def with_support(attempts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Attach how many retained requirements support each rule's category (0 marks an unsupported rule)."""
    kept = taxonomy.where(F.col("author_decision").isin("accept", "correct"))
    counts = kept.groupBy(F.col("author_final_category").alias("taxonomy_category")).agg(F.count("*").alias("support"))
    return attempts.join(counts, "taxonomy_category", "left").fillna(0, ["support"])


def mutation_quota(attempts: DataFrame, per_split: dict[str, int], seed: int) -> DataFrame:
    """The first ``quota`` valid mutations per (split, rule) in hash order, and the shortfall per group."""
    digest = stable_digest("mutation-quota-v1", seed, F.col("source_split"), F.col("mutation_operator"), F.col("source_index"))
    # Ranking reads the rows twice, so the mutated code is kept instead of being made again.
    valid = checkpointed(attempts.where(F.col("status") == "valid").withColumn("_digest", digest))
    ranked = hash_rank(valid, ["source_split", "mutation_operator"], "_digest", "id")
    quota = F.try_element_at(F.create_map(*[x for k, v in per_split.items() for x in (F.lit(k), F.lit(v))]), F.col("source_split"))
    return ranked.withColumn("quota", quota).where(F.col("rank") <= F.col("quota")).drop("_digest")


def shortfall(attempts: DataFrame, picked: DataFrame, per_split: dict[str, int]) -> DataFrame:
    """Groups that did not reach their quota."""
    groups = attempts.select("source_split", "mutation_operator").distinct()
    got = picked.groupBy("source_split", "mutation_operator").agg(F.count("*").alias("got"))
    quota = F.try_element_at(F.create_map(*[x for k, v in per_split.items() for x in (F.lit(k), F.lit(v))]), F.col("source_split"))
    return (
        groups.join(got, ["source_split", "mutation_operator"], "left")
        .fillna(0, ["got"])
        .withColumn("missing", quota - F.col("got"))
        .where(F.col("missing") > 0)
    )
