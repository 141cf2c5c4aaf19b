"""Mining changed functions from version histories.

``commits(repo, path, sha, author_date, message, list_pos)`` in the order the
host lists them (newest first), ``versions(repo, path, sha, content)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelineage.functions.pycode import extract_functions, mark_functions
from codelineage.session import checkpointed

# Cutoff and caps of the reference. Caps are arguments; without one nothing is cut.
CUTOFF = "2022-12-31 23:59:59"
FILES_PER_REPO = 200
COMMITS_PER_FILE = 50
MAX_FILE_BYTES = 750_000
VALID_FILES = 5
TARGET_REPOS = 1000


def repo_rules(repos: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    off = lambda c: F.coalesce(~F.col(c), F.lit(True))
    return repos.where(
        off("private") & off("archived") & off("fork")
        & (F.col("created_at") <= F.lit(cutoff).cast("timestamp")) & (F.col("language") == "Python")
    )


def _up_to(rows: DataFrame, cap: int | None) -> DataFrame:
    return rows if cap is None else rows.where(F.col("nth") <= cap)


def file_cap(files: DataFrame, cap: int | None = None) -> DataFrame:
    """Python blobs, all or the first ``cap`` per repository in tree order (cut before the shuffle by the rank filter)."""
    nth = F.row_number().over(W.partitionBy("repo").orderBy("tree_pos"))
    blobs = files.where((F.col("type") == "blob") & F.col("path").endswith(".py"))
    return _up_to(blobs.withColumn("nth", nth), cap)


def decoded(versions: DataFrame, encoded: str = "content_b64", limit: int | None = None) -> DataFrame:
    """Base64 content as text; absent, empty, non-UTF-8 versions and those over ``limit`` bytes have none."""
    raw = F.unbase64(encoded)
    fits = F.octet_length(raw) >= 1 if limit is None else F.octet_length(raw).between(1, limit)
    return versions.withColumn("content", F.when(fits, F.try_validate_utf8(raw.cast("string"))))


def considered_commits(commits: DataFrame, cutoff: str = CUTOFF, cap: int | None = None) -> DataFrame:
    """Commits up to the cutoff, all or the first ``cap`` per file in list order."""
    order = W.partitionBy("repo", "path").orderBy("list_pos")
    until = commits.where(F.col("author_date") <= F.lit(cutoff).cast("timestamp"))
    return _up_to(until.withColumn("nth", F.row_number().over(order)), cap)


FILE = ["repo", "path"]


def changed_names(commits: DataFrame, versions: DataFrame) -> DataFrame:
    """Names of the functions whose body changed in each file's latest valid adjacent pair of commits.

    Versions are parsed where they are read; a row per function with the digest of its
    body is all that is shuffled and sorted. A function is laid side by side with its next older
    version; the rank filter keeps the newest changed pair of each file before the shuffle.
    """
    marked = versions.where(F.col("content").isNotNull()).select(*FILE, "sha", mark_functions(F.col("content")).alias("found"))
    numbered = commits.select(*FILE, "sha", "nth").join(marked, [*FILE, "sha"])
    one = numbered.select(*FILE, "nth", "sha", F.inline("found"))
    older = W.partitionBy(*FILE, "name").orderBy("nth")
    pairs = one.withColumn("old", F.lead(F.struct("nth", "sha", "mark")).over(older)).where(
        (F.col("old.nth") == F.col("nth") + 1) & (F.col("old.mark") != F.col("mark"))
    )
    changed = pairs.select(*FILE, F.col("name").alias("function_name"), F.col("nth").alias("pair"), F.col("old.sha").alias("old_sha"), F.col("sha").alias("new_sha"))
    newest = F.rank().over(W.partitionBy(*FILE).orderBy("pair"))
    return changed.withColumn("place", newest).where("place = 1").drop("place")


def _beside(changed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """What ``found`` has of both versions beside the changed functions: one join for the two of them."""
    sides, given = ("old", "new"), [c for c in found.columns if c not in keys]
    each = changed.select("*", F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_sha").alias("sha")) for side in sides])))
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct(*given))).alias(f"_{side}")
    both = each.join(found, keys).groupBy(*changed.columns).agg(*[of(side) for side in sides]).where("_old is not null and _new is not null")
    return both.select(*changed.columns, *[F.col(f"_{side}.{c}").alias(f"{side}_{c}") for side in sides for c in given])


def with_commits(changed: DataFrame, commits: DataFrame) -> DataFrame:
    """Date and message of both commits beside the changed functions."""
    return _beside(changed, commits.select(*FILE, "sha", "author_date", "message"), [*FILE, "sha"])


def with_code(changed: DataFrame, versions: DataFrame) -> DataFrame:
    """Code and lines of both versions beside the changed functions; only the versions of picked pairs are parsed again, once.

    The changed functions (names and digests, no code) are kept, since they pick the versions and take their code.
    """
    changed = checkpointed(changed)
    shas = changed.select(*FILE, F.explode(F.array("old_sha", "new_sha")).alias("sha")).distinct()
    texts = versions.join(shas, [*FILE, "sha"], "left_semi").select(*FILE, "sha", extract_functions(F.col("content")).alias("found"))
    one = texts.select(*FILE, "sha", F.inline("found")).select(*FILE, "sha", F.col("name").alias("function_name"), "code", "start_line", "end_line")
    return _beside(changed, one, [*FILE, "sha", "function_name"])


def changed_functions(commits: DataFrame, versions: DataFrame) -> DataFrame:
    """Functions whose body changed in each file's latest valid adjacent pair, with commits and code."""
    found = with_code(with_commits(changed_names(commits, versions), commits), versions)
    both = [f"{side}_{c}" for c in ("sha", "author_date", "message", "code", "start_line", "end_line") for side in ("old", "new")]
    return found.select(*FILE, "function_name", *both, "pair")


def changed_files(functions: DataFrame) -> DataFrame:
    """One row per file with its commit pair (dates and messages, where given) and number of changed functions."""
    both = [f"{side}_{c}" for c in ("sha", "author_date", "message") for side in ("old", "new")]
    return functions.groupBy(*FILE, *[c for c in both if c in functions.columns]).agg(F.count("*").alias("changed_functions"))


def valid_files_cap(changed: DataFrame, files: DataFrame, need: int | None = None) -> DataFrame:
    """Valid files per repository in tree order: all, or the first ``need``, and repositories with fewer are dropped."""
    placed = changed.join(files.select("repo", "path", "tree_pos"), ["repo", "path"])
    nth = F.row_number().over(W.partitionBy("repo").orderBy("tree_pos"))
    first = _up_to(placed.withColumn("nth", nth), need)
    full = first.groupBy("repo").agg(F.count("*").alias("valid_files")).where(F.col("valid_files") >= (need or 1))
    return first.join(full, "repo")


def repo_rank(repos: DataFrame, valid: DataFrame, target: int = TARGET_REPOS) -> DataFrame:
    """Selected repositories ranked by stars; the rank filter keeps ``target`` rows per task before the final sort."""
    kept = repos.join(valid.groupBy("repo").agg(F.max("valid_files").alias("valid_files")), "repo")
    rank = F.row_number().over(W.orderBy(F.desc("stars"), "repo"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= target)


def function_ids(ranked: DataFrame, valid: DataFrame, functions: DataFrame) -> DataFrame:
    """``function_<n>`` in rank, file and source order.

    Counts per ranked repository (at most the target number) give offsets;
    rows are numbered inside their repository only.
    """
    rows = (
        functions.join(valid.select("repo", "path", "tree_pos"), ["repo", "path"])
        .join(ranked.select("repo", "rank"), "repo")
    )
    before = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("repo", "rank").agg(F.count("*").alias("n")).select(
        "repo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = F.row_number().over(W.partitionBy("repo").orderBy("tree_pos", "old_start_line", "function_name"))
    number = F.col("offset") + F.col("local")
    return rows.withColumn("local", inside).join(offsets, "repo").select(
        F.concat(F.lit("function_"), number).alias("id"), "repo", "path", "function_name", "old_sha", "new_sha", "rank",
        F.lit("function_body_updated").alias("change_type"),
    )
