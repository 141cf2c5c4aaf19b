"""Column functions over text and code: normalisation, line and token similarity.

Every function maps columns to columns with built-in expressions, so the work
stays in the JVM. Word classes are ASCII and the whitespace class is the
ECMAScript one, because labels depend on that exact definition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelineage.functions.edits import edit_distance

# Whitespace class and identifier / token / number patterns.
BLANKS = r" \t\n\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{BLANKS}]"
BLANK_CHARACTERS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# The look back comes behind the first character: in front it would be tried at every one of a text.
IDENTIFIER = r"[A-Za-z_](?<![A-Za-z0-9_][A-Za-z_])[A-Za-z0-9_]*"
NUMBER = r"[0-9](?<![A-Za-z0-9_][0-9])[0-9]*(?![A-Za-z0-9_])"
TOKEN = rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{BLANKS}]"
TAG_LINE = r"(?i)(@Authorship:|\[AUTHORSHIP:)"
STRUCTURE_WORDS = ("if", "for", "while", "return", "function", "def", "class")
# Keywords that keep their spelling in a code shape.
SHAPE_KEYWORDS = (
    "def", "class", "if", "else", "elif", "for", "while", "return", "import", "from", "as", "with", "try", "except", "finally",
    "pass", "break", "continue", "function", "const", "let", "var", "async", "await",
)


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARACTERS))


def squeeze(c: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed.

    A run that is one blank already stays, and the wide class is tried behind a look at one range only: it costs far more per character.
    """
    return F.trim(F.regexp_replace(c, f"(?=[^!-~])(?: {WS}+|[{BLANKS[1:]}]{WS}*)", " "))


def norm_ws(c: Column) -> Column:
    return squeeze(c)


def norm_line(c: Column) -> Column:
    return F.lower(squeeze(c))


def norm_syntax(c: Column) -> Column:
    """Comments dropped, identifiers / strings / numbers replaced.

    The text is one line after ``norm_ws``, so a comment marker removes
    everything behind it, and keywords count as identifiers.
    """
    steps = (
        ("(?s)//.*", ""),
        (r"(?s)/\*.*?\*/", ""),
        ("(?s)#.*", ""),
        (IDENTIFIER, "VAR"),
        (f"VAR{WS}*:", "VAR:"),
        ("'[^']*'", '"STR"'),
        ('"[^"]*"', '"STR"'),
        ("`[^`]*`", '"STR"'),
        (NUMBER, "NUM"),
    )
    return reduce(lambda col, step: F.regexp_replace(col, step[0], step[1]), steps, norm_ws(c))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda in ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def split_lines(c: Column) -> Column:
    return F.split(c, "\n")


def trimmed_lines(c: Column) -> Column:
    """Trimmed lines without the blank ones."""
    return F.filter(F.transform(split_lines(c), js_trim), lambda x: F.length(x) > 0)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), 0)


def line_shape(c: Column) -> Column:
    return F.regexp_replace(c, IDENTIFIER, "VAR")


def token_similarity(a: Column, b: Column) -> Column:
    """Share of equal tokens at equal positions, over the longer list."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda m: m))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(equal / F.greatest(F.size(a), F.size(b)))
    )


def line_features(c: Column) -> Column:
    """Array of (squeezed text, shape, tokens) per non-blank line."""
    return F.transform(
        trimmed_lines(c),
        lambda x: F.struct(norm_ws(x).alias("ws"), line_shape(x).alias("shape"), tokens(x).alias("tokens")),
    )


def features_similar(x: Column, y: Column) -> Column:
    return (x["ws"] == y["ws"]) | (x["shape"] == y["shape"]) | (token_similarity(x["tokens"], y["tokens"]) > 0.7)


def fuzzy_score(a: Column, b: Column) -> Column:
    """Similar lines by position over the longer block, times 100."""
    hits = F.size(
        F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(features_similar(x, y), F.lit(False))), lambda m: m)
    )
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(100.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(hits / F.greatest(F.size(a), F.size(b)) * 100)
    )


def fuzzy_lines(a: Column, b: Column) -> Column:
    return fuzzy_score(line_features(a), line_features(b))


def structural_score(a: Column, b: Column) -> Column:
    """Average of control-word, line-count and operator-count closeness.

    Kept for reporting: each term is at most 30, so it never reaches a match.
    """
    score, checks = F.lit(0.0), F.lit(0)
    for word in STRUCTURE_WORDS:
        pattern = F.lit(f"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")
        n1, n2 = F.regexp_count(a, pattern), F.regexp_count(b, pattern)
        used = (n1 > 0) | (n2 > 0)
        score = score + F.when(used, F.greatest(F.lit(0), 10 - F.abs(n1 - n2))).otherwise(0)
        checks = checks + F.when(used, 1).otherwise(0)
    l1, l2 = F.size(split_lines(a)), F.size(split_lines(b))
    score = score + (1 - F.abs(l1 - l2) / F.greatest(l1, l2)) * 30
    checks = checks + 1
    operators = F.lit(r"[+\-*/=<>!&|]")
    o1, o2 = F.regexp_count(a, operators), F.regexp_count(b, operators)
    used = (o1 > 0) | (o2 > 0)
    score = score + F.when(used, (1 - F.abs(o1 - o2) / F.greatest(o1, o2) / 2) * 30).otherwise(0.0)
    checks = checks + F.when(used, 1).otherwise(0)
    return score / checks


def share_of_lines_in(target: Column, text: Column) -> Column:
    """Share of the target's non-blank trimmed lines found among the text's lines."""
    wanted = trimmed_lines(target)
    have = F.transform(split_lines(text), js_trim)
    found = F.size(F.filter(wanted, lambda x: F.array_contains(have, x)))
    return F.try_divide(found, F.size(wanted))


def partial_match(target: Column, full: Column) -> Column:
    return F.contains(full, target) | F.coalesce(share_of_lines_in(target, full) > 0.7, F.lit(False))


def echoed_in(target: Column, message: Column) -> Column:
    """The message holds the code raw, squeezed, or more than 70 % of its lines."""
    return (
        F.contains(message, target)
        | F.contains(norm_line(message), norm_line(target))
        | F.coalesce(share_of_lines_in(target, message) > 0.7, F.lit(False))
    )


def line_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(trimmed_lines(a)), F.array_distinct(trimmed_lines(b))
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0))
        .when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    )


def bounded_levenshtein(a: Column, b: Column, gap: int | None = None) -> Column:
    """Edit distance; texts whose lengths differ by more than ``gap``, where given, count as wholly different."""
    distance = F.levenshtein(a, b)
    if gap is None:
        return distance
    return F.when(F.abs(F.length(a) - F.length(b)) > gap, F.greatest(F.length(a), F.length(b))).otherwise(distance)


def word_overlap(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, f"{WS}+")), F.array_distinct(F.split(b, f"{WS}+"))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))


def significant_lines(c: Column) -> Column:
    """Squeezed lower-case lines that are neither blank nor comment or docstring openers."""
    return F.transform(F.filter(trimmed_lines(c), lambda x: ~x.rlike("^(#|//|\"\"\"|''')")), norm_line)


def subset_match(a: Column, b: Column) -> Column:
    x, y = significant_lines(a), significant_lines(b)
    hit = F.size(F.filter(x, lambda l: F.exists(y, lambda r: F.contains(r, l) | F.contains(l, r))))
    return (F.size(x) > 0) & (F.size(y) > 0) & F.coalesce(F.try_divide(hit, F.size(x)) >= 0.9, F.lit(False))


def code_shape(c: Column) -> Column:
    """Literals emptied, words that do not start with a keyword become ``id``."""
    keep = "|".join(SHAPE_KEYWORDS)
    words = rf"(?<![A-Za-z0-9_])(?!{keep})[A-Za-z0-9_]+"
    c = F.regexp_replace(F.regexp_replace(c, '"[^"]*"', '""'), "'[^']*'", "''")
    return F.lower(squeeze(F.regexp_replace(c, words, "ID")))


def shape_ratio(x: Column, y: Column, gap: int | None = None) -> Column:
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return (
        F.when(x == y, F.lit(1.0))
        .when(F.contains(x, y) | F.contains(y, x), short / long)
        .otherwise(1 - bounded_levenshtein(x, y, gap) / long)
    )


def shape_similarity(a: Column, b: Column, gap: int | None = None) -> Column:
    return shape_ratio(code_shape(a), code_shape(b), gap)


def edit_similarity(df: DataFrame, name: str, asked: Column, x: Column, y: Column, floor: float = 0.0, gap: int | None = None) -> DataFrame:
    """Add 1 - distance / longer length where ``asked``, 0 where it is below ``floor``; null elsewhere.

    Texts whose lengths differ by more than ``gap``, where given, count as wholly different.
    """
    apart, long = F.abs(F.length(x) - F.length(y)), F.greatest(F.length(x), F.length(y))
    limit = F.ceil(long * (1 - floor)).cast("int") if floor else long
    far = apart > limit if gap is None else (apart > gap) | (apart > limit)
    told = df.withColumn("_told", F.when(asked, F.when(far, 0).otherwise(1)))
    counted = F.col("_told") == 1
    distance = F.col("_distance")
    return (
        told.withColumn("_distance", edit_distance(F.when(counted, x), F.when(counted, y), F.when(counted, limit)))
        .withColumn(name, F.when(F.col("_told") == 0, 0.0).when(counted, F.when(distance < 0, 0.0).otherwise(1 - distance / long)))
        .drop("_told", "_distance")
    )


COMMENT = "^(#|//|\"\"\"|''')"
BAG = " etaoinsr(=_"
SHAPES_MIN = 0.9


def chat_form(c: Column, terms: bool = False) -> Column:
    """What the chat similarity needs of one text: squeezed text, shape, lengths, number of different words, counts of some characters;
    with ``terms`` the words too, for texts that meet many others of quite another length."""
    x, shape = norm_line(c), code_shape(c)
    count = lambda text, ch: F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    listed = lambda f: [f["terms"].alias("terms")] if terms else []
    return F.transform(
        F.array(F.struct(x.alias("x"), shape.alias("sx"), F.array_distinct(F.split(x, f"{WS}+")).alias("terms"))),
        lambda f: F.struct(
            f["x"].alias("x"), f["sx"].alias("sx"), F.length(f["x"]).alias("n"), F.length(f["sx"]).alias("sn"),
            F.size(f["terms"]).alias("words"), F.array(*[count(f["x"], ch) for ch in BAG]).alias("bag"), *listed(f),
        ),
    )[0]


def may_be_similar(a: Column, b: Column, floor: float) -> Column:
    """False only where the chat similarity of two forms cannot exceed ``floor`` (0.5 or more).

    Short texts must be equal; else one text holds the other, or the shapes are as long as a similarity of
    0.9 asks for, or the lengths and the character counts leave room for the edit distance, or, for lengths
    not within half, the numbers of different words for the overlap.
    """
    short, long = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    lacks = lambda p, q: F.aggregate(F.zip_with(p["bag"], q["bag"], lambda i, j: F.greatest(i - j, F.lit(0))), F.lit(0), lambda n, d: n + d)
    room = long * (1 - floor)
    edits = (long - short < room) & (lacks(a, b) < room) & (lacks(b, a) < room)
    overlap = (short * 2 <= long) & (F.least(a["words"], b["words"]) > F.greatest(a["words"], b["words"]) * floor)
    shapes = F.least(a["sn"], b["sn"]) >= F.greatest(a["sn"], b["sn"]) * SHAPES_MIN
    inside = F.contains(a["x"], b["x"]) | F.contains(b["x"], a["x"])
    return F.when(short < 20, a["x"] == b["x"]).otherwise(shapes | edits | overlap | inside)


def form_similarity(
    df: DataFrame, a: str, b: str, name: str = "similarity", floor: float = 0.0, gap: int | None = None, terms: bool = False
) -> DataFrame:
    """Add the similarity of two texts given by their forms; texts under 20 characters must be equal.

    Otherwise, in order: containment of a text that is not a comment counts 1, then shapes above 0.9, containment by
    length, edit distance when the lengths are within half, and word overlap. Edit similarities below ``floor`` read as
    0. The steps are separate columns, so each is computed once, and the edit distances only where they decide.
    """
    x, y, sx, sy = F.col(a)["x"], F.col(b)["x"], F.col(a)["sx"], F.col(b)["sx"]
    short, long = F.least(F.col(a)["n"], F.col(b)["n"]), F.greatest(F.col(a)["n"], F.col(b)["n"])
    within = F.contains(x, y) | F.contains(y, x)
    ratio_of = lambda p, q: F.least(F.length(p), F.length(q)) / F.greatest(F.length(p), F.length(q))
    # Squeezed texts are one line, so "90 % of the significant lines" is containment of that line.
    known = F.when(short < 20, (x == y).cast("double")).when(within & ~x.rlike(COMMENT) & ~y.rlike(COMMENT), F.lit(1.0))
    shape = F.when(sx == sy, F.lit(1.0)).when(F.contains(sx, sy) | F.contains(sy, sx), ratio_of(sx, sy))
    overlap = F.size(F.array_intersect(F.col(a)["terms"], F.col(b)["terms"])) / F.greatest(F.col(a)["words"], F.col(b)["words"]) if terms else word_overlap(x, y)
    known_as = df.withColumn("_known", known).withColumn("_shape", F.when(F.col("_known").isNull(), shape))
    shaped = edit_similarity(known_as, "_shape_edits", F.col("_known").isNull() & F.col("_shape").isNull(), sx, sy, SHAPES_MIN, gap)
    shaped = shaped.withColumn("_shape", F.coalesce("_shape", "_shape_edits")).withColumn(
        "_ratio", F.when(F.col("_known").isNull() & ~(F.col("_shape") > SHAPES_MIN) & within, short / long)
    )
    open_ = F.col("_known").isNull() & ~(F.col("_shape") > SHAPES_MIN) & F.col("_ratio").isNull()
    near = (long - short) / long < 0.5
    return (
        edit_similarity(shaped, "_edits", open_ & near, x, y, floor, gap)
        .withColumn(
            name, F.coalesce("_known", F.when(F.col("_shape") > SHAPES_MIN, F.col("_shape")).otherwise(F.coalesce("_ratio", F.when(near, F.col("_edits")).otherwise(overlap))))
        )
        .drop("_known", "_shape", "_shape_edits", "_ratio", "_edits")
    )


def similarity_without_edits(a: Column, b: Column, gap: int | None = None) -> Column:
    """``form_similarity`` of two forms with terms where it needs no edit distance, else null."""
    x, y, sx, sy = a["x"], b["x"], a["sx"], b["sx"]
    short, long = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    s_short, s_long = F.least(a["sn"], b["sn"]), F.greatest(a["sn"], b["sn"])
    within, s_within = F.contains(x, y) | F.contains(y, x), F.contains(sx, sy) | F.contains(sy, sx)
    open_ = F.lit(None).cast("double")
    s_near, near = s_long - s_short <= F.ceil(s_long * (1 - SHAPES_MIN)), (long - short) / long < 0.5
    if gap is not None:
        s_near = s_near & (s_long - s_short <= gap)
    overlap = F.size(F.array_intersect(a["terms"], b["terms"])) / F.greatest(a["words"], b["words"])
    return (
        F.when(short < 20, (x == y).cast("double"))
        .when(within & ~x.rlike(COMMENT) & ~y.rlike(COMMENT), F.lit(1.0))
        .when(sx == sy, F.lit(1.0))
        .when(s_within & (s_short / s_long > SHAPES_MIN), s_short / s_long)
        .when(~s_within & s_near, open_)
        .when(within, short / long)
        .when(near, open_)
        .otherwise(overlap)
    )


def chat_similarity(df: DataFrame, a: str, b: str, name: str = "similarity", floor: float = 0.0, gap: int | None = None) -> DataFrame:
    """``form_similarity`` of two text columns."""
    formed = df.withColumns({"_fa": chat_form(F.col(a)), "_fb": chat_form(F.col(b))})
    return form_similarity(formed, "_fa", "_fb", name, floor, gap).drop("_fa", "_fb")


# Requirement boilerplate patterns and prefix.
REQUIREMENT_PREFIX = r"^[A-Z][A-Z_]{2,}:\s*"
BOILERPLATE = (
    r"(?i)\bwithout (?:altering|changing|affecting) (?:the |its )?(?:function(?:'s)? )?"
    r"(?:existing |external |runtime )?(?:behavior|behaviour|functionality)\b",
    r"(?i)\bwhile preserving (?:the |its )?(?:function(?:'s)? )?"
    r"(?:existing |current |same )?(?:behavior|behaviour|functionality)\b",
    r"(?i)\bpreserving (?:the |its )?(?:function(?:'s)? )?"
    r"(?:existing |current |same )?(?:behavior|behaviour|functionality)\b",
)


def clean_requirement(c: Column) -> Column:
    c = F.regexp_replace(js_trim(c), REQUIREMENT_PREFIX, "")
    for pattern in BOILERPLATE:
        c = F.regexp_replace(c, pattern, "")
    c = F.btrim(F.regexp_replace(squeeze(c), " (?=[,.;:])", ""), F.lit(" ,.;:"))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("empty"))


def identifier_tokens(c: Column) -> Column:
    """Camel-case, snake-case and digit runs, lower-cased."""
    pattern = r"[A-Z]+(?=[A-Z][a-z]|(?![\p{L}\p{N}_]))|[A-Z]?[a-z]+|[0-9]+|[A-Z]+"
    return F.transform(F.regexp_extract_all(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(pattern), 0), F.lower)


def normalize_code(c: Column) -> Column:
    """Common indent removed, trailing blanks dropped per line, line ends kept.

    The common prefix of all indents is that of the smallest and the largest
    one; a back-reference finds it. Only regular expressions are used, so the
    result can feed a Python UDF directly.
    """
    indents = F.regexp_extract_all(c, F.lit(r"(?md)^([ \t]*)[^ \t\n]"), F.lit(1))
    ends = F.concat(F.array_min(indents), F.lit("\0"), F.array_max(indents))
    margin = F.coalesce(F.regexp_extract(ends, r"^([ \t]*)[ \t]*\x00\1", 1), F.lit(""))
    shifted = F.regexp_replace(c, F.concat(F.lit("(?md)^"), margin), F.lit(""))
    return F.regexp_replace(shifted, r"[ \t]+(?=\r?(?:\n|\z))", "")


def strip_fence(c: Column) -> Column:
    """Body of a text that is one fenced block, else the trimmed text."""
    text = js_trim(c)
    body = F.regexp_extract(text, r"(?is)^```(?:python)?\s*(.*?)\s*```$", 1)
    fenced = text.rlike(r"(?is)^```(?:python)?\s*(.*?)\s*```$")
    return F.when(fenced, js_trim(body)).otherwise(text)


def iso_utc(c: Column) -> Column:
    """ISO-8601 time with ``Z``, an offset, or neither, which means UTC; null where it is none."""
    zoned = F.when(c.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.try_to_timestamp(zoned)
