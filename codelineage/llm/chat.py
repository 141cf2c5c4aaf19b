"""Chat formatting by a declarative template and a finite-state machine over roles.

A template names, for each role, the marks before and after a text and whether the
text counts for the loss; ``after`` is the machine: the roles that may follow each
role. Formatting emits one row per turn with its text segments and a loss flag for
each. Marks that occur inside texts are escaped so that reading back gives the
same turns.

A null text is empty, a null role is the empty role. Roles the template does not know
keep their name inside their marks and never count for the loss. Turns with equal
numbers are ordered by role, then text, nulls first; equal rows are separate turns. Rows
with a null conversation form one conversation. An empty table gives no conversations.
Invalid turn orders are formatted too and reported in ``allowed`` and ``valid``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Marks:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Marks]
    after: dict[str, tuple[str, ...]]
    first: tuple[str, ...]
    last: tuple[str, ...]
    other: tuple[str, str, str] = ("[ROLE] ", " [/ROLE][TEXT] ", " [/TEXT]")
    controls: tuple[str, ...] = field(default=())


# The marks of this template.
DEFAULT = Template(
    roles={
        "system": Marks("<s>[SYS] ", " [/SYS]"),
        "user": Marks("[INST] ", " [/INST]"),
        "assistant": Marks("[ANS] ", " [/ANS]</s>", loss=True),
    },
    after={"system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    first=("system", "user"),
    last=("assistant",),
    controls=("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[ROLE]", "[/ROLE]", "[TEXT]", "[/TEXT]"),
)


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """Backslashes doubled, and one put after the first character of every control string.

    No control string is left: it would have to stand unbroken in the text already.
    Control strings that overlap one another in part are not supported by a template.
    """
    tails = "|".join(re.escape(c[1:]) for c in template.controls)
    heads = "".join(sorted({c[0] for c in template.controls}))
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"([{re.escape(heads)}])({tails})", r"$1\\$2")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = DEFAULT) -> DataFrame:
    """Rows (conv_id, seq, allowed, segments): each segment a text and its loss flag.

    ``allowed`` is the machine's verdict on the step from the turn before. The
    window is over one conversation and spills to disk, whatever its length.
    """
    rows = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({"seq": F.row_number().over(order), "before": F.lag("role").over(order)})
    allowed = F.when(F.col("before").isNull(), F.col("role").isin(*template.first))
    for name, following in template.after.items():
        allowed = allowed.when(F.col("before") == name, F.col("role").isin(*following))
    plain = lambda t: F.struct(F.lit(t).alias("text"), F.lit(False).alias("loss"))
    own = lambda c, loss: F.struct(escape(c, template).alias("text"), F.lit(loss).alias("loss"))
    a, b, c = template.other
    other = F.array(plain(a), own(F.col("role"), False), plain(b), own(F.col("text"), False), plain(c))
    segments = None
    for name, marks in template.roles.items():
        parts = F.array(plain(marks.before), own(F.col("text"), marks.loss), plain(marks.after))
        segments = (F.when if segments is None else segments.when)(F.col("role") == name, parts)
    return rows.select(
        "conv_id", F.col("seq").cast("long").alias("seq"), "role", allowed.otherwise(False).alias("allowed"), segments.otherwise(other).alias("segments")
    )


def parse_turn(formatted: str, template: Template = DEFAULT) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    for name, marks in template.roles.items():
        if formatted.startswith(marks.before):
            return name, unescape(formatted[len(marks.before) : len(formatted) - len(marks.after)])
    a, b, c = template.other
    middle = formatted.index(b, len(a))
    return unescape(formatted[len(a) : middle]), unescape(formatted[middle + len(b) : len(formatted) - len(c)])


READ = T.StructType(
    [
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("valid", T.BooleanType()),
    ]
)


def read_back(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, parsed from the formatted turns.

    The digests run over a whole conversation in order, so its rows stream through
    one task, held one batch at a time.
    """
    schema = T.StructType([turns.schema["conv_id"], *READ])
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    kind = ordered.select("conv_id").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        columns = to_arrow_schema(kind).types + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        shape = pa.schema(list(zip([f.name for f in schema], columns)))
        open_, state, last = False, None, None
        done = []

        def close():
            key, n, sha, chars, loss, total, valid, role = state
            done.append((key, n, sha.hexdigest(), chars, loss.hexdigest(), total, valid and role in template.last))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), columns)], schema=shape)
            done.clear()
            return out

        for batch in batches:
            for key, allowed, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "allowed", "segments"))):
                if not open_ or key != last:
                    if open_:
                        close()
                    state, last, open_ = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, None], key, True
                formatted = "".join(s["text"] for s in segments)
                role, text = parse_turn(formatted, template)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in segments:
                    if s["loss"]:
                        masked = unescape(s["text"])
                        state[3] += len(masked)
                        state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
                state[6] = state[6] and allowed
                state[7] = role
                if len(done) >= 4096:
                    yield flush()
        if open_:
            close()
        if done:
            yield flush()

    return ordered.mapInArrow(run, schema)
