"""Chat formatting by prefix-target expansion, in column functions only.

Every turn becomes a segment of one string per conversation. Every assistant turn becomes an example: all segments
before it are the context, its own text is the only trainable part, marked by its offsets. Turns that no reply follows are
an example without a target, so nothing of a conversation is left out. ``examples`` makes the strings beside their
conversation, so they are neither shuffled nor stored; ``expand`` keeps the offsets only, which are the same in the
conversation's string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
TURN, END, ASK, ASKED = "<s>", "</s>", "[INST] ", " [/INST]"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """A backslash before every backslash and inside every control string."""
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, "<(/?s>)", r"<\\$1")
    return F.regexp_replace(text, r"\[(/?INST\])", r"[\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segment(role: Column, text: Column) -> Column:
    """A turn in the template; the role is written in percent code, so it is one line without control strings."""
    body = F.when(role == ASSISTANT, F.concat(escaped(text), F.lit(END))).otherwise(F.concat(F.lit(ASK), escaped(text), F.lit(ASKED)))
    return F.concat(F.lit(TURN), F.url_encode(role), F.lit("\n"), body)


def format_conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id`` and ``formatted``, its turns in order.

    Null roles and texts are empty. Turns are ordered by (turn, role, text), null turns first; repeated rows are turns of
    their own. A null conversation id is a conversation. Other columns are left out; no rows give no rows.
    """
    turns = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: segment(t["role"], t["text"])), "").alias("formatted"))


def _read(part: Column) -> tuple[Column, Column, Column]:
    """Role of a segment without its turn mark, characters before what follows the role's line, and text."""
    code = F.substring_index(part, "\n", 1)
    role, head = F.url_decode(code), F.length(code) + 1
    opened, closed = F.when(role == ASSISTANT, 0).otherwise(len(ASK)), F.when(role == ASSISTANT, len(END)).otherwise(len(ASKED))
    return role, head, unescaped(F.substring(part, head + opened + 1, F.length(part) - head - opened - closed))


def prefixes(formatted: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id``, ``pos`` from 1, ``role``, ``head``, ``part`` (its segment without the turn mark), ``last``
    (whether no turn follows) and ``example``, the segments of all turns before it and its own.

    The strings grow with the square of a conversation's turns. They are made row by row beside their conversation: none is
    shuffled or sorted here.
    """
    turns = formatted.select("conv_id", F.split("formatted", TURN).alias("parts")).select("conv_id", "parts", F.posexplode("parts").alias("pos", "part")).filter("pos > 0")
    role, head, _ = _read(F.col("part"))
    example = F.array_join(F.slice("parts", F.lit(1), F.col("pos") + 1), TURN)
    return turns.select("conv_id", "pos", role.alias("role"), head.alias("head"), "part", (F.col("pos") + 1 == F.size("parts")).alias("last"), example.alias("example"))


def examples(formatted: DataFrame) -> DataFrame:
    """The prefix-target expansion: one example per assistant turn, and one without a target for turns that no reply follows.

    ``conv_id``, ``pos`` of the example's last turn, ``n_context`` turns before it, ``example`` (their segments and its own),
    ``start`` and ``end`` of the trainable text in it (code points, 0-based), ``target``, what lies between them, unescaped,
    and ``last``, whether the example is the whole conversation. Without a target, the last three but ``last`` are null.
    """
    reply, size = F.col("role") == ASSISTANT, F.length("example").cast("long")
    marked = prefixes(formatted).filter(reply | F.col("last"))
    marked = marked.withColumn("start", F.when(reply, size - F.length("part") + F.col("head"))).withColumn("end", F.when(reply, size - len(END)))
    cut = F.substring("example", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return marked.select("conv_id", "pos", (F.col("pos") - 1).alias("n_context"), "example", "start", "end", unescaped(cut).alias("target"), "last")


def read_turns(formatted: DataFrame) -> DataFrame:
    """One row per turn, read back: ``conv_id``, ``pos`` from 1, ``role``, ``text``, ``chars`` of its segment."""
    parts = formatted.select("conv_id", F.posexplode(F.split("formatted", TURN)).alias("pos", "part")).filter("pos > 0")
    role, _, text = _read(F.col("part"))
    return parts.select("conv_id", "pos", role.alias("role"), text.alias("text"), (F.length("part") + len(TURN)).alias("chars"))


def expand(formatted: DataFrame) -> DataFrame:
    """The examples with a target, as offsets into the conversation's string: ``conv_id``, ``pos``, ``n_context`` turns before it, ``start`` and ``end`` of its trainable text, ``target`` (that text, unescaped)."""
    return examples(formatted).filter(F.col("start").isNotNull()).select("conv_id", "pos", "n_context", "start", "end", "target")


def with_strings(examples: DataFrame, formatted: DataFrame) -> DataFrame:
    """Adds ``example``, the string up to the end of the reply with its end mark. Grows with the square of a conversation's turns."""
    joined = examples.join(formatted, examples["conv_id"].eqNullSafe(formatted["conv_id"])).drop(formatted["conv_id"])
    return joined.withColumn("example", F.substring("formatted", F.lit(1), (F.col("end") + len(END)).cast("int"))).drop("formatted")


def digests(formatted: DataFrame) -> DataFrame:
    """What the examples say, read back: one row per conversation with ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    The turns are those of the conversation's last example, its context included; the loss columns are the targets of
    all its examples, cut out of their strings by the mask.
    """
    made = examples(formatted).select("conv_id", "pos", "target", F.when(F.col("last"), F.col("example")).alias("whole"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "target")))
    read = made.groupBy("conv_id").agg(ordered.alias("targets"), F.max("whole").alias("whole"))

    def turn(part: Column) -> Column:
        role, _, text = _read(part)
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))

    parts = F.split("whole", TURN)
    turns = F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), turn), "")
    loss = F.array_join(F.transform("targets", lambda t: t["target"]), "")
    return read.select(
        "conv_id",
        (F.size(parts) - 1).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
    )
