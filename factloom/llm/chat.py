"""Chat formatting by event-sourced reconstruction, in native column functions.

A log holds events of many conversations: ``conv_id``, ``seq``, ``turn``,
``kind``, ``role``, ``text``. ``reconstruct`` partitions it by conversation,
sorts by sequence and folds it into final messages:

* ``message`` opens a message at its turn (a turn may hold several);
* ``delta`` appends its text to the message open at its turn;
* ``edit`` replaces whatever its turn held before;
* ``regenerate`` does so too and removes what later turns held before it.

``render`` writes one string per conversation with a run-length loss mask, and
``read_back`` parses that string again.

Defined cases: a null text or role is empty; events with a null ``conv_id``
form one conversation; null ``seq`` or ``turn`` sorts first; equal ``seq`` is
ordered by role and text; repeated rows are separate messages; an empty log
gives no rows; other columns are ignored. A conversation's final text is one
value, so it must fit one Spark string (2 GB); nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn:", "</turn>"
#: The role of the texts that are trained on.
LOSS_ROLE = "assistant"

#: A conversation whose texts imitate control strings and escapes.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\b`` and the control strings ``\o`` and ``\c``: no
    control string is left, and each backslash tells what it stands for."""
    return _swap(_swap(_swap(text, "\\", "\\b"), OPEN, "\\o"), CLOSE, "\\c")


def unescape(text: Column) -> Column:
    return _swap(_swap(_swap(text, "\\o", OPEN), "\\c", CLOSE), "\\b", "\\")


def escape_role(role: Column) -> Column:
    return _swap(escape(role), ">", "\\g")


def unescape_role(role: Column) -> Column:
    return unescape(_swap(role, "\\g", ">"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Finished turns as a log: each row is a ``message`` event."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("seq"),
        F.col("turn").cast("long").alias("turn"),
        F.lit("message").alias("kind"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, message_no, role, text."""
    log = events.select(
        "conv_id",
        "seq",
        "turn",
        "kind",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # Windows and both groupings below hash on conv_id alone: one exchange.
    earlier_turns = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    same_turn = Window.partitionBy("conv_id", "turn")
    in_order = same_turn.orderBy("seq", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    kept = (
        log.withColumn("cut_by", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier_turns))
        .where("cut_by is null or seq > cut_by")
        .withColumn("reset_at", F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(same_turn))
        .where("reset_at is null or seq >= reset_at")
        .withColumn("message_no", F.sum(F.when(F.col("kind") == "delta", 0).otherwise(1)).over(in_order))
    )
    part = F.struct("seq", F.col("role").alias("by"), "text")
    return (
        kept.groupBy("conv_id", "turn", "message_no")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select(
            "conv_id",
            "turn",
            "message_no",
            F.col("parts")[0]["by"].alias("role"),
            F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: for each turn, its head, text and tail as
    (n_chars, loss)."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">\n"))
    tail = f"{CLOSE}\n"
    turn = messages.select(
        "conv_id",
        F.struct(
            "turn",
            "message_no",
            head.alias("head"),
            escape(F.col("text")).alias("body"),
            (F.col("role") == LOSS_ROLE).alias("loss"),
        ).alias("t"),
    )

    def run(n_chars: Column, loss: Column) -> Column:
        return F.struct(n_chars.cast("long").alias("n_chars"), loss.alias("loss"))

    def runs(t: Column) -> Column:
        return F.array(
            run(F.char_length(t["head"]), F.lit(False)),
            run(F.char_length(t["body"]), t["loss"]),
            run(F.lit(len(tail)), F.lit(False)),
        )

    return (
        turn.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
            F.flatten(F.transform("turns", runs)).alias("mask"),
        )
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse the formatted strings: conv_id, formatted, turns (role, text, loss).

    A text whose length differs from its run in the mask raises an error.
    """
    pieces = F.split("formatted", f"{CLOSE}\n")
    blocks = F.slice(pieces, 1, F.size(pieces) - 1)
    parsed = rendered.select("conv_id", "formatted", "mask", blocks.alias("blocks"))

    def turn(block: Column, i: Column) -> Column:
        end = F.locate(">", block)
        body = F.substring(block, end + 2, F.char_length(block))
        run = F.element_at("mask", (i * 3 + 2).cast("int"))
        return F.struct(
            unescape_role(F.substring(block, F.lit(len(OPEN) + 1), end - len(OPEN) - 1)).alias("role"),
            F.when(F.char_length(body) == run["n_chars"], unescape(body))
            .otherwise(F.raise_error("loss mask does not fit the text"))
            .alias("text"),
            run["loss"].alias("loss"),
        )

    return parsed.select("conv_id", "formatted", F.transform("blocks", turn).alias("turns"))


def format_conversations(events: DataFrame) -> DataFrame:
    """The operator: a log in, one formatted string and loss mask per conversation out."""
    return render(reconstruct(events))


def digest(parsed: DataFrame) -> DataFrame:
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return parsed.select("conv_id", "formatted", "turns", loss.alias("loss_text")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    probe = spark.sql(
        "SELECT * FROM VALUES (:i, 0L, 'user', :t), (:i, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)",
        args={"i": PROBE_ID, "t": PROBE_TEXT},
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(
        probe.withColumn("conv_id", F.col("conv_id").cast("long"))
    )
