"""Tables of chat turns ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlark.constants import CALL_COLOUR, CONTENT_COLOUR, EMPTY_MESSAGE, MAX_ROUNDS, STOP_WORD
from sqlark.functions.ordered import ROWS_PER_BLOCK, with_next
from sqlark.operators.text import concat_pages

USER, PLANNER, WRITER, REVIEWER, AUTO = "user", "planner", "writer", "reviewer", "auto"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def final_messages(turns: DataFrame) -> DataFrame:
    """Last turn of every conversation; combines map-side, one row per conversation."""
    last = F.max_by(F.struct("turn", "role", "text"), "turn")
    return turns.groupBy("conv_id").agg(last.alias("m")).select("conv_id", "m.turn", "m.role", "m.text")


def ends_with_stop(text: Column | str) -> Column:
    return F.coalesce(F.upper(F.right(_col(text), F.lit(len(STOP_WORD)))) == STOP_WORD, F.lit(False))


def mentions_stop(text: Column | str) -> Column:
    return F.coalesce(F.contains(F.lower(_col(text)), F.lit(STOP_WORD.lower())), F.lit(False))


def shown_text(text: Column | str) -> Column:
    """Text as shown to the user: a placeholder for '', the stop word removed in its exact case."""
    text = _col(text)
    return F.when(text == "", EMPTY_MESSAGE).otherwise(F.replace(text, F.lit(STOP_WORD), F.lit("")))


def next_speaker(speaker: Column | str, stopped: Column | str) -> Column:
    """Who speaks after ``speaker``: the planner answers the user and hands to
    the writer, whom the reviewer checks until the writer stops the chat."""
    speaker = _col(speaker)
    return (
        F.when(speaker == USER, PLANNER)
        .when(speaker.isin(PLANNER, REVIEWER), WRITER)
        .when((speaker == WRITER) & _col(stopped), USER)
        .when(speaker == WRITER, REVIEWER)
        .otherwise(AUTO)
    )


def transition_audit(turns: DataFrame, speaker: str = "speaker", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """How often each speaker was followed by whom, next to whom the rule names.

    One row per (speaker, expected, observed): number of transitions, whether
    they keep the rule, and whether the speaker repeats.
    """
    # Only the rule's answer goes through the shuffle, not the texts it is read from.
    narrow = turns.select(
        "conv_id",
        "turn",
        F.col(speaker).alias("speaker"),
        next_speaker(speaker, mentions_stop("text")).alias("expected"),
    )
    linked = with_next(narrow, ["conv_id"], "turn", "speaker", "observed", rows_per_block)
    return (
        linked.where(F.col("observed").isNotNull())
        .groupBy("speaker", "expected", "observed")
        .agg(F.count(F.lit(1)).alias("n_transitions"))
        .withColumn("follows_rule", F.col("expected").isin(AUTO) | (F.col("expected") == F.col("observed")))
        .withColumn("repeats", F.col("speaker") == F.col("observed"))
    )


def first_rounds(turns: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """The first messages of each conversation. The rank limit is applied
    before the shuffle, so a long conversation does not travel whole."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("_place", place).where(F.col("_place") <= rounds).drop("_place")


def rendered_turn(name: Column | str, role: Column | str, text: Column | str, call: Column | None = None) -> Column:
    """One turn as Markdown. ``call`` is a struct ``(name, arguments)`` shown
    when there is no content; a turn with neither renders as NULL."""
    head = F.concat(F.lit("**"), _col(name), F.lit("** ("), _col(role), F.lit("): "))
    # The markup of a rendered turn.
    content = F.concat(head, F.lit(f"<span style='color:{CONTENT_COLOUR}'>"), _col(text), F.lit("</span>"))
    if call is None:
        return content
    called = F.concat(
        head,
        F.lit(f"<span style='color:{CALL_COLOUR}'>Function Call - "),
        call["name"],
        F.lit(" with arguments "),
        call["arguments"],
        F.lit("</span>"),
    )
    return F.coalesce(content, called)


def rendered_transcripts(turns: DataFrame, name: str = "role", call: str | None = None) -> DataFrame:
    """Conversations as text, turns apart by a blank line: ``conv_id, part_no,
    text``. Only a conversation beyond one block of turns has more than part 0."""
    shown = turns.select(
        "conv_id", "turn", rendered_turn(name, "role", "text", F.col(call) if call else None).alias("text")
    )
    return concat_pages(shown, "conv_id", "turn", "text", separator="\n\n", trailing=False).drop("n_chars")


def message_json(agents_chat: Column | str, user_chat: Column | str) -> Column:
    """Message for the front end as JSON; absent sides stay as nulls."""
    both = F.struct(_col(agents_chat).alias("agents_chat"), _col(user_chat).alias("user_chat"))
    return F.to_json(both, {"ignoreNullFields": "false"})
