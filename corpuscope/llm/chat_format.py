"""Chat transcripts from typed content parts, in SQL functions only.

A turn's content is an array of typed parts.  A visitor flattens each part by its kind:
text is written out, an image, audio or document part becomes a placeholder.  The k-th
placeholder of a transcript stands for the k-th row of ``attachments``, which records the
reference and the number of tokens the placeholder expands to.

A transcript is a list of segments, each with a loss flag; joined they are the text:

    <|im_start|> role <|im_sep|> part ... <|im_end|>   for every turn, without the blanks

Only text parts of the trained roles carry loss.  A control string inside a text or role
gets a backslash behind its first character, one more than it may already have there, so
that no text can open or close a turn and every text can be read back as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE, JOINT = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|part|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

#: What follows the first character of a control string of this and other common templates.
_TAIL = r"\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]"
_CONTROL = r"<\|[A-Za-z0-9_]+\|>"

PART = (
    "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,"
    "seconds:double,pages:bigint>"
)

#: Tokens an attachment expands to: tiles of an image and one for its start, steps of
#: audio, pages of a document.
TILE, TILE_TOKENS, STEPS_A_SECOND, PAGE_TOKENS = 448, 256, 25, 1024


def escape(text: Column) -> Column:
    """``text`` with every control string broken by one more backslash."""
    return F.regexp_replace(text, rf"([<\[])(\\*+)(?={_TAIL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*+)(?={_TAIL})", "$1$2")


def text_parts(text: str | Column) -> Column:
    """Content of one text part; a null text is empty."""
    text = F.col(text) if isinstance(text, str) else text
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("width", "height")],
        F.lit(None).cast("double").alias("seconds"),
        F.lit(None).cast("bigint").alias("pages"),
    )
    return F.array(part)


def _is_text(part: Column) -> Column:
    """True for text parts and for parts of unknown or no kind, which are read as text."""
    return ~F.coalesce(part["kind"].isin(*PLACEHOLDERS), F.lit(False))


def expanded_tokens(part: Column) -> Column:
    """Tokens the placeholder of ``part`` expands to; unknown sizes count as one unit."""
    tiles = [F.ceil(F.greatest(F.coalesce(part[c], F.lit(1)), F.lit(1)) / TILE) for c in ("width", "height")]
    steps = F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * STEPS_A_SECOND)
    return (
        F.when(part["kind"] == "image", tiles[0] * tiles[1] * TILE_TOKENS + 1)
        .when(part["kind"] == "audio", F.greatest(steps, F.lit(1)))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .cast("bigint")
    )


def _segment(text: Column, loss: Column | bool) -> Column:
    loss = F.lit(loss) if isinstance(loss, bool) else loss
    return F.struct(text.alias("text"), loss.alias("loss"))


def _visit(parts: Column, trained: Column) -> Column:
    """Segments of the parts of one turn, in order."""

    def one(part, i):
        written = F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit(""))))
        for kind, placeholder in PLACEHOLDERS.items():
            written = written.when(part["kind"] == kind, F.lit(placeholder))
        segment = _segment(written, trained & _is_text(part))
        # Two texts side by side could make a control string that neither holds.
        touching = (i > 0) & _is_text(part) & _is_text(F.get(parts, i - 1))
        return F.when(touching, F.array(_segment(F.lit(JOINT), False), segment)).otherwise(
            F.array(segment)
        )

    return F.flatten(F.transform(parts, one))


def format_chats(
    turns: DataFrame,
    content: str | Column,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    trained: Sequence[str] = ("assistant",),
) -> DataFrame:
    """``(conv, n_turns, segments, attachments, formatted)``, one row a conversation.

    ``content`` is an array of :data:`PART` structs (a column or its name); the turns
    come by ``turn``, nulls first, ties by role and content.  Null contents, parts, roles
    and texts are empty; a part of unknown kind is text; repeated rows are turns of their
    own; rows with a null conversation form one.  An empty table gives no rows.  Further
    columns of ``turns`` are not looked at.  A transcript is one value, so a conversation
    has to fit one row; equal keys are gathered on the map side first.
    """
    content = F.col(content) if isinstance(content, str) else content
    none = F.array().cast(f"array<{PART}>")
    rows = turns.select(
        F.col(conv).alias(conv),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.filter(F.coalesce(content.cast(f"array<{PART}>"), none), lambda p: p.isNotNull()).alias("parts"),
        ).alias("_turn"),
    )
    gathered = rows.groupBy(conv).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def segments(t):
        head = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))
        return F.concat(
            F.array(_segment(head, False)),
            _visit(t["parts"], t["role"].isin(*trained)),
            F.array(_segment(F.lit(CLOSE), False)),
        )

    def attached(t, i):
        return F.transform(
            F.filter(t["parts"], lambda p: ~_is_text(p)),
            lambda p: F.struct(
                i.cast("bigint").alias("turn_index"),
                p["kind"].alias("kind"),
                p["ref"].alias("ref"),
                expanded_tokens(p).alias("tokens"),
            ),
        )

    return gathered.select(
        conv,
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.flatten(F.transform("_turns", segments)).alias("segments"),
        F.flatten(F.transform("_turns", attached)).alias("attachments"),
    ).withColumn("formatted", F.array_join("segments.text", ""))


def read_turns(formatted: str | Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a transcript; placeholders hold no text."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted
    pieces = F.split(formatted, _literal(OPEN), -1)

    def one(piece):
        ends = F.split(piece, _literal(MIDDLE), 2)
        texts = F.transform(F.split(F.get(ends, F.lit(1)), _CONTROL, -1), unescape)
        return F.struct(
            unescape(F.get(ends, F.lit(0))).alias("role"), F.array_join(texts, "").alias("text")
        )

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one)


def read_loss(segments: str | Column) -> Column:
    """The text under the loss mask of a transcript, as it was before it was escaped."""
    segments = F.col(segments) if isinstance(segments, str) else segments
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"])), "")


def _literal(text: str) -> str:
    return rf"\Q{text}\E"
