r"""Chat formatting by a grammar round trip, in DataFrame functions only.

A conversation becomes one text of turns, ``<|im_start|>role\nbody<|im_end|>\n``. A
deterministic parser reads such a text back: it cuts at the start mark, takes the role up
to the first line feed, the body up to the end mark, and refuses any other ``<|``. A turn is
rendered as it stands, parsed and compared with its source; where the two differ, its
content holds something the grammar means otherwise, and it is escaped and tried again.
The finished conversation is parsed as a whole and must equal its turns.

Escapes are reversible: ``<``, any backslashes, an optional ``!`` and ``|`` get one backslash
more behind ``<``, so no ``<|`` is left; a line feed inside a role becomes ``<!|``. The parser
takes them back in every body and role, so one text has one reading.

The project keeps no conversations; the operator is general: rows of a conversation id, a
turn to order by, a role and a text, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TAIL = f"{END}\n"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*!?)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """What an escaped body or role stands for."""
    return F.regexp_replace(F.replace(text, F.lit("<!|"), F.lit("\n")), r"<\\(\\*!?)\|", "<$1|")


def _drawn(role: Column, text: Column, escape: Column) -> tuple[Column, Column]:
    """Role and body as they are written."""
    safe_role = F.replace(_escaped(role), F.lit("\n"), F.lit("<!|"))
    return F.when(escape, safe_role).otherwise(role), F.when(escape, _escaped(text)).otherwise(text)


def render_turn(role: Column, text: Column, escape: Column) -> Column:
    """One turn under the template, its content escaped or as it stands."""
    head, body = _drawn(role, text, escape)
    return F.concat(F.lit(START), head, F.lit("\n"), body, F.lit(_TAIL))


def parse_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted text; null if the grammar does not accept it."""
    parts = F.split(formatted, START.replace("|", r"\|"), -1)

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        head = F.substring(part, F.lit(1), at - 1)
        body = F.substring(part, at + 1, F.length(part) - at - len(_TAIL))
        accepted = (at > 0) & F.endswith(part, F.lit(_TAIL)) & ~F.contains(head, F.lit("<|")) & ~F.contains(body, F.lit("<|"))
        return F.when(accepted, F.struct(unescaped(head).alias("role"), unescaped(body).alias("text")))

    def read(pieces: Column) -> Column:
        turns = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
        return F.when((F.get(pieces, F.lit(0)) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)

    return _bound(parts, read)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _same(parsed: Column, turns: Column) -> Column:
    return F.coalesce(parsed == turns, F.lit(False))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, read from the formatted text and unescaped."""
    cut = lambda raw: F.array_join(
        F.transform(spans, lambda s: unescaped(F.substring(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))), ""
    )
    return _bound(formatted.cast("binary"), cut)


def format_conversations(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """``(conv_col, n_turns long, n_escaped long, formatted string, loss_spans array<struct<start, end>>)``.

    One row per conversation. ``loss_spans`` are byte ranges of ``formatted``, in order: the
    bodies of turns whose role is one of ``loss_roles``. ``n_escaped`` counts turns whose content
    had to be escaped. Turns go by ``turn_col``, nulls first; equal turns by role and
    text, and repeated rows are turns of their own. A null text or role is empty, an empty text
    is a turn with an empty body. Rows without a conversation id are one conversation.
    Other columns are ignored, whatever their names. An empty table has no conversations.

    A conversation is one string and must fit one (2 GB); everything before it is put together
    works turn by turn, so that only the finished turns of a long conversation meet.
    """
    text, role = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text"))
    source = F.array(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))
    back = lambda escape: parse_turns(render_turn(F.col("_role"), F.col("_text"), F.lit(escape)))
    tried = rows.withColumn(
        "_escape",
        F.when(_same(back(False), source), False)
        .when(_same(back(True), source), True)
        .otherwise(F.raise_error(F.lit("a turn does not come back from its escaped form")).cast("boolean")),
    )
    head, body = _drawn(F.col("_role"), F.col("_text"), F.col("_escape"))
    before_body = F.octet_length(head) + len(START) + 1
    sized = tried.withColumn("_lead", before_body).withColumn("_body", F.octet_length(body))
    whole = F.col("_lead") + F.col("_body") + len(_TAIL)
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text")
    placed = sized.withColumn("_at", F.row_number().over(order)).withColumn(
        "_start", F.coalesce(F.sum(whole.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_lead")
    )
    one = F.struct(
        F.col("_at").alias("at"),
        F.col("_role").alias("role"),
        F.col("_text").alias("text"),
        F.col("_escape").alias("escape"),
        F.col("_start").alias("start"),
        (F.col("_start") + F.col("_body")).alias("end"),
    )
    gathered = placed.groupBy("_conv").agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    written = gathered.withColumn(
        "formatted", F.array_join(F.transform("_turns", lambda t: render_turn(t["role"], t["text"], t["escape"])), "")
    )
    wanted = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(_same(parse_turns(F.col("formatted")), wanted), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not come back from its formatted text")).cast("string")
    )
    lossy = F.filter("_turns", lambda t: t["role"].isin(*loss_roles))
    return written.select(
        F.col("_conv").alias(conv_col),
        F.size("_turns").cast("long").alias("n_turns"),
        F.size(F.filter("_turns", lambda t: t["escape"])).cast("long").alias("n_escaped"),
        checked.alias("formatted"),
        F.transform(lossy, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
    )
