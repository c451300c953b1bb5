"""Chat formatting: turns as one training text with a loss mask, held to a grammar by parsing it again.

The text of a conversation is its turns one after the other, with nothing between:

    user       [INST]text[/INST]
    system     [SYS]text[/SYS]
    assistant  <s>text</s>
    any other  [ROLE]name[IS]text[/ROLE]

Each turn is rendered as it is and parsed again. Where the parser doesn't give back the turn, what conflicts is
escaped, one kind a round, until it does: first what looks like an escaped control string already, then the control
strings themselves. An escape is one more backslash behind the opening bracket, and the parser takes one away, so it
can always be undone. The joined text is parsed once more, and an error is raised unless it falls into exactly those
turns. Everything is DataFrame functions. The escapes are found row by row; one shuffle on conv_id brings the turns of
a conversation together.

Cases: turns go by ``turn`` (null first), ties by role, then text, and repeated rows are turns of their own; a null
role is the role '', a null text is empty, a null conv_id is a conversation; an empty table gives an empty result;
further columns, whatever their names, are ignored. A conversation is one training sequence, hence one value of at
most 2 GB; reading its spans back costs spans times characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
OPEN = {"user": "[INST]", "system": "[SYS]", "assistant": "<s>"}
CLOSE = {"user": "[/INST]", "system": "[/SYS]", "assistant": "</s>"}
OTHER = ("[ROLE]", "[IS]", "[/ROLE]")
#: What stands behind the opening bracket of a control string.
_REST = r"((?:/?(?:INST|SYS|ROLE)|IS)\]|/?s>)"
CONTROL = r"[\[<]" + _REST
#: A turn, up to the first string that closes it.
PIECE = r"(?s)\[INST\].*?\[/INST\]|\[SYS\].*?\[/SYS\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\]"


def _deeper(text: Column, least: int) -> Column:
    """One more backslash in control strings that have ``least`` or more (at 0: exactly none)."""
    return F.regexp_replace(text, rf"([\[<])({r'\\+' if least else ''}){_REST}", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*){_REST}", "$1$2$3")


def _body(piece: Column, opening: str, closing: str) -> Column:
    return F.substring(piece, F.lit(len(opening) + 1), F.char_length(piece) - (len(opening) + len(closing)))


def _turn(piece: Column) -> Column:
    """role and text of a piece, still escaped; the role of other turns is a part of it."""
    named = rf"(?s)^\[ROLE\](.*?)\[IS\](.*)\[/ROLE\]$"
    out = F.struct(F.regexp_extract(piece, named, 1).alias("role"), F.regexp_extract(piece, named, 2).alias("text"))
    for role, opening in OPEN.items():
        out = F.when(F.startswith(piece, F.lit(opening)), F.struct(F.lit(role).alias("role"), _body(piece, opening, CLOSE[role]).alias("text"))).otherwise(out)
    return out


def pieces(formatted: Column) -> Column:
    return F.regexp_extract_all(formatted, F.lit(PIECE), F.lit(0))


def _render(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, opening in OPEN.items():
        out = F.when(role == name, F.concat(F.lit(opening), text, F.lit(CLOSE[name]))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text; null where it isn't of the grammar: something stands between
    turns, a turn holds a control string, or a named turn has no name or one with a form of its own."""
    found = F.transform(pieces(formatted), _turn)
    plain = lambda x: ~x["role"].rlike(CONTROL) & ~x["text"].rlike(CONTROL)
    turns = F.transform(found, lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    again = F.array_join(F.transform(found, lambda x: _render(x["role"], x["text"])), "")
    return F.when((again == formatted) & F.forall(found, plain), turns)


def render_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, ``piece`` (the rendered turn) and ``rounds`` (of escapes that it took)."""
    d = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns({"as_role": F.col("role"), "as_text": F.col("text"), "rounds": F.lit(0)})
    source = F.array(F.struct("role", "text"))
    for least in (1, 0):
        d = d.withColumn("piece", _render(F.col("as_role"), F.col("as_text")))
        d = d.withColumn("same", F.coalesce(parse(F.col("piece")) == source, F.lit(False)))
        d = d.withColumns({c: F.when(F.col("same"), F.col(c)).otherwise(_deeper(F.col(c), least)) for c in ("as_role", "as_text")} | {"rounds": F.col("rounds") + (~F.col("same")).cast("int")})
    piece = _render(F.col("as_role"), F.col("as_text"))
    return d.select("conv_id", "turn", "role", "text", "rounds", piece.alias("piece"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (start and end, in code points of formatted: the texts of the
    assistant's turns), escaped_turns."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    d = render_turns(turns).withColumn("chars", F.char_length("piece").cast("long"))
    end = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"n": F.row_number().over(order), "end": end})
    mine = F.col("role") == "assistant"
    span = F.when(mine, F.struct((F.col("end") - F.col("chars") + len(OPEN["assistant"])).alias("start"), (F.col("end") - len(CLOSE["assistant"])).alias("end")))
    d = d.select("conv_id", "rounds", F.struct("n", "piece", span.alias("span")).alias("turn"))
    d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.count_if(F.col("rounds") > 0).alias("escaped_turns"))
    d = d.select("conv_id", "escaped_turns", F.transform("turns", lambda x: x["piece"]).alias("own"), F.filter(F.transform("turns", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"))
    d = d.withColumn("formatted", F.array_join("own", ""))
    checked = F.when(pieces(F.col("formatted")) == F.col("own"), F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted text doesn't fall into its turns")).cast("string"))
    return d.select("conv_id", F.size("own").cast("long").alias("n_turns"), checked.alias("formatted"), "loss_spans", "escaped_turns")


def read_back(chats: DataFrame) -> DataFrame:
    """What the formatted texts and their masks say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, escaped_turns."""
    d = chats.withColumn("turns", parse(F.col("formatted")))
    text = F.col("formatted")
    spans = F.transform("loss_spans", lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    d = d.withColumn("loss", F.array_join(spans, ""))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "escaped_turns",
    )


#: The same by plain aggregates over the source; only formatted_chars and escaped_turns know the template.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([\[<])(\\*)((?:/?(?:INST|SYS|ROLE)|IS)\]|/?s>)', '\1\2\\\3', 'g') AS t,
    regexp_replace(role, '([\[<])(\\*)((?:/?(?:INST|SYS|ROLE)|IS)\]|/?s>)', '\1\2\\\3', 'g') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(t) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 7 ELSE 17 + length(r) END) AS BIGINT) AS formatted_chars,
    count(*) FILTER (t <> text OR (role NOT IN ('user', 'system', 'assistant') AND r <> role)) AS escaped_turns
FROM e GROUP BY conv_id"""
