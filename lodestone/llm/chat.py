"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are the
context and only its text is trainable. A conversation that does not end with
an assistant turn gives one more example with nothing trainable, so that the
examples hold every turn. A turn is written as

    [TURN]role[/TURN]text</s>

after a leading ``<s>``. Control strings inside roles and texts get a backslash
after their first character (one more if they have some already), which is
undone by taking one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings, of this template and of a common one.
CONTROL = ("<s>", "</s>", "[TURN]", "[/TURN]", "[INST]", "[/INST]")
TAILS = "/?(?:s>|TURN\\]|INST\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"([<\[])(\\*+)({TAILS})"), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"([<\[])\\(\\*+)({TAILS})"), F.lit("$1$2$3"))


def examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Columns ``id_col``, ``example`` (from 0), ``n_turns``, ``formatted``, ``loss_start``, ``loss_end``.

    ``loss_start`` and ``loss_end`` are code points of ``formatted``; equal if
    nothing is trainable. Turns stand by ``turn_col`` (null first), ties by role
    and text, so repeated rows stay and reruns agree. Null roles and texts count
    as empty. Rows with a null id form one conversation. An empty table gives
    no rows; other columns are left out.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(f"`{turn_col}`").alias("t"), text(f"`{role_col}`").alias("role"), text(f"`{text_col}`").alias("text"))
    own = ("example", "n_turns", "formatted", "loss_end", "loss_start")
    if id_col.lower() in own:
        raise ValueError(f"{id_col} is the name of a result column")
    # the id apart from the names used on the way
    name, id_col = id_col, "__id"
    rows = turns.select(F.col(f"`{name}`").alias(id_col), turn.alias("__turn")).groupBy(id_col).agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
    pieces = F.transform("__turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit("[TURN]"), escape(t["role"]), F.lit("[/TURN]")).alias("head"), escape(t["text"]).alias("body")))
    rows = rows.select(id_col, pieces.alias("__pieces"))
    last = F.size("__pieces") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("__pieces", i)["role"] == "assistant") | (i == last))
    rows = rows.select(id_col, "__pieces", F.posexplode(targets).alias("example", "__at"))
    whole = F.concat(F.lit("<s>"), F.array_join(F.transform(F.slice("__pieces", F.lit(1), F.col("__at") + 1), lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), ""))
    target = F.get("__pieces", F.col("__at"))
    end = F.length("formatted") - 4
    return (
        rows.select(id_col, F.col("example").cast("long").alias("example"), (F.col("__at") + 1).cast("long").alias("n_turns"), whole.alias("formatted"), target.alias("__target"))
        .withColumn("loss_end", end.cast("long"))
        .withColumn("loss_start", F.when(F.col("__target.role") == "assistant", end - F.length("__target.body")).otherwise(end).cast("long"))
        .drop("__target").withColumnRenamed(id_col, name)
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    parts = F.regexp_extract_all(formatted, F.lit(r"(?s)\[TURN\](.*?)\[/TURN\]"), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(r"(?s)\[/TURN\](.*?)</s>"), F.lit(1))
    return F.transform(F.arrays_zip(parts.alias("role"), bodies.alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return unescape(formatted.substr((start + 1).cast("int"), (end - start).cast("int")))
