"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``<s>[INST] role [/INST] text</s>``. In the grammar neither a role nor a text holds a control
string, so where one does, or the deterministic parser does not get the source turn back, the turn is rendered as
``<s>[INST~] role [/INST] text</s>`` with ``~`` and every control string escaped, which holds none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import table

RAW, ESCAPED, HEAD_END, TURN_END = "<s>[INST] ", "<s>[INST~] ", " [/INST] ", "</s>"
#: Replaced in this order; undone in the opposite one.
ESCAPES = [("~", "~0"), ("</s>", "~1"), ("[/INST]", "~2"), ("[INST]", "~3"), ("<s>", "~4")]
#: What marks turns; never left as it is in a role or a text.
CONTROL = ["<s>", "</s>", "[INST]", "[INST~]", "[/INST]"]


def conflicts(c: Column) -> Column:
    """Whether c holds a control string."""
    found = F.lit(False)
    for x in CONTROL:
        found = found | F.contains(c, F.lit(x))
    return found


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _render(t: Column, escaped: Column) -> Column:
    role = F.when(escaped, escape(t["role"])).otherwise(t["role"])
    text = F.when(escaped, escape(t["text"])).otherwise(t["text"])
    return F.concat(F.when(escaped, F.lit(ESCAPED)).otherwise(F.lit(RAW)), role, F.lit(HEAD_END), text, F.lit(TURN_END))


def _parse_turn(s: Column) -> Column:
    """(role, text, head, escaped) of one rendered turn without its end mark; head: its characters before the text."""
    escaped = F.startswith(s, F.lit(ESCAPED))
    start = F.when(escaped, F.lit(len(ESCAPED))).otherwise(F.lit(len(RAW)))
    end = F.instr(s, HEAD_END)
    role = F.substring(s, start + 1, end - start - 1)
    text = F.substring(s, end + len(HEAD_END), F.length(s))
    return F.struct(
        F.when(escaped, unescape(role)).otherwise(role).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"),
        (end + len(HEAD_END) - 1).alias("head"), escaped.alias("escaped"), text.alias("shown"),
    )


def parse(rendered: Column) -> Column:
    """Turns of a rendered conversation: split at end marks, then heads are read; needs nothing but the text."""
    pieces = F.split(rendered, F.lit("</s>"), F.lit(-1))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), _parse_turn)


def _pairs(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chat(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, the turns parsed back from it, and loss spans.

    Null texts and roles are empty; null conversation ids form one conversation; null turns come first and ties go
    by role then text, so repeated rows stay. Other columns are ignored. An empty table gives no rows. Turns of one
    conversation must meet in one row, since its text and digest are one value; nothing else is gathered.
    Raises if a text can't be recovered. Columns: conv_id, formatted, turns (role, text, head, escaped, shown),
    spans (start, length in code points of each text under the loss mask, as shown), n_turns.
    """
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.struct(F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    # first try: every turn alone, unescaped; a turn that conflicts or doesn't come back whole is escaped
    plain = _render(F.col("t"), F.lit(False))
    rows = rows.withColumn("escaped", conflicts(F.col("t.role")) | conflicts(F.col("t.text")) | (_pairs(parse(plain)) != F.array("t")))
    rows = rows.withColumn("piece", F.when(F.col("escaped"), _render(F.col("t"), F.lit(True))).otherwise(plain))
    shown = F.when(F.col("escaped"), escape(F.col("t.text"))).otherwise(F.col("t.text"))
    rows = rows.withColumn("length", F.length(shown))
    # a running sum, so that the spans of a conversation cost no more than its turns
    order = Window.partitionBy("conv_id").orderBy("turn", "t.role", "t.text")
    end = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("start", (end - len(TURN_END) - F.col("length")).cast("int"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "t", "start", "length", "escaped"))).alias("rows"))
    out = whole.select("conv_id", F.transform("rows", lambda r: r["t"]).alias("source"), F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
                       F.transform(F.filter("rows", lambda r: r["t"]["role"] == loss_role), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["escaped"].alias("escaped"))).alias("spans"))
    out = out.select("conv_id", "source", "formatted", "spans", parse(F.col("formatted")).alias("turns"))
    back = F.when(_pairs(F.col("turns")) == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("chat round trip failed: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return out.select("conv_id", "formatted", back.alias("turns"), "spans", F.size("turns").cast("long").alias("n_turns"))


EXTRA = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", EXTRA), (-1, 1, "assistant", EXTRA)], "conv_id long, turn long, role string, text string")
    out = format_chat(conv.unionByName(extra))
    piece = lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"])
    loss = F.array_join(F.transform("spans", lambda s: F.when(s["escaped"], unescape(piece(s))).otherwise(piece(s))), "")
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("loss", loss).select(
        "conv_id", "n_turns", F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_conflicts(c: str) -> str:
    return " OR ".join(f"contains({c}, '{x}')" for x in CONTROL)


def _sql_escape(c: str) -> str:
    for a, b in ESCAPES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{EXTRA}' UNION ALL SELECT -1, 1, 'assistant', '{EXTRA}'),
d AS (SELECT *, {_sql_conflicts('text')} OR {_sql_conflicts('role')} AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum({len(RAW) + len(HEAD_END) + len(TURN_END)} + CASE WHEN esc THEN 1 + length({_sql_escape('role')}) + length({_sql_escape('text')})
                ELSE length(role) + length(text) END) AS BIGINT) AS formatted_chars
FROM d GROUP BY conv_id
"""
