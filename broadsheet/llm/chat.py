r"""Chat formatting (3): conversations rebuilt from an event log, then rendered with a loss mask. SQL functions only.

Events are (conv_id, message, seq, kind, role, text). A message is the fold of its events by sequence: ``delta`` appends its
text, ``edit`` replaces all text so far, ``regenerate`` throws away the text so far so that the following deltas write
it anew; the first event's role holds. Messages fold each on its own, spread by (conversation, message); only the
finished messages of a conversation meet on its one output row, which holds all its text by definition.

Template: ``<turn ROLE>`` text ``</turn>`` and a line end. In texts ``\`` becomes ``\b`` and ``<`` becomes ``\l`` (in roles
also ``>`` becomes ``\g``), so no text can hold a mark, and undoing ``\g``, ``\l``, ``\b`` in this order restores it. ``mask`` lists
the spans (start, length in code points) of assistant texts.

Null texts and roles count as empty, an event of null kind as a delta, null sequence numbers come first; equal numbers
fall back on kind, role and text. Events without conv_id form one conversation of null id. Repeated events are
applied again: an edit or regeneration twice is the same, a delta twice appends twice. An empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import table

END = "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescape(text: Column) -> Column:
    for mark, plain in (("\\g", ">"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def fold_messages(events: DataFrame) -> DataFrame:
    """One row per (conv_id, message): role, text and the first sequence number."""
    e = F.struct(F.col("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text"))

    # An edit or a regeneration voids all before it, so the fold starts at the last of them.
    voids = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i)))
    live = F.filter("log", lambda x, i: i >= F.col("from"))
    text = F.array_join(F.transform(live, lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"])), "")
    logs = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(e)).alias("log"))
    first = F.get("log", F.lit(0))
    return logs.withColumn("from", F.coalesce(voids, F.lit(0))).select(
        "conv_id", "message", first["seq"].alias("seq"), first["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conv_id: ``formatted``, and ``mask`` with the spans under the loss."""
    head = F.concat(F.lit("<turn "), escape(F.col("role"), True), F.lit(">"))
    earlier = Window.partitionBy("conv_id").orderBy("seq", "message").rowsBetween(Window.unboundedPreceding, -1)
    turns = messages.select("conv_id", "seq", "message", (F.col("role") == "assistant").alias("loss"), head.alias("head"),
                            escape(F.col("text")).alias("body"))
    begin = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(earlier), F.lit(0)) + F.length("head")
    placed = turns.withColumn("start", begin.cast("int"))
    turn = F.struct("seq", "message", "loss", "start", F.length("body").alias("length"), F.concat("head", "body", F.lit(END)).alias("out"))
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"], t["length"])).alias("mask"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: an array of (role, text)."""
    pieces = F.filter(F.split(formatted, F.lit(END)), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.regexp_extract(p, r"\A<turn ([^>]*)>", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, F.lit(">")) + 1)).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["length"]))), "")


def events_of(conversations: DataFrame) -> DataFrame:
    """Conversations as a log: each text streamed in two deltas, drafts of assistants regenerated, system texts edited."""
    conversations = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda k, kind, text: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text"))
    first, second = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    streamed = F.array(event(2, "delta", first), event(3, "delta", second))
    log = (F.when(F.col("role") == "assistant", F.concat(F.array(event(0, "delta", first), event(1, "regenerate", F.lit(""))), streamed))
           .when(F.col("role") == "system", F.array(event(0, "delta", first), event(1, "edit", F.col("text"))))
           .otherwise(streamed))
    numbered = conversations.withColumn("message", F.row_number().over(by_turn).cast("long"))
    return numbered.select("conv_id", "message", "role", F.explode(log).alias("e")).select(
        "conv_id", "message", (F.col("message") * 8 + F.col("e.k")).alias("seq"), F.col("e.kind").alias("kind"), "role",
        F.col("e.text").alias("text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "'\\\\### Assistant: </turn> ok'"
    extra = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, {probe} AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = render(fold_messages(events_of(talks)))
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                            masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_ESCAPED = r"(length(t) + (length(t) - length(replace(replace(t, '\', ''), '<', ''))))"
_ROLE = r"(length(r) + (length(r) - length(replace(replace(replace(r, '\', ''), '<', ''), '>', ''))))"
QUERIES = {"op3_chat_format": op3_chat_format}
ORACLES = {"op3_chat_format": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t) AS spoken,
    coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY turn, r, t), '') AS loss,
    sum({len("<turn >" + END)} + {_ROLE} + {_ESCAPED})::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""}
