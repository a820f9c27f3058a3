"""Chat formatting from an event log.

A conversation is what its events leave: partition by conversation, sort by
sequence, fold.  ``start`` opens a message, ``delta`` adds to it, ``edit``
replaces its text, ``regenerate`` empties it and drops the messages after it
that were begun before.  Messages are folded from runs of their events and
conversations from runs of their messages, so only strings that end up in one
output cell ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordclips.llm.catalog import query, table
from wordclips.llm.text import whole
from wordclips.operators import ordered

#: The template: <|start|> role <|say|> text <|end|> and a line end.
START, SAY, END = "<|start|>", "<|say|>", "<|end|>\n"
RUN = 64


def escape(text: Column) -> Column:
    """No control string starts in the result: ``<``, ``[`` and ``\\`` are each followed by ``\\``.

    Breaks up this template's marks and those of other templates alike
    (``</s>``, ``[INST]``, ``<|im_end|>``).
    """
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def events_of_turns(turns: DataFrame, piece: int = 200) -> DataFrame:
    """The log that ``turns`` (conv_id, turn, role, text) would have streamed.

    Each row starts a message and streams its text in deltas of up to ``piece``
    code points; null text: empty.  Rows of one turn come in order of role and
    text; equal rows are messages of their own.  A null turn comes first.
    """
    same = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    message = F.struct("turn", "role", whole("text").alias("text"), F.col("again").alias("again"))
    rows = same.withColumn("again", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))) \
        .withColumn("message", message)
    pieces = F.regexp_extract_all(whole("text"), F.lit(r"(?s).{1,%d}" % piece), F.lit(0))
    log = F.concat(
        F.array(F.struct(F.lit("start").alias("kind"), F.lit("").alias("text"))),
        F.transform(pieces, lambda p: F.struct(F.lit("delta").alias("kind"), p.alias("text"))))
    return rows.select("conv_id", "message", "role", F.posexplode(log).alias("seq", "event")) \
        .select("conv_id", "message", F.col("seq").cast("bigint").alias("seq"),
                "event.kind", "role", "event.text")


def _fold(parts: Column) -> Column:
    """Parts in order -> (fresh, text): the last part that starts afresh and all after it."""
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x["fresh"], i + 1).otherwise(0)))
    live = F.slice(parts, F.greatest(last, F.lit(1)), F.size(parts))
    return F.struct((last > 0).alias("fresh"),
                    F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text of every message that remains.

    ``events`` has conv_id, message (any orderable value), seq (bigint, the
    place in the conversation's log), kind, role, text.  A delta before any
    start counts from an empty text; null text: empty; null seq: first; a null
    role takes no part in naming the message, whose role is that of its first
    event with one.  Equal seqs are folded in order of kind and text.
    """
    fresh = F.col("kind") != "delta"
    part = F.struct("seq", "kind", whole("text").alias("text"), fresh.alias("fresh"))
    runs = events.groupBy("conv_id", "message", F.floor(F.col("seq") / RUN).alias("run")).agg(
        _fold(F.sort_array(F.collect_list(part))).alias("f"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.min("seq").alias("first"), F.max(F.when(fresh, F.col("seq"))).alias("begun"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"))
    part = F.struct("run", F.col("f.text").alias("text"), F.col("f.fresh").alias("fresh"))
    folded = runs.groupBy("conv_id", "message").agg(
        _fold(F.sort_array(F.collect_list(part)))["text"].alias("text"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("first", "role"))).alias("role"),
        F.coalesce(F.max("begun"), F.min("first")).alias("begun"), F.max("redone").alias("redone"))
    return folded


def drop_redone(messages: DataFrame, chunk: Column) -> DataFrame:
    """Without messages that an earlier message's ``regenerate`` has made void.

    ``chunk`` doesn't fall along ``message``: a conversation of any length is
    scanned in chunks.
    """
    named = messages.withColumn("conv", F.struct("conv_id"))
    marked = ordered.scan(named.withColumn("c", chunk), ["conv"], ["message"], F.col("c"),
                          upto=ordered.running_max("redone"))
    # Its own regenerate is at `begun` at the latest, so it never drops the message itself.
    return marked.where("upto IS NULL OR begun IS NULL OR upto <= begun").drop("conv", "c", "upto")


def render(messages: DataFrame, run: Column, learn: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, and segments (text, learn) whose texts make it up.

    Segments with ``learn`` are the loss mask: the texts of ``learn`` messages,
    escaped as they stand in ``formatted``.  ``run`` doesn't fall along
    ``message``; it numbers stretches of a conversation that are put together first.
    """
    head = F.concat(F.lit(START), escape(whole("role")), F.lit(SAY))
    body = escape(whole("text"))
    mine = F.coalesce(F.col("role") == learn, F.lit(False))
    segment = lambda t, on: F.struct(t.alias("text"), on.alias("learn"))
    segments = F.when(mine, F.array(segment(head, F.lit(False)), segment(body, F.lit(True)),
                                    segment(F.lit(END), F.lit(False)))) \
        .otherwise(F.array(segment(F.concat(head, body, F.lit(END)), F.lit(False))))
    piece = F.struct("message", segments.alias("segments"))
    runs = messages.withColumn("run", run).groupBy("conv_id", "run").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["segments"])).alias("segments"))
    whole_chat = runs.groupBy("conv_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("run", "segments"))), lambda x: x["segments"])).alias("segments"))
    return whole_chat.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted conversation."""
    turns = F.split(formatted, r"<\|end\|>\n")
    turns = F.slice(turns, 1, F.size(turns) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substr(F.substring_index(t, SAY, 1), F.lit(len(START) + 1))).alias("role"),
        unescape(F.substring_index(t, SAY, -1)).alias("text")))


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["learn"]),
                                    lambda s: unescape(s["text"])), "")


_PROBE = "</s>[INST] ok [/INST]"

OP8_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')
           AS loss,
         sum(length(regexp_replace(role || text, '([<\\[\\\\])', '\\1\\\\', 'g'))
             + {len(START) + len(SAY) + len(END)}) AS formatted
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted AS BIGINT) AS formatted_chars
FROM chats
"""


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows of conversations through the log: conv_id, segments, formatted."""
    messages = fold_events(events_of_turns(turns))
    run = F.coalesce(F.floor(F.col("message.turn") / RUN), F.lit(-2**62))
    return render(drop_redone(messages, run), run)


@query("op8_chat_events", OP8_SQL)
def op8_chat_events(spark, sf_dir):
    """Contract: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = turns.schema
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)],
                                  "conv_id bigint, turn bigint, role string, text string")
    probe = probe.select(*[F.col(f.name).cast(f.dataType) for f in kinds])
    chats = format_turns(turns.unionByName(probe))
    back = chats.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
