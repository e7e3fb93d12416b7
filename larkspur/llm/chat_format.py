"""Chat formatting from event logs, with DataFrame operations only.

A log's events have a conversation, a sequence number, a kind, a message, a role and a text:
`message` (a whole message), `delta` (a streamed piece), `edit` (replaces all text so far) and
`regenerate` (empties the message; deltas that follow stream it anew). Logs are partitioned
by conversation and message, sorted by sequence number and folded: the last message, edit or
regenerate event starts a message's final text, the deltas after it complete it. A message stands
where its first event stands and has the role first given to it.

`render` writes each conversation as segments in order, opening mark, text, closing mark, with a
loss flag on assistant texts. Control strings inside texts (and roles) are broken by a backslash
after their first character, and backslashes are doubled, so `unescape` gives back the same text and
no text can end a turn. `read_back` reads formatted text alone: it splits it at the marks and unescapes.

The fold is dealt out by conversation and message, so one hot conversation is folded by many tasks.
Only rendering brings a conversation together, as its output is one value (and its digests are of the
whole); a conversation must thus be within Spark's 2 GB for a value.

Rows by turn become a log (`as_events`) in which each row is a message with an id of its own, so they go through the same fold.
What a model is trained on is taken from the formatted text alone: it is split into turns again, and those of the trained role count.

Defined results: null text is empty, null role the empty role, null kind a message. Messages of equal sequence number are
ordered by role and text (equal ones are alike); repeated rows of kind `message` without a message id are messages of
their own. A null conversation is one conversation. Empty table: no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
# What chat templates in use treat as control strings. All are broken after their first character.
CONTROLS = r"<(?=\|)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({CONTROLS})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role ends at the line's end, so its own line ends are written as backslash and n."""
    return F.regexp_replace(escape(role), "\n", r"\\n")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def fold(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, kind, message_id, role, text) to messages (conv_id, seq, message_id, role, text)."""
    kind = F.coalesce("kind", F.lit("message"))
    rows = events.select("conv_id", "seq", kind.alias("kind"), "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # a whole message without an id is a message of its own and needs no folding
    lone = rows.filter("message_id is null and kind = 'message'").select("conv_id", "seq", "message_id", "role", "text")
    parts = rows.filter("message_id is not null or kind <> 'message'")
    # keys that deal out the fold; all sequence numbers of a message meet
    message = Window.partitionBy("conv_id", "message_id")
    start = F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(message)
    live = parts.withColumn("start", start).withColumn("first", F.min("seq").over(message))
    text = F.when(F.col("start").isNull() | (F.col("seq") >= F.col("start")), F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text")))
    folded = live.groupBy("conv_id", "message_id").agg(
        F.min("first").alias("seq"), F.min(F.struct("seq", "role"))["role"].alias("role"),
        # an event at the start's own sequence number that isn't a delta comes first
        F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("seq", (F.col("kind") == "delta").alias("later"), text.alias("t"))))).alias("pieces"),
    )
    folded = folded.select("conv_id", "seq", "message_id", "role", F.array_join(F.transform("pieces", lambda p: p["t"]), "").alias("text"))
    return lone.unionByName(folded)


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, formatted): loss marks what a model is trained on."""
    turn = F.struct("seq", "role", "text")
    gathered = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segments(t):
        mark = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
        return F.array(
            mark(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == trained).alias("loss")),
            mark(F.lit(f"{END}\n")),
        )

    cut = gathered.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"))
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of formatted text: split at the marks, which no escaped text holds, then unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    cut = lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))).alias("text"))
    return F.transform(F.transform(pieces, body), cut)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def trained_text(turns: Column, trained: str = "assistant") -> Column:
    """All text of the trained role's turns, as `read_back` gives them, with nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == trained), lambda t: t["text"]), "")


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log: every row a whole message at its turn, with an id of its own, so repeated rows stay apart.

    The id is the row's place in the input, which a task that runs again finds the same; nothing is shuffled for it."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.monotonically_increasing_id().cast("string").alias("message_id"), role, text)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(asked).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = render(fold(as_events(rows)))
    # all that follows is read back from the formatted text; digests are computed of columns bound once
    read = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"))
    read = read.select("conv_id", "formatted_chars", "turns", trained_text(F.col("turns")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


_ESCAPED = r"regexp_replace(replace(coalesce({}, ''), '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"
OP5_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
