"""Chat formatting: conversations rebuilt from an event log, then rendered.

``final_messages`` folds a log (partitioned by conversation, sorted by sequence) into final messages; ``render`` writes
each as one segment of the formatted conversation, with the part of it that a loss may see; ``read_back`` parses the
segments again. A conversation's formatted text is its segments in the order that ``ordered`` gives its messages, so that a
conversation of any length is never one value, and a hot conversation is never held in memory: the digest streams over
sorted rows.

Template: ``<s>[INST] role [/INST]text</s>`` for each message. Inside a role or text a backslash is doubled, and a control
string gets a backslash after its first character; dropping the backslash of each pair undoes both.

Defined results: a NULL text or role is empty; a NULL conversation is a conversation of its own; a NULL sequence comes
first; events with equal sequence are ordered by role, then text; equal rows each count; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, slices, table

# The template's control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)
_PAIR = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])", r"\\")


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def final_messages(events: DataFrame) -> DataFrame:
    """Folds (conv_id, seq long, kind, msg, role, text) into (conv_id, seq, role, text), one row a message.

    kind: ``message`` starts message ``msg`` with its role and text; ``delta`` appends to it; ``edit`` replaces its text;
    ``regenerate`` empties it and drops every message that began after it, so far. Events of a message before its last
    message, edit or regenerate don't count, and a message that never began is no message. ``seq`` of the result is where
    the message began. Other kinds, and a NULL kind or msg, are ignored.
    """
    e = events.select("conv_id", F.coalesce("seq", F.lit(-(2**62))).cast("long").alias("seq"), "kind", "msg", "role", "text").where(
        F.col("kind").isin("message", "delta", "edit", "regenerate") & F.col("msg").isNotNull()
    )
    own = W.partitionBy("conv_id", "msg")
    began = e.withColumn("began", F.min(F.when(F.col("kind") == "message", F.col("seq"))).over(own))
    e = began.withColumn("role", F.max(F.when(F.col("kind") == "message", F.coalesce("role", F.lit("")))).over(own))
    # where the latest event of its message that sets the text anew stands
    began = e.withColumn("reset", F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(own)).where("began IS NOT NULL")
    later = W.partitionBy("conv_id").orderBy(F.col("seq").desc()).rangeBetween(W.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("began"))).over(later)
    live = began.withColumn("cut", cut).where("cut IS NULL OR began <= cut").where("seq >= reset")
    parts = F.sort_array(F.collect_list(F.struct("seq", (F.col("kind") == "delta").alias("late"), "text")))
    folded = live.groupBy("conv_id", "msg", F.col("began").alias("seq")).agg(F.max("role").alias("role"), parts.alias("parts"))
    text = F.concat_ws("", F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))))
    return folded.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def ordered(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text), a conversation's rows together and sorted by sequence, then role, then text."""
    return messages.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) to segments (conv_id, seq, role, segment, loss_start, loss_length).

    The loss mask covers the text of messages whose role is ``assistant``, in characters of the segment.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("<s>[INST] "), role, F.lit(" [/INST]"))
    m = messages.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), text.alias("body"))
    return m.select(
        "conv_id", "seq", "role", F.concat("head", "body", F.lit("</s>")).alias("segment"),
        F.length("head").alias("loss_start"), F.when(F.col("role") == "assistant", F.length("body")).otherwise(0).alias("loss_length"),
    )


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches):
    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows: list[tuple] = []
    at, state = object(), None

    def done():
        if state:
            rows.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def out():
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        got = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)
        rows.clear()
        return got

    for batch in slices(batches, 1024):
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length")]
        for conv, segment, start, length in zip(*cols, strict=True):
            if state is None or conv != at:
                done()
                at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for turn in _TURN.finditer(segment):
                state[0] += 1
                state[1].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
            seen = unescape(segment[start : start + length])
            state[2] += len(seen)
            state[3].update(seen.encode())
            state[4] += len(segment)
        if len(rows) > 4096:
            yield out()
    done()
    yield out()


def read_back(segments: DataFrame) -> DataFrame:
    """Parses rendered segments into one digest a conversation; streams over rows that stand as ``ordered`` leaves them."""
    ship(segments.sparkSession)
    return segments.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(_digests, READ)


def as_events(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as events, each a whole message."""
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.monotonically_increasing_id().alias("msg"), "role", "text"
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose log has deltas, an edit, a regeneration and what it drops."""
    said = "</s>[INST] ok [/INST]"
    log = [
        (-1, 0, "message", -1, "user", "draft"), (-1, 1, "message", -2, "assistant", "first try"), (-1, 2, "delta", -2, None, " goes on"),
        (-1, 3, "edit", -1, None, said), (-1, 4, "message", -3, "user", "an answer to it"), (-1, 5, "regenerate", -2, None, None),
        (-1, 6, "delta", -2, None, said[:3]), (-1, 7, "delta", -2, None, said[3:9]), (-1, 8, "delta", -2, None, said[9:]),
    ]
    extra = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return read_back(render(ordered(final_messages(as_events(rows).unionByName(extra)))))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), f AS (
  SELECT *, '<s>[INST] ' || replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')
    || ' [/INST]' || replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') || '</s>' AS segment
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
