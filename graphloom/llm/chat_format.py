"""Chat formatting from event logs.

A log says how conversations came about: a message is opened, text is streamed into it, it is edited, or generated anew, which
also takes back what followed it. The log is partitioned by conversation (a long one in segments of messages), sorted by
sequence, and folded into final messages, which are rendered with turn marks. What a regeneration takes back in later segments
is found from a table of the segments, without their texts. Control strings inside texts get a backslash, so that the output
can be read back: ``read_back`` parses it and gives the turns' and the loss mask's digests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, most_before, shuffle_width

#: What a log's events do to a message; ``open`` may carry a first text.
OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
#: Places of a conversation that are folded together; turns and characters after which a part of the output ends.
SEGMENT, PART_TURNS, PART_CHARS = 64, 64, 1 << 20
#: Marks before and after a turn's text; other roles stand in the mark itself.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("[ROLE {}] ", " [/ROLE]")
#: The role that is trained on.
LEARNED = "assistant"
#: What could be read as a mark. A backslash more goes behind the first character, and comes off again.
_CONTROL = r"(?:/?s>|/?INST\]|/?ROLE[\] ])"
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*{_CONTROL})"), re.compile(rf"([<\[])\\(\\*{_CONTROL})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn with its marks, and where the text begins and ends in it."""
    before, after = MARKS.get(role) or (OTHER[0].format(quote(role, safe="")), OTHER[1])
    inner = escape(text)
    return before + inner + after, len(before), len(before) + len(inner)


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    at = 0
    while at < len(formatted):
        for role, (before, after) in MARKS.items():
            if formatted.startswith(before, at):
                start = at + len(before)
                break
        else:
            head, after = OTHER[0].split("{}")[0], OTHER[1]
            start = formatted.index("] ", at) + 2
            role = unquote(formatted[at + len(head) : start - 2])
        end = formatted.index(after, start)
        yield role, unescape(formatted[start:end])
        at = end + len(after)


def conversation_log(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", delta: int = 512) -> DataFrame:
    """A log of which ``rows`` (one for each turn) are the final messages.

    A hash of the row chooses how its message came about: written at once, streamed in deltas of ``delta`` characters, drafted
    and edited, or drafted, answered, and regenerated. Every row is a message of its own; rows of one turn follow each other by
    a hash of role and text. Nulls: a null role or text is empty, a null turn comes first.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("place"), role.alias("role"), text.alias("text"))
    own = own.withColumn("message", F.concat_ws("-", F.hex(F.xxhash64("role", "text")), F.monotonically_increasing_id()))
    event = lambda kind, text, message="message": F.struct(F.lit(kind).alias("kind"), F.col(message).alias("message"), F.col("role").alias("role"), text.alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{delta}}}"), 0)
    streamed = F.transform(pieces, lambda piece: event(DELTA, piece))
    draft = F.concat(F.left("text", F.lit(delta // 8)), F.lit(" ..."))
    opened = event(OPEN, F.lit(""))
    stale = F.struct(F.lit(OPEN).alias("kind"), F.concat("message", F.lit("-next")).alias("message"), F.lit("user").alias("role"), F.lit("No, again.").alias("text"))
    way = F.pmod(F.xxhash64("conv_id", "place", "role", "text"), F.lit(4))
    events = (
        F.when(way == 0, F.array(event(OPEN, F.col("text"))))
        .when(way == 1, F.concat(F.array(opened), streamed))
        .when(way == 2, F.array(event(OPEN, draft), event(EDIT, F.col("text"))))
        .otherwise(F.concat(F.array(opened, event(DELTA, draft), stale, event(REGENERATE, F.lit(""))), streamed))
    )
    return own.select("conv_id", "place", F.posexplode(events).alias("step", "e")).select(
        "conv_id", "place", "e.message", F.coalesce("place", F.lit(-(2**63))).alias("seq"), "step", "e.kind", "e.role", "e.text"
    )


def _fold_and_render(batches):
    """Folds sorted events into messages and renders them; see ``format_conversations`` for the columns."""

    class Part:
        """Turns that are written together."""

        def __init__(self):
            self.pieces, self.loss, self.length, self.turns = [], [], 0, 0

        def add(self, role: str, text: str) -> None:
            turn, start, end = render_turn(role, text)
            if role == LEARNED:
                self.loss.append({"start": self.length + start, "end": self.length + end})
            self.pieces.append(turn)
            self.length += len(turn)
            self.turns += 1

    class Group:
        """A segment of one conversation, folded event by event."""

        def __init__(self, conv_id, segment):
            self.conv_id, self.segment, self.single, self.number = conv_id, segment, True, 0
            self.taken_back = None  # the latest regeneration of an earlier message
            self.key, self.part, self.done = None, Part(), None
            self.role, self.pieces, self.since, self.renewed = "", None, None, None

        def event(self, key, at, kind, role, text):
            """Takes an event; yields a part that is full."""
            if key != self.key:
                yield from self.close()
                self.key, self.role, self.pieces, self.since, self.renewed = key, "", None, at, None
            if kind == OPEN:
                self.role = role or ""
            if kind != DELTA or self.pieces is None:
                self.pieces, self.since = [], at
            if kind == REGENERATE:
                self.renewed = at
            self.pieces.append(text or "")

        def close(self):
            if self.key is None:
                return
            if self.taken_back is None or self.since > self.taken_back:
                self.part.add(self.role, "".join(self.pieces))
                if self.part.turns >= PART_TURNS or self.part.length >= PART_CHARS:
                    yield from self.shift()
            if self.renewed is not None and (self.taken_back is None or self.renewed > self.taken_back):
                self.taken_back = self.renewed
            self.key = None

        def shift(self):
            """Hands out the part before, since only the last one knows whether it is alone."""
            if self.done:
                yield self.row(self.done, False)
            self.done, self.part = self.part, Part()

        def end(self):
            yield from self.close()
            if self.part.turns:
                yield from self.shift()
            if self.done:
                yield self.row(self.done, self.single and self.number == 0)

        def row(self, part: Part, alone: bool):
            self.number += 1
            return self.conv_id, self.segment, self.number - 1, "".join(part.pieces), part.loss, part.turns, alone

    group = None
    for batch in batches:
        rows = []
        for conv_id, segment, place, message, seq, step, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if group is None or (conv_id, segment) != (group.conv_id, group.segment):
                if group is not None:
                    rows.extend(group.end())
                group = Group(conv_id, segment)
            if kind is None:  # what the segments' table says: the conversation has others
                group.single, group.taken_back = False, None if seq is None else (seq, step)
            else:
                rows.extend(group.event((place, message), (seq, step), kind, role, text))
        if rows:
            yield _parts(batch.schema.field(0).type, rows)
    if group is not None and (rows := list(group.end())):
        yield _parts(pa.int64() if group.conv_id is None else None, rows)


def _parts(conv_type, rows: list[tuple]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (conv_type, pa.int64(), pa.int32(), pa.string(), spans, pa.int64(), pa.bool_())
    names = ["conv_id", "segment", "piece", "formatted", "loss", "n_turns", "alone"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def format_conversations(log: DataFrame) -> DataFrame:
    """The final messages of a log's conversations, with turn marks, as training texts.

    ``log`` has conv_id, place long and message (which message an event is of, and where it stands: messages are ordered by place,
    then message), seq long and step int (the order of events in a conversation), kind, role (of ``open``), text. ``open`` starts
    a message; ``delta`` adds text; ``edit`` replaces the text; ``regenerate`` drops it and takes back later messages that were
    begun before. Returns parts of conversations in order of segment and piece: conv_id, segment, piece, formatted string, loss
    (start and end of the texts to learn, in code points of ``formatted``), n_turns, alone (the conversation has one part).

    Nulls and odd rows: a null text is empty, a null conv_id is a conversation of its own, a null place comes first. Events
    without ``open`` make a message with an empty role. A message is one value, so its final text must fit a row; conversations
    of any length are split. An empty table gives an empty result. Other columns are ignored.
    """
    spark = log.sparkSession
    work = Workspace(spark, "chat-format")
    events = log.select("conv_id", F.floor(F.col("place") / SEGMENT).alias("segment"), "place", "message", "seq", "step", "kind", "role", "text")
    renewed = F.when(F.col("kind") == REGENERATE, F.struct("seq", "step"))
    segments = work.save(events.groupBy("conv_id", "segment").agg(F.max(renewed).alias("renewed")), "segments")
    long = segments.groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("n")).where("n > 1").select("_conv")
    several = segments.join(long, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    # the latest of all earlier segments: conversations are in order, so the greatest pair is the last conversation's
    before = most_before(work, several, [F.col("conv_id"), F.col("segment")], F.struct("conv_id", "renewed"), "before", "several")
    renewal = F.when(F.col("before.conv_id").eqNullSafe(F.col("conv_id")), F.col("before.renewed"))
    before = before.withColumn("renewal", renewal)
    kinds = {f.name: f.dataType for f in events.schema}
    told = before.select(
        "conv_id", "segment", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("place", "message")), F.col("renewal.seq").cast(kinds["seq"]).alias("seq"),
        F.col("renewal.step").cast(kinds["step"]).alias("step"), *(F.lit(None).cast("string").alias(c) for c in ("kind", "role", "text")),
    )
    both = events.unionByName(told).repartition(shuffle_width(spark), "conv_id", "segment")
    order = [F.col("conv_id"), F.col("segment"), F.col("kind").isNotNull(), F.col("place"), F.col("message"), F.col("seq"), F.col("step")]
    conv = kinds["conv_id"].simpleString()
    schema = f"conv_id {conv}, segment long, piece int, formatted string, loss array<struct<start:long,end:long>>, n_turns long, alone boolean"
    return work.save(both.sortWithinPartitions(*order).mapInArrow(_fold_and_render, schema), "formatted")


def _read(batches):
    """Digests of conversations whose parts stand together and in order; one part at a time is in memory."""

    class Digests:
        def __init__(self, conv_id):
            self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
            self.n_turns = self.loss_chars = self.formatted_chars = 0

        def add(self, formatted: str, loss: list[dict]) -> None:
            for role, text in parse_turns(formatted):
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n_turns += 1
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                self.loss.update(text.encode())
                self.loss_chars += len(text)
            self.formatted_chars += len(formatted)

        def row(self):
            return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars

    def out(rows: list[tuple], conv_type) -> pa.RecordBatch:
        kinds = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    held, conv_type = None, None
    for batch in batches:
        conv_type, rows = batch.column(0).type, []
        for conv_id, alone, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None and (alone or conv_id != held.conv_id):
                rows.append(held.row())
                held = None
            if held is None:
                held = Digests(conv_id)
            held.add(formatted, loss)
            if alone:
                rows.append(held.row())
                held = None
        if rows:
            yield out(rows, conv_type)
    if held is not None:
        yield out([held.row()], conv_type)


def read_back(parts: DataFrame) -> DataFrame:
    """What the output of ``format_conversations`` says: conv_id, n_turns long, turns_sha256 string (role and text of every turn,
    each ended by a line feed), loss_chars long, loss_sha256 string (the texts under the loss mask), formatted_chars long.

    A conversation of one part is read where it lies. The parts of others meet and are streamed through the digests, which have no
    other way than from the first turn to the last. An empty table gives an empty result.
    """
    spark = parts.sparkSession
    conv = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    single = parts.where("alone").select("conv_id", "alone", "formatted", "loss")
    others = parts.where(~F.col("alone")).repartition(shuffle_width(spark), "conv_id").sortWithinPartitions("conv_id", "segment", "piece")
    return single.mapInArrow(_read, schema).unionByName(others.select("conv_id", "alone", "formatted", "loss").mapInArrow(_read, schema))


#: What the query gives over ``conversations`` in DuckDB's SQL, where no two rows of a conversation share a turn.
FORMAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*(?:/?s>|/?INST\]|/?ROLE[\] ]))', '\1\\\2', 'g') AS escaped FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 16 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
