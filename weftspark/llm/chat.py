"""Operator 9: chat formatting by rendering ever longer beginnings of a conversation.

The template is a black box from turns to text.  Rendering one turn more and
comparing with the output before tells where that turn's text went; an output
that does not begin with the one before tells that the template rewrites
history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partition_count

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: What opens and closes a turn of each role.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = re.compile(r"[\\\[<]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    r"\[SYS\]((?:[^\\\[]++|\\.)*+)\[/SYS\]|\[INST\]((?:[^\\\[]++|\\.)*+)\[/INST\]|<s>((?:[^\\<]++|\\.)*+)</s>|\[ROLE ((?:[^\\\]]++|\\.)*+)\]((?:[^\\\[]++|\\.)*+)\[/ROLE\]",
    re.DOTALL,
)
#: Stands in for a turn's text while its place is sought, lengthened until no text holds it; no template writes private characters of its own.
_PROBE = "\ue000\ue001"


def _probe(turns: list[Turn]) -> str:
    probe = _PROBE
    while any(probe in role or probe in text for role, text in turns):
        probe += _PROBE[-1]
    return probe


def escape(text: str) -> str:
    """A text in which no control string can stand: each ``\\``, ``[`` and ``<`` gets a backslash."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(turns: list[Turn]) -> str:
    """The production template: each turn between its role's marks, control strings in texts escaped."""
    out = []
    for role, text in turns:
        opens, closes = MARKS.get(role) or (f"[ROLE {escape(role).replace(']', chr(92) + ']')}]", "[/ROLE]")
        out += [opens, escape(text), closes]
    return "".join(out)


def read_marked(formatted: str) -> list[Turn]:
    """The turns that :func:`marked` was given."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        system, user, assistant, role, other = m.groups()
        if role is not None:
            turns.append((unescape(role), unescape(other)))
        else:
            turns.append(next((r, unescape(t)) for r, t in (("system", system), ("user", user), ("assistant", assistant)) if t is not None))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


Span = tuple[int, int, int, int]
#: Turns that are rendered again and again with what came before, where a template allows it.
BLOCK = 16


def _prefixes(turns: list[Turn], template: Template) -> tuple[str, list[Span]] | None:
    """The text and each turn's place in it by rendering ever longer beginnings; None if one is rewritten by a later one.

    Each turn costs one rendering of what came so far and one with a probe for its text.
    """
    before, spans, mark = template([]), [], _probe(turns)
    for i in range(len(turns)):
        now = template(turns[: i + 1])
        probe = template([*turns[:i], (turns[i][0], mark)])
        at = probe.find(mark, len(before))
        if not now.startswith(before) or at < 0 or not probe.startswith(before):
            return None
        spans.append((len(before), len(now), at, len(now) - (len(probe) - at - len(mark))))
        before = now
    return before, spans


def _in_blocks(turns: list[Turn], template: Template) -> tuple[str, list[Span]] | None:
    """The same block by block; None unless the blocks' texts, put together, are what the template makes of the conversation up to each block's end.

    A template may open every text with something of its own, ``template([])``: it counts once.
    """
    head = template([])
    text, spans, size = head, [], len(head)
    for i in range(0, len(turns), BLOCK):
        done = _prefixes(turns[i : i + BLOCK], template)
        if done is None or not done[0].startswith(head):
            return None
        move = size - len(head)
        spans += [tuple(x + move for x in s) for s in done[1]]
        text += done[0][len(head) :]
        size = len(text)
        if text != template(turns[: i + BLOCK]):
            return None
    return text, spans


def render(turns: list[Turn], template: Template = marked) -> tuple[str, list[Span], bool]:
    """The conversation's text, each turn's (start, end, text_start, text_end) in it, and whether the template rewrites history.

    Beginnings within blocks of turns are rendered and compared.  That stands if
    the blocks' texts together are what the template makes of the conversation up to
    the end of each block: a sixteenth of all beginnings is rendered whole, so a
    template that rewrites what is a block or more behind is found too.  Otherwise (turn numbers, say) beginnings
    of the whole conversation are, which costs the square of its length.  After a
    rewrite, turns are sought by probes in the whole.
    """
    done = _in_blocks(turns, template) or _prefixes(turns, template)
    if done:
        return *done, False
    whole, spans, mark = template(turns), [], _probe(turns)
    for i, (role, _) in enumerate(turns):
        probe = template([*turns[:i], (role, mark), *turns[i + 1 :]])
        at = probe.find(mark)
        # A turn that the template leaves out has no place.
        end = len(whole) - (len(probe) - at - len(mark)) if at >= 0 else -1
        spans.append((at, end, at, end))
    return whole, spans, True


_SPAN = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64())])


def format_chats(conversations: DataFrame, template: Template = marked) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (role, start, end, text_start, text_end in code points), rewrites.

    Turns are taken by turn (null first), then role and text, so that repeated
    turns all stay in a defined order, turns of one number too.  Null roles and
    texts are empty; rows without conv_id are one conversation; an empty table has
    none.  Extra columns are ignored.  Rows are dealt by conversation and
    streamed; one conversation at a time is in memory, for its formatted text is
    one value of the result.  So a conversation may be as long as one value may
    be, and is one task's work, in proportion to its length (see :func:`render`).
    """
    turns = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = turns.repartition(partition_count(conversations), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kind = None, [], None
        done: list[tuple] = []
        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != key:
                    done.append((key, held, *render(held, template)))
                    size += len(done[-1][2])
                    held = []
                    if size > 8 << 20:
                        yield _chats(done, kind)
                        done, size = [], 0
                key = conv
                held.append((role, text))
        if held:
            done.append((key, held, *render(held, template)))
        if done:
            yield _chats(done, kind)

    schema = ordered.select("conv_id", F.lit("").alias("formatted")).schema
    return ordered.mapInArrow(run, f"conv_id {schema['conv_id'].dataType.simpleString()}, formatted string, spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long>>, rewrites boolean")


def _chats(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    spans = [[dict(zip(("role", "start", "end", "text_start", "text_end"), (t[0], *s), strict=True)) for t, s in zip(turns, at, strict=True)] for _, turns, _, at, _ in done]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[2] for x in done], pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array([x[4] for x in done], pa.bool_())], names=["conv_id", "formatted", "spans", "rewrites"])


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites.

    The loss mask is the texts of assistants.  ``rewrites``: whether the template
    was found to change what it had written before.
    """
    formatted = format_chats(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns = read_marked(text)
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == "assistant")
                told = "".join(f"{role}\n{t}\n" for role, t in turns)
                rows.append((len(turns), _sha(told), len(loss), _sha(loss), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), batch.column("rewrites")], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
