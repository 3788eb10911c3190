"""Chat formatting: turns of typed content parts into one marked-up text per conversation.

A visitor walks a turn's parts in order: texts are escaped, and images, audio and documents
become numbered placeholders with their reference and the number of tokens they expand to.

The template, per turn (fixed strings)::

    ### role:
    content</turn>

A placeholder is ``<|kind:number|>``, numbered through the conversation. In contents a backslash
stands before every backslash and before every control string (``### ``, ``</turn>``, ``<|``);
in roles before line ends too. No control string overlaps another, so taking each backslash
away with the next character kept gives the text back.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, HEAD_END, TURN_END, OPEN, CLOSE = "### ", ":\n", "</turn>\n", "<|", "|>"
LEARNED_ROLE = "assistant"
#: A row holds whole turns up to about so many characters; longer conversations have more rows.
CHUNK_CHARS = 1 << 18
#: Tokens of a part: an image per started square of pixels and at least one, audio per second, a document per page.
IMAGE_SQUARE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1_000

PART = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
CHUNK = ("conv_id {}, chunk int, last boolean, first_turn long, n_turns long, formatted string, "
         "loss array<struct<start:long,end:long>>, attachments array<struct<number:long,kind:string,ref:string,tokens:long,turn:long,at:long>>")

_CONTROL = re.compile(r"\\|### |</turn>|<\|")
_CONTROL_IN_ROLE = re.compile(r"\\|### |</turn>|<\||\n")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: What ends a plain stretch when a content or a role is read.
_NEXT_IN_CONTENT = re.compile(r"(?s)(?:[^\\<]|\\.|<(?![|/])|</(?!turn>))*")
_NEXT_IN_ROLE = re.compile(r"(?s)(?:[^\\\n]|\\.)*")
_PLACEHOLDER = re.compile(r"<\|([a-z]+):(\d+)\|>")


def escaped(text: str, role: bool = False) -> str:
    return (_CONTROL_IN_ROLE if role else _CONTROL).sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class PartVisitor:
    """Flattens the parts of turns: ``out`` is the text so far, ``length`` its code points from the
    conversation's start; ``loss`` and ``attachments`` have places in it."""

    length: int = 0
    number: int = 0
    out: list[str] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def turn(self, index: int, role: str, parts: list[dict]) -> None:
        self.write(HEAD + escaped(role, role=True) + HEAD_END)
        run: list[str] = []  # texts beside each other are one: a control string may span them
        for part in [*parts, None]:
            kind = part and (part.get("kind") or "text")
            if kind == "text":
                run.append(part.get("text") or "")
                continue
            if run:
                self.visit_text("".join(run), role == LEARNED_ROLE)
                run = []
            if part:
                getattr(self, f"visit_{kind}", self.visit_other)(part, index)
        self.write(TURN_END)

    def visit_text(self, text: str, learned: bool) -> None:
        start = self.length
        self.write(escaped(text))
        if learned and text:
            self.loss.append((start, self.length))

    def attach(self, kind: str, part: dict, tokens: int, index: int) -> None:
        self.attachments.append({"number": self.number, "kind": kind, "ref": part.get("ref"), "tokens": tokens, "turn": index, "at": self.length})
        self.write(f"{OPEN}{kind}:{self.number}{CLOSE}")
        self.number += 1

    def visit_image(self, part: dict, index: int) -> None:
        side = lambda x: max(1, -(-(x or 0) // IMAGE_SQUARE))
        self.attach("image", part, side(part.get("width")) * side(part.get("height")), index)

    def visit_audio(self, part: dict, index: int) -> None:
        seconds = part.get("seconds") or 0.0
        self.attach("audio", part, math.ceil(seconds * AUDIO_RATE) if 0 < seconds < math.inf else 0, index)

    def visit_document(self, part: dict, index: int) -> None:
        self.attach("document", part, PAGE_TOKENS * max(part.get("pages") or 0, 0), index)

    def visit_other(self, part: dict, index: int) -> None:
        self.attach("other", part, 0, index)

    def taken(self):
        """What was written since the last call: text, loss and attachments."""
        got = "".join(self.out), self.loss, self.attachments
        self.out, self.loss, self.attachments = [], [], []
        return got


def turns_of(formatted: str):
    """(role, contents) of each turn of a formatted text; contents are texts, and (kind, number) for
    placeholders. Raises where the text isn't of the template."""
    pos = 0
    while pos < len(formatted):
        if not formatted.startswith(HEAD, pos):
            raise ValueError(f"no turn at {pos}")
        line = _NEXT_IN_ROLE.match(formatted, pos + len(HEAD)).end() + 1
        if not formatted.endswith(HEAD_END, pos, line):
            raise ValueError(f"no role at {pos}")
        role, pos, contents = unescaped(formatted[pos + len(HEAD) : line - len(HEAD_END)]), line, []
        while True:
            end = _NEXT_IN_CONTENT.match(formatted, pos).end()
            if end > pos:
                contents.append(unescaped(formatted[pos:end]))
            if formatted.startswith(TURN_END, end):
                pos = end + len(TURN_END)
                break
            mark = _PLACEHOLDER.match(formatted, end)
            if not mark:
                raise ValueError(f"stray control string at {end}")
            contents.append((mark[1], int(mark[2])))
            pos = mark.end()
        yield role, contents


def format_chats(conversations: DataFrame, parts: str | None = None) -> DataFrame:
    """Each conversation's formatted text, with the code points a model learns from (``loss``: the
    texts of the role ``assistant``) and its attachments. All places count code points from the
    conversation's start. A row holds whole turns, up to about 256 K characters: nearly every
    conversation is one row (``chunk`` 0, ``last``); the rows of a longer one follow each other in
    the same partition, so no conversation has to fit in memory.

    ``conversations`` has conv_id, turn, role and text, or typed parts in the column ``parts``, an
    array of structs with fields of PART (kind ``text``, ``image``, ``audio``, ``document``; others
    count as ``other`` with no tokens; a null kind is text). Turns go by turn (null first), then
    role and text. Null role, text or parts are empty; a null conv_id is a conversation too;
    repeated rows are turns of their own; an empty table gives no rows; other columns are not
    read. Texts of any length are formatted whole."""
    content = F.expr(f"transform(coalesce(`{parts}`, array()), p -> cast(p as {PART}))") if parts else F.expr(
        f"array(cast(named_struct('kind', 'text', 'text', text, 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null) as {PART}))")
    only_text = parts is None
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), (F.coalesce("text", F.lit("")) if only_text else content).alias("content"))
    # parts have no order of their own worth having: ties of turn and role go by their JSON text
    tie = F.col("content") if only_text else F.to_json("content")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", tie)
    kind = CHUNK.format(rows.schema["conv_id"].dataType.simpleString())

    def run(batches):
        import pyarrow as pa

        visitor = state = None

        def row(last):
            text, loss, attached = visitor.taken()
            out = {"conv_id": state["conv_id"], "chunk": state["chunk"], "last": last, "first_turn": state["first"], "n_turns": state["turns"] - state["first"],
                   "formatted": text, "loss": [{"start": a, "end": b} for a, b in loss], "attachments": attached}
            state["chunk"], state["first"] = state["chunk"] + 1, state["turns"]
            return out

        for b in batches:
            done, size = [], 0
            for conv_id, role, content in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if state is None or state["conv_id"] != conv_id:
                    if state is not None:
                        done.append(row(True))
                    visitor, state = PartVisitor(), {"conv_id": conv_id, "chunk": 0, "first": 0, "turns": 0, "from": 0}
                elif visitor.length - state["from"] >= CHUNK_CHARS:
                    done.append(row(False))
                    state["from"] = visitor.length
                was = visitor.length
                visitor.turn(state["turns"], role, [{"kind": "text", "text": content}] if only_text else content)
                state["turns"] += 1
                size += visitor.length - was
                if size > 4 * CHUNK_CHARS and done:
                    yield pa.RecordBatch.from_pylist(done, shape)
                    done, size = [], 0
            if done:
                yield pa.RecordBatch.from_pylist(done, shape)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(True)], shape)

    shape = _arrow_shape(conversations, kind)
    return rows.mapInArrow(run, kind)


def _arrow_shape(df: DataFrame, kind: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], kind).schema)


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars,
    loss_sha256, formatted_chars, n_attachments and attachment_tokens of every conversation, from
    the formatted rows alone. ``in_order``: the rows of a conversation lie one after another, as
    format_chats leaves them; else they are shuffled and sorted first. Raises where a text isn't of
    the template, a placeholder has no attachment or a loss span isn't an assistant's text."""
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    rows = formatted.select("conv_id", "last", "formatted", "loss", "attachments")
    kind = (f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
            "formatted_chars long, n_attachments long, attachment_tokens long")
    shape = _arrow_shape(formatted, kind)

    def run(batches):
        import hashlib

        import pyarrow as pa

        fresh = lambda: {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "at": 0, "n": 0, "tokens": 0}
        s = fresh()
        for b in batches:
            done = []
            for conv_id, last, text, loss, attached in zip(*(c.to_pylist() for c in b.columns)):
                marks, learned = [], []
                for role, contents in turns_of(text):
                    said = "".join(x for x in contents if isinstance(x, str))
                    marks += [x for x in contents if not isinstance(x, str)]
                    if role == LEARNED_ROLE:
                        learned += [x for x in contents if isinstance(x, str)]
                    s["turns"] += 1
                    s["all"].update(f"{role}\n{said}\n".encode())
                spans = [unescaped(text[x["start"] - s["at"] : x["end"] - s["at"]]) for x in loss]
                if spans != learned:
                    raise ValueError(f"conversation {conv_id}: the loss spans are not the assistant's texts")
                if marks != [(a["kind"], a["number"]) for a in attached]:
                    raise ValueError(f"conversation {conv_id}: placeholders and attachments differ")
                for x in spans:
                    s["chars"] += len(x)
                    s["loss"].update(x.encode())
                s["at"] += len(text)
                s["n"] += len(attached)
                s["tokens"] += sum(a["tokens"] for a in attached)
                if last:
                    done.append({"conv_id": conv_id, "n_turns": s["turns"], "turns_sha256": s["all"].hexdigest(), "loss_chars": s["chars"], "loss_sha256": s["loss"].hexdigest(),
                                 "formatted_chars": s["at"], "n_attachments": s["n"], "attachment_tokens": s["tokens"]})
                    s = fresh()
            if done:
                yield pa.RecordBatch.from_pylist(done, shape)

    return rows.mapInArrow(run, kind)


#: A conversation whose texts hold control strings of this template and of others (fixed value).
TRICKY_ID, TRICKY_TEXT = -7, r"\### Assistant: </turn> ok"


def with_tricky(conversations: DataFrame) -> DataFrame:
    """The conversations' four columns, and conversation -7: a user and an assistant who say the same."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    more = rows.sparkSession.createDataFrame([(TRICKY_ID, 0, "user", TRICKY_TEXT), (TRICKY_ID, 1, "assistant", TRICKY_TEXT)], rows.schema)
    return rows.unionByName(more)


def chat_digests(conversations: DataFrame) -> DataFrame:
    return read_back(format_chats(with_tricky(conversations)), in_order=True)


def duckdb_sql() -> str:
    slashes = lambda x, pattern: f"regexp_replace({x}, '{pattern}', '\\\\\\0', 'g')"
    content, role = r"\\|### |</turn>|<\|", r"\\|### |</turn>|<\||\n"
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {TRICKY_ID}, n, case n when 0 then 'user' else 'assistant' end, '{TRICKY_TEXT}' from range(2) r(n)),
f as (
  select *, '### ' || {slashes('role', role)} || ':' || chr(10) || {slashes('text', content)} || '</turn>' || chr(10) as turn_text,
         case when role = 'assistant' then text else '' end as learned from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       sum(length(learned))::bigint as loss_chars,
       sha256(string_agg(learned, '' order by turn nulls first, role, text)) as loss_sha256,
       sum(length(turn_text))::bigint as formatted_chars, 0::bigint as n_attachments, 0::bigint as attachment_tokens
from f group by conv_id"""
