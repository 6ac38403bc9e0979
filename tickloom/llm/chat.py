"""Chat formatting by incremental black-box rendering.

A template is a function from a list of messages to a text; nothing else is known about it. Successive turn prefixes are rendered, and consecutive outputs are compared: where the longer one begins with the shorter one, the rest is the new turn's span; where it doesn't, the template rewrites history, which is reported. A turn's text inside its span is found by rendering the turn again with two probe texts: what both share before and after the probe is the template's own.

Rows are dealt by conversation and streamed in turn order. Prefixes are whole at every length, so a task holds a conversation's turns, and its time grows with their square. Whoever has endless conversations and a template whose turns don't depend on those before may set ``window``: a prefix then begins at most that many turns back. Each time it is cut, both renderings are compared, and a template that depends on earlier turns is an error.

A conversation whose template rewrites history has no spans that follow one another; its digest holds its length and the flag, and null for what would be read back from spans.

Null texts and roles are empty; rows without a conversation id form one conversation; turns that are equal in number are ordered by role and text, and repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

Messages = list[dict[str, str]]

#: Probe texts: one private-use character each, which templates have no reason to treat differently.
PROBES = ("\ue000", "\ue001")


@dataclass(frozen=True)
class Template:
    """``render``: messages to text. ``unescape``: a rendered text to what it stands for. ``read``: a turn's span to (role, text)."""

    render: Callable[[Messages], str]
    unescape: Callable[[str], str]
    read: Callable[[str], tuple[str, str]]


def escape(text: str, control: str = "\\#<") -> str:
    """A backslash before each character of ``control``, so that no marker can appear in the result."""
    return "".join("\\" + c if c in control else c for c in text) if any(c in text for c in control) else text


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0 and k + 1 < len(text):
        out.append(text[at:k] + text[k + 1])
        at = k + 2
    return "".join(out) + text[at:]


def render_marked(messages: Messages) -> str:
    """``### role: text</turn>`` and a line feed for each turn."""
    return "".join(f"### {escape(m['role'], chr(92) + '#<:')}: {escape(m['text'])}</turn>\n" for m in messages)


def read_marked(span: str) -> tuple[str, str]:
    body = span.removeprefix("### ").removesuffix("</turn>\n")
    at = body.index(": ")
    while (len(body[:at]) - len(body[:at].rstrip("\\"))) % 2:  # that colon is escaped
        at = body.index(": ", at + 1)
    return unescape(body[:at]), unescape(body[at + 2 :])


MARKED = Template(render_marked, unescape, read_marked)


@dataclass
class Turn:
    """``span``: the turn's part of the output; ``inside``: where its text lies in the span, (-1, -1) if that can't be told; ``rewrites``: the output before didn't stay as it was; ``shared``: how much of it did; ``lost``: how much didn't."""

    span: str
    inside: tuple[int, int]
    rewrites: bool
    shared: int
    lost: int = 0


def common(a: str, b: str) -> int:
    """How many characters a and b begin with in common: halves are compared whole."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def next_turn(before: Messages, message: dict[str, str], rendered: str, template: Template) -> tuple[Turn, str]:
    """The turn that ``message`` adds after ``before``, whose rendering is ``rendered``; and the new rendering."""
    out = template.render([*before, message])
    if not out.startswith(rendered):
        shared = common(rendered, out)
        return Turn(out[shared:], (-1, -1), True, shared, len(rendered) - shared), out
    span = out[len(rendered) :]
    probes = [template.render([*before, message | {"text": p}]) for p in PROBES]
    if not all(p.startswith(rendered) for p in probes):
        return Turn(span, (-1, -1), False, len(rendered)), out
    a, b = (p[len(rendered) :] for p in probes)
    first = common(a, b)
    tail = common(a[::-1], b[::-1])
    last = len(span) - tail
    fits = first < len(a) and a[first] == PROBES[0] and span.startswith(a[:first]) and last >= first and span.endswith(a[len(a) - tail :])
    return Turn(span, (first, last) if fits else (-1, -1), False, len(rendered)), out


class Renderer:
    """Turns of one conversation, one after the other; with ``window``, that many turns in memory at most."""

    def __init__(self, template: Template, window: int | None = None):
        self.template, self.window = template, window
        self.before: Messages = []
        self.rendered = template.render([])

    def add(self, role: str, text: str) -> Turn:
        if self.window and len(self.before) >= self.window:
            self.shift()
        message = {"role": role, "text": text}
        turn, self.rendered = next_turn(self.before, message, self.rendered, self.template)
        self.before.append(message)
        return turn

    def shift(self) -> None:
        """Takes the older half of the turns off."""
        half = max(1, self.window // 2)
        empty, off, kept = (self.template.render(m) for m in ([], self.before[:half], self.before[half:]))
        if not (self.rendered.startswith(off) and kept.startswith(empty) and self.rendered[len(off) :] == kept[len(empty) :]):
            raise ValueError("the template's turns depend on those before: it needs whole prefixes")
        self.before, self.rendered = self.before[half:], kept


TURNS = "n long, role string, begin long, end long, text_begin long, text_end long, span string, rewrites boolean"


def format_turns(df: DataFrame, template: Template = MARKED, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", window: int | None = None, partitions: int | None = None) -> DataFrame:
    """A row per turn, in order inside its partition: (conversation, n, role, begin, end, text_begin, text_end, span, rewrites). Positions are characters of the formatted conversation; -1 where a text's place can't be told."""
    spark = df.sparkSession
    bounded_batches(spark, 1000)
    own = df.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    dealt = (own.repartition(partitions, "c") if partitions else own.repartition("c")).sortWithinPartitions("c", "t", "r", "x")
    names = [conv_col, "n", "role", "begin", "end", "text_begin", "text_end", "span", "rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, renderer, n, at = object(), None, 0, 0
        for b in batches:
            rows = []
            for c, r, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if c != current:
                    current, renderer, n, at = c, Renderer(template, window), 0, 0
                    at = len(renderer.rendered)
                turn = renderer.add(r, x)
                begin = at - turn.lost
                inside = [begin + p if p >= 0 else -1 for p in turn.inside]
                rows.append((n, r, begin, begin + len(turn.span), *inside, turn.span, turn.rewrites))
                n, at = n + 1, begin + len(turn.span)
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(cols, kinds))], names=names)

    kind = df.schema[conv_col].dataType.simpleString()
    return dealt.mapInArrow(run, f"{conv_col} {kind}, {TURNS}")


def conversation_digest(turns: DataFrame, template: Template = MARKED, conv_col: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation, from the spans of ``format_turns`` (whose order inside partitions it keeps): what the output says when it is read back."""
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done(s: list) -> tuple:
            read = (None, None, None) if s[6] else (s[2].hexdigest(), s[3], s[4].hexdigest())
            return (s[1], *read, s[5], s[6])

        for b in batches:
            ids, rows = [], []
            for c, begin, end, first, last, span, rewrites in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5, 6, 7, 8))):
                if state is None or c != state[0]:
                    if state is not None:
                        ids.append(state[0])
                        rows.append(done(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                state[1] += 1
                state[5] = end
                state[6] |= rewrites
                if state[6]:
                    continue
                role, text = template.read(span)
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if role == loss_role:
                    learned = template.unescape(span[first - begin : last - begin]) if first >= 0 else text
                    state[3] += len(learned)
                    state[4].update(learned.encode("utf-8", "replace"))
            yield batch(ids, rows)
        if state is not None:
            yield batch([state[0]], [done(state)])

    kind = turns.schema[conv_col].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]

    def batch(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(ids, arrow), *(pa.array(v, k) for v, k in zip(cols, kinds))], names=names)

    return turns.mapInArrow(run, f"{conv_col} {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")


def oracle(planted: str) -> str:
    """The digest of ``conversations`` and the planted one under the marked template, as SQL: from the rows, without any rendering."""
    text = planted.replace("'", "''")
    count = lambda column, marks: f"(length({column}) + length(regexp_replace({column}, '[^{marks}]', '', 'g')))"
    order = "ORDER BY turn NULLS FIRST, role, text"
    fixed = len("### " + ": " + "</turn>\n")
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{text}'), (-7, 1, 'assistant', '{text}')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({fixed} + {count("role", chr(92) * 4 + "#<:")} + {count("text", chr(92) * 4 + "#<")}) AS BIGINT) AS formatted_chars, false AS rewrites_history FROM r GROUP BY conv_id"""
