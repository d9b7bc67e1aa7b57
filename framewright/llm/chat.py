"""Chat formatting by a declarative template, with a loss flag for each segment.

A finite-state machine over the roles reads the turns in order and marks those
that are out of order. A template names what stands before and after a turn of
each role and whether its text counts for the loss. Control strings inside
texts are escaped, so that only the template's own marks are control strings.
Reading back takes the segments of a conversation as one string: where they were
cut does not matter. An automaton finds each turn's opening mark, the role it
stands for, and the closing mark of that role; only then is a text unescaped.
A string that is no sequence of whole turns is an error.

Turns are sorted within partitions of whole conversations and read as a stream,
so a conversation of any length takes the memory of one turn.

Order: by turn, then role and text, nulls first. Nulls: a null text or role is
empty; rows without a conversation id form one conversation. Unknown roles get
the template's ``other`` marks, which hold the role's name. Repeated rows are
turns each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Marks:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Marks]
    other: Marks
    turns: dict[str, tuple[str, ...]]  # the roles that may follow each; "" is the start
    controls: tuple[str, ...]
    escape: str = "\\"
    _pattern: regex.Pattern = field(init=False, compare=False, default=None)

    def __post_init__(self):
        e = regex.escape(self.escape)
        rest = "|".join(f"{regex.escape(c[0])}{e}*{regex.escape(c[1:])}" for c in self.controls)
        object.__setattr__(self, "_pattern", regex.compile(rest))
        head, tail = self.other.before.split("{role}")
        opening = [*(m.before for m in self.roles.values()), head]
        closing = [*(m.after for m in self.roles.values()), self.other.after, tail]
        for mark in (*opening, *closing):
            if not any(c in mark for c in self.controls):
                raise ValueError(f"the mark {mark!r} holds no control string")
        for mark in closing:  # one that overlaps itself could begin in the text before it
            if any(mark.startswith(mark[k:]) for k in range(1, len(mark))):
                raise ValueError(f"the mark {mark!r} ends as it begins")
        for k, mark in enumerate(opening):
            if any(other.startswith(mark) for other in opening[:k] + opening[k + 1 :]):
                raise ValueError(f"the mark {mark!r} begins another one")

    def escaped(self, text: str) -> str:
        """An escape more after the first character of every control string, escaped or not."""
        return self._pattern.sub(lambda m: m[0][0] + self.escape + m[0][1:], text)

    def unescaped(self, text: str) -> str:
        return self._pattern.sub(lambda m: m[0][0] + m[0][1 + len(self.escape) :], text)

    def marks(self, role: str) -> Marks:
        return self.roles.get(role) or Marks(self.other.before.replace("{role}", self.escaped(role)), self.other.after, self.other.loss)


INSTRUCTION = Template(
    roles={
        "system": Marks("<<SYS>>", "<</SYS>>"),
        "user": Marks("[INST] ", " [/INST]"),
        "assistant": Marks("<s>", "</s>", loss=True),
    },
    other=Marks("[ROLE]{role}[/ROLE]", "[/TURN]"),
    turns={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"),
)


def _in_order(df: DataFrame, conversation: str, *order: str) -> DataFrame:
    return df.repartition(conversation).sortWithinPartitions(conversation, *order)


def format_chats(turns: DataFrame, template: Template = INSTRUCTION, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Three segments a turn: conv_id, position, text, loss, and whether the turn is in order."""
    source = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        conversation, state, position = object(), "", 0
        for batch in batches:
            rows = []
            for conv, _, who, said in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != conversation:
                    conversation, state, position = conv, "", 0
                marks, good = template.marks(who), who in template.turns.get(state, ())
                for segment, loss in ((marks.before, False), (template.escaped(said), marks.loss), (marks.after, False)):
                    rows.append((conv, position, segment, loss, good))
                    position += 1
                state = who
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    types, names = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()], ["conv_id", "position", "text", "loss", "in_order"]
    return _in_order(source, "conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, position long, text string, loss boolean, in_order boolean")


class _Reader:
    """The automaton that reads one conversation, from pieces of its formatted string.

    It waits for an opening mark, the end of a role's name, or the end of a text,
    and holds no more than the turn it is in.
    """

    def __init__(self, template: Template):
        self.template = template
        self.opening = {m.before: r for r, m in template.roles.items()}
        self.head, self.tail = template.other.before.split("{role}")
        self.waiting = re.compile("|".join(map(re.escape, [*self.opening, self.head])))
        self.longest = max(map(len, [*self.opening, self.head]))
        self.rest, self.masked = "", []  # what is not read yet, and the stretches of it that count for the loss
        self.state, self.role, self.before, self.searched = "between", "", "", 0
        self.n_turns, self.loss_chars, self.chars, self.in_order = 0, 0, 0, True
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, loss: bool) -> None:
        if loss and piece:
            self.masked.append((len(self.rest), len(self.rest) + len(piece)))
        self.rest += piece
        self.chars += len(piece)
        at = 0
        while (next_at := self._step(at)) is not None:
            at, self.searched = next_at, next_at
        self.rest = self.rest[at:]
        self.masked = [(max(a - at, 0), b - at) for a, b in self.masked if b > at]
        self.searched -= at

    def _step(self, at: int) -> int | None:
        """Where the reading goes on after the next mark, or None if it is not there yet."""
        if self.state == "between":
            mark = self.waiting.match(self.rest, at)
            if mark is None:
                if len(self.rest) - at >= self.longest:
                    raise ValueError(f"no turn begins with {self.rest[at : at + self.longest]!r}")
                return None
            known = self.opening.get(mark[0])
            self.state, self.role = ("role", "") if known is None else ("text", known)
            return mark.end()
        end = self.tail if self.state == "role" else self.template.marks(self.role).after
        found = self.rest.find(end, max(at, self.searched))
        if found < 0:
            self.searched = max(at, len(self.rest) - len(end) + 1)
            return None
        if self.state == "role":
            self.state, self.role = "text", self.template.unescaped(self.rest[at:found])
        else:
            self._turn(at, found)
            self.state = "between"
        return found + len(end)

    def _turn(self, a: int, b: int) -> None:
        plain = self.template.unescaped(self.rest[a:b])
        self.n_turns += 1
        self.turns.update(f"{self.role}\n{plain}\n".encode("utf-8", "surrogatepass"))
        self.in_order &= self.role in self.template.turns.get(self.before, ())
        self.before = self.role
        learned = "".join(self.rest[max(a, x) : min(b, y)] for x, y in self.masked if x < b and y > a)
        if learned:
            learned = self.template.unescaped(learned)
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))

    def close(self) -> tuple:
        if self.state != "between" or self.rest:
            raise ValueError("a conversation ends inside a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.in_order


def read_chats(segments: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """What formatted segments hold, one row a conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, in_order.

    Turns, roles and their order are found by the marks alone. The loss digest
    takes what lies under the ``loss`` flags inside the texts.
    """

    def run(batches):
        conversation, reader = None, None
        for batch in batches:
            done = []
            for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv != conversation:
                    if reader is not None:
                        done.append((conversation, *reader.close()))
                    conversation, reader = conv, _Reader(template)
                reader.feed(text, loss)
            yield batch_of(done)
        if reader is not None:
            yield batch_of([(conversation, *reader.close())])

    def batch_of(rows):
        columns = list(zip(*rows)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]
    source = _in_order(segments.select("conv_id", "position", "text", "loss"), "conv_id", "position").select("conv_id", "text", "loss")
    return source.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean")
