"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

``format_chat`` sorts the turns of each conversation, checks their order
with a state machine and writes segments: text with a flag that says whether
it counts for the loss. The template is a table of parts; control strings
inside texts are escaped with backslashes, so that ``parse`` gets roles and
texts back from the formatted text alone.

Conversations are dealt by id and sorted in their partitions; a task streams
over its turns and holds one turn at a time, however long a conversation is.

Defined cases: turns are ordered by (turn, role, text), nulls first; null
roles and texts are empty; repeated rows are turns each; rows with a null
conversation id form one conversation. An order that the machine forbids
doesn't drop anything: the conversation is formatted and marked not valid.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import nullable, whole


@dataclass(frozen=True)
class Template:
    """Parts of a turn in order: (text, loss). ``{role}`` and ``{text}`` are filled in, escaped."""

    parts: tuple[tuple[str, bool], ...] = (("### ", False), ("{role}", False), (": ", False),
                                           ("{text}", True), (" </turn>\n", False))
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    control: tuple[str, ...] = ("###", "</turn>")
    learn_from: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()

#: state -> role -> next state. ``None`` is the state after a turn that has no arrow.
MACHINE = {"start": {"system": "system", "user": "user"}, "system": {"user": "user"},
           "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
FINAL = ("assistant",)


def escape(text: str, control: Iterable[str] = TEMPLATE.control) -> str:
    """A backslash before every backslash and every control string."""
    return re.sub("|".join(map(re.escape, ("\\", *control))), lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def role_name(role: str, template: Template = TEMPLATE) -> str:
    """Name of a role in the text; roles the template doesn't know are quoted, so names never clash."""
    return template.names.get(role) or '"' + escape(role, (*template.control, '"')) + '"'


def segments(role: str, text: str, template: Template = TEMPLATE) -> list[tuple[str, bool]]:
    """Segments of one turn with their loss flags."""
    out = []
    for part, loss in template.parts:
        filled = {"{role}": role_name(role, template), "{text}": escape(text, template.control)}.get(part, part)
        out.append((filled, loss and role in template.learn_from))
    return out


def advance(state: str | None, role: str) -> str | None:
    return MACHINE.get(state, {}).get(role)


def format_chat(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``(conv_id, turn_no, segment, text, loss, state, last)`` in order inside partitions.

    ``state`` is the machine's state after the turn (null: order broken);
    ``last`` marks the last segment of a conversation.
    """
    t = turns.select(whole("conv_id"), "turn", "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    dealt = t.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    schema = "conv_id long, turn_no long, segment int, text string, loss boolean, state string, last boolean"

    def run(frames: Iterator[pd.DataFrame]):
        conv, state, no, held = None, "start", -1, None

        def rows_of(h, last):
            c, n, role, text, st = h
            parts = segments(role, text, template)
            return [(c, n, k, x, f, st, last and k == len(parts) - 1) for k, (x, f) in enumerate(parts)]

        for pdf in frames:
            out, size = [], 0
            for c, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                fresh = no < 0 or c != conv
                if held is not None:
                    out += rows_of(held, fresh)
                if fresh:
                    conv, state, no = c, "start", -1
                role, text, no = role or "", text or "", no + 1
                state = advance(state, role)
                held = (c, no, role, text, state)
                size += len(text)
                if size > 1 << 22:
                    yield _frame(out)
                    out, size = [], 0
            if out:
                yield _frame(out)
        if held is not None:
            yield _frame(rows_of(held, True))

    return dealt.mapInPandas(run, schema).withColumn("conv_id", nullable("conv_id"))


def _frame(rows: list) -> pd.DataFrame:
    cols = ["conv_id", "turn_no", "segment", "text", "loss", "state", "last"]
    return pd.DataFrame(rows, columns=cols)


class Reader:
    """Reads the formatted text of one conversation, fed in pieces, without help from the segments' borders."""

    def __init__(self, template: Template = TEMPLATE):
        lit = [re.escape(p) for p, _ in template.parts if p not in ("{role}", "{text}")]
        name = "|".join([*map(re.escape, template.names.values()), r'"(?:[^"\\]|\\.)*"'])
        self.turn = re.compile(rf"{lit[0]}({name}){lit[1]}((?:[^\\]|\\.)*?){lit[2]}", re.S)
        self.end = template.parts[-1][0]
        self.roles = {v: k for k, v in template.names.items()}
        self.rest = ""

    def feed(self, text: str) -> list[tuple[str, str]]:
        """Turns ``(role, text)`` that are complete by now."""
        self.rest += text
        if not text.endswith(self.end):
            return []
        out, at = [], 0
        while m := self.turn.match(self.rest, at):
            name = m[1]
            out.append((self.roles.get(name) if name in self.roles else unescape(name[1:-1]), unescape(m[2])))
            at = m.end()
        self.rest = self.rest[at:]
        return out


def parse(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of each conversation, read back from the segments' text and loss flags.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid)``. Needs the order that ``format_chat`` leaves.
    """
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, valid boolean")

    def run(frames: Iterator[pd.DataFrame]):
        def start():
            return {"reader": Reader(template), "turns": hashlib.sha256(), "loss": hashlib.sha256(),
                    "n": 0, "loss_chars": 0, "chars": 0, "valid": True, "state": None}

        st = start()
        for pdf in frames:
            out = []
            for c, text, loss, state, last in zip(pdf["conv_id"], pdf["text"], pdf["loss"],
                                                  pdf["state"], pdf["last"]):
                st["chars"] += len(text)
                if loss:
                    plain = unescape(text)
                    st["loss_chars"] += len(plain)
                    st["loss"].update(plain.encode("utf-8", "surrogatepass"))
                for role, said in st["reader"].feed(text):
                    st["n"] += 1
                    st["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                st["valid"] &= state is not None
                if last:
                    if st["reader"].rest:
                        raise ValueError(f"conversation {c}: formatted text can't be read back")
                    out.append((c, st["n"], st["turns"].hexdigest(), st["loss_chars"], st["loss"].hexdigest(),
                                st["chars"], bool(st["valid"] and state in FINAL)))
                    st = start()
            if out:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return (formatted.withColumn("conv_id", whole("conv_id")).mapInPandas(run, schema)
            .withColumn("conv_id", nullable("conv_id")))
