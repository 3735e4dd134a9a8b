"""Chat formatting by a finite-state machine over roles and a declarative template.

A ``Template`` lists the marker of every role, the marker after a turn, what surrounds a
conversation, which roles' texts carry loss, and the turn order as a table of (state, role) ->
state.  A conversation's turns are run through that machine: a role without an entry is a
violation, after which the machine goes on in the state of that name (or at the start); a
conversation is valid if nothing was violated and it ends in an accepting state.  Invalid ones
are formatted too, and marked.

Each turn becomes one output row with its segments (text, loss) in order: markers never
carry loss, a text does if its role's does.  A conversation is the concatenation of its rows, so none, however long, has to
be one value.  Control strings inside texts get an escape character after their first
character, and escape characters are doubled, so no marker can be read inside a text and the
text comes back exactly.  ``Template.parse`` reads a row's turn back.

Rows are range-partitioned by conversation and turn and written once.  A machine's step is
a map from states to states, and a run of turns is the composition of their maps, so each
partition reports one map (for the conversation it may have begun in the middle of) and its
last conversation; the states in which partitions begin follow from these few rows, one a partition.
A conversation that holds a third of all rows is thus spread over many tasks.

Defined cases: a null text is an empty one, a null role an empty role; a role that the template
doesn't know is written out behind a marker of its own; null turns come first, and rows with
equal turns are ordered by role, then text, repeated rows counting each; all rows with a null conv_id are one conversation; an empty
table gives an empty result; only conv_id, turn, role and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize

ESCAPE = "\\"
ROWS_A_TASK = 20_000  # turns of a partition, about


@dataclass(frozen=True)
class Template:
    """How conversations are written; see ``CHAT`` for one."""
    start: str
    stop: str
    markers: dict  # role -> marker before a turn's text
    other: str  # marker before the name of any other role
    named: str  # marker between such a name and the text
    close: str  # marker after a turn's text
    loss: frozenset  # roles whose texts carry loss
    order: dict  # state -> {role: next state}; the first state is where a conversation begins
    accepting: frozenset  # states in which a conversation may end
    reserved: tuple = ()  # further control strings that texts must not hold
    controls: tuple = field(init=False)

    def __post_init__(self):
        used = [self.start, self.stop, *self.markers.values(), self.other, self.named, self.close]
        if len(set(self.markers.values()) | {self.other}) <= len(self.markers) or not all(len(c) > 1 for c in [*used, *self.reserved]):
            raise ValueError("markers of roles must differ and have two characters at least")
        controls = tuple(sorted({*used, *self.reserved}))
        firsts = {c[0] for c in controls}
        # so no control string can begin in a marker or text and end in the next
        if any(firsts & set(c[1:]) or ESCAPE in c for c in controls):
            raise ValueError("a control string's first character must not occur inside any, nor the escape character")
        if any(b.startswith(a) for a, b in zip(controls, controls[1:])):
            raise ValueError("no control string may begin with another")
        object.__setattr__(self, "controls", controls)

    def states(self) -> list[str]:
        return list(self.order)

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The state after a turn of ``role``, and whether the turn was in order."""
        after = self.order[state].get(role)
        if after is not None:
            return after, True
        return (role if role in self.order else next(iter(self.order))), False

    def escape(self, text: str) -> str:
        return _controls_in(self).sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str, first: bool, last: bool) -> list[tuple[str, bool]]:
        """A turn's segments with their loss flags; ``first`` and ``last``: of its conversation."""
        marker = self.markers.get(role)
        head = marker if marker is not None else self.other + self.escape(role) + self.named
        return [((self.start if first else "") + head, False), (self.escape(text), role in self.loss),
                (self.close + (self.stop if last else ""), False)]

    def parse(self, formatted: str) -> tuple[str, str]:
        """(role, text) of one formatted turn; an error if it isn't one."""
        parts = re.split(_controls_in(self, group=True), formatted)
        if parts[0] == "" and parts[1:2] == [self.start]:
            parts = parts[2:]
        if parts[-1] == "" and parts[-2:-1] == [self.stop]:
            parts = parts[:-2]
        roles = {m: r for r, m in self.markers.items()}
        if len(parts) == 5 and parts[0] == parts[4] == "" and parts[1] in roles and parts[3] == self.close:
            return roles[parts[1]], self.unescape(parts[2])
        if len(parts) == 7 and parts[0] == parts[6] == "" and parts[1::2] == [self.other, self.named, self.close]:
            return self.unescape(parts[2]), self.unescape(parts[4])
        raise ValueError(f"not a formatted turn: {formatted[:80]!r}")


def _controls_in(template: Template, group: bool = False):
    pattern = "|".join(map(re.escape, template.controls))
    return re.compile(f"({pattern})" if group else pattern)


# Markers, and strings of common chat formats that are kept out of texts.
CHAT = Template(
    start="<s>", stop="</s>",
    markers={"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"},
    other="<|role|>", named="<|text|>", close="<|end|>", loss=frozenset({"assistant"}),
    order={"start": {"system": "system", "user": "user"}, "system": {"user": "user"},
           "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    accepting=frozenset({"assistant"}),
    reserved=("[INST]", "[/INST]", "<|endoftext|>"),
)

_OUT = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("state", pa.string()), ("in_order", pa.bool_()),
                  ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))])
_OUT_DDL = "conv_id bigint, place bigint, turn bigint, state string, in_order boolean, segments array<struct<text string, loss boolean>>"
_RUN = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("map", pa.list_(pa.string())), ("state", pa.string())])
_RUN_DDL = "part int, first bigint, last bigint, map array<string>, state string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _run_maps(template: Template):
    """Per partition: its first and last conversation, the map of states over the first one's turns,
    and the state that the last one ends in (null if it is the first)."""
    states = template.states()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}  # a task may have several partitions
        for part, conv, role in _rows(batches):
            here = found.setdefault(part, {"part": part, "first": conv, "last": conv, "map": list(states), "state": None})
            if conv != here["last"]:
                here["last"], here["state"] = conv, states[0]
            if here["state"] is None:
                here["map"] = [template.step(s, role)[0] for s in here["map"]]
            else:
                here["state"] = template.step(here["state"], role)[0]
        yield pa.RecordBatch.from_pylist(list(found.values()), schema=_RUN)

    return run


def begin_states(template: Template, parts: list[dict]) -> dict:
    """For each partition: the conversation open at its start as (id,), or (); its state; the next partition's first, likewise."""
    states, out, open_conv, state = template.states(), {}, (), states_first(template)
    parts = sorted(parts, key=lambda p: p["part"])
    for p, after in zip(parts, [*((q["first"],) for q in parts[1:]), ()]):
        out[p["part"]] = (open_conv, state, after)
        if p["state"] is None:  # all of it is one conversation
            began = state if open_conv == (p["first"],) else states[0]
            state = p["map"][states.index(began)]
        else:
            state = p["state"]
        open_conv = (p["last"],)
    return out


def states_first(template: Template) -> str:
    """The state in which a conversation begins."""
    return next(iter(template.order))


def _writer(template: Template, begins: dict):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, held = [], 0, None
        open_part, open_conv, state = None, (), None

        def finish(after: tuple) -> None:
            """The held turn, once it is known which conversation comes ``after`` it."""
            nonlocal size
            conv, role, text, first, row = held
            segments = template.segments(role, text, first, last=after != (conv,))
            size += len(text)
            out.append(row | {"segments": [{"text": t, "loss": loss} for t, loss in segments]})

        for part, place, conv, turn, role, text in _rows(batches):
            if held is not None:
                finish((conv,) if part == open_part else begins[open_part][2])
            if part != open_part:
                open_part = part
                open_conv, state, _ = begins[part]
            first = open_conv != (conv,)
            state, good = template.step(states_first(template) if first else state, role)
            open_conv = (conv,)
            held = conv, role, text, first, {"conv_id": conv, "place": place, "turn": turn, "state": state, "in_order": good}
            if len(out) >= 1000 or size > 1 << 24:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                out, size = [], 0
        if held is not None:
            finish(begins[open_part][2])
        yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return write


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row a turn: conv_id, place (rows in order), turn, state after it, in_order, segments (text, loss).

    ``turns``: conv_id, turn, role, text.
    """
    spark = turns.sparkSession
    wanted = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                          F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-wanted.count() // ROWS_A_TASK))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]  # the hash spares comparing long texts
    # a place's high bits are its partition; two reads of the shuffle itself might range rows differently
    ranged = materialize(wanted.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "text")
                               .withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "chat_turns")
    by_part = ranged.repartition(tasks, "part").sortWithinPartitions("place")
    runs = by_part.select("part", "conv_id", "role").mapInArrow(_run_maps(template), _RUN_DDL).collect()  # a row a partition
    begins = begin_states(template, [r.asDict() for r in runs])
    return by_part.select("part", "place", "conv_id", "turn", "role", "text").mapInArrow(_writer(template, begins), _OUT_DDL)


def conversation_checks(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, n_turns, violations, valid) of formatted conversations: partial sums, whatever their length."""
    last = F.max_by("state", "place")
    return (formatted.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(~F.col("in_order")).alias("violations"), last.alias("_end"))
                     .withColumn("valid", (F.col("violations") == 0) & F.col("_end").isin(*template.accepting)).drop("_end"))


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_DIGESTS_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def conversation_digests(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation, parsed back from its formatted rows: conv_id, n_turns, digests and lengths.

    Digests need a conversation's bytes in order; they are fed turn by turn, so a task holds one batch.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, state = [], (), None

        def done():
            n, turns, chars, loss, total = state
            out.append({"conv_id": conv[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                        "loss_sha256": loss.hexdigest(), "formatted_chars": total})

        for batch in batches:
            for here, segments in zip(batch.column("conv_id").to_pylist(), batch.column("segments").to_pylist()):
                if conv != (here,):
                    if conv:
                        done()
                    conv, state = (here,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                written = "".join(s["text"] for s in segments)
                role, text = template.parse(written)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                under_loss = template.unescape("".join(s["text"] for s in segments if s["loss"]))
                state[2] += len(under_loss)
                state[3].update(under_loss.encode())
                state[4] += len(written)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_DIGESTS)
                out = []
        if conv:
            done()
        yield pa.RecordBatch.from_pylist(out, schema=_DIGESTS)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "segments")
    return ordered.mapInArrow(digest, _DIGESTS_DDL)
