"""Chat formatting: a finite-state machine over roles and a declarative template.

A template gives each role a prefix, a suffix and a loss flag. The machine's states are the role last
seen; a conversation is valid if every step has a transition. Texts are escaped so that no control string of
the template occurs in them; the escape is reversible. A conversation becomes one string, the list of its
segments as (text, loss) and the spans of the string under the loss mask. DataFrame functions only.

Defined results: null text is empty; roles outside the template, null among them, are marked with their
name in a generic turn and make the conversation invalid; turns order by number (null first), then role, then
text, and repeated rows are all formatted; null conversation ids form one conversation; an empty table
gives an empty result. A conversation is one output string, so its turns meet in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks in a template: what is in angle or square brackets, opened brackets, and else what has no white space.
_MARK = re.compile(r"<[^<>\s]*>|\[[^\[\]\s]*\]|\[[^\[\]\s]*|[^\s<\[]+|\S")


@dataclass(frozen=True)
class Template:
    """roles: prefix, suffix and loss flag of each role; other: prefix, end of the name and suffix of unknown roles; end: the end of each turn."""

    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("<s>[SYS] ", " [/SYS]", False), "user": ("<s>[INST] ", " [/INST]", False), "assistant": ("<s>[OUT] ", " [/OUT]", True)})
    other: tuple[str, str, str] = ("<s>[TURN ", "] ", " [/TURN]")
    #: state: role: next state. The machine starts in ``start``.
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    end: str = "</s>"
    #: What must not occur in a text; by default all marks of the template, longer ones first. Each becomes ``~`` and a letter; ``~`` itself becomes ``~a``.
    controls: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.controls:
            text = [x for prefix, suffix, _ in self.roles.values() for x in (prefix, suffix)] + [self.end, *self.other]
            found = dict.fromkeys(m for x in text for m in _MARK.findall(x) if not m.isalnum())
            object.__setattr__(self, "controls", tuple(sorted(found, key=lambda m: -len(m))))
        if "~" in "".join(self.controls) or len(self.controls) > LETTERS:
            raise ValueError(f"marks are free of ~ and {LETTERS} at most")
        if self.other[1].rstrip() not in self.controls:
            raise ValueError("a mark has to end the names of unknown roles")


#: Letters that stand for controls.
LETTERS = 0x7E - ord("b")


def _letter(k: int) -> str:
    return "~" + chr(ord("b") + k)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~a"))
    for k, control in enumerate(template.controls):
        out = F.replace(out, F.lit(control), F.lit(_letter(k)))
    return out


def unescape(text: Column, template: Template) -> Column:
    out = text
    for k, control in reversed(list(enumerate(template.controls))):
        out = F.replace(out, F.lit(_letter(k)), F.lit(control))
    return F.replace(out, F.lit("~a"), F.lit("~"))


def format_chat(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, valid, formatted, segments (text, loss) and loss_spans (start, chars), starts from 1 and all in code points."""
    t = template or Template()
    role, text = F.col("role"), escape(F.col("text"), t)
    named = F.concat(F.lit(t.other[0]), F.when(role.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), escape(role, t))), F.lit(t.other[1]))

    def of(part: int, otherwise: Column) -> Column:
        out = otherwise
        for name, marks in t.roles.items():
            out = F.when(role == name, F.lit(marks[part])).otherwise(out)
        return out

    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("conv", "turn", "role", "text", of(0, named).alias("prefix"), text.alias("escaped"), F.concat(of(1, F.lit(t.other[2])), F.lit(t.end)).alias("suffix"), of(2, F.lit(False)).alias("loss"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumns({"ord": F.row_number().over(order), "chars": F.char_length("prefix") + F.char_length("escaped") + F.char_length("suffix")})
    rows = rows.withColumn("end", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    packed = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("ord", "role", "prefix", "escaped", "suffix", "loss", "end"))).alias("turns"))
    steps = F.create_map(*[F.lit(x) for state, to in t.machine.items() for name, into in to.items() for x in (f"{state}>{name}", into)])
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit(">"), F.coalesce(x["role"], F.lit("")))), F.lit("stuck")))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(x["prefix"].alias("text"), F.lit(False).alias("loss")), F.struct(x["escaped"].alias("text"), x["loss"].alias("loss")), F.struct(x["suffix"].alias("text"), F.lit(False).alias("loss")))))
    spans = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: F.struct(
        (x["end"] - F.char_length(x["suffix"]) - F.char_length(x["escaped"]) + 1).cast("int").alias("start"), F.char_length(x["escaped"]).alias("chars")))
    return packed.select(
        F.col("conv").alias(conv_col), (state != "stuck").alias("valid"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["prefix"], x["escaped"], x["suffix"])), "").alias("formatted"), segments.alias("segments"), spans.alias("loss_spans"),
    )


def read_chat(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds turns (role, text) parsed from ``formatted``, and loss_texts cut out of it by ``loss_spans``, both unescaped."""
    t = template or Template()

    def parse(turn: Column) -> Column:
        rest = F.substring(turn, F.lit(len(t.other[0]) + 1), F.char_length(turn))
        at = F.instr(rest, t.other[1].rstrip())
        role = F.when(at > 1, unescape(F.substring(rest, F.lit(2), at - 2), t))
        body = F.substring(rest, at + len(t.other[1]), F.char_length(rest))
        out = F.struct(role.alias("role"), unescape(F.substring(body, F.lit(1), F.char_length(body) - len(t.other[2])), t).alias("text"))
        for name, (prefix, suffix, _) in t.roles.items():
            inner = F.substring(turn, F.lit(len(prefix) + 1), F.char_length(turn) - len(prefix) - len(suffix))
            out = F.when(turn.startswith(prefix), F.struct(F.lit(name).alias("role"), unescape(inner, t).alias("text"))).otherwise(out)
        return out

    turns = F.filter(F.split("formatted", re.escape(t.end)), lambda x: x != "")
    loss = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"], x["chars"]), t))
    return formatted.withColumns({"turns": F.transform(turns, parse), "loss_texts": loss})


SQL = r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
  select *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
    '~', '~a'), '<s>', '~b'), '</s>', '~c'), '[INST]', '~d'), '[/INST]', '~e'), '[SYS]', '~f'), '[/SYS]', '~g'), '[OUT]', '~h'), '[/OUT]', '~i'), '[TURN', '~j'), '[/TURN]', '~k'), ']', '~l') as e
  from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum(length(e) + case role when 'system' then length('<s>[SYS]  [/SYS]</s>') when 'user' then length('<s>[INST]  [/INST]</s>') when 'assistant' then length('<s>[OUT]  [/OUT]</s>') end)::bigint as formatted_chars
from escaped group by conv_id
"""
