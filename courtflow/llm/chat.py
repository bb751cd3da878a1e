"""Chat formatting: a finite-state machine over roles and a declarative template.

``Template`` names the marks around a turn, the roles whose texts are learned, and the machine:
for each state the roles that may follow and the state they lead to. ``format_chats`` folds the
machine over the turns of each conversation and emits its segments in order, each a piece of text
and a flag whether it counts in the loss; ``read_back`` parses the joined output again. Only
DataFrame functions are used.

Texts and roles keep their content: the escape character is doubled, and wherever a control string
begins an escape character is put after its first character, so that no control string is left.
Taking the character after each escape as it is gives the text back.

A conversation is one training example, so its turns come together in one row (Spark's own bound
of 2 GB a row is the bound of a conversation); the texts are shuffled once.

Edge cases: null roles and texts are empty; turns are ordered by number (null first), then role,
then text; repeated rows are turns of their own; rows without id form one conversation with a null
id; a turn out of order is formatted like any other, marked in ``in_order``, and the machine goes
on from the state its role leads to (a role it does not know leaves the state); other columns are
not read; an empty table gives no row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import query, table, text_of

#: Turns that the machine's fold marks in one string, so that marking costs no square of a conversation.
BLOCK = 256


@dataclass(frozen=True)
class Template:
    turn_start: str = "### "
    role_end: str = ": "
    turn_end: str = "</turn>"
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; the first state is where a conversation begins
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    #: states in which a conversation may end
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        for mark in (self.turn_start, self.role_end, self.turn_end):
            if len(mark) < 2 or self.escape in mark:
                raise ValueError(f"a mark has two characters at least and no escape: {mark!r}")
            if any(mark.startswith(mark[k:]) for k in range(1, len(mark))):
                raise ValueError(f"a mark must not end as it begins: {mark!r}")
        if len(self.escape) != 1:
            raise ValueError("the escape is one character")
        unknown = {s for to in self.machine.values() for s in to.values()} | set(self.final)
        if unknown - set(self.machine):
            raise ValueError(f"states without a line in the machine: {unknown - set(self.machine)}")


def _escaped(text: Column, template: Template, marks: tuple[str, ...]) -> Column:
    doubled = F.replace(text, F.lit(template.escape), F.lit(2 * template.escape))
    begins = "|".join(f"{re.escape(m[0])}(?={_quoted(m[1:])})" for m in marks)
    return F.regexp_replace(doubled, begins, "$0" + ("\\\\" if template.escape == "\\" else re.escape(template.escape)))


def _unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, re.escape(template.escape) + r"([\s\S])", "$1")


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _marks(roles: Column, template: Template) -> Column:
    """For an array of roles: the state at the end, and per block a string of 1 (in order) and 0."""
    states = list(template.machine)
    known = sorted({r for to in template.machine.values() for r in to})
    wide = len(known) + 1
    steps = [-1] * (len(states) * wide)
    resume = [-1] * wide
    for state, to in template.machine.items():
        for role, after in to.items():
            code = known.index(role) + 1
            steps[states.index(state) * wide + code] = states.index(after)
            resume[code] = states.index(after)
    step_of, resume_of = (F.array(*map(F.lit, x)) for x in (steps, resume))

    def step(acc: Column, role: Column) -> Column:
        code = F.array_position(F.array(*map(F.lit, known)), role).cast("int")
        to = F.get(step_of, acc["state"] * wide + code)
        other = F.get(resume_of, code)
        after = F.when(to >= 0, to).when(other >= 0, other).otherwise(acc["state"])
        return F.struct(after.alias("state"), F.concat(acc["marks"], F.when(to >= 0, F.lit("1")).otherwise(F.lit("0"))).alias("marks"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), F.lit("").alias("marks")), step)
        return F.aggregate(F.array(inner), acc, lambda a, x: F.struct(x["state"].alias("state"), F.array_append(a["marks"], x["marks"]).alias("marks")))

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(roles) - 1) / BLOCK).cast("int"))), lambda b: F.slice(roles, b * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("marks"))
    return F.aggregate(parts, start, block)


def format_chats(turns: DataFrame, template: Template | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``key``; ``segments``, an array of (text, loss); ``in_order``, a
    boolean per turn; ``valid``, whether all turns are in order and the last one may be the last."""
    template = template or Template()
    row = F.struct(turns[turn].alias("turn"), text_of(turns, role).alias("role"), text_of(turns, text).alias("text"))
    chats = turns.select(turns[key].alias("key"), row.alias("row")).groupBy("key").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    chats = chats.withColumn("walk", _marks(F.transform("turns", lambda t: t["role"]), template))
    learned = F.array(*map(F.lit, template.learned)) if template.learned else F.array().cast("array<string>")
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def segments(t: Column) -> Column:
        name = _escaped(t["role"], template, (template.turn_start, template.turn_end, template.role_end))
        return F.array(
            segment(F.concat(F.lit(template.turn_start), name, F.lit(template.role_end)), F.lit(False)),
            segment(_escaped(t["text"], template, (template.turn_start, template.turn_end)), F.array_contains(learned, t["role"])),
            segment(F.lit(template.turn_end), F.lit(False)),
        )

    in_order = F.transform("turns", lambda t, i: F.substring(F.get(F.col("walk")["marks"], F.floor(i / BLOCK).cast("int")), i % BLOCK + 1, F.lit(1)) == "1")
    final = [i for i, state in enumerate(template.machine) if state in template.final]
    valid = F.col("walk")["state"].isin(final) & ~F.exists(F.col("walk")["marks"], lambda m: F.contains(m, F.lit("0")))
    return chats.select(F.col("key").alias(key), F.flatten(F.transform("turns", segments)).alias("segments"), in_order.alias("in_order"), valid.alias("valid"))


def formatted(segments: Column) -> Column:
    """The text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: Template | None = None) -> Column:
    """The turns in a formatted text: an array of (role, text)."""
    template = template or Template()
    pieces = F.split(text, _quoted(template.turn_end), -1)

    def turn(piece: Column) -> Column:
        at = F.locate(template.role_end, piece)
        head, start = len(template.turn_start), len(template.role_end)
        role = F.substring(piece, F.lit(head + 1), at - head - 1)
        return F.struct(_unescaped(role, template).alias("role"), _unescaped(F.substring(piece, at + start, F.length(piece)), template).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def learned_text(segments: Column, template: Template | None = None) -> Column:
    """What the loss mask covers, as it was written."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: _unescaped(s["text"], template)), "")


_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) AS v(conv_id, turn, role, text)
), safe AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS safe_text,
        replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ': ', ':\ ') AS safe_role
    FROM turns
), learned AS (
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss_text,
        sum(13 + length(safe_role) + length(safe_text)) AS formatted_chars
    FROM safe GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss_text) AS loss_chars, sha256(loss_text) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM learned
"""


@query("op11_chat_format", _SQL)
def op11(spark, sf_dir):
    text = r"\### Assistant: </turn> ok"
    probe = spark.sql("SELECT -7L conv_id, 0L turn, 'user' role, :text text UNION ALL SELECT -7L, 1L, 'assistant', :text", args={"text": text})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    chats = format_chats(turns).select("conv_id", "valid", formatted(F.col("segments")).alias("formatted"), learned_text(F.col("segments")).alias("learned"))
    back = chats.withColumn("turns", read_back(F.col("formatted")))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
