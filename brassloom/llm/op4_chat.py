r"""Chat formatting: a state machine over roles and a declarative template.

A template says for each role what stands before and after a turn's text and
whether that text is under the loss mask. ``segments`` emits each turn as three
text segments with their loss flags; joined in order they are the formatted
conversation. The state machine's state is the role of the turn before: a turn
that may not follow it is marked as invalid, with the rest formatted as usual.

Inside texts, a backslash, ``<`` and ``[`` get a backslash before them, so no text can
hold one of the template's marks, all of which begin with ``<`` or ``[``.
``read_back`` needs the segments' texts and flags only: it finds the marks, undoes
the escapes and gives each conversation's turns and loss text as digests.

Turns are numbered and linked by windows per conversation; a conversation is read
back as a stream, whose memory doesn't grow with the number of its turns.

Edge cases: null text and null role are empty texts. Roles that the template
doesn't know get a mark with their name and no loss; they may follow any turn.
Turns are ordered by turn (null first), then role and text, so repeated rows stay
side by side and count each. Rows with null conv_id form one conversation. Extra
columns are ignored, whatever their names. The query's own conversation -7 joins a
given one of that number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brassloom.llm.common import ship, small_batches, table


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool
    #: Roles after which this one may stand; "" is the start.
    follows: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    roles: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>", False, ("",)),
            "user": Turn("[INST]", "[/INST]", False, ("", "system", "assistant")),
            "assistant": Turn("<s>", "</s>", True, ("user",)),
        }
    )
    other: Turn = Turn("[ROLE]", "[/ROLE]", False, ())
    #: Between the name and the text of a role that isn't known.
    named: str = "[:]"


SPECIAL = r"([\\<\[])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, r"\\$1")


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, no (order of the segment), text, loss and valid (whether the turn may stand where it does)."""
    role = F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("no", F.row_number().over(by)).withColumn("last", F.coalesce(F.lag("role").over(by), F.lit("")))
    o = template.other
    before, after = F.concat(F.lit(o.before), escape(F.col("role")), F.lit(template.named)), F.lit(o.after)
    loss, valid = F.lit(o.loss), F.lit(True)
    for name, t in template.roles.items():
        here = F.col("role") == name
        before, after = F.when(here, F.lit(t.before)).otherwise(before), F.when(here, F.lit(t.after)).otherwise(after)
        loss, valid = F.when(here, F.lit(t.loss)).otherwise(loss), F.when(here, F.col("last").isin(*t.follows)).otherwise(valid)
    three = F.array(F.struct(before.alias("text"), F.lit(False).alias("loss")), F.struct(escape(F.col("text")).alias("text"), loss.alias("loss")), F.struct(after.alias("text"), F.lit(False).alias("loss")))
    out = rows.select("conv_id", "no", valid.alias("valid"), F.posexplode(three).alias("part", "s"))
    return out.select("conv_id", (F.col("no").cast("long") * 3 + F.col("part")).alias("no"), "s.text", "s.loss", "valid")


class _Conversation:
    """What is read of one conversation so far."""

    def __init__(self, template: Template):
        self.open = {t.before: name for name, t in template.roles.items()} | {template.other.before: None}
        self.close = {t.after for t in template.roles.values()} | {template.other.after}
        marks = sorted([*self.open, *self.close, template.named], key=len, reverse=True)
        self.tokens = re.compile(r"\\(.)|(" + "|".join(map(re.escape, marks)) + r")|[^\\<\[]+|.", re.S)
        self.named = template.named
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid, self.role, self.parts = True, None, []

    def read(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid &= valid
        for m in self.tokens.finditer(text):
            mark = m[2]
            if mark is None:
                plain = m[1] if m[1] is not None else m[0]
                self.parts.append(plain)
                if loss:
                    self.loss_chars += len(plain)
                    self.loss.update(plain.encode("utf-8", "surrogatepass"))
            elif mark in self.open:
                self.role, self.parts = self.open[mark], []
            elif mark == self.named:
                self.role, self.parts = "".join(self.parts), []
            else:
                self.turns.update(f"{self.role}\n{''.join(self.parts)}\n".encode("utf-8", "surrogatepass"))
                self.n, self.parts = self.n + 1, []


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, from the segments' texts and loss flags."""
    ship(formatted.sparkSession)
    rows = formatted.select("conv_id", "no", "text", "loss", "valid").repartition("conv_id").sortWithinPartitions("conv_id", "no")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of = None, None
        for batch in small_batches(batches):
            done = []
            for conv, text, loss, valid in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if of is None or conv != at:
                    if of:
                        done.append((at, of))
                    at, of = conv, _Conversation(template)
                of.read(text, loss, valid)
            if done:
                yield out(done, batch.schema.field(0).type)
        if of:
            yield out([(at, of)], batch.schema.field(0).type)

    def out(done: list, id_type: pa.DataType) -> pa.RecordBatch:
        rows = [(k, c.n, c.turns.hexdigest(), c.loss_chars, c.loss.hexdigest(), c.chars, c.valid) for k, c in done]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t or id_type) for x, t in zip(zip(*rows), types)], names=names)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def formatted_text(parts: DataFrame) -> DataFrame:
    """conv_id and the whole formatted text, for conversations that fit into a row."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda s: s["text"]), "")
    return parts.groupBy("conv_id").agg(joined.alias("formatted"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(segments(given.unionByName(more)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last,
    length(regexp_replace(text, '([\\<\[])', '\\\1', 'g')) AS chars, length(regexp_replace(role, '([\\<\[])', '\\\1', 'g')) AS role_chars FROM c)
SELECT conv_id, COUNT(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
  COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY no) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  SUM(chars + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 16 + role_chars END)::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN last = '' WHEN 'user' THEN last IN ('', 'system', 'assistant') WHEN 'assistant' THEN last = 'user' ELSE TRUE END) AS valid
FROM e GROUP BY conv_id
"""
