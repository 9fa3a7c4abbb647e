"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbours of the
same role share one block (their texts stay apart by a part mark), and the
pieces are concatenated. Control strings inside texts get a backslash after
their first character, and ones that already carry backslashes get one more,
so nothing in a text can be read as a mark and unescaping restores every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    part: str = "<|im_part|>"
    end: str = "<|im_end|>"
    #: Control strings of other common templates, escaped as well.
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return (self.start, self.part, self.end, *self.reserved)

    def sites(self, before: str) -> str:
        """A regular expression of first characters that ``before`` and a control string's rest follow."""
        rests: dict[str, list[str]] = {}
        for c in self.controls():
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(f"({re.escape(c)}){before}(?=\\\\*(?:{'|'.join(r)}))" for c, r in sorted(rests.items()))

    def escape(self, text: Column) -> Column:
        groups = len({c[0] for c in self.controls()})
        return F.regexp_replace(text, self.sites(""), "".join(f"${i + 1}" for i in range(groups)) + "\\\\")

    def unescape(self, text: Column) -> Column:
        groups = len({c[0] for c in self.controls()})
        return F.regexp_replace(text, self.sites("\\\\"), "".join(f"${i + 1}" for i in range(groups)))

    # A role stands on one line: its line feeds and percent signs are percent-encoded.
    def escape_role(self, role: Column) -> Column:
        return F.replace(F.replace(self.escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


CHATML = Template()


def format_chats(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, formatted, loss_spans: [start, end) code points of the texts to be learned, in order.

    chats: conv_id, turn, role, text; other columns are ignored, whatever their
    names. Turns are in order of turn (nulls first), ties by role and text as
    they are, repeated rows stay. Null roles and texts are empty, an empty text
    is an empty turn. Null ids form one conversation. No rows, no result. A
    conversation is one output string, so its rows meet in one task, however
    long its texts; that is the operator's result and not a group that could be
    split.
    """
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))

    def piece(t: Column, j: Column) -> Column:
        """What stands before the text of turn j, the text, and what stands after it."""
        opens = F.coalesce(F.get("_turns", j - 1)["role"] != t["role"], F.lit(True))
        closes = F.coalesce(F.get("_turns", j + 1)["role"] != t["role"], F.lit(True))
        return F.struct(
            F.when(opens, F.concat(F.lit(template.start), template.escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(template.part)).alias("before"),
            template.escape(t["text"]).alias("text"),
            F.when(closes, F.lit(template.end + "\n")).otherwise(F.lit("")).alias("after"),
            t["role"].isin(*template.loss_roles).alias("loss"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("_turns", piece).alias("_pieces"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def advance(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["before"])
        end = start + F.length(p["text"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + F.length(p["after"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.aggregate("_pieces", zero, advance, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def parsed_turns(template: Template = CHATML) -> Column:
    """Array of (role, text), read back from the column ``formatted`` alone."""
    blocks = F.filter(F.split("formatted", re.escape(template.end + "\n")), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = template.unescape_role(head.substr(F.lit(len(template.start) + 1), F.length(head)))
        body = b.substr(F.length(head) + 2, F.length(b))
        return F.transform(F.split(body, re.escape(template.part)), lambda p: F.struct(role.alias("role"), template.unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def parse_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, turns: array of (role, text)."""
    return formatted.select("conv_id", parsed_turns(template).alias("turns"))


def masked_text(formatted: DataFrame, template: Template = CHATML) -> Column:
    """All text under the loss mask, cut out of the formatted string and unescaped span by span."""
    text = formatted["formatted"]
    return F.array_join(F.transform(formatted["loss_spans"], lambda s: template.unescape(text.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id and what the formatted string and its loss mask hold, as counts and SHA-256 sums."""
    masked = formatted.select("conv_id", "formatted", masked_text(formatted, template).alias("_loss"))
    # Exploded as one element, so that the turns are parsed once.
    told = masked.select("conv_id", "formatted", "_loss", F.explode(F.array(parsed_turns(template))).alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("_all"),
        "_loss",
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return told.select("conv_id", "n_turns", F.sha2("_all", 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")


def with_probe(spark: SparkSession, chats: DataFrame) -> DataFrame:
    """chats plus conversation -1, whose texts are control strings."""
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chats.select("conv_id", "turn", "role", "text").unionByName(probe)


def op3(spark: SparkSession, chats: DataFrame) -> DataFrame:
    return digest(format_chats(with_probe(spark, chats)))


#: Each control string costs one character more, each block its marks, each merged turn a part mark.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), t AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens,
    len(regexp_extract_all(text, '<\\*(\|(im_start|im_part|im_end|endoftext|system|user|assistant)\|>|/?s>|<SYS>>|</SYS>>)|\[\\*/?INST\]')) AS n_controls
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + n_controls + CASE WHEN opens THEN 12 + length(role) + 1 + 10 + 1 ELSE 11 END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
