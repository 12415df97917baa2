"""Chat formatting by perspective rotation, DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that
speaker as ``assistant``, every other speaker as a named ``user``, system turns
as ``system``, and a mask of the code-point spans to train on: the speaker's own
turns with their end marks.

A conversation may be very long, so it is rendered in blocks of ``BLOCK`` turn
numbers, and a block of more than ``MOST_TURNS`` turns in parts: a row per
conversation, perspective, block and part, the dialogue being the rows' texts in
that order. Mask offsets count from the dialogue's beginning, and ``offset`` is
where a row's text begins, so blocks don't change what is trained on. A
conversation that fits one block is one row.

Control strings inside a text (``<|``, also with backslashes between) get one
more backslash, so that a turn cannot forge a header and the text can be had
back exactly; ``unescape`` undoes it. Speakers are told apart by their roles as
they are; in a name, white space and ``<|>~`` are written as ``~`` and two
hexadecimal digits, so that different roles have different names.

Defined cases: a null text is an empty turn; a null role is a participant named
``unknown``, the same as one of that name; null turns come first, in a block
numbered -1; a null conversation id is one conversation; repeated rows are repeated
turns, ordered by turn, name, text; conversations of system turns only have no
participant and no row; very long texts are turns like others; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, running_sums, table

BLOCK, MOST_TURNS = 128, 512
START, END = "<|im_start|>", "<|im_end|>"
CONTEXT_ROLES = ("system",)
#: Characters that don't stand in names; ~ first, since it begins what replaces the others.
CODED = "~ \t\n\x0b\f\r<|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def name_of(role: Column) -> Column:
    name = F.coalesce(role.cast("string"), F.lit("unknown"))
    for c in CODED:
        name = F.replace(name, F.lit(c), F.lit(f"~{ord(c):02X}"))
    return name


def rotate(turns: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", block: int = BLOCK, most: int = MOST_TURNS) -> DataFrame:
    """Rows (conv_id, perspective, block, part, n_turns, offset, rendered, mask)."""
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.coalesce(F.floor(F.col(f"`{turn}`") / block), F.lit(-1)).cast("long").alias("block"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            name_of(F.col(f"`{role}`")).alias("name"),
            escape(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    # The rank needs the same shuffle as the grouping below it, and sorting may spill.
    rank = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("t"))
    rows = rows.withColumn("part", F.floor((rank - 1) / most).cast("long"))
    blocks = durable(rows.groupBy("conv_id", "block", "part").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    end = len(END) + 1
    context = lambda name: name.isin(*CONTEXT_ROLES)
    head = lambda name, own: (
        F.when(context(name), F.concat(F.lit(START), name, F.lit("\n")))
        .when(own, F.lit(f"{START}assistant\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))
    )
    # Lengths alone say where each row's text begins: that with all speakers as users, and less for own turns.
    names = F.transform("turns", lambda t: t["name"])
    plain = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.length(head(t["name"], F.lit(False))) + F.length(t["text"]) + end)
    light = blocks.select("conv_id", "block", "part", names.alias("names"), plain.alias("plain"))
    people = light.select(F.col("conv_id").alias("c"), F.explode("names").alias("perspective")).where(~context(F.col("perspective"))).distinct()
    light = light.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    less = F.length(head(F.col("perspective"), F.lit(False))) - F.length(head(F.col("perspective"), F.lit(True)))
    own_turns = F.size(F.filter("names", lambda x: x == F.col("perspective")))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = light.select("conv_id", "block", "part", "perspective", (F.col("plain") - own_turns * less).alias("size"))
    offsets = offsets.select(F.col("conv_id").alias("c"), F.col("block").alias("o_block"), F.col("part").alias("o_part"), "perspective", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("o_block")) & (F.col("part") == F.col("o_part"))
    both = blocks.join(offsets, same).drop("c", "o_block", "o_part")
    own = lambda t: t["name"] == F.col("perspective")
    both = both.withColumn("heads", F.transform("turns", lambda t: head(t["name"], own(t))))
    step = F.zip_with("heads", "turns", lambda h, t: (F.length(h) + F.length(t["text"]) + end).cast("long"))
    both = both.withColumn("starts", running_sums(step, F.col("offset")))
    pieces = F.zip_with("heads", "turns", lambda h, t: F.concat(h, t["text"], F.lit(f"{END}\n")))
    spans = F.transform(
        F.filter(F.arrays_zip("starts", "heads", "turns"), lambda z: z["turns"].isNotNull() & own(z["turns"])),
        lambda z: F.struct(
            (z["starts"] + F.length(z["heads"])).alias("start"),
            (z["starts"] + F.length(z["heads"]) + F.length(z["turns"]["text"]) + len(END)).alias("end"),
        ),
    )
    return both.select("conv_id", "perspective", "block", "part", F.size("turns").cast("long").alias("n_turns"), "offset", F.array_join(pieces, "").alias("rendered"), spans.alias("mask"))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    df = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    target = F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return df.select("conv_id", "perspective", "block", "part", "n_turns", "offset", "rendered", mask.alias("mask"), F.length("rendered").cast("long").alias("n_chars"), target.alias("target_chars"))


def _sql() -> str:
    name = "coalesce(role, 'unknown')"
    for c in CODED:
        name = f"replace({name}, chr({ord(c)}), '~{ord(c):02X}')"
    return rf"""
WITH r AS (
  SELECT conv_id, coalesce(floor(turn / {BLOCK}), -1)::BIGINT AS block, turn, {name} AS name,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS txt,
         row_number() OVER () AS rid
  FROM conversations
), t AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, name, txt, rid) - 1) // {MOST_TURNS} AS part FROM r
), p AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> 'system'),
x AS (
  SELECT t.*, perspective,
         CASE WHEN name = 'system' THEN '{START}system' || chr(10) WHEN name = perspective THEN '{START}assistant' || chr(10)
              ELSE '{START}user name=' || name || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), y AS (
  SELECT *, head || txt || '{END}' || chr(10) AS piece,
         coalesce(sum(length(head) + length(txt) + {len(END) + 1}) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, txt, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
  FROM x
)
SELECT conv_id, perspective, block, part::BIGINT AS part, count(*) AS n_turns, min(s) AS offset, string_agg(piece, '' ORDER BY s) AS rendered,
       coalesce(string_agg((s + length(head))::VARCHAR || '-' || (s + length(head) + length(txt) + {len(END)})::VARCHAR, ',' ORDER BY s) FILTER (name = perspective), '') AS mask,
       sum(length(piece))::BIGINT AS n_chars,
       coalesce(sum(length(txt) + {len(END)}) FILTER (name = perspective), 0)::BIGINT AS target_chars
FROM y GROUP BY conv_id, perspective, block, part
"""


OP1_SQL = _sql()
