r"""Chat formatting with Spark expressions only.

Turn structs are collected per conversation and sorted, adjacent turns of one
role are merged with array functions, and the template is concatenated::

    ### user: first text<part>second text</turn>\n### assistant: answer</turn>\n

``<part>`` keeps the original turns of a merged one apart. Inside roles and
texts the control strings are escaped (``\`` -> ``\\``, ``###`` -> ``\h``,
``</turn>`` -> ``\e``, ``<part>`` -> ``\p``, in roles also ``:`` -> ``\c``), so
the output can be read back exactly. ``pieces`` is the same output cut into
(text, loss) structs: loss is true for the texts of ``loss_role`` alone.

Nulls and edge cases: a null text or role counts as empty; rows with a null
conversation id form one conversation; a null turn sorts first; equal turn
numbers are ordered by role, then text; repeated rows stay as turns of their
own. Only the four named columns are read. An empty table gives no rows.

Scale: one shuffle, on the conversation id. A conversation is one output text,
so it has to fit in one row; copies of a conversation have ids of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pizarra.llm.common import table

HEAD, END, PART = "###", "</turn>", "<part>"
ESCAPES = ((HEAD, "\\h"), (END, "\\e"), (PART, "\\p"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(c: Column, pairs=ESCAPES) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for plain, code in pairs:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(c: Column, pairs=ESCAPES) -> Column:
    r"""Splitting on ``\\`` from the left leaves the single backslashes that
    introduce a code; within a segment each code stands for its string."""

    def plain(segment: Column) -> Column:
        for text, code in pairs:
            segment = F.replace(segment, F.lit(code), F.lit(text))
        return segment

    return F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")


def merged_turns(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent turns of one role become one."""
    first = F.filter(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda i: (i == 0) | ~F.get(turns, i)["role"].eqNullSafe(F.get(turns, i - 1)["role"]),
    )
    return F.transform(
        first,
        lambda i, k: F.struct(
            F.get(turns, i)["role"].alias("role"),
            F.transform(F.slice(turns, i + 1, F.coalesce(F.get(first, k + 1), F.size(turns)) - i), lambda t: t["text"]).alias("texts"),
        ),
    )


def _pieces(turn: Column, loss_role: str) -> Column:
    """The template of one merged turn as array<struct<text, loss>>."""

    def piece(text, loss) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    head = F.concat(F.lit(HEAD + " "), escape(turn["role"], ROLE_ESCAPES), F.lit(": "))
    body = F.flatten(
        F.transform(
            turn["texts"],
            lambda text, i: F.array(
                piece(F.when(i == 0, head).otherwise(F.lit(PART)), F.lit(False)),
                piece(escape(text), turn["role"] == loss_role),
            ),
        )
    )
    return F.concat(body, F.array(piece(F.lit(END + "\n"), F.lit(False))))


def chat_format(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``id_col``, formatted, pieces."""
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = df.groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    merged = grouped.select(id_col, merged_turns(F.col("_turns")).alias("_merged"))
    pieces = merged.select(id_col, F.flatten(F.transform("_merged", lambda t: _pieces(t, loss_role))).alias("pieces"))
    return pieces.select(id_col, F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the original turns, parsed from the text."""
    blocks = F.filter(F.split(formatted, f"{END}\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        colon = F.instr(block, ":")
        role = unescape(F.substring(block, F.lit(len(HEAD) + 2), colon - len(HEAD) - 2), ROLE_ESCAPES)
        texts = F.split(F.substring(block, colon + 2, F.char_length(block)), PART)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.sql(
        "SELECT CAST(-7 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, :said AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)",
        args={"said": said},
    )
    out = chat_format(rows.unionByName(extra)).select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("pieces")).alias("loss")
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _esc_sql(c: str, pairs=ESCAPES) -> str:
    out = f"replace({c}, chr(92), chr(92) || chr(92))"
    for plain, code in pairs:
        out = f"replace({out}, '{plain}', '{code}')"
    return out


ORACLE = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(length({_esc_sql("text")})
    + CASE WHEN before = role THEN {len(PART)} ELSE length({_esc_sql("role", ROLE_ESCAPES)}) + {len(HEAD) + 3} END
    + CASE WHEN after = role THEN 0 ELSE {len(END) + 1} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
