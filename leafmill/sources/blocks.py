"""Conversations as blocks, rendered to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INPUT_SHOWN = 80


def render(kind: Column, text: Column, name: Column, tool_input: Column, content: Column) -> Column:
    """Text of one block: words as they are, thoughts quoted, tool calls shortened, results by their size only, others dropped (null)."""
    quoted = F.concat(F.lit("> "), F.regexp_replace(F.coalesce(text, F.lit("")), "\n", "\n> "))
    call = F.concat(F.lit("["), F.coalesce(name, F.lit("tool")), F.lit(": "), F.substring(F.coalesce(tool_input, F.lit("")), 1, INPUT_SHOWN), F.lit("]"))
    result = F.concat(F.lit("[result: "), F.coalesce(F.octet_length(content), F.lit(0)).cast("string"), F.lit(" bytes]"))
    return F.when(kind == "text", text).when(kind == "thinking", quoted).when(kind == "tool_use", call).when(kind == "tool_result", result)


def conversations(blocks: DataFrame) -> DataFrame:
    """``conv_id, body`` of blocks (conv_id, turn, block_no, type, text, name, input, content), in order; conversations without any text are left out."""
    shown = blocks.withColumn("part", render(F.col("type"), F.col("text"), F.col("name"), F.col("input"), F.col("content"))).where(F.col("part").isNotNull())
    ordered = F.sort_array(F.collect_list(F.struct("turn", "block_no", "part")))
    return shown.groupBy("conv_id").agg(F.array_join(ordered.getField("part"), "\n\n").alias("body"))
