"""Chunkers as table functions for SQL: one text in, its chunks out, by lateral join.

    register(spark)
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL chunk_text(text, 'sentence', 1000, 200) AS c")

The rows are those of `chunks.chunk_table`. `analyze` checks the constant arguments before
the query runs and adds offsets only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pagemill.operators.chunks import MODES, placed_chunks


def _constant(argument: AnalyzeArgument | None, name: str, default: int) -> int:
    if argument is None:
        return default
    if not argument.isConstantExpression or not isinstance(argument.dataType, (IntegerType, LongType)) or argument.value is None:
        raise ValueError(f"{name} must be a constant whole number")
    return argument.value


class ChunkText:
    """chunk_text(text, mode [, size, overlap, offsets]): chunk_index, total_chunks, content and, with offsets, their places."""

    @staticmethod
    def analyze(text: AnalyzeArgument, mode: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None,
                offsets: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("text must be a string")
        if not mode.isConstantExpression or mode.value not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if not 0 <= _constant(overlap, "overlap", 200) < _constant(size, "size", 1000):
            raise ValueError("overlap must be at least 0 and below size")
        schema = StructType().add("chunk_index", "long").add("total_chunks", "long").add("content", "string")
        if offsets is not None and offsets.value:
            schema = schema.add("start_index", "long").add("end_index", "long")
        return AnalyzeResult(schema)

    def eval(self, text: str, mode: str, size: int = 1000, overlap: int = 200, offsets: bool = False) -> Iterator[tuple]:
        for row in placed_chunks(text, mode, size, overlap):
            yield row if offsets else row[:3]


class MergeChunks:
    """merge_chunks(chunks [, max_size]): neighbouring chunks packed up to max_size, in order."""

    @staticmethod
    def analyze(chunks: AnalyzeArgument, max_size: AnalyzeArgument | None = None) -> AnalyzeResult:
        if chunks.dataType.simpleString() != "array<string>":
            raise ValueError("chunks must be an array of strings")
        if _constant(max_size, "max_size", 2000) < 1:
            raise ValueError("max_size must be above 0")
        return AnalyzeResult(StructType().add("chunk_index", "long").add("content", "string"))

    def eval(self, chunks: list[str], max_size: int = 2000) -> Iterator[tuple]:
        out: list[str] = []
        for chunk in chunks or []:
            if out and len(out[-1]) + len(chunk) < max_size:
                out[-1] = f"{out[-1]} {chunk}" if out[-1] else chunk
            else:
                out.append(chunk)
        yield from enumerate(t for t in (o.strip() for o in out) if t)


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", udtf(ChunkText))
    spark.udtf.register("merge_chunks", udtf(MergeChunks))
