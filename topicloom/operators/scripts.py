"""Multi-statement SQL scripts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from topicloom.session import fresh_dir

# Quoted text and comments are taken whole, so a separator inside them does not count.
_PIECE = re.compile(
    r"""(?P<quoted>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)
      | (?P<comment>--[^\n]*|/\*(?!\+).*?\*/)
      | (?P<end>;)
      | (?P<other>.)""", re.VERBOSE | re.DOTALL)


def split_script(text: str) -> list[str]:
    """Statements of a script, without comments and blanks."""
    statements = [""]
    for piece in _PIECE.finditer(text):
        if piece.lastgroup == "end":
            statements.append("")
        else:
            statements[-1] += " " if piece.lastgroup == "comment" else piece.group()
    return [s.strip() for s in statements if s.strip()]


def run_script(spark: SparkSession, text: str) -> DataFrame:
    """Run all statements in order; the result is that of the last one."""
    statements = split_script(text)
    if not statements:
        raise ValueError("the script holds no statement")
    for statement in statements[:-1]:
        spark.sql(statement)
    return spark.sql(statements[-1])


def run_stream_sql(spark: SparkSession, text: str) -> DataFrame:
    """The one statement of a continuous query over registered topics."""
    statements = split_script(text)
    if len(statements) != 1:
        raise ValueError(f"a continuous query takes one statement, got {len(statements)}")
    return spark.sql(statements[0])


def run_script_with_writeback(spark: SparkSession, text: str,
                              path: str | None = None, preview: int = 20
                              ) -> tuple[DataFrame, DataFrame, str]:
    """Write the script's result as JSON, then read result and preview from what was written.

    The query runs once, and result files keep the parallelism of the query.
    """
    path = path or fresh_dir(spark, "writeback")
    result = run_script(spark, text)
    result.write.mode("overwrite").json(path)
    written = spark.read.schema(result.schema).json(path)
    return written, written.limit(preview), path
