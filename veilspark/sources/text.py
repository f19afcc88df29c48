"""Text sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Recognizer, from_config


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line (``line`` from 1); carriage returns before line feeds go, a final partial line stays."""
    rest = [c for c in df.columns if c != text]
    parts = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n", -1)
    return df.select(*rest, F.posexplode(parts).alias("pos", text)).select(*rest, (F.col("pos") + 1).alias("line"), text)


def recognizers(path: str) -> tuple[Recognizer, ...]:
    """Recognizers of a JSON or YAML file on the driver."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return from_config(json.load(f))
        import yaml

        return from_config(yaml.safe_load(f) or {})


def as_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


FORMATS = ("parsable", "github", "colored", "standard")


def _padded(text, width: int):
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def report(df: DataFrame, style: str = "standard") -> DataFrame:
    """Findings (file, line, entity_type, start, end, score, recognizer) as lines of text: ``file, line, start, value``.

    ``standard`` and ``colored`` are for people, ``github`` for the annotations of that service's checks, ``parsable`` is a JSON object a
    line. The head of a file is not a line of its own here: rows are not in the order of files until they are sorted.
    A null file gives a null ``github`` line.
    """
    if style not in FORMATS:
        raise ValueError(f"style is one of {', '.join(FORMATS)}")
    place, score = F.concat(F.col("line").cast("string"), F.lit(":"), (F.col("start") + 1).cast("string")), F.col("score").cast("string")
    if style == "parsable":
        fields = F.struct("file", "line", (F.col("start") + 1).alias("column"), "entity_type", "start", "end", "score", "recognizer")
        value = F.to_json(fields, {"ignoreNullFields": "false"})
    elif style == "github":
        value = F.concat(F.lit("::"), score, F.lit(" file="), "file", F.lit(",line="), F.col("line").cast("string"), F.lit(",col="), (F.col("start") + 1).cast("string"), F.lit("::"), place, F.lit(" ["), "entity_type", F.lit("]"))
    elif style == "colored":
        dim = F.concat(F.lit("  \x1b[2m"), place, F.lit("\x1b[0m"))
        paint = F.concat(F.when(F.col("score") < 1, "\x1b[33m").otherwise("\x1b[31m"), score, F.lit("\x1b[0m"))
        value = F.concat(_padded(F.concat(_padded(dim, 20), paint), 38), "entity_type")
    else:
        value = F.concat(_padded(F.concat(_padded(F.concat(F.lit("  "), place), 12), score), 21), "entity_type")
    return df.select("file", "line", "start", value.alias("value"))
