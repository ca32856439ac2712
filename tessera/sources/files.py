"""Files as tables: bounded reads, format detection, text decoding, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx

MAX_BYTES = 10 << 20

#: In this order the first rule that holds names the format; content types, then name endings.
FORMATS = (
    ("HTML", ("text/html",), (".html", ".htm")),
    ("TEXT", ("text/",), (".txt", ".log", ".csv")),
    ("PDF", ("application/pdf",), (".pdf",)),
    ("DOCX", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), (".docx",)),
    ("PPTX", ("application/vnd.openxmlformats-officedocument.presentationml.presentation",), (".pptx",)),
    ("IMAGE", ("image/",), (".png", ".jpg", ".jpeg", ".bmp")),
    ("HWP", (), (".hwp",)),
    ("HWPX", (), (".hwpx",)),
)


def file_format(content_type: Column, name: Column) -> Column:
    """The format by content type or name, in the order of the rules, ``UNKNOWN`` if none holds."""
    kind, end = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    out = F
    for fmt, kinds, ends in FORMATS:
        test = F.lit(False)
        for k in kinds:
            test = test | kind.startswith(k)
        for e in ends:
            test = test | end.endswith(e)
        out = out.when(test, F.lit(fmt))
    return out.otherwise(F.lit("UNKNOWN"))


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files of up to ``max_bytes`` with their bytes, and the rejected ones without. The size filter reaches the
    source, so a rejected file's bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("format", file_format(F.lit(None).cast("string"), F.col("name")))
    return named.where(F.col("length") <= max_bytes), named.where(F.col("length") > max_bytes).select("path", "name", "length", F.lit("TOO_LARGE").alias("code"))


def decoded(content: Column) -> Column:
    """The text of UTF-8 bytes; bytes that are none read as replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def text_files(files: DataFrame) -> DataFrame:
    """Cleaned text of text files."""
    return files.where("format = 'TEXT'").select("path", "name", tx.clean_text(decoded(F.col("content"))).alias("text"))


def listing(files: DataFrame, prefix: str = "", delimiter: str | None = None) -> DataFrame:
    """Keys under a prefix; with a delimiter those beyond it are folded into their common prefix."""
    rows = files.where(F.col("key").startswith(prefix))
    if not delimiter:
        return rows.select("key", F.lit(False).alias("is_prefix"))
    rest = F.substr("key", F.lit(len(prefix) + 1))
    inner = F.instr(rest, delimiter) > 0
    folded = F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter))
    return rows.select(F.when(inner, folded).otherwise(F.col("key")).alias("key"), inner.alias("is_prefix")).distinct()
