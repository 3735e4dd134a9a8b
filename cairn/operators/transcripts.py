"""Transcripts: nested records <-> exploded entries, and the rendered text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.ordinal import ordered_concat
from cairn.functions.text import elapsed_text

ENTRY = T.StructType([T.StructField("text", T.StringType()),
                      T.StructField("start", T.DoubleType()),
                      T.StructField("duration", T.DoubleType())])
TRANSCRIPT = T.StructType([T.StructField("video_id", T.StringType()),
                           T.StructField("vector_store_id", T.StringType()),
                           T.StructField("file_id", T.StringType()),
                           T.StructField("entries", T.ArrayType(ENTRY))])


def nest_transcripts(entries: DataFrame) -> DataFrame:
    """Exploded entries (video_id, pos, text, start, duration) -> one record per video,
    entries in ``pos`` order, with its JSON text."""
    item = F.struct(F.col("pos").alias("p"),
                    F.struct("text", F.col("start").cast("double").alias("start"),
                             F.col("duration").cast("double").alias("duration")).alias("e"))
    nested = (entries.groupBy("video_id")
                     .agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("entries")))
    rec = F.struct("video_id", F.lit("").alias("vector_store_id"), F.lit("").alias("file_id"), "entries")
    return nested.select("video_id", "entries", F.to_json(rec).alias("json"))


def load_transcripts(records: DataFrame, json_col: str = "json") -> DataFrame:
    """JSON transcript records -> exploded entries; a record without entries keeps one
    row with null entry fields (``pos`` null)."""
    parsed = records.select(F.from_json(F.col(json_col), TRANSCRIPT).alias("t"))
    return (parsed.select("t.video_id", "t.vector_store_id", "t.file_id",
                          F.posexplode_outer(F.coalesce(F.col("t.entries"), F.array().cast(T.ArrayType(ENTRY))))
                          .alias("pos", "e"))
                  .select("video_id", "vector_store_id", "file_id", "pos", "e.text", "e.start", "e.duration"))


def render_transcripts(entries: DataFrame) -> DataFrame:
    """'H:MM:SS text' lines per video, in entry order, joined by newlines."""
    lines = entries.select("video_id", "pos",
                           F.concat(elapsed_text("start"), F.lit(" "), F.col("text")).alias("line"))
    text = ordered_concat(lines, ["video_id"], "pos", "line", "\n", "transcript")
    counts = entries.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return text.join(counts, "video_id")
