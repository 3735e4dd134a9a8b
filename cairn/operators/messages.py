"""Conversation messages: payload assembly, tool lists, exit cuts, response text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.ordinal import group_ordinal, ordered_concat
from cairn.session import written

# The header message announcing the per-file messages.
HEADER_TEMPLATE = (
    "\nThe following %d messages will contain a file path, and the contents of the file.\n"
    "This information will be provided in the following json schema:\n"
    "{\n"
    "    'path': \"file path\",\n"
    "    'content': \"file contents\"\n"
    "}\n"
    "This information will be used throughout the duration of the conversation.\n"
)


def build_messages(files: DataFrame, store: str = "store", path: str = "path",
                   content: str = "content", limit: int = T.MAX_MESSAGE_CHARS) -> DataFrame:
    """Per store: a header (seq 0) stating the file count, then one message per file whose
    JSON payload is at most ``limit`` characters, numbered in path order.

    Output: store, seq, path, payload_chars, message (header text or JSON payload);
    the header's ``payload_chars`` is its own length.  Files with one path in a store are numbered
    in the order of their digests, repeated rows each on their own.
    """
    key = [store, path, "_digest"]
    # escaping never shortens a content, so longer ones needn't be measured
    short = F.length(content) <= limit
    digested = files.select(store, path, content, F.xxhash64(content).alias("_digest"))
    # counts and numbers are worked out on narrow rows, written once; contents are shuffled once, to meet them
    sized = written(digested.select(*key, F.when(short, T.payload_length(F.col(path), F.col(content))).alias("payload_chars")),
                    "message_sizes")
    numbered = group_ordinal(sized.filter(F.col("payload_chars") <= limit), [store], [path, "_digest"], "seq")
    contents = digested.filter(short).groupBy(*key).agg(F.first(content).alias(content))
    body = numbered.join(contents, key).select(
        store, "seq", path, "payload_chars",
        F.to_json(F.struct(F.col(path).alias("path"), F.col(content).alias("content"))).alias("message"))
    header = (sized.groupBy(store).agg(F.count(F.lit(1)).alias("n"))
                   .select(store, F.lit(0).cast("bigint").alias("seq"),
                           F.lit(None).cast("string").alias(path),
                           F.format_string(HEADER_TEMPLATE, F.col("n")).alias("message"))
                   .withColumn("payload_chars", F.length("message").cast("bigint")))
    return header.unionByName(body)


def thread_resources(assistants: DataFrame) -> DataFrame:
    """Tools, response format and tool resources implied by an assistant's flags."""
    tools = F.array_compact(F.array(F.when(F.col("file_search"), F.lit("file_search")),
                                    F.when(F.col("interpret_code"), F.lit("code_interpreter"))))
    return assistants.select(
        "id", tools.alias("tools"),
        F.when(F.col("respond_with_json"), "json_object").otherwise("auto").alias("response_format"),
        F.array_compact(F.array(F.when(F.col("file_search"), F.lit("file_search"))))
         .alias("tool_resources"))


def truncate_at_exit(turns: DataFrame, conv: str = "conv_id", pos: str = "pos",
                     role: str = "role", text: str = "text") -> DataFrame:
    """Drop each conversation's turns from its first user exit word on.

    The cut is a per-conversation aggregate, written and joined back (no window over a
    possibly huge conversation; the join on it can be split).
    """
    cut = written(turns.filter((F.col(role) == "user") & T.is_exit_word(text))
                       .groupBy(conv).agg(F.min(pos).alias("_cut")), "exit_cuts")
    return (turns.join(cut, conv, "left")
                 .filter(F.col("_cut").isNull() | (F.col(pos) < F.col("_cut")))
                 .drop("_cut"))


def message_blocks(messages: DataFrame, text: str = "text") -> DataFrame:
    """Assistant messages as content blocks: the text and a file attachment."""
    return messages.withColumn("content", F.array(
        F.struct(F.lit("text").alias("type"), F.col(text).alias("value")),
        F.struct(F.lit("image_file").alias("type"),
                 F.concat(F.lit("file-"), F.substring(F.sha2(F.col(text), 256), 1, 24)).alias("value"))))


def response_text(messages: DataFrame, run: str = "conv_id", seq: str = "pos") -> DataFrame:
    """Concatenate the text blocks of every message of a run, in order, no separator."""
    texts = messages.select(run, seq, F.array_join(
        F.transform(F.filter("content", lambda b: b["type"] == "text"), lambda b: b["value"]), "")
        .alias("_t"))
    joined = ordered_concat(texts, [run], seq, "_t", "", "response_text")
    counts = messages.groupBy(run).agg(F.count(F.lit(1)).alias("n_messages"))
    return joined.join(counts, run)
