"""Assistant / thread registries: lookups, upserts, ordinals, exports.

Registries are DataFrames with an explicit ``position`` (rows have no order).
The 'list' order is created_at ascending, stable on position.  Ordinals come
from the distributed ``global_ordinal`` (never a single-partition window), and
lookups are joins, so a registry may be as large as any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.hashing import sha256_hex
from cairn.functions.ordinal import global_ordinal, nth
from cairn.session import written

ID_PREFIXES = ("asst_", "thread_")

# The two default assistants and their conversation openings.
TRANSCRIPT_ASSISTANT_NAME = "Transcript Analysis Assistant"
TRANSCRIPT_ASSISTANT_INSTRUCTIONS = (
    "You are an assistant that summarizes video transcripts and answers questions about them.")
CODING_ASSISTANT_NAME = "Coding Assistant"
CODING_ASSISTANT_INSTRUCTIONS = (
    "You are an assistant which helps users by generating, debugging, and optimizing code snippets.\n"
    "It provides clear, well-commented code along with explanations to aid user understanding.\n"
    "\nGeneral Guidelines\n"
    "1.) Understand the Request: Ensure you fully understand the users requirements. Ask clarifying questions if needed.\n"
    "2.) Simplicity and Clarity: Provide simple, clean, and well-documented code. Avoid overly complex solutions unless explicitly requested.\n"
    "3.) Explain the Code: Always include a brief explanation of the code to help the user understand how it works.\n"
    "4.) Best Practices: Follow coding best practices and conventions for the relevant programming language.\n"
    "5.) Error Handling: Include error handling where appropriate to make the code robust.\n"
    "6.) Modularity: Write modular code with functions or classes to enhance readability and reusability.\n"
    "\nCode Generation Steps\n"
    "1.) Identify the Language: Confirm the programming language to be used (e.g., Python, JavaScript, etc.).\n"
    "2.) Gather Requirements: Understand the specific functionality or problem the user needs the code to address.\n"
    "3.) Write the Code: Generate the code snippet or full program.\n"
    "4.) Comment the Code: Add comments to explain key parts of the code.\n"
    "5.) Provide Explanation: Write a brief explanation of what the code does and how it works.\n"
    "6.) Optimize: If applicable, suggest optimizations or improvements."
)
DEFAULT_ASSISTANTS = (
    (TRANSCRIPT_ASSISTANT_NAME, TRANSCRIPT_ASSISTANT_INSTRUCTIONS, True, False),
    (CODING_ASSISTANT_NAME, CODING_ASSISTANT_INSTRUCTIONS, True, True),
)
CONVERSATION_OPENINGS = (
    (TRANSCRIPT_ASSISTANT_NAME, TRANSCRIPT_ASSISTANT_INSTRUCTIONS,
     "Generating summary of transcript...", "Please summarize the transcript."),
    (CODING_ASSISTANT_NAME, CODING_ASSISTANT_INSTRUCTIONS,
     "Generating summary of codebase...", "Please summarize the codebase."),
)
DEFAULT_OPENING = ("Generating summary of content...",
                   "Please identify what the provided content is and provide a summary.")
DEFAULT_MODEL = "gpt-3.5-turbo"
SETTINGS_DEFAULTS = {"model": DEFAULT_MODEL, "compression": True, "code_style": "monokai",
                     "data_mode": "binary"}
SETTINGS_KEYS = ("api_key", "model", "compression", "data_mode", "code_style", "assistants", "threads")


def default_order(registry: DataFrame, name: str = "ordinal") -> DataFrame:
    """1-based ordinal in list order: created_at ascending, stable on position."""
    return global_ordinal(registry, ["created_at", "position"], name)


def pick(registry: DataFrame, n: int) -> DataFrame:
    """The n-th item of the list (1-based; negative: from the end); empty if there is none."""
    return nth(registry, ["created_at", "position"], n)


def custom_order(registry: DataFrame, key, descending: bool = False, name: str = "ordinal") -> DataFrame:
    """1-based ordinal by a custom key column/expression, ties kept in position order."""
    k = F.col(key) if isinstance(key, str) else key
    return global_ordinal(registry.withColumn("_key", k),
                          [F.col("_key").desc() if descending else F.col("_key").asc(), "position"],
                          name).drop("_key")


def menu(registry: DataFrame) -> DataFrame:
    """'N) name' lines of the list command."""
    ordered = default_order(registry)
    return ordered.select("id", "name", "ordinal",
                          F.concat(F.col("ordinal").cast("string"), F.lit(") "), F.col("name")).alias("line"))


def unique_names(registry: DataFrame) -> DataFrame:
    """(lname, id, position) for case-insensitive names held by exactly one item."""
    return (registry.groupBy(F.lower("name").alias("lname"))
                    .agg(F.count(F.lit(1)).alias("_n"), F.min_by("id", "position").alias("id"))
                    .filter(F.col("_n") == 1).drop("_n"))


def ambiguous_names(registry: DataFrame) -> DataFrame:
    """Case-insensitive names held by more than one item (a name lookup would fail)."""
    return (registry.groupBy(F.lower("name").alias("lname"))
                    .agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"))
                    .filter(F.col("n") > 1))


def lookup_by_name(lookups: DataFrame, registry: DataFrame, col: str = "lookup") -> DataFrame:
    """Per lookup: status 'found' / 'ambiguous' / 'missing' and the id when found."""
    counts = (registry.groupBy(F.lower("name").alias("_lname"))
                      .agg(F.count(F.lit(1)).alias("_n"), F.min_by("id", "position").alias("_id")))
    counts = written(counts, "name_counts")  # so that a hot lookup's join can be split
    j = lookups.join(counts, F.lower(F.col(col)) == F.col("_lname"), "left")
    status = (F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("found"))
    return (j.withColumn("status", status)
             .withColumn("id", F.when(F.col("_n") == 1, F.col("_id")))
             .drop("_lname", "_n", "_id"))


def lookup_by_id(lookups: DataFrame, registry: DataFrame, col: str = "lookup") -> DataFrame:
    """Per lookup: ``idx`` = 0-based list position of the first item with that id, else -1."""
    idx = written(default_order(registry).groupBy("id").agg((F.min("ordinal") - 1).alias("_idx")), "id_places")
    return (lookups.join(idx, F.col(col) == F.col("id"), "left")
                   .withColumn("idx", F.coalesce(F.col("_idx"), F.lit(-1)).cast("bigint"))
                   .drop("_idx"))


def resolve_identifier(idents: DataFrame, registry: DataFrame, col: str = "identifier") -> DataFrame:
    """Resolve each identifier to (resolved_id, idx); idx -1 when nothing matches.

    An 'asst_'/'thread_' prefix is looked up as an id only; otherwise the
    case-insensitive unique name, then a 1-based menu number (whitespace
    allowed); numbers out of range resolve to nothing.
    """
    ordered = default_order(registry)
    # written tables, so that the joins of a hot identifier can be split
    by_id = written(ordered.groupBy("id").agg((F.min("ordinal") - 1).alias("_idx_id")), "id_places")
    by_name = written(unique_names(ordered.select("id", "name", "position"))
                      .join(by_id.withColumnRenamed("_idx_id", "_idx_name"), "id")
                      .select("lname", "_idx_name", F.col("id").alias("_id_name")), "name_places")
    by_num = written(ordered.select((F.col("ordinal") - 1).alias("_idx_num"), F.col("id").alias("_id_num")), "places")
    ident = F.col(col)
    prefixed = F.lit(False)
    for p in ID_PREFIXES:
        prefixed = prefixed | ident.startswith(p)
    number = F.expr(f"try_cast(trim(`{col}`) AS BIGINT)") - 1
    j = (idents.withColumn("_prefixed", prefixed).withColumn("_num", number)
               .join(by_id.withColumnRenamed("id", "_id"), F.col("_prefixed") & (ident == F.col("_id")), "left")
               .join(by_name, ~F.col("_prefixed") & (F.lower(ident) == F.col("lname")), "left")
               .join(by_num, ~F.col("_prefixed") & F.col("_idx_name").isNull()
                     & (F.col("_num") == F.col("_idx_num")), "left"))
    idx = F.coalesce(F.col("_idx_id"), F.col("_idx_name"), F.col("_idx_num"), F.lit(-1)).cast("bigint")
    rid = F.coalesce(F.col("_id"), F.col("_id_name"), F.col("_id_num"))
    return (j.withColumn("idx", idx).withColumn("resolved_id", rid)
             .drop("_prefixed", "_num", "_id", "_idx_id", "lname", "_idx_name", "_id_name", "_idx_num", "_id_num"))


def delete_identified(registry: DataFrame, idents: DataFrame, col: str = "identifier") -> DataFrame:
    """Registry without the items the identifiers resolve to (all resolved against the
    registry as it was), renumbered."""
    gone = resolve_identifier(idents, registry, col).filter(F.col("idx") >= 0).select(
        F.col("resolved_id").alias("id")).distinct()
    return default_order(registry.join(gone, "id", "left_anti"))


def thread_assistant(threads: DataFrame, assistants: DataFrame) -> DataFrame:
    """The assistant a thread resumes with: by its stored name (unique,
    case-insensitive, names only), falling back to the stored id."""
    names = written(unique_names(assistants).withColumnRenamed("id", "_by_name"), "unique_names")
    return (threads.join(names, F.lower(F.col("assistant_name")) == F.col("lname"), "left")
                   .withColumn("resolved_assistant_id", F.coalesce("_by_name", "assistant_id"))
                   .withColumn("resolved_by", F.when(F.col("_by_name").isNotNull(), "name").otherwise("stored_id"))
                   .drop("lname", "_by_name"))


def conversation_opening(assistants: DataFrame) -> DataFrame:
    """(user_msg, gpt_msg) keyed by an assistant's (name, instructions); default otherwise.
    The lookup side is a fixed two-row table, so it is broadcast."""
    spark = assistants.sparkSession
    openings = spark.createDataFrame(
        [(n, i, u, g) for n, i, u, g in CONVERSATION_OPENINGS],
        "_name string, _instructions string, user_msg string, gpt_msg string")
    j = assistants.join(F.broadcast(openings),
                        (F.col("name") == F.col("_name")) & (F.col("instructions") == F.col("_instructions")),
                        "left")
    return (j.withColumn("user_msg", F.coalesce("user_msg", F.lit(DEFAULT_OPENING[0])))
             .withColumn("gpt_msg", F.coalesce("gpt_msg", F.lit(DEFAULT_OPENING[1])))
             .drop("_name", "_instructions"))


def assistant_id_for(name, instructions) -> "F.Column":
    return F.concat(F.lit("asst_"), F.substring(sha256_hex(F.concat_ws("\n", name, instructions)), 1, 24))


def record_key(name="name", instructions="instructions") -> "F.Column":
    """Content key of an assistant: equality is on (name, instructions) only."""
    return sha256_hex(F.concat_ws("\n", F.col(name), F.col(instructions)))


def sync_defaults(registry: DataFrame, defaults: DataFrame, now_epoch: int) -> DataFrame:
    """Bring the default assistants into the registry.

    Looked up by case-insensitive name: missing -> appended after the last
    position; found once but not equal (name or instructions differ) ->
    replaced in place, keeping created_at and position; equal -> kept; the
    name held by several items -> that default is skipped (the lookup fails).
    Output: the whole registry with ``action``.  The defaults are a fixed list of a few
    rows, so they and what they match are broadcast.
    """
    reg = registry.select("id", "name", "instructions", "created_at", "position")
    d = defaults.select(F.lower("name").alias("_lname"), F.col("name").alias("_dname"),
                        F.col("instructions").alias("_dinstr"), F.col("seq").alias("_dseq"))
    # only items that carry a default's name matter: a row per default is left of them
    held = (reg.join(F.broadcast(d.select("_lname")), F.lower("name") == F.col("_lname"), "left_semi")
               .groupBy(F.lower("name").alias("_lname")).agg(
                   F.count(F.lit(1)).alias("_n"),
                   F.min_by(F.struct("id", "name", "instructions"), "position").alias("_old")))
    matched = written(d.join(held, "_lname", "left"), "default_matches")
    replace = (matched.filter((F.col("_n") == 1) & ((F.col("_old.name") != F.col("_dname"))
                                                    | (F.col("_old.instructions") != F.col("_dinstr"))))
                      .select(F.col("_old.id").alias("_old_id"), "_dname", "_dinstr"))
    updated = (reg.join(F.broadcast(replace), F.col("id") == F.col("_old_id"), "left")
                  .select(F.when(F.col("_old_id").isNotNull(), assistant_id_for(F.col("_dname"), F.col("_dinstr")))
                           .otherwise(F.col("id")).alias("id"),
                          F.coalesce("_dname", "name").alias("name"),
                          F.coalesce("_dinstr", "instructions").alias("instructions"),
                          "created_at", "position",
                          F.when(F.col("_old_id").isNotNull(), "replaced").otherwise("kept").alias("action")))
    last = reg.agg(F.max("position")).scalar()  # scalar subquery: one value, no join
    appended = (matched.filter(F.col("_n").isNull())
                .select(assistant_id_for(F.col("_dname"), F.col("_dinstr")).alias("id"),
                        F.col("_dname").alias("name"), F.col("_dinstr").alias("instructions"),
                        F.lit(now_epoch).cast("bigint").alias("created_at"),
                        (F.coalesce(last, F.lit(-1)) + F.col("_dseq")).cast("bigint").alias("position"),
                        F.lit("appended").alias("action")))
    return updated.unionByName(appended)


def append_unique(registry: DataFrame, candidates: DataFrame, order: str = "pos") -> DataFrame:
    """Candidates accepted into the registry: non-empty name, not taken
    (case-insensitive) and not taken by an earlier candidate.  Output: the
    accepted rows with their new positions after the registry's last."""
    named = candidates.filter(F.length("name") > 0).withColumn("lname", F.lower("name"))
    first = named.groupBy("lname").agg(F.min(order).alias("_first"))
    taken = registry.select(F.lower("name").alias("lname")).distinct()
    first = written(first, "first_names")
    accepted = (named.join(first, "lname").filter(F.col(order) == F.col("_first"))
                     .join(taken, "lname", "left_anti").drop("_first", "lname"))
    last = registry.agg(F.max("position")).scalar()  # scalar subquery
    return (global_ordinal(accepted, [order], "_k")
            .withColumn("position", (F.coalesce(last, F.lit(-1)) + F.col("_k")).cast("bigint"))
            .drop("_k"))


def missing_fields(records: DataFrame) -> DataFrame:
    """Expected-but-empty fields of each record (name, instructions)."""
    miss = F.array_compact(F.array(F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.lit("name")),
                                   F.when(F.coalesce(F.col("instructions"), F.lit("")) == "",
                                          F.lit("instructions"))))
    return records.withColumn("missing", miss)


def check_choices(inputs: DataFrame, choices: DataFrame, col: str = "input", choice: str = "choice",
                  blacklist: bool = False, case_sensitive: bool = True) -> DataFrame:
    """``valid`` per input: in the choice list (or not in it, for a blacklist)."""
    key = (lambda c: c) if case_sensitive else (lambda c: F.lower(c))
    ch = written(choices.select(key(F.col(choice)).alias("_c")).distinct().withColumn("_hit", F.lit(True)), "choices")
    j = inputs.join(ch, key(F.col(col)) == F.col("_c"), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.withColumn("valid", ~hit if blacklist else hit).drop("_c", "_hit")


def check_numeric_choices(inputs: DataFrame, registry: DataFrame, col: str = "input") -> DataFrame:
    """``valid`` when the input parses as an integer within 1..len(registry)."""
    num = F.expr(f"try_cast(trim(`{col}`) AS BIGINT)")
    n = registry.agg(F.count(F.lit(1))).scalar()
    return inputs.withColumn("valid", F.coalesce((num >= 1) & (num <= n), F.lit(False)))


def clean_cache(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """JSON objects -> (key, value) for string values only (others are dropped)."""
    m = F.from_json(F.col(json_col), "map<string,variant>")
    kept = F.transform_values(F.map_filter(m, lambda k, v: F.schema_of_variant(v) == "STRING"),
                              lambda k, v: F.variant_get(v, "$", "string"))
    return docs.select("*", F.explode(kept).alias("key", "value")).drop(json_col)


SETTINGS_SCHEMA = T.StructType([
    T.StructField("api_key", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("compression", T.BooleanType()), T.StructField("data_mode", T.StringType()),
    T.StructField("code_style", T.StringType()),
    T.StructField("assistants", T.ArrayType(T.StringType())),
    T.StructField("threads", T.ArrayType(T.StringType())),
    T.StructField("assistant_id", T.StringType())])


def normalize_settings(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Settings JSON -> typed columns with defaults for missing keys, the deprecated
    key dropped, and ``changed`` when the key count is not the expected one."""
    s = F.from_json(F.col(json_col), SETTINGS_SCHEMA)
    n_keys = F.size(F.json_object_keys(F.col(json_col)))
    out = docs.select(
        "*", s["api_key"].alias("api_key"),
        F.coalesce(s["model"], F.lit(SETTINGS_DEFAULTS["model"])).alias("model"),
        F.coalesce(s["compression"], F.lit(SETTINGS_DEFAULTS["compression"])).alias("compression"),
        F.coalesce(s["data_mode"], F.lit(SETTINGS_DEFAULTS["data_mode"])).alias("data_mode"),
        F.coalesce(s["code_style"], F.lit(SETTINGS_DEFAULTS["code_style"])).alias("code_style"),
        F.size(F.coalesce(s["assistants"], F.array().cast("array<string>"))).alias("n_assistants"),
        F.size(F.coalesce(s["threads"], F.array().cast("array<string>"))).alias("n_threads"),
        (n_keys != len(SETTINGS_KEYS)).alias("changed"))
    return out.drop(json_col)


def export_times(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """The three timestamp conversions of an export: ISO text, float and int epoch seconds."""
    t = F.col(ts)
    micros = F.unix_micros(t)
    return (df.withColumn(f"{ts}_iso", iso_time(t))
              .withColumn(f"{ts}_ts", (micros / F.lit(1_000_000.0)))
              .withColumn(f"{ts}_int", (micros / F.lit(1_000_000)).cast("bigint")))


def convert_times(df: DataFrame, convert) -> DataFrame:
    """Every timestamp of ``df``, at any depth of structs, arrays and map values, replaced by
    ``convert(column)``."""
    def walk(value, kind: T.DataType):
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return convert(value)
        if isinstance(kind, T.StructType):
            fields = F.struct(*[walk(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(value.isNotNull(), fields)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, x: walk(x, kind.valueType))
        return value

    return df.select(*[walk(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def iso_time(t) -> "F.Column":
    """ISO text of a timestamp, with a fraction only where there is one."""
    micros = F.unix_micros(t)
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros % 1_000_000 != 0, F.concat(iso, F.format_string(".%06d", F.pmod(micros, F.lit(1_000_000))))).otherwise(iso)


def export_json(records: DataFrame) -> DataFrame:
    """One JSON text per record, nested records included, timestamps as ISO text."""
    exported = convert_times(records, iso_time)
    return exported.select("id", F.to_json(F.struct(*exported.columns), {"ignoreNullFields": "false"}).alias("json"))
