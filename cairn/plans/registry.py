"""Registered queries: assistant/thread registries, settings records, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans import query_registry
from cairn.operators import registry as RG
from cairn.operators import select as S
from cairn.functions.hashing import sha256_hex
from cairn.plans import sqlx as X
from cairn.sources import fixtures as FX
from cairn.sources.tables import read_table

QUERIES, ORACLE, register = query_registry()


SYNC_TIME = 1735689600  # fixed 'now' (2025-01-01T00:00:00Z) so synced rows are reproducible
# Fixed literal registry row: a stale copy of a default assistant, named in other case.
STALE_DEFAULT = ("asst_legacy", "coding assistant", "old instructions", 1600000000, -1)


def _imported(spark, sf_dir):
    """Imported assistants: low keys share names in pairs (ambiguous), some fields blank."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    name = F.concat(F.lit("Agent "), F.when(k < 300, k - k % 2).otherwise(k).cast("string"))
    return c.select(F.concat(F.lit("asst_imp_"), k.cast("string")).alias("id"), name.alias("name"),
                    F.when(F.col("c_nationkey") % 5 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
                    .alias("instructions"),
                    F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_name")).alias("display_name"),
                    (F.lit(1704067200) + k * 60).cast("bigint").alias("created_at"), k.alias("position"))


_IMPORTED = """(SELECT 'asst_imp_' || CAST(c_custkey AS VARCHAR) AS id,
  'Agent ' || CAST(CASE WHEN c_custkey < 300 THEN c_custkey - c_custkey % 2 ELSE c_custkey END AS VARCHAR) AS name,
  CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_mktsegment END AS instructions,
  CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS display_name,
  CAST(1704067200 + c_custkey * 60 AS BIGINT) AS created_at, c_custkey AS position FROM customer)"""

_ORDERED = "(SELECT *, row_number() OVER (ORDER BY created_at, position) AS ordinal FROM assistants)"


# ----------------------------------------------------------------- records


def _settings_docs(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    doc = F.struct(
        F.concat(F.lit("sk-"), k.cast("string")).alias("api_key"),
        F.when(k % 4 != 0, F.when(F.col("c_mktsegment") == "BUILDING", "gpt-4o").otherwise("gpt-4")).alias("model"),
        F.when(k % 5 != 0, F.col("c_acctbal") > 0).alias("compression"),
        F.when(k % 3 != 0, F.lit("json")).alias("data_mode"),
        F.when(k % 7 != 0, F.lit("native")).alias("code_style"),
        F.when(k % 13 != 0, F.array(F.concat(F.lit("asst_"), k.cast("string")))).alias("assistants"),
        F.array().cast("array<string>").alias("threads"),
        F.when(k % 11 == 0, F.concat(F.lit("asst_legacy"), k.cast("string"))).alias("assistant_id"))
    return c.select(k, F.to_json(doc).alias("json"))


@register("normalize_records", """
SELECT c_custkey, 'sk-' || CAST(c_custkey AS VARCHAR) AS api_key,
  CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'gpt-4o' ELSE 'gpt-4' END
       ELSE 'gpt-3.5-turbo' END AS model,
  CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal > 0 ELSE true END AS compression,
  CASE WHEN c_custkey % 3 <> 0 THEN 'json' ELSE 'binary' END AS data_mode,
  CASE WHEN c_custkey % 7 <> 0 THEN 'native' ELSE 'monokai' END AS code_style,
  CASE WHEN c_custkey % 13 <> 0 THEN 1 ELSE 0 END AS n_assistants, 0 AS n_threads,
  (2 + (c_custkey % 4 <> 0)::INT + (c_custkey % 5 <> 0)::INT + (c_custkey % 3 <> 0)::INT
     + (c_custkey % 7 <> 0)::INT + (c_custkey % 13 <> 0)::INT + (c_custkey % 11 = 0)::INT) <> 7 AS changed
FROM customer""")
def q_normalize_records(spark, sf_dir):
    return RG.normalize_settings(_settings_docs(spark, sf_dir))


@register("export_records", """
SELECT id, name, assistant_name, assistant_id,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN epoch_us(created_at) % 1000000 <> 0 THEN printf('.%06d', epoch_us(created_at) % 1000000) ELSE '' END
    AS created_at_iso,
  epoch_us(created_at) / 1000000.0 AS created_at_ts,
  CAST(epoch_us(created_at) // 1000000 AS BIGINT) AS created_at_int
FROM threads""")
def q_export_records(spark, sf_dir):
    t = RG.export_times(FX.threads(spark, sf_dir))
    return t.drop("created_at", "position").select(
        "id", "name", "assistant_name", "assistant_id", "created_at_iso",
        F.col("created_at_ts").cast("double").alias("created_at_ts"), "created_at_int")


_CACHE_DOC = """'{"h' || CAST(event_id AS VARCHAR) || '": "file-' || substr(sha256(props), 1, 8) || '", ' || substr(props, 2)"""


@register("clean_cache", f"""
WITH d AS (SELECT event_id, {_CACHE_DOC} AS j FROM events),
k AS (SELECT event_id, j, unnest(json_keys(j)) AS key FROM d)
SELECT event_id, key, json_extract_string(j, '$."' || key || '"') AS value FROM k
WHERE json_type(j, '$."' || key || '"') = 'VARCHAR'""")
def q_clean_cache(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "props")
    doc = F.concat(F.lit('{"h'), F.col("event_id").cast("string"), F.lit('": "file-'),
                   F.substring(sha256_hex("props"), 1, 8), F.lit('", '), F.expr("substring(props, 2)"))
    return RG.clean_cache(e.select("event_id", doc.alias("json")))


@register("record_keys", """
SELECT id, sha256(name || chr(10) || instructions) AS record_key FROM assistants""")
def q_record_keys(spark, sf_dir):
    return FX.assistants(spark, sf_dir).select("id", RG.record_key().alias("record_key"))


@register("thread_records", """
SELECT 'thread_' || CAST(o_orderkey AS VARCHAR) AS id, 'order ' || CAST(o_orderkey AS VARCHAR) AS name,
  c.c_name AS assistant_name, 'asst_' || CAST(o_custkey AS VARCHAR) AS assistant_id,
  CAST(epoch(o_orderdate) AS BIGINT) AS created_epoch,
  strftime(make_timestamp(CAST(epoch(o_orderdate) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_thread_records(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    remote = o.select("o_orderkey", "o_custkey",
                      F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_epoch"))
    rec = remote.join(c, remote.o_custkey == c.c_custkey, "left").select(
        F.concat(F.lit("thread_"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.struct(F.col("c_name").alias("name"),
                 F.concat(F.lit("asst_"), F.col("o_custkey").cast("string")).alias("id")).alias("assistant"),
        "created_epoch", F.timestamp_seconds("created_epoch").alias("created_at"))
    return rec.select("id", "name", F.col("assistant.name").alias("assistant_name"),
                      F.col("assistant.id").alias("assistant_id"), "created_epoch",
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# ----------------------------------------------------------------- checks


def _name_candidates(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id").distinct()
    k = F.col("conv_id")
    cand = F.when(k % 2 == 0, F.concat(F.lit("ORDER "), (k * 3).cast("string"))).otherwise(
        F.concat(F.lit("Thread "), k.cast("string")))
    return c.select(k, cand.alias("input"))


@register("check_choices", """
SELECT 'name' AS kind, input, lower(input) NOT IN (SELECT lower(name) FROM threads) AS valid
FROM (SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'ORDER ' || CAST(conv_id * 3 AS VARCHAR)
                                ELSE 'Thread ' || CAST(conv_id AS VARCHAR) END AS input FROM conversations)
UNION ALL
SELECT 'number' AS kind, input,
  coalesce(TRY_CAST(trim(input) AS BIGINT) BETWEEN 1 AND (SELECT count(*) FROM assistants), false) AS valid
FROM (SELECT ' ' || CAST(conv_id * 20 - 5 + turn AS VARCHAR) AS input FROM conversations)""")
def q_check_choices(spark, sf_dir):
    names = RG.check_choices(_name_candidates(spark, sf_dir), FX.threads(spark, sf_dir), "input", "name",
                             blacklist=True, case_sensitive=False)
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn")
    answers = conv.select(F.concat(F.lit(" "), (F.col("conv_id") * 20 - 5 + F.col("turn")).cast("string"))
                          .alias("input"))
    numbers = RG.check_numeric_choices(answers, FX.assistants(spark, sf_dir), "input")
    return (names.select(F.lit("name").alias("kind"), "input", "valid")
            .unionByName(numbers.select(F.lit("number").alias("kind"), "input", "valid")))


@register("missing_fields", f"""
SELECT id,
  array_to_string(list_filter([CASE WHEN display_name = '' THEN 'name' END,
                               CASE WHEN instructions = '' THEN 'instructions' END], lambda x: x IS NOT NULL), ',') AS missing,
  CAST((display_name = '')::INT + (instructions = '')::INT AS INTEGER) AS n_missing
FROM {_IMPORTED}""")
def q_missing_fields(spark, sf_dir):
    rec = _imported(spark, sf_dir).select("id", F.col("display_name").alias("name"), "instructions")
    out = RG.missing_fields(rec)
    return out.select("id", F.array_join("missing", ",").alias("missing"),
                      F.size("missing").cast("int").alias("n_missing"))


# ----------------------------------------------------------------- joins


def _defaults_df(spark):
    return spark.createDataFrame([(n, i, s) for s, (n, i, _, _) in enumerate(RG.DEFAULT_ASSISTANTS, start=1)],
                                 "name string, instructions string, seq int")


_DEFAULTS_SQL = "(VALUES " + ", ".join(
    f"({X.q(n)}, {X.q(i)}, {s})" for s, (n, i, _, _) in enumerate(RG.DEFAULT_ASSISTANTS, start=1)) + \
    ") d(dname, dinstr, dseq)"


@register("conversation_opening", f"""
WITH reg AS (SELECT id, name, instructions FROM assistants
  UNION ALL SELECT 'asst_default_' || CAST(dseq AS VARCHAR), dname, dinstr FROM {_DEFAULTS_SQL}),
o AS (SELECT * FROM (VALUES {', '.join(f'({X.q(n)}, {X.q(i)}, {X.q(u)}, {X.q(g)})' for n, i, u, g in RG.CONVERSATION_OPENINGS)}) v(oname, oinstr, user_msg, gpt_msg))
SELECT reg.id, coalesce(o.user_msg, {X.q(RG.DEFAULT_OPENING[0])}) AS user_msg,
  coalesce(o.gpt_msg, {X.q(RG.DEFAULT_OPENING[1])}) AS gpt_msg
FROM reg LEFT JOIN o ON reg.name = o.oname AND reg.instructions = o.oinstr""")
def q_conversation_opening(spark, sf_dir):
    a = FX.assistants(spark, sf_dir).select("id", "name", "instructions")
    d = _defaults_df(spark).select(F.concat(F.lit("asst_default_"), F.col("seq").cast("string")).alias("id"),
                                   "name", "instructions")
    return RG.conversation_opening(a.unionByName(d)).select("id", "user_msg", "gpt_msg")


@register("thread_assistant", """
WITH n AS (SELECT lower(name) AS lname, arg_min(id, position) AS aid FROM assistants GROUP BY 1 HAVING count(*) = 1)
SELECT t.id, coalesce(n.aid, t.assistant_id) AS resolved_assistant_id,
  CASE WHEN n.aid IS NOT NULL THEN 'name' ELSE 'stored_id' END AS resolved_by
FROM threads t LEFT JOIN n ON lower(t.assistant_name) = n.lname""")
def q_thread_assistant(spark, sf_dir):
    r = RG.thread_assistant(FX.threads(spark, sf_dir), FX.assistants(spark, sf_dir))
    return r.select("id", "resolved_assistant_id", "resolved_by")


def _registry_with_stale(spark, sf_dir):
    a = FX.assistants(spark, sf_dir).select("id", "name", "instructions", "created_at", "position")
    stale = spark.createDataFrame([STALE_DEFAULT],
                                  "id string, name string, instructions string, created_at bigint, position bigint")
    return a.unionByName(stale)


_STALE_SQL = "SELECT " + ", ".join([X.q(STALE_DEFAULT[0]), X.q(STALE_DEFAULT[1]), X.q(STALE_DEFAULT[2]),
                                    f"CAST({STALE_DEFAULT[3]} AS BIGINT)", f"CAST({STALE_DEFAULT[4]} AS BIGINT)"])


@register("sync_defaults", f"""
WITH reg AS (SELECT id, name, instructions, created_at, position FROM assistants UNION ALL {_STALE_SQL}),
names AS (SELECT lower(name) AS lname, count(*) AS n, arg_min(id, position) AS id FROM reg GROUP BY 1),
m AS (SELECT d.*, n.id AS old_id, n.n AS n FROM {_DEFAULTS_SQL} LEFT JOIN names n ON lower(d.dname) = n.lname),
rep AS (SELECT m.old_id, m.dname, m.dinstr FROM m JOIN reg r ON r.id = m.old_id
        WHERE m.n = 1 AND (r.name <> m.dname OR r.instructions <> m.dinstr))
SELECT CASE WHEN rep.old_id IS NOT NULL THEN 'asst_' || substr(sha256(rep.dname || chr(10) || rep.dinstr), 1, 24)
            ELSE r.id END AS id,
  coalesce(rep.dname, r.name) AS name, coalesce(rep.dinstr, r.instructions) AS instructions,
  r.created_at, r.position, CASE WHEN rep.old_id IS NOT NULL THEN 'replaced' ELSE 'kept' END AS action
FROM reg r LEFT JOIN rep ON r.id = rep.old_id
UNION ALL
SELECT 'asst_' || substr(sha256(dname || chr(10) || dinstr), 1, 24), dname, dinstr, CAST({SYNC_TIME} AS BIGINT),
  CAST((SELECT max(position) FROM reg) + dseq AS BIGINT), 'appended'
FROM m WHERE n IS NULL""")
def q_sync_defaults(spark, sf_dir):
    out = RG.sync_defaults(_registry_with_stale(spark, sf_dir), _defaults_df(spark), SYNC_TIME)
    return out.select("id", "name", "instructions", "created_at", "position", "action")


def _thread_candidates(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id").distinct()
    k = F.col("conv_id")
    name = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(F.lit("ORDER "), k.cast("string")))
             .otherwise(F.concat(F.lit("chat "), (k % 50).cast("string"))))
    return c.select(F.concat(F.lit("thread_c"), k.cast("string")).alias("id"), name.alias("name"),
                    k.alias("pos"))


@register("append_unique", """
WITH c AS (SELECT DISTINCT 'thread_c' || CAST(conv_id AS VARCHAR) AS id,
             CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'ORDER ' || CAST(conv_id AS VARCHAR)
                  ELSE 'chat ' || CAST(conv_id % 50 AS VARCHAR) END AS name, conv_id AS pos FROM conversations),
a AS (SELECT c.* FROM c JOIN (SELECT lower(name) AS lname, min(pos) AS p FROM c WHERE length(name) > 0 GROUP BY 1) f
        ON lower(c.name) = f.lname AND c.pos = f.p
      WHERE lower(c.name) NOT IN (SELECT lower(name) FROM threads))
SELECT id, name, pos, CAST((SELECT max(position) FROM threads) + row_number() OVER (ORDER BY pos) AS BIGINT) AS position
FROM a""")
def q_append_unique(spark, sf_dir):
    return RG.append_unique(FX.threads(spark, sf_dir), _thread_candidates(spark, sf_dir), "pos").select(
        "id", "name", "pos", "position")


@register("lookup_by_id", f"""
WITH l AS (SELECT id AS thread_id, CASE WHEN position % 10 = 0 THEN assistant_id || '_x' ELSE assistant_id END AS lookup
           FROM threads),
r AS (SELECT id, min(ordinal) - 1 AS idx FROM {_ORDERED} GROUP BY id)
SELECT l.thread_id, l.lookup, CAST(coalesce(r.idx, -1) AS BIGINT) AS idx FROM l LEFT JOIN r ON l.lookup = r.id""")
def q_lookup_by_id(spark, sf_dir):
    t = FX.threads(spark, sf_dir)
    look = t.select(F.col("id").alias("thread_id"),
                    F.when(F.col("position") % 10 == 0, F.concat("assistant_id", F.lit("_x")))
                    .otherwise(F.col("assistant_id")).alias("lookup"))
    return RG.lookup_by_id(look, FX.assistants(spark, sf_dir), "lookup").select("thread_id", "lookup", "idx")


def _identifiers(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    ident = (F.when(k % 6 == 0, F.concat(F.lit("asst_"), ck.cast("string")))
              .when(k % 6 == 1, F.upper("c_name"))
              .when(k % 6 == 2, (ck % 2000 + 1).cast("string"))
              .when(k % 6 == 3, F.concat(F.lit("asst_x"), k.cast("string")))
              .when(k % 6 == 4, F.concat(F.lit("-"), (k % 3).cast("string")))
              .otherwise(F.concat(F.lit(" "), ck.cast("string"), F.lit(" "))))
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", ident.alias("identifier"))


_IDENT_SQL = """(SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN 'asst_' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN upper(c.c_name)
    WHEN 2 THEN CAST(o_custkey % 2000 + 1 AS VARCHAR) WHEN 3 THEN 'asst_x' || CAST(o_orderkey AS VARCHAR)
    WHEN 4 THEN '-' || CAST(o_orderkey % 3 AS VARCHAR) ELSE ' ' || CAST(o_custkey AS VARCHAR) || ' ' END AS identifier
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""


def _resolve_sql(idents: str, registry: str) -> str:
    return f"""
WITH r AS (SELECT id, name, row_number() OVER (ORDER BY created_at, position) - 1 AS idx FROM {registry}),
byid AS (SELECT id, min(idx) AS idx FROM r GROUP BY id),
byname AS (SELECT lower(name) AS lname, arg_min(id, idx) AS id, min(idx) AS idx FROM r GROUP BY 1 HAVING count(*) = 1),
i AS (SELECT *, starts_with(identifier, 'asst_') OR starts_with(identifier, 'thread_') AS pre,
        TRY_CAST(trim(identifier) AS BIGINT) - 1 AS num FROM {idents}),
res AS (SELECT i.*,
  CASE WHEN i.pre THEN b1.idx ELSE coalesce(b2.idx, r3.idx) END AS ridx,
  CASE WHEN i.pre THEN b1.id ELSE coalesce(b2.id, r3.id) END AS rid
  FROM i LEFT JOIN byid b1 ON i.pre AND i.identifier = b1.id
  LEFT JOIN byname b2 ON NOT i.pre AND lower(i.identifier) = b2.lname
  LEFT JOIN r r3 ON NOT i.pre AND b2.lname IS NULL AND i.num = r3.idx)"""


@register("resolve_identifier", _resolve_sql(_IDENT_SQL, "assistants") + """
SELECT o_orderkey, identifier, rid AS resolved_id, CAST(coalesce(ridx, -1) AS BIGINT) AS idx FROM res""")
def q_resolve_identifier(spark, sf_dir):
    r = RG.resolve_identifier(_identifiers(spark, sf_dir), FX.assistants(spark, sf_dir), "identifier")
    return r.select("o_orderkey", "identifier", "resolved_id", "idx")


@register("registry_delete", _resolve_sql(
    "(SELECT lower(c_name) AS identifier FROM customer WHERE c_acctbal < 0)", "assistants") + """
SELECT id, name, row_number() OVER (ORDER BY created_at, position) AS ordinal FROM assistants
WHERE id NOT IN (SELECT rid FROM res WHERE ridx >= 0)""")
def q_registry_delete(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_name", "c_acctbal")
    idents = c.filter(F.col("c_acctbal") < 0).select(F.lower("c_name").alias("identifier"))
    return RG.delete_identified(FX.assistants(spark, sf_dir), idents).select("id", "name", "ordinal")


# ----------------------------------------------------------------- names / order


@register("ambiguous_names", f"""
SELECT lower(name) AS lname, count(*) AS n, min(position) AS first_position FROM {_IMPORTED}
GROUP BY 1 HAVING count(*) > 1""")
def q_ambiguous_names(spark, sf_dir):
    return RG.ambiguous_names(_imported(spark, sf_dir))


@register("lookup_by_name", f"""
WITH reg AS {_IMPORTED},
cnt AS (SELECT lower(name) AS lname, count(*) AS n, arg_min(id, position) AS id FROM reg GROUP BY 1),
l AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'agent x' || CAST(c_custkey AS VARCHAR)
                  ELSE 'AGENT ' || CAST(c_custkey AS VARCHAR) END AS lookup FROM customer)
SELECT l.lookup, CASE WHEN cnt.n IS NULL THEN 'missing' WHEN cnt.n > 1 THEN 'ambiguous' ELSE 'found' END AS status,
  CASE WHEN cnt.n = 1 THEN cnt.id END AS id
FROM l LEFT JOIN cnt ON lower(l.lookup) = cnt.lname""")
def q_lookup_by_name(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    look = c.select(F.when(k % 10 == 0, F.concat(F.lit("agent x"), k.cast("string")))
                    .otherwise(F.concat(F.lit("AGENT "), k.cast("string"))).alias("lookup"))
    return RG.lookup_by_name(look, _imported(spark, sf_dir), "lookup").select("lookup", "status", "id")


@register("registry_menu", f"""
SELECT id, name, ordinal, CAST(ordinal AS VARCHAR) || ') ' || name AS line FROM {_ORDERED}""")
def q_registry_menu(spark, sf_dir):
    return RG.menu(FX.assistants(spark, sf_dir))


@register("registry_sorted", """
SELECT id, row_number() OVER (ORDER BY name DESC, position) AS ordinal FROM assistants""")
def q_registry_sorted(spark, sf_dir):
    return RG.custom_order(FX.assistants(spark, sf_dir), "name", descending=True).select("id", "ordinal")


PICKED = 7  # the ordinal that the query picks


@register("pick_ordinal", f"""
SELECT 'first' AS pick, id, name FROM {_ORDERED} WHERE ordinal = 1
UNION ALL SELECT 'n-th', id, name FROM {_ORDERED} WHERE ordinal = {PICKED}
UNION ALL SELECT 'last', id, name FROM {_ORDERED} WHERE ordinal = (SELECT count(*) FROM assistants)""")
def q_pick_ordinal(spark, sf_dir):
    registry = FX.assistants(spark, sf_dir)
    picks = [RG.pick(registry, n).select(F.lit(label).alias("pick"), "id", "name")
             for label, n in (("first", 1), ("n-th", PICKED), ("last", -1))]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


@register("export_json", """
SELECT id, '{"id":"' || id || '","name":"' || name || '","assistant":{"name":"' || assistant_name || '","id":"'
  || assistant_id || '"},"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN epoch_us(created_at) % 1000000 <> 0 THEN printf('.%06d', epoch_us(created_at) % 1000000) ELSE '' END
  || '"}' AS json
FROM threads WHERE assistant_name IS NOT NULL AND assistant_id IS NOT NULL""")
def q_export_json(spark, sf_dir):
    """Thread records as JSON, with the assistant nested and times as ISO text."""
    t = FX.threads(spark, sf_dir).filter("assistant_name IS NOT NULL AND assistant_id IS NOT NULL")
    return RG.export_json(t.select("id", "name", F.struct(
        F.col("assistant_name").alias("name"), F.col("assistant_id").alias("id")).alias("assistant"), "created_at"))
