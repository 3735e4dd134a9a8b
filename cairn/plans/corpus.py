"""Registered corpus queries: selection, fingerprints, cache, stores.

Each query is ``(spark, sf_dir) -> DataFrame`` over whole tables; its DuckDB
oracle text sits next to it in ``ORACLE``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans import query_registry
from cairn.functions import text as T
from cairn.functions.hashing import ALGORITHMS, content_id, int64_digest, sha256_hex
from cairn.operators import cache as C
from cairn.operators import listing as LI
from cairn.operators import select as S
from cairn.operators import stores as ST
from cairn.plans import sqlx as X
from cairn.session import written
from cairn.sources import fixtures as FX
from cairn.sources.tables import read_table

QUERIES, ORACLE, register = query_registry()


P, CT = "path", "content"

# ----------------------------------------------------------------- selection


@register("filter_extension", f"""
SELECT doc_id, path, {X.suffix(P)} AS suffix FROM files WHERE {X.allowed_suffix(P)}""")
def q_filter_extension(spark, sf_dir):
    return S.filter_extension(FX.files(spark, sf_dir)).select("doc_id", "path",
                                                              T.path_suffix("path").alias("suffix"))


@register("detect_encoding", f"""
SELECT doc_id, {X.encoding(CT)} AS encoding FROM files""")
def q_detect_encoding(spark, sf_dir):
    return S.detect_encoding(FX.files(spark, sf_dir)).select("doc_id", "encoding")


@register("filter_encoding", f"""
SELECT doc_id, {X.encoding(CT)} AS encoding FROM files
WHERE {X.encoding(CT)} IN ('UTF-8', 'ASCII')""")
def q_filter_encoding(spark, sf_dir):
    return S.filter_encoding(FX.files(spark, sf_dir)).select("doc_id", "encoding")


@register("filter_directories", f"""
SELECT doc_id, path FROM files WHERE NOT {X.bad_dir(P)}""")
def q_filter_directories(spark, sf_dir):
    return S.filter_directories(FX.files(spark, sf_dir)).select("doc_id", "path")


@register("filter_patterns", f"""
SELECT doc_id, path FROM files WHERE NOT {X.bad_pattern(P)}""")
def q_filter_patterns(spark, sf_dir):
    return S.filter_patterns(FX.files(spark, sf_dir)).select("doc_id", "path")


@register("select_files", f"""
SELECT doc_id, path, {X.disposition(P, CT)} AS disposition FROM files
WHERE {X.disposition(P, CT)} IN ('kept', 'converted')""")
def q_select_files(spark, sf_dir):
    return S.select_files(FX.files(spark, sf_dir)).select("doc_id", "path", "disposition")


@register("classify_files", f"""
SELECT doc_id, path, {X.disposition(P, CT)} AS disposition FROM files""")
def q_classify_files(spark, sf_dir):
    return S.classify(FX.files(spark, sf_dir)).select("doc_id", "path", "disposition")


@register("convert_extension", f"""
SELECT doc_id, path,
  CASE WHEN {X.suffix(P)} = '.lua' THEN {X.parent(P)} || {X.stem(P)} || '.txt' ELSE path END AS upload_path
FROM files WHERE {X.disposition(P, CT)} IN ('kept', 'converted')""")
def q_convert_extension(spark, sf_dir):
    sel = S.select_files(FX.files(spark, sf_dir))
    return S.convert_extension(sel).select("doc_id", "path", "upload_path")


@register("selection_stats", f"""
SELECT source, count(*) AS total_count,
  CAST(count_if(d = 'kept') AS BIGINT) AS valid_count,
  CAST(count_if(d = 'converted') AS BIGINT) AS converted_count,
  CAST(count_if(d IN ('kept', 'converted')) AS BIGINT) AS selected_count
FROM (SELECT source, {X.disposition(P, CT)} AS d FROM files) GROUP BY source""")
def q_selection_stats(spark, sf_dir):
    return S.selection_stats(S.classify(FX.files(spark, sf_dir)), ["source"])


@register("union_selected", f"""
SELECT doc_id, CASE WHEN d = 'converted' THEN {X.parent(P)} || {X.stem(P)} || '.txt' ELSE path END AS path,
  d AS disposition
FROM (SELECT doc_id, path, {X.disposition(P, CT)} AS d FROM files) WHERE d IN ('kept', 'converted')""")
def q_union_selected(spark, sf_dir):
    sel = S.select_files(FX.files(spark, sf_dir))
    return (S.union_selected(S.kept_files(sel), S.convertible_files(sel))
            .select("doc_id", "path", "disposition"))


@register("except_converted", f"""
SELECT doc_id, path FROM files WHERE {X.disposition(P, CT)} = 'kept'""")
def q_except_converted(spark, sf_dir):
    f = FX.files(spark, sf_dir)
    passing = S.select_files(f).drop("disposition")
    return S.except_converted(passing).select("doc_id", "path")


# ----------------------------------------------------------------- fingerprints


@register("fingerprint_corpus", """
SELECT doc_id, sha256(text) AS hash FROM documents""")
def q_fingerprint_corpus(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return C.fingerprint(d, "text").select("doc_id", "hash")


@register("fingerprint_sha3")  # DuckDB has no SHA-3; tested against hashlib
def q_fingerprint_sha3(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return C.fingerprint(d, "text", algorithm="sha3_256").select("doc_id", "hash")


@register("fingerprint_xxh")  # tested against the xxhash library
def q_fingerprint_xxh(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    names = [a for a in ALGORITHMS if a.startswith("xx")]
    for name in names:
        d = C.fingerprint(d, "text", name, name)
    return d.select("doc_id", *names)


@register("fingerprint_int64", """
SELECT doc_id, CAST(CAST('0x' || substr(sha256(text), 1, 16) AS UBIGINT) AS VARCHAR) AS int64_digest
FROM documents""")
def q_fingerprint_int64(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", int64_digest(sha256_hex("text")).alias("int64_digest"))


@register("size_labels", f"""
SELECT doc_id, sz, {X.size_label('sz')} AS size_label
FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) * CAST(power(1024, doc_id % 5) AS BIGINT)
             + doc_id AS sz FROM documents)""")
def q_size_labels(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    sz = (F.octet_length("text").cast("bigint")
          * F.pow(F.lit(1024), F.col("doc_id") % 5).cast("bigint") + F.col("doc_id"))
    return d.select("doc_id", sz.alias("sz")).select("doc_id", "sz", T.size_label("sz").alias("size_label"))


# ----------------------------------------------------------------- cache


def _assigned(spark, sf_dir):
    return C.assign_file_ids(FX.batch(spark, sf_dir), FX.hash_cache(spark, sf_dir))


_ASSIGN_SQL = """
SELECT b.pos, b.path, b.source, b.hash,
  coalesce(c.file_id, 'file-' || substr(b.hash, 1, 24)) AS file_id,
  (c.file_id IS NOT NULL OR b.pos > f.first_pos) AS cached
FROM batch b
JOIN (SELECT hash, min(pos) AS first_pos FROM batch GROUP BY hash) f USING (hash)
LEFT JOIN hash_cache c USING (hash)"""


@register("assign_file_ids", _ASSIGN_SQL)
def q_assign_file_ids(spark, sf_dir):
    return _assigned(spark, sf_dir).select("pos", "path", "source", "hash", "file_id", "cached")


@register("assign_file_ids_filtered", _ASSIGN_SQL)
def q_assign_file_ids_filtered(spark, sf_dir):
    """The same ids by way of the cache's Bloom filter, which is written beside the cache."""
    cache = FX.hash_cache(spark, sf_dir)
    blocks = C.filter_geometry(cache.count())
    held = written(C.build_filter(cache, blocks), "cache_filter")
    ids = C.assign_file_ids_filtered(FX.batch(spark, sf_dir), cache, held, blocks)
    return ids.select("pos", "path", "source", "hash", "file_id", "cached")


@register("batch_duplicates", """
WITH b AS (SELECT doc_id AS pos, sha256(content) AS hash FROM files)
SELECT b.pos, b.hash, f.first_pos FROM b
JOIN (SELECT hash, min(pos) AS first_pos FROM b GROUP BY hash) f USING (hash)
WHERE b.pos > f.first_pos""")
def q_batch_duplicates(spark, sf_dir):
    """All files as one batch."""
    everything = C.fingerprint(FX.files(spark, sf_dir).select(F.col("doc_id").alias("pos"), "content")).select("pos", "hash")
    return C.batch_duplicates(everything).select("pos", "hash", "first_pos")


@register("cache_stats", f"""
SELECT source, count(*) AS n_files, CAST(count_if(cached) AS BIGINT) AS n_cached,
  CAST(count_if(NOT cached) AS BIGINT) AS n_new
FROM ({_ASSIGN_SQL}) GROUP BY source""")
def q_cache_stats(spark, sf_dir):
    return C.cache_stats(_assigned(spark, sf_dir), ["source"])


@register("update_hash_cache", """
SELECT hash, file_id FROM hash_cache
UNION ALL
SELECT DISTINCT hash, 'file-' || substr(hash, 1, 24) AS file_id FROM batch
WHERE hash NOT IN (SELECT hash FROM hash_cache)""")
def q_update_hash_cache(spark, sf_dir):
    cache = FX.hash_cache(spark, sf_dir)
    return C.update_hash_cache(cache, _assigned(spark, sf_dir))


def _stored_metadata(spark, sf_dir):
    """Metadata saved by the earlier run (doc_id % 3 = 0): first-seen record per hash."""
    f = FX.files(spark, sf_dir).filter(F.col("doc_id") % 3 == 0).withColumn("hash", sha256_hex("content"))
    rec = F.struct(T.path_name("path").alias("name"), F.col("path").alias("full_path"),
                   F.octet_length("content").cast("bigint").alias("sz_bytes"),
                   content_id("vs_", "hash").alias("vector_store_id"),
                   content_id("file-", "hash").alias("file_id"))
    return (f.groupBy("hash").agg(F.min_by(rec, "doc_id").alias("r"))
             .select("hash", "r.*"))


_STORED_SQL = f"""
SELECT hash, arg_min(struct_pack(name := {X.name(P)}, full_path := path,
    sz_bytes := CAST(octet_length(encode(content)) AS BIGINT)), doc_id) AS r
FROM (SELECT *, sha256(content) AS hash FROM files WHERE doc_id % 3 = 0) GROUP BY hash"""


@register("restore_or_create_files", f"""
WITH stored AS ({_STORED_SQL}),
first AS (SELECT hash, min(pos) AS first_pos, arg_min(path, pos) AS fpath,
                 arg_min(CAST(octet_length(encode(content)) AS BIGINT), pos) AS fsize FROM batch GROUP BY hash)
SELECT b.pos, b.path, b.source, b.content, b.hash,
  coalesce(s.r.name, {X.name('f.fpath')}) AS name,
  coalesce(s.r.full_path, f.fpath) AS full_path,
  coalesce(s.r.sz_bytes, f.fsize) AS sz_bytes,
  'vs_' || substr(b.hash, 1, 24) AS vector_store_id,
  'file-' || substr(b.hash, 1, 24) AS file_id,
  (s.hash IS NOT NULL OR b.pos > f.first_pos) AS restored
FROM batch b JOIN first f USING (hash) LEFT JOIN stored s USING (hash)""")
def q_restore_or_create_files(spark, sf_dir):
    return C.restore_or_create_files(FX.batch(spark, sf_dir), _stored_metadata(spark, sf_dir))


# ----------------------------------------------------------------- stores


def _selected_with_ids(spark, sf_dir):
    sel = S.convert_extension(S.select_files(FX.files(spark, sf_dir)))
    return (sel.withColumn("hash", sha256_hex("content"))
               .withColumn("file_id", content_id("file-", "hash"))
               .withColumnRenamed("source", "store"))


_SELECTED_SQL = f"""
SELECT doc_id, source AS store, path, content, 'file-' || substr(sha256(content), 1, 24) AS file_id
FROM files WHERE {X.disposition(P, CT)} IN ('kept', 'converted')"""


@register("build_store", f"""
SELECT store, {X.store_id('store')} AS store_id, path, file_id,
  row_number() OVER (PARTITION BY store ORDER BY path, file_id) AS position
FROM ({_SELECTED_SQL})""")
def q_build_store(spark, sf_dir):
    return (ST.build_store(_selected_with_ids(spark, sf_dir), "store", "path")
            .select("store", "store_id", "path", "file_id", "position"))


@register("first_files", f"""
SELECT store, {X.store_id('store')} AS store_id, path, file_id
FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY path, file_id) AS k FROM ({_SELECTED_SQL})) WHERE k = 1""")
def q_first_files(spark, sf_dir):
    """Each store's first file and its id."""
    return ST.first_files(_selected_with_ids(spark, sf_dir).select("store", "path", "file_id"))


@register("file_contents", f"""
SELECT path, sha256(arg_max(content, doc_id)) AS content_hash,
  CAST(length(arg_max(content, doc_id)) AS BIGINT) AS n_chars
FROM (SELECT doc_id, CASE WHEN {X.suffix(P)} = '.lua' THEN {X.parent(P)} || {X.stem(P)} || '.txt'
                          ELSE path END AS path, content FROM ({_SELECTED_SQL}))
GROUP BY path""")
def q_file_contents(spark, sf_dir):
    sel = _selected_with_ids(spark, sf_dir).select("doc_id", F.col("upload_path").alias("path"), "content")
    return (ST.file_contents(sel, "path", "doc_id", "content")
            .select("path", sha256_hex("content").alias("content_hash"),
                    F.length("content").cast("bigint").alias("n_chars")))


@register("store_status", f"""
SELECT {X.store_id('store')} AS id, store AS name,
  CASE WHEN in_progress = 0 THEN 'completed' ELSE 'in_progress' END AS status,
  total, completed, in_progress, usage_bytes, {X.size_label('usage_bytes')} AS size_label,
  printf('%s (%s), %d/%d file(s), %s', {X.store_id('store')}, store, completed, total,
         {X.size_label('usage_bytes')}) AS info
FROM (SELECT store, count(*) AS total, CAST(count_if(status = 'completed') AS BIGINT) AS completed,
        CAST(count_if(status = 'in_progress') AS BIGINT) AS in_progress,
        CAST(sum(bytes) AS BIGINT) AS usage_bytes
      FROM file_status GROUP BY store)""")
def q_store_status(spark, sf_dir):
    return ST.store_status(FX.file_status(spark, sf_dir), "store")


# ----------------------------------------------------------------- listing difference

# The earlier listing has the files with doc_id % 4 <> 0, the later one those with doc_id % 4 <> 1,
# of which every sixth has moved to another folder and every fifth has been edited.
_LISTINGS_SQL = """
old AS (SELECT path, source, sha256(content) AS hash FROM files WHERE doc_id % 4 <> 0),
new AS (SELECT CASE WHEN doc_id % 6 = 0 THEN '/corpus/' || source || '/moved' || substr(path, length(source) + 9) ELSE path END AS path,
  source, sha256(CASE WHEN doc_id % 5 = 0 THEN content || ' edited' ELSE content END) AS hash FROM files WHERE doc_id % 4 <> 1)"""


def _listings(spark, sf_dir):
    f, k = FX.files(spark, sf_dir), F.col("doc_id")
    old = f.filter(k % 4 != 0).select("path", sha256_hex("content").alias("hash"))
    moved = F.concat(F.lit("/corpus/"), "source", F.lit("/moved"), F.expr("substr(path, length(source) + 9)"))
    edited = F.when(k % 5 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content"))
    new = f.filter(k % 4 != 1).select(F.when(k % 6 == 0, moved).otherwise(F.col("path")).alias("path"), sha256_hex(edited).alias("hash"))
    return old, new


@register("listing_changes", f"""
WITH {_LISTINGS_SQL.strip()},
come AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM new WHERE path NOT IN (SELECT path FROM old)),
gone AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM old WHERE path NOT IN (SELECT path FROM new))
SELECT new.path, 'changed' AS change, old.path AS old_path, old.hash AS old_hash, new.hash AS hash
FROM new JOIN old USING (path) WHERE new.hash <> old.hash
UNION ALL SELECT come.path, CASE WHEN gone.path IS NULL THEN 'added' ELSE 'moved' END, coalesce(gone.path, ''),
  CASE WHEN gone.path IS NULL THEN '' ELSE gone.hash END, come.hash FROM come LEFT JOIN gone ON come.hash = gone.hash AND come.n = gone.n
UNION ALL SELECT gone.path, 'removed', gone.path, gone.hash, '' FROM gone ANTI JOIN come ON come.hash = gone.hash AND come.n = gone.n""")
def q_listing_changes(spark, sf_dir):
    return LI.listing_changes(*_listings(spark, sf_dir)).fillna("")


@register("stores_after_changes", f"""
WITH {_LISTINGS_SQL.strip()}
SELECT source AS store, path, 'file-' || substr(hash, 1, 24) AS file_id FROM new""")
def q_stores_after_changes(spark, sf_dir):
    """Stores of the earlier listing brought up to date by the difference: equal to a fresh build."""
    old, new = _listings(spark, sf_dir)
    store_of = F.regexp_extract("path", "^/corpus/([^/]*)/", 1)
    members = old.select(store_of.alias("store"), "path", content_id("file-", "hash").alias("file_id"))
    return LI.apply_changes(members, LI.listing_changes(old, new), store_of)


# ----------------------------------------------------------------- flagship


def ingest_summary(spark, sf_dir):
    """Per store: selected files, how many are new vs already cached, and the store size.

    files -> select_files -> fingerprint -> assign_file_ids (against the
    earlier run's cache) -> per-store roll-up.
    """
    files = FX.files(spark, sf_dir)
    selected = C.fingerprint(S.select_files(files), "content").withColumn("pos", F.col("doc_id"))
    assigned = C.assign_file_ids(selected, FX.hash_cache(spark, sf_dir))
    agg = assigned.groupBy(F.col("source").alias("store")).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if("cached").cast("bigint").alias("n_cached"),
        F.count_if(~F.col("cached")).cast("bigint").alias("n_new"),
        F.sum(F.octet_length("content")).cast("bigint").alias("usage_bytes"))
    return agg.select(ST.store_id(F.col("store")).alias("store_id"), "store", "n_files", "n_cached",
                      "n_new", "usage_bytes", T.size_label("usage_bytes").alias("size_label"))


register("ingest_summary", f"""
WITH sel AS (SELECT doc_id AS pos, source, content, sha256(content) AS hash FROM files
             WHERE {X.disposition(P, CT)} IN ('kept', 'converted')),
a AS (SELECT s.*, (c.file_id IS NOT NULL OR s.pos > f.first_pos) AS cached
      FROM sel s JOIN (SELECT hash, min(pos) AS first_pos FROM sel GROUP BY hash) f USING (hash)
      LEFT JOIN hash_cache c USING (hash)),
g AS (SELECT source AS store, count(*) AS n_files, CAST(count_if(cached) AS BIGINT) AS n_cached,
        CAST(count_if(NOT cached) AS BIGINT) AS n_new,
        CAST(sum(octet_length(encode(content))) AS BIGINT) AS usage_bytes FROM a GROUP BY source)
SELECT {X.store_id('store')} AS store_id, store, n_files, n_cached, n_new, usage_bytes,
  {X.size_label('usage_bytes')} AS size_label FROM g""")(ingest_summary)
