"""What small tables can't show: ordinals of tables beyond the range sample, hot keys, several partition counts."""

import contextlib
import io

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from cairn.functions.ordinal import global_ordinal, group_ordinal, nth
from cairn.operators import cache as C
from cairn.operators import messages as M
from cairn.operators import registry as RG
from cairn.operators import summarize as SM
from cairn.operators import toolcalls as TC
from cairn.sources.tables import TABLES
from tools.check_oracle import digest, rows_of

ORDINAL_USERS = ("append_unique", "build_messages", "build_store", "lookup_by_id", "pick_ordinal", "registry_delete",
                 "registry_menu", "registry_sorted", "resolve_identifier")


@contextlib.contextmanager
def setting(spark, **conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("partitions", [4, 200])
def test_ordinal_users_match_beyond_the_range_sample(spark, partitions):
    sf = "/root/testdata/sf0.1"
    con, queries, sql = oracle(sf), E.queries(), E.oracle_sql()
    with setting(spark, **{"spark.sql.shuffle.partitions": str(partitions)}):
        for name in ORDINAL_USERS:
            columns, rows = rows_of(queries[name](spark, sf).toPandas())
            expected_columns, expected = rows_of(con.execute(sql[name]).df())
            assert columns == expected_columns and len(rows) == len(expected), name
            assert digest(rows) == digest(expected), name


def test_ordinals_with_payload_columns(spark):
    """20,000 rows with columns that no order looks at, against a window."""
    df = spark.range(20_000).select((F.hash("id") % 997).alias("k"), "id", F.repeat(F.lit("payload "), 20).alias("text"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    for n in (3, 16):
        got = global_ordinal(df, ["k", "id"], "o", num_partitions=n)
        exp = df.select("id", F.row_number().over(Window.orderBy("k", "id")).alias("e"))
        assert got.select("o").distinct().count() == 20_000
        assert got.join(exp, "id").filter("o <> e").count() == 0
        # the same with the payload read and not read
        assert got.select("id", "o").exceptAll(global_ordinal(df, ["k", "id"], "o", num_partitions=n).drop("text", "k", "digest")).count() == 0
    grouped = group_ordinal(df, ["k"], ["id"], "o")
    exp = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy("id")).alias("e"))
    assert grouped.join(exp, "id").filter("o <> e").count() == 0


def test_nth(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in (5, 3, 9)], "k int, name string")
    assert [r["k"] for n in (1, 2, 3, -1, -3) for r in nth(df, ["k"], n).collect()] == [3, 5, 9, 9, 3]
    assert nth(df, ["k"], 4).count() == nth(df, ["k"], -4).count() == 0


HOT = 30_000


def _hot(spark):
    """A third of the rows on one key, the others on keys of their own."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    return spark.range(HOT).select(key.alias("hash"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 512).alias("pad"))


def _splits(df):
    """Whether the final plan of an executed DataFrame splits a skewed partition."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return "skew=true" in out.getvalue().lower().replace(" ", "") or "isSkewJoin=true" in out.getvalue()


def cases(spark):
    rows = _hot(spark)
    cache = spark.createDataFrame([("k1", "file-1")], "hash string, file_id string")
    registry = spark.range(HOT // 3).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"),
                                            F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"),
                                            F.timestamp_seconds("id").alias("created_at"), F.col("id").alias("position"))
    lookups = rows.select(F.col("hash").alias("lookup"), "pad")
    events = rows.select(F.col("hash").alias("call_id"), F.col("pos").alias("ord"),
                         F.when(F.col("pos") % 5 == 0, "done").otherwise("delta").alias("phase"), F.col("pad").alias("snapshot"))
    turns = rows.select(F.col("hash").alias("conv_id"), "pos", F.lit("user").alias("role"),
                        F.when(F.col("pos") > 29_000, "exit").otherwise(F.col("pad")).alias("text"))
    threads = rows.select(F.col("hash").alias("assistant_name"), F.col("pad").alias("assistant_id"))
    return {
        "batch_duplicates": lambda: C.batch_duplicates(rows),
        "assign_file_ids": lambda: C.assign_file_ids(rows, cache),
        "restore_or_create": lambda: C.restore_or_create(rows, cache, "hash", "pos", {"file_id": F.col("pad")}),
        "kept_events": lambda: TC.kept_events(events),
        "truncate_at_exit": lambda: M.truncate_at_exit(turns),
        "lookup_by_name": lambda: RG.lookup_by_name(lookups, registry),
        "lookup_by_id": lambda: RG.lookup_by_id(lookups, registry),
        "thread_assistant": lambda: RG.thread_assistant(threads, registry),
        "check_choices": lambda: RG.check_choices(lookups.withColumnRenamed("lookup", "input"),
                                                  registry.select(F.col("id").alias("choice"))),
        "group_ordinal": lambda: group_ordinal(rows, ["hash"], ["pos"], "o"),
        "summarize": lambda: SM.summarize(spark.range(HOT).select(
            F.lit(1).alias("unit"), F.col("id").alias("part"), F.when(F.col("id") % 3 == 0, "hot hot hot").otherwise(
                F.concat(F.lit("w"), F.col("id").cast("string"))).alias("text")), "unit", "text", "part"),
    }


@pytest.mark.parametrize("name", ["batch_duplicates", "assign_file_ids", "restore_or_create", "kept_events", "truncate_at_exit",
                                  "lookup_by_name", "lookup_by_id", "thread_assistant", "check_choices", "group_ordinal", "summarize"])
def test_a_hot_key_is_split(spark, name):
    with setting(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
                           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.files.maxPartitionBytes": "256k",
                           "spark.sql.files.openCostInBytes": "1k"}):
        assert _splits(cases(spark)[name]()), name


def test_shared_folder_is_needed_off_local(spark, monkeypatch):
    from cairn import session as S

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        S.shared_dir(Session())


def test_a_local_session_without_settings_gets_one_folder(spark, monkeypatch):
    import os
    from cairn import session as S

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf, spark.sparkContext

    monkeypatch.setattr(S, "_SCRATCH", {})
    was = spark.conf.get("spark.checkpoint.dir")
    first = S.shared_dir(Session())
    assert os.path.isdir(first) and S.shared_dir(Session()) == first != was
    spark.sparkContext.setCheckpointDir(was)


def test_a_run_drops_its_intermediate_tables(spark):
    import os
    from cairn import session as S

    with S.run_folder(spark) as path:
        df = S.written(spark.range(5), "things")
        assert df.count() == 5 and os.listdir(path) == ["things"]
        with S.run_folder(spark) as inner:
            S.written(spark.range(5), "things")
            assert os.path.isdir(inner)
        assert not os.path.exists(inner) and os.path.isdir(path)
    assert not os.path.exists(path) and S.fresh_path(spark, "x").startswith(S.shared_dir(spark))


def test_cache_errors_are_not_an_empty_cache(spark, tmp_path):
    from cairn.streaming import pipelines as PL

    assert PL.read_hash_cache(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "batch_id=0").mkdir()
    (tmp_path / "batch_id=0" / "part-0.parquet").write_bytes(b"not a parquet file")
    with pytest.raises(Exception):
        PL.read_hash_cache(spark, str(tmp_path)).collect()


def test_index_key_sees_a_changed_inner_file(spark, sf_small, tmp_path):
    import shutil
    from cairn.plans import retrieval as PR

    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    shutil.copyfile(f"{sf_small}/documents.parquet", folder / "part-0.parquet")
    first = PR._index(spark, str(tmp_path)).n_docs
    assert PR._index(spark, str(tmp_path)).n_docs == first
    shutil.copyfile(f"{sf_small}/documents.parquet", folder / "part-1.parquet")
    assert PR._index(spark, str(tmp_path)).n_docs >= first
    changed = spark.read.parquet(str(folder)).limit(1).select("doc_id", "text")
    changed.toPandas().to_parquet(folder / "part-1.parquet")
    assert PR._index(spark, str(tmp_path)).n_docs > 0


def test_message_cap_is_the_production_one(spark):
    from cairn.plans import conversation as PC

    assert PC.MESSAGE_LIMIT == 256_000
    rows = [("s", "a.py", "x" * 255_000), ("s", "b.py", "x" * 256_000), ("s", "c.py", "y")]
    got = M.build_messages(spark.createDataFrame(rows, "store string, path string, content string")).collect()
    assert sorted(r["path"] for r in got if r["path"]) == ["a.py", "c.py"]


def test_no_array_loses_nested_times(spark):
    df = spark.sql("SELECT 1 AS id, timestamp'2024-01-02 03:04:05.5' AS t, named_struct('u', array(timestamp'2024-01-02 03:04:05')) AS s")
    row = RG.convert_times(df, RG.iso_time).first()
    assert row["t"] == "2024-01-02T03:04:05.500000" and row["s"]["u"] == ["2024-01-02T03:04:05"]
    assert RG.export_json(df).first()["json"] == '{"id":1,"t":"2024-01-02T03:04:05.500000","s":{"u":["2024-01-02T03:04:05"]}}'


def test_a_page_behind_comments_is_html(spark):
    from cairn.operators import route as R

    pages = spark.createDataFrame([(1, "http://a/", "  <!-- " + "c" * 500 + " -->\n <HTML>x", "text/html"),
                                   (2, "http://b/", "<p>", "image/png")], "page_id bigint, url string, html string, content_type string")
    assert [r["extension"] for r in R.ingest_pages(pages.drop("content_type")).orderBy("page_id").collect()] == [".html", ".txt"]
    assert [r["page_id"] for r in R.ingest_pages(pages).collect()] == [1]
    assert [r["page_id"] for r in R.rejected_pages(pages).collect()] == [2]
