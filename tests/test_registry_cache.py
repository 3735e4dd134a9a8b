"""Registry resolution golden rows and ingest-cache invariants."""

from pyspark.sql import functions as F

from cairn.operators import cache as C
from cairn.operators import registry as RG
from cairn.functions.hashing import sha256_hex

REG = [("asst_1", "Alpha", "x", 10, 0), ("asst_5", "Beta", "y", 20, 1), ("asst_9", "Gamma", "z", 30, 2),
       ("asst_7", "dup", "u", 40, 3), ("asst_8", "DUP", "v", 50, 4)]


def registry(spark):
    return spark.createDataFrame(REG, "id string, name string, instructions string, created_at bigint, position bigint")


def test_resolve_identifier_golden(spark):
    idents = ["asst_5", "asst_x", "gamma", "3", " 2 ", "0", "-1", "99", "dup", "thread_1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(idents)], "k int, identifier string")
    out = {r["identifier"]: (r["resolved_id"], r["idx"]) for r in RG.resolve_identifier(df, registry(spark)).collect()}
    assert out["asst_5"] == ("asst_5", 1)
    assert out["asst_x"] == (None, -1)            # prefixed miss does not fall through to name
    assert out["gamma"] == ("asst_9", 2)          # name, case-insensitive
    assert out["3"] == ("asst_9", 2)              # 1-based menu number
    assert out[" 2 "] == ("asst_5", 1)
    assert out["0"] == (None, -1) and out["-1"] == (None, -1) and out["99"] == (None, -1)
    assert out["dup"] == (None, -1)               # ambiguous name resolves to nothing
    assert out["thread_1"] == (None, -1)


def test_menu_and_orders(spark):
    menu = RG.menu(registry(spark)).orderBy("ordinal").collect()
    assert [r["line"] for r in menu] == ["1) Alpha", "2) Beta", "3) Gamma", "4) dup", "5) DUP"]
    desc = RG.custom_order(registry(spark), "name", descending=True).orderBy("ordinal").collect()
    assert [r["name"] for r in desc] == ["dup", "Gamma", "DUP", "Beta", "Alpha"]


def test_sync_defaults_idempotent(spark):
    reg = registry(spark)
    defaults = spark.createDataFrame([("Beta", "new", 1), ("Delta", "d", 2)], "name string, instructions string, seq int")
    once = RG.sync_defaults(reg, defaults, 99)
    rows = {r["name"]: r for r in once.collect()}
    assert rows["Beta"]["action"] == "replaced" and rows["Beta"]["created_at"] == 20 and rows["Beta"]["position"] == 1
    assert rows["Delta"]["action"] == "appended" and rows["Delta"]["position"] == 6
    twice = RG.sync_defaults(once.drop("action"), defaults, 99)
    assert {r["action"] for r in twice.collect()} == {"kept"}


def test_append_unique(spark):
    cands = spark.createDataFrame([("t1", "beta", 1), ("t2", "", 2), ("t3", "new", 3), ("t4", "NEW", 4)],
                                  "id string, name string, pos int")
    out = RG.append_unique(registry(spark), cands, "pos").collect()
    assert [(r["id"], r["position"]) for r in out] == [("t3", 5)]


def _batch(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos int, content string")
    return df.withColumn("hash", sha256_hex("content"))


def test_assign_ids_invariants(spark):
    batch = _batch(spark, ["a", "b", "a", "c", "b", "a"])
    empty = spark.createDataFrame([], "hash string, file_id string")
    first = C.assign_file_ids(batch, empty).orderBy("pos").collect()
    assert [r["cached"] for r in first] == [False, False, True, False, True, True]   # later duplicates are hits
    assert len({r["file_id"] for r in first}) == 3
    cache = C.update_hash_cache(empty, C.assign_file_ids(batch, empty))
    assert cache.count() == 3
    again = C.assign_file_ids(batch, cache)
    assert again.filter(~F.col("cached")).count() == 0                                # re-ingest: no new ids
    assert C.update_hash_cache(cache, again).count() == 3                              # merge is idempotent


def test_restore_first_seen(spark):
    batch = spark.createDataFrame([(1, "/a/x.py", "s", "same"), (2, "/b/y.py", "s", "same")],
                                  "pos int, path string, source string, content string").withColumn(
        "hash", sha256_hex("content"))
    stored = spark.createDataFrame([], "hash string, name string, full_path string, sz_bytes bigint, "
                                       "vector_store_id string, file_id string")
    out = C.restore_or_create_files(batch, stored).orderBy("pos").collect()
    assert [r["full_path"] for r in out] == ["/a/x.py", "/a/x.py"]   # first-seen path wins
    assert [r["restored"] for r in out] == [False, True]


def test_sync_defaults_name_case_and_ambiguity(spark):
    reg = registry(spark)
    defaults = spark.createDataFrame([("alpha", "x", 1), ("Dup", "d", 2)], "name string, instructions string, seq int")
    rows = RG.sync_defaults(reg, defaults, 99).collect()
    by_action = {}
    for r in rows:
        by_action.setdefault(r["action"], []).append(r["name"])
    assert by_action["replaced"] == ["alpha"]          # same instructions, name differs in case -> not equal
    assert "appended" not in by_action                 # 'Dup' is ambiguous -> the default is skipped


def test_clean_cache_golden(spark):
    df = spark.createDataFrame([(1, '{"a":"x","b":1,"c":null,"d":{"e":"f"}}')], "k int, json string")
    assert [(r["key"], r["value"]) for r in RG.clean_cache(df).collect()] == [("a", "x")]


def test_store_refs_golden(spark):
    from cairn.operators import route as R
    rows = [("ok", ["vs_1"]), ("none", []), ("two", ["a", "b"]), ("prefix", ["x"]), ("empty", [""])]
    df = spark.createDataFrame(rows, "input string, vector_store_ids array<string>")
    got = {r["input"]: (r["store_ok"], r["store_error"]) for r in R.check_store_refs(df).collect()}
    assert got["ok"] == (True, None)
    assert got["none"][0] is False and got["two"][0] is False
    assert got["prefix"] == (False, "invalid format") and got["empty"] == (False, "empty")


def test_build_messages_header_and_limit(spark):
    from cairn.operators import messages as M
    files = spark.createDataFrame([("s", "/a.py", "x" * 10), ("s", "/b.py", "y" * 100), ("s", "/c.py", "é")],
                                  "store string, path string, content string")
    out = M.build_messages(files, limit=60).orderBy("seq").collect()
    assert out[0]["seq"] == 0 and "The following 3 messages" in out[0]["message"]   # count before the cap
    assert [(r["seq"], r["path"]) for r in out[1:]] == [(1, "/a.py"), (2, "/c.py")]  # /b.py exceeds 60 chars
    assert out[2]["payload_chars"] == len('{"path": "/c.py", "content": "\\u00e9"}')


def test_route_precedence(spark):
    from cairn.operators import route as R
    listing = spark.createDataFrame([("/c/src/a.py",), ("/c/src/exit",)], "path string")
    inputs = ["exit", "/c/src/a.py", "/c/src", "/c", "https://youtu.be/dQw4w9WgXcQ", "https://example.com/x",
              "nothing here", "/c/src/exit"]
    df = spark.createDataFrame([(x,) for x in inputs], "input string")
    got = {r["input"]: r["kind"] for r in R.route_inputs(df, listing).collect()}
    assert got == {"exit": "exit", "/c/src/a.py": "file", "/c/src": "directory", "/c": "directory",
                   "https://youtu.be/dQw4w9WgXcQ": "video", "https://example.com/x": "web",
                   "nothing here": "unsupported", "/c/src/exit": "file"}


def test_settings_defaults_and_changed(spark):
    docs = spark.createDataFrame([
        (1, '{"api_key":"k","model":"m","compression":false,"data_mode":"json","code_style":"s",'
            '"assistants":[],"threads":[]}'),
        (2, '{"api_key":"k","assistant_id":"old","threads":[]}')], "k int, json string")
    rows = {r["k"]: r for r in RG.normalize_settings(docs).collect()}
    assert (rows[1]["model"], rows[1]["compression"], rows[1]["changed"]) == ("m", False, False)
    r = rows[2]
    assert (r["model"], r["compression"], r["data_mode"], r["code_style"]) == ("gpt-3.5-turbo", True, "binary", "monokai")
    assert r["changed"] is True and "assistant_id" not in r.asDict()


def test_export_time_formats(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.123456",), ("2024-01-02 03:04:05",)], "t string") \
        .select(F.to_timestamp("t").alias("created_at"))
    out = RG.export_times(df).collect()
    assert out[0]["created_at_iso"] == "2024-01-02T03:04:05.123456" and out[1]["created_at_iso"] == "2024-01-02T03:04:05"
    assert out[1]["created_at_int"] == 1704164645 and abs(out[0]["created_at_ts"] - 1704164645.123456) < 1e-6


def test_transcript_without_entries_and_text_blocks(spark):
    from cairn.operators import messages as M
    from cairn.operators import transcripts as TR
    recs = spark.createDataFrame([('{"video_id":"v1","vector_store_id":"","file_id":""}',),
                                  ('{"video_id":"v2","entries":[{"text":"hi","start":3661.5,"duration":1.0}]}',)],
                                 "json string")
    rows = {r["video_id"]: r for r in TR.load_transcripts(recs).collect()}
    assert rows["v1"]["pos"] is None and rows["v1"]["text"] is None          # missing entries -> empty
    assert (rows["v2"]["pos"], rows["v2"]["text"]) == (0, "hi")
    rendered = TR.render_transcripts(TR.load_transcripts(recs).filter("pos IS NOT NULL")).first()
    assert rendered["transcript"] == "1:01:01.500000 hi"
    msgs = M.message_blocks(spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "conv_id long, pos long, text string"))
    assert M.response_text(msgs, "conv_id", "pos").first()["response_text"] == "ab"   # image blocks ignored


def test_exit_cut(spark):
    from cairn.operators import messages as M
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "user", " exit"), (1, 2, "assistant", "exit"),
                                   (1, 3, "user", "EXIT"), (1, 4, "user", "after")],
                                  "conv_id long, pos long, role string, text string")
    assert [r["pos"] for r in M.truncate_at_exit(turns).orderBy("pos").collect()] == [0, 1, 2]


def test_choices_fields_and_names(spark):
    from cairn.operators import route as R
    taken = spark.createDataFrame([("Order 1",), ("chat",)], "name string")
    cands = spark.createDataFrame([("order 1",), ("ORDER 2",), ("CHAT",)], "input string")
    got = {r["input"]: r["valid"] for r in RG.check_choices(cands, taken, "input", "name", blacklist=True,
                                                            case_sensitive=False).collect()}
    assert got == {"order 1": False, "ORDER 2": True, "CHAT": False}
    nums = spark.createDataFrame([(" 2 ",), ("0",), ("6",), ("x",), ("+5",)], "input string")
    got = {r["input"]: r["valid"] for r in RG.check_numeric_choices(nums, registry(spark), "input").collect()}
    assert got == {" 2 ": True, "0": False, "6": False, "x": False, "+5": True}
    recs = spark.createDataFrame([("a", "", "i"), ("b", "n", ""), ("c", "n", "i")], "id string, name string, instructions string")
    assert {r["id"]: r["missing"] for r in RG.missing_fields(recs).collect()} == \
        {"a": ["name"], "b": ["instructions"], "c": []}
    looks = spark.createDataFrame([("ALPHA",), ("Dup",), ("zeta",)], "lookup string")
    got = {r["lookup"]: (r["status"], r["id"]) for r in RG.lookup_by_name(looks, registry(spark)).collect()}
    assert got == {"ALPHA": ("found", "asst_1"), "Dup": ("ambiguous", None), "zeta": ("missing", None)}
    amb = RG.ambiguous_names(registry(spark)).collect()
    assert [(r["lname"], r["n"]) for r in amb] == [("dup", 2)]
    parts = spark.createDataFrame([(["'my", "file.txt'"],), (['"a', 'b"'],)], "parts array<string>")
    assert [r["input"] for r in R.clean_inputs(parts).collect()] == ["myfile.txt", "ab"]
    bodies = spark.createDataFrame([("  <!DOCTYPE html><p>",), ("%PDF-1.7",), ("plain",)], "b string")
    assert [r[0] for r in bodies.select(R.sniff_content_type(F.col("b"))).collect()] == \
        ["text/html; charset=utf-8", "application/pdf", "text/plain"]
