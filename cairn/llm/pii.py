"""Personal data: fixed patterns, and the terms around them that give them away.

Base spans are the matches of four patterns.  Beyond them, information-theoretic
sanitisation (Sanchez and Batet, "C-sanitized"): a protected entity is the
normalised value of a base span; a term discloses it by their pointwise mutual
information over the corpus, PMI = log2(N c(t, e) / (c(t) c(e))), against the
entity's own information, IC = log2(N / c(e)).  c(t) counts the documents with the term,
c(e) those with the entity, c(t, e) those with the term within ``CONTEXT`` words of the
entity (words of other entities aren't counted).  A term with PMI of at least ``THRESHOLD`` times IC, seen in at least
``CONTEXTS`` documents with different contexts of the entity (copies are one context), is
protected in every document that holds the entity: generalised to its shape, or removed from
``REMOVE`` times IC on.  Documents without base spans are left alone.

Everything is DataFrame functions.  Counts are partial sums before the shuffle: an
entity or term that a third of the rows hold is one row of each task.  c(t) is
counted over whole texts of all documents under the term's 64-bit hash; a collision
would only raise c(t) and so protect less.

Patterns are written so that they can't backtrack: runs are possessive and start
at the run's first character (or where the last match ended), which gives the
same leftmost matches.  Positions are sums of the lengths of what ``split`` leaves
between matches, in code points.

Defined cases: a null text is empty and has no spans; repeated rows each give a row
with equal spans; null doc_ids are documents like others; an empty table gives an
empty result; only doc_id and text are read, so other columns can't clash.  A text's spans
may be any number: the work grows with the text and its spans, not with their product.

Limits: an entity with contexts of one kind only (most that stand in a single document) has too
little evidence to call a term disclosing; and disclosing terms are protected in documents that hold
their entity, not in others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize

# The patterns of each kind, in order.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{N}]+"
MARK = "\uE000"  # stands for spans while terms are counted; blank in a text

CONTEXT = 8
CONTEXTS = 2
THRESHOLD = 0.9
REMOVE = 0.99
RUN = 64  # matches whose lengths are added up at a time
CHUNK = 256  # code points of a piece that parts of a text are cut from


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, (F.length(digits) - i).cast("int"), F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def normal(kind: str, value: Column) -> Column:
    return F.lower(value) if kind in ("email", "ip") else F.regexp_replace(value, "[^0-9]", "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once.

    The optimizer puts a column that an expression names once into it, also into a lambda, where it
    would be worked out for every element.  So lambdas here name lambda variables only."""
    return F.transform(F.array(value), body)[0]


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def before_each(values: Column, fold, first: int = 0) -> Column:
    """For each entry of an array of ints, what ``fold`` makes of ``first`` and all entries before it.

    Entries are folded ``RUN`` at a time, so the work grows with their number."""
    def folded(part: Column) -> Column:
        return F.aggregate(part, F.lit(first), fold)

    def offsets(own: Column) -> Column:
        n_runs = F.ceil(F.size(own) / RUN).cast("int")
        runs = F.when(n_runs > 0, F.transform(F.sequence(F.lit(0), n_runs - 1), lambda r: folded(F.slice(own, r * RUN + 1, F.lit(RUN))))
                      ).otherwise(F.array().cast("array<int>"))
        return F.aggregate(runs, F.array(F.lit(first)), lambda acc, x: F.concat(acc, F.array(fold(F.element_at(acc, -1), x))))

    def before(own: Column, off: Column) -> Column:
        def at(x: Column, k: Column) -> Column:
            run = F.floor(k / RUN).cast("int")
            return fold(F.get(off, run), folded(F.slice(own, run * RUN + 1, k - run * RUN)))
        return F.transform(own, at)

    return let(values, lambda own: let(offsets(own), lambda off: before(own, off)))


def with_matches(df: DataFrame, name: str, pattern: Column, tried: Column) -> DataFrame:
    """``df`` with ``name``: (start, end, value) of all matches of the pattern in text."""
    values, pieces, steps = (f"{name}{x}" for x in ("", "_pieces", "_steps"))
    none = F.array().cast("array<string>")
    ends = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"))
    return (df.withColumn(values, F.when(tried, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none))
            .withColumn(pieces, F.when(F.size(values) > 0, F.slice(F.split("text", pattern, -1), F.lit(1), F.size(values))).otherwise(none))
            # what lies before a match, and the match
            .withColumn(steps, F.zip_with(values, pieces, lambda v, p: F.struct((F.length(p) + F.length(v)).alias("n"), v.alias("value"))))
            .withColumn(values, F.when(F.size(steps) > 0, let(F.col(steps), lambda own: F.zip_with(
                own, before_each(F.transform(own, lambda x: x["n"]), _sum),
                lambda x, at: F.struct((at + x["n"] - F.length(x["value"])).alias("start"), (at + x["n"]).alias("end"), x["value"].alias("value")))))
                .otherwise(F.array_remove(F.array(ends), ends)))
            .drop(pieces, steps))


def chunked(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points, from which ``cut`` takes parts without walking the whole text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from start up to end."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((end - 1) / CHUNK).cast("int")
    part = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substr(part, start - first * CHUNK + 1, end - start)).otherwise("")


def cut_around(chunks: Column, rows: Column, length: Column, put) -> Column:
    """The text with each of ``rows`` (start, end, covered: where the spans before it end) replaced by what ``put`` makes
    of the row and its words; a row that overlaps the ones before gives nothing."""
    def replaced(ch: Column):
        return lambda s: F.when(s["start"] < s["covered"], F.lit("")).otherwise(
            F.concat(cut(ch, s["covered"], s["start"]), put(s, cut(ch, s["start"], s["end"]))))

    def whole(h: Column) -> Column:
        last = F.try_element_at(h["rows"], F.lit(-1))
        return F.concat(F.array_join(F.transform(h["rows"], replaced(h["chunks"])), ""),
                        cut(h["chunks"], F.greatest(last["covered"], last["end"]), length))

    return let(F.struct(chunks.alias("chunks"), rows.alias("rows")), whole)


def with_covered(rows: Column, *fields: str) -> Column:
    """Sorted spans (start, end, ...) with ``covered``: where the spans before each one end, and ``fresh``: 1 if it begins behind that."""
    def row(s: Column, c: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), *[s[f].alias(f) for f in fields],
            c.alias("covered"), (s["start"] >= c).cast("int").alias("fresh"))

    return let(rows, lambda own: F.zip_with(own, before_each(F.transform(own, lambda s: s["end"]), _larger), row))


def with_contexts(df: DataFrame) -> DataFrame:
    """``df`` with ``entities``: (entity, terms) of each of its ``found`` spans (start, end, entity), the
    terms being the distinct ones among the last ``CONTEXT`` before and the first after it in
    the text.  Words of spans are no terms; spans that overlap are one place."""
    some = F.size("found") > 0
    masked = cut_around(chunked(F.translate("text", MARK, " ")), F.col("rows"), F.length("text"), lambda s, value: F.lit(f" {MARK} "))
    tokens = F.regexp_extract_all(F.lower(masked), F.lit(f"{MARK}|{TERM}"), F.lit(0))

    def around(h: Column) -> Column:
        def entity(s: Column, earlier: Column) -> Column:
            place = earlier + s["fresh"] - 1
            before = F.get(h["marks"], place) - place  # terms before the place
            first = F.greatest(F.lit(0), before - CONTEXT)
            return F.struct(s["entity"].alias("entity"), F.array_distinct(F.concat(
                F.slice(h["words"], first + 1, before - first), F.slice(h["words"], before + 1, F.lit(CONTEXT)))).alias("terms"))
        return F.zip_with(h["rows"], h["places"], entity)

    def parts(tokens: Column) -> Column:
        marks = F.filter(F.transform(tokens, lambda t, i: F.when(t == MARK, i)), lambda i: i.isNotNull())
        return F.struct(marks.alias("marks"), F.filter(tokens, lambda t: t != MARK).alias("words"), F.col("rows"),
                        before_each(F.transform("rows", lambda s: s["fresh"]), _sum).alias("places"))

    return (df.withColumn("rows", with_covered(F.array_sort("found"), "entity"))
            .withColumn("entities", F.when(some, let(let(tokens, parts), around)).otherwise(
                F.array().cast("array<struct<entity:string,terms:array<string>>>"))))


def written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, a count for each kind, ``base`` (kind:start:end of all
    spans) and ``entities`` (entity, and the terms of its context)."""
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern in PATTERNS.items():
        tried = F.contains("text", F.lit("@")) if kind == "email" else F.col("text").rlike(HINTS[kind])
        df = with_matches(df, kind, F.lit(pattern), tried)
        df = df.withColumn(kind, F.filter(kind, _passing(kind)))
    df = with_contexts(df.withColumn("found", F.concat(*[F.transform(kind, _entity(kind)) for kind in PATTERNS])))
    return (df.withColumn("base", F.concat(*[written(kind, F.col(kind)) for kind in PATTERNS]))
            .select("doc_id", F.xxhash64("text").alias("digest"), *[F.size(k).cast("bigint").alias(f"n_{k}") for k in PATTERNS],
                    F.array_join("base", ",").alias("base"), "entities"))


def _passing(kind: str):
    return lambda s: passes(kind, s["value"])


def _entity(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                              F.concat(F.lit(f"{kind}:"), normal(kind, s["value"])).alias("entity"))


def disclosing_terms(docs: DataFrame, spans: DataFrame, threshold: float = THRESHOLD, contexts: int = CONTEXTS) -> DataFrame:
    """(entity, term, disclosure): the terms that give an entity away, and PMI / IC."""
    found = spans.select("doc_id", "digest", F.explode("entities").alias("e")).select("doc_id", "digest", "e.entity", "e.terms")
    entities = found.select("doc_id", "digest", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("c_e"))
    # one context a document, then documents of each context: a hot entity's copies are few rows of each task
    pairs = (found.withColumn("context", F.xxhash64("terms")).withColumn("term", F.explode("terms"))
             .groupBy("entity", "term", "doc_id", "digest").agg(F.min("context").alias("context"))
             .groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("docs"))
             .groupBy("entity", "term").agg(F.sum("docs").alias("c_te"), F.count(F.lit(1)).alias("contexts"))
             .filter(F.col("contexts") >= contexts))
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))))
    terms = docs.select(words.alias("term")).groupBy(F.xxhash64("term").alias("key")).agg(F.count(F.lit(1)).alias("c_t"))
    n = spans.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    pmi = F.log2(F.lit(float(max(1, n))) * F.col("c_te") / (F.col("c_t") * F.col("c_e")))
    ic = F.log2(F.lit(float(max(1, n))) / F.col("c_e"))
    return (pairs.join(entities, "entity").withColumn("key", F.xxhash64("term")).join(terms, "key")
            .withColumn("disclosure", F.when(ic > 0, F.least(F.lit(1.0), pmi / ic)))
            .filter(F.col("disclosure") >= threshold).select("entity", "term", "disclosure"))


def term_spans(docs: DataFrame, spans: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(doc_id, digest, terms): where the disclosing terms stand in the documents that hold
    their entity, with the strongest disclosure of each."""
    flagged = (spans.select("doc_id", "digest", F.explode("entities.entity").alias("entity")).distinct()
               .join(disclosing, "entity").groupBy("doc_id", "digest", "term").agg(F.max("disclosure").alias("disclosure"))
               .groupBy(F.col("doc_id").alias("of"), F.col("digest").alias("of_digest"))
               .agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms")))
    flagged = materialize(flagged, "pii_flagged")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort(F.map_keys("terms")), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a written table: broadcast only if its size allows
    texts = texts.withColumn("digest", F.xxhash64("text")).join(
        flagged, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")))
    matched = with_matches(texts.withColumn("pattern", pattern), "term", F.col("pattern"), F.lit(True))
    strength = F.transform("term", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.col("terms")[F.lower(s["value"])].alias("disclosure")))
    return matched.select("doc_id", "digest", strength.alias("terms")).dropDuplicates(["doc_id", "digest"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and the term spans of
    every row of ``docs`` (doc_id, text)."""
    spans = materialize(base_spans(docs), "pii_spans")
    terms = term_spans(docs, spans, materialize(disclosing_terms(docs, spans), "pii_terms"))
    terms = materialize(terms.withColumnsRenamed({"doc_id": "of", "digest": "of_digest"}), "pii_term_spans")
    all_spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")),
                            F.when(F.size("terms") > 0, F.array_join(written("term", F.col("terms")), ",")))
    return (spans.join(terms, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
            .select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
                    all_spans.alias("spans"), "digest", "terms"))


def sanitize(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row with its spans replaced: base spans by their kind, terms
    by their shape, or by nothing where they disclose as much as the entity itself."""
    found = find_personal_data(docs).select(F.col("doc_id").alias("of"), F.col("digest").alias("of_digest"), "spans", "terms")
    found = materialize(found.filter("spans <> ''").dropDuplicates(["of", "of_digest"]), "pii_found")
    parts = F.split("span", ":")
    spans = (found.withColumn("span", F.explode(F.split("spans", ","))).select(
        "of", "of_digest", parts[1].cast("int").alias("start"), parts[2].cast("int").alias("end"), parts[0].alias("kind"), "terms")
        .withColumn("disclosure", F.when(F.col("kind") == "term", F.filter("terms", lambda t: t["start"] == F.col("start"))[0]["disclosure"]))
        .groupBy("of", "of_digest").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "disclosure"))).alias("cuts")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.withColumn("digest", F.xxhash64("text")).join(
        spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")

    def mark(s: Column, value: Column) -> Column:
        shape = F.when(value.rlike(r"^\p{N}+$"), "<NUMBER>").when(value.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
        return F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(
            s["disclosure"] >= REMOVE, "").otherwise(shape)

    done = cut_around(chunked(F.col("text")), with_covered(F.col("cuts"), "kind", "disclosure"), F.length("text"), mark)
    return joined.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(done).alias("text"))
