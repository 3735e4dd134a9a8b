"""Difference of two listings of a file tree, and stores kept in step with it.

A listing is (path, hash), a path once.  Files are matched by path first: equal hashes
are unchanged (no row), others ``changed``.  Paths of one listing only are matched by
content: the k-th new path of a hash, by name, takes the k-th old path of it and is
``moved``; what is left is ``added`` or ``removed``.  The numbering is the distributed
``group_ordinal``, so a hash that a third of all files share (empty ones) is no hot group,
and (hash, number) is unique on both sides of the join.

Defined cases: a null hash (unreadable file) equals no content, so such a path is
``changed`` where both listings have it, else ``added`` or ``removed``; null paths are left
out; either listing may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashing import content_id
from cairn.functions.ordinal import group_ordinal
from cairn.session import written

FILE_ID_PREFIX = "file-"


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, old_path, old_hash, hash): one row a changed, moved, added or removed file."""
    old = before.filter("path IS NOT NULL").select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
    new = after.filter("path IS NOT NULL").select("path", "hash", F.lit(True).alias("stays"))
    both = written(old.join(new, "path", "full_outer"), "listings")
    changed = (both.filter("was AND stays AND coalesce(old_hash <> hash, true)")
                   .select("path", F.lit("changed").alias("change"), F.col("path").alias("old_path"), "old_hash", "hash"))

    def numbered(rows: DataFrame, hash_: str) -> DataFrame:
        # a path is in one of the two only, so a content named by its path has no match
        rows = rows.select("path", hash_, F.coalesce(hash_, F.concat(F.lit("/"), "path")).alias("content"))
        return group_ordinal(rows, ["content"], ["path"], "place")

    come = written(numbered(both.filter("was IS NULL"), "hash"), "listing_come")
    gone = written(numbered(both.filter("stays IS NULL"), "old_hash").withColumnRenamed("path", "old_path"), "listing_gone")
    arrived = come.join(gone, ["content", "place"], "left").select(
        "path", F.when(F.col("old_path").isNull(), "added").otherwise("moved").alias("change"), "old_path", "old_hash", "hash")
    removed = gone.join(come.select("content", "place"), ["content", "place"], "left_anti").select(
        F.col("old_path").alias("path"), F.lit("removed").alias("change"), "old_path", "old_hash",
        F.lit(None).cast("string").alias("hash"))
    return changed.unionByName(arrived).unionByName(removed)


def apply_changes(members: DataFrame, changes: DataFrame, store_of: Column) -> DataFrame:
    """Store membership (store, path, file_id) after ``changes``; ``store_of`` is the store of a ``path``.

    Removed files leave, moved ones keep their id under the new path (a hit, not a new
    upload), changed ones stay in their stores with an id of the new content, added ones
    join the store of their path.
    """
    changes = written(changes.select("path", "change", "old_path", "hash"), "listing_changes")
    new_id = content_id(FILE_ID_PREFIX, "hash")
    left = changes.filter("old_path IS NOT NULL").select(
        F.col("old_path").alias("_old"), F.col("path").alias("_path"), "change", new_id.alias("_id"))
    kept = (members.join(left, F.col("path") == F.col("_old"), "left").filter("change IS NULL OR change <> 'removed'")
                   .select("store", F.coalesce("_path", "path").alias("path"), "change",
                           F.when(F.col("change") == "changed", F.col("_id")).otherwise(F.col("file_id")).alias("file_id")))
    kept = kept.select(F.when(F.col("change") == "moved", store_of).otherwise(F.col("store")).alias("store"), "path", "file_id")
    added = changes.filter("change = 'added'").select(store_of.alias("store"), "path", new_id.alias("file_id"))
    return kept.unionByName(added)
