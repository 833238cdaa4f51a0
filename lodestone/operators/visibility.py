"""Who sees which documents, as bitmaps of document numbers: built once, or-ed for each user, and asked about what a search found.

A document is seen through one of a few holders: the public, a group, an owner, a client. The index has a bitmap for each
holder and 32,768 document numbers, made by partial aggregation, so a holder with a third of all documents is no large task.
A user's documents are those of the holders that the user counts among; no user meets a document to find them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.acl import CLIENT, GROUP, PRIVATE, PUBLIC

EVERY_CLIENT = "clients"


def holder_rows(docs: DataFrame) -> DataFrame:
    """``holder, doc_id``: through whom each of ``docs(doc_id, visibility, owner_id, group_id)`` is seen; clients' documents also as those of all clients."""
    vis = F.col("visibility")
    holder = (
        F.when(vis == PUBLIC, F.array(F.lit("public"))).when(vis == GROUP, F.array(F.concat(F.lit("group:"), F.col("group_id"))))
        .when(vis == PRIVATE, F.array(F.concat(F.lit("owner:"), F.col("owner_id"))))
        .when(vis == CLIENT, F.array(F.lit(EVERY_CLIENT), F.concat(F.lit("client:"), F.col("owner_id"))))
    )
    return docs.select(F.explode(holder).alias("holder"), F.col("doc_id").cast("long").alias("doc_id")).filter("holder IS NOT NULL AND doc_id IS NOT NULL")


def holders(users: DataFrame, memberships: DataFrame, for_list: bool = True) -> DataFrame:
    """``user_id, holder`` for ``users(user_id, kind, role)``: what each user counts among. Administrators see all clients' documents in lists, not in searches."""
    uid, internal = F.col("user_id"), F.col("kind") == "internal"
    client = F.concat(F.lit("client:"), uid)
    own = F.when(internal, F.array(F.lit("public"), F.concat(F.lit("owner:"), uid), *([client] if for_list else []))).otherwise(F.array(client))
    own = users.select(uid, F.explode(own).alias("holder"))
    groups = users.filter(internal).join(memberships, "user_id").select(uid, F.concat(F.lit("group:"), F.col("group_id")).alias("holder"))
    found = own.unionByName(groups.filter("holder IS NOT NULL"))
    if for_list:
        found = found.unionByName(users.filter(internal & (F.col("role") == "admin")).select(uid, F.lit(EVERY_CLIENT).alias("holder")))
    return found.distinct()


class VisibleIndex:
    """``holder, bucket, docs``: a stored bitmap for each holder and bucket of document numbers, sorted by holder."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.bitmaps = path, spark.read.parquet(path)

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> VisibleIndex:
        rows = holder_rows(docs)
        bits = rows.groupBy("holder", F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("docs"))
        bits.repartitionByRange("holder", "bucket").sortWithinPartitions("holder", "bucket").write.parquet(path)
        return cls(docs.sparkSession, path)

    def visible(self, who: DataFrame) -> DataFrame:
        """``user_id, bucket, docs``: the bitmaps of ``who(user_id, holder)`` or-ed for each user."""
        return self.bitmaps.join(who, "holder").groupBy("user_id", "bucket").agg(F.bitmap_or_agg("docs").alias("docs"))

    def counts(self, who: DataFrame) -> DataFrame:
        """``user_id, n_visible``; users who see nothing are left out.

        Holders of several users are or-ed once for each set of them that some user has. What a user alone has is then
        looked at in its own buckets only, so bitmaps are opened for sets and for holders, not for users.
        """
        known = who.join(self.bitmaps.select("holder").distinct(), "holder", "left_semi")  # holders without documents count for nobody
        several = known.groupBy("holder").agg((F.count("*") > 1).alias("several"))
        parts = known.join(several, "holder").groupBy("user_id").agg(
            F.array_sort(F.collect_set(F.when(F.col("several"), F.col("holder")))).alias("together"), F.array_sort(F.collect_set(F.when(~F.col("several"), F.col("holder")))).alias("alone")
        )
        sets = parts.select("together").distinct().select("together", F.explode("together").alias("holder"))
        both = self.bitmaps.join(sets, "holder").groupBy("together", "bucket").agg(F.bitmap_or_agg("docs").alias("docs"))
        shared = both.groupBy("together").agg(F.sum(F.bitmap_count("docs")).alias("n"))
        alone = parts.filter(F.size("alone") > 0).select("user_id", "together", F.explode("alone").alias("holder"))
        own = self.bitmaps.join(alone, "holder").groupBy("user_id", "together", "bucket").agg(F.bitmap_or_agg("docs").alias("own"))
        # a bucket counts for what the own bitmaps add to the common ones
        met = own.join(both.withColumnRenamed("docs", "common"), ["together", "bucket"], "left").select(
            "user_id", "bucket", F.coalesce(F.bitmap_count("common"), F.lit(0)).alias("before"), F.explode(F.array_compact(F.array("own", "common"))).alias("docs")
        )
        united = met.groupBy("user_id", "bucket", "before").agg(F.bitmap_count(F.bitmap_or_agg("docs")).alias("after"))
        more = united.groupBy("user_id").agg(F.sum(F.col("after") - F.col("before")).alias("more"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
        return parts.select("user_id", "together").join(shared, "together", "left").join(more, "user_id", "left").select("user_id", n.alias("n_visible")).filter("n_visible > 0")

    def allowed(self, found: DataFrame, who: DataFrame) -> DataFrame:
        """Those rows of ``found(user_id, doc_id, ...)`` whose document the user sees, by a bit each."""
        at = F.bitmap_bit_position(F.col("doc_id").cast("long"))
        asked = found.withColumns({"_bucket": F.bitmap_bucket_number(F.col("doc_id").cast("long")), "_at": at})
        seen = self.visible(who.join(found.select("user_id").distinct(), "user_id", "left_semi"))
        byte = F.conv(F.hex(F.substring("docs", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        both = asked.join(seen.withColumnRenamed("bucket", "_bucket"), ["user_id", "_bucket"])
        return both.filter(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*found.columns)
