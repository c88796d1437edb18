"""Exact dedup in DataFrame functions: group by a 128-bit content hash, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import LOWER_AZ, UPPER_AZ, written

#: Repeated hashes up to which their table is broadcast (about 60 bytes each); more are joined by shuffle.
BROADCAST_HASHES = 500_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Rows group by the 128-bit hash of the text; hashes of
    several rows are grouped again by the whole text, so that different texts of one hash stay apart. Of
    each group the row with the ``keep`` ("smallest" or "largest") id stays.

    Null texts equal empty ones. Null ids rank behind all others and are kept only if the group has no other
    (keep_id is then null). Rows repeated with the id that stays are all kept. Other columns are not read. An
    empty table gives an empty result. Equal rows are reduced before each shuffle, so a group may be of any size.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER_AZ, LOWER_AZ)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"))
    hashed = rows.select("doc_id", F.unhex(F.md5("norm")).alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    several = written(hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "hashes")
    few = several.count() <= BROADCAST_HASHES
    members = rows.select("doc_id", "norm", F.unhex(F.md5("norm")).alias("hash")).join(F.broadcast(several) if few else several, "hash", "left_semi")
    same = members.groupBy("hash", "norm").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(same.select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "groups")
    out = hashed.join(groups.withColumn("_met", F.lit(True)), ["hash", "sha"], "left")
    keep_id = F.when(F.col("_met"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
