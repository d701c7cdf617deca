"""Proportional stratified interleaving into shards (operator 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, discard, materialize, table

#: Rows that one window orders, about.
WINDOW_ROWS = 50_000


def interleave(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """Put rows into shards that all have the mixture of the whole: law ``rows``, so counts differ by
    at most one, and each source's count per shard differs from its share by no more than the
    rounding of ranks.

    Rows of a source are shuffled by a seeded hash of their id and text and ranked; row r of n has the
    fractional rank (r - 1/2) / n; all rows sorted by it are cut into ``shards`` equal runs. No
    window holds a source or the table: ranks are counted within (source, leading digits of the hash)
    and, for the second sort, within slots of the fractional rank, and only the counts per slot are
    summed over; bins and slots follow the number of rows, and only rows that repeat both id and text
    stay together. Texts of any length count as a whole, other columns are not read. A null source is one of its own, null texts have size 1, null ids sort last in their
    source, repeated rows are separate rows and an empty table gives no rows."""
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[id_col].cast("bigint").cast("string"), F.lit("~")), F.crc32(text).cast("string")).cast("binary"))
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), docs[stratum_col].cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        key.alias("key"),
    )
    rows = keyed = materialize(rows, "keyed")
    count = rows.count()
    digits = next(d for d in range(1, 16) if count <= WINDOW_ROWS * 16**d)
    rank_slots = 16**digits
    rows = rows.withColumn("bin", F.substring("key", 1, digits))
    bins = rows.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("rows"))
    by_stratum = Window.partitionBy("stratum")
    bins = bins.select("stratum", "bin", (F.sum("rows").over(by_stratum.orderBy("bin")) - F.col("rows")).alias("before"), F.sum("rows").over(by_stratum).alias("n"))
    local = F.row_number().over(Window.partitionBy("stratum", "bin").orderBy("key", "doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("r", local).join(bins, ["stratum", "bin"])
    fraction = (F.col("before") + F.col("r") - F.lit(0.5)) / F.col("n")
    ranked = ranked.withColumn("fraction", fraction).withColumn("slot_no", F.floor(F.col("fraction") * rank_slots))
    ranked = materialize(ranked.select("doc_id", "stratum", "size", "text_crc32", "key", "fraction", "slot_no"), "ranked")
    discard(keyed)
    # One row for some 3,000 rows or more of the table.
    slots = ranked.groupBy("slot_no").agg(F.count(F.lit(1)).alias("rows"))
    slots = slots.select("slot_no", (F.sum("rows").over(Window.orderBy("slot_no")) - F.col("rows")).alias("before"), F.sum("rows").over(Window.orderBy("slot_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    place = F.row_number().over(Window.partitionBy("slot_no").orderBy("fraction", "stratum", "key", "doc_id", "text_crc32", "size"))
    out = ranked.withColumn("r", place).join(broadcast_if_small(materialize(slots, "slots")), "slot_no").withColumn("pos", F.col("before") + F.col("r") - 1)
    shard = F.expr(f"pos * {shards} div n")
    first = F.expr(f"(pos * {shards} div n * n + {shards - 1}) div {shards}")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("pos") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


OP4_SQL = f"""
WITH crc AS (SELECT {_crc_table()}::BIGINT[] AS t),
b AS (SELECT doc_id, coalesce('s' || source, '') AS stratum, coalesce(text, '') AS text FROM documents),
h AS (SELECT *, hex(encode(text)) AS x FROM b),
d0 AS (SELECT doc_id, stratum, CAST(length(x) // 2 + 1 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT))),
    lambda a, v: xor(a >> 8, t[xor(a & 255, v) + 1])), 4294967295::BIGINT) AS text_crc32 FROM h, crc),
d AS (SELECT *, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || text_crc32) AS key FROM d0),
r AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, key, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 16 // n AS INTEGER) AS shard, pos - (pos * 16 // n * n + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""
