"""Exact dedup (operator 1): stateful streaming deduplication, in DataFrame operations only.

Rows enter as a stream of fingerprints. A streaming aggregation without a watermark keeps, for every
digest ever seen, its count and the row to keep (identifier and content locator) in RocksDB state
that never expires. Rows that hit a digest of another row are found by their locators and compared
with it byte by byte.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, scratch, table
from tidemark.sources.store import _fs

#: Digests of more than this share of all rows are joined by broadcast: there are at most as many as its inverse.
HOT_SHARE = 0.001
#: Up to so many locators of copies are broadcast to find the texts to compare; more are joined by shuffle.
HITS_BROADCAST = 1_000_000
#: State on the executors' disks, with changes alone in each checkpoint, without the space that RocksDB
#: sets aside ahead in every partition's logs, and with memory bounded for all partitions of an executor.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _keyed(source: DataFrame, apart: DataFrame | None) -> DataFrame:
    """``source`` with norm and its key: the digest, and for texts that have the digest of another (``apart``: digest
    and the text that keeps it) the digest with all bytes behind it."""
    df = source.withColumn("norm", normalized(F.col("text"))).withColumn("digest", digest_of(F.col("norm")))
    if apart is None:
        return df
    other = F.coalesce(F.col("norm") != F.col("stays"), F.lit(False))
    key = F.when(other, F.concat("digest", F.encode("norm", "UTF-8"))).otherwise(F.col("digest"))
    return df.join(apart, "digest", "left").withColumn("digest", key).drop("stays")


def check_with_earlier(source: DataFrame, contents: str, call: str) -> DataFrame:
    """(digest, stays): digests of which the call has a text that differs from another of it or of earlier calls, with
    the text that keeps the digest. The text of every digest that is new is kept below ``contents`` for later
    calls, so a hit in the state is a hit of bytes across calls too."""
    spark = source.sparkSession
    texts = _keyed(source, None).groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    kind = "digest binary, stays string"
    fs, place = _fs(spark, contents)
    known = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(contents) if fs.exists(place) else spark.createDataFrame([], kind)
    fresh = materialize(texts.join(known, "digest", "left"), "fresh")
    stays = F.coalesce("stays", "least")
    fresh.where("stays is null").select("digest", F.col("least").alias("stays")).write.parquet(f"{contents}/{call}")
    apart = materialize(fresh.where((F.col("least") != stays) | (F.col("most") != stays)).select("digest", stays.alias("stays")), "apart")
    discard(fresh)
    return apart


def keep_state(stream: DataFrame) -> DataFrame:
    """The keyed state of a stream of fingerprints: digest -> count and the row that stays, which is
    the longest original, then the smallest doc_id (a null one last), with its locator. Rows that
    repeat the one that stays differ in their locators, so one row is kept and no group is ordered."""
    best = F.max(F.struct(F.col("n"), F.bitwise_not("doc_id").alias("rank"), F.col("locator")))
    return stream.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))


def run_stream(landing: str, schema, spark: SparkSession, files_per_batch: int | None = None, state_dir: str | None = None) -> DataFrame:
    """Feed the fingerprint files below ``landing`` that the state has not seen through it, and return its
    last values. The state lives in RocksDB, with its checkpoint in the shared folder or ``state_dir``;
    each micro-batch writes the digests it changed under its own number, so a repeated batch overwrites
    itself."""
    updates, checkpoint = (f"{state_dir}/updates", f"{state_dir}/state") if state_dir else (scratch(spark, "updates"), scratch(spark, "state"))
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
        state = keep_state(reader.parquet(landing))
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{updates}/batch={n}")
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not query.lastProgress and not state_dir:  # no file at all
        return state_of_nothing(spark, schema)
    found = spark.read.parquet(updates)
    return found.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "batch").alias("s")).select("digest", "s.*")


def state_of_nothing(spark: SparkSession, schema) -> DataFrame:
    return keep_state(spark.createDataFrame([], schema))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None, state_dir: str | None = None, apart: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, keep_file.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null and blank texts are
    all equal to the empty one. Of equal texts the one with the most code points stays, then the one
    with the smallest doc_id, a null id last. Of rows that repeat with the same id and text just one
    is kept. Without rows the result is empty. Only the two columns are read, texts as a whole.

    With ``state_dir`` (a folder all executors share) a later call goes on from this one's state: its
    rows are judged with all rows ever fed, and only its own are read, with one stored text of each digest that they hit.
    Different texts of one digest, in one call or in two, are told apart by their bytes."""
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.input_file_name().alias("file"))
    landing = f"{state_dir}/fingerprints" if state_dir else scratch(spark, "fingerprints")
    number = uuid.uuid4().hex
    call = f"{landing}/{number}"
    if state_dir:
        apart = check_with_earlier(source, f"{state_dir}/contents", number)
    _keyed(source, apart).select(
        "doc_id",
        "digest",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n"),
        F.struct("file", F.lit(call).alias("call"), F.monotonically_increasing_id().alias("place")).alias("locator"),
    ).write.parquet(call)
    prints = spark.read.parquet(call)
    state = materialize(run_stream(landing, prints.schema, spark, files_per_batch, state_dir), "keepers")
    rows = state.agg(F.sum("group_size")).first()[0] or 0
    # At most 1 / HOT_SHARE digests can hold more than that share of the rows each.
    hot = F.broadcast(state.where(F.col("group_size") > HOT_SHARE * rows))
    cold = state.where(F.col("group_size") <= HOT_SHARE * rows)
    members = prints.join(hot, "digest").unionByName(prints.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    members = materialize(members, "members")
    discard(state)
    if apart is None:
        wrong = materialize(colliding(source, members), "colliding")
        if not wrong.isEmpty():
            discard(members)
            return find_copies(docs, id_col, text_col, files_per_batch, None, wrong)
        discard(wrong)
    return _described(members)


def colliding(source: DataFrame, members: DataFrame) -> DataFrame:
    """(digest, stays): digests of which a copy's bytes differ from those of another, with the text that keeps
    the digest; none, as a rule.

    Only rows that hit another row's digest are read for this, found by file and id, and hashed again;
    of each digest the least and the greatest text are compared, first within every task, so of a group
    of copies each task sends two texts at most."""
    place = F.xxhash64("file", F.coalesce("doc_id", F.lit(-1))).alias("place")  # a few rows too many do no harm
    hits = materialize(members.where("group_size > 1").select(F.col("locator.file").alias("file"), "doc_id").select(place).distinct(), "hits")
    small = len(hits.select(F.lit(1)).take(HITS_BROADCAST + 1)) <= HITS_BROADCAST
    placed = source.select("text", place)
    copies = placed.join(F.broadcast(hits) if small else hits, "place", "left_semi").select(normalized(F.col("text")).alias("norm"))
    copies = copies.withColumn("digest", digest_of(F.col("norm")))
    ends = copies.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    return ends.where("least <> most").select("digest", F.col("least").alias("stays"))


def _described(members: DataFrame) -> DataFrame:
    return members.select(
        "doc_id",
        F.bitwise_not("best.rank").alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("locator") == F.col("best.locator")).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
        F.col("best.locator.file").alias("keep_file"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents")).drop("keep_file")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
