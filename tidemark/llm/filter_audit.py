"""Filter interaction audit (operator 11): what five filters remove in every order, and their Shapley
values by the multilinear extension.

Spark reduces the documents to counts per part and mask of failed filters (32 masks at most). A part's
counts give one polynomial: removed(x) is the number of documents removed if filter i runs with
probability x_i. Its corners are the survivors of every set of filters, and the integral of its partial
derivatives along the diagonal gives the Shapley values.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: The filters, in the order of the bits of a mask.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_ALL = 1 << len(FILTERS)
_KIND = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
_SPACE = r"[\\x20\\x09-\\x0D]"
#: Whether a whole text fails A to D; each projection uses the columns of the one before.
_MEASURES = [
    {"words": f"array_remove(split(text, '{_SPACE}+'), '')", "upper": "char_length(regexp_replace(text, '[^A-Z]+', ''))"},
    {"n_words": "cast(size(words) as bigint)", "n_distinct": "cast(size(array_distinct(words)) as bigint)"},
    {
        "mask": """int(n_words < 100) + 2 * int(100 * n_distinct < 80 * n_words) + 4 * int(100L * upper > 10L * char_length(text))
            + 8 * int(text rlike '[#$%&*|]')"""
    },
]


def polynomial(counts: list[int]) -> list[int]:
    """Coefficients of removed(x), one for each set of filters (a mask), from the counts per mask.

    A document of mask m stays with the chance of prod(1 - x_i for i in m); multiplied out, that is
    (-1)^|S| x^S over the subsets S of m. So the coefficient of S is -(-1)^|S| times all documents
    that fail at least the filters of S."""
    above = list(counts)
    for bit in range(len(FILTERS)):
        for s in range(_ALL):
            if not s >> bit & 1:
                above[s] += above[s | 1 << bit]
    return [0] + [above[s] if s.bit_count() % 2 else -above[s] for s in range(1, _ALL)]


def corners(coefficients: list[int]) -> list[int]:
    """removed(x) where x is 1 for the filters of a set and 0 for others, for each set."""
    out = list(coefficients)
    for bit in range(len(FILTERS)):
        for s in range(_ALL):
            if s >> bit & 1:
                out[s] += out[s ^ 1 << bit]
    return out


def shapley(coefficients: list[int], bit: int) -> Fraction:
    """The integral over t from 0 to 1 of the partial derivative to x_bit at (t, ..., t): x^S gives
    t^(|S| - 1) for every S with the filter, and that 1 / |S|."""
    return sum((Fraction(c, s.bit_count()) for s, c in enumerate(coefficients) if s >> bit & 1), Fraction(0))


def audit_rows(part: str, masks: list[int], n: list[int], good: list[int], toxic: list[int]) -> list[dict]:
    """The 600 rows of one part."""
    dense = [[0] * _ALL for _ in range(3)]
    for column, values in zip(dense, (n, good, toxic)):
        for m, v in zip(masks, values):
            column[m] += v
    coefficients = polynomial(dense[0])
    gone, good_gone, toxic_gone = corners(coefficients), corners(polynomial(dense[1])), corners(polynomial(dense[2]))
    total, last = sum(dense[0]), _ALL - 1
    values = [shapley(coefficients, bit) * len(ORDERS) for bit in range(len(FILTERS))]
    assert all(v.denominator == 1 for v in values)
    out = []
    for order in ORDERS:
        done = 0
        for step, letter in enumerate(order, 1):
            bit = FILTERS.index(letter)
            now = done | 1 << bit
            removed = gone[now] - gone[done]
            out.append({
                "part": part, "filter_order": order, "step": step, "kept": total - gone[now], "removed": removed, "redundant": gone[1 << bit] - removed,
                "unique_fails": gone[last] - gone[last ^ 1 << bit], "good_lost": good_gone[now] - good_gone[done], "toxic_lost": toxic_gone[now] - toxic_gone[done], "shapley": int(values[bit]),
            })
            done = now
    return out


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters.

    Equal texts are found by their SHA-256. Of equal texts only the rows of the smallest id pass filter
    E, so rows are counted per (digest, id), then per digest and whatever else tells them apart, added up
    before they are shuffled: a text that a third of all rows repeat is a few rows by then."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    df = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    for step in _MEASURES:
        df = df.select("*", *(F.expr(e).alias(name) for name, e in step.items()))
    df = df.select("doc_id", "part", "mask", F.unhex(F.sha2("text", 256)).alias("digest"))
    numbered = df.where("doc_id is not null").join(known, "doc_id", "left").na.fill(0, ["good", "toxic"])
    numbered = numbered.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("c"))
    groups = numbered.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("c").alias("n"), F.min(F.struct("doc_id", "c")).alias("first"))
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    groups = groups.join(least, "digest").withColumn("passing", F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0))
    copies = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    counted = groups.select("part", "good", "toxic", F.explode(copies).alias("x")).select("part", "x.mask", "x.n", (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic"))
    nameless = df.where("doc_id is null").select("part", "mask", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"))
    return counted.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic"))).where("n > 0")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters (all 120) and step, with the counts that the contract
    names.

    A null text is the empty one, a null part the part ''; texts of any length are read whole. A row
    with a null id is a copy of nothing and has no labels; rows that repeat an id and text are no copies
    of each other. Of several labels of an id, one that says quality or toxic 1 is enough; null labels say
    nothing. An empty table has no parts, so no rows. Only the three columns are read, so others
    cannot clash."""
    parts = mask_counts(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 masks at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist(audit_rows(part, *([x[c] for x in m] for c in ("mask", "n", "good", "toxic"))), schema=schema)

    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])
    return parts.mapInArrow(run, _KIND)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Removes by brute force over all orders; a Shapley value is the sum of its definition.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
lb AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CAST(len(words) < 100 AS INT) AS fa, CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT) AS fb,
  CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT) AS fc, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS fd, CAST(coalesce(doc_id > first_id, false) AS INT) AS fe
  FROM w LEFT JOIN lb USING (doc_id)),
m AS (SELECT part, map {'A': fa, 'B': fb, 'C': fc, 'D': fd, 'E': fe} AS fails, fa + fb + fc + fd + fe AS n_fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT [a.c, b.c, x.c, y.c, z.c] AS p FROM l a, l b, l x, l y, l z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
s AS (SELECT m.*, p, step, p[step] AS filter, fails[p[step]] = 1 AS hit, list_sum(list_transform(p[1:step - 1], lambda k: fails[k])) AS before FROM m, o, range(1, 6) r(step)),
a AS (SELECT part, array_to_string(p, '') AS filter_order, CAST(step AS INTEGER) AS step, filter, sum(n) FILTER (WHERE NOT hit AND coalesce(before, 0) = 0) AS kept, sum(n) FILTER (WHERE hit AND coalesce(before, 0) = 0) AS removed,
  sum(n) FILTER (WHERE hit AND before > 0) AS redundant, sum(n) FILTER (WHERE hit AND n_fails = 1) AS unique_fails, sum(good) FILTER (WHERE hit AND coalesce(before, 0) = 0) AS good_lost, sum(toxic) FILTER (WHERE hit AND coalesce(before, 0) = 0) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM a
"""
