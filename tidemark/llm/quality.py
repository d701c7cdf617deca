"""Quality rules with risk-controlled thresholds (operator 3), in DataFrame operations only.

Fixed base rules come first. Further rules compare a score of the text with a cutoff; each stratum's
cutoffs are chosen on labelled documents so that, with the stated confidence over all strata and
rules together, no more than the stated share of good documents is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, materialize, table

#: Scores, each larger for worse texts, and the strictest cutoff that each may get: shares that prose stays below
#: (of characters that are symbols or capitals, of words of one character, of lines and words that repeat).
SCORES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 0.1),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.3),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.3),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.1),
    "singles": ("n_singles / greatest(n_words, 1)", 0.1),
}
#: Steps from cutoffs of 1 to the strictest, the same for all strata and fixed before any label is seen.
STEPS = 50
CUTOFFS = {rule: [round(1 - (1 - strictest) * k / (STEPS - 1), 4) for k in range(STEPS)] for rule, (_, strictest) in SCORES.items()}
#: Share of good documents of a stratum that all rules together may reject, and the chance that any bound fails.
RISK, DELTA = 0.04, 0.05
#: A rejected good document weighs as much as so many rejected bad ones.
COST = 10

_SPACE = r"[\\x20\\x09-\\x0D]"
_MEASURES = [
    # every projection uses columns of the one before, so that long arrays are made once
    {"words": rf"array_remove(split(text, '{_SPACE}+'), '')", "lines": rf"filter(split(text, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"},
    {
        "n_words": "cast(size(words) as bigint)",
        "word_chars": rf"cast(char_length(regexp_replace(text, '{_SPACE}+', '')) as bigint)",
        "n_symbols": "cast(char_length(regexp_replace(text, '[^#*$%&|<>]+', '')) as bigint)",
        "n_capitals": r"cast(char_length(regexp_replace(text, '[^\\p{Lu}]+', '')) as bigint)",
        "n_singles": "cast(size(filter(words, w -> char_length(w) = 1)) as bigint)",
        "n_lines": "cast(size(lines) as bigint)",
        "n_dup_lines": "cast(size(lines) - size(array_distinct(lines)) as bigint)",
        "windows": "if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))",
    },
    {
        # places of windows found twice or more: equal neighbours once (hash, place) are sorted, where
        # equal hashes are told apart by their words
        "places": """if(size(array_distinct(windows)) = size(windows), cast(array() as array<int>),
            array_sort(flatten(transform(array(sort_array(transform(windows, (h, i) -> struct(h as h, i as i)))), s ->
              transform(filter(s, (x, k) -> (k > 0 and s[k - 1].h = x.h and slice(words, s[k - 1].i + 1, 3) = slice(words, x.i + 1, 3))
                or (k + 1 < size(s) and s[k + 1].h = x.h and slice(words, s[k + 1].i + 1, 3) = slice(words, x.i + 1, 3))), x -> x.i)))))""",
    },
    {
        # words covered by those windows, each once
        "n_repeat_words": "cast(aggregate(places, struct(0 as n, -9 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n) as bigint)",
    },
]
#: The base rules.
BASE = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, digest and the counts of every whole text."""
    df = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[stratum_col].cast("string"), F.lit("")).alias("stratum"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    for step in _MEASURES:
        df = df.select("*", *(F.expr(e).alias(name) for name, e in step.items()))
    return df.select("doc_id", "stratum", F.unhex(F.sha2("text", 256)).alias("digest"), *METRICS, "n_lines", "n_capitals", "n_singles")


def binomial_cdf(k: str, n: str, p: float) -> str:
    """SQL for P(Binomial(n, p) <= k), summed term by term in logarithms; 1 from the mean on."""
    odds = p / (1 - p)
    return f"""if({k} >= {n} * {p}D, 1D, exp(aggregate(if({k} < 1, cast(array() as array<bigint>), sequence(1L, {k})),
        struct({n} * ln(1 - {p}D) as term, {n} * ln(1 - {p}D) as total),
        (a, i) -> struct(a.term + ln(({n} - i + 1) / i * {odds}D) as term,
          greatest(a.total, a.term + ln(({n} - i + 1) / i * {odds}D)) + ln(1 + exp(-abs(a.total - a.term - ln(({n} - i + 1) / i * {odds}D)))) as total),
        a -> a.total)))"""


def _step(first: str = "size(filter(array({cutoffs}), c -> c > {score}))") -> str:
    """SQL for the first step at which a row would be rejected by any rule; STEPS if at none."""
    return "least(" + ", ".join(first.format(cutoffs=", ".join(f"{c}D" if "filter(array" in first else repr(c) for c in CUTOFFS[r]), score=e) for r, (e, _) in SCORES.items()) + ")"


def certified_cutoffs(measures: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = RISK, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """(stratum, rule, cutoff): the certified cutoffs that are worth it; none where evidence is short.

    Of every stratum one sequence, fixed before any label is seen, is tested: all rules tighten together in STEPS
    steps, each from a cutoff of 1 to its strictest. A step is certified if, were a share ``risk`` of the good
    documents that pass the base rules rejected by all its rules together, so few of the labelled ones would be with a
    probability of at most ``delta`` / strata: the exact one-sided binomial bound. The sequence ends at its first
    failure, so only strata need a correction (Bonferroni's), and all rules share the whole risk; with four
    strata 107 good labels are enough. A label counts once, however often its id is there, and so do copies of one text in a
    stratum, of whose labels the worst counts: repeated rows are no more evidence. Of the certified steps the one that rejects the most bad documents
    less ``cost`` times the good ones is taken, the most lenient of equals, if that is above 0."""
    known = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("good")).where("good is not null and doc_id is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    scored = measures.where(~F.expr(BASE)).join(known, "doc_id").select("doc_id", "stratum", "digest", (F.col("good") > 0).cast("bigint").alias("good"), F.expr(_step()).alias("step"))
    labelled = scored.groupBy("doc_id").agg(F.min(F.struct("digest", "stratum", "step")).alias("one"), F.min("good").alias("good")).select("one.*", "good")
    scored = labelled.groupBy("stratum", "digest").agg(F.min("good").alias("good"), F.min("step").alias("step"))
    # counts per step are all that the tests need
    counts = materialize(scored.groupBy("stratum", "step").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")), "steps")
    steps = counts.groupBy("stratum").agg(F.sum("g").alias("n")).where("n > 0").select("stratum", "n", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    strata = max(1, counts.where("g > 0").select("stratum").distinct().count())  # a stratum without good labels is no hypothesis
    so_far = Window.partitionBy("stratum").orderBy("step")
    tests = steps.join(counts, ["stratum", "step"], "left").na.fill(0, ["g", "b"])
    tests = tests.select("stratum", "step", "n", F.sum("g").over(so_far).alias("k"), F.sum("b").over(so_far).alias("bad"))
    tests = tests.withColumn("ok", F.expr(binomial_cdf("k", "n", risk)) <= delta / strata)
    certified = tests.withColumn("certified", F.min("ok").over(so_far)).where("certified")
    worth = certified.withColumn("gain", F.col("bad") - cost * F.col("k")).where("gain > 0")
    best = worth.groupBy("stratum").agg(F.max(F.struct("gain", (-F.col("step")).alias("step"))).alias("best")).select("stratum", (-F.col("best.step")).alias("step"))
    cutoffs = F.array(*(F.struct(F.lit(rule).alias("rule"), F.element_at(F.array(*map(F.lit, cuts)), F.col("step") + 1).alias("cutoff")) for rule, cuts in CUTOFFS.items()))
    return best.select("stratum", F.explode(cutoffs).alias("r")).select("stratum", "r.*")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept and the rule that rejected it, if any.

    Texts of any length are read whole. A null or empty text has no words, so it fails the base rule; a null stratum is the stratum ''.
    Labels of unknown, null or repeated ids do no harm: of several labels the worst counts. Repeated
    rows are judged each; an empty table gives an empty result; without labels the base rule alone
    decides. Only doc_id, text and the stratum are read."""
    measures = materialize(measure(docs, id_col, text_col, stratum_col), "measures")
    cutoffs = certified_cutoffs(measures, labels)
    per_stratum = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in SCORES))
    per_stratum = broadcast_if_small(materialize(per_stratum, "cutoffs"))
    judged = measures.join(per_stratum, "stratum", "left")
    reason = F.coalesce(*(F.expr(f"if({e} >= cut_{r}, '{r}', null)") for r, (e, _) in SCORES.items()))
    base = F.expr(BASE)
    return judged.select("doc_id", *METRICS, base.alias("base_failed"), (~base & reason.isNull()).alias("kept"), F.when(base, "base").otherwise(reason).alias("rejected_by"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_DUCK_CDF = f"""CASE WHEN k >= n * {RISK!r} THEN 1 ELSE (
  SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK!r}) + (n - i) * ln(1 - {RISK!r}))) FROM range(0, CAST(k AS BIGINT) + 1) r(i)) END"""
_DUCK_STEP = _step("len(list_filter([{cutoffs}], lambda c: c > {score}))")
OP3_SQL = rf"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
win AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) o(j) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, stratum, sha256(text) AS digest, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(len(lines) AS BIGINT) AS n_lines, len(list_filter(words, lambda x: length(x) = 1)) AS n_singles, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
known AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
sr AS (SELECT doc_id, stratum, digest, good, {_DUCK_STEP} AS step FROM m JOIN known USING (doc_id) WHERE NOT {BASE}),
s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY digest, stratum, step) AS nth FROM sr) WHERE nth = 1),
s AS (SELECT stratum, digest, min(CAST(good > 0 AS INT)) AS good, min(step) AS step FROM s1 GROUP BY 1, 2),
fam AS (SELECT greatest(1, count(*)) AS family FROM (SELECT stratum FROM s WHERE good > 0 GROUP BY stratum)),
t AS (SELECT stratum, g.step, count(*) FILTER (WHERE good > 0) AS n, count(*) FILTER (WHERE good > 0 AND s.step <= g.step) AS k, count(*) FILTER (WHERE good <= 0 AND s.step <= g.step) AS bad FROM s, range({STEPS}) g(step) GROUP BY ALL),
c AS (SELECT *, bool_and(n > 0 AND ({_DUCK_CDF}) <= {DELTA} / (SELECT family FROM fam)) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM t),
best AS (SELECT stratum, arg_max(step, (bad - {COST} * k, -step)) AS step FROM c WHERE ok AND bad - {COST} * k > 0 GROUP BY ALL),
cuts AS (SELECT stratum, {", ".join(f"list_extract({cuts}, step + 1) AS cut_{r}" for r, cuts in CUTOFFS.items())} FROM best),
j AS (SELECT doc_id, {", ".join(METRICS)}, {BASE} AS base_failed,
  coalesce({", ".join(f"CASE WHEN {e} >= cut_{r} THEN '{r}' END" for r, (e, _) in SCORES.items())}) AS reason FROM m LEFT JOIN cuts USING (stratum))
SELECT doc_id, {", ".join(METRICS)}, base_failed, NOT base_failed AND reason IS NULL AS kept, CASE WHEN base_failed THEN 'base' ELSE reason END AS rejected_by FROM j
"""
