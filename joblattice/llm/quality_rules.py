"""Quality rules whose cutoffs come with a bound on good documents lost (operator 2).

Each rule rejects documents whose value of a metric, in percent, is above a cutoff.
Cutoffs are chosen per stratum (language) on the labelled documents: of n good ones, k
lie above a cutoff. A cutoff is certified when Bin(n, r) would give k or fewer with a
probability of at most delta / (all tests made), r being the rule's share of the false
rejection rate that is allowed. By the union bound all certified cutoffs hold
together with probability 1 - delta, so at most ``MAX_FALSE_REJECTION`` of a
stratum's good documents are lost. The lowest certified cutoff is used; a stratum
without one keeps everything that passes the base rules.

Only counts per (stratum, rule, cutoff) leave the documents: partial sums, then at most
strata x 4 x 20 rows. The cutoffs chosen are one row, joined by broadcast when
Spark finds it small. No Python runs.

Defined results: a null or empty text has no word and fails the base rules; a null
language is a stratum of its own; repeated rows and labels count once per row;
labels without quality are ignored; an empty table or no label gives no cutoff;
further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblattice.llm.common import BLANKS, UPPER, documents, stored, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_FALSE_REJECTION = 0.08  # of a stratum's good documents, over all rules
DELTA = 0.05  # chance that any certified cutoff breaks that
CUTOFFS = tuple(range(0, 100, 5))  # percent, tested for each rule and stratum

METRICS = {
    "symbol_percent": "100.0D * n_symbols / greatest(word_chars, 1)",
    "repeat_percent": "100.0D * n_repeat_words / greatest(n_words, 1)",
    "dup_line_percent": "100.0D * n_dup_lines / greatest(n_lines, 1)",
    "upper_percent": "100.0D * n_upper / greatest(word_chars, 1)",
}


def _size(array: Column) -> Column:
    return F.size(array).cast("bigint")


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows whose hash stands twice or more in ``windows``.

    Windows are sorted by hash with their starts; those with an equal neighbour are
    kept, and their starts, sorted, each cover the words up to the next start.
    """
    dealt = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twin = F.filter(
            F.transform(
                pairs,
                lambda p, i: F.when(
                    ((i > 0) & (p["h"] == F.get(pairs, F.greatest(i - 1, F.lit(0)))["h"]))
                    | ((i < last) & (p["h"] == F.get(pairs, i + 1)["h"])),
                    p["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.array_sort(twin)

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("p")),
            lambda s, p: F.struct(
                (s["n"] + F.least(F.lit(width), p - s["p"])).alias("n"), p.alias("p")
            ),
            lambda s: s["n"],
        )

    def once(value: Column, use) -> Column:
        # Evaluates ``value`` one time for all of its uses.
        return F.transform(F.array(value), use)[0]

    return once(dealt, lambda pairs: once(starts(pairs), covered))


def measured(docs: DataFrame) -> DataFrame:
    """The base columns of every document, beside its id and language."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    rows = docs.select("doc_id", "lang", text.alias("_text"), words_of(text).alias("_words"), lines.alias("_lines"))
    hashes = F.when(
        F.size("_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("_words", i, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    bare = F.translate("_text", BLANKS, "")
    rows = rows.select(
        "doc_id",
        "lang",
        F.xxhash64("_text").alias("text_hash"),
        _size(F.col("_words")).alias("n_words"),
        F.length(bare).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _size(F.col("_lines")).alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        (F.length("_text") - F.length(F.translate("_text", UPPER, "")))
        .cast("bigint")
        .alias("n_upper"),
        hashes.alias("_windows"),
    )
    # The windows are sorted only where one of them occurs twice.
    repeats = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"), repeated_words(F.col("_windows"))
    ).otherwise(F.lit(0).cast("bigint"))
    rows = rows.withColumn("n_repeat_words", repeats).drop("_windows")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return rows.withColumn("base_failed", failed).withColumns({k: F.expr(v) for k, v in METRICS.items()})


def _tail_log(n: Column, k: Column, rate: float) -> Column:
    """log P(Bin(n, rate) <= k), summed from the largest term down."""
    r = F.lit(rate)

    def step(s: Column, i: Column) -> Column:
        j = k - i  # from k to 0; the term below is term * j / (n - j + 1) * (1 - r) / r
        down = s["t"] * (j + 1) / (n - j) * ((1 - r) / r)
        return F.struct((s["sum"] + down).alias("sum"), down.alias("t"))

    log_first = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k),
        F.lit(0.0),
        lambda s, j: s + F.when(j == 0, F.lit(0.0)).otherwise(F.log((n - j + 1) / F.greatest(j, F.lit(1)))),
    ) + k * F.log(r) + (n - k) * F.log(1 - r)
    sums = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("t")),
        step,
        lambda s: s["sum"],
    )
    return log_first + F.log(sums)


def chosen_cutoffs(measures: DataFrame, labels: DataFrame, limit: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """Per stratum: ``lang``, and for each rule its lowest certified cutoff or null.

    A text counts once in its stratum, however many labelled copies it has: the bound holds
    for independent draws.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_labelled"))
    held = measures.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_labelled"))
    held = held.groupBy("lang", "text_hash").agg(*[F.any_value(m).alias(m) for m in METRICS])
    counts = held.groupBy("lang").agg(
        F.count("*").alias("n"),
        *[
            F.array(*[F.count_if(F.col(m) > c) for c in CUTOFFS]).alias(m)
            for m in METRICS
        ],
    )
    rate = limit / len(METRICS)
    # One row per language: counting them needs no more than one small task.
    counts = counts.withColumn("strata", F.count("*").over(Window.partitionBy()))
    budget = F.log(F.lit(delta) / (F.col("strata") * len(METRICS) * len(CUTOFFS)))
    n = F.col("n")

    def certified(m: str) -> Column:
        ok = [
            F.when(
                (F.get(m, F.lit(i)) < n * rate)
                & (_tail_log(n, F.get(m, F.lit(i)), rate) <= budget),
                F.lit(float(c)),
            )
            for i, c in enumerate(CUTOFFS)
        ]
        return F.coalesce(*ok)

    return counts.select("lang", *[certified(m).alias(f"{m}_cutoff") for m in METRICS])


def judged(measures: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measures`` with ``kept``: base rules passed and no metric above its cutoff."""
    chosen = cutoffs.withColumnRenamed("lang", "_lang")
    above = [F.coalesce(F.col(m) > F.col(f"{m}_cutoff"), F.lit(False)) for m in METRICS]
    kept = ~F.col("base_failed") & ~reduce(Column.__or__, above)
    return measures.join(chosen, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("kept", kept)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A few numbers per document, used twice: the texts are read and measured once.
    measures = stored(measured(documents(spark, sf_dir)), "quality-measures")
    cutoffs = chosen_cutoffs(measures, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(measures, cutoffs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE {m} > {c}) AS {m}_{c}" for m in METRICS for c in CUTOFFS
)
_DUCK = {m: e.replace("100.0D", "CAST(100 AS DOUBLE)") for m, e in METRICS.items()}


def _certified(m: str) -> str:
    rate = MAX_FALSE_REJECTION / len(METRICS)
    tests = [
        f"CASE WHEN {m}_{c} < n * {rate!r} AND list_sum(list_transform(range(0, {m}_{c} + 1), lambda j: "
        f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate!r}) + (n - j) * ln(1 - {rate!r})))) "
        f"<= {DELTA!r} / (strata * {len(METRICS) * len(CUTOFFS)}) THEN {c} END"
        for c in CUTOFFS
    ]
    return f"coalesce({', '.join(tests)}) AS {m}_cutoff"


SQL = f"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split)),
twice AS (SELECT doc_id, w FROM windows GROUP BY ALL HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows SEMI JOIN twice USING (doc_id, w))
  GROUP BY doc_id),
measures AS (
  SELECT doc_id, lang, t, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (doc_id)),
rated AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    {", ".join(f"{e} AS {m}" for m, e in _DUCK.items())}
  FROM measures),
counts AS (
  SELECT lang, count(*) AS n, {_COUNTS}
  FROM (
    SELECT DISTINCT lang, t, {", ".join(METRICS)} FROM rated JOIN labels USING (doc_id)
    WHERE NOT base_failed AND quality = 1)
  GROUP BY lang),
cutoffs AS (
  SELECT lang, {", ".join(_certified(m) for m in METRICS)}
  FROM counts, (SELECT count(*) AS strata FROM counts))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"NOT coalesce({m} > {m}_cutoff, false)" for m in METRICS)} AS kept
FROM rated LEFT JOIN cutoffs ON rated.lang IS NOT DISTINCT FROM cutoffs.lang
"""
