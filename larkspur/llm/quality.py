"""Quality rules with risk-controlled cutoffs, in built-in expressions only.

A rule rejects a document whose measure lies beyond a cutoff. A policy is one cutoff for each rule; POLICIES
lists them from lenient to strict, fixed beforehand. For each stratum (language) they are tested in this order
on all labelled documents that the base rule keeps: were good documents rejected at the rate ``risk`` or
above, how likely is it to see so few rejected (exact binomial tail)? The walk stops at the first policy that
can't be certified, so one level serves the whole list (fixed-sequence testing) and rules share one risk, being
tested jointly. Bonferroni divides the level by the number of strata that have labels enough to certify a
policy that rejects none, a number that depends on no outcome. With probability 1 - ``delta`` all strata's
policies together then reject at most ``risk`` of a stratum's good documents, labels being independent draws.
A stratum with fewer labels gets no policy, and nothing of it is rejected beyond the base rule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_SPACE = " \t\n\x0b\f\r"

#: Rules: name, measure, whether values above the cutoff (or else below it) are rejected.
RULES = (
    ("symbols", "n_symbols / greatest(word_chars, 1)", True),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", True),
    ("repeat_words", "n_repeat_words / greatest(n_words, 1)", True),
    ("long_words", "word_chars / greatest(n_words, 1)", True),
    ("short_words", "word_chars / greatest(n_words, 1)", False),
)
#: Policies from lenient to strict: a cutoff for each rule.
POLICIES = (
    (0.50, 0.90, 0.48, 30.0, 1.00),
    (0.35, 0.85, 0.48, 25.0, 1.25),
    (0.25, 0.80, 0.46, 20.0, 1.50),
    (0.15, 0.75, 0.44, 18.0, 1.75),
    (0.10, 0.70, 0.42, 16.0, 2.00),
    (0.08, 0.65, 0.40, 14.0, 2.25),
    (0.06, 0.60, 0.38, 13.0, 2.50),
    (0.05, 0.50, 0.35, 12.0, 2.75),
    (0.04, 0.45, 0.30, 11.0, 3.00),
    (0.03, 0.40, 0.25, 10.0, 3.20),
    (0.02, 0.35, 0.20, 9.0, 3.40),
)
RISK, DELTA = 0.02, 0.05


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with _words ... columns replaced by the counts n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words (long). Expects a column text; others pass through."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("_trim", F.btrim(text, F.lit(_SPACE)))
    d = d.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", r"[\x20\x09-\x0D]+")))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != ""))
    n = F.size("_words")
    w = F.col("_words")
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    none = F.array().cast("array<bigint>")
    d = d.withColumn("_grams", F.when(n >= 3, grams).otherwise(none))
    # most texts repeat no window of three words: only the others are sorted
    pairs = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("_sorted")
    again = F.filter(s, lambda x, j: (F.try_element_at(s, F.when(j > 0, j).otherwise(F.lit(-1)))["h"].eqNullSafe(x["h"]) & (j > 0)) | (F.try_element_at(s, j + 2)["h"] == x["h"]).eqNullSafe(True))
    d = d.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col("_at")
    covered = F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.try_element_at(p, j + 2) - x), F.lit(3))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_words", n.cast("long")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"))
    d = d.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("n_repeat_words", covered.cast("long"))
    return d.drop("_trim", "_words", "_lines", "_grams", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Exact P(X <= k) for X ~ Bin(n, p): the terms' sum, each from the one before, scaled by the largest
    so far so that nothing underflows."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * F.lit(math.log1p(-p))).alias("term"), (n * F.lit(math.log1p(-p))).alias("top"), F.lit(1.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        top = F.greatest(a["top"], term)
        return F.struct(term.alias("term"), top.alias("top"), (a["sum"] * F.exp(a["top"] - top) + F.exp(term - top)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(steps, start, step, lambda a: F.exp(a["top"]) * a["sum"]))


def hits(policy: tuple[float, ...]) -> list[Column]:
    """For each rule whether it rejects a measured row under ``policy``."""
    return [F.expr(measure) > cutoff if above else F.expr(measure) < cutoff for (_, measure, above), cutoff in zip(RULES, policy)]


def least_labels(risk: float, delta: float) -> int:
    """How many good documents, none of them rejected, certify a policy at level ``delta``."""
    return math.ceil(math.log(delta) / math.log1p(-risk))


def certified_policies(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, n, policy, k, bound): the strictest certified policy (its number, from 1) of each stratum; of
    its n good documents it rejects k, which a rate of ``risk`` would allow with probability ``bound`` at
    most. A stratum without a certified policy has no row.

    ``labelled``: stratum, good (boolean) and the measures' columns; only a row a stratum is shuffled."""
    rejected = [F.count_if(F.greatest(*hits(p))).alias(f"k{i}") for i, p in enumerate(POLICIES, 1)]
    counts = labelled.where("good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *rejected)
    grid = counts.select("stratum", "n", F.inline(F.array(*[F.struct(F.lit(i).alias("policy"), F.col(f"k{i}").alias("k")) for i in range(1, len(POLICIES) + 1)])))
    strata = counts.agg(F.greatest(F.count_if(F.col("n") >= least_labels(risk, delta)), F.lit(1)).alias("strata"))
    # a rate above the risk can't be certified: its tail, of up to n terms, need not be summed
    tail = F.when(F.col("k") > risk * F.col("n"), F.lit(1.0)).otherwise(binomial_tail(F.col("k"), F.col("n"), risk))
    tested = grid.crossJoin(F.broadcast(strata)).withColumn("bound", tail).withColumn("pass", F.col("bound") <= F.lit(delta) / F.col("strata"))
    # fixed sequence: the policy before the first that fails
    ends = tested.groupBy("stratum").agg(F.coalesce(F.min(F.when(~F.col("pass"), F.col("policy"))), F.lit(len(POLICIES) + 1)).alias("end"))
    return tested.join(ends, "stratum").where("policy = end - 1").select("stratum", "n", "policy", "k", "bound")


def fit_policies(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``certified_policies`` from measured ``docs`` and ``labels`` (doc_id, quality: 1 is good). A document is good
    if all its labels say so; a null stratum is one of its own, the empty name."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    kept = docs.where(~base_failed()).select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return certified_policies(kept.join(marks, "doc_id"), risk, delta)


def judged(docs: DataFrame, fitted: DataFrame, stratum: str = "lang") -> DataFrame:
    """Measured ``docs`` with base_failed, policy (its number, null if the stratum has none), failed_rules (names)
    and kept. ``fitted`` has a row a stratum; Spark sends it if it is small, or else joins by shuffle."""
    d = docs.withColumn("_stratum", F.coalesce(F.col(stratum), F.lit("")))
    d = d.join(fitted.select(F.col("stratum").alias("_stratum"), "policy"), "_stratum", "left")
    names = F.array(*[F.when(F.element_at(F.array(*[hits(p)[r] for p in POLICIES]), F.col("policy")), F.lit(name)) for r, (name, _, _) in enumerate(RULES)])
    failed = F.when(F.col("policy").isNotNull(), F.filter(names, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_stratum")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, ``stratum``, the counts, base_failed, policy, failed_rules and kept of every row of ``docs``
    (doc_id, text, ``stratum``; other columns are ignored).

    Null, empty and blank texts have no words and fail the base rule. Repeated rows are judged alike; rows
    without a doc_id are judged too, but can't be labelled. A stratum with few labels (one, say) has no policy.
    Empty tables: no rows, or no policies."""
    scratch = Scratch(docs.sparkSession, "quality")
    d = scratch.table(measured(docs.select("doc_id", "text", stratum)).drop("text"), "measures")
    return judged(d, scratch.table(fit_policies(d, labels, stratum, risk, delta), "policies"), stratum)


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with their own columns. Rows are written with their measures,
    so that these are made once and no text moves between executors."""
    scratch = Scratch(docs.sparkSession, "quality")
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col(stratum).alias(stratum))
    d = scratch.table(measured(own).drop("text"), "measures")
    return judged(d, scratch.table(fit_policies(d, labels, stratum, risk, delta), "policies"), stratum).where("kept").select("_row.*")


#: The same for DuckDB; the columns that the registered query returns.
QUALITY_RULES_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(list_zip(words, words[2:], words[3:])[:-3], lambda x: concat_ws(' ', x[1], x[2], x[3]))) AS gram FROM w WHERE len(words) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM t, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY 1),
m AS (SELECT doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {', '.join(map(repr, p))})" for i, p in enumerate(POLICIES, 1))}) AS p(policy, c1, c2, c3, c4, c5)),
h AS (SELECT b.*, policy, {" OR ".join(f"{measure.replace(' / ', '::DOUBLE / ')} {'>' if above else '<'} c{i}" for i, (_, measure, above) in enumerate(RULES, 1))} AS hit FROM b, p),
marks AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
c AS (SELECT stratum, policy, count(*) AS n, count(*) FILTER (WHERE hit) AS k FROM h JOIN marks USING (doc_id) WHERE good AND NOT base_failed GROUP BY 1, 2),
s AS (SELECT greatest(count(*) FILTER (WHERE n >= {least_labels(RISK, DELTA)}), 1) AS strata FROM c WHERE policy = 1),
x AS (SELECT stratum, policy, k <= {RISK} * n AND
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) <= {DELTA} / strata AS pass FROM c, s),
e AS (SELECT stratum, coalesce(min(policy) FILTER (WHERE NOT pass), {len(POLICIES) + 1}) - 1 AS policy FROM x GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(e.policy, 0)::INTEGER AS policy, NOT base_failed AND NOT coalesce(h.hit, false) AS kept
FROM b LEFT JOIN e USING (stratum) LEFT JOIN (SELECT doc_id AS d, policy, hit FROM h) h ON h.d = doc_id AND h.policy = e.policy
"""
