"""Quality rules (operator 9): document rules, and host verdicts shrunk by an empirical beta prior.

Everything is DataFrame expressions.  A document's signals come from arrays inside its own row (no explode, no
shuffle); failures of each rule are counted per host with map-side aggregation, so a host with a third of all rows costs
one counter per task.  For every rule, host rates are shrunk towards a beta prior fitted to all hosts by moments, without the variance that sampling alone gives.  Two rules
(few words, repeated words) reject a document on their own.  The others (symbols, repeated lines) are weaker evidence: they
reject where the host bears them out, that is where its shrunk rate of that rule lies above the prior's mean by
``HOST_SPREAD`` of the prior's standard deviations.  A host nearly all of whose documents fail is rejected whole.  The verdicts on hosts
are joined back: by broadcast if those hosts were counted and are few, by an ordinary join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import SPACE, WORD, maybe_broadcast, read_table
from cellweave.sources.shared import materialise

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
GRAM = 5
#: Symbols for each hundred code points in words, and repeated lines in a hundred lines, above which a document fails.
MAX_SYMBOL_PERCENT = 10
MAX_LINE_PERCENT = 30
#: A host bears out a rule if its shrunk failure rate is above the prior's mean by this many standard deviations of the prior.
HOST_SPREAD = 0.5
#: Hosts differ if their rates do by this many standard deviations more than those of equal hosts would.
HOST_CHANCE = 3.0
#: A host is rejected whole if its shrunk rate of documents that fail on their own is above this.
HOST_LIMIT = 0.8
#: Hosts with a verdict are broadcast up to this many (a name and three booleans each).
BROADCAST_HOSTS = 20_000

#: Rules that reject where the host bears them out; a column of ``add_signals`` each.
HOST_RULES = ("symbols_failed", "lines_failed")
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *HOST_RULES)


def _gram_hashes() -> Column:
    return F.when(
        F.size("_w") >= GRAM,
        F.transform(F.sequence(F.lit(0), F.size("_w") - GRAM), lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(GRAM)])),
    )


def add_signals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``SIGNALS`` added (in place of columns of these names).

    Null texts count as empty: no words, all counts 0, ``base_failed`` true.  Words repeat if they stand in a window
    of five words that occurs twice or more in the same text; windows are told apart by 64-bit hashes.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    kept = [df[c].alias(c) for c in df.columns if c not in SIGNALS]
    names = [c for c in df.columns if c not in SIGNALS]
    one = df.select(
        *kept,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    two = one.select(
        *names,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_w"),
    )
    three = two.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "_n_lines", _gram_hashes().alias("_grams"))
    # Most texts repeat no window: they stop at a hash set.  The others sort (window, position) once.
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    four = three.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    again = F.transform(
        "_sorted",
        lambda x, i: F.when(x["g"].eqNullSafe(F.get("_sorted", i - 1)["g"]) | x["g"].eqNullSafe(F.get("_sorted", i + 1)["g"]), x["i"]),
    )
    five = four.withColumn("_starts", F.sort_array(F.filter(again, lambda x: x.isNotNull())))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-GRAM).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(GRAM), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    # Through a generator, so that no filter above is pushed below, where it would repeat all this for each array element.
    counts = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "_n_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    six = five.select(*names, F.inline(F.array(counts)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    symbols, lines = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"), 100 * F.col("n_dup_lines") > MAX_LINE_PERCENT * F.col("_n_lines")
    return six.withColumns({"base_failed": failed, "symbols_failed": symbols, "lines_failed": lines}).drop("_n_lines")


def host_verdicts(signals: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT, spread: float = HOST_SPREAD) -> DataFrame:
    """One row per host (null is a host): ``host, n_docs``, and for each of ``base_failed`` and ``HOST_RULES`` its failures
    ``n_<rule>``, ``<rule>_rate`` (shrunk) and ``<rule>_host`` (the verdict).

    The prior of a rule is the beta distribution with the mean of the hosts' failure rates and the variance that is left of
    theirs without what sampling alone gives (the mean of m (1 - m) / n), with a strength between 1 and 1,000,000 documents.  Where
    hosts differ no more than chance allows (the chi-square sum of their rates is within ``HOST_CHANCE`` standard deviations of
    its expectation, or no variance is left) the strength is the largest, and the weak rules have no verdict on any host.
    """
    rules = ("base_failed", *HOST_RULES)
    hosts = signals.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(f"n_{r}") for r in rules])
    rate = lambda r: F.col(f"n_{r}") / F.col("n_docs")
    prior = hosts.agg(
        F.count(F.lit(1)).alias("_hosts"), F.avg(1 / F.col("n_docs")).alias("_each"),
        *[f.alias(f"{x}_{r}") for r in rules for x, f in (("m", F.avg(rate(r))), ("v", F.var_pop(rate(r))), ("p", F.sum(f"n_{r}") / F.sum("n_docs")), ("s", F.sum(F.col(f"n_{r}") * rate(r))), ("b", F.sum(f"n_{r}")))],
    )
    for r in rules:
        m, p = F.col(f"m_{r}"), F.col(f"p_{r}")
        left = F.col(f"v_{r}") - m * (1 - m) * F.col("_each")
        # Sum of n (rate - p)^2 over p (1 - p), against its expectation and deviation if all hosts were the same.
        square = (F.col(f"s_{r}") - p * F.col(f"b_{r}")) / (p * (1 - p))
        free = F.col("_hosts") - 1
        differ = F.coalesce((p > 0) & (p < 1) & (left > 0) & (square > free + HOST_CHANCE * F.sqrt(2 * free)), F.lit(False))
        prior = prior.withColumn(f"d_{r}", differ).withColumn(f"k_{r}", F.when(differ, F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / left - 1))).otherwise(F.lit(1e6)))
    out = hosts.join(F.broadcast(prior))
    for r in rules:
        m, k = F.col(f"m_{r}"), F.col(f"k_{r}")
        out = out.withColumn(f"{r}_rate", (F.col(f"n_{r}") + m * k) / (F.col("n_docs") + k))
        if r == "base_failed":
            out = out.withColumn(f"{r}_host", F.col(f"{r}_rate") > limit)
        else:
            out = out.withColumn(f"{r}_host", F.col(f"d_{r}") & (F.col(f"{r}_rate") > m + spread * F.sqrt(m * (1 - m) / (k + 1))))
    return out.select("host", "n_docs", *[f"{x}{r}{y}" for r in rules for x, y in (("n_", ""), ("", "_rate"), ("", "_host"))])


def _with_verdict(signals: DataFrame, host_col: str) -> DataFrame:
    """``signals`` with ``kept``: the document's and its host's verdict."""
    found = materialise(host_verdicts(signals, host_col), "hosts").select(F.col("host").alias("_host"), F.col("base_failed_host").alias("_bad"), *[F.col(f"{r}_host").alias(f"_{r}") for r in HOST_RULES])
    found = maybe_broadcast(found.where(" OR ".join(["_bad", *[f"_{r}" for r in HOST_RULES]])), BROADCAST_HOSTS)
    joined = signals.join(found, F.col(host_col).eqNullSafe(F.col("_host")), "left")
    failed = F.col("base_failed") | F.coalesce("_bad", F.lit(False))
    for r in HOST_RULES:
        failed = failed | (F.col(r) & F.coalesce(f"_{r}", F.lit(False)))
    return joined.withColumn("kept", ~failed).drop(*found.columns)


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Signals and the verdict for every row: ``doc_id, SIGNALS, kept``.

    ``kept`` is false if the base rule failed, if a host rule failed that the row's host bears out, or if the host was
    rejected.  Texts of any length are judged whole; null texts count as empty and fail.  Repeated rows and null ids are judged
    like any other row; a null host is a host.  Other columns of ``df`` are not read.  An empty table gives an empty result.
    """
    narrow = df.select(df[id_col].alias("doc_id"), df[host_col].alias("_source"), df[text_col].alias("_text"))
    signals = materialise(add_signals(narrow, "_text").drop("_text"), "signals")
    return _with_verdict(signals, "_source").select("doc_id", *SIGNALS, "kept")


def keep_quality(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``df`` that pass (see ``quality_verdicts``), with ``df``'s columns and nothing else, whatever their names.

    Signals are computed once and written beside the rows (texts that fail on their own are left out there); texts are
    never shuffled for it unless hosts with a verdict are too many to broadcast.
    """
    names = df.columns
    marked = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(names)])
    text, host = f"c{names.index(text_col)}", f"c{names.index(host_col)}"
    signals = add_signals(marked, text).withColumn(text, F.when(~F.col("base_failed"), F.col(text)))
    kept = _with_verdict(materialise(signals, "signals"), host).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document signals and host-aware verdicts for all ``documents``."""
    return quality_verdicts(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), base AS (
  SELECT rid, doc_id, source, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols
  FROM w
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM
    (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), p AS (
  SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5
), g AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram FROM p
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n >= 2
), covered AS (
  SELECT rid, sum(least(5, i - coalesce(before, i - 5))) AS n_rep FROM
    (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM again) GROUP BY rid
), s AS (
  SELECT base.*, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
         n_words < 10 OR 100 * coalesce(n_rep, 0) > 20 * n_words AS base_failed,
         100 * n_symbols > 10 * word_chars AS symbols_failed, 100 * coalesce(n_dup, 0) > 30 * coalesce(n_lines, 0) AS lines_failed
  FROM base LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
), hosts AS (
  SELECT source, rule, count(*) AS n, sum(failed::INT) AS bad FROM
    (SELECT source, unnest(['base', 'symbols', 'lines']) AS rule, unnest([base_failed, symbols_failed, lines_failed]) AS failed FROM s)
  GROUP BY source, rule
), prior AS (
  SELECT rule, avg(bad / n) AS m, var_pop(bad / n) AS v, avg(1 / n) AS each, count(*) - 1 AS free, sum(bad) / sum(n) AS p, sum(bad * bad / n) AS s, sum(bad) AS b FROM hosts GROUP BY rule
), spread AS (
  SELECT rule, m, v - m * (1 - m) * each AS left_over, p > 0 AND p < 1 AND v > m * (1 - m) * each AND (s - p * b) / (p * (1 - p)) > free + 3 * sqrt(2 * free) AS differ FROM prior
), fitted AS (
  SELECT rule, m, differ, CASE WHEN differ THEN greatest(1.0, least(1e6, m * (1 - m) / left_over - 1)) ELSE 1e6 END AS k FROM spread
), verdict AS (
  SELECT source, bool_or(rule = 'base' AND rate > 0.8) AS bad, bool_or(rule = 'symbols' AND differ AND rate > high) AS symbols, bool_or(rule = 'lines' AND differ AND rate > high) AS lines
  FROM (SELECT source, rule, differ, (bad + m * k) / (n + k) AS rate, m + 0.5 * sqrt(m * (1 - m) / (k + 1)) AS high FROM hosts JOIN fitted USING (rule)) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbols_failed, lines_failed,
       NOT (base_failed OR verdict.bad OR symbols_failed AND verdict.symbols OR lines_failed AND verdict.lines) AS kept
FROM s JOIN verdict ON s.source IS NOT DISTINCT FROM verdict.source
"""
