"""Quality rules by weak supervision.

Every rule looks at one measure of a text and votes good, votes bad or abstains.  No
rule rejects alone: expectation-maximisation over the votes of the whole corpus
estimates how many documents are good and how accurate each rule is on good and on bad
ones, and a document is kept if its posterior chance of being good reaches a half.

All work is in DataFrame functions.  Measures are taken inside the row and written once
without the text; the corpus meets only as counts of vote patterns (a map-side combined
aggregate of at most 3 ** rules rows), over which one fold runs the steps of the
estimate; the posteriors of those patterns, as many rows at most, are broadcast back.

A window of three words is compared by its 64-bit hash, within its text alone: two
different windows of a text of a million words meet by chance once in 10 ** 7 such texts.

Edge cases: a null text counts as empty; a text without words has 0 everywhere, no vote
but those on its length, and fails the base rules; letters without case (and texts with
few letters) leave the rule of capitals silent; repeated rows get equal verdicts; an empty
table gives an empty result; extra columns are carried if named in ``carry``, and those
named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.storage import durable

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Words in a base document at least, and percent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Steps of expectation-maximisation.
STEPS = 60
#: Imagined votes: bad and all votes on good documents, bad and all votes on bad ones; good and all documents.
ON_GOOD, ON_BAD, GOOD_DOCS = (0.5, 50.0), (4.0, 10.0), (17.0, 20.0)
#: A document is kept from this posterior chance on.
KEEP_FROM = 0.5


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def _rules() -> dict[str, tuple[Column, float, float, float, float]]:
    """name: (measure, good from, good to, bad below, bad above).  Between good and bad, or without a measure, a rule abstains."""
    none = float("-inf")
    cased = F.when(F.col("n_cased") >= 20, F.col("n_upper") / F.col("n_cased"))
    lines = F.when(F.col("n_lines") >= 3, F.col("n_dup_lines") / F.col("n_lines"))
    long_enough = F.when(F.col("n_words") >= LEAST_WORDS, F.col("n_ends") / F.col("n_words"))
    return {
        "symbols": (_share("n_symbols", "n_words"), none, 0.02, none, 0.1),
        "capitals": (cased, none, 0.25, none, 0.6),
        "shouting": (_share("n_shouts", "n_words"), none, 0.05, none, 0.25),
        "repeats": (_share("n_repeat_words", "n_words"), none, 0.2, none, 0.4),
        "lines": (lines, none, 0.15, none, 0.4),
        "sentences": (long_enough, 0.02, 0.3, 0.002, 0.6),
        "letters": (_share("n_letters", "word_chars"), 0.9, 1.0, 0.8, 1.0),
        "alphabetic": (_share("n_alphabetic", "n_words"), 0.9, 1.0, 0.8, 1.0),
        "doubled_marks": (_share("n_doubled", "n_words"), none, 0.02, none, 0.1),
        "word_length": (_share("word_chars", "n_words"), 3.0, 12.0, 2.0, 60.0),
    }


def votes(rules: dict[str, tuple[Column, float, float, float, float]] | None = None) -> Column:
    """Array of the rules' votes on the measures of a row: 1 good, -1 bad, 0 none."""
    def vote(x: Column, lo: float, hi: float, below: float, above: float) -> Column:
        return F.when((x < below) | (x > above), F.lit(-1)).when((x >= lo) & (x <= hi), F.lit(1)).otherwise(F.lit(0)).cast("int")

    return F.array(*[vote(*rule) for rule in (rules or _rules()).values()])


def measures(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and, of every whole text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word),
    n_cased, n_upper, n_letters, n_shouts, n_ends (words that end a sentence), n_alphabetic (words with a letter) and n_doubled
    (words in which a mark follows itself)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = lambda c: F.char_length(c).cast("long")
    base = docs.select(*[F.col(c) for c in carry], text.alias("__t"))
    # words and lines are columns of their own, so that a text is split once and not for each use
    base = base.withColumns({"__w": F.array_remove(F.split("__t", f"[{SPACE}]+", -1), ""), "__l": F.filter(F.split("__t", "\n", -1), lambda s: s.rlike(f"[^{SPACE}]"))})
    w = F.col("__w")
    marks = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")))
    base = base.withColumn("__s", F.when(F.size(w) >= 3, F.sort_array(marks)))
    s = F.col("__s")
    again = F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"]))
    base = base.withColumn("__r", F.sort_array(F.transform(again, lambda x: x["i"])))
    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("__r", zero, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")))["n"]
    t = F.col("__t")
    return base.select(
        *[F.col(c) for c in carry],
        F.size(w).cast("long").alias("n_words"),
        size(F.translate(t, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (size(t) - size(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        size(F.regexp_replace(t, r"[^\p{Lu}\p{Ll}]+", "")).alias("n_cased"),
        size(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("n_upper"),
        size(F.regexp_replace(t, r"[^\p{L}\p{M}]+", "")).alias("n_letters"),
        (size(t) - size(F.translate(t, "!", ""))).alias("n_shouts"),
        F.regexp_count(t, F.lit(rf"[.!?…。！？][\"'”’»)]*(?:[{SPACE}]|\z)")).cast("long").alias("n_ends"),
        F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alphabetic"),
        F.regexp_count(t, F.lit(rf"([^\p{{L}}\p{{M}}\p{{N}}.\-_={SPACE}])\1[^{SPACE}]*")).cast("long").alias("n_doubled"),
    )


def _chance(v: Column, at: Column) -> Column:
    """Posterior chance of good under the parameters ``at`` (log odds and log ratios of a bad and of a good vote) of votes ``v``."""
    odds = F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), at["odds"], lambda acc, j: acc + F.when(F.get(v, j) < 0, F.get(at["bad"], j)).when(F.get(v, j) > 0, F.get(at["good"], j)).otherwise(F.lit(0.0)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _parameters(patterns: Column, n_rules: int) -> Column:
    """The parameters that fit ``patterns`` (array of n, v, q: rows, votes, chance of good), imagined votes included."""
    def total(value) -> Column:
        return F.aggregate(patterns, F.lit(0.0), lambda acc, p: acc + value(p))

    def rates(chance, imagined: tuple[float, float]) -> Column:
        def rate(j: Column) -> Column:
            zero = F.struct(F.lit(imagined[0]).alias("bad"), F.lit(imagined[1]).alias("cast"))
            add = lambda acc, p: F.struct(
                F.when(F.get(p["v"], j) < 0, acc["bad"] + p["n"] * chance(p)).otherwise(acc["bad"]).alias("bad"),
                F.when(F.get(p["v"], j) != 0, acc["cast"] + p["n"] * chance(p)).otherwise(acc["cast"]).alias("cast"),
            )
            return F.aggregate(patterns, zero, add, lambda acc: acc["bad"] / acc["cast"])

        return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), rate)

    share = (total(lambda p: p["n"] * p["q"]) + F.lit(GOOD_DOCS[0])) / (total(lambda p: p["n"]) + F.lit(GOOD_DOCS[1]))
    return F.struct(rates(lambda p: p["q"], ON_GOOD).alias("on_good"), rates(lambda p: F.lit(1.0) - p["q"], ON_BAD).alias("on_bad"), share.alias("share"))


def _ratios(at: Column) -> Column:
    """Parameters as log odds of good and log likelihood ratios of votes; a rule that errs as often on both says nothing."""
    pair = F.arrays_zip(at["on_good"], at["on_bad"])
    return F.struct(
        (F.log(at["share"]) - F.log(F.lit(1.0) - at["share"])).alias("odds"),
        F.transform(pair, lambda p: F.least(F.lit(0.0), F.log(p["on_good"]) - F.log(p["on_bad"]))).alias("bad"),
        F.transform(pair, lambda p: F.greatest(F.lit(0.0), F.log(F.lit(1.0) - p["on_good"]) - F.log(F.lit(1.0) - p["on_bad"]))).alias("good"),
    )


def accuracies(voted: DataFrame, n_rules: int, steps: int = STEPS) -> DataFrame:
    """One row: n_docs, share of good documents, on_good and on_bad (each rule's share of bad votes on good and on bad documents)
    and ratios, as ``_ratios`` makes them.  ``voted`` has a column ``votes``.

    The first guess takes documents with no bad vote as good.  At most 3 ** ``n_rules`` patterns meet in the fold."""
    counts = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    guess = F.when(F.exists("votes", lambda v: v < 0), F.lit(0.0)).otherwise(F.lit(1.0))
    held = counts.agg(F.sort_array(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), F.col("votes").alias("v"), guess.alias("q")))).alias("patterns"), F.sum("n").alias("n_docs"))

    def step(acc: Column, _: Column) -> Column:
        # parameters first, then chances: each is bound once by a lambda over one element
        at = F.transform(F.array(_parameters(acc, n_rules)), _ratios)
        return F.flatten(F.transform(at, lambda r: F.transform(acc, lambda p: F.struct(p["n"].alias("n"), p["v"].alias("v"), _chance(p["v"], r).alias("q")))))

    fitted = held.select("n_docs", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("patterns"), step).alias("patterns"))
    fitted = fitted.select("n_docs", _parameters(F.col("patterns"), n_rules).alias("at"))
    return fitted.select(F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), F.col("at.share").alias("share"), F.col("at.on_good").alias("on_good"), F.col("at.on_bad").alias("on_bad"), _ratios(F.col("at")).alias("ratios"))


def judged(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), steps: int = STEPS) -> DataFrame:
    """The measures of every document and votes, posterior (chance of being good), base_failed and kept."""
    rules = _rules()
    made = ("votes", "posterior", "base_failed", "kept")
    measured = measures(docs, text_col, tuple(c for c in carry if c not in made)).withColumn("votes", votes(rules))
    measured = durable(measured, "quality-rules")
    fitted = durable(accuracies(measured, len(rules), steps), "quality-rules-accuracies")
    patterns = measured.select("votes").distinct().crossJoin(F.broadcast(fitted.select("ratios"))).select("votes", _chance(F.col("votes"), F.col("ratios")).alias("posterior"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = measured.join(F.broadcast(patterns), "votes").withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))


def report(docs: DataFrame, text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """rule, votes_good, votes_bad, bad_on_good, bad_on_bad of each rule: what it says and how far it is believed."""
    rules = _rules()
    voted = durable(measures(docs, text_col, ()).select(votes(rules).alias("votes")), "quality-rules")
    fitted = durable(accuracies(voted, len(rules), steps), "quality-rules-accuracies")
    count = lambda i, y: F.count(F.when(F.get("votes", F.lit(i)) == y, 1))
    told = voted.agg(F.array(*[F.struct(F.lit(name).alias("rule"), count(i, 1).alias("votes_good"), count(i, -1).alias("votes_bad")) for i, name in enumerate(rules)]).alias("told"))
    each = told.crossJoin(fitted).select(F.explode(F.arrays_zip("told", "on_good", "on_bad")).alias("x"))
    return each.select("x.told.*", F.col("x.on_good").alias("bad_on_good"), F.col("x.on_bad").alias("bad_on_bad"))


ORACLE_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (
  SELECT row, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS win, unnest(range(1, len(w) - 1)) AS i
  FROM base WHERE len(w) >= 3),
marked AS (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM windows),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM marked, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY row),
measured AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^\p{Lu}\p{Ll}]+', '', 'g')) AS n_cased,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}\p{M}]+', '', 'g')) AS n_letters,
         length(t) - length(replace(t, '!', '')) AS n_shouts,
         len(list_filter(w, lambda x: regexp_matches(x, '[.!?…。！？]["''”’»)]*$'))) AS n_ends, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_alphabetic,
         len(list_filter(w, lambda x: regexp_matches(x, '[^\p{L}\p{M}\p{N}.\-_=]{2}')
           AND len(list_filter(range(1, length(x)), lambda i: x[i] = x[i+1] AND NOT regexp_matches(x[i], '[\p{L}\p{M}\p{N}.\-_=]'))) > 0)) AS n_doubled
  FROM base b LEFT JOIN covered c ON b.row = c.row),
shares AS (
  SELECT *, [CASE WHEN n_words > 0 THEN n_symbols / n_words END, CASE WHEN n_cased >= 20 THEN n_upper / n_cased END, CASE WHEN n_words > 0 THEN n_shouts / n_words END,
             CASE WHEN n_words > 0 THEN n_repeat_words / n_words END, CASE WHEN n_lines >= 3 THEN n_dup_lines / n_lines END, CASE WHEN n_words >= 50 THEN n_ends / n_words END,
             CASE WHEN word_chars > 0 THEN n_letters / word_chars END, CASE WHEN n_words > 0 THEN n_alphabetic / n_words END, CASE WHEN n_words > 0 THEN n_doubled / n_words END,
             CASE WHEN n_words > 0 THEN word_chars / n_words END] AS x,
         -- good from, good to, bad below, bad above
         [[-1, 0.02, -1, 0.1], [-1, 0.25, -1, 0.6], [-1, 0.05, -1, 0.25], [-1, 0.2, -1, 0.4], [-1, 0.15, -1, 0.4], [0.02, 0.3, 0.002, 0.6], [0.9, 1, 0.8, 1], [0.9, 1, 0.8, 1],
          [-1, 0.02, -1, 0.1], [3, 12, 2, 60]] AS r
  FROM measured),
voted AS MATERIALIZED (
  SELECT *, list_transform(range(1, 11), lambda j: CASE WHEN x[j] < r[j][3] OR x[j] > r[j][4] THEN -1 WHEN x[j] BETWEEN r[j][1] AND r[j][2] THEN 1 ELSE 0 END) AS v FROM shares),
patterns AS (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY v),
held AS MATERIALIZED (SELECT list(v ORDER BY v) AS vs, list(n ORDER BY v) AS ns, len(list(v)) AS m FROM patterns),
em AS (
  SELECT 0 AS step, list_transform(vs, lambda v: CASE WHEN list_contains(v, -1) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS q FROM held
  UNION ALL
  SELECT step + 1, list_transform(vs, lambda v: 1 / (1 + exp(-(ln(share) - ln(1 - share) + list_sum(list_transform(range(1, 11), lambda j:
           CASE WHEN v[j] < 0 THEN least(0, ln(g[j]) - ln(b[j])) WHEN v[j] > 0 THEN greatest(0, ln(1 - g[j]) - ln(1 - b[j])) ELSE 0 END))))))
  FROM (
    SELECT step, vs, (17 + list_sum(list_transform(range(1, m + 1), lambda i: ns[i] * q[i]))) / (20 + list_sum(ns)) AS share,
           list_transform(range(1, 11), lambda j: (0.5 + list_sum(list_transform(range(1, m + 1), lambda i: CASE WHEN vs[i][j] < 0 THEN ns[i] * q[i] ELSE 0 END)))
             / (50 + list_sum(list_transform(range(1, m + 1), lambda i: CASE WHEN vs[i][j] <> 0 THEN ns[i] * q[i] ELSE 0 END)))) AS g,
           list_transform(range(1, 11), lambda j: (4 + list_sum(list_transform(range(1, m + 1), lambda i: CASE WHEN vs[i][j] < 0 THEN ns[i] * (1 - q[i]) ELSE 0 END)))
             / (10 + list_sum(list_transform(range(1, m + 1), lambda i: CASE WHEN vs[i][j] <> 0 THEN ns[i] * (1 - q[i]) ELSE 0 END)))) AS b
    FROM em, held) WHERE step < 61),
believed AS (SELECT unnest(vs) AS v, unnest(q) AS posterior FROM em, held WHERE step = 61),
failing AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM voted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept
FROM failing JOIN believed USING (v)
"""
