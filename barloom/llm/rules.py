"""Quality rules combined by weak supervision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import GAP, let, stored

#: Rules in order: (name, measure, good up to, bad from); between the two a rule abstains.
RULES = (
    ("long_words", "word_chars / n_words", 12.0, 18.0),
    ("symbols", "n_symbols / n_words", 0.05, 0.3),
    ("repeated_words", "n_repeat_words / n_words", 0.15, 0.35),
    ("repeated_lines", "n_dup_lines / n_lines", 0.2, 0.6),
    ("capitals", "n_capitals / word_chars", 0.2, 0.5),
    ("exclamations", "n_exclamations / n_words", 0.1, 0.5),
)
ROUNDS = 20
#: Beliefs that the estimate starts from, as (start, least, most): the share of good documents, how often a vote
#: on a good document says good, and how often one on a bad document says bad. The rules are
#: cut so that few good documents fail any of them, and most kinds of bad ones fail few.
PRIOR, PASSES, CATCHES = (0.8, 0.05, 0.95), (0.995, 0.995, 0.9999), (0.3, 0.05, 0.95)
#: Weight of the starting beliefs, in votes.
BELIEF = 10.0


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur more than once.

    Windows are sorted by hash; neighbours of equal hash count if their words agree.
    """
    count = F.size(words)

    def window(i):
        return F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))

    def marked(ranked):
        def same(x, y):
            equal = [words[x["i"] + k] == words[y["i"] + k] for k in range(3)]
            return F.coalesce((x["h"] == y["h"]) & equal[0] & equal[1] & equal[2], F.lit(False))

        def start(x, k):
            return F.when(same(x, F.get(ranked, k - 1)) | same(x, F.get(ranked, k + 1)), x["i"])

        starts = F.filter(F.transform(ranked, start), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    windows = F.transform(F.sequence(F.lit(0), count - 3), window)
    return F.when(count < 3, F.lit(0)).otherwise(let(F.sort_array(windows), marked))


def _only(text: Column, kept: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def measures(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds the counts that the rules look at; NULL texts count as empty. Whole texts, no Python."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        )

    def lined(x):
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    found = docs.withColumns({"_w": let(words, counted), "_l": let(lines, lined)})
    return found.select(
        *docs.columns,
        "_w.n_words",
        "_w.word_chars",
        _only(text, "#*$%&|<>").alias("n_symbols"),
        "_l.n_dup_lines",
        "_w.n_repeat_words",
        "_l.n_lines",
        _only(text, r"\p{Lu}").alias("n_capitals"),
        _only(text, "!").alias("n_exclamations"),
    )


def votes() -> Column:
    """1, -1 or 0 (abstain) of every rule, for a document with words."""
    return F.array(
        *[
            F.when(F.expr(measure) <= good, 1).when(F.expr(measure) >= bad, -1).otherwise(0)
            for _, measure, good, bad in RULES
        ]
    )


def posterior(cast: Column, state: Column) -> Column:
    """Probability that a document is good: each vote adds the log of how much likelier good documents get it."""

    def evidence(v, rule):
        says_good = F.log(rule["passes"] / (1 - rule["catches"]))
        says_bad = F.log((1 - rule["passes"]) / rule["catches"])
        return F.when(v == 1, says_good).when(v == -1, says_bad).otherwise(0.0)

    weighed = F.zip_with(cast, state["rules"], evidence)
    start = F.log(state["prior"] / (1 - state["prior"]))
    return 1 / (1 + F.exp(-F.aggregate(weighed, start, lambda x, y: x + y)))


def accuracies(judged: DataFrame) -> DataFrame:
    """One row, one struct ``state`` (prior; passes and catches of each rule), by expectation-maximisation.

    Documents with the same votes weigh as one pattern; there are at most 3 to the number of rules
    of them, so the whole estimate is one fold over an array. Expectation: the probability that each
    pattern's documents are good. Maximisation: how often each rule's votes agree with that,
    for good and for bad documents apart, since a rule that misses most kinds of bad
    documents can still be right whenever it objects.
    """
    patterns = judged.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    held = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))

    def total(rows, value):
        return F.aggregate(rows, F.lit(0.0), lambda sum_, row: sum_ + value(row))

    def share(belief, hits, all_):
        start, low, high = belief
        return F.greatest(F.lit(low), F.least(F.lit(high), (start * BELIEF + hits) / (BELIEF + all_)))

    def step(state, _):
        scored = F.transform(
            "patterns",
            lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(p["votes"], state).alias("good")),
        )

        def updated(rows):
            def rule(k):
                def mass(vote, weight):
                    return total(rows, lambda r: F.when(r["votes"][k] == vote, r["n"] * weight(r)).otherwise(0.0))

                good_up, good_down = mass(1, lambda r: r["good"]), mass(-1, lambda r: r["good"])
                bad_up, bad_down = mass(1, lambda r: 1 - r["good"]), mass(-1, lambda r: 1 - r["good"])
                return F.struct(
                    share(PASSES, good_up, good_up + good_down).alias("passes"),
                    share(CATCHES, bad_down, bad_up + bad_down).alias("catches"),
                )

            prior = share(PRIOR, total(rows, lambda r: r["n"] * r["good"]), total(rows, lambda r: r["n"]))
            return F.struct(prior.alias("prior"), F.array(*[rule(k) for k in range(len(RULES))]).alias("rules"))

        return let(scored, updated)

    first = F.struct(F.lit(PASSES[0]).alias("passes"), F.lit(CATCHES[0]).alias("catches"))
    start = F.struct(F.lit(PRIOR[0]).alias("prior"), F.array(*[first] * len(RULES)).alias("rules"))
    return held.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("state"))


def judge(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds the measures, ``quality`` (the posterior), ``base_failed`` and ``kept`` to every document.

    The text column is dropped: measures are written once, and votes are estimated over all documents
    with words. A document without words fails the base rules; its quality is NULL.
    Repeated rows are judged alike; columns named like a new one are replaced.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations"}
    kept = [c for c in docs.columns if c not in new]
    measured = stored(measures(docs.select(*kept), text_col=text_col).drop(text_col), "measures")
    judged = measured.withColumn("votes", F.when(F.col("n_words") > 0, votes()))
    state = accuracies(judged.filter("votes is not null"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = judged.withColumn("_state", state.scalar())
    quality = posterior(F.col("votes"), F.col("_state"))
    return scored.withColumns({"quality": quality, "base_failed": failed}).select(
        *[c for c in scored.columns if c not in ("_state", "quality", "base_failed", "kept")],
        "quality",
        "base_failed",
        F.coalesce(~F.col("base_failed") & (F.col("quality") >= threshold), F.lit(False)).alias("kept"),
    )
