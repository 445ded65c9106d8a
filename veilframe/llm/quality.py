r"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains on a document.  Expectation-maximisation over the counts of vote
patterns estimates how often each rule votes and is right in either class, and the posterior probability
of the good class replaces a filter that all rules must pass.  With R rules there are at most 3^R
patterns, whatever the corpus holds, so their counts are all that reaches the driver.

Defined results: a null text counts as empty; an empty text has zero counts and fails the base rule; a null
id is kept; each repeated row is judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, stage_table, without_clashes

#: characters that count as symbols
SYMBOLS = "#*$%&|<>"
_SPACE_RUN = "[\\x20\\x09-\\x0D]+"
_SPACES = " \t\n\x0b\f\r"
#: frequent function words of the four languages of the corpus
FUNCTION_WORDS = "the of and to in is that for with on by was it as from are this be der die und das ist nicht mit von ein eine im den zu auch für le la les des de et est un une en que qui dans pour sur il elle par el los las del y una con no se su al es lo".split()
#: EM rounds; the estimates of a few thousand patterns settle well before
EM_ROUNDS = 50
#: a document is kept at this posterior probability of being good
KEEP_AT = 0.5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more: sort windows, compare neighbours."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("p")),
    )
    repeated = lambda s: F.array_sort(
        F.transform(
            F.filter(s, lambda x, j: F.coalesce(x["g"] == F.get(s, j - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, j + 1)["g"], F.lit(False))),
            lambda x: x["p"],
        )
    )
    covered = lambda d: F.aggregate(F.transform(d, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return F.when(n < 3, F.lit(0)).otherwise(_let(F.sort_array(windows), lambda s: _let(repeated(s), covered)))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``veil_q`` of the counts that the rules look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, _SPACE_RUN), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    symbol_free = F.translate(text, SYMBOLS, "")
    of_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_intersect(w, F.lit(FUNCTION_WORDS))).cast("long").alias("n_function"),
        ),
    )
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    raw = docs.withColumns({"veil_w": of_words, "veil_l": of_lines})
    return raw.withColumn(
        "veil_q",
        F.struct(
            F.col("veil_w.n_words"),
            F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(symbol_free)).cast("long").alias("n_symbols"),
            F.col("veil_l.n_dup_lines"),
            F.col("veil_w.n_repeat_words"),
            F.col("veil_w.n_function"),
            F.col("veil_l.n_lines"),
            (F.length(text) - F.length(F.regexp_replace(text, "[A-ZÀ-ÖØ-Þ]", ""))).cast("long").alias("n_upper"),
            (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_shout"),
        ),
    ).drop("veil_w", "veil_l")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(2))


def votes(q: str = "veil_q") -> list[Column]:
    """0 bad, 1 good, 2 abstains, for each rule. Ratios are compared by integer products."""
    c = lambda name: F.col(f"{q}.{name}")
    n = c("n_words")
    return [
        _vote(c("n_symbols") * 5 > n, c("n_symbols") * 50 <= n),
        _vote(c("n_dup_lines") * 10 > c("n_lines") * 3, c("n_dup_lines") * 20 <= c("n_lines")),
        _vote((c("word_chars") < n * 3) | (c("word_chars") > n * 12), (c("word_chars") >= n * 4) & (c("word_chars") <= n * 9)),
        _vote(c("n_repeat_words") * 5 > n, c("n_repeat_words") * 20 <= n),
        _vote(c("n_upper") * 10 > c("word_chars") * 3, c("n_upper") * 10 <= c("word_chars")),
        _vote(c("n_shout") * 10 > n, c("n_shout") == 0),
        _vote(c("n_function") < 2, c("n_function") >= 5),
    ]


def base_failed(q: str = "veil_q") -> Column:
    n = F.col(f"{q}.n_words")
    return (n < 50) | (F.col(f"{q}.n_repeat_words") * 100 > n * 50)


def fit(pattern_counts: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[list[float]]]:
    """EM for two classes with one-coin-per-class rules that may abstain.

    Returns the prior log odds of good, and per rule the log likelihood ratio good:bad of the votes
    0, 1 and 2.  Starts from the share of good votes; add-one smoothing keeps all ratios finite.  A rule whose
    good vote would speak for the bad class has no say.
    """
    if not pattern_counts:
        return 0.0, []
    n_rules = len(pattern_counts[0][0])
    post = []
    for pattern, _ in pattern_counts:
        good, bad = pattern.count(1), pattern.count(0)
        post.append((good + 0.5) / (good + 2 * bad + 1))  # one bad vote weighs as two good ones
    prior, ratios = 0.0, [[0.0] * 3 for _ in range(n_rules)]
    for _ in range(EM_ROUNDS):
        n_good = sum(c * p for (_, c), p in zip(pattern_counts, post))
        n_bad = sum(c * (1 - p) for (_, c), p in zip(pattern_counts, post))
        prior = math.log((n_good + 1) / (n_bad + 1))
        for j in range(n_rules):
            by_good, by_bad = [1.0] * 3, [1.0] * 3
            for (pattern, c), p in zip(pattern_counts, post):
                by_good[pattern[j]] += c * p
                by_bad[pattern[j]] += c * (1 - p)
            ratios[j] = [math.log(by_good[v] / (n_good + 3)) - math.log(by_bad[v] / (n_bad + 3)) for v in range(3)]
            if ratios[j][1] < ratios[j][0]:
                ratios[j] = [0.0] * 3
        post = [1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(r[v] for r, v in zip(ratios, pattern)))))) for pattern, _ in pattern_counts]
    return prior, ratios


def fit_on(featured: DataFrame) -> tuple[float, list[list[float]]]:
    """``fit`` on the vote patterns of all documents that pass the base rule."""
    n_rules = len(votes())
    counted = featured.where(~base_failed()).select(*[v.alias(f"v{j}") for j, v in enumerate(votes())]).groupBy(*[f"v{j}" for j in range(n_rules)]).count()
    return fit(sorted((tuple(row[:n_rules]), row["count"]) for row in counted.collect()))


def posterior(model: tuple[float, list[list[float]]]) -> Column:
    """Probability of good; sums rounded so that the verdict does not hang on the order of additions."""
    prior, ratios = model
    score = F.lit(float(prior))
    for vote, r in zip(votes(), ratios):
        score = score + F.when(vote == 0, F.lit(float(r[0]))).when(vote == 1, F.lit(float(r[1]))).otherwise(F.lit(float(r[2])))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-score)), 9)


def judged(featured: DataFrame) -> DataFrame:
    """Adds ``veil_good`` (posterior) and ``veil_kept`` to a table with ``veil_q``."""
    good = posterior(fit_on(featured))
    return featured.withColumn("veil_good", good).withColumn("veil_kept", ~base_failed() & (F.col("veil_good") >= KEEP_AT))


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    docs, named_back = without_clashes(docs)
    return named_back(judged(stage_table(with_features(docs, text_col), "quality")).where("veil_kept").select(*docs.columns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = stage_table(with_features(documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "quality")
    return judged(featured).select(
        "doc_id",
        *[F.col(f"veil_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"),
        F.col("veil_kept").alias("kept"),
        F.col("veil_good").alias("p_good"),
    )
