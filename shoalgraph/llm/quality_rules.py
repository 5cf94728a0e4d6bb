"""Document quality by weak supervision, in DataFrame operations only.

Ten rules look at a text; each votes good (1) or bad (-1) or abstains (0). The votes form one of at most
3 ** 10 patterns, so the corpus reduces to a bounded table of pattern counts (one aggregate over all
rows). Expectation-maximisation on that table estimates the share of good texts and how often each rule votes good,
bad or not at all on either kind; the posterior probability of "good" for a pattern is broadcast back. No rule has a veto: a
bad vote of a rule that often errs is outvoted by good ones, and a text whose rules mostly keep silent, as they do on bad
texts, can go without any bad vote. Rule thresholds are fixed; what is estimated comes from all documents, without labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgraph.llm.runtime import cut, prepare, text_or_empty, unused

WINDOW = 8
SPACES = "[\\x20\\x09-\\x0D]+"
#: A word or number with the punctuation of prose.
PLAIN = "^[(\"'«“]*[\\p{L}\\p{N}][\\p{L}\\p{N}'’.,:-]*[!?;]?[)\"'»”]?\\z"
#: A line that ends as a sentence does.
ENDED = "[.!?:;\"'»”)][\\x20\\x09-\\x0D]*\\z"
#: Common function words of English, German, Spanish and French.
FUNCTION_WORDS = sorted(
    {
        *"the of and to in is that for it with as was on be are this by from at or".split(),
        *"der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als".split(),
        *"de la que el en y a los se del las un por con no una su para es al".split(),
        *"de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    }
)
RULES = ["symbols", "capitals", "shouting", "dup_lines", "repeats", "word_length", "length", "line_ends", "function_words", "plain_words"]
#: P(bad vote), P(no vote) and P(good vote) of any rule before anything is seen, on good and on bad texts, and the share of the
#: rows that this counts as.
PRIOR = {True: [0.05, 0.25, 0.70], False: [0.40, 0.25, 0.35]}
WEIGHT = 0.01
ROUNDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a run of WINDOW words found twice or more in the list."""

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"]))
            at = F.sort_array(F.array_compact(twice))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"))
            return F.aggregate(at, zero, step, lambda acc: acc["n"])

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of_sorted))

    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW))), covered))


def measures(text: Column) -> Column:
    """A struct of the counts that rules look at."""

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_intersect(w, F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function"),
            F.size(F.filter(w, lambda x: x.rlike(PLAIN))).cast("long").alias("n_plain"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda s: s.rlike(ENDED))).cast("long").alias("n_ended"),
        )

    return F.struct(
        let(F.array_remove(F.split(text, SPACES), ""), of_words).alias("w"),
        let(F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")), of_lines).alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("!!")).cast("long").alias("n_shouts"),
    )


def vote(bad: Column, good: Column | None = None) -> Column:
    said = F.when(bad, -1)
    return (said.when(good, 1) if good is not None else said).otherwise(0)


def votes(m: Column) -> list[Column]:
    """The rules, in the order of RULES."""
    n, lines = F.greatest(m["w"]["n_words"], F.lit(1)), F.greatest(m["l"]["n_lines"], F.lit(1))
    chars = F.greatest(m["w"]["word_chars"], F.lit(1))
    return [
        vote(10 * m["n_symbols"] > n, 100 * m["n_symbols"] <= n),
        vote(10 * m["n_capitals"] > 3 * chars, 10 * m["n_capitals"] <= chars),
        vote(50 * m["n_shouts"] > n),
        vote(10 * m["l"]["n_dup_lines"] > 3 * lines),
        vote(5 * m["w"]["n_repeat_words"] > n, m["w"]["n_repeat_words"] == 0),
        vote((2 * chars < 5 * n) | (chars > 14 * n), (2 * chars >= 7 * n) & (2 * chars <= 17 * n)),
        vote(m["w"]["n_words"] < 30, m["w"]["n_words"] >= 60),
        vote(5 * m["l"]["n_ended"] < lines, 5 * m["l"]["n_ended"] >= 4 * lines),
        vote(m["w"]["n_function"] == 0, m["w"]["n_function"] >= 4),
        vote(5 * m["w"]["n_plain"] < 4 * n, 20 * m["w"]["n_plain"] >= 19 * n),
    ]


def coded(m: Column) -> Column:
    """All votes as one number in base 3, the first rule's digit highest (0 bad, 1 none, 2 good)."""
    code = F.lit(0)
    for v in votes(m):
        code = code * 3 + v + 1
    return code.cast("int")


def digits(pattern: int) -> list[int]:
    """Votes (0 bad, 1 none, 2 good) of a pattern."""
    out = []
    for _ in RULES:
        pattern, d = divmod(pattern, 3)
        out.append(d)
    return out[::-1]


def posteriors(counts: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """P(good) of every pattern, by expectation-maximisation.

    A rule's vote (bad, none or good) is taken to be independent of the others' given the kind of text. It begins with the
    share of good votes among those cast, and then fits the share of good texts and each rule's votes on either
    kind; PRIOR, as so many rows as WEIGHT says, keeps which kind is which. Nothing else is fixed.
    """
    if not counts:
        return {}
    seen = {p: digits(p) for p in sorted(counts)}
    total = sum(counts.values())
    weight = WEIGHT * total + 1
    post = {p: (1 + d.count(2)) / (2 + d.count(2) + d.count(0)) for p, d in seen.items()}
    for _ in range(rounds):
        like = {}
        for c in PRIOR:
            mass = {p: n * (post[p] if c else 1 - post[p]) for p, n in sorted(counts.items())}
            whole = sum(mass.values()) + weight
            got = [[weight * x for x in PRIOR[c]] for _ in RULES]
            for p, d in seen.items():
                for j, v in enumerate(d):
                    got[j][v] += mass[p]
            like[c] = whole / (total + 2 * weight), [[x / whole for x in row] for row in got]
        for p, d in seen.items():
            logit = math.log(like[False][0] / like[True][0]) + sum(math.log(like[False][1][j][v] / like[True][1][j][v]) for j, v in enumerate(d))
            post[p] = 1 / (1 + math.exp(max(-700.0, min(700.0, logit))))
    return post


def base_failed(m: Column) -> Column:
    return (m["w"]["n_words"] < 20) | (100 * m["w"]["n_repeat_words"] > 30 * m["w"]["n_words"])


def judged(df: DataFrame, pattern: str, p_good: str) -> DataFrame:
    """Adds the posterior of the votes in the column ``pattern``; its counts are at most 3 ** 10 rows."""
    post = posteriors({r[pattern]: r["count"] for r in df.groupBy(pattern).count().collect()})
    table = df.sparkSession.createDataFrame(sorted(post.items()), f"`{pattern}` int, `{p_good}` double")
    return df.join(F.broadcast(table), pattern, "left")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Counts, base verdict and kept (p_good of at least ``least``, and not base_failed) of every document.

    A null or empty text has no words and is base_failed. Ids may be null or repeat, equal texts get equal verdicts. An empty
    table gives no rows; other columns don't matter.
    """
    prepare(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), let(text_or_empty(text_col), measures).alias("m"))
    found = cut(found.withColumn("pattern", coded(F.col("m"))))
    m = F.col("m")
    return judged(found, "pattern", "p_good").select(
        "doc_id",
        m["w"]["n_words"].alias("n_words"),
        m["w"]["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"),
        m["w"]["n_repeat_words"].alias("n_repeat_words"),
        base_failed(m).alias("base_failed"),
        (~base_failed(m) & (F.col("p_good") >= least)).alias("kept"),
        "p_good",
    )


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that quality_report() keeps, with all their columns (of any name) and in no shuffle.

    Null, empty and very short texts are base_failed and go; repeated rows all stay or all go; an empty table gives no rows. The
    documents are written once with their votes, so that texts are measured once.
    """
    prepare(docs.sparkSession)
    m, pattern, p_good = unused(docs, "m", "pattern", "p_good")
    measured = docs.withColumn(m, let(text_or_empty(text_col), measures))
    marked = cut(measured.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(base_failed(F.col(m)), -1).otherwise(1).alias(m), coded(F.col(m)).alias(pattern)))
    return judged(marked, pattern, p_good).where((F.col(m) > 0) & (F.col(p_good) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
