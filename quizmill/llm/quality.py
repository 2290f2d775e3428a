"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes that a text is fit (1), unfit (-1) or abstains (0). Nobody says how far a rule can be
trusted: expectation-maximisation estimates, from how the rules agree over the whole corpus, how often
each one votes each way on fit and on unfit texts. A text is kept if its posterior probability of being
fit reaches ``threshold``.

The votes of all texts are first summed to one row per vote pattern (3 to the number of rules at most,
whatever the corpus' size), and the iterations run over that list inside one ``aggregate`` expression.
Texts that fail the base rule are decided by it and don't shape the estimates.

Defined results: a null, empty or blank text has no words, fails the base rule and is not kept; it
still votes, as unfit where a rule looks at its length. Equal texts get equal results, repeated rows
stay repeated. An empty table gives an empty result. Columns whose names clash with results are
replaced in ``label``'s output, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.storage import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ITERATIONS = 30
#: Where the estimates begin: the share of fit texts, and how often a rule of each kind votes
#: [-1, 0, 1] on fit and on unfit texts.
PRIOR = 0.85
DEFECT = [0.01, 0.98, 0.01, 0.30, 0.69, 0.01]
PRAISE = [0.01, 0.09, 0.90, 0.01, 0.49, 0.50]
#: The beginning keeps the weight of this share of the texts (a Dirichlet prior), so that a class
#: can't drift away to some other split of the corpus.
WEIGHT = 0.5


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Positions covered by three-word windows that occur twice or more in ``words``.

    Windows are compared by 64-bit hashes. Only texts in which some hash repeats are sorted.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.xxhash64(words[i - 1], words[i], words[i + 1]),
    )

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            marked = F.transform(
                p,
                lambda x, k: F.when(
                    (F.get(p, k - 1)["h"] == x["h"])
                    | (F.get(p, k + 1)["h"] == x["h"]),
                    x["i"],
                ),
            )
            return F.sort_array(F.filter(marked, lambda v: v.isNotNull()))

        def total(s: Column) -> Column:
            # each window adds the words that the one before it doesn't already cover
            return F.aggregate(
                s,
                F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
                lambda a, i: F.struct(
                    i.alias("last"), (a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum")
                ),
                lambda a: a["sum"],
            )

        return _let(_let(pairs, starts), total)

    return F.when(n < 3, F.lit(0)).otherwise(
        _let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
        )
    )


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts and what the rules look at, one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blanks = " \t\n\x0b\x0c\r"

    def counts(t: Column, words: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(words),
            "word_chars": F.char_length(F.translate(t, blanks, "")),
            "n_symbols": _count(t, SYMBOLS),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_lines": F.size(lines),
            "n_upper": F.char_length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
            "n_marks": _count(t, ".!?;,"),
            "n_exclaim": _count(t, "!"),
            "n_distinct": F.size(F.array_distinct(words)),
        }
        return F.struct(*(v.cast("bigint").alias(k) for k, v in found.items()))

    split = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(
        F.split(text, "\n"), lambda x: F.char_length(F.translate(x, blanks, "")) > 0
    )
    # bound to lambda variables: as columns, Spark may work out the split again for every word
    found = _let(text, lambda t: _let(split, lambda w: _let(lines, lambda x: counts(t, w, x))))
    return (
        docs.select(F.col(id_col), found.alias("_found"))
        .select(F.col(id_col), "_found.*")
        .withColumn("base_failed", base_failed())
    )


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)


def _unfit(when: Column) -> Column:
    return F.when(when, F.lit(-1)).otherwise(F.lit(0))


def _fit(when: Column) -> Column:
    return F.when(when, F.lit(1)).otherwise(F.lit(0))


def rules() -> list[tuple[str, Column, list[float]]]:
    """Name, vote and first estimates of each rule, over the columns of ``measures``; whole-number comparisons.

    A rule that looks for one defect abstains without it: its absence says little.
    """
    c = F.col
    words, chars = c("n_words"), c("word_chars")
    return [
        ("symbols", _unfit(20 * c("n_symbols") > chars), DEFECT),
        ("capitals", _unfit(3 * c("n_upper") > chars), DEFECT),
        ("shouting", _unfit(4 * c("n_exclaim") > words), DEFECT),
        ("repeats", _unfit(5 * c("n_repeat_words") > 2 * words), DEFECT),
        ("monotony", _unfit(8 * c("n_distinct") < words), DEFECT),
        ("lines", _unfit(3 * c("n_dup_lines") > c("n_lines")), DEFECT),
        ("word_length", _unfit((chars < 2 * words) | (chars > 12 * words)), DEFECT),
        ("plain", _fit((50 * c("n_symbols") <= chars) & (words > 0)), PRAISE),
        ("calm", _fit((5 * c("n_upper") <= chars) & (20 * c("n_exclaim") <= words) & (words > 0)), PRAISE),
        ("varied", _fit((5 * c("n_repeat_words") <= 2 * words) & (5 * c("n_distinct") >= words) & (words > 0)), PRAISE),
        ("sentences", _fit((c("n_marks") > 0) & (100 * c("n_marks") >= words) & (2 * c("n_marks") <= words)), PRAISE),
    ]


def fit(patterns: DataFrame, first: list[list[float]]) -> DataFrame:
    """One row: the model after ``ITERATIONS`` rounds over rows of (votes, n).

    ``prior`` is the share of fit texts; ``rates[r]`` holds how often rule r votes -1, 0 and 1 on fit
    and on unfit texts, as [fit -1, fit 0, fit 1, unfit -1, unfit 0, unfit 1].
    """
    listed = patterns.agg(
        F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("all")
    )
    begun = F.array(*(F.array(*map(F.lit, rule)) for rule in first))
    begin = F.struct(F.lit(PRIOR).alias("prior"), begun.alias("rates"))

    def step(model: Column, _: Column) -> Column:
        weighed = F.transform(
            F.col("all"),
            lambda p: F.struct(
                p["votes"].alias("votes"),
                p["n"].alias("n"),
                (p["n"] * posterior(p["votes"], model)).alias("fit"),
            ),
        )

        def update(ps: Column) -> Column:
            total = _sum(ps, lambda p: p["n"])
            fit_n = _sum(ps, lambda p: p["fit"])

            def rate(rule: Column, r: Column) -> Column:
                def share(at: int, vote: int, good: bool) -> Column:
                    def mass(p: Column) -> Column:
                        part = p["fit"] if good else p["n"] - p["fit"]
                        return F.when(p["votes"][r] == vote, part).otherwise(F.lit(0.0))

                    whole, own = (fit_n, PRIOR) if good else (total - fit_n, 1 - PRIOR)
                    weight = total * WEIGHT * own
                    return (_sum(ps, mass) + weight * rule[at]) / (whole + weight)

                cells = [(g, v) for g in (True, False) for v in (-1, 0, 1)]
                return F.array(*(share(k, v, g) for k, (g, v) in enumerate(cells)))

            return F.struct(
                ((fit_n + total * WEIGHT * PRIOR) / (total + total * WEIGHT)).alias("prior"),
                F.transform(begun, rate).alias("rates"),
            )

        return _let(weighed, update)

    return listed.select(
        F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), begin, step).alias("model")
    )


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + value(x))


def posterior(votes: Column, model: Column) -> Column:
    """Probability that a text with these votes is fit."""
    odds = F.aggregate(
        F.transform(votes, lambda v, r: F.struct(v.alias("v"), model["rates"][r].alias("p"))),
        F.log(model["prior"]) - F.log(1 - model["prior"]),
        lambda a, x: a + F.log(x["p"][x["v"] + 1]) - F.log(x["p"][x["v"] + 4]),
    )
    return 1 / (1 + F.exp(-odds))


def label(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """Per input row: the measures, ``votes``, ``quality`` (posterior) and ``kept``."""
    named = rules()
    seen = materialize(
        measures(docs, id_col, text_col).withColumn("votes", F.array(*(v for _, v, _ in named))),
        "quality",
    )
    patterns = seen.groupBy("votes").agg(
        F.sum(F.when(~F.col("base_failed"), 1).otherwise(0)).alias("n")
    )
    scored = patterns.crossJoin(F.broadcast(fit(patterns, [begin for _, _, begin in named]))).select(
        "votes", posterior(F.col("votes"), F.col("model")).alias("quality")
    )
    # one row per vote pattern: at most 3 to the number of rules
    out = seen.join(F.broadcast(scored), "votes")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return label(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def _oracle() -> str:
    """The same in DuckDB: counts by unnesting words, the estimates by a recursive query."""
    bad = [
        "20 * n_symbols > word_chars", "3 * n_upper > word_chars", "4 * n_exclaim > n_words",
        "5 * n_repeat_words > 2 * n_words", "8 * n_distinct < n_words", "3 * n_dup_lines > n_lines",
        "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    ]
    good = [
        "50 * n_symbols <= word_chars", "5 * n_upper <= word_chars AND 20 * n_exclaim <= n_words",
        "5 * n_repeat_words <= 2 * n_words AND 5 * n_distinct >= n_words",
        "n_marks > 0 AND 100 * n_marks >= n_words AND 2 * n_marks <= n_words",
    ]
    votes = [f"CASE WHEN {x} THEN -1 ELSE 0 END" for x in bad]
    votes += [f"CASE WHEN n_words > 0 AND {x} THEN 1 ELSE 0 END" for x in good]
    start = str([DEFECT] * len(bad) + [PRAISE] * len(good))
    rule = f"range(1, {len(votes) + 1})"
    odds = (
        f"(ln(prior) - ln(1 - prior) + list_sum(list_transform({rule}, "
        "lambda r: ln(rates[r][{v}[r] + 2]) - ln(rates[r][{v}[r] + 5]))))"
    )
    share = (
        "(list_sum(list_transform(range(1, len(a) + 1), lambda k: CASE WHEN a[k].v[r] = {vote} THEN {mass} ELSE 0 END))"
        f" + total * {WEIGHT} * {{own}} * first[r][{{at}}]) / ({{whole}} + total * {WEIGHT} * {{own}})"
    )
    cells = ", ".join(
        share.format(vote=vote, mass=mass, own=own, whole=whole, at=3 * k + vote + 2)
        for k, (mass, own, whole) in enumerate([("f[k]", PRIOR, "fit"), ("a[k].n - f[k]", 1 - PRIOR, "(total - fit)")])
        for vote in (-1, 0, 1)
    )
    return rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
tok AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
tri AS (SELECT doc_id, i, word, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^.!?;,]', '', 'g')) AS n_marks, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim, len(list_distinct(words)) AS n_distinct
    FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{', '.join(votes)}] AS votes FROM m),
p AS (SELECT votes, count(*) FILTER (NOT base_failed)::DOUBLE AS n FROM b GROUP BY votes),
l AS (SELECT list({{'v': votes, 'n': n}} ORDER BY votes) AS a, sum(n) AS total, {start}::DOUBLE[][] AS first FROM p),
e(step, prior, rates) AS (
    SELECT 0, {PRIOR}::DOUBLE, first FROM l
    UNION ALL
    SELECT step + 1, (fit + total * {WEIGHT} * {PRIOR}) / (total + total * {WEIGHT}), list_transform({rule}, lambda r: [{cells}])
    FROM (SELECT *, list_sum(f) AS fit FROM (
        SELECT *, list_transform(a, lambda x: x.n / (1 + exp(-{odds.format(v='x.v')}))) AS f FROM e, l WHERE step < {ITERATIONS}))),
q AS (SELECT votes, 1 / (1 + exp(-{odds.format(v='votes')})) AS quality FROM p, (SELECT prior, rates FROM e WHERE step = {ITERATIONS}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept
FROM b JOIN q USING (votes)"""


SQL = _oracle()
