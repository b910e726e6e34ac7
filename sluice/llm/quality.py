"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a predicate over a text's counts. Each rule's cost and selectivity are estimated on a sample; the rules then
run in the order of rejection per cost over one array of the text's words, and a row that one rule rejects is not
shown to the next. The verdict does not depend on the order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.runtime import WS, documents, trimmed, words

SYMBOLS = "#*$%&|<>"


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once per row, not once per element of the loops within."""
    return F.transform(F.array(value), use)[0]


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, WS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")


def n_dup_lines(text: Column) -> Column:
    return bound(worded_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def windows(word: Column) -> Column:
    """Hashes of the 3-word windows of the array `word`, which has three words or more."""
    return F.transform(F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)))


def repeats(window: Column) -> Column:
    """How many windows are found earlier in the array."""
    return F.size(window) - F.size(F.array_distinct(window))


def covered(window: Column) -> Column:
    """Words in windows found twice or more.

    Windows are sorted by hash and position; equal neighbours repeat; each repeated start covers three words, or as
    many as there are before the next repeated start.
    """

    def starts(s):
        h = lambda i: F.get(s, i).getField("h")
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(h(i) == h(i - 1), F.lit(False)) | F.coalesce(h(i) == h(i + 1), F.lit(False)))
        return F.sort_array(F.transform(again, lambda i: F.get(s, i).getField("p")))

    def words_of(p):
        step = lambda i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), F.get(p, i) + 3) - F.get(p, i))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, i: acc + step(i)))

    sorted_ = F.sort_array(F.transform(window, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return bound(sorted_, lambda s: bound(starts(s), words_of))


def n_repeat_words(word: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more in the array `word`."""
    count = lambda w: bound(windows(w), lambda h: F.when(repeats(h) == 0, F.lit(0)).otherwise(covered(h)))
    return bound(word, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(count(w))).cast("long")


class Counts:
    """What rules look at, of a text and the array of its words. Columns are expressions: what a rule doesn't name, or
    isn't reached, is not computed."""

    def __init__(self, text: Column, word: Column):
        self.text, self.word = text, word

    @property
    def n_words(self) -> Column:
        return F.size(self.word).cast("long")

    @property
    def word_chars(self) -> Column:
        return word_chars(self.text)

    @property
    def n_symbols(self) -> Column:
        return n_symbols(self.text)

    def repeat_words_over(self, percent: int) -> Column:
        """100 * n_repeat_words > percent * n_words. A window that r others repeat makes r + 1 <= 2 r windows of at most
        three words, so few repeats decide without the words' positions."""

        def over(w: Column) -> Column:
            n = F.size(w)
            few = lambda h: 600 * repeats(h).cast("long") <= percent * n
            return F.when(n < 3, F.lit(False)).otherwise(bound(windows(w), lambda h: F.when(few(h), F.lit(False)).otherwise(100 * covered(h).cast("long") > percent * n)))

        return bound(self.word, over)

    def dup_lines_over(self, percent: int) -> Column:
        """100 * n_dup_lines > percent * lines with a word."""
        return bound(worded_lines(self.text), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > percent * F.size(x))


class Counted(Counts):
    """The same where the counts are columns already."""

    def __init__(self):
        pass

    n_words = property(lambda self: F.col("n_words"))
    word_chars = property(lambda self: F.col("word_chars"))
    n_symbols = property(lambda self: F.col("n_symbols"))

    def repeat_words_over(self, percent: int) -> Column:
        return 100 * F.col("n_repeat_words") > percent * F.col("n_words")

    def dup_lines_over(self, percent: int) -> Column:
        return 100 * F.col("n_dup_lines") > percent * F.col("_lines")


@dataclass(frozen=True)
class Rule:
    """rejects: of a text's counts, a boolean Column that is never null. cost: of the same, about the nanoseconds that
    the rule takes over the text, given its words; by the text's length where a rule doesn't say."""

    name: str
    rejects: Callable[[Counts], Column]
    cost: Callable[[Counts], Column] = lambda c: CHARACTER * F.length(c.text)


@dataclass(frozen=True)
class Estimate:
    """cost: nanoseconds a row of the sample; rejected: share of the sample."""

    rule: Rule
    cost: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.cost, 1.0)


#: Nanoseconds of one step, measured on one core: a character that is looked at, or is split off with its line and
#: stripped; a word's window that is hashed and told apart. Prices are fixed and steps are counted, so the order is the
#: same in each run.
CHARACTER, LINE_CHARACTER, WINDOW = 40, 30, 1000


def default_rules(*, min_words: int = 50, repeat_pct: int = 50, symbol_pct: int = 30, dup_line_pct: int = 50, mean_len: tuple[float, float] = (2.5, 12.0)) -> list[Rule]:
    low, high = mean_len
    return [
        Rule("few_words", lambda c: c.n_words < min_words, lambda c: F.lit(CHARACTER)),
        Rule("repeated_words", lambda c: c.repeat_words_over(repeat_pct), lambda c: WINDOW * c.n_words),
        Rule("symbols", lambda c: 100 * c.n_symbols > symbol_pct * c.n_words),
        Rule("repeated_lines", lambda c: c.dup_lines_over(dup_line_pct), lambda c: LINE_CHARACTER * F.length(c.text)),
        Rule("word_length", lambda c: (c.word_chars < low * c.n_words) | (c.word_chars > high * c.n_words)),
    ]


def estimate(docs: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = 2000, seed: int = 11) -> list[Estimate]:
    """Cost and selectivity of each rule on a seeded sample of about `rows` rows (all, where there are no more); best
    order first, ties by name. Every task samples its own rows and sums them up, so no task gets the sample."""
    n = docs.count()
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_t"))
    if n > rows:
        sample = sample.sample(rows / n, seed)
    c = Counts(F.col("_t"), F.col("_w"))
    parts = [x for i, r in enumerate(rules) for x in (r.rejects(c).cast("int").alias(f"hit{i}"), r.cost(c).cast("double").alias(f"cost{i}"))]
    got = sample.withColumn("_w", words(F.col("_t"))).select(*parts).agg(*(F.avg(f"{k}{i}").alias(f"{k}{i}") for i in range(len(rules)) for k in ("hit", "cost"))).first()
    out = [Estimate(rule, got[f"cost{i}"] or 0.0, got[f"hit{i}"] or 0.0) for i, rule in enumerate(rules)]
    return sorted(out, key=lambda e: (-e.rank, e.cost, e.rule.name))


def cascade(order: Sequence[Rule], counts: Counts) -> Column:
    """Name of the first rule, in this order, that rejects the row; null if none. Later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(rule.rejects(counts), F.lit(rule.name)).otherwise(out)
    return out


def quality_filter(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", **sample) -> DataFrame:
    """docs that no rule rejects. Null and empty texts have no words and so fall to the first base rule; texts of any
    length are judged whole; an empty table stays empty; other columns, whatever their names, pass through; equal rows
    share a verdict. The words are split once a row, and no row is shuffled."""
    order = [e.rule for e in estimate(docs, rules or default_rules(), text, **sample)]
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.where(bound(words(t), lambda w: cascade(order, Counts(t, w))).isNull())


def op2_quality_rules(spark, sf_dir):
    """The contract returns every count of every row, so here the cascade runs over counts that are there: it decides
    `kept` in the estimated order, but has no counting to save. quality_filter() saves it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = default_rules()
    order = [e.rule for e in estimate(docs, rules)]
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", t.alias("_t"), words(F.col("text")).alias("_w"), worded_lines(t).alias("_l"))
    rows = rows.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        word_chars(F.col("_t")).alias("word_chars"),
        n_symbols(F.col("_t")).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
    )
    counts = Counted()
    base = [r.rejects(counts) for r in rules if r.name in ("few_words", "repeated_words")]
    return rows.withColumns({"base_failed": base[0] | base[1], "kept": cascade(order, counts).isNull()}).drop("_lines")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM p),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS lines
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * lines
            OR word_chars < 2.5 * n_words OR word_chars > 12.0 * n_words) AS kept FROM b
"""
