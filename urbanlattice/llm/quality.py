"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition over a text's counts under which the document is rejected.
On a bounded sample every rule is timed and its share of rejections measured; the
cascade then asks the rules in order of rejections per cost, and a document that one
rule rejects reaches no later one (CASE WHEN evaluates lazily). The order changes
what the cascade costs, never its verdict.

A null text has no words. An empty table gives no rows; the rules then keep their
given order. Other columns pass through, whatever their names; repeated rows, and rows
that share an id or have none, get each their own text's verdict. Texts are judged
whole, however long.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Shield, hold, scratch, text_or_empty, written

SYMBOLS = "#*$%&|<>"
NOT_LETTERS = "".join(c for c in map(chr, range(1, 128)) if not c.isalpha())
WINDOW = 8
#: Rows of the sample on which costs and rejections are measured, about.
SAMPLE_ROWS = 1000


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text that is not null."""
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_letters(text: Column) -> Column:
    """Characters that are ASCII letters or not ASCII."""
    return F.char_length(F.translate(text, NOT_LETTERS, "")).cast("long")


def n_distinct_words(words: Column) -> Column:
    return F.size(F.array_distinct(words)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(word_hashes: Column, size: int = WINDOW) -> Column:
    """64-bit hashes of each window of ``size`` words, given the words' hashes; none if there are fewer."""
    n = F.size(word_hashes)
    at = F.when(n >= size, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(size)]))


def covered(sorted_windows: Column, size: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more; ``sorted_windows``: (hash, position) in order."""
    twice = F.filter(
        sorted_windows,
        lambda x, i: F.coalesce(F.get(sorted_windows, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_windows, i + 1)["h"] == x["h"], F.lit(False)),
    )
    starts = F.array_sort(F.transform(twice, lambda x: x["p"]))
    total = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-size).alias("end")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p + size - a["end"])).alias("n"), (p + size).alias("end")),
    )
    return total["n"].cast("long")


def with_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _text and _words, on which the rules' counts build."""
    return hold(df.withColumn("_text", text_or_empty(text_col)), "_words", words_of(F.col("_text")))


def with_windows(df: DataFrame, words: str = "_words") -> DataFrame:
    """Adds _windows: the windows' hashes."""
    return hold(with_hashes(df, words), "_windows", window_hashes(F.col("_hashes")))


def with_hashes(df: DataFrame, words: str = "_words") -> DataFrame:
    return hold(df, "_hashes", F.transform(words, lambda w: F.xxhash64(w)))


def order_of(windows: Column) -> Column:
    """Null if no window occurs twice: only texts with repeats pay for the order."""
    return F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
    )


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text."""
    return _counted(df, text_col).drop("_text", "_words")


def _counted(df: DataFrame, text_col: str) -> DataFrame:
    at = hold(with_windows(with_words(df, text_col)), "_ordered", order_of(F.col("_windows")))
    text, words = F.col("_text"), F.col("_words")
    return at.select(
        *df.columns,
        "_text",
        "_words",
        n_words(words).alias("n_words"),
        word_chars(text).alias("word_chars"),
        n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
        F.explode(F.array(F.when(F.col("_ordered").isNull(), F.lit(0).cast("long")).otherwise(covered(F.col("_ordered"))))).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a function from a count's name to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: The limits are loose on purpose: they take out texts of marks, of one repeated phrase or of list fragments.
RULES = [
    Rule("too_few_words", lambda c: c("n_words") < 20),
    Rule("repeated_windows", lambda c: 100 * c("n_repeat_words") > 30 * c("n_words")),
    Rule("word_length", lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
    Rule("symbols", lambda c: 4 * c("n_symbols") > c("n_words")),
    Rule("repeated_lines", lambda c: (c("n_dup_lines") >= 3) & (20 * c("n_dup_lines") > c("n_words"))),
    Rule("few_distinct_words", lambda c: 20 * c("n_distinct_words") < c("n_words")),
    Rule("few_letters", lambda c: 2 * c("n_letters") < c("word_chars")),
]
BASE_RULES = ("too_few_words", "repeated_windows")


def lazy_counts() -> dict[str, Column]:
    """Counts as expressions over _text and _words, evaluated by the rules that ask for them."""
    text, words = F.col("_text"), F.col("_words")
    return {
        "n_words": n_words(words),
        "word_chars": word_chars(text),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_distinct_words": n_distinct_words(words),
        "n_letters": n_letters(text),
    }


def measured_order(df: DataFrame, text_col: str, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) in order of rejections per cost, from a sample of about ``sample_rows`` rows.

    The sample is drawn by a hash of the text, so that it's the same in each run; copies of one text count once."""
    rows = df.count()
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]
    share = min(1.0, sample_rows / rows)
    some = df.select(text_or_empty(text_col).alias("_t")).where(F.pmod(F.xxhash64("_t"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).distinct()
    out = []
    with scratch():
        # the sample's texts stay in the shared folder: their number is bounded, their bytes aren't
        sample = written(some, "rule-sample")
        size = sample.count()
        if not size:
            return [(r, 0.0, 0.0) for r in rules]
        at = with_words(sample.repartition(2), "_t")

        def timed(rule: list[Rule]) -> tuple[float, int]:
            began = time.perf_counter()
            rejected = cascade_column(at, rule).where(F.col("_reason").isNotNull()).count() if rule else at.where(F.size("_words") < 0).count()
            return time.perf_counter() - began, rejected

        # a rule's cost is what it takes besides the job itself: reading the sample and its words
        job = timed([])[0]
        for r in rules:
            took, rejected = timed([r])
            out.append((r, max(took - job, 1e-3), rejected / size))
    return sorted(out, key=lambda x: -x[2] / max(x[1], 1e-6))


def cascade_column(at: DataFrame, rules: list[Rule], ready: dict[str, Column] | None = None) -> DataFrame:
    """Adds _reason: the first of the rules, in this order, that rejects the row. No later rule is evaluated for it.

    ``ready``: counts that ``at`` already holds; the others are computed for the rows that reach a rule which asks for them."""
    counts = lazy_counts() | (ready or {})
    case = None
    for r in rules:
        asked: list[str] = []
        r.rejects(lambda name, asked=asked: asked.append(name) or F.lit(1))
        if "n_repeat_words" in asked and "n_repeat_words" not in counts:
            # rows already rejected don't pay for the windows
            at = hold(at, "_so_far", F.lit(None).cast("string") if case is None else case)
            at = hold(at, "_hashes", F.when(F.col("_so_far").isNull(), F.transform("_words", lambda w: F.xxhash64(w))))
            at = hold(at, "_windows", F.when(F.col("_so_far").isNull(), window_hashes(F.col("_hashes"))))
            at = hold(at, "_ordered", order_of(F.col("_windows")))
            counts["n_repeat_words"] = F.when(F.col("_ordered").isNull(), F.lit(0).cast("long")).otherwise(covered(F.col("_ordered")))
            case = F.when(F.col("_so_far").isNotNull(), F.col("_so_far"))
        hit = r.rejects(counts.__getitem__)
        case = F.when(hit, F.lit(r.name)) if case is None else case.when(hit, F.lit(r.name))
    return hold(at, "_reason", case if case is not None else F.lit(None).cast("string"))


def cascade(df: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, reason: str = "reason") -> DataFrame:
    """``df`` with the column ``reason``: the rule that rejects the row, null if none does."""
    if reason in df.columns:
        raise ValueError(f"the table has a column {reason}; name another for the rule")
    at, asked = _asked(df, text_col, rules, sample_rows)
    return asked.select(*at.back, F.col("_reason").alias(reason))


def passed(df: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with their columns."""
    at, asked = _asked(df, text_col, rules, sample_rows)
    return asked.where("_reason IS NULL").select(*at.back)


def _asked(df: DataFrame, text_col: str, rules: list[Rule], sample_rows: int) -> tuple[Shield, DataFrame]:
    order = [r for r, _, _ in measured_order(df, text_col, rules, sample_rows)]
    at = Shield(df)
    return at, cascade_column(with_words(at.df, at.of[text_col]), order)


#: Counts that a verdict comes with, of every row.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, counts, base_failed, kept, reason) of each row: COUNTS of all rows, and the cascade's verdict in the measured order.

    Rules over COUNTS find them ready; what others ask for is computed for the rows that reach them alone."""
    order = [r for r, _, _ in measured_order(df, text_col, rules, sample_rows)]
    at = cascade_column(_counted(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_t"), order, {c: F.col(c) for c in COUNTS})
    base = F.lit(False)
    for r in rules:
        if r.name in BASE_RULES:
            base = base | r.rejects(F.col)
    return at.select(F.col("_id").alias(id_col), *COUNTS, base.alias("base_failed"), F.col("_reason").isNull().alias("kept"), F.col("_reason").alias("reason"))
