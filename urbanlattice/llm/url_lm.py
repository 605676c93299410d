"""URL filter: host and path rules, then a character language-model ratio, in DataFrame functions only.

Two variable-order Markov models are estimated over the characters of URLs that a
rule accepts and that a rule rejects. With n(c x) the count of character x after
context c of length k, and n(c) that of the context,

    p_k(x | c) = (n(c x) + S * p_(k-1)(x | c without its first)) / (n(c) + S)

so that the longest context with evidence decides and shorter ones smooth it; p_0
rests on equal shares of the alphabet. A URL's score is the mean over its characters
of ln(p_accepted / p_rejected). The threshold is the score that separates labelled
URLs held out of the counts best (greatest sum of both classes' rates).

Counts, scores and the threshold cover all rows. Ratios are summed as integers of
1e-6, so that the order of summing changes nothing. Null URLs count as empty: no
host, no path, the method judges them. Repeated rows keep their number; rows that share an
id or have none are judged by their own URL; other columns are left aside, whatever
their names. URLs are read whole, however long. Without
labelled URLs of both classes the ratio is 0 and every URL is allowed. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import measured_broadcasts, spread_join, written

#: (rule, verdict): host, then the start of the path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Longest context in characters.
ORDER = 4
#: Weight of the shorter context's share.
SMOOTHING = 4.0
#: Printable ASCII, one symbol for all other characters, the start's and the end's.
ALPHABET = 98
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Equal rows that one row stands for at most where they are written out again.
REPEATS = 1000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits (of equal ones the first in alphabetical order), else null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + start), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def verdict_of(rule: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    case = F.lit(None).cast("string")
    for name, verdict in rules:
        case = F.when(rule == name, F.lit(verdict)).otherwise(case)
    return case


def symbols(url: Column, order: int = ORDER) -> Column:
    """The URL over the model's alphabet, with starts before it and its end."""
    plain = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), r"[^\x21-\x7d]", "~")
    return F.concat(F.lit("\x02" * order), plain, F.lit("\x03"))


def grams(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))


def model(counts: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING) -> DataFrame:
    """(gram, weight, ratio) from (gram, weight, good, bad): ln(p_accepted / p_rejected) in 1e-6 of a gram's last character."""
    levels = {order: counts.select("gram", "good", "bad")}
    for k in range(order - 1, -1, -1):
        shorter = levels[k + 1].groupBy(F.substring("gram", 2, k + 1).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        # each order's counts serve its shares, its contexts and the next shorter order: they are made once
        levels[k] = written(shorter, f"url-grams-{k + 1}")
    below = None
    for k in range(order + 1):
        at = levels[k]
        context = at.groupBy(F.substring("gram", 1, k).alias("context")).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        # over an alphabet of 98, contexts of length 0 and 1 have at most 98 rows and shorter grams at most 98 * 98
        small = F.broadcast if k <= 1 else lambda x: x
        at = at.join(small(context), F.substring("gram", 1, k) == F.col("context"))
        if below is None:
            at = at.withColumn("low_good", F.lit(1.0 / ALPHABET)).withColumn("low_bad", F.lit(1.0 / ALPHABET))
        else:
            small = F.broadcast if k <= 2 else lambda x: x
            at = at.join(small(below), F.substring("gram", 2, k) == F.col("suffix"))
        share = lambda n, total, low: (F.col(n) + smoothing * F.col(low)) / (F.col(total) + smoothing)
        at = at.select("gram", share("good", "all_good", "low_good").alias("p_good"), share("bad", "all_bad", "low_bad").alias("p_bad"))
        if k < order:
            below = written(at.select(F.col("gram").alias("suffix"), F.col("p_good").alias("low_good"), F.col("p_bad").alias("low_bad")), f"url-shares-{k + 1}")
    ratio = F.round(1e6 * F.log(F.col("p_good") / F.col("p_bad"))).cast("long").alias("ratio")
    return counts.select("gram", "weight").join(at.select("gram", ratio), "gram")


def threshold(scored: DataFrame) -> float:
    """The score in steps of 0.01 that best separates held-out (score, good) rows; 0 if a class is missing."""
    steps = scored.groupBy(F.greatest(F.lit(-500), F.least(F.lit(500), F.floor(100 * F.col("score")))).alias("step")).agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    rows = sorted(steps.collect())  # 1,001 rows at most
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, g, b = None, 0.0, 0, 0
    for i, r in enumerate(rows):
        # rows from here on are accepted
        value = (good - g) / good + b / bad
        if best is None or value > best:
            # half way to the last rejected step
            best, at = value, (r["step"] + (rows[i - 1]["step"] + 1 if i else r["step"])) / 200
        g, b = g + r["good"], b + r["bad"]
    return at


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) for each row."""
    measured_broadcasts(df.sparkSession)
    url = F.col("_url")
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).groupBy("_id", "_url").agg(F.count(F.lit(1)).alias("_n"))
    rows = written(rows.withColumn("_key", F.monotonically_increasing_id()), "urls")  # numbers hold once written
    rule = rule_of(host_of(url), path_of(url), rules)
    at = rows.select("_key", "_n", symbols(url).alias("_s"), verdict_of(rule, rules).alias("_label"), (F.pmod(F.xxhash64("_url"), F.lit(5)) == 0).alias("_held"))
    each = at.select("_key", "_n", "_label", "_held", F.explode(grams(F.col("_s"), ORDER + 1)).alias("gram"))
    seen = lambda v: F.sum(F.when((F.col("_label") == v) & ~F.col("_held"), F.col("_n")).otherwise(0))
    counts = written(each.groupBy("gram").agg(F.count(F.lit(1)).alias("weight"), seen("allow").alias("good"), seen("block").alias("bad")), "url-grams")
    total = counts.agg(F.sum("weight")).first()[0] or 0
    met = spread_join(each.select("_key", "gram"), model(counts).drop("weight"), "gram", counts.select("gram", F.col("weight").alias("n")), total)
    sums = met.groupBy("_key").agg(F.sum("ratio").alias("_sum"), F.count(F.lit(1)).alias("_len"))
    scored = written(rows.join(sums, "_key", "left").withColumn("score", F.coalesce(F.col("_sum") / 1e6 / F.col("_len"), F.lit(0.0))).drop("_sum", "_len"), "url-scores")
    label = verdict_of(rule, rules)
    held = scored.where(F.pmod(F.xxhash64("_url"), F.lit(5)) == 0).select("score", (label == "allow").alias("good")).where(F.col("good").isNotNull())
    cut = threshold(held)
    # as many rows as there were: those of a frequent row are dealt to several tasks, some at a time
    times = lambda n: F.explode(F.array_repeat(F.lit(1), n.cast("int"))).alias("_one")
    many = scored.where(F.col("_n") > REPEATS).select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / REPEATS) - 1)).alias("_k"))
    many = many.repartition(F.col("_key"), F.col("_k")).withColumn("_n", F.least(F.lit(REPEATS), F.col("_n") - F.col("_k") * REPEATS)).drop("_k")
    out = scored.where(F.col("_n") <= REPEATS).unionByName(many).select("*", times(F.col("_n"))).withColumn("rule", rule)
    return out.select(
        F.col("_id").alias(id_col),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        F.col("score"),
    )
