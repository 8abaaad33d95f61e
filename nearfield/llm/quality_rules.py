"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate over the whole text that says whether the rule rejects it. A document is kept when no
rule rejects it, so the verdict doesn't depend on the order of the rules; only the work does. ``plan_cascade``
measures on a bounded sample what each rule costs and how much it rejects, and orders the rules by rejection per
cost. ``rejects`` then nests them in one CASE expression, which stops at the first rule that rejects.

Defined results: a null text counts as empty; an empty text has no words and is rejected by the length rule; a null
doc_id, lang or source is passed through. Repeated rows get the same verdict. Columns the input has besides
``doc_id`` and ``text`` are never read, so clashing names can't disturb the measures; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, words

#: Thresholds of the verdict; the first two are the contract's base, the others this operator's own rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_100_WORDS = 25
MEAN_WORD_CHARS = (2, 14)
MAX_DUP_LINE_PERCENT = 50
MAX_SHOUT_PERCENT = 60
MIN_LETTER_PERCENT = 60
#: Most rows of the sample on which cost and rejection are measured.
SAMPLE_ROWS = 512
#: How often a sample row is looked at in a run, timed runs of a rule, and the factor between costs that count as different.
REPLICAS = 4
RUNS = 2
COST_STEP = 2.0

SYMBOLS = "[#*$%&|<>]"
#: Characters of scripts that put no spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]+"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    cost: float = 0.0
    rejection: float = 0.0
    note: str = field(default="", compare=False)


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def window_hashes(ws: Column) -> Column:
    """A 64-bit hash of each window of three words."""
    return let(
        ws,
        lambda a: F.transform(
            F.slice(a, F.lit(1), F.greatest(F.size(a) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(a, i + 1), F.get(a, i + 2)),
        ),
    )


def covered_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort (hash, place), mark neighbours, add up the union."""

    def again(pairs):
        return F.filter(
            pairs,
            lambda p, k: F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)),
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.sort_array(F.transform(let(pairs, again), lambda p: p["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        places,
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n")),
        lambda acc: acc["n"],
    )


def n_repeat_words(hashes: Column) -> Column:
    """Words in windows found twice or more in the text, from the windows' hashes; sorted only where one recurs."""
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered_words(h)))


def base_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Columns of these names that ``df`` has are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        df.withColumn("_ws", words(F.col(text)))
        .withColumn("n_words", F.size("_ws").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(whole, r"[ \t-\r]+", "")).cast("long"))
        .withColumn("n_symbols", n_symbols(whole))
        .withColumn("n_dup_lines", n_dup_lines(whole))
        .withColumn("n_repeat_words", n_repeat_words(window_hashes(F.col("_ws"))))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .drop("_ws")
    )


def _squeezed(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, keep, ""))


def own_rules(text: Column, measures: bool) -> list[Rule]:
    """The rules beyond the base. With ``measures`` the columns of base_measures are there and are used.

    The verdict with measures is the one ORACLE_SQL defines. Without them marks are letters as well, and characters of
    scripts without spaces make no word too long.
    """
    n = F.col("n_words") if measures else F.size(words(text))
    chars = F.col("word_chars") if measures else F.length(F.regexp_replace(text, r"[ \t-\r]+", ""))
    symbols = F.col("n_symbols") if measures else n_symbols(text)
    dups = F.col("n_dup_lines") if measures else n_dup_lines(text)
    letters = F.length(text) - _squeezed(text, r"\p{L}+" if measures else r"[\p{L}\p{M}]+")
    long = chars > MEAN_WORD_CHARS[1] * n
    if not measures:
        long = long & (chars - (F.length(text) - _squeezed(text, UNSPACED)) > MEAN_WORD_CHARS[1] * n)
    return [
        Rule("symbols", 100 * symbols > MAX_SYMBOLS_PER_100_WORDS * n),
        Rule("word_length", (chars < MEAN_WORD_CHARS[0] * n) | long),
        Rule("dup_lines", 100 * dups > MAX_DUP_LINE_PERCENT * F.size(F.split(text, "\n"))),
        Rule("shouting", 100 * (F.length(text) - _squeezed(text, r"\p{Lu}+")) > MAX_SHOUT_PERCENT * letters),
        Rule("letters", 100 * letters < MIN_LETTER_PERCENT * chars),
    ]


def base_rules(text: Column, measures: bool) -> list[Rule]:
    n = F.col("n_words") if measures else F.size(words(text))
    repeats = F.col("n_repeat_words") if measures else n_repeat_words(window_hashes(words(text)))
    return [Rule("too_short", n < MIN_WORDS), Rule("repeats", 100 * repeats > MAX_REPEAT_PERCENT * n)]


def plan_cascade(df: DataFrame, rules: list[Rule], prepare: Callable[[DataFrame], DataFrame] = lambda x: x, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` over ``prepare(df)`` with measured cost and rejection, best rejection per cost first.

    The sample is about ``sample_rows`` rows drawn from all of ``df``, held in memory. Each rule runs over it, every row
    REPLICAS times, once to warm up and RUNS times to be timed; the least time less that of a run without a rule is its
    cost, in steps of COST_STEP so that the order is the same from run to run. An empty table leaves the order as given.
    Only the order rests on the sample, never a verdict.
    """
    n = df.count()
    drawn = df.filter(F.rand(7) < min(1.0, 1.5 * sample_rows / n)) if n > sample_rows else df
    sample = prepare(drawn.limit(sample_rows)).cache()
    n = sample.count()
    if not n:
        sample.unpersist()
        return list(rules)
    copies = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(REPLICAS))))

    def least(rejected: Column) -> tuple[float, int]:
        count = copies.agg(F.count_if(rejected))
        count.collect()
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            found = count.collect()[0][0]
            times.append(time.perf_counter() - began)
        return min(times), found

    idle, _ = least(F.col("_copy") < 0)
    measured = []
    for rule in rules:
        took, rejected = least(rule.rejects)
        measured.append(Rule(rule.name, rule.rejects, max(took - idle, 0.0) / (n * REPLICAS), rejected / (n * REPLICAS)))
    sample.unpersist()
    return in_order(measured)


def in_order(rules: list[Rule]) -> list[Rule]:
    """Best rejection per cost first; costs count in steps, those of less than a hundredth of the greatest as that."""
    most = max((r.cost for r in rules), default=0.0)
    step = lambda r: round(math.log(max(r.cost, most / 100, 1e-12), COST_STEP))
    return sorted(rules, key=lambda r: (-r.rejection / COST_STEP ** step(r), step(r), r.name))


def rejects(rules: list[Rule]) -> Column:
    """True where some rule rejects; later rules aren't evaluated where an earlier one does."""
    out = F.lit(False)
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(True)).otherwise(out)
    return out


def measure_documents(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base measures of every row plus ``kept``: false where the base fails, else the cascade's verdict."""
    whole = F.coalesce(F.col(text), F.lit(""))
    order = plan_cascade(df, own_rules(whole, measures=True), lambda x: base_measures(x, text), sample_rows)
    return base_measures(df, text).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~rejects(order)))


def filter_documents(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with the columns of ``df``; nothing is measured beyond the first rejection.

    Texts with vowel signs or in scripts without spaces may stay here that measure_documents, bound to its SQL, rejects.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    order = plan_cascade(df, base_rules(whole, measures=False) + own_rules(whole, measures=False), sample_rows=sample_rows)
    return df.filter(~rejects(order))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

#: The same in DuckDB.
ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY r),
m AS (
  SELECT w.r, doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))
              - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')) AS letters,
         length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS uppers,
         len(string_split(t, chr(10))) AS n_lines
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 25 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
         OR 100 * n_dup_lines > 50 * n_lines OR 100 * uppers > 60 * letters OR 100 * letters < 60 * word_chars) AS kept
FROM b
"""
