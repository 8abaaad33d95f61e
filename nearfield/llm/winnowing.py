"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into tokens (words; each ideograph or syllable of scripts without spaces is a token of its own), and every
run of ``K`` tokens gets a rolling hash: a cyclic polynomial over the tokens' XXH64, so that each token is hashed once
and from one run to the next a token's hash enters and one leaves. Of every ``WINDOW`` consecutive hashes the least is
selected, the rightmost one among equals. The selected (hash, place) pairs are the fingerprint. Two texts that share a
passage of at least ``WINDOW + K - 1`` tokens select a common hash in it, and the kept places say where.

Likeness is the Jaccard measure of the two sets of selected hashes; a text with fewer than ``K`` tokens has one hash,
the polynomial of all its tokens; texts without a token have none and are alike (1) only to each other.

``with_next`` gives each row the text of the next row in descending order of doc_id. Rows fall into ranges of (doc_id,
hash of the text) between quantiles of a bounded sample, so the texts go through one shuffle by range, and each range
gets a copy of the first row below it. The sample decides how even the ranges are and never a result. Rows that are
equal in both and are as many as a range holds are counted, go on as one row, and are repeated at the end.

Defined results: null texts count as empty; null doc_ids come last, ties are in order of the text's hash, rows equal in
doc_id and text are interchangeable; tokens and texts may have any length; empty tables give empty results. Only doc_id
and text are read, so that other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import ranges
from .text import let

K = 3
WINDOW = 4
#: Rows that a range of ids should hold.
RANGE_ROWS = 1024

#: A token: one character of a script written without spaces, or a run of other characters between gaps.
GAP = r"[ \t-\r]+"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
TOKEN = UNSPACED + r"|[^ \t-\r\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"


def tokens(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    by_gap = F.split(whole, GAP)
    fine = F.regexp_extract_all(whole, F.lit(f"({TOKEN})"), 1)
    return F.filter(F.when(whole.rlike(UNSPACED), fine).otherwise(by_gap), lambda t: t != "")


def _turn(x: Column, n: int) -> Column:
    """The 64 bits of ``x`` turned left by ``n``."""
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) if n else x


def gram_hashes(tokens: Column, k: int = K) -> Column:
    """Rolling hashes of each run of ``k`` tokens; one of all tokens where there are fewer, none where there is none."""

    def rolled(hs, i, n):
        return reduce(lambda a, b: a.bitwiseXOR(b), [_turn(F.get(hs, i + j) if j else F.get(hs, i), n - 1 - j) for j in range(n)])

    def runs(hs):
        starts = F.slice(hs, F.lit(1), F.greatest(F.size(hs) - (k - 1), F.lit(0)))
        out = F.transform(starts, lambda h, i: reduce(lambda a, b: a.bitwiseXOR(b), [_turn(h if j == 0 else F.get(hs, i + j), k - 1 - j) for j in range(k)]))
        for n in range(1, k):
            out = F.when(F.size(hs) == n, F.array(rolled(hs, F.lit(0), n))).otherwise(out)
        return out

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), runs)


def select_minima(hashes: Column, window: int = WINDOW) -> Column:
    """The fingerprint, an array of (hash, place): the least hash of each window, the rightmost of equal ones, once each.

    Fewer hashes than a window are one window.
    """

    def minima(hs):
        n = F.size(hs)
        windows = F.slice(hs, F.lit(1), F.when(n > window, n - (window - 1)).otherwise(F.least(n, F.lit(1))))

        def place(h, i):
            def rightmost(least):
                at = i
                for j in range(1, window):
                    at = F.when(F.get(hs, i + j) == least, i + j).otherwise(at)
                return F.struct(least.alias("hash"), at.alias("place"))

            return let(F.least(h, *[F.get(hs, i + j) for j in range(1, window)]), rightmost)

        return F.transform(windows, place)

    # one place is chosen by neighbouring windows only, so that a repeat equals the element before it
    return let(let(hashes, minima), lambda m: F.filter(m, lambda x, i: F.coalesce(F.get(m, i - 1)["place"] != x["place"], F.lit(True))))


def winnow(df: DataFrame, text: str, prefix: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with {prefix}hashes and {prefix}places, the selected hashes and where they are, in order of place."""
    return (
        df.withColumn("_minima", select_minima(gram_hashes(tokens(F.col(text)), k), window))
        .withColumn(f"{prefix}places", F.col("_minima.place"))
        .withColumn(f"{prefix}hashes", F.col("_minima.hash"))
        .drop("_minima")
    )


def digest(hashes: Column, places: Column) -> Column:
    """A fingerprint as 32 hex digits, from the selected hashes and their places."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(hashes, places)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), places, hashes)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def add_key(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return docs.withColumns({"_known": F.col("doc_id").isNotNull().cast("bigint"), "_id": F.coalesce("doc_id", F.lit(0).cast("bigint")), "_hash": F.xxhash64("text")})


def in_ranges(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, _known, _hash, _range, _n): every row with its range from the lowest up, and ``_n`` 1.

    Rows equal in doc_id and text that would fill ranges are one row, of which ``_n`` tells how many there are.
    """
    placed, heavy = ranges.in_ranges(documents, add_key, ["_known", "_id", "_hash"], range_rows)
    placed = placed.withColumn("_n", F.lit(1).cast("bigint"))
    if heavy is not None:
        same = ["_range", "doc_id", "_known", "_hash"]
        merged = placed.filter(heavy).groupBy(*same).agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("_n"))
        placed = placed.filter(~heavy).select(*merged.columns).unionByName(merged)
    return placed.select("doc_id", "text", "_known", "_hash", "_range", "_n")


def _lined(documents: DataFrame, range_rows: int, carry: dict[str, Column]) -> DataFrame:
    """(doc_id, text, ``carry``, next, times): each row with text and ``carry`` of the next, and how often it is there."""
    docs = in_ranges(documents, range_rows)
    order = F.struct("_known", "doc_id", "_hash", "text")
    # the first row of each range goes below the nearest range above that has rows; the windows see numbers only
    firsts = cut(docs.groupBy("_range").agg(F.max(order).alias("first")))
    ends = Window.partitionBy()
    above = firsts.select("_range", F.coalesce(F.lead("_range").over(Window.orderBy("_range")), F.min("_range").over(ends)).alias("_to"))
    ghosts = firsts.join(above, "_range").select(*[F.col(f"first.{c}").alias(c) for c in ("doc_id", "text", "_known", "_hash")], F.col("_to").alias("_range"), F.lit(0).cast("bigint").alias("_n"))
    lined = docs.unionByName(ghosts).repartition("_range").withColumns(carry)  # after the shuffle, where the ranges are even
    w = Window.partitionBy("_range").orderBy(F.col("_n") == 0, F.col("_known").desc(), F.col("doc_id").desc(), F.col("_hash").desc(), F.col("text").desc())
    row = F.struct("text", *carry)
    found = lined.withColumn("next", F.lead(row).over(w)).filter("_n > 0")
    # of equal rows all but the last have their like behind them
    both = F.array(F.struct(F.col("next"), F.lit(1).cast("bigint").alias("times")), F.struct(row.alias("next"), (F.col("_n") - 1).alias("times")))
    return found.select("doc_id", "text", *carry, F.explode(F.filter(both, lambda x: x["times"] > 0)).alias("_each")).select("doc_id", "text", *carry, "_each.next", "_each.times")


def repeated(df: DataFrame) -> DataFrame:
    """Each row of ``df`` as often as its column times says, without that column."""
    return df.withColumn("times", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).drop("times")


def with_next(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document in descending doc_id; after the last, that of the first."""
    return repeated(_lined(documents, range_rows, {}).select("doc_id", "text", F.col("next.text").alias("next_text"), "times"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 2) characters replaced by as many, or all, from the start of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each text with its edited text and the fingerprints of both, the hashes of the next text, and how often it is there.

    A text is fingerprinted once; its hashes are the next text's of the row before it as well.
    """
    lined = _lined(documents, range_rows, {"minima": select_minima(gram_hashes(tokens(F.col("text"))))})
    named = lined.select("doc_id", "text", F.col("minima.hash").alias("hashes"), F.col("minima.place").alias("places"), F.col("next.minima.hash").alias("next_hashes"), edited(F.col("text"), F.col("next.text")).alias("edited_text"), "times")
    return winnow(named, "edited_text", "edited_")


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compare_documents(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    compared = fingerprint_documents(documents, range_rows).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
        digest(F.col("hashes"), F.col("places")).alias("fingerprint"),
        digest(F.col("edited_hashes"), F.col("edited_places")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        "times",
    )
    return repeated(compared)
