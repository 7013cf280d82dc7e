"""Edit-distance candidates, clusters and spell checking against a dictionary frame (word, count)."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.columns import col

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def edits_1(word: Column) -> Column:
    """All texts one deletion, transposition, replacement or insertion (a-z) away; the word itself included."""
    n = F.length(word)
    part = lambda a, b: F.substring(word, a, b)
    at = F.sequence(F.lit(0), n)
    inner = F.filter(at, lambda i: i < n)
    letters = F.array(*map(F.lit, LETTERS))
    deletes = F.transform(inner, lambda i: F.concat(part(F.lit(1), i), part(i + 2, n)))
    swaps = F.transform(F.filter(at, lambda i: i < n - 1), lambda i: F.concat(part(F.lit(1), i), part(i + 2, F.lit(1)), part(i + 1, F.lit(1)), part(i + 3, n)))
    replaces = F.flatten(F.transform(inner, lambda i: F.transform(letters, lambda c: F.concat(part(F.lit(1), i), c, part(i + 2, n)))))
    inserts = F.flatten(F.transform(at, lambda i: F.transform(letters, lambda c: F.concat(part(F.lit(1), i), c, part(i + 1, n)))))
    return F.array_distinct(F.concat(deletes, swaps, replaces, inserts))


def edits_n(word: Column, distance: int = 2) -> Column:
    """:func:`edits_1` applied ``distance`` times; prefer a join on distance where there is a dictionary."""
    out = edits_1(word)
    for _ in range(distance - 1):
        out = F.array_distinct(F.flatten(F.transform(out, edits_1)))
    return out


def deletion_keys(word: Column, distance: int) -> Column:
    """Every text that up to ``distance`` deletions leave: two words within that edit distance share one (a letter changed is deleted from both)."""
    keep = F.array(word)
    out = keep
    for _ in range(distance):
        keep = F.array_distinct(F.flatten(F.transform(keep, lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i < F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w)))))))
        out = F.array_union(out, keep)
    return out


def within_distance(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """(w1, w2, d): words of ``a`` and ``b`` (first columns, distinct) at Levenshtein ``distance`` or less.

    Candidates share a deletion key, an equi-join; the distance is then verified.
    """
    one = a.select(col(a.columns[0]).alias("w1")).filter("w1 IS NOT NULL").distinct()
    two = b.select(col(b.columns[0]).alias("w2")).filter("w2 IS NOT NULL").distinct()
    met = one.select("w1", F.explode(deletion_keys(F.col("w1"), distance)).alias("k")).join(two.select("w2", F.explode(deletion_keys(F.col("w2"), distance)).alias("k")), "k")
    return met.select("w1", "w2").distinct().withColumn("d", F.levenshtein("w1", "w2", distance)).filter("d >= 0")


def edit_distance_pairs(df: DataFrame, word: str, distance: int = 2) -> DataFrame:
    """(w1, w2) with w1 < w2 at exactly ``distance``."""
    own = df.select(col(word).alias("w"))
    return within_distance(own, own, distance).filter((F.col("d") == distance) & (F.col("w1") < F.col("w2"))).select("w1", "w2")


def cluster_by_edit_distance(df: DataFrame, word: str, distance: int = 2) -> DataFrame:
    """(word, near): sorted later words at exactly ``distance``; words without any are left out."""
    return edit_distance_pairs(df, word, distance).groupBy(F.col("w1").alias("word")).agg(F.array_sort(F.collect_list("w2")).alias("near"))


def corrections(words: DataFrame, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """(word, corrected): the commonest dictionary word within ``distance`` (itself if known), ties to the nearer then the lesser; else the word."""
    own = words.select(col(words.columns[0]).alias("word")).distinct()
    near = within_distance(own, dictionary.select("word"), distance)
    ranked = near.join(dictionary.select(F.col("word").alias("w2"), "count"), "w2")
    best = ranked.groupBy(F.col("w1").alias("word")).agg(F.min_by("w2", F.struct((-F.col("count")).alias("n"), F.col("d"), F.col("w2"))).alias("best"))
    return own.join(best, "word", "left").select("word", F.coalesce("best", "word").alias("corrected"))


def probabilities(dictionary: DataFrame) -> DataFrame:
    """(word, p): share of the dictionary's counts."""
    total = dictionary.agg(F.sum("count").alias("n"))
    return dictionary.crossJoin(F.broadcast(total)).select("word", (F.col("count") / F.col("n")).alias("p"))  # one row


def correct_sentences(df: DataFrame, id_col: str, tokens: str, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """(id, corrected): token lists with each word corrected, joined by blanks in order.

    Distinct words are corrected once, then joined back.
    """
    long = df.select(col(id_col).alias("id"), F.posexplode(col(tokens)).alias("pos", "word"))
    fixed = corrections(long.select("word"), dictionary, distance)
    back = long.join(fixed, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "corrected"))).alias("w"))
    return back.select(F.col("id").alias(id_col), F.array_join("w.corrected", " ").alias("corrected"))


class FuzzyIndex:
    """Dictionary words by pieces, so that a word meets only those that can reach ``threshold`` (difflib ratio in percent, rounded).

    Matching blocks are a common subsequence: a ratio of t leaves (1 - t) of both lengths
    to be added or left out. Of a word cut into one piece more than such edits, one piece
    stands whole in the other, moved by no more places than there are edits. Words too
    short for so many pieces are met by every word of a fitting length.
    """

    def __init__(self, words: list[str], threshold: float):
        self.least = threshold - 0.5
        self.pieces: dict[int, list[tuple[int, int, dict[str, list[str]]]]] = {}
        self.short: dict[int, list[str]] = {}
        for d in words:
            n = len(d)
            if n not in self.pieces and n not in self.short:
                edits = self.edits(n + int(n * (200 - self.least) / self.least + 1e-9)) if self.least > 0 else n
                at = [n * k // (edits + 1) for k in range(edits + 2)] if edits < n else []
                if at:
                    self.pieces[n] = [(p, q - p, {}) for p, q in zip(at, at[1:])]
                else:
                    self.short[n] = []
            if n in self.short:
                self.short[n].append(d)
            else:
                for p, z, by in self.pieces[n]:
                    by.setdefault(d[p : p + z], []).append(d)

    def edits(self, both: int) -> int:
        """The most characters that two words of ``both`` characters together may not share."""
        return int((1 - self.least / 100) * both + 1e-9)

    def near(self, w: str) -> list[str]:
        """Every dictionary word at the threshold, and some below it."""
        m, out = len(w), set()
        fits = lambda n: 200 * min(m, n) >= self.least * (m + n)
        for n, pieces in self.pieces.items():
            if fits(n):
                e = self.edits(m + n)
                for p, z, by in pieces:
                    for x in range(max(0, p - e), min(m - z, p + e) + 1):
                        out.update(by.get(w[x : x + z], ()))
        for n, words in self.short.items():
            if fits(n):
                out.update(words)
        return sorted(out)


def fuzzy_matches(words: DataFrame, dictionary: DataFrame, threshold: int = 75, block: int = 20_000) -> DataFrame:
    """(word, match, ratio): dictionary words with 100 * difflib ratio (rounded) at ``threshold`` or more.

    The dictionary is sent in blocks of ``block`` words, each indexed by pieces
    (:class:`FuzzyIndex`); words with letters in common too few are passed over before the
    ratio. Words are spread over all shuffle partitions, by number: their bytes are few beside their work.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = words.select(col(words.columns[0]).alias("word")).filter("word IS NOT NULL").distinct().repartition(parts, F.xxhash64("word"))
    spark, schema = words.sparkSession, "word string, match string, ratio int"
    out, held = spark.createDataFrame([], schema), []

    def scan(part: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(part)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = FuzzyIndex(sent.value, threshold)
            for pdf in parts:
                rows = []
                for w in pdf["word"]:
                    m = difflib.SequenceMatcher(None, "", w, autojunk=False)
                    for d in index.near(w):
                        m.set_seq1(d)
                        if 100 * m.quick_ratio() >= threshold - 0.5 and (r := round(100 * m.ratio())) >= threshold:
                            rows.append((w, d, r))
                yield pd.DataFrame(rows, columns=["word", "match", "ratio"])

        return own.mapInPandas(run, schema)

    for r in dictionary.select("word").toLocalIterator():
        if r.word is not None:
            held.append(r.word)
        if len(held) >= block:
            out, held = out.unionByName(scan(held)), []
    return out.unionByName(scan(held)) if held else out


def fuzzy_correct(df: DataFrame, id_col: str, tokens: str, dictionary: DataFrame, threshold: int = 75) -> DataFrame:
    """(id, corrected): each token replaced by its best fuzzy match (ties: lesser word), if there is one."""
    long = df.select(col(id_col).alias("id"), F.posexplode(col(tokens)).alias("pos", "word"))
    best = fuzzy_matches(long.select("word"), dictionary, threshold).groupBy("word").agg(F.min_by("match", F.struct((-F.col("ratio")).alias("r"), F.col("match"))).alias("best"))
    back = long.join(best, "word", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("best", "word").alias("w")))).alias("w"))
    return back.select(F.col("id").alias(id_col), F.array_join("w.w", " ").alias("corrected"))
