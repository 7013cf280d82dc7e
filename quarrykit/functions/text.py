"""Tokens, n-grams, tf-idf, keyphrases, name matching, phrases, URLs, compounding."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.columns import col
from ..plans.lineage import checkpointed

WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}_]{2,}"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def count_words(df: DataFrame, text: str | None = None, lines: bool = False) -> DataFrame | None:
    """(word, count); ``lines`` splits at white space and keeps case; no text column gives None."""
    if text is None:
        return None
    tokens = F.filter(F.split(col(text), r"\s+"), lambda w: w != "") if lines else words(col(text))
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def strip_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def bigram_context(df: DataFrame, tokens: str, window: int = 2, unique: bool = False, skip: str = "|") -> DataFrame:
    """(w1, w2, count) of ordered pairs less than ``window`` apart within a row; ``unique`` merges both orders."""
    t, n = F.col("t"), F.size("t")
    ahead = [F.zip_with(F.slice(t, 1, F.greatest(n - k, F.lit(0))), F.slice(t, k + 1, n), lambda x, y: F.struct(x.alias("w1"), y.alias("w2"))) for k in range(1, window)]
    rows = df.select(F.filter(col(tokens), lambda x: x != skip).alias("t")).filter(n > 1)
    p = rows.select(F.explode(F.concat(*ahead)).alias("p")).select("p.w1", "p.w2")
    if unique:
        p = p.select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2"))
    return p.groupBy("w1", "w2").agg(F.count("*").alias("count"))


def corpus_tfidf(df: DataFrame, text: str) -> DataFrame:
    """(term, tf, df, weight): (1 + ln total tf) * ln(N / (1 + df)) over lower-cased terms of two characters or more.

    Terms are counted per row, then per term; both counts combine before their shuffles.
    """
    n = df.agg(F.count("*").alias("n"))
    tokens = F.regexp_extract_all(F.lower(col(text)), F.lit(TERM), F.lit(0))
    long = df.select(F.monotonically_increasing_id().alias("d"), tokens.alias("t")).select("d", F.explode("t").alias("w")).groupBy("d", "w").agg(F.count("*").alias("k"))
    got = long.groupBy(F.col("w").alias("term")).agg(F.sum("k").cast("bigint").alias("tf"), F.count("*").alias("df"))
    return got.crossJoin(F.broadcast(n)).select("term", "tf", "df", ((1 + F.ln("tf")) * F.ln(F.col("n") / (1 + F.col("df")))).alias("weight"))  # n is one row


def ziegler_keywords(foreground: DataFrame, background: DataFrame, text: str) -> DataFrame:
    """(term, score) by (wf / wb) ln(wf + wb) over corpus tf-idf; terms the background lacks score their weight; best first."""
    f = corpus_tfidf(foreground, text).select("term", F.col("weight").alias("wf"))
    b = corpus_tfidf(background, text).select("term", F.col("weight").alias("wb"))
    both = f.join(b, "term", "left")
    total = F.col("wf") + F.col("wb")
    ratio = F.try_divide("wf", "wb") * F.when(total > 0, F.ln(total))
    score = F.when(F.coalesce("wb", F.lit(0.0)) == 0, F.col("wf")).otherwise(ratio)
    return both.select("term", score.alias("score")).orderBy(F.desc_nulls_last("score"), "term")


def match_names(a: DataFrame, b: DataFrame, a_id: str, a_name: str, b_id: str, b_name: str, max_distance: float | None = None) -> DataFrame:
    """(b_id, a_id, distance): for each row of ``b`` its nearest row of ``a`` by tf-idf cosine, ties to the lesser id.

    Terms, document frequencies and weights come from ``a`` (smoothed idf, rows of unit
    length). Rows of ``b`` without a known term get the least id of ``a`` at sqrt(2).
    Candidates come from an equi-join on terms.
    """

    def terms(df: DataFrame, i: str, t: str) -> DataFrame:
        w = F.regexp_extract_all(F.lower(col(t)), F.lit(TERM), F.lit(0))
        return df.select(col(i).alias("id"), F.explode(w).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))

    ta, tb = terms(a, a_id, a_name), terms(b, b_id, b_name)
    n = a.agg(F.count("*").alias("n"), F.min(col(a_id)).alias("first"))
    idf = ta.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n.select("n"))).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def weighed(t: DataFrame) -> DataFrame:
        w = t.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
        norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))

    wa, wb = weighed(ta), weighed(tb)
    sims = wa.select("term", F.col("id").alias("a"), F.col("w").alias("wa")).join(wb.select("term", F.col("id").alias("b"), F.col("w").alias("wb")), "term").groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 12).alias("sim"))
    best = sims.groupBy("b").agg(F.min_by(F.struct("a", "sim"), F.struct((-F.col("sim")).alias("s"), F.col("a"))).alias("m"))
    whole = b.select(col(b_id).alias("b")).join(best, "b", "left").crossJoin(F.broadcast(n.select("first")))
    out = whole.select(F.col("b").alias("b_id"), F.coalesce("m.a", "first").alias("a_id"), F.sqrt(F.greatest(2 - 2 * F.coalesce("m.sim", F.lit(0.0)), F.lit(0.0))).alias("distance"))
    return out if max_distance is None else out.filter(F.col("distance") <= max_distance)


def join_bigrams(bigrams: Column, replacements: dict[str, str] | None = None) -> Column:
    """A sentence from consecutive bigrams (array of structs l, r); a bigram "l r" in the table becomes its replacement.

    After a replacement the next bigram's first word is already spoken for, so only its
    second word is added, unless that bigram is replaced in turn, which starts anew from
    its second word. An empty array gives an empty text.
    """
    known = F.create_map(*[F.lit(x) for kv in (replacements or {}).items() for x in kv]) if replacements else F.create_map().cast("map<string,string>")

    def step(acc: Column, b: Column) -> Column:
        said = F.concat_ws(" ", b["l"], b["r"])
        new = F.try_element_at(known, said)
        fresh = acc["last"].isNull()
        plain = F.when(fresh, F.array(b["l"], b["r"])).otherwise(F.array(b["r"]))
        merged = F.when(fresh, F.array(new)).otherwise(F.when(acc["glued"], F.array(b["r"])).otherwise(F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(new))))
        out = F.when(new.isNull(), F.concat(acc["out"], plain)).when(fresh, F.array(new)).when(acc["glued"], F.concat(acc["out"], F.array(b["r"]))).otherwise(merged)
        return F.struct(out.alias("out"), b["r"].alias("last"), (new.isNotNull() & ~acc["glued"]).alias("glued"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(False).alias("glued"))
    return F.aggregate(bigrams, start, step, lambda a: F.array_join(a["out"], " "))


def neighbours(tokens: Column) -> Column:
    """Structs (l, r) of each token and the next; the array is read twice, not once a token."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda x, y: F.struct(x.alias("l"), y.alias("r")))


def _maybe_in(df: DataFrame, key: Column, keys: DataFrame, bits: int = 27) -> DataFrame:
    """Rows of ``df`` whose text ``key`` may be among ``keys`` (one column): surely those that are. A bitmap of 2^``bits`` hashes is broadcast, 16 MB at most however many keys."""
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    span = 64 * 256
    seen = keys.select(h(F.col(keys.columns[0])).alias("__h"))
    longs = seen.groupBy(F.expr("__h div 64").alias("__w")).agg(F.expr("bit_or(shiftleft(1L, cast(__h % 64 AS int)))").alias("__b"))
    slots = longs.groupBy(F.expr("__w div 256").alias("__k")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("__w") % 256).cast("int"), "__b"))).alias("__m"))
    map_ = slots.select("__k", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0))).alias("__a"))
    own = df.withColumn("__h", h(key)).withColumn("__k", F.expr(f"__h div {span}"))
    return own.join(F.broadcast(map_), "__k").filter(F.expr("getbit(__a[cast(__h div 64 % 256 AS int)], cast(__h % 64 AS int)) = 1")).select(*map(col, df.columns))


def compounding_decisions(df: DataFrame, text: str, dictionary: DataFrame, split_on_both: bool = True, threshold: int = 3) -> DataFrame:
    """(bigram, joined, n_bigram, n_joined, make_bigram) for word pairs also written as one word or with a hyphen.

    Counts are of rows that hold the form as tokens. ``make_bigram``: where the counts
    are within ``threshold``, the joined form is unknown or both words are known (and
    ``split_on_both``); otherwise both words are known and the joined form is rarer or
    unknown. The dictionary (column word) is joined, never collected.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    t = F.col("t")  # split at blanks, so a pair's text parts in one way only; repeats end inside their row, and only counts are shuffled
    rows = df.select(F.split(col(text), " ").alias("t"))
    n = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.array_distinct(F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda x, y: F.concat(x, F.lit(" "), y)))
    hyphen = lambda w: F.contains(w, F.lit("-"))
    forms = rows.select(F.array_distinct("t").alias("t")).select(F.filter("t", lambda w: ~hyphen(w)).alias("plain"), F.transform(F.filter("t", hyphen), lambda w: F.replace(w, F.lit("-"), F.lit(""))).alias("other"))
    one = forms.select(F.explode("plain").alias("joined"), F.lit(True).alias("plain")).unionByName(forms.select(F.explode(F.array_except("other", "plain")).alias("joined"), F.lit(False).alias("plain")))
    uni = checkpointed(one.groupBy("joined").agg(F.count("*").alias("n_joined"), F.max("plain").alias("plain")).filter("plain"))  # read twice
    met = _maybe_in(rows.select(F.explode(pairs).alias("p")), F.replace("p", F.lit(" "), F.lit("")), uni.select("joined"))  # most pairs are never written as one word
    counts = met.groupBy("p").agg(F.count("*").alias("n_bigram"))
    bi = counts.select(F.substring_index("p", " ", 1).alias("l"), F.substring_index("p", " ", -1).alias("r"), "n_bigram")
    c = bi.withColumn("joined", F.concat("l", "r")).join(uni, "joined")
    words_ = dictionary.select("word").distinct()
    known = lambda d, c_: d.join(words_.select(F.col("word").alias(f"k_{c_}")), F.col(c_) == F.col(f"k_{c_}"), "left")
    for x in ("joined", "l", "r"):
        c = known(c, x)
    whole, both = F.col("k_joined").isNotNull(), F.col("k_l").isNotNull() & F.col("k_r").isNotNull()
    near = F.abs(F.col("n_bigram") - F.col("n_joined")) < threshold
    make = (near & (~whole | (both & F.lit(split_on_both)))) | (~near & both & ((F.col("n_joined") <= F.col("n_bigram")) | ~whole))
    return c.select(F.concat_ws(" ", "l", "r").alias("bigram"), "joined", "n_bigram", "n_joined", make.alias("make_bigram"))


def correct_compounding(df: DataFrame, text: str, dictionary: DataFrame, split_on_both: bool = True, threshold: int = 3, most: int = 10_000) -> DataFrame:
    """``df`` with ``corrected``: words split or joined as :func:`compounding_decisions` says (at most ``most`` decisions)."""
    rows = compounding_decisions(df, text, dictionary, split_on_both, threshold).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} decisions")
    single = {k: r.bigram for r in rows if r.make_bigram for k in (r.joined, r.bigram.replace(" ", "-"))}
    double = {r.bigram: r.joined for r in rows if not r.make_bigram}
    known = F.create_map(*[F.lit(x) for kv in single.items() for x in kv]) if single else F.create_map().cast("map<string,string>")
    t = F.transform(F.split(col(text), " "), lambda w: F.coalesce(F.try_element_at(known, w), w))
    pairs = neighbours(t)
    return df.withColumn("corrected", F.when(F.size(t) > 1, join_bigrams(pairs, double)).otherwise(F.array_join(t, "")))


def url_pattern(url: Column) -> Column:
    """Host and path of a URL with digit runs as ``\\d+`` and slugs of letters as ``[^/]+`` beyond the first segment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\d+", r"\\d+"), r"(/[^/]+)/[\p{L}][\p{L}_-]*", r"$1/[^/]+")


def cluster_urls(df: DataFrame, url: str, min_size: int = 10) -> DataFrame:
    """(url, pattern, unclustered 0/1): urls whose pattern at least ``min_size`` rows share; others stand for themselves."""
    own = df.select(col(url).alias("url")).withColumn("pattern", url_pattern(F.col("url")))
    big = own.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).select(F.col("pattern").alias("p"))
    return own.join(big, F.col("pattern") == F.col("p"), "left").select("url", F.coalesce("p", "url").alias("pattern"), F.col("p").isNull().cast("int").alias("unclustered"))


def _common_runs(a: str, b: str, k: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(i, j, n): starts and lengths of the maximal runs of ``k`` characters or more along which a[i:] and b[j:] agree; None if over ``most`` grams meet."""
    ids = np.unique(np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    base, x, y = int(ids.max()) + 1, ids[: len(a)], ids[len(a) :]
    p, q, top = x, y, base
    for g in range(1, k):
        if top > (1 << 62) // base:
            both = np.unique(np.concatenate([p, q]), return_inverse=True)[1]
            p, q, top = both[: len(p)], both[len(p) :], int(both.max()) + 1
        p, q, top = p[:-1] * base + x[g:], q[:-1] * base + y[g:], top * base
    order = np.argsort(q, kind="stable")
    lo, hi = np.searchsorted(q[order], p, "left"), np.searchsorted(q[order], p, "right")
    met = hi - lo
    if met.sum() > most:
        return None
    i = np.repeat(np.arange(len(p)), met)
    j = order[np.repeat(lo - np.cumsum(met) + met, met) + np.arange(len(i))]
    at = np.lexsort((i, i - j))
    i, j = i[at], j[at]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    first = np.flatnonzero(new)
    return i[first], j[first], np.diff(np.append(first, len(i))) + k - 1


def matching_blocks(a: str, b: str, least: int = 2, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(start in ``a``, length) of difflib's matching blocks of ``least`` characters or more, in no order.

    Difflib takes the longest run that two texts share (the first in ``a``, then in ``b``)
    and goes on to its left and right. The same blocks come from all maximal runs taken
    longest first, where a run that leaves the gap between two blocks is cut to the gaps and
    waits for its turn. Texts so repetitive that over ``most`` grams meet are left to difflib.
    """
    if min(len(a), len(b)) < least:
        return
    runs = _common_runs(a, b, least, most)
    if runs is None:
        yield from ((i, n) for i, _, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if n >= least)
        return
    at = np.lexsort((runs[1], runs[0], -runs[2]))
    runs = [r[at] for r in runs]
    cut: list[tuple[int, int, int]] = []  # (-n, i, j) of pieces
    # the blocks so far in order, one before and one after all: starts and ends in a and in b
    ia, ea, ib, eb = [-1, len(a)], [0, len(a) + 1], [-1, len(b)], [0, len(b) + 1]
    while True:
        todo = list(zip((-runs[2]).tolist(), runs[0].tolist(), runs[1].tolist()))
        k, taken = 0, 0
        while (k < len(todo) or cut) and taken < 24:
            if cut and (k == len(todo) or cut[0] < todo[k]):
                n, i, j = heappop(cut)
            else:
                n, i, j = todo[k]
                k += 1
            n = -n
            g = bisect_left(ea, i + 1)  # gap g lies between blocks g - 1 and g: the first that the run can touch
            while g < len(ia) and ia[g - 1] < i + n and ib[g - 1] < j + n:
                s = max(ea[g - 1] - i, eb[g - 1] - j, 0)
                e = min(ia[g] - i, ib[g] - j, n)
                if s == 0 and e == n:
                    yield i, n
                    ia.insert(g, i), ea.insert(g, i + n), ib.insert(g, j), eb.insert(g, j + n)
                    taken += 1
                    break
                if e - s >= least:
                    heappush(cut, (s - e, i + s, j + s))
                g += 1
        runs = [r[k:] for r in runs]
        if not len(runs[0]) and not cut:
            return
        # runs that touch no gap in both texts are done with
        i, j, n = runs
        first = np.maximum(np.searchsorted(ea, i, "right"), np.searchsorted(eb, j, "right"))
        last = np.minimum(np.searchsorted(ia, i + n, "left"), np.searchsorted(ib, j + n, "left"))
        runs = [r[first <= last] for r in runs]


def extract_phrases(df: DataFrame, group: str, order: str, text: str, min_length: int = 2, max_length: int | None = None, min_freq: int = 1) -> DataFrame:
    """(group, phrase, freq): substrings that each text shares with the texts before it, by difflib's matching blocks.

    A group is one list of texts and is folded in order, by nature on one task. Groups are spread
    over all shuffle partitions: their work is far more than their bytes, by which adaptive execution would gather them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[group].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, int] = {}
        seen = ""
        for t in pdf.sort_values("o")["t"].dropna():
            if seen:
                blocks = matching_blocks(seen, t, max(min_length, 1))
                for a, n in blocks if min_length > 0 else [*blocks, (0, 0)]:  # difflib's last block is empty
                    p = seen[a : a + n].strip()
                    if len(p) >= min_length and (max_length is None or len(p) <= max_length):
                        found[p] = found.get(p, 0) + 1
            seen = f"{seen}||{t}" if seen else t
        rows = [(p, n) for p, n in sorted(found.items()) if n >= min_freq]
        # explicit types: a list without phrases would otherwise become a column of floats
        return pd.DataFrame({"g": pdf["g"].iloc[:1].repeat(len(rows)).to_numpy(), "phrase": np.array([p for p, _ in rows], object), "freq": np.array([n for _, n in rows], np.int64)})

    own = df.select(col(group).alias("g"), col(order).alias("o"), col(text).alias("t"))
    return own.repartition(parts, "g").groupBy("g").applyInPandas(fold, f"g {kind}, phrase string, freq bigint").withColumnRenamed("g", group)


def topics(df: DataFrame, tokens: str, k: int, n: int = 10, seed: int = 0, vocabulary: int | None = None) -> DataFrame:
    """(topic, words): the ``n`` heaviest words of each topic of a latent Dirichlet allocation.

    All words count; ``vocabulary`` keeps so many of the commonest only, where it is given.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    if vocabulary is None:
        vocabulary = max(1, df.select(F.explode(col(tokens)).alias("w")).distinct().count())
    counter = CountVectorizer(inputCol=tokens, outputCol="features", vocabSize=vocabulary).fit(df)
    model = LDA(k=k, seed=seed, maxIter=10).fit(counter.transform(df))
    words_ = F.array(*map(F.lit, counter.vocabulary))
    return model.describeTopics(n).select("topic", F.transform("termIndices", lambda i: F.get(words_, i)).alias("words"))


def random_string(n: int = 10, seed: int | None = None) -> Column:
    """A random text of capital letters and digits."""
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda k: F.substring(F.lit(chars), (F.floor(F.rand(None if seed is None else seed + k) * 36) + 1).cast("int"), F.lit(1))
    return F.concat(*[pick(k) for k in range(n)])


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")

