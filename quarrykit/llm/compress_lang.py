"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, sliced

UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower-cased words of letters between single blanks, a blank at either end."""
    return f" {_NOT_LETTERS.sub(' ', text.lower())} "


def _cut(raw: bytes, size: int) -> Iterator[bytes]:
    """``raw`` in pieces of ``size`` bytes at most, cut before blanks where there are any."""
    at = 0
    while len(raw) - at > size:
        end = raw.rfind(b" ", at + 1, at + size)
        end = at + size if end < 0 else end
        yield raw[at:end]
        at = end
    yield raw[at:]


class Classifier:
    """Holds one raw-content dictionary per language; encodes, compares, predicts.

    ``contents`` maps a language to its dictionary, ``sizes`` to its number of training
    rows, by which ties are settled. Texts below ``short`` bytes also encode each word
    and each pair of words by itself, since whole bytes of one small frame tell little.
    Texts over ``block`` bytes are encoded whole in blocks, each with the fresh
    dictionary, and sizes are summed: a dictionary saves a bounded number of bytes a frame,
    so in a single frame margins would shrink as texts grow.
    """

    def __init__(self, contents: dict[str, bytes], sizes: dict[str, int], level: int = 3, short: int = 300, block: int = 32_768):
        self.langs = sorted(contents, key=lambda x: (-sizes.get(x, 0), x))
        self.short, self.block = short, block
        self.encoders = []
        for x in self.langs:
            d = zstandard.ZstdCompressionDict(contents[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); margin: how much larger the runner-up's encoding is, as a share of it."""
        plain = normalise(text or "")
        if not self.langs or not any(c.isalpha() for c in plain):
            return UNKNOWN, 0.0, 0.0
        raw = plain.encode("utf-8", "surrogatepass")
        frames = list(_cut(raw, self.block))
        if len(raw) < self.short:
            w = raw.split()
            frames += [b" %b " % x for x in w] + [b" %b %b " % x for x in zip(w, w[1:])]
        sizes = [sum(len(e.compress(x)) for x in frames) for e in self.encoders]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)  # stable: ties go to the commoner language
        best = sizes[order[0]]
        margin = 1.0 if len(order) < 2 else 1 - best / sizes[order[1]]
        score = 1 / sum(2.0 ** (-min(50.0, 200 * (1 - best / s))) for s in sizes)
        return self.langs[order[0]], score, margin


def build_dictionaries(rows: list[tuple[str, str]], size: int = 110_000, words: int = 3000) -> dict[str, bytes]:
    """Per language, ``size`` bytes of normalised training text, then its ``words`` commonest words, commonest last."""
    texts: dict[str, list[str]] = {}
    for lang, text in rows:
        texts.setdefault(lang, []).append(normalise(text))
    out = {}
    for lang, own in texts.items():
        counts = Counter(w for t in own for w in t.split())
        common = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:words]][::-1]
        out[lang] = "".join(own).encode("utf-8", "surrogatepass")[:size] + f" {' '.join(common)} ".encode("utf-8", "surrogatepass")
    return {k: v for k, v in out.items() if len(v) >= 16}


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 400, sample_chars: int = 4000, most_languages: int = 200, level: int = 3) -> tuple[dict[str, bytes], dict[str, int]]:
    """Dictionaries learned from a bounded sample of labelled rows.

    Of the rows where ``train`` holds and language and text are not null, about
    ``sample_rows`` per language are drawn by a hash of the id, at most twice as many. Of a
    longer text one piece of ``sample_chars`` characters is taken, at a place that a hash of
    the id gives; pieces fill the dictionaries in the order of that hash, up to their size.
    """
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: int(r[1]) for r in rows.groupBy(F.col(lang_col)).count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return {}, {}
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.3 * sample_rows / n))]), F.col(lang_col))
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)
    picked = rows.filter(drawn).select(F.col(lang_col).alias("l"), F.col(id_col).cast("string").alias("i"), F.substring(F.col(text_col), 1 + F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("place")), F.greatest(F.char_length(text_col) - sample_chars + 1, F.lit(1))).cast("int"), F.lit(sample_chars)).alias("t")).limit(2 * sample_rows * len(sizes)).collect()
    picked.sort(key=lambda r: (r.i or "", r.t))
    return build_dictionaries([(r.l, r.t) for r in picked]), sizes


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: Column | None = None, min_margin: float = 0.005, level: int = 3) -> DataFrame:
    """The input's columns kept aside, one row per input row: id, held_out, lang_pred, score, margin, accepted.

    The whole text is encoded, in blocks, with each language's dictionary and the smallest
    encoding wins. ``accepted`` is false where the runner-up is within ``min_margin`` of the best,
    and where the prediction is ``und``: a null text or one without letters, or nothing to
    learn from. Equal sizes go to the language with more training rows, then the lesser
    name. ``score`` (0 to 1) grows with the relative margins. By default rows whose
    crc32 of the id leaves remainder 2 by 4 are held out from training; neither id,
    language nor any other column enters a prediction, whatever the others are called; rows
    with a null id are predicted too. Repeated rows get equal results; an empty table gives
    an empty result.
    """
    train = ~held_out(id_col) if train is None else train
    contents, sizes = fit(docs, train, id_col, text_col, lang_col, level=level)
    sent = docs.sparkSession.sparkContext.broadcast((contents, sizes))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(*sent.value, level=level)
        for b in sliced(batches, "t"):
            lang, score, margin = zip(*map(model.predict, b.column("t").to_pylist()))
            ok = [x != UNKNOWN and m >= min_margin for x, m in zip(lang, margin)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(lang), pa.array(score), pa.array(margin), pa.array(ok)], ["id", "held_out", "lang_pred", "score", "margin", "accepted"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, margin double, accepted boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = 0.005, level: int = 3) -> DataFrame:
    """``docs`` without the rows that :func:`identify` rejects; columns, of any names, and values stay as they are.

    Null and empty texts and those without letters are rejected, as is every row where
    there is nothing to learn from; null ids stay; repeated rows go or stay together; an
    empty table stays empty.
    """
    contents, sizes = fit(docs, ~held_out(id_col), id_col, text_col, lang_col, level=level)
    sent = docs.sparkSession.sparkContext.broadcast((contents, sizes))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(*sent.value, level=level)
        for b in sliced(batches, text_col):
            keep = []
            for t in b.column(at):
                x, _, m = model.predict(t.as_py())
                keep.append(x != UNKNOWN and m >= min_margin)
            yield b.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
