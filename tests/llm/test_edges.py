"""Every operator and every pipeline stage on nulls, empties, ties, repeats, long texts, an empty table and clashing names."""

import random

import pytest

import corpus_pipeline
from quarrykit.llm import benchmark_align, bestfit_pack, block_lstm, compress_lang, license_rules, paragraph_minhash, piecewise_hash, preference_format, simhash_bytes, warc_merkle
from quarrykit.llm.queries import tokenizer_path

CLASH = "id bigint, h string, t string, l string, i string, key bigint, spot bigint, raw binary, part int, kind string, fp bigint, own_0 string, removed boolean, piece int, length bigint, start bigint, score double, bucket int, copy int, digest string, mark bigint, n bigint, kept boolean, __text string, __id bigint"
EXTRA = (1, "h", "t", "l", "i", 2, 3, b"r", 4, "k", 5, "o", True, 6, 7, 8, 0.5, 9, 1, "d", 3, 4, False, "mine", 7)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASH
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def english(rng, n):
    return " ".join(rng.choice("the of and to in is that with for was on stone river cloud field bread".split()) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    long = " ".join(f"{rng.choice('the of and to in is'.split())} w{rng.randrange(10**6)}" for _ in range(110_000))  # over 1 MB
    own = [english(rng, 60) for _ in range(12)]
    texts = [(1, own[0]), (1, own[1]), (2, own[0]), (2, own[0]), (None, own[2]), (None, None), (3, None), (4, ""), (5, "  \n\t\n"), (6, "12 34 !!"), (7, long), (8, own[3] + "\n" + own[0]), (9, own[4] + " " + ITEM), (10, "Released under the MIT License."), (11, "é" * 3000), (12, "a b"), (13, "<|endoftext|> x"), (14, own[5]), (15, own[6])]
    return [(i, t, "en" if i != 15 else None, "s", None if t is None else len(t), *EXTRA) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(4).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (None, ITEM, "x"), (3, None, "x"), (4, "", "x")], "item_id bigint, text string, doc_id string")


OPS = {
    "op2": lambda d, b: license_rules.find_licences(d),
    "op3": lambda d, b: compress_lang.identify(d),
    "op4": lambda d, b: paragraph_minhash.duplicate_paragraphs(d),
    "op5": lambda d, b: simhash_bytes.near_duplicates(d),
    "op6": lambda d, b: bestfit_pack.pack_documents(d, tokenizer_path()),
    "op8": lambda d, b: benchmark_align.find_contamination(d, b),
    "op9": lambda d, b: piecewise_hash.compare_with_edited(d),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_document_operators(docs, bench, rows, name):
    got = OPS[name](docs, bench).collect()
    assert OPS[name](docs.limit(0), bench).collect() == []
    ids = sorted((str(r.doc_id) for r in got))
    every = sorted(str(r[0]) for r in rows)
    if name in ("op3", "op5", "op9"):
        assert ids == every
    if name == "op2":
        assert ids == ["10"]
    if name == "op3":
        by = {str(r.doc_id): r for r in got}
        assert all(by[k].lang_pred == "und" and not by[k].accepted for k in ("3", "4", "5", "6")) and by["7"].lang_pred == "en"
        assert all(0 <= r.score <= 1 for r in got)
    if name == "op4":
        assert set(ids) == {"1", "2", "8"} and sum(not r.removed for r in got if r.kind == "line") == 1
    if name == "op5":
        zero = [r for r in got if r.fingerprint == "0" * 16]
        assert len(zero) == 4 and {r.n_near for r in zero} == {3} and {r.component_id for r in zero} == {3}  # the null id counts as a row, not as a least id
        assert {r.n_near for r in got if r.doc_id == 2} == {2}
    if name == "op6":
        assert {str(r.doc_id) for r in got} == set(every)
        assert sum(r.length for r in got if r.doc_id in (3, 4)) == 2
        last = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == last.get(r.sequence_id, 0) and r.offset + r.length <= 1024
            last[r.sequence_id] = r.offset + r.length
        from tokenizers import Tokenizer

        real = Tokenizer.from_file(tokenizer_path())
        for k in (7, 11, 13):
            n = sum(r.length for r in got if r.doc_id == k)
            assert n == len(real.encode(next(x[1] for x in rows if x[0] == k), add_special_tokens=False).ids) + 1
    if name == "op8":
        assert [(r.doc_id, r.item_id, r.score) for r in got] == [(9, 1, 1.0)] * 2
    if name == "op9":
        assert {r.n_chars for r in got if r.doc_id == 7} == {len(next(x[1] for x in rows if x[0] == 7))}
        same = [r.fingerprint for r in got if r.doc_id == 2]
        assert same[0] == same[1] and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_pages_and_audit(spark):
    wide = "page_id bigint, url string, html string, id bigint, h string, text string, r string, idx bigint, bucket int, digest string"
    extra = (1, "h", "own text", "r", 2, 3, "d")
    deep = "<html><body><article>" + "<p>" + "long words here " * 70_000 + "</p></article></body></html>"
    rows = [(1, "u", "<p>a b</p>", *extra), (1, "u", "<p>a b</p>", *extra), (None, None, None, *extra), (2, "u", "", *extra), (3, "u", "<p></p>", *extra), (4, "u", deep, *extra)]
    pages = spark.createDataFrame(rows, wide)
    got = block_lstm.main_text(pages).collect()
    assert len(got) == 6 and {r.n_chars for r in got if r.page_id in (None, 2, 3)} == {0}
    assert all(r.n_chars == len(r.text) for r in got) and block_lstm.main_text(pages.limit(0)).collect() == []
    assert max(r.n_chars for r in got) in (0, len(("long words here " * 70_000).strip()))
    own = warc_merkle.digests(pages, warc_merkle.record(), "page_id")
    assert warc_merkle.audit(own, own).collect() == [] and warc_merkle.audit(own.limit(0), own.limit(0)).collect() == []
    less = warc_merkle.audit(own, own.filter("id <> 4")).collect()
    assert [(r.first_id, r.status) for r in less if r.level == 0] == [(4, "missing")]
    one = spark.createDataFrame(rows[:1], wide)
    more = warc_merkle.audit(own, own.unionByName(warc_merkle.digests(one, warc_merkle.record(), "page_id"))).collect()
    assert [(r.first_id, r.status) for r in more if r.level == 0] == [(1, "extra")]


def test_preferences_with_clashing_names(spark):
    wide = "pair_id bigint, turn bigint, role string, text string, said string, a string, b string, part string, split bigint, shared boolean"
    t = spark.createDataFrame([(1, 0, "user", "x", "s", "a", "b", "p", 1, True), (1, 1, "assistant", "y" * 1_100_000, "s", "a", "b", "p", 1, True), (None, 1, "user", "x", "s", "a", "b", "p", 1, True)], wide)
    got = preference_format.format_preferences(t, t.limit(0)).collect()
    assert {(r.pair_id, r.part, r.turn) for r in got} == {(1, "chosen", 0), (1, "chosen", 1)} and max(r.mask_length for r in got) == 1_100_008
    assert preference_format.pair_completions(t, t).filter("chosen IS NOT NULL").count() == 0


def test_every_stage(spark, docs, rows, tmp_path, bench):
    bench.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert none.collect() == []
        if name == "packing":
            assert {str(r.doc_id) for r in got.collect()} == {str(r[0]) for r in rows}
            continue
        assert got.schema.names == docs.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        left = [tuple(r) for r in got.collect()]
        assert all(r[5:] == tuple(bytearray(x) if isinstance(x, bytes) else x for x in EXTRA) for r in left)
        key = sorted((str(r[0]), r[1] or "") for r in left)
        texts = [(str(r[0]), r[1] or "") for r in rows]
        if name == "language_id":
            assert not {"3", "4", "5", "6"} & {k for k, _ in key} and ("7", next(t for k, t in texts if k == "7")) in key
        if name == "simhash_dedup":
            assert len([k for k in key if k[0] == "2"]) == 0 and len([k for k in key if k[0] == "1"]) == 2
            assert len([k for k, t in key if not t.strip()]) == 1  # null, empty and blank texts are one group
        if name == "substring_dedup":
            assert dict(key)["8"] == dict(texts)["8"].split("\n")[0] and len([k for k in key if k[0] == "None"]) == 2 and "2" not in dict(key)
        if name == "decontamination":
            assert key == sorted(x for x in texts if x[0] != "9")
