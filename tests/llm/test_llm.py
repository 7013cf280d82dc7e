"""Operators of the llm subpackage against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarrykit.llm import benchmark_align, bestfit_pack, block_lstm, compress_lang, license_rules, paragraph_minhash, piecewise_hash, preference_format, simhash_bytes, warc_merkle
from quarrykit.llm.common import collision_pairs, components
from quarrykit.llm.queries import tokenizer_path

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
WORDS = {"en": "the and of to in that with over under stone river cloud field bread winter".split(), "fr": "le la les des une dans avec pour sur être rivière nuage pain hiver champ".split()}


def passage(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    texts = [("\n".join(passage(rng, rng.randint(5, 60), x) for _ in range(rng.randint(1, 5))), x) for x in ["en", "fr"] * 40]
    texts += [(texts[0][0], "en"), (texts[0][0], "en"), (texts[2][0] + " extra", "en"), (None, "en"), ("", "en"), ("   \n", None), ("12 34", "fr"), ("short", "en")]
    rows = [(i, t, x, f"s{i % 3}", len(t or "")) for i, (t, x) in enumerate(texts)]
    rows.append((200, texts[4][0] + "\n" + passage(rng, 4000), "en", "s", 0))
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_components_and_collisions(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 130)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    rows = spark.createDataFrame([(k % 3 if k > 30 else 9, k) for k in range(60)], "key bigint, id bigint")
    for limit in (5, 1000):  # hot keys in blocks, and whole
        pairs = [tuple(r) for r in collision_pairs(rows, [], lambda a, b: F.lit(True), limit).collect()]
        keys = {r.id: r.key for r in rows.collect()}
        assert sorted(pairs) == [(a, b) for a in range(60) for b in range(a + 1, 60) if keys[a] == keys[b]]


def simhash(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("subset", [2, 3, 5])
def test_simhash(corpus, nothing, subset):
    got = by_id(simhash_bytes.near_duplicates(corpus, subset=subset))
    rows = sorted(corpus.collect())
    f = {r.doc_id: simhash(r.text) for r in rows}
    assert {k: v.fingerprint for k, v in got.items()} == {k: f"{v:016x}" for k, v in f.items()}
    near = {a: [b for b in f if b != a and (f[a] ^ f[b]).bit_count() <= 3] for a in f}
    assert {k: v.n_near for k, v in got.items()} == {k: len(v) for k, v in near.items()}
    for a in f:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        assert got[a].component_id == min(seen)
    assert simhash_bytes.near_duplicates(nothing).count() == 0


def test_simhash_finds_every_flip(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    for b in list(base):
        x = b
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << bit
        base.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in base]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(60) for j in range(i) if (base[i] ^ base[j]).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in set(signed)], "id bigint")
    for s in (2, 3, 5):
        for limit in (2000, 3):
            pairs = [tuple(r) for r in simhash_bytes.near_pairs(df, subset=s, limit=limit).collect()]
            assert len(pairs) == len(set(pairs)) and {tuple(sorted(p)) for p in pairs} == want


def test_packing(corpus, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    got = bestfit_pack.pack_documents(corpus, path, window=64).collect()
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in corpus.collect()}
    pieces = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 64 and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for k, v in ids.items():
        own = sorted(pieces[k])
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == len(v)
        assert all(n == 64 for _, _, n in own[1:]) and len(own) == -(-len(v) // 64)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    assert bestfit_pack.pack_documents(nothing, path).count() == 0


def test_packing_plan():
    for seed in range(20):
        rng = random.Random(seed)
        counts = Counter(rng.choice([rng.randint(1, 100), rng.randint(20, 60)]) for _ in range(400))
        runs = bestfit_pack.plan_packing(dict(counts), 100)
        seqs, ranks = {}, Counter()
        for n, r0, k, s0, at in runs:
            ranks[n] += k
            for i in range(k):
                seqs.setdefault(s0 + i, []).append((at, n))
        assert ranks == counts
        assert all(sum(n for _, n in v) <= 100 for v in seqs.values()) and set(seqs) == set(range(len(seqs)))
        assert len(seqs) <= -(-sum(n * c for n, c in counts.items()) // 100) * 1.08 + 1
    assert bestfit_pack.plan_packing({40: 1, 30: 2, 60: 1, 70: 0}, 100)[-1][3] == 1  # 60+40 exact, 30+30 left


def test_ranks_in_slices(spark):
    rows = spark.range(500).select(F.col("id"), F.lit(0).alias("piece"), (F.col("id") % 7 + 1).alias("length"))
    out = bestfit_pack.pack(rows, 10, slice_rows=20).collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(out) == 500 and all(sum(n for _, n in v) <= 10 and len({o for o, _ in v}) == len(v) for v in seqs.values())


def test_encoder_equals_tokenizer():
    e = bestfit_pack.Encoder(tokenizer_path())
    odd = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\tx\t \ty", "x　 y", "²½ I'll", "<|endoftext|> x", "日本 語", "a\r\nb", "\x1c x", "w" * 300 + " b", "é ế 😀"]
    rng = random.Random(2)
    odd += ["".join(rng.choice(["a", "Bc", " ", "\n", ",", "é", "1", "\t", "'s"]) for _ in range(60)) for _ in range(200)]
    assert e.batch(odd) == [e.whole(x) for x in odd]
    assert e.batch(odd) == [e.whole(x) for x in odd]


def test_language(corpus, nothing):
    got = by_id(compress_lang.identify(corpus))
    want = {r.doc_id: r for r in corpus.collect()}
    right = [got[k].lang_pred == want[k].lang for k in got if len(want[k].text or "") > 30]
    assert sum(right) / len(right) > 0.95
    for k, r in want.items():
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= got[k].score <= 1
        if not any(c.isalpha() for c in r.text or ""):
            assert got[k].lang_pred == "und" and not got[k].accepted
    kept = compress_lang.keep_identified(corpus)
    assert kept.columns == corpus.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v.accepted}
    assert compress_lang.identify(nothing).count() == 0
    assert {r.lang_pred for r in compress_lang.identify(corpus.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_fingerprints(corpus, nothing):
    rows = sorted(corpus.collect())
    got = by_id(piecewise_hash.compare_with_edited(corpus))
    assert set(got) == {r.doc_id for r in rows}
    for a, b in zip(rows, rows[1:] + rows[:1]):
        t, u = a.text or "", b.text or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + u[:k]
        r = got[a.doc_id]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == piecewise_hash.fingerprint(t) and r.edited_fingerprint == piecewise_hash.fingerprint(edited)
        assert r.near_edited == piecewise_hash.likeness([(r.fingerprint, r.edited_fingerprint)])[0]
        assert r.near_next == piecewise_hash.likeness([(r.fingerprint, piecewise_hash.fingerprint(u))])[0]
    assert piecewise_hash.compare_with_edited(nothing).count() == 0
    one = corpus.filter("doc_id = 3")
    assert piecewise_hash.compare_with_edited(one).first().near_next == 1.0


def test_rolling_and_lcs():
    rng = random.Random(6)
    raw = bytes(rng.randrange(256) for _ in range(80))
    want = []
    for i in range(80):
        w = [raw[i - 6 + k] if i - 6 + k >= 0 else 0 for k in range(7)]
        x = 0
        for k in range(7):
            x ^= w[k] << 5 * (6 - k) & 0xFFFFFFFF
        want.append((w[0] + sum((k + 2) * w[k] for k in range(1, 7)) + x + 1) & 0xFFFFFFFF)
    assert piecewise_hash._rolling(np.frombuffer(raw, np.uint8)).tolist() == want
    a, b = (["".join(rng.choices("ABC+/9", k=rng.randint(1, 64))) for _ in range(60)] for _ in range(2))

    def lcs(x, y):
        d = [0] * (len(y) + 1)
        for p in x:
            last = 0
            for j, q in enumerate(y, 1):
                last, d[j] = d[j], last + 1 if p == q else max(d[j], d[j - 1])
        return d[-1]

    assert piecewise_hash._lcs(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)]


def test_paragraphs(spark, nothing):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(12)]
    near = [" ".join("edit" if k == 20 else w for k, w in enumerate(p.split())) for p in base[:4]]
    docs = [(1, base[0] + "\n" + base[1]), (2, base[0] + "\n" + base[2]), (3, near[1] + "\nfew words"), (4, "\n".join(base[3:6])), (5, near[3]), (6, base[0].upper()), (7, None), (8, ""), (9, "few words"), (10, base[7] + "\n" + base[7])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS)
    for measure in ("jaccard", "edit"):
        found = paragraph_minhash.duplicate_paragraphs(df, verify=measure)
        got = {(r.doc_id, r.paragraph): r.removed for r in found.collect()}
        assert got == {(1, 0): False, (2, 0): True, (6, 0): True, (1, 1): False, (3, 0): True, (4, 0): False, (5, 0): True, (10, 0): False, (10, 1): True}
    left = by_id(paragraph_minhash.remove_paragraphs(df, found))
    assert set(left) == {1, 2, 3, 4, 7, 8, 9, 10}
    assert left[2].text == base[2] and left[3].text == "few words" and left[10].text == base[7] and left[2].n_chars == len(base[2]) and left[7].text is None
    assert paragraph_minhash.duplicate_paragraphs(nothing).count() == 0
    b, r = paragraph_minhash.tune_bands(0.65)
    assert 1 - (1 - 0.65**r) ** b >= 0.98


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 2, h[i, j - 1] - 2)
    return h.max()


def test_decontamination(spark, corpus, nothing):
    rng = random.Random(9)
    for _ in range(50):
        a, b = ([bytes([rng.choice(b"abcd")]) for _ in range(rng.randint(1, 15))] for _ in range(2))
        score, s, e = benchmark_align.align(a, b)
        assert score == smith_waterman(a, b) == smith_waterman(a, b[s:e])
    items = [" ".join(f"q{rng.randrange(900)}" for _ in range(30)) for _ in range(6)]
    edited = " ".join("new" if k % 8 == 3 else w for k, w in enumerate(items[1].split()))
    extra = [(300, "before it " + items[0] + " after", "en", "s", 0), (301, edited.upper(), "en", "s", 0), (302, "x " + items[2][:60], "en", "s", 0)]
    docs = corpus.unionByName(spark.createDataFrame(extra, DOCS))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id bigint, text string")
    for block in (4 << 20, 100):
        got = {(r.doc_id, r.item_id): r for r in benchmark_align.find_contamination(docs, bench, block_bytes=block).collect()}
        assert set(got) == {(300, 0), (301, 1)} and got[300, 0].score == 1
    r = got[300, 0]
    assert extra[0][1][r.start : r.end] == items[0]
    left = benchmark_align.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 2
    assert benchmark_align.find_contamination(nothing, bench).count() == 0 and benchmark_align.find_contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_of_edited_copies(spark, nothing):
    rng = random.Random(12)
    items = [" ".join(rng.choice(WORDS["en"]) + rng.choice(["", "s", "er", "ing", "ed"]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 9, 20, 33, 50, 50)]
    for beside in (0, 1, 5):
        texts = [passage(rng, rng.randint(1, 300)) for _ in range(20)] + items[6:] * beside
        for t in items[6:]:
            for every in (3, 4, 5):
                texts.append("pre " + " ".join(f"new{k}" if k % every == 1 else w for k, w in enumerate(t.split())) + " post")
                texts.append(" ".join(f"{w} new{k}" if k % every == 1 else w for k, w in enumerate(t.split())))
                texts.append(" ".join(w for k, w in enumerate(t.split()) if k % every != 1))
        m = benchmark_align.Matcher([(k, t.encode().split()) for k, t in enumerate(items)], 3, 0.4)
        for t in texts:
            best = {k: smith_waterman(i.split(), t.split()) / (2 * len(i.split())) for k, i in enumerate(items)}
            got = {}
            for k, score, *_ in m.matches(t):
                got[k] = max(score, got.get(k, 0))
            assert got == {k: v for k, v in best.items() if v >= 0.4}
    item = " ".join(f"q{k}" for k in range(50))
    edited = " ".join("new" if k % 4 == 1 else w for k, w in enumerate(item.split()))
    docs = spark.createDataFrame([(1, edited, "en", "s", 0), (2, item, "en", "s", 0), (3, f"{item} and then {edited}", "en", "s", 0)], DOCS)
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    found = benchmark_align.find_contamination(docs, bench).collect()
    assert sorted((r.doc_id, round(r.score, 2)) for r in found) == [(1, 0.62), (2, 1.0), (3, 0.62), (3, 1.0)]
    assert benchmark_align.drop_contaminated(docs, bench).count() == 0


def test_block_parser():
    html = '<head><title>t</title></head><body><div class="nav main"><a href="x>y">Go</a></div><p>One &amp; two<br>three<p>Four <b>five</b><script>var a="</p>"</script><!-- c --><ul><li>a<li>b</ul>tail &#233;'
    got = block_lstm.blocks(html)
    assert [t for _, t, _ in got] == ["Go", "One & two three", "Four five", "a", "b", "tail é"]
    assert got[0][0] == ("body", "div nav main") and got[0][2] == 1.0 and got[3][0][-2:] == ("ul", "li")
    assert block_lstm.blocks(None) == [] and block_lstm.blocks("a < b <") != []
    assert block_lstm.blocks("<p " + "x='" * 5000) is not None


def test_labeller(spark):
    rng = random.Random(3)
    data = [block_lstm.invented_page(rng) for _ in range(4)]
    m = block_lstm.Labeller()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = block_lstm._padded([p for p, _ in data])
    y = np.zeros(mask.shape[:2])
    for c, (_, own) in enumerate(data):
        y[: len(own), c] = own
    _, g = m.gradients(x, mask, y)
    for k in ("uf", "wb", "v", "bf", "ub", "c"):
        i = tuple(s // 2 for s in m.p[k].shape)
        m.p[k][i] += 1e-4
        up = m.gradients(x, mask, y)[0]
        m.p[k][i] -= 2e-4
        down = m.gradients(x, mask, y)[0]
        m.p[k][i] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][i]) < 1e-4
    model = block_lstm.trained(400, 5)
    rng = random.Random(77)
    test = [block_lstm.invented_page(rng) for _ in range(150)]
    right = np.concatenate([a == (o > 0) for a, (_, o) in zip(model.keep([p for p, _ in test]), test)])
    assert right.mean() > 0.95
    page = "<html><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav><article><h1>Title here</h1><p>Some text of the article, long enough.</p><p>More &lt;text&gt;.</p></article><footer>&copy; foot</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (1, "u", page)], "page_id bigint, url string, html string")
    got = block_lstm.main_text(df, train_pages=400).collect()
    assert sorted((r.page_id, r.n_chars) for r in got)[2:] == [(2, 0), (3, 0)]
    assert got[0].text == "Title here\nSome text of the article, long enough.\nMore <text>." and block_lstm.main_text(df.limit(0), train_pages=400).count() == 0


def test_preferences(spark):
    turns = lambda rows: spark.createDataFrame(rows, "pair_id bigint, turn bigint, role string, text string")
    a = turns([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", None), (2, 0, "user", "z"), (3, 0, None, "q"), (None, 0, "user", "x")])
    b = turns([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", "")])
    got = {(r.pair_id, r.part, r.turn): r for r in preference_format.format_preferences(a, b).collect()}
    assert set(got) == {(1, "prompt", 0), (1, "chosen", 1), (1, "rejected", 1), (1, "rejected", 2), (2, "prompt", 0), (3, "chosen", 0)}
    r = got[1, "chosen", 1]
    assert r.rendered == "<|assistant|>\nyes<|end|>\n" and r.rendered[r.mask_start : r.mask_start + r.mask_length] == "yes<|end|>\n"
    assert got[1, "prompt", 0].mask_length == got[1, "rejected", 2].mask_length == 0
    assert preference_format.format_preferences(a.limit(0), b.limit(0)).count() == 0


def test_licences(spark):
    assert all(any(k in p for k in license_rules.KEYWORDS) for p in license_rules.SENTENCES.values())
    assert {n for _, names in license_rules.RULES for n in names} <= set(license_rules.SENTENCES)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including the rights to use, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, "Intro text. " + mit), (2, "x\nReleased under the MIT License.\ny"), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "no word of it"), (6, None), (7, ""), (8, "Licensed under the Apache License, Version 2.0. All rights reserved.")]
    got = license_rules.find_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.licence) for r in got) == [(1, "MIT"), (2, "MIT"), (3, "GPL-3.0"), (4, "CC-BY-NC-4.0"), (8, "All-Rights-Reserved"), (8, "Apache-2.0")]
    assert next(r for r in got if r.doc_id == 1).sentences == "mit_grant+mit_notice"
    r = next(r for r in got if r.doc_id == 2)
    assert rows[1][1][r.start : r.end] == "Released under the MIT License."


def test_audit(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é" * (i % 50) + "body" * 40) for i in range(70)] + [(None, "u", "h"), (500, None, None), (3, "http://x/3", "again")], "page_id bigint, url string, html string")
    own = warc_merkle.digests(pages, warc_merkle.record(), "page_id")
    assert warc_merkle.audit(own, own, 4).count() == 0
    bad = warc_merkle.damaged_copy(pages).filter("page_id <> 20").unionByName(pages.filter("page_id = 7").withColumn("page_id", F.lit(900).cast("bigint")))
    got = warc_merkle.audit(own, warc_merkle.digests(bad, warc_merkle.record(), "page_id"), 4).collect()
    assert sorted((r.first_id, r.status) for r in got if r.level == 0) == [(5, "altered"), (11, "missing"), (20, "missing"), (900, "extra")]
    assert max(r.level for r in got) == 4 and all(r.status == "range" for r in got if r.level)
    whole = [r for r in got if r.level == 4][0]
    assert whole.offset == 0 and whole.length == own.agg(F.sum("length")).first()[0]
    assert warc_merkle.audit(own.limit(0), own.limit(0)).count() == 0


def test_pipeline(spark, corpus, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(0, " ".join(f"q{k}" for k in range(30)))], "item_id bigint, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = spark.createDataFrame([(400, "one two " + " ".join(f"q{k}" for k in range(30)) + " the and of to", "en", "s", 5)], DOCS)
    corpus.unionByName(leak).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
        if k < 4:
            assert docs.columns == DOCS.names
    assert 83 not in seen[0] and 0 in seen[0]
    assert not {80, 81} & seen[1] and 0 in seen[1]
    assert 400 in seen[2] and 400 not in seen[3] and seen[3] == seen[4]
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, ran.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, docs.select("doc_id", "piece", "ids_crc32").collect()))
