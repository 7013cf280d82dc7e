"""Pages nested deeper than any label looks, and benchmark ids of any type."""

from quarrykit.llm import benchmark_align, block_lstm


def test_deep_nesting_keeps_levels():
    inner = "<p>in the middle</p>"
    html = "<article>" + "<div>" * 5000 + inner + "</div>" * 5000 + "<p>after all</p></article><footer>foot</footer></b></i></section>"
    got = block_lstm.blocks(html)
    assert [t for _, t, _ in got] == ["in the middle", "after all", "foot"]
    assert len(got[0][0]) == block_lstm.NEAR and [x for x in got[1][0]] == ["article", "p"] and got[2][0] == ("footer",)
    wide = block_lstm.blocks("<div><p>x</p>" * 3000)
    assert len(wide) == 3000


def test_item_ids_of_any_type(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, "zero " + text, 1), (2, None, 1), (3, "", 1), (3, text, 1), (3, text, 1)], "doc_id bigint, text string, item_id int")
    for kind, key in (("smallint", 7), ("string", "7"), ("decimal(9,0)", None), ("date", None)):
        bench = spark.createDataFrame([(str(key) if key else "2020-01-01" if kind == "date" else "7", text), (None, text), ("7" if kind != "date" else "2020-01-01", None)], "item_id string, text string").selectExpr(f"cast(item_id AS {kind}) AS item_id", "text")
        got = benchmark_align.find_contamination(docs, bench)
        assert dict(got.dtypes)["item_id"] == kind and sorted(str(r.doc_id) for r in got.collect()) == ["3", "3", "None"]
        assert benchmark_align.drop_contaminated(docs, bench).count() == 2
        assert benchmark_align.drop_contaminated(docs, bench.limit(0)).count() == 5
