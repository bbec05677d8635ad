from collections import Counter

import corpus_pipeline as c
from loomtable.llm import jaccard, language, mixing, packing


def test_stages_take_effect(spark, docs, tmp_path):
    """Each stage does to its input what its operator says of it, and the run is their composition."""
    path = f"file://{tmp_path}/sf"
    docs.write.parquet(f"{path}/documents.parquet")
    data = spark.read.parquet(f"{path}/documents.parquet")
    row = lambda d: Counter(map(str, d.collect()))

    kept = c.keep_languages(spark, data, path)
    assert kept.columns == data.columns
    model = language.train(data)
    und = {r["doc_id"] for r in language.identify(data.select("doc_id", "text"), model).where("lang_pred = 'und'").collect()}
    assert {1, 2, 3, 15} <= und and {r["doc_id"] for r in kept.collect()}.isdisjoint(und - {None})
    one = c.drop_near_duplicates(spark, kept, path)
    assert one.columns == data.columns
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.join(kept).collect()}
    assert sorted(r["doc_id"] for r in one.where("doc_id IS NOT NULL").collect()) == sorted({v for v in groups.values() if v is not None})
    mixed = c.mix_sources(spark, one, path)
    times = Counter()
    for r in mixing.mix(one).collect():
        times[str(r["_row"])] += r["_taken"]
    assert row(mixed) == +times and mixed.columns == data.columns
    got, want = c.run(spark, path), packing.pack(mixed)
    cut = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert row(got.select(cut)) == row(want.select(cut))
    assert [n for n, _ in c.STAGES] == ["language_id", "near_duplicates", "mixing", "packing"]


def test_one_row_of_each_component_stays(spark):
    """Texts of one id lie in components of their own, and no name of a column is special."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, a, 0), (5, a, 1), (5, b, 2), (5, b, 3), (6, b, 4), (7, "", 5), (7, "", 6), (7, None, 7), (None, a, 8), (None, a, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int").selectExpr("*", "_gone AS row", "_gone AS text_hash", "_gone AS _id")
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (5, b), (7, ""), (7, None), (None, a), (None, a)], key=str)
    assert jaccard.deduplicated(docs).exceptAll(kept).count() == 0
    assert jaccard.deduplicated(docs.limit(0)).collect() == []
