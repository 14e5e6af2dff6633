"""The pipeline over odd tables: empty ones, null ids and texts, repeated rows, long texts, further columns."""

import random

import corpus_pipeline
from tests.llm.data import prose

EXTRA = ["'x' as predicted", "1 as kept", "2 as __did", "'y' as item_id", "3 as did", "4 as score", "'z' as component"]


def write(spark, folder, docs, labels=(), items=()):
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *EXTRA)
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return table


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows(spark, tmp_path):
    rng = random.Random(7)
    leak = prose(rng, 40)
    base = prose(rng, 80)
    docs = [(i, prose(rng, 60)) for i in range(10, 30)]
    docs += [(1, base), (2, base), (3, base + " more"), (None, prose(rng, 50)), (None, None), (40, None), (41, ""), (42, " \n\t"), (43, prose(rng, 20_000)), (44, f"{prose(rng, 30)} {leak} {prose(rng, 5)}"), docs[0], docs[0]]
    table = write(spark, tmp_path, docs, items=[(1, leak), (2, None), (3, "")])
    current, seen = table, {}
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
        current.write.parquet(f"{tmp_path}/out-{name}")
        current = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = current
        if name != "packing":
            assert current.columns == table.columns, name
    ids = lambda name: sorted((r["doc_id"] for r in seen[name].select("doc_id").collect()), key=str)
    every = sorted((i for i, _ in docs), key=str)
    assert ids("toxicity") == ids("line_dedup") == every  # without labels nothing is toxic
    assert ids("near_dedup") == sorted((i for i in every if i not in (2, 3)), key=str)
    assert ids("decontamination") == sorted((i for i in every if i not in (2, 3, 44)), key=str)
    kept = {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()}
    assert kept[40] is None and kept[41] == "" and len(kept[43].split()) == 20_000
    pieces = seen["packing"].select("doc_id", "piece", "length").collect()
    assert {r["doc_id"] for r in pieces} == set(ids("decontamination"))
    assert sum(r["doc_id"] == docs[0][0] for r in pieces) == 3 and max(r["length"] for r in pieces) <= 1024 and sum(r["doc_id"] == 43 for r in pieces) > 5
    whole = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, seen["packing"].select(columns).collect()))
