"""The corpus pipeline on planted documents, against brute force for each stage."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from axonflow.llm.common import materialize


def planted(spark, folder):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    rows, labels, kinds = [], [], {}

    def add(text, kind):
        kinds[len(rows)] = kind
        rows.append((len(rows), text, "en", f"s{len(rows) % 3}", None if text is None else len(text)))

    for i in range(240):
        add(say(rng.randint(40, 120)), "clean")
        if i % 3 == 0:
            words = say(60).split()
            for bad in ("nasty", "vilest"):
                words.insert(rng.randrange(60), bad)
            add(" ".join(words), "toxic")
    for i in range(0, 40, 4):
        add(rows[i][1].replace(" ", "  ", 3) if kinds[i] == "clean" else rows[i][1], "copy" if kinds[i] == "clean" else "toxic")
    for i in range(1, 60, 6):
        if kinds[i] == "clean":
            add(rows[i][1] + " altogether", "near")
    add("password=abcdefgh12345678 " + say(50), "secret")
    add(None, "empty")
    for i, kind in kinds.items():
        if i % 2 == 0 or kind != "clean":
            labels.append((i, 1, int(kind == "toxic")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, kinds


def test_stages_keep_clean_documents_and_act_on_the_others(spark, tmp_path):
    rows, kinds = planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [set(kinds)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert len(corpus_pipeline.STAGES) == 5
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    toxic = {i for i, k in kinds.items() if k == "toxic"}
    assert len(toxic & kept[1]) <= 0.05 * len(toxic) and kept[0] - kept[1] <= toxic
    assert kept[1] - kept[2] == {i for i, k in kinds.items() if k == "copy"} & kept[1]
    assert kept[2] - kept[3] == {i for i, k in kinds.items() if k == "near"} & kept[2]
    assert kept[4] == kept[3]
    secret = next(i for i, k in kinds.items() if k == "secret")
    row = docs.where(F.col("doc_id") == secret).first()
    assert row["text"].startswith("[ASSIGN] ") and row["n_chars"] == len(row["text"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == kept[4]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in whole) == sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in pieces)
    assert sum(r["length"] for r in whole) == sum(len(np.frombuffer(r["ids"], "<u4")) for r in whole)


def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path):
    planted(spark, str(tmp_path))
    clash = ("key", "v", "share", "normal", "tokens", "row_id_", "score", "size", "n")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(60)
    for c in clash:
        docs = docs.withColumn(c, F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.where("false"), str(tmp_path)).count() == 0 and last(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 60


def test_duplicate_stages_decide_on_rows(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(2000)}" for _ in range(60)) for _ in range(4))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], schema)
    left = lambda stage, rows: sorted(((r["doc_id"], r["text"]) for r in stage(spark, frame(rows), "").collect()), key=str)
    rows = [(0, b, "s"), (1, a, "s"), (1, b, "s"), (None, b, "s"), (None, c, "s"), (None, c, "s"), (2, d, "s"), (2, d, "s"), (2, d, "t")]
    want = sorted([(0, b), (1, a), (None, c), (2, d)], key=str)
    assert left(corpus_pipeline.exact_stage, rows) == want
    near = [(0, b, "s"), (1, a, "s"), (1, b + " more", "s"), (None, b + " else", "s"), (None, c, "s"), (2, d, "s"), (2, d + " more", "s"), (None, None, "s")]
    assert left(corpus_pipeline.near_stage, near) == sorted([*want, (None, None)], key=str)
