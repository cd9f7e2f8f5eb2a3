import corpus_pipeline as P


def test_stages_keep_what_they_should(spark, made, tmp_path):
    good = [" ".join(f"w{i}x{k}" for k in range(90)) for i in range(40)]
    rows = [(i, good[i], f"s{i % 3}") for i in range(40)] + [(100, good[3], "s0"), (101, good[4].replace("w4x50", "changed"), "s1"), (102, "too short", "s2"), (103, " ".join(f"b{k}" for k in range(40)) + " " + good[5][:200], "s2"), (104, None, None)]
    made(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert docs.columns == P.COLUMNS
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert left[0] == [*range(40), 100, 101, 103]
    assert left[1] == [*range(40), 103]
    assert left[2] == [*range(40)]
    assert set(left[3]) <= set(range(40)) and left[3] == left[4]
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == set(left[4])


def test_repeated_rows_leave_one(spark, made, tmp_path):
    text = " ".join(f"w{k}" for k in range(60))
    docs = made([(1, text, "s"), (1, text, "s"), (2, text, "s"), (None, text, "s")])
    assert sorted(str(r.doc_id) for r in P.near_dedup(spark, docs, "").collect()) == ["1", "None"]


def test_repeated_and_missing_ids(spark, made):
    text = lambda p: " ".join(f"{p}{k}" for k in range(60))
    near = text("c").replace("c59", "end")
    docs = made([(61, text("a"), "s"), (62, text("a"), "s"), (62, text("b"), "s"), (3, text("c"), "s"), (7, near, "s"), (7, text("d"), "s"), (None, text("e"), "s"), (None, text("e"), "s"), (None, text("f"), "s")])
    left = sorted((str(r.doc_id), r.text[:2]) for r in P.near_dedup(spark, docs, "").collect())
    assert left == [("3", "c0"), ("61", "a0"), ("62", "b0"), ("7", "d0"), ("None", "e0"), ("None", "f0")]
