from ledgerloom.operators import scoring


def test_rows_that_the_first_key_pairs_go_no_further(spark, monkeypatch):
    gold = spark.createDataFrame([("g1", "a", 1), ("g2", "b", 2), ("g3", None, 3)], "gold_id string, x string, y int")
    pred = spark.createDataFrame([("p1", "a", 1), ("p2", "c", 2), ("p3", None, 3)], "pred_id string, x string, y int")
    kept = {}
    real = scoring.written
    monkeypatch.setattr(scoring, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    found = scoring.align_unique(gold, pred, [["x", "y"], ["y"]])
    assert sorted(tuple(r) for r in found.collect()) == [("g1", "p1", 1), ("g2", "p2", 2), ("g3", "p3", 2)]
    paired = kept["first-pairs"].where("_step is not null").collect()
    assert [(r["_id"], r["_with"], r["x"], r["y"]) for r in paired] == [("g1", "p1", None, None)]
    assert kept["first-pairs"].count() == 5
