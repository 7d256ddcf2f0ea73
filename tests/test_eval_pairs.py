import math
import tempfile

import pytest
from pyspark.sql import functions as F

from gridwork.operators.evaluate import binary_metrics, include_flag, split_accuracy, split_matrix
from gridwork.operators.pairs import (halve_classes, map_labels, one_negative_pairs, question_pairs,
                                      shuffle, train_eval_split)
from gridwork.operators.ranking import global_rank
from gridwork.operators.scoring import cosine_rank, map_distinct_text, score_distinct, translation_volume

GOLD = "doc_id string, table_id string, is_include boolean, row_split int, col_split int"


def test_include_and_accuracy(spark):
    gold = spark.createDataFrame([
        ("a", "t1", True, 1, 1), ("a", "t2", False, 2, 0), ("a", "t3", True, None, None),
        ("b", "t4", True, 0, 1), ("c", "t5", True, 1, 1)], GOLD)
    qs = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t4"), ("c", "t5"), ("x", "t9")],
                               "doc_id string, table_id string")
    flagged = include_flag(gold, qs)
    assert {r.table_id: r.is_include for r in flagged.collect()} == \
        {"t1": True, "t2": True, "t3": False, "t4": True, "t5": True}
    preds = spark.createDataFrame([
        ("a", "t1", "argmax_micro", 1, 1), ("a", "t2", "argmax_micro", 2, 0),
        ("b", "t4", "argmax_micro", 1, 1), ("a", "t1", "argmax_macro", 0, 0)],
        "doc_id string, table_id string, variant string, row_split int, col_split int")
    acc = {r.variant: (r.correct, r.total, r.accuracy) for r in split_accuracy(flagged, preds).collect()}
    # doc c has no predictions: t5 does not count; t3 is unlabelled
    assert acc["argmax_micro"] == (2, 3, 2 / 3)
    assert acc["argmax_macro"] == (0, 3, 0.0)
    mat = {(r.row_split, r.col_split): r.n for r in split_matrix(flagged).collect()}
    assert mat == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 2, (2, 0): 1, (2, 1): 0}


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "label int, pred int")
    r = binary_metrics(df).collect()[0]
    assert (r.accuracy, r.precision, r.recall) == (0.6, 2 / 3, 2 / 3)
    assert math.isclose(r.f1, 2 / 3)
    none = binary_metrics(spark.createDataFrame([(0, 0)], "label int, pred int")).collect()[0]
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_pairs(spark):
    qs = spark.createDataFrame([("q1", "how much?", "d", "t", "c1"), ("q2", "when?", "d", "t", None)],
                               "qid string, question string, doc_id string, table_id string, cell_id string")
    ss = spark.createDataFrame([("d", "t", "s1", "c1"), ("d", "t", "s2", "c2"), ("d", "t", "s3", None),
                                ("d", "u", "s4", "c1")],
                               "doc_id string, table_id string, sentence string, cell_id string")
    p = {(r.question, r.sentence): r.label for r in question_pairs(qs, ss).collect()}
    assert p == {("how much?", "s1"): 1, ("how much?", "s2"): 0, ("how much?", "s3"): 0,
                 ("when?", "s1"): 0, ("when?", "s2"): 0, ("when?", "s3"): 0}
    one = one_negative_pairs(qs, ss).collect()
    assert sum(r.label for r in one) == 1
    assert sum(1 for r in one if r.question == "how much?" and r.label == 0) == 1
    assert sum(1 for r in one if r.question == "when?") == 1


def test_exact_sizes(spark):
    rows = [("entailment", f"a{i}", "x") for i in range(7)] + \
           [("neutral", f"b{i}", "y") for i in range(5)] + [("contradiction", f"c{i}", "z") for i in range(6)]
    nli = spark.createDataFrame(rows, "label string, s1 string, s2 string")
    h = halve_classes(nli)
    counts = {r.label: r["count"] for r in h.groupBy("label").count().collect()}
    assert counts == {"entailment": 7, "neutral": 2, "contradiction": 3}   # round half to even
    m = map_labels(h)
    assert sorted({r.label for r in m.collect()}) == [0, 1]
    sh = shuffle(m).collect()
    assert sorted(r.shuffle_pos for r in sh) == list(range(1, 13))
    sp = train_eval_split(m)
    assert sum(1 for r in sp.collect() if r.split == "eval") == math.ceil(0.2 * 12)


def test_global_rank(spark):
    df = spark.range(0, 5000).withColumn("k", F.md5(F.col("id").cast("string")))
    r = global_rank(df, ["k"], partitions=7).collect()
    exp = {k: i + 1 for i, k in enumerate(sorted(x.k for x in r))}
    assert all(x.rank == exp[x.k] for x in r)


def test_scoring(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    calls = []

    def fn(p):
        calls.append(len(p))
        return [[float(len(t or ""))] for t in p["text"]]
    out = {r.text: r.type for r in score_distinct(df, ["text"], fn).collect()}
    assert out == {"a": [1.0], "bb": [2.0], None: [0.0]}
    tr = map_distinct_text(df, lambda s: s.map(lambda t: "A" if t == "a" else None)).collect()
    assert sorted((r.text or "", r.translated or "") for r in tr) == [("", ""), ("a", "A"), ("a", "A"), ("bb", "bb")]
    vol = translation_volume(spark.createDataFrame([("abc",), ("a$",), ("売上高",), ("①",)], "text string"))
    r = vol.collect()[0]
    assert (r.n_texts, r.n_translate, r.chars) == (4, 2, 3)


def test_cosine_rank(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, v array<double>")
    r = {x.id: (x.rank, x.score) for x in cosine_rank(q, docs, "qid", "v", "id", "v").collect()}
    assert r[1] == (1, 1.0) and r[3][0] == 2 and r[2] == (3, 0.0)


def test_cosine_rank_in_blocks(spark, monkeypatch):
    from gridwork.operators import scoring
    docs = spark.range(30).select("id", F.array(F.col("id") * 1.0, F.lit(7.0)).alias("v"))
    q = spark.range(25).select(F.col("id").alias("qid"), F.array(F.lit(3.0), F.col("id") * 1.0 + 1).alias("v"))
    whole = sorted(cosine_rank(q, docs, "qid", "v", "id", "v").select("qid", "id", "score", "rank").collect())
    monkeypatch.setattr(scoring, "QUERY_BLOCK", 4)
    assert sorted(cosine_rank(q, docs, "qid", "v", "id", "v").select("qid", "id", "score", "rank").collect()) == whole
    top = cosine_rank(q, docs, "qid", "v", "id", "v", top_k=3).select("qid", "id", "score", "rank").collect()
    assert sorted(top) == [r for r in whole if r["rank"] <= 3] and len(whole) == 750


def test_first_k_with_a_hot_group(spark):
    from gridwork.operators.ranking import first_k_per_group
    hot = spark.range(0, 20000).select(F.lit("hot").alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    cold = spark.range(0, 30).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("g"),
                                     F.md5(F.col("id").cast("string")).alias("k"))
    df = hot.unionByName(cold)
    sizes = df.select("g", F.when(F.col("g") == "hot", 7001).otherwise(4).alias("k")).distinct()
    rows = first_k_per_group(df.withColumnRenamed("k", "key").repartition(7), "g", "key", sizes).collect()
    kept = {}
    for r in rows:
        kept.setdefault(r.g, []).append((r.key, r._keep))
    for g, xs in kept.items():
        want = 7001 if g == "hot" else 4
        xs.sort()
        assert [k for k, keep in xs if keep] == [k for k, _ in xs[:want]], g
    assert len(rows) == 20030


def test_first_k_of_all_and_none(spark):
    from gridwork.operators.ranking import first_k_per_group
    df = spark.createDataFrame([(g, f"{i:032x}") for g in "ab" for i in (1, 1, 2)], "g string, key string")
    sizes = spark.createDataFrame([("a", 3), ("b", 0)], "g string, k long")
    assert sorted((r.g, r._keep) for r in first_k_per_group(df, "g", "key", sizes).collect()) == [("a", True)] * 3 + [("b", False)] * 3


def test_every_question_draws_its_own_negative(spark):
    qs = spark.createDataFrame([(f"q{i}", f"text {i}", "d", "t", f"c{i % 10}") for i in range(200)]
                               + [("lone", "only own", "d", "u", "c1")],
                               "qid string, question string, doc_id string, table_id string, cell_id string")
    ss = spark.createDataFrame([("d", "t", f"s{i}", f"c{i % 10}" if i % 7 else None) for i in range(60)] + [("d", "u", "s", "c1")],
                               "doc_id string, table_id string, sentence string, cell_id string")
    rows = one_negative_pairs(qs, ss).collect()
    negative = {r.question: r.sentence for r in rows if r.label == 0}
    cell = {r.sentence: r.cell_id for r in ss.collect()}
    assert len([r for r in rows if r.label == 0]) == len(negative) == 200 and "only own" not in negative
    assert all(cell[negative[f"text {i}"]] != f"c{i % 10}" for i in range(200))
    assert len(set(negative.values())) > 40


def test_other_classes_are_left_out_and_counted(spark):
    from gridwork.operators.pairs import unknown_classes
    rows = [("entailment", "a"), ("neutral", "b"), ("neutral", "c"), ("odd", "d"), (None, "e")]
    nli = spark.createDataFrame(rows, "label string, s1 string")
    assert sorted(r.label for r in halve_classes(nli).collect()) == ["entailment", "neutral"]
    assert {(r.label, r.n) for r in unknown_classes(nli).collect()} == {("odd", 1), (None, 1)}


def _tied(spark, n=30_000):
    """A third of all rows are equal."""
    df = spark.range(n, numPartitions=6).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("s1"), F.lit("x").alias("s2"))
    return df.withColumn("label", F.lit(1))


def test_ranks_of_equal_rows_are_many_tasks(spark, monkeypatch):
    from gridwork.operators import ranking
    stored = []
    keep = ranking.cut_lineage
    monkeypatch.setattr(ranking, "cut_lineage", lambda df: stored.append(keep(df)) or stored[-1])
    ranked = global_rank(_tied(spark), ["s1"], ties=True, partitions=12)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 30_001))
    sizes = [r["count"] for r in stored[-1].groupBy("_pid").count().collect()]
    assert max(sizes) < 30_000 / 6
    same = [r["rank"] for r in ranked.filter("s1 = 'same'").collect()]
    assert max(same) - min(same) == len(same) - 1 == 9_999


def test_exact_sizes_with_a_third_of_rows_equal(spark):
    df = _tied(spark)
    split = train_eval_split(df, 0.2)
    assert split.groupBy("split").count().orderBy("split").collect() == [("eval", 6000), ("train", 24000)]
    # the selection is by key: equal rows straddle the edge at most at one key
    kinds = {(r.s1 == "same", r.split): r["count"] for r in split.groupBy("s1", "split").count().collect()}
    assert sum(v for (same, _), v in kinds.items() if same) <= 10_000
    nli = df.withColumn("label", F.lit("neutral")).unionByName(_tied(spark, 999).withColumn("label", F.lit("contradiction")))
    got = {r.label: r["count"] for r in halve_classes(nli).groupBy("label").count().collect()}
    assert got == {"neutral": 15_000, "contradiction": 500}
    order = shuffle(df).collect()
    assert sorted(r.shuffle_pos for r in order) == list(range(1, 30_001))


@pytest.mark.parametrize("pairs", [[(0, 0)], [(2, 3)], [(1, 1), (1, 1), (4, 0), (4, 5)], [(0, 2), (3, 3)], []])
def test_runs_make_up_the_matrix(spark, pairs):
    from gridwork.operators.evaluate import split_runs
    gold = spark.createDataFrame([("D", f"t{i}", True, r, c) for i, (r, c) in enumerate(pairs)],
                                 "doc_id string, table_id string, is_include boolean, row_split int, col_split int")
    wanted = {(r, c): pairs.count((r, c)) for r in range(max([r for r, _ in pairs], default=-1) + 1)
              for c in range(max([c for _, c in pairs], default=-1) + 1)}
    assert sorted(map(tuple, split_matrix(gold).collect())) == sorted((r, c, n) for (r, c), n in wanted.items())
    area = [(r, c) for x in split_runs(gold).collect() for r in range(x.row_from, x.row_to + 1) for c in range(x.col_from, x.col_to + 1)]
    assert sorted(area) == sorted(wanted)
    part = split_matrix(gold, rows=(1, 2), cols=(1, 3)).collect()
    assert sorted(map(tuple, part)) == sorted((r, c, n) for (r, c), n in wanted.items() if 1 <= r <= 2 and 1 <= c <= 3)


def test_a_wrong_label_costs_no_matrix(spark):
    from gridwork.operators.evaluate import split_runs
    gold = spark.createDataFrame([("D", "a", True, 1, 1), ("D", "b", True, 10 ** 6, 10 ** 6)],
                                 "doc_id string, table_id string, is_include boolean, row_split int, col_split int")
    runs = split_runs(gold).collect()
    assert len(runs) <= 8 and sum((r.row_to - r.row_from + 1) * (r.col_to - r.col_from + 1) for r in runs) == (10 ** 6 + 1) ** 2
    assert sorted(map(tuple, split_matrix(gold, rows=(0, 1), cols=(0, 1)).collect())) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 1)]


def test_stored_results_are_not_scored_again(spark, tmp_path):
    from gridwork.operators.scoring import score_stored
    log, place = str(tmp_path / "log"), str(tmp_path / "store")
    (tmp_path / "log").mkdir()

    def load(version):
        def start():
            import os
            import uuid

            def fn(pdf):
                with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                    f.write(f"{os.getpid()} {len(pdf)}")
                return [None if t is None else [float(len(t)), float(version)] for t in pdf["text"]]
            return fn
        return start

    def scored():
        return sum(int(p.read_text().split()[1]) for p in (tmp_path / "log").iterdir())

    df = spark.createDataFrame([("a",), ("bb",), ("a",), (None,), ("",)], "text string")
    wanted = [("", [0.0, 1.0]), ("a", [1.0, 1.0]), ("a", [1.0, 1.0]), ("bb", [2.0, 1.0])]
    for _ in range(2):
        got = score_stored(df, ["text"], load(1), place, "v1").collect()
        assert sorted((r.text, list(r.type)) for r in got if r.text is not None) == wanted and len(got) == 5
        assert scored() == 4
    more = score_stored(df.union(spark.createDataFrame([("ccc",)], "text string")), ["text"], load(1), place, "v1")
    assert more.count() == 6 and scored() == 5
    assert {tuple(r.type) for r in score_stored(df, ["text"], load(2), place, "v2").collect() if r.text} == {(1.0, 2.0), (2.0, 2.0)}
    assert scored() == 9
    assert score_stored(df.limit(0), ["text"], load(3), place, "v3").count() == 0 and scored() == 9


def test_stored_results_meet_rows_by_the_input(spark):
    """F16: addresses (64 characters a row) stay with the distinct inputs; kinds of inputs with several texts keep theirs."""
    from gridwork.operators.scoring import score_stored
    place = tempfile.mkdtemp(prefix="gridwork-results-") + "/r"
    load = lambda: lambda p: [[float(len(repr(v)))] for v in p.iloc[:, 0]]
    rows = [(1, "a"), (2, "a"), (None, None), (3, None), (1, "a"), (4, "")]
    df = spark.createDataFrame(rows, "i long, text string")
    got = score_stored(df, ["text"], load, place, "f16", out="p")
    assert sorted((str(r.i), str(r.text), r.p[0]) for r in got.collect()) == sorted(
        (str(i), str(t), float(len(repr(t)))) for i, t in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" in plan.split("Join", 2)[1]
    stored = spark.read.parquet(f"{place}/version=f16")
    assert stored.count() == 3 and stored.columns == ["key", "p"]
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (0.0,)], "x double")
    assert score_stored(zeros, ["x"], load, place, "f16-x", out="p").filter("p is not null").count() == 3
