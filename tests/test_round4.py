"""Findings of round 4: what large tables leave on the disk, and the whole of C1."""

import os
from collections import Counter
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from gridwork import session
from gridwork.plans import io_queries, oracle_sql, queries, report  # noqa: F401  (io_queries registers its queries)
from gridwork.plans.oracle_queries import ORACLE
from gridwork.sources import store

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"
LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_discount double, l_shipdate timestamp")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders 0 to 59 of seven customers with one to four lines each."""
    d = str(tmp_path_factory.mktemp("tables"))
    day = datetime(2021, 3, 4)
    orders = [(k, k % 7, "O", "1-URGENT", day) for k in range(60)]
    lines = [(k, k + i, i, i, 1.5 * i + k, 100.25 + k, 0.05, day) for k in range(60) for i in range(1, k % 4 + 2)]
    spark.createDataFrame(orders, ORDERS).coalesce(1).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return d


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def by_sql(d, name, columns):
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet/*.parquet')")
    return Counter(c.execute(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall())


def stages(spark):
    return {f for f in os.listdir(session.checkpoint_dir(spark)) if f.startswith("stage-")}


SLICED = ["best_splits", "sentences_keep_empty", "table_status", "append_scale"]


@pytest.mark.parametrize("name", SLICED)
def test_slices_of_documents_give_all_rows_and_leave_only_them(spark, tables, monkeypatch, name):
    monkeypatch.setattr(report, "SLICE_LINES", 80)
    before = stages(spark)
    got = queries.REGISTRY[name](spark, tables)
    assert len(stages(spark) - before) == 1  # the result: every slice's stages are gone
    assert rows(got) == by_sql(tables, name, got.columns) and got.count()


@pytest.mark.parametrize("name", ["map_distinct_text", "score_distinct_cells", "score_stored_cells"])
def test_slices_of_texts_ask_once_for_each(spark, tables, monkeypatch, name):
    monkeypatch.setattr(report, "SLICE_LINES", 80)
    before = stages(spark)
    got = queries.REGISTRY[name](spark, tables)
    if name != "score_stored_cells":
        assert len(stages(spark) - before) == 1
    label = ["type", "label"] if "label" in got.columns else ["translated"]
    texts = {}
    grid = report.report_grid(spark, tables).filter("text is not null").select("doc_id", "table_id", "r", "c", "text")
    for r in grid.join(got.select("doc_id", "table_id", "r", "c", *label), ["doc_id", "table_id", "r", "c"]).collect():
        texts.setdefault(r["text"], set()).add(str([r[x] for x in label]))
    assert got.count() == grid.count() and texts and all(len(v) == 1 for v in texts.values())
    if name == "score_stored_cells":  # every text has one stored result
        folder = max((f for f in os.listdir(session.checkpoint_dir(spark)) if f.startswith("results-")),
                     key=lambda f: os.path.getmtime(f"{session.checkpoint_dir(spark)}/{f}"))
        assert spark.read.parquet(f"{session.checkpoint_dir(spark)}/{folder}").count() == len(texts)


def test_pages_of_a_slice_make_room_for_the_next(spark, tables, monkeypatch):
    monkeypatch.setattr(report, "SLICE_LINES", 80)
    seen, write = [], io_queries.io.write_corpus
    monkeypatch.setattr(io_queries.io, "write_corpus", lambda pages, root: seen.append((root, write(pages, root))))
    got = queries.REGISTRY["corpus_scan"](spark, tables)
    assert rows(got) == by_sql(tables, "corpus_scan", got.columns)
    assert len(seen) == 2 and sum(n for _, n in seen) == 21  # three files of each of seven customers
    assert not any(os.path.exists(root) for root, _ in seen)


def test_csv_files_of_a_store_are_packed(spark, tmp_path):
    df = spark.createDataFrame([("d", "a\nb", ""), ("e", None, '"x, ')], "doc_id string, s string, t string")
    store.write_store(df, str(tmp_path / "s"), fmt="csv")
    files = [f for f in os.listdir(tmp_path / "s/files") if f.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert rows(store.read_store(spark, str(tmp_path / "s"), df.schema, fmt="csv")) == rows(df)
    assert store.store_errors(spark, str(tmp_path / "s"), df.schema, fmt="csv").count() == 0


def test_stages_and_shuffles_go_with_their_slice(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("k")).union(spark.createDataFrame([(-1, None)], "id long, k long"))
    seen, before = [], stages(spark)

    def job(part):
        seen.append(rows(part.select("k").distinct()))
        return session.cut_lineage(part.groupBy("k").agg(F.sum("id").alias("s")))

    got = session.in_slices(df, "k", 3, job)
    assert rows(got) == rows(df.groupBy("k").agg(F.sum("id").alias("s")))
    assert len(seen) == 3 and sum(seen, Counter()) == Counter([(k,) for k in [*range(10), None]])
    assert len(stages(spark) - before) == 1
    assert rows(session.in_slices(df.limit(0), "k", 3, lambda part: part)) == Counter()


def test_a_stage_leaves_no_shuffle(spark):
    setting, tracker = spark.conf.get(session.CLEAN_SHUFFLES), spark._jsc.sc().env().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    session.cut_lineage(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert tracker.shuffleStatuses().size() <= before
    assert spark.conf.get(session.CLEAN_SHUFFLES) == setting


FOREIGN = ["㈱①", "１２㌔", "ﾊﾟ½", "か゛", "Å", "①２千円", "(単位:百万円)", "12.50", "", None]


def test_normalized_slots_folds_every_text(spark, tables, monkeypatch):
    import unicodedata
    slots = spark.createDataFrame(
        [("d", "p", "t", 0, i, 0, i, None, t, None) for i, t in enumerate(FOREIGN)],
        "doc_id string, page_id string, table_id string, table_ord long, r int, c int, src_ord int, cell_id string, text string, type array<double>")
    monkeypatch.setattr(report, "report_grid", lambda spark, sf_dir: slots)
    got = {r["r"]: r["text"] for r in queries.REGISTRY["normalized_slots"](spark, tables).collect()}
    want = {i: t if t is None else unicodedata.normalize("NFKC", t).replace(" ", "") for i, t in enumerate(FOREIGN)}
    want |= {5: "12000000000", 1: "12キロ", 7: "12500000.00"}  # 12 thousand yen; all numbers are millions
    assert got == want


def test_sql_folds_every_text():
    import unicodedata
    texts = [t for t in FOREIGN if t] + [chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) != "Cn"]
    c = duckdb.connect()
    c.execute("create table t (i int, x varchar)")
    c.executemany("insert into t values (?, ?)", [*enumerate(texts)][:400])
    got = dict(c.execute(f"select i, {oracle_sql.nfkc('x')} from t").fetchall())
    assert got == {i: unicodedata.normalize("NFKC", t) for i, t in enumerate(texts[:400])}
