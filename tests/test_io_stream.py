import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gridwork.sources import io
from gridwork.sources.rules import read_rules
from gridwork.streaming.extract_stream import start_extraction

PAGE = ('<html><body><p>(1) 売上</p><table table-id="S100ABCD-0000000-tab1">'
        '<tr><th></th><th>金額(千円)</th></tr><tr><td>品目</td><td>1,234</td></tr></table>'
        '<table table-id="S100ABCD-0000000-tab2"><tr><td>(単位:百万円)</td><td>5</td></tr></table>'
        '<table table-id="S100ABCD-0000000-tab3"><tr><td>x</td><td>7</td></tr></table></body></html>')


def _corpus():
    root = tempfile.mkdtemp(prefix="gridwork-corpus-")
    os.makedirs(f"{root}/S100ABCD")
    with open(f"{root}/S100ABCD/report.html", "w", encoding="utf-8") as f:
        f.write(PAGE)
    with open(f"{root}/top.html", "w", encoding="utf-8") as f:   # not one level down: ignored
        f.write(PAGE)
    return root


def test_scan_corpus(spark):
    pages = io.scan_corpus(spark, _corpus()).collect()
    assert [(p.doc_id, p.page_id) for p in pages] == [("S100ABCD", "report.html")]


def test_streaming_extraction(spark):
    root = _corpus()
    out = tempfile.mkdtemp(prefix="gridwork-out-") + "/slots"
    ckpt = tempfile.mkdtemp(prefix="gridwork-stream-ckpt-")
    q = start_extraction(spark, root, out, ckpt, trigger_once=True)
    q.awaitTermination(120)
    got = {(r.table_id[-4:], r.r, r.c): r.text for r in spark.read.parquet(out).collect()}
    assert got[("tab1", 1, 1)] == "1234000"          # (千円) anchor above
    assert got[("tab2", 0, 1)] == "5000000"          # sheet unit
    assert got[("tab3", 0, 1)] == "7000000"          # carried from tab2


def test_streaming_does_not_depend_on_arrival(spark):
    """Two files of a document, together or one after the other; a batch run twice."""
    unit = PAGE.replace('<tr><td>x</td><td>7</td></tr>', '<tr><td>(単位:百万円)</td><td>1</td></tr>')
    plain = '<table table-id="S100ABCD-0000000-tab9"><tr><td>8</td></tr></table>'

    def run(steps):
        root = tempfile.mkdtemp(prefix="gridwork-corpus-")
        os.makedirs(f"{root}/S100ABCD")
        out, ckpt = (tempfile.mkdtemp(prefix=f"gridwork-{x}-") for x in ("out", "stream-ckpt"))
        for files in steps:
            for name, html in files.items():
                with open(f"{root}/S100ABCD/{name}", "w", encoding="utf-8") as f:
                    f.write(html)
            start_extraction(spark, root, f"{out}/slots", ckpt, trigger_once=True).awaitTermination(120)
        return sorted((r.page_id, r.table_id, r.r, r.c, r.text) for r in spark.read.parquet(f"{out}/slots").collect())

    a, b = {"a.html": unit}, {"b.html": plain}
    got = run([a | b])
    assert got == run([b, a]) and [x[4] for x in got if x[0] == "b.html"] == ["8"]


def test_last_file_has_a_repeated_table(spark):
    from gridwork.operators.extract import extract_tables, parse_pages
    one = '<table table-id="t"><tr><td>{}</td></tr></table>'
    pages = spark.createDataFrame([("D", f"{x}.html", one.format(x)) for x in "acb"], "doc_id string, page_id string, html string")
    assert [r.text for r in extract_tables(parse_pages(pages)).collect()] == ["c"]


def test_json_round_trips(spark):
    d = tempfile.mkdtemp(prefix="gridwork-json-")
    qpath = f"{d}/q.json"
    with open(qpath, "w", encoding="utf-8") as f:
        json.dump({"q1": {"question": "いくら?", "doc_id": "D", "table_id": "D-tab1", "cell_id": "c1"}}, f,
                  ensure_ascii=False, indent=4)
    qs = io.read_questions(spark, qpath).collect()
    assert [(r.qid, r.table_id, r.cell_id) for r in qs] == [("q1", "D-tab1", "c1")]
    gold = spark.createDataFrame([("D", "D-tab10", True, 1, 2), ("D", "D-tab2", False, None, None),
                                  ("E", "E-x", True, 0, 0)],
                                 "doc_id string, table_id string, is_include boolean, row_split int, col_split int")
    gj = io.gold_json(gold).collect()
    assert [r.doc_id for r in gj] == ["D", "E"]
    assert list(json.loads(gj[0].json)["D"]) == ["D-tab2", "D-tab10"]
    io.write_json_lines(io.gold_json(gold), f"{d}/gold")
    back = {(r.table_id, r.is_include, r.row_split, r.col_split)
            for r in io.read_gold(spark, f"{d}/gold").collect()}
    assert back == {("D-tab10", True, 1, 2), ("D-tab2", False, None, None), ("E-x", True, 0, 0)}
    preds = spark.createDataFrame([("D", "D-tab1", "argmax_micro", 1, 1)],
                                  "doc_id string, table_id string, variant string, row_split int, col_split int")
    io.write_json_lines(io.predictions_json(preds), f"{d}/pred")
    pb = io.read_predictions(spark, f"{d}/pred").collect()
    assert [(r.table_id, r.variant, r.row_split) for r in pb] == [("D-tab1", "argmax_micro", 1)]


def test_tsv_rules_slots(spark):
    d = tempfile.mkdtemp(prefix="gridwork-tsv-")
    with open(f"{d}/nli.tsv", "w", encoding="utf-8") as f:
        f.write("entailment\ta\tb\nneutral\tc\td\n")
    df = io.read_tsv(spark, f"{d}/nli.tsv", ["label", "s1", "s2"], usecols=[0, 2, 1])
    assert [tuple(r) for r in df.collect()] == [("entailment", "a", "b"), ("neutral", "c", "d")]
    with open(f"{d}/rules.csv", "w", encoding="utf-8") as f:
        f.write("（百万円）,1000000\n(円),\n(%),0.01\n（百万円）,1000\n")
    rules = {r.key: (r.mult, r.ord) for r in read_rules(spark, f"{d}/rules.csv").collect()}
    assert rules == {"(百万円)": ("1000", 1), "(%)": ("0.01", 2)}
    slots = spark.createDataFrame([("D", "t", 0, 0, 0, 0, None, "x", None)],
                                  "doc_id string, table_id string, table_ord long, r int, c int, src_ord int, "
                                  "cell_id string, text string, type array<double>")
    io.write_slots(slots, f"{d}/slots")
    assert io.read_slots(spark, f"{d}/slots", ["D"]).count() == 1
    sent = spark.createDataFrame([("D", "t", 1, 1, "s", "c", "x")],
                                 "doc_id string, table_id string, r int, c int, sentence string, cell_id string, data string")
    ctx = spark.createDataFrame([("D", "t", "ctx", "t-aboveparagraph", "")],
                                "doc_id string, table_id string, sentence string, cell_id string, data string")
    once = io.with_context(sent, ctx)
    assert io.with_context(once, ctx).count() == once.count() == 2


def test_write_corpus(spark, tmp_path):
    rows = [("d1", "a.html", "<p>一</p>\n"), ("d1", "b.html", None), ("d2", "a.html", "")]
    pages = spark.createDataFrame(rows, "doc_id string, page_id string, html string").repartition(3)
    root = f"file://{tmp_path}/corpus"
    assert io.write_corpus(pages, root) == 3
    assert io.write_corpus(pages, root) == 3  # tried again: the same files
    assert sorted(os.listdir(tmp_path / "corpus" / "d1")) == ["a.html", "b.html"]
    got = {(r["doc_id"], r["page_id"]): r["html"] for r in io.scan_corpus(spark, root).collect()}
    assert got == {("d1", "a.html"): "<p>一</p>\n"}  # Spark does not list empty files
    assert io.write_corpus(pages.limit(0), f"{root}-empty") == 0
    for bad in ("a/b", None, ".."):
        with pytest.raises(Exception, match="no file name"):
            io.write_corpus(pages.withColumn("page_id", F.lit(bad).cast("string")), root)


def test_corpus_scan_writes_no_file_by_spark(spark, monkeypatch, tmp_path):
    """A file for every page through Spark's text writer took more than 29 ms each."""
    from gridwork.plans import io_queries
    from gridwork.sources import fixtures
    html = '<table table-id="{0}-tab1"><tr><td>{0}</td></tr></table>'
    pages = spark.createDataFrame([("S1", "S1/part0.html", html.format("a")), ("S1", "S1/part1.html", html.format("b")),
                                   (None, None, None)], "doc_id string, page_id string, html string")
    monkeypatch.setattr(fixtures, "report_pages", lambda *a: pages)
    monkeypatch.setattr(io_queries, "scratch", lambda *a: str(tmp_path / "corpus"))
    got = {(r["doc_id"], r["table_id"], r["text"]) for r in io_queries.corpus_scan(spark, "").collect()}
    assert got == {("S1", "a-tab1", "a"), ("S1", "b-tab1", "b")}
    files = sorted(str(p.relative_to(tmp_path / "corpus")) for p in (tmp_path / "corpus").rglob("*") if p.is_file())
    assert files == ["S1/part0.html", "S1/part1.html", "null/null"]
