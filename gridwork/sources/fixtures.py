"""Inputs derived from the driver tables (see FIXTURES.md).

The driver data has no report HTML, so report tables are derived from
``lineitem`` joined with ``orders``: a document is a customer, a table is an
order, a data row is a line item. Every builder here is a plain Spark job over
the given tables, so its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwork.schema import SLOT_COLS
from gridwork.session import in_parts, read_table

N_COLS = 5


def _e(s: str) -> Column:
    return F.expr(s)


def _ymd(ts: str) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("年"), F.month(ts).cast("string"),
                    F.lit("月"), F.dayofmonth(ts).cast("string"), F.lit("日"))


def _num(x: str) -> Column:
    return F.col(x).cast("decimal(15,2)").cast("string")


def doc_id_of(custkey: Column) -> Column:
    s = custkey.cast("string")
    return F.concat(F.lit("S"), F.lpad(s, F.greatest(F.lit(7), F.length(s)), "0"))


def page_id_of(doc: Column, orderkey: Column) -> Column:
    """The report file of an order's table: three files a document."""
    return F.concat(doc, F.lit("/part"), (orderkey % 3).cast("string"), F.lit(".html"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered inside their order (``r`` from 1) with the order's customer.

    Input derivation only: the numbering is a window per order, so one huge
    order would be numbered in one task (``operators.ranking.global_rank``
    gives a range-partitioned alternative at the cost of a checkpoint)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumn("r", F.row_number().over(w)))


def _table_cols(df: DataFrame) -> DataFrame:
    doc = doc_id_of(F.col("o_custkey"))
    return (df.withColumn("doc_id", doc)
            .withColumn("table_id", F.concat(F.col("doc_id"), F.lit("-0000000-tab"),
                                             F.col("o_orderkey").cast("string")))
            .withColumn("page_id", page_id_of(doc, F.col("o_orderkey")))
            .withColumn("table_ord", F.col("o_orderkey"))
            .withColumn("k", F.col("o_orderkey") % 4))


def _table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every report table: ``s`` has their cells ``(c, t)`` from left to right."""
    lines = _table_cols(report_lines(spark, sf_dir))
    data = lines.select(
        "doc_id", "page_id", "table_id", "table_ord", "k", "r",
        F.array(
            F.struct(F.lit(0).alias("c"), F.concat(F.lit("品目"), F.col("r").cast("string")).alias("t")),
            F.struct(F.lit(1).alias("c"), _num("l_quantity").alias("t")),
            F.struct(F.lit(2).alias("c"), F.when(
                (F.col("k") >= 2) & (_e("o_orderkey div 4") % 5 == 0) & (F.col("r") == 1),
                F.concat(F.lit("千米ドル"), _num("l_extendedprice")),
            ).otherwise(_num("l_extendedprice")).alias("t")),
            F.struct(F.lit(3).alias("c"), _num("l_discount").alias("t")),
            F.struct(F.lit(4).alias("c"), _ymd("l_shipdate").alias("t")),
        ).alias("s"))

    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    keys = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    heads = _table_cols(orders.join(keys, "o_orderkey", "left_semi")).select(
        "doc_id", "page_id", "table_id", "table_ord", "k", F.lit(0).alias("r"),
        F.array(
            F.struct(F.lit(0).alias("c"),
                     F.when(F.col("k") == 3, F.lit("(単位:百万円)")).otherwise(F.lit("")).alias("t")),
            F.struct(F.lit(1).alias("c"), F.lit("数量").alias("t")),
            F.struct(F.lit(2).alias("c"),
                     F.when(F.col("k") == 0, F.lit("金額(千円)"))
                     .when(F.col("k") == 1, F.lit("金額(百万円)"))
                     .otherwise(F.lit("金額")).alias("t")),
            F.struct(F.lit(3).alias("c"),
                     F.when(F.col("k") < 2, F.lit("割引(%)")).otherwise(F.lit("割引")).alias("t")),
            F.struct(F.lit(4).alias("c"), F.lit("出荷日").alias("t")),
        ).alias("s"))
    return data.unionByName(heads)


def _cell(c: Column, t: Column) -> tuple[Column, Column, Column]:
    """Whether the slot at column ``c`` of a row is unfilled, its text and its cell id."""
    key, r = F.col("table_ord"), F.col("r")
    inner = (r > 0) & (c > 0)
    unfilled = inner & ((key * 7 + r * 3 + c) % 23 == 0)
    blank = inner & ((key * 5 + r * 11 + c) % 19 == 0)
    text = F.when(unfilled, F.lit(None).cast("string")).when(blank, F.lit("")).otherwise(t)
    cell_id = F.when(unfilled | ((key + r + c) % 29 == 0), F.lit(None).cast("string")).otherwise(
        F.concat(F.col("table_id"), F.lit("-R"), r.cast("string"), F.lit("C"), c.cast("string")))
    return unfilled, text, cell_id


def report_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture ``slots`` table: one 5-column report table per order.

    Row 0 holds headers whose unit words depend on ``k = orderkey % 4``; data
    rows hold quantity, price, discount and ship date. Some data slots are
    left unfilled (NULL) or empty, one price per order of some N/U tables
    carries a prefix unit, and every filled slot gets 4 class probabilities
    from an integer hash.
    """
    g = _table_rows(spark, sf_dir).withColumn("s", F.explode("s")).select(
        "doc_id", "page_id", "table_id", "table_ord", "k", "r", "s.c", "s.t")
    key = F.col("table_ord")
    r, c = F.col("r"), F.col("c")
    inner = (r > 0) & (c > 0)
    unfilled, text, cell_id = _cell(c, F.col("t"))
    g = g.withColumn("_h", key * 1103 + r * 131 + c * 31)
    n0, n1, n2, n3 = (F.expr("_h % 17"), F.expr("(_h div 17) % 13"), F.expr("(_h div 221) % 11"),
                      F.expr("(_h div 2431) % 45"))
    w1 = F.when(inner, n1).when(r == 0, 100 - n0 - n2 - n3).otherwise(n1)
    w2 = F.when(inner, n2).when(r == 0, n2).otherwise(100 - n0 - n1 - n3)
    w3 = F.when(inner, 100 - n0 - n1 - n2).otherwise(n3)
    typ = F.when(unfilled | ((key + r * 2 + c) % 31 == 0), F.lit(None)).otherwise(
        F.array(*[w.cast("double") / F.lit(100.0) for w in (n0, w1, w2, w3)]))
    return in_parts(g.select(
        "doc_id", "page_id", "table_id", "table_ord", r.cast("int").alias("r"), c.cast("int").alias("c"),
        (r * N_COLS + c).cast("int").alias("src_ord"), cell_id.alias("cell_id"),
        text.alias("text"), typ.alias("type"),
    ).select(*SLOT_COLS))


def _div(x: Column, d: int) -> Column:
    """Integer division of a non-negative bigint (exact below 2**53)."""
    return ((x - x % d) / d).cast("long")


def literal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for the post-scaling rules (C7-C12) and the page helpers (C15-C18),
    built from ``orders``: dates, birth dates, yen/sen amounts, note markers,
    bracketed numbers, stock units, headings, table ids."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                   "o_totalprice")
    k = F.col("o_orderkey")
    d = _ymd("o_orderdate")
    price = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    digits = (k % 1000).cast("string")
    m = k % 8
    text = (
        F.when(m == 0, F.concat(F.lit("設立"), d, F.lit("、登記"), d))
        .when(m == 1, F.concat(F.lit("代表取締役 "), d, F.lit("生")))
        .when(m == 2, F.concat(d, F.lit("から"), d, F.lit("生")))
        .when(m == 3, F.concat(F.lit("※"), (k % 10).cast("string"), digits, F.lit("注記")))
        .when(m == 4, F.concat(price, F.lit("〔"), digits, F.lit("〕")))
        .when(m == 5, F.concat(F.lit("株式の状況(1単元の株式数"), digits, F.lit("株)")))
        .when(m == 6, F.concat(F.lit("1株当たり"), digits, F.lit("円"), (k % 100).cast("string"), F.lit("銭")))
        .otherwise(F.concat(F.lit("("), (k % 9).cast("string"), F.lit(") 【沿革】"), d, F.lit(" 概要　")))
    )
    return o.select(
        doc_id_of(F.col("o_custkey")).alias("doc_id"),
        F.concat(doc_id_of(F.col("o_custkey")), F.lit("-0000000-tab"), k.cast("string")).alias("table_id"),
        k.alias("table_ord"), text.alias("text"))


# ------------------------------------------------------------ report pages --
PAGE_HEAD = ('<html><head><title>報告書</title><script>var t="</p>";</script>'
             '<style>p{margin:0}</style></head><body>')


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML pages of every document, each rendering its fixture tables in order.

    Spans: for ``k = 2`` the header cell (0,3) spans two columns (the (0,4)
    cell is not written); for ``k = 1`` the cell (1,0) spans two rows (the
    (2,0) cell is not written). An unfilled last cell of a row is not written
    (the row is short); other unfilled cells are written empty. Before each
    table: a heading paragraph and a dated paragraph (``orderkey % 6`` not 0
    or 1), a page marker (1) or nothing (0).

    A row's cells are written where the row is made, and rows move once, to
    their page's task; orders with one key are as many tables, with one header row.
    """
    r, k = F.col("r"), F.col("k")

    def html(x: Column) -> Column:
        c = x["c"]
        _, text, cell_id = _cell(c, x["t"])
        covered = ((k == 2) & (r == 0) & (c == 4)) | ((k == 1) & (r == 2) & (c == 0))
        skipped = covered | (text.isNull() & (c == 4))
        tag = F.when(r == 0, F.lit("th")).otherwise(F.lit("td"))
        attrs = F.concat(
            F.when(cell_id.isNotNull(), F.concat(F.lit(' cell-id="'), cell_id, F.lit('"'))).otherwise(F.lit("")),
            F.when((k == 2) & (r == 0) & (c == 3), F.lit(' colspan="2"')).otherwise(F.lit("")),
            F.when((k == 1) & (r == 1) & (c == 0), F.lit(' rowspan="2"')).otherwise(F.lit("")))
        filled = F.coalesce(text, F.lit(""))
        inner = F.when((r % 2 == 0) & (c == 2), F.concat(F.lit("<span> "), filled, F.lit(" </span>"))).otherwise(filled)
        return F.struct(c.alias("c"), F.when(~skipped, F.concat(F.lit("<"), tag, attrs, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))).alias("h"))

    m = F.col("o_orderkey") % 6
    para = (F.when(m == 0, F.lit(""))
            .when(m == 1, F.concat(F.lit("<p>div#pageDIV"), F.col("o_orderkey"), F.lit("</p>")))
            .otherwise(F.concat(
                F.lit("<div><p>("), (F.col("o_orderkey") % 9).cast("string"), F.lit(") 【"),
                F.col("o_orderpriority"), F.lit("】 "), F.col("o_orderstatus"),
                F.lit("<!-- c --></p><p>作成日 "), _ymd("o_orderdate"), F.lit("<br></p></div>"))))
    paras = (read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("table_ord"))
             .agg(F.sort_array(F.collect_list(para)).alias("paras")))
    rows = _table_rows(spark, sf_dir).withColumn("cells", F.transform("s", html))
    # a header row brings its order's paragraphs, and its cells, as orders with one key share it
    head = F.struct(F.col("cells").alias("cells"), F.col("paras").alias("paras"))
    line = F.struct(r.alias("r"), F.concat(F.lit("<tr>"), F.array_join(F.col("cells")["h"], ""), F.lit("</tr>")).alias("h"))
    rows = (rows.join(paras.withColumn("r", F.lit(0)), ["table_ord", "r"], "left")
            .select("doc_id", "page_id", "table_id", "table_ord", F.when(r == 0, head).alias("head"), F.when(r > 0, line).alias("line"))
            .repartition("doc_id", "page_id"))
    tables = rows.groupBy("doc_id", "page_id", "table_id", "table_ord").agg(
        F.collect_list("head").alias("heads"), F.array_join(F.sort_array(F.collect_list("line"))["h"], "").alias("lines"))
    header = F.concat(F.lit("<tr>"), F.array_join(F.sort_array(F.flatten(F.col("heads")["cells"]))["h"], ""), F.lit("</tr>"))
    table = F.concat(F.lit('<table table-id="'), F.col("table_id"), F.lit('">'), header, F.col("lines"), F.lit("</table>"))
    tables = tables.select("doc_id", "page_id", "table_ord", F.col("heads")[0]["paras"].alias("paras"), table.alias("h"))
    tables = tables.select("doc_id", "page_id", "table_ord", F.array_join(F.transform("paras", lambda p: F.concat(p, "h")), "").alias("h"))
    return tables.groupBy("doc_id", "page_id").agg(
        F.concat(F.lit(PAGE_HEAD), F.lit("<h1>報告書 "), F.col("doc_id"),
                 F.lit("</h1><table><tr><td>nav</td></tr></table>"),
                 _ordered_join("table_ord", "h"), F.lit("</body></html>")).alias("html")
    ).select("doc_id", "page_id", "html")


def _ordered_join(pos: str, val: str) -> Column:
    """Concatenate ``val`` of a group in ``pos`` order (bounded groups only)."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, val))),
                                    lambda x: x.getField(val)), "")


# ------------------------------------------------- questions, gold, NLI --
def _conv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns attached to the report table of the order with the
    same number (conversation ``i`` talks about order ``i``)."""
    conv = read_table(spark, sf_dir, "conversations")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    doc = doc_id_of(F.col("o_custkey"))
    return conv.join(orders, conv["conv_id"] == orders["o_orderkey"]).select(
        "conv_id", "turn", "role", "text", doc.alias("doc_id"),
        F.concat(doc, F.lit("-0000000-tab"), F.col("o_orderkey").cast("string")).alias("table_id"))


def _row_cell(table_id: Column, row: Column) -> Column:
    return F.concat(table_id, F.lit("-R"), row.cast("string"), F.lit("C2"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, question, doc_id, table_id, cell_id)``: user turns ask about the
    price cell of row ``turn div 2 + 1`` of their table."""
    t = _conv_tables(spark, sf_dir).filter(F.col("role") == "user")
    return t.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"),
        F.col("text").alias("question"), "doc_id", "table_id",
        _row_cell(F.col("table_id"), _div(F.col("turn"), 2) + 1).alias("cell_id"))


def conversation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, table_id, sentence, cell_id)``: assistant turns answer about
    row ``(turn - 1) div 2 + 1``; system turns are sentences without a cell id."""
    t = _conv_tables(spark, sf_dir).filter(F.col("role") != "user")
    cell = F.when(F.col("role") == "assistant",
                  _row_cell(F.col("table_id"), _div(F.col("turn") - 1, 2) + 1))
    return t.select("doc_id", "table_id", F.col("text").alias("sentence"), cell.alias("cell_id"))


def gold_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-label stand-ins for every order's table: split (1,1), (0,1) for
    every fifth order, unlabelled (NULL) for every seventh; not included."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    doc = doc_id_of(F.col("o_custkey"))
    unl = k % 7 == 0
    return o.select(
        doc.alias("doc_id"),
        F.concat(doc, F.lit("-0000000-tab"), k.cast("string")).alias("table_id"),
        F.lit(False).alias("is_include"),
        F.when(unl, F.lit(None)).when(k % 5 == 0, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("row_split"),
        F.when(unl, F.lit(None)).otherwise(F.lit(1)).cast("int").alias("col_split"))


def nli_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(label, s1, s2)`` with three classes from ``events``."""
    e = read_table(spark, sf_dir, "events")
    label = (F.when(F.col("event_type") == "view", F.lit("entailment"))
             .when(F.col("event_type") == "click", F.lit("neutral"))
             .otherwise(F.lit("contradiction")))
    return e.select(label.alias("label"),
                    F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string")).alias("s1"),
                    F.coalesce(F.col("props"), F.lit("")).alias("s2"))


# ---------------------------------------------------------- text probes --
# Fixed probe affixes for the C1-C6 check: spaces, triangles, full-width
# digits, magnitude words, commas and trailing unit characters.
PROBE_PREFIXES = ["", "　", "▲", "１２", " ", "△"]
PROBE_SUFFIXES = ["", "百万円", "千円", " 円", ",000", "株", "個円", "　", "▴"]


def probe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture cell texts wrapped in affixes chosen by position."""
    g = report_grid(spark, sf_dir).filter(F.col("text").isNotNull())
    pre = F.element_at(F.array(*[F.lit(p) for p in PROBE_PREFIXES]),
                       ((F.col("table_ord") + F.col("r")) % len(PROBE_PREFIXES) + 1).cast("int"))
    suf = F.element_at(F.array(*[F.lit(s) for s in PROBE_SUFFIXES]),
                       ((F.col("table_ord") + F.col("c") * 3 + F.col("r")) % len(PROBE_SUFFIXES) + 1).cast("int"))
    return in_parts(g.select("doc_id", "table_id", "r", "c", F.concat(pre, F.col("text"), suf).alias("text")))
