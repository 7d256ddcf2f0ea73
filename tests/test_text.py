import duckdb
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridwork.functions import text as T
from gridwork.functions.decimal_text import times_text
from gridwork.plans import oracle_sql
from definitions import product

PROBES = [
    "", " 1,234 ", "▲5", "△1,000百万円", "0百万円", "1.5百万円", "百万円", "3千円", "12円", "100株",
    "5個円", "１２３", "ＡＢＣ（株）", "　x　", "a\x1cb", "売上高", "①", "株式の状況(1単元の株式数100株)",
    "設立1998年1月2日、登記1998年1月2日", "1990年12月3日生", "2000年1月1日から2001年2月3日生",
    "1株当たり12円5銭", "3円123銭", "3円005銭", "※212.5", "※2", "※1abc", "〔9〕100〔10〕", "(1) 【沿革】 概要　",
    "（２）会社", "S100ILF5-0000000-tab12", "x-tab", "abc$", "über", "a+b",
]


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.orderBy("i").select(fn(F.col("t")).alias("o")).collect()]


#: What normalisation makes of each probe, and what the rules after scaling make of it; None: as it was.
NORMALIZED = {
    " 1,234 ": "1234", "▲5": "-5", "△1,000百万円": "-1000000000", "0百万円": "0", "1.5百万円": "1.5000000", "百万円": "000000",
    "3千円": "3000", "12円": "12", "100株": "100", "5個円": "5", "１２３": "123", "ＡＢＣ（株）": "ABC(株)", "　x　": "x",
    "a\x1cb": "ab", "①": "1", "代表(1) 【沿革】 概要　": "代表(1)【沿革】概要", "(1) 【沿革】 概要　": "(1)【沿革】概要",
    "（２）会社": "(2)会社",
}
RULED = {
    "株式の状況(1単元の株式数100株)": "100", "設立1998年1月2日、登記1998年1月2日": "設立1998-01-02、登記1998-01-02",
    "1990年12月3日生": "1990-12-03生", "2000年1月1日から2001年2月3日生": "2000-01-01から2001-02-03",
    "1株当たり12円5銭": "12.05", "3円123銭": "3.123", "3円005銭": "3.05", "※212.5": "12", "〔9〕100〔10〕": "100",
}


def test_normalize_text(spark):
    assert run(spark, T.normalize_text, PROBES) == [NORMALIZED.get(p, p) for p in PROBES]


def test_post_rules(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PROBES)], "i int, text string")
    got = [r.text for r in T.with_steps(df, "text", T.POST_SCALE_STEPS).orderBy("i").collect()]
    assert got == [RULED.get(p, p) for p in PROBES]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="0123456789 ,.▲百万千円株個銭年月日生※〔〕-ab　１", max_size=12),
                min_size=1, max_size=20))
def test_rules_random(spark, values):
    """The rules as SQL, run by another engine."""
    def by_sql(rule):
        rows = duckdb.execute(f"SELECT {rule('t')} FROM (SELECT unnest(?) AS t, unnest(range(?)) AS i) ORDER BY i",
                              [values, len(values)]).fetchall()
        return [r[0] for r in rows]

    assert run(spark, T.normalize_text, values) == by_sql(oracle_sql.norm_text)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    got = [r.text for r in T.with_steps(df, "text", T.POST_SCALE_STEPS).orderBy("i").collect()]
    assert got == by_sql(oracle_sql.post_rules)


def test_helpers(spark):
    df = spark.createDataFrame([(p,) for p in PROBES], "t string")
    rows = df.select("t", T.has_date("t").alias("d"), T.clean_heading("t").alias("h"),
                     T.tab_number("t").alias("n"), T.doc_prefix("t").alias("p"),
                     T.needs_translation("t").alias("x"), T.is_number("t").alias("f")).collect()
    import re
    import regex
    for r in rows:
        t = r.t
        assert r.d == (re.search(r"[０-９0-9]{4}年[０-９0-9]{1,2}月[０-９0-9]{1,2}日", t) is not None)
        h = re.sub(r"^[\(（]?[０-９0-9]+[\)）]?[ 　]*", "", t)
        assert r.h == re.sub(r"[【】]", "", h).strip()
        m = re.search(r"-tab(\d+)", t)
        assert r.n == (int(m.group(1)) if m else None)
        assert r.p == t[:8]
        assert r.x == (regex.fullmatch(r"[\w\s\p{P}]*", t) is None)
        if not t.isascii() or t != t.strip():
            continue  # is_number sees NFKC-folded, space-free text
        try:
            float(t)
            ok = True
        except ValueError:
            ok = False
        assert r.f == ok, t


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(
    st.from_regex(r"-?[0-9]{1,70}(\.[0-9]{0,30})?", fullmatch=True),
    st.sampled_from(["1000000", "0.01", "1000", "1", "0.001", "100.5", "123456789012345678901234567"])), min_size=1, max_size=15))
def test_times_text(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.o for r in df.orderBy("i").select(times_text("a", "b").alias("o")).collect()]
    assert got == [product(a, b) for a, b in pairs]


def test_nfkc_only_non_ascii(spark):
    assert run(spark, T.nfkc, ["ＡＢＣ", "abc", None, "㈱①"]) == ["ABC", "abc", None, "(株)1"]
