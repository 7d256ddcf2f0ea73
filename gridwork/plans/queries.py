"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or data Spark derives from them) in
full; none is limited, sampled or filtered to a subset to stay cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.plans import report

REGISTRY: dict = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


@register("report_sentences")
def report_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship (G1-G6 on F6 probability/macro over D1-D5)."""
    return report.report_sentences(spark, sf_dir)


@register("normalized_slots")
def normalized_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C12 + D1-D5 + D7: every slot's final text."""
    return report.by_documents(spark, sf_dir, lambda grid: report.normalized(grid)[0].select("doc_id", "table_id", "r", "c", "text"))


@register("table_status")
def table_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status F/U/N of every table and whether it took a carried unit."""
    return report.by_documents(spark, sf_dir, lambda grid: report.normalized(grid)[1].select("doc_id", "table_id", "status", "carried"))


@register("best_splits")
def best_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best split of every table for all four variants."""
    return report.split_predictions(spark, sf_dir)


@register("extract_tables")
def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B5 (+C1-C6): HTML pages rendered from the fixture tables, parsed back."""
    from gridwork.operators.extract import extract_tables as ext, parse_pages
    from gridwork.sources.fixtures import report_pages
    raw = parse_pages(report_pages(spark, sf_dir), kinds=["slot"])
    return ext(raw).select("doc_id", "table_id", "table_ord", "r", "c", "cell_id", "text")


@register("context_above")
def context_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1-H4: the context sentence of every keyed table of the rendered pages."""
    from gridwork.operators.extract import context_above as ctx, parse_pages
    from gridwork.sources.fixtures import report_pages
    return ctx(parse_pages(report_pages(spark, sf_dir), kinds=["context"]))


# ------------------------------------------------------- text functions --
@register("text_normalize")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C6 on fixture texts wrapped in probe affixes."""
    from gridwork.functions.text import NORMALIZE_STEPS, with_steps
    from gridwork.sources.fixtures import probe_texts
    return with_steps(probe_texts(spark, sf_dir), "text", NORMALIZE_STEPS)


@register("text_rules")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7-C12 and C15-C19 on texts built from ``orders``."""
    from gridwork.functions import text as T
    from gridwork.sources.fixtures import literal_texts
    df = literal_texts(spark, sf_dir).withColumn("src", F.col("text"))
    df = T.with_steps(df, "text", T.POST_SCALE_STEPS)
    return df.select(
        "table_id", F.col("text").alias("rules_text"),
        T.has_date("src").alias("has_date"),
        T.clean_heading("src").alias("heading"),
        T.tab_number("table_id").cast("bigint").alias("tab_no"),
        T.doc_prefix("table_id").alias("doc_prefix"),
        T.needs_translation("src").alias("needs_translation"),
        T.is_number(F.regexp_extract("src", "[0-9.]+", 0)).alias("is_number"))


@register("nfkc_documents")
def nfkc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 on every document (no NFKC in DuckDB: row-count check only)."""
    from gridwork.functions.text import nfkc
    from gridwork.session import read_table
    d = read_table(spark, sf_dir, "documents")
    folded = nfkc(F.col("text"))
    return d.select("doc_id", F.length(folded).alias("n_chars_nfkc"),
                    (folded != F.col("text")).alias("changed"))


# --------------------------------------------------------- unit variants --
@register("append_scale")
def append_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older append-the-zeros unit rules on the fixture tables."""
    from gridwork.functions.text import NORMALIZE_STEPS, with_steps
    from gridwork.operators.units import append_units
    from gridwork.sources.rules import APPEND_RULES

    def job(grid: DataFrame) -> DataFrame:
        g = with_steps(grid, "text", NORMALIZE_STEPS[1:])
        return append_units(g, APPEND_RULES).select("doc_id", "table_id", "r", "c", "text")
    return report.by_documents(spark, sf_dir, job)


# ---------------------------------------------------- split / sentences --
@register("split_variants_legacy")
def split_variants_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """splits from 1, empty cells counted, four variants."""
    return report.split_predictions(spark, sf_dir, legacy=True)


@register("sentences_fixed")
def sentences_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 + G1-G6: sentences of unclassified tables (split fixed at (1,1))."""
    return report.report_sentences(spark, sf_dir, variant=None)


@register("sentences_keep_empty")
def sentences_keep_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 (older variant): legacy split search, sentences for empty cells too."""
    return report.report_sentences(spark, sf_dir, keep_empty=True, legacy_split=True)


# ------------------------------------------------------------ evaluation --
def _gold(spark, sf_dir):
    from gridwork.operators.evaluate import include_flag
    from gridwork.sources.fixtures import gold_splits, questions
    return include_flag(gold_splits(spark, sf_dir), questions(spark, sf_dir))


@register("include_flag")
def include_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold tables flagged when a question names them."""
    return _gold(spark, sf_dir).select("doc_id", "table_id", "is_include")


@register("split_accuracy")
def split_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2 + I3: accuracy of the four split variants against the gold splits."""
    from gridwork.operators.evaluate import split_accuracy as acc
    from gridwork.session import cut_lineage
    # the accuracy reads the predictions twice (documents present, per-table
    # match): store them once (one row per table and variant)
    return acc(_gold(spark, sf_dir), cut_lineage(report.split_predictions(spark, sf_dir)))


@register("split_matrix")
def split_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: zero-filled count matrix of the gold splits."""
    from gridwork.operators.evaluate import split_matrix as sm
    return sm(_gold(spark, sf_dir))


@register("binary_metrics")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy / precision / recall / F1 of ``toxic`` against ``quality``."""
    from gridwork.operators.evaluate import binary_metrics as bm
    from gridwork.session import read_table
    lab = read_table(spark, sf_dir, "labels")
    return bm(lab, label="quality", pred="toxic")


# ------------------------------------------------------- training pairs --
@register("qa_pairs")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J2: question x sentences of its table, labelled by cell id."""
    from gridwork.operators.pairs import question_pairs
    from gridwork.sources.fixtures import conversation_sentences, questions
    return question_pairs(questions(spark, sf_dir), conversation_sentences(spark, sf_dir))


@register("qa_pairs_one_negative")
def qa_pairs_one_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives plus one md5-chosen negative per question."""
    from gridwork.operators.pairs import one_negative_pairs
    from gridwork.sources.fixtures import conversation_sentences, questions
    return one_negative_pairs(questions(spark, sf_dir), conversation_sentences(spark, sf_dir))


def _balanced(spark, sf_dir):
    from gridwork.operators.pairs import halve_classes, map_labels
    from gridwork.sources.fixtures import nli_pairs
    return map_labels(halve_classes(nli_pairs(spark, sf_dir)))


@register("balance_classes")
def balance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + J5 + J6: halve two classes exactly, map labels, seeded order."""
    from gridwork.operators.pairs import shuffle
    return shuffle(_balanced(spark, sf_dir))


@register("train_eval_split")
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 80/20 train/eval split of the balanced pairs."""
    from gridwork.operators.pairs import train_eval_split as tes
    return tes(_balanced(spark, sf_dir))


# ------------------------------------------- scoring, similarity, text map --
@register("score_distinct_cells")
def score_distinct_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + E4: classify each distinct cell text once, join back, argmax label."""
    from gridwork.functions.vectors import argmax_label
    from gridwork.operators.scoring import rule_cell_classifier, score_distinct
    from gridwork.sources.fixtures import report_grid
    from gridwork.session import in_slices
    g = report_grid(spark, sf_dir).filter(F.col("text").isNotNull()).drop("type")

    def job(cells: DataFrame) -> DataFrame:  # all cells of a text are in one slice, so it is scored once
        s = score_distinct(cells, ["text"], rule_cell_classifier)
        return s.select("doc_id", "table_id", "r", "c", "type", argmax_label("type").alias("label"))
    return in_slices(g, "text", report.n_slices(spark, sf_dir), job)


@register("score_stored_cells")
def score_stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + E4 with a result store: the header rows' cells are scored in a first run; in a second one,
    over all cells, only the texts that are new."""
    from gridwork.functions.vectors import argmax_label
    from gridwork.operators.scoring import rule_cell_classifier, score_stored
    from gridwork.plans.io_queries import scratch
    from gridwork.session import in_slices
    from gridwork.sources.fixtures import report_grid
    path = scratch(spark, "results")
    g = report_grid(spark, sf_dir).filter(F.col("text").isNotNull()).drop("type")
    load = lambda: rule_cell_classifier
    score_stored(g.filter("r = 0"), ["text"], load, path, "rules-1")

    def job(cells: DataFrame) -> DataFrame:  # all cells of a text are in one slice, so it is new once
        s = score_stored(cells, ["text"], load, path, "rules-1")
        return s.select("doc_id", "table_id", "r", "c", "type", argmax_label("type").alias("label"))
    return in_slices(g, "text", report.n_slices(spark, sf_dir), job)


@register("split_runs")
def split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4, sparse: the matrix of the gold splits as rectangles of equal counts."""
    from gridwork.operators.evaluate import split_runs as sr
    return sr(_gold(spark, sf_dir))


@register("softmax_label")
def softmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 + E4: softmax of hashed logits and the argmax label."""
    from gridwork.functions.vectors import argmax_label, softmax
    from gridwork.sources.fixtures import report_grid
    g = report_grid(spark, sf_dir).filter(F.col("type").isNotNull())
    logits = F.transform("type", lambda v: v * 10.0)
    sm = F.col("_sm")  # a column, which both results read
    return g.withColumn("_sm", softmax(logits)).select(
        "doc_id", "table_id", "r", "c",
        F.transform(sm, lambda v: F.round(v, 6)).alias("probs"),
        argmax_label(sm).alias("label"))


@register("score_pairs")
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score each distinct (question, sentence) pair once."""
    from gridwork.operators.pairs import question_pairs
    from gridwork.operators.scoring import rule_pair_scorer, score_distinct
    from gridwork.sources.fixtures import conversation_sentences, questions
    p = question_pairs(questions(spark, sf_dir), conversation_sentences(spark, sf_dir))
    return score_distinct(p, ["question", "sentence"], rule_pair_scorer, out="probs")


@register("cosine_rank")
def cosine_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + K2: every embedding ranked against the first vector of each label."""
    from gridwork.operators.scoring import cosine_rank as cr
    from gridwork.session import read_table
    emb = read_table(spark, sf_dir, "embeddings")
    q = emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return cr(q, emb.select("vec_id", "embedding"), "label", "q", "vec_id", "embedding").select("qid", "vec_id", "score", "rank")


@register("translation_volume")
def translation_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: documents needing translation and their characters, per language."""
    from gridwork.operators.scoring import translation_volume as tv
    from gridwork.session import read_table
    return tv(read_table(spark, sf_dir, "documents"), "text", by=["lang"])


# Fixed values of the stand-in translation map (a caller-given service in use).
HEADER_WORDS = {"数量": "quantity", "金額": "amount", "割引": "discount", "出荷日": "ship date"}


def header_translator(texts):
    return texts.map(lambda t: HEADER_WORDS.get(t))


@register("map_distinct_text")
def map_distinct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: a text map applied once per distinct cell text, source text as fallback."""
    from gridwork.operators.scoring import map_distinct_text as mdt
    from gridwork.session import in_slices
    from gridwork.sources.fixtures import report_grid
    g = report_grid(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", "table_id", "r", "c", "text")

    def job(cells: DataFrame) -> DataFrame:  # all cells of a text are in one slice, so it is mapped once
        return mdt(cells, header_translator).select("doc_id", "table_id", "r", "c", "text", "translated")
    return in_slices(g, "text", report.n_slices(spark, sf_dir), job)


@register("page_text_blocks")
def page_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1/H1 tokenizer on the driver's raw web pages (unclosed tags, scripts,
    comments, no keyed tables): every text block that could give a table its
    context, with its date flag. No HTML parser in DuckDB: row-count check."""
    from gridwork.operators.extract import text_blocks
    from gridwork.session import read_table
    return text_blocks(read_table(spark, sf_dir, "pages"))
