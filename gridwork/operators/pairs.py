"""Training-pair building.

Random choices of the reference (unseeded ``random.choice``, pandas sampling)
become md5 ranks of a seed and the row: repeatable, exact in size, and
computed without gathering a group in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwork.operators.ranking import first_k_per_group, global_rank
from gridwork.schema import TABLE_KEY

# The three NLI classes and their binary labels.
ENTAILMENT, CONTRADICTION, NEUTRAL = "entailment", "contradiction", "neutral"
LABEL_MAP = {ENTAILMENT: 1, CONTRADICTION: 0, NEUTRAL: 0}


def rand_key(seed, *cols) -> Column:
    """md5 of the seed and the columns; ``concat_ws`` keeps NULLs from nulling the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("␀"))
                                                      for c in cols]))


def question_pairs(questions: DataFrame, sentences: DataFrame) -> DataFrame:
    """J1 + J2: every question with every sentence of its table; label 1 where
    the sentence's cell is the question's cell (a NULL id never matches);
    duplicate ``(label, question, sentence)`` rows dropped."""
    q = questions.select(*TABLE_KEY, "question", F.col("cell_id").alias("target"))
    s = sentences.select(*TABLE_KEY, "sentence", "cell_id")
    j = q.join(s, TABLE_KEY)
    label = F.coalesce((F.col("cell_id") == F.col("target")), F.lit(False)).cast("int")
    return j.select(label.alias("label"), "question", "sentence").dropDuplicates()


def one_negative_pairs(questions: DataFrame, sentences: DataFrame, seed: int = 0) -> DataFrame:
    """All positives of each question plus one negative of its own, then J2.

    Sentences are numbered inside their table by (cell, sentence), so those of
    one cell are one run. Each question draws, by the hash of the seed and its
    id, one of the sentences outside its own cell's run and meets it in an
    equi-join on (table, number); a question x sentence product is never
    built. Without a sentence of another cell there is no negative.
    """
    q = questions.select("qid", *TABLE_KEY, "question", F.col("cell_id").alias("target"))
    s = sentences.select(*TABLE_KEY, "sentence", "cell_id")
    pos = q.join(s.withColumnRenamed("cell_id", "target"), [*TABLE_KEY, "target"])
    pos = pos.select(F.lit(1).alias("label"), "question", "sentence")

    ranked = global_rank(s, [*TABLE_KEY, "cell_id", "sentence"], out="_rank")
    tables = ranked.groupBy(*TABLE_KEY).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = (ranked.filter("cell_id is not null").groupBy(*TABLE_KEY, F.col("cell_id").alias("target"))
            .agg(F.min("_rank").alias("_start"), F.count(F.lit(1)).alias("_own")))
    own, start = F.coalesce("_own", F.lit(0)), F.coalesce(F.col("_start") - F.col("_first"), F.lit(0))
    number = F.conv(F.substring(rand_key(seed, "qid"), 1, 8), 16, 10).cast("long")
    drawn = (q.join(tables, TABLE_KEY).join(runs, [*TABLE_KEY, "target"], "left").filter(F.col("_n") > own)
             .withColumn("_draw", number % (F.col("_n") - own)))
    drawn = drawn.withColumn("_rank", F.col("_first") + F.when(F.col("_draw") < start, F.col("_draw"))
                             .otherwise(F.col("_draw") + own))
    neg = (drawn.select(*TABLE_KEY, "_rank", "question").join(ranked, [*TABLE_KEY, "_rank"])
           .select(F.lit(0).alias("label"), "question", "sentence"))
    return pos.unionByName(neg).dropDuplicates()


def halve_classes(nli: DataFrame, seed: int = 42, halved=(CONTRADICTION, NEUTRAL), kept=(ENTAILMENT,)) -> DataFrame:
    """All rows of the ``kept`` class and exactly ``round(n/2)`` (half to
    even, as Python) rows of each halved class, chosen by md5 rank. Rows of
    other classes (and of none) are left out; see :func:`unknown_classes`."""
    keyed = nli.withColumn("_k", rand_key(seed, *nli.columns))
    part = keyed.filter(F.col("label").isin(*halved))
    sizes = part.groupBy("label").agg(F.bround(F.count(F.lit(1)) / 2.0, 0).cast("long").alias("k"))
    half = first_k_per_group(part, "label", "_k", sizes).filter("_keep").drop("_keep")
    return keyed.filter(F.col("label").isin(*kept)).unionByName(half).drop("_k")


def unknown_classes(nli: DataFrame, known=(ENTAILMENT, CONTRADICTION, NEUTRAL)) -> DataFrame:
    """``(label, n)`` of the classes that :func:`halve_classes` leaves out."""
    return (nli.filter(~F.coalesce(F.col("label").isin(*known), F.lit(False)))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def map_labels(nli: DataFrame, mapping=None) -> DataFrame:
    """Class names -> 0/1."""
    mapping = mapping or LABEL_MAP
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return nli.withColumn("label", F.element_at(m, F.col("label")).cast("int"))


def shuffle(df: DataFrame, seed: int = 42) -> DataFrame:
    """A seeded order, given as ``shuffle_pos`` (1-based, exact, distributed)."""
    keyed = df.withColumn("_k", rand_key(seed, *df.columns))
    return global_rank(keyed, ["_k"], out="shuffle_pos", ties=True).drop("_k")


def train_eval_split(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` = 'eval' for exactly ``ceil(test_size * n)`` rows (smallest
    md5 keys), 'train' for the rest."""
    keyed = df.withColumn("_k", rand_key(seed, *df.columns)).withColumn("_g", F.lit(0))
    sizes = keyed.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) * F.lit(test_size)).cast("long").alias("k"))
    marked = first_k_per_group(keyed, "_g", "_k", sizes)
    return marked.withColumn("split", F.when(F.col("_keep"), "eval").otherwise("train")).drop("_keep", "_g", "_k")
