"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Each stage works on all rows that the one before kept:
language ID (documents without a recognised language go), line dedup (repeated lines go,
and documents of which no line is left), n-gram Jaccard join (one document of each group
stays), benchmark decontamination (documents that hold a benchmark passage go), and byte-pair
encoding and decoding. All but the last return the columns of documents. Rows are separate
documents, also where they share an id or have none: each stage decides for rows, not for ids.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import bpe_automaton, decontamination, jaccard_join, language_id, line_dedup
from tablescope.llm.queries import tokenizer_path
from tablescope.llm.storage import dropped, keyed, ship, written

LEAST_SHARE = 0.5

#: SQL can express neither the language model nor the encoding.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises with a share of at least LEAST_SHARE."""
    ship(spark)
    model = language_id.train(docs)
    found = language_id.identify(docs, model, lang_out="__lang", score_out="__share")
    return found.where((F.col("__lang") != language_id.UNKNOWN) & (F.col("__share") >= LEAST_SHARE)).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere before; those that had lines and have none left are dropped."""
    ship(spark)
    done = line_dedup.dedup_lines(docs, lines_col="__lines", kept_col="__kept").where("`__lines` = 0 or `__kept` > 0")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each group, a null id only where all are null; documents without words stay."""
    ship(spark)
    docs = keyed(docs, "__row")
    groups = jaccard_join.similar_components(docs, "__row").select(F.col("id").alias("__row"), "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")
    stay = docs.select("doc_id", "__row").join(groups, "__row").groupBy("component_id").agg(F.min(rank).alias("first"))
    stay = written(stay.select("first.__row"), "first-rows")
    dropped(groups)
    return docs.join(stay, "__row", "left_semi").drop("__row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    ship(spark)
    docs = keyed(docs, "__row")
    index = decontamination.build_index(docs, "__row")
    hits = decontamination.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = written(hits.where(F.size("starts") > 0).select(F.col("id").alias("__row")), "contaminated")
    dropped(index)
    return docs.join(bad, "__row", "left_anti").drop("__row")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and the text they decode to."""
    ship(spark)
    done = bpe_automaton.round_trip(docs, bpe_automaton.WordTokenizer(tokenizer_path()))
    return done.select(F.col("id").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), "tokens", "decoded")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
