"""Corpus preparation: quality filter, exact and near deduplication, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of documents.

Defined cases, for every stage: a null text counts as empty; texts are taken whole, however long;
columns besides doc_id, text and source are carried through whatever their names (but ``_row`` and ``_metadata``,
which the deduplicating stages need); an empty table gives an empty table. Each stage's docstring has the rest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality, simhash
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.queries import held_out, ranks_path
from tessera.runtime import materialise, read_table

#: None: a stage learns a model, hashes shingles or tokenises, which SQL can't express.
ORACLE_SQL = None
#: Key of a row within a stage.
ROW = "_row"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking model accepts; it learns from labelled rows outside the held-out fold.

    The decision depends on the text alone, so rows of equal text stay or go together, rows that repeat an
    id are judged each, and a null id is judged like any other (it has no label to learn from).
    An empty or null text has a score like any other. Without labels all rows stay.
    """
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), train_on=~held_out(5, 0), threshold=0.3)
    return quality.keep_good(docs, model)


def _with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, the same at every read; ids may be null or repeated.

    A stage's Parquet files hold their rows' places already; other tables are written with a number first.
    """
    try:
        return docs.select("*", F.concat("_metadata.file_path", F.lit("#"), F.col("_metadata.row_index").cast("string")).alias(ROW))
    except AnalysisException:
        return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the longest original, then the smallest id (null last), then the first row.

    Empty, null and white-space texts are one group. Rows are told apart by their place, so of rows that repeat
    an id, or have none, one of each text stays.
    """
    keyed = _with_rows(docs)
    dropped = exact_dedup(keyed, row_col=ROW).filter("NOT first").select(ROW)
    return keyed.join(dropped, ROW, "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within 4 bits one row stays: the smallest id (null last), then the first row.

    Texts without words have fingerprint zero and are linked like any other. Rows are told apart by their place.
    """
    keyed = _with_rows(docs)
    dropped = simhash.near_duplicates(keyed, radius=4, shingle=4, row_col=ROW).filter("NOT first").select(ROW)
    return keyed.join(dropped, ROW, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson count says, sources tempered by a square root, in shuffled order.

    A null source is a source of its own; rows that repeat an id get the same count; rows without an id share one.
    """
    return mixing.replicate(docs, temper=0.5, seed=3, own_columns_only=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens.

    An empty or null text is one piece of its end id; each replica of a document is packed by itself.
    """
    return packing.pack_documents(docs, ranks_path=ranks_path(), capacity=2048)


STAGES = [
    ("quality_filter", quality_filter),
    ("drop_exact_copies", drop_exact_copies),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
