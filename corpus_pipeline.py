"""A corpus from documents to token ids, stage by stage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from hushframe.llm import bpe, contentsort, minhash, mixing, toxicity
from hushframe.llm.frames import materialize
from hushframe.llm.queries import TOXIC_SCORE, toxicity_model, vocabulary

def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, and the key's name; doc_ids may repeat or be null.

    Rows of files are numbered by file and place in it, so that texts need not be
    written again. Where there is no such place, or several rows come from one,
    rows are written once with a key.
    """
    key, file, at, number = (_fresh(docs, n) for n in ("row_key", "file_of_row", "place_of_row", "number_of_file"))
    try:
        place = docs.metadataColumn("_metadata")
        placed = docs.select("*", place["file_path"].alias(file), place["row_index"].alias(at))
        unique = placed.groupBy(file, at).count().where("count > 1").isEmpty()
    except AnalysisException:  # not rows of files
        unique = False
    if not unique:
        return materialize(docs.withColumn(key, F.monotonically_increasing_id())), key
    # one row per file
    files = materialize(placed.select(file).distinct().coalesce(1).withColumn(number, F.monotonically_increasing_id()))
    numbered = placed.join(files, file).withColumn(key, F.shiftleft(F.col(number), 40) + F.col(at))
    return numbered.select(*[numbered[f"`{c}`"] for c in docs.columns], key), key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. It learns from the labels
    of the documents it is given, the held-out ones aside.

    Null and empty texts have no toxic window and stay; repeated rows are scored each and
    rows without an id like any other; an empty table stays empty. All columns are returned,
    whatever their names.
    """
    model, name = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), _fresh(docs, "score_of_row")
    return toxicity.with_score(docs, model, name).where(F.col(name) < TOXIC_SCORE).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest, then first row of each group of equal texts. Rows without a
    text are a group apart from empty texts.

    Ties go to the smallest doc_id, null last, then to the first row, so of repeated rows
    one stays. An empty table stays empty. All columns are returned, whatever their names.
    """
    rows, key = _numbered(docs)
    kept = contentsort.exact_duplicates(rows.where("text IS NOT NULL"), row_col=key).where("kept").select(key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(key).alias("key")))
    textless = rows.where("text IS NULL").agg(first.alias("first")).select(F.col("first.key").alias(key))
    return rows.join(kept.union(textless), key, "left_semi").drop(key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near duplicates.

    Texts without words are near nothing and all stay. The smallest doc_id stays, null
    last, then the first row. An empty table stays empty. All columns are returned, whatever
    their names.
    """
    rows, key = _numbered(docs)
    kept = minhash.near_duplicates(rows, row_col=key).where("kept").select(key)
    return rows.join(kept, key, "left_semi").drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix begins it: not at all, once or twice.

    Texts without words are never taken; a null source is a source; repeated rows and rows
    without an id have places of their own. An empty table stays empty. All columns are
    returned, whatever their names.
    """
    rows, key = _numbered(docs)
    times, turn = _fresh(docs, "times_taken"), _fresh(docs, "turn_of_row")
    copies = mixing.mix(rows, row_col=key).where("copies > 0").select(key, F.col("copies").alias(times))
    chosen = rows.join(copies, key)
    return chosen.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, times, turn)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of each row.

    A null text counts as empty: no ids. Repeated rows are encoded each, ids are passed on
    as they are, null too; an empty table gives no rows. Other columns are not read.
    """
    return bpe.digests(bpe.round_trip(docs, vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Models and tokenizers are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
