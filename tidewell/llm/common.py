"""Helpers that the operators share: tables, checkpoints, word pieces."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from reliable storage.

    Uses ``spark.checkpoint.dir`` of the session, which all executors share.
    Only where it is unset (tests on one machine) is a folder made here.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a Parquet table in that folder, which takes less room
    and stays there."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidewell-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions: raise that setting with the data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, every: bool = False) -> DataFrame:
    """_id (doc_id), _digest and _text of the rows: what a row is known by.

    One doc_id may stand on several texts, so that the text's 64-bit digest is
    part of the key. ``every`` keeps the columns of ``docs`` as well.
    """
    key = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_digest")]
    return docs.select("*", *key) if every else docs.select(*key, F.col("text").cast("string").alias("_text"))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or one like it that no column has."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def tidied(run):
    """``run`` (of mapInArrow), giving freed memory back when its task ends, so
    that a reused worker does not keep the most that any task needed."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def trim() -> None:
    """Give freed memory of this process back."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


#: A blank with no white space after it. Python's white space contains all of
#: the tokenizers' white space, so a cut here is a cut between their words.
_CUT = re.compile(r" (?=\S)")
_BLANKS = re.compile(r" \s|\s$")


def pieces(text: str) -> list[str]:
    """``text`` cut before each single blank that stands before a word.

    Byte-level BPE never merges across such a cut, whatever surrounds it: white
    space before the blank ends as a token of its own kind, and the blank goes
    with the word. All pieces but the first lack their leading blank.
    """
    return _CUT.split(text) if _BLANKS.search(text) else text.split(" ")
