"""What several operators share: words, public vocabularies, kept intermediate tables."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsieve.session import written as stored  # noqa: F401  a table in the shared scratch folder

#: A word is a longest run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Rows of text handed to Python at once. Texts are of any length, so few rows bound the memory.
ROWS_PER_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand few rows at once to Python workers, so that a run of long texts fits their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; the folds of the learned operators. NULL counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def id_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def map_batches(df: DataFrame, make, schema: T.StructType) -> DataFrame:
    """`make()` runs once in each task and returns a function from a batch to a list of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        work = make()
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                arrays = [
                    x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=field.type)
                    for x, field in zip(columns, arrow, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def vocabulary(name: str) -> str:
    """A path as it is, or the place of a public vocabulary file on the machine that asks."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(name: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(vocabulary(name))


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable bytes of Latin-1 stand for themselves, the others for U+0100 and on in their order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {**{b: chr(b) for b in own}, **{b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}}


class PieceModel:
    """Asks the library's model for single pieces, without the cost of a whole encoding."""

    def __init__(self, tok):
        self.model = tok.model
        self.letters = _byte_letters()

    def __call__(self, piece: str) -> list:
        return self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.letters))
