"""BPE encoding and decoding of whole texts (operator 5).

Map-only: a task reads its rows in Arrow batches, keeps a bounded cache of pieces and writes a digest row
per document, so nothing is shuffled and a lost task is simply run again.

Defined results: a null text counts as empty; the empty text has no ids and the digests of the empty
string; repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from polyad.llm.common import table
from polyad.llm.tokenizer import default_path, encoder, unpack


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """`(doc_id, n_tokens, ids_sha256, decoded_sha256)`, and with `with_ids` also `ids` (array<int>) and `decoded`."""
    path = path or default_path()
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(6 if with_ids else 4)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = bpe.encode_packed(text.as_py() or "")
                ids = unpack(packed)
                decoded = bpe.decode(ids)
                row = [doc, len(ids), sha256(packed).hexdigest(), sha256(decoded.encode()).hexdigest()]
                for column, value in zip(out, [*row, list(ids), decoded], strict=False):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names[: len(out)])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
