"""Vector bin packing of token sequences (operator 8).

Examples are placed under limits on tokens, segments and loss-bearing tokens at once. An open sequence takes,
of all pooled pieces that fit, the one whose demand has the largest dot product with the capacity that is
left (both as shares of the limits). The first `context` tokens of a document are its context and bear no loss;
all others do. Documents may be cut: whole sequences' worth leaves a long document at once, and the piece that
closes a sequence is cut to fill it. With the limits of production (2048 tokens, 8 segments, 2032 loss-bearing
tokens, 16 of context) each limit binds: a sequence of many short documents ends at its segments, one from within
a long document at its loss-bearing tokens, which leaves room for the context of another.

Map-only: each task packs its own rows from a pool of bounded size, so memory does not grow with the input
and nothing is shuffled. What can't be closed within the limits, as at the end of a task, is split into sequences
whose lengths are powers of two, which need no padding.

Defined results: a null text counts as empty and still has its end token; repeated rows are packed each for
itself; other columns of the input are ignored; an empty table gives no rows; texts may be of any length.
Sequence ids are unique and depend on how the input is split into tasks.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from polyad.llm.common import table
from polyad.llm.tokenizer import SPECIAL, default_path

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, loss_tokens bigint"


@functools.cache
def _fast_encoder(path: str):
    """The same vocabulary as ranks, for the library that encodes whole texts fastest."""
    import tiktoken
    import json

    import public_tokenizers

    from polyad.llm.tokenizer import BytePairEncoder

    bpe = BytePairEncoder(path)
    with open(path, encoding="utf-8") as file:
        added = {a["content"]: a["id"] for a in json.load(file)["added_tokens"]}
    ranks = {s: i for i, s in enumerate(bpe.bytes_of) if s and i not in added.values()}
    # a rank must follow the order of the merges, and ids do in this vocabulary: checked here, not assumed
    if bpe.merged != sorted(bpe.merged):
        return lambda text: np.frombuffer(bpe.encode_packed(text), "<u4")
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: fast.encode_to_numpy(text, allowed_special="all") if SPECIAL in text else fast.encode_to_numpy(text, disallowed_special=())


class Packer:
    """Places pieces `(doc, start, ids, doc_tokens)`; `rows` holds what has been placed and not yet taken."""

    def __init__(self, first_id: int, max_tokens: int, max_segments: int, max_loss: int, context: int, pool: int):
        self.next_id, self.limits, self.pool_size = first_id, np.array([max_tokens, max_segments, max_loss], float)[:, None], pool
        self.max_tokens, self.max_segments, self.max_loss, self.context = max_tokens, max_segments, max_loss, context
        self.items: list = []
        self.rows: list[tuple] = []

    def loss(self, start: int, length: int) -> int:
        """Loss-bearing tokens of a piece."""
        return max(0, start + length - max(start, self.context))

    def longest(self, start: int, tokens: int, loss: int) -> int:
        """Tokens that a piece from `start` may have within this room."""
        return min(tokens, loss + max(0, self.context - start))

    def add(self, doc: int, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.max_tokens <= self.longest(at, self.max_tokens, self.max_loss):
            self._emit([(doc, at, ids[at : at + self.max_tokens], total)])
            at += self.max_tokens
        while at < total:  # what is left, in pieces that a sequence can hold
            n = min(total - at, self.longest(at, self.max_tokens, self.max_loss))
            self.items.append((doc, at, ids[at : at + n].copy(), total))
            at += n
            if len(self.items) >= self.pool_size:
                self._pack(self.pool_size // 2)

    def finish(self) -> None:
        self._pack(0)

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), total, self.next_id, offset, self.loss(start, len(ids))))
            offset += len(ids)
        self.next_id += 1

    def _pack(self, leave: int) -> None:
        """Fill sequences until at most `leave` pieces are pooled. Each round takes one piece at least."""
        items = self.items
        if len(items) <= leave:
            return
        start, size = np.array([x[1] for x in items]), np.array([len(x[2]) for x in items])
        free = np.maximum(0, self.context - start)  # tokens at the piece's head that bear no loss
        alive, left = np.ones(len(items), bool), len(items)
        demand = np.stack([size, np.ones_like(size), np.maximum(0, size - free)]) / np.maximum(self.limits, 1)
        while left > leave:
            tokens, segments, loss = self.max_tokens, self.max_segments, self.max_loss
            pieces = []
            while tokens and segments and left:
                room = np.array([tokens, segments, loss]) / np.maximum(self.limits[:, 0], 1)
                fits = alive & (size <= tokens) & (size - free <= loss)
                if segments == 1 and pieces:
                    fits &= size == tokens  # the last segment has to close the sequence
                if fits.any():
                    at = int(np.argmax(np.where(fits, room @ demand, -1)))
                    part = items[at]
                    alive[at], left = False, left - 1
                else:
                    cut = np.minimum(tokens, loss + free)
                    longer = alive & (size > cut) & (cut > 0)
                    if segments == 1:
                        longer &= cut == tokens
                    if not longer.any():
                        break
                    at = int(np.argmax(np.where(longer, cut * (1 << 20) + size, -1)))
                    doc, begin, ids, total = items[at]
                    n = int(cut[at])
                    part, items[at] = (doc, begin, ids[:n], total), (doc, begin + n, ids[n:], total)
                    start[at], size[at], free[at] = begin + n, size[at] - n, max(0, free[at] - n)
                    demand[:, at] = np.array([size[at], 1, max(0, size[at] - free[at])]) / np.maximum(self.limits[:, 0], 1)
                pieces.append(part)
                tokens, segments, loss = tokens - len(part[2]), segments - 1, loss - self.loss(part[1], len(part[2]))
            if tokens == 0:
                self._emit(pieces)
            else:
                self._powers(pieces)
        self.items = [x for x, a in zip(items, alive, strict=True) if a]

    def _powers(self, pieces: list) -> None:
        """Sequences of power-of-two lengths, which need no padding."""
        total = sum(len(p[2]) for p in pieces)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            taken = []
            while room:
                doc, start, ids, all_tokens = pieces[0]
                n = min(room, len(ids))
                taken.append((doc, start, ids[:n], all_tokens))
                room -= n
                if n == len(ids):
                    pieces.pop(0)
                else:
                    pieces[0] = (doc, start + n, ids[n:], all_tokens)
            self._emit(taken)


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         max_tokens: int = 2048, max_segments: int = 8, max_loss: int = 2032, context: int = 16, pool: int = 512) -> DataFrame:
    """One row per piece, with its loss-bearing tokens: those past the first `context` tokens of its document."""
    path = path or default_path()
    if min(max_tokens, max_segments, max_loss, pool) < 1 or context < 0:
        raise ValueError("limits must be positive")

    def run(batches):
        encode = _fast_encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40, max_tokens, max_segments, max_loss, context, pool)
        end = np.array([end_id], np.uint32)

        def taken():
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.concatenate([encode(text.as_py() or ""), end]))
            yield taken()
        packer.finish()
        yield taken()

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
