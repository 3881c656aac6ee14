"""Token counts with a whole-token shortcut.

The vocabulary is examined once, on the driver: which strings encode alone as one token, and that no piece holds a
word mark after another character, so that a text's tokens are those of its pre-tokens. Pre-tokens in the table
count one; only the rest is merged, by the library, and remembered for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship

MARK = "▁"
#: Merged pre-tokens remembered by a task; the memory is emptied when full.
REMEMBERED = 400_000


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def whole_tokens(model: bytes) -> set[str]:
    """Words (without their word mark) whose pre-token is proven to encode as exactly one token.

    Raises ``ValueError`` where the proof fails that pre-tokens encode apart: a piece with a mark past its leading
    marks would join two of them, and a normaliser other than identity would move their borders.
    """
    sp = load(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    if joined := [p for p in pieces if MARK in p.lstrip(MARK)]:
        raise ValueError(f"pieces join pre-tokens: {joined[:5]}")
    if sp.encode(" a  b", out_type=str) != sp.encode(f"{MARK}a{MARK}{MARK}b", out_type=str) or sp.decode(sp.encode("ﬁ   x ")) != "ﬁ   x ":
        raise ValueError("the model's normaliser changes texts")
    words = [p[1:] for p in pieces if p[:1] == MARK and MARK not in p[1:] and len(p) > 1]
    return {w for w, ids in zip(words, sp.encode(words, num_threads=1)) if len(ids) == 1}


class Counts(dict):
    """Tokens of a word that a mark precedes; words not known are merged and remembered."""

    def __init__(self, sp: sentencepiece.SentencePieceProcessor, whole: set[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.sp, self.whole, self.most = sp, whole, len(whole) + REMEMBERED

    def __missing__(self, word: str) -> int:
        n = len(self.sp.encode(word))
        if len(self) >= self.most:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[word] = n
        return n


def count_tokens(text: str, counts: Counts) -> int:
    """Tokens of a whole text. Empty text has none."""
    if not text:
        return 0
    if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
        return count_marked(text.replace(" ", MARK), counts)
    return sum(map(counts.__getitem__, text.split(" ")))


def count_marked(text: str, counts: Counts) -> int:
    """The general case: runs of marks belong to the word that follows; a last run stands alone."""
    total, marks = 0, 1  # the mark that the library puts before a text
    for word in text.split(MARK):
        if word:
            total += counts[word] if marks == 1 else len(counts.sp.encode(MARK * (marks - 1) + word))
            marks = 0
        marks += 1
    if marks > 1:
        total += len(counts.sp.encode(MARK * (marks - 2))) if marks > 2 else 1
    return total


def token_counts(docs: DataFrame, row_id: Column, text: Column, model: bytes) -> DataFrame:
    """One row for each row of ``docs``: ``row_id``, ``n_bytes``, ``n_tokens`` of the whole text, as the library gives
    them without begin, end or special tokens. Null counts as empty: no bytes, no tokens. Repeated rows each count;
    null ids stay null; other columns are not read. Texts of any length are counted word by word."""
    ship(docs.sparkSession)
    given = docs.select(row_id.alias("row_id"), text.alias("text"))
    table = docs.sparkSession.sparkContext.broadcast((model, whole_tokens(model)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto, whole = table.value
        counts = Counts(load(proto), whole)
        for batch in batches:
            texts = batch.column(1)
            sizes = pa.array([0 if n is None else n for n in pc.binary_length(texts).to_pylist()], pa.int64())
            n = pa.array([count_tokens(t, counts) if t else 0 for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n], ["row_id", "n_bytes", "n_tokens"])

    return given.mapInArrow(scan, f"row_id {given.schema['row_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def token_limits(docs: DataFrame, row_id: Column, text: Column, model: bytes, limit: int = 4096) -> DataFrame:
    """``token_counts`` with ``over_limit``: more tokens than ``limit``."""
    return token_counts(docs, row_id, text, model).withColumn("over_limit", F.col("n_tokens") > limit)
