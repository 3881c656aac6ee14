"""Benchmark decontamination by one Aho-Corasick automaton.

Test items are normalised to words and cut into windows of ten; the windows of all items form one automaton.
Each text is normalised the same way, scanned once, and hits are mapped back to offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, words_of

SCHEMA = "struct<n_words:bigint,n_hit:bigint,item_ids:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
RAW_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Automata are built from so many bytes of item text at a time; a node costs some 60 bytes.
BLOCK_BYTES = 1 << 19


def windows_of(raw: bytes | None, window: int) -> list[bytes]:
    """Item windows: ``window`` consecutive words; an item of fewer words, but not none, is one window."""
    words = words_of(raw)
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def automaton_of(items: list[tuple[str, bytes]], window: int) -> ahocorasick.Automaton:
    """Patterns carry a blank on both sides, so that matches lie on word borders. Values: (words, item ids)."""
    found: dict[bytes, set[str]] = {}
    for item, raw in items:
        for w in windows_of(raw, window):
            found.setdefault(w, set()).add(item)
    auto = ahocorasick.Automaton()
    for w, ids in found.items():
        auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(ids))))
    if len(auto):
        auto.make_automaton()
    return auto


def char_offsets(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Code point offsets of byte offsets."""
    if raw.isascii():
        return at
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(lead)))[at]


def scan_text(raw: bytes | None, automata: list[ahocorasick.Automaton]) -> tuple[int, int, list[str], list[dict]]:
    """(words, hit words, items met, hit spans as code point offsets of the original, end exclusive)."""
    words = words_of(raw)
    if not words:
        return 0, 0, [], []
    norm = f" {b' '.join(words).decode('latin-1')} "
    hit: np.ndarray | None = None
    items: set[str] = set()
    for auto in automata:
        if not len(auto):
            continue
        ends: list[tuple[int, int]] = []
        for end, (n, ids) in auto.iter(norm):
            ends.append((end, n))
            items.update(ids)
        if ends:
            # the blank that closes word i is blank number i + 1 of the normalised text
            blanks = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
            past = np.searchsorted(blanks, np.array([e for e, _ in ends]))
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, past - np.array([n for _, n in ends]), 1)
            np.add.at(step, past, -1)
            now = np.cumsum(step[:-1]) > 0
            hit = now if hit is None else hit | now
    if hit is None:
        return len(words), 0, [], []
    spots = np.array([m.span() for m in RAW_WORD.finditer(raw)], np.int64)
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    starts, stops = char_offsets(raw, spots[first, 0]), char_offsets(raw, spots[last, 1])
    return len(words), int(hit.sum()), sorted(items), [{"start": int(a), "end": int(b)} for a, b in zip(starts, stops)]


def blocks_of(items: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """Item texts in blocks of bounded size, fetched a partition at a time. Rows with a null id or text are no items."""
    block, size = [], 0
    for item, text in items.toLocalIterator():
        raw = text.encode()
        if block and size + len(raw) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, raw))
        size += len(raw)
    yield block


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def hits_in(benchmark: DataFrame, text: Column, item_id: str = "item_id", item_text: str = "text", window: int = 10) -> Column:
    """A struct for each text, as ``find_benchmark`` tells. Only the text leaves the JVM.

    The items are sent to executors in blocks of ``BLOCK_BYTES``. One block, the usual case, is one automaton,
    built once per task. More blocks are scanned one after another, so memory stays bounded at any size.
    """
    spark = benchmark.sparkSession
    ship(spark)
    item = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    sent = [spark.sparkContext.broadcast(b) for b in blocks_of(item)]

    @F.arrow_udf(SCHEMA)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = automaton_of(sent[0].value, window) if len(sent) == 1 else None
        for batch in batches:
            raws = batch.cast(pa.binary()).to_pylist()
            if kept is not None:
                rows = [scan_text(raw, [kept]) for raw in raws]
            else:
                parts = []
                for s in sent:
                    auto = automaton_of(s.value, window)
                    parts.append([scan_text(raw, [auto])[2:] for raw in raws])
                rows = [merged(raw, [p[i] for p in parts]) for i, raw in enumerate(raws)]
            n, h, i, s = zip(*rows) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(i, pa.list_(pa.string())), pa.array(s, SPANS)], ["n_words", "n_hit", "item_ids", "spans"])

    return scan(text)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, row_id: Column, text: Column, item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row for each row of ``docs``: ``row_id``, ``n_words``, ``n_hit``, ``item_ids``, ``spans``.

    A document word is hit if it lies in an occurrence of an item window. ``item_ids`` are the distinct ids, as
    sorted strings, of items with an occurring window; ``spans`` are runs of hit words in the original text.
    Null and empty texts, and texts without a word, have no words and no hits. Items with a null id or text, or
    without words, match nothing; repeated items count once; repeated documents each get their row. Columns of
    ``docs`` other than the two given are not read, whatever their names.
    """
    return docs.select(row_id.alias("row_id"), hits_in(benchmark, text, item_id, item_text, window).alias("found")).select("row_id", "found.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: Column) -> DataFrame:
    """Rows of ``docs``, columns unchanged, without a word in a benchmark window."""
    return docs.select(F.struct("*").alias("row"), hits_in(benchmark, text).alias("found")).where("found.n_hit = 0").select("row.*")


def merged(raw: bytes | None, parts: list[tuple[list[str], list[dict]]]) -> tuple[int, int, list[str], list[dict]]:
    """One text's result from those of several automata."""
    words = words_of(raw)
    if not any(spans for _, spans in parts):
        return len(words), 0, [], []
    spots = np.array([m.span() for m in RAW_WORD.finditer(raw)], np.int64)
    starts, stops = char_offsets(raw, spots[:, 0]), char_offsets(raw, spots[:, 1])
    hit = np.zeros(len(words), bool)
    for _, spans in parts:
        for s in spans:
            hit |= (starts >= s["start"]) & (stops <= s["end"])
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return len(words), int(hit.sum()), sorted({i for ids, _ in parts for i in ids}), [{"start": int(starts[a]), "end": int(stops[b])} for a, b in zip(first, last)]
