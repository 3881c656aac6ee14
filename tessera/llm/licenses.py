"""License scans by a positional index of rare words.

Every notice template posts the words of its mandatory key phrases with their positions. Corpus-wide document
frequencies rank the licence words that a file holds; the file's highest-IDF ones are looked up, and their postings are
intersected by relative position, file position less template position. What is left counts if the template's mandatory
key phrases stand in place: no place of them is missed, whatever the frequencies.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tessera.llm.common import ship, words_of


@dataclass(frozen=True)
class Template:
    """A notice: its label, its words, the phrases that must stand in place, and whether its hits are base places."""

    label: str
    text: str
    must: tuple[str, ...]
    base: bool = False


def phrase(label: str, words: str) -> Template:
    """A template that counts only as a whole."""
    return Template(label, words, (words,), True)


# The phrases of the contract, and notices in their usual public wording.
BASE = (
    phrase("mit", "under the mit license"),
    phrase("apache-2", "apache license version 2"),
    phrase("cc-by-nc", "cc by nc"),
)
NOTICES = (
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses license 2 0")),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "either version 2 of the license")),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "either version 3 of the license")),
    Template("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license", "version 2 1")),
    Template("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license", "either version 3")),
    Template("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "either version 3")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "the following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc0", "licensed under cc0 1 0 universal", ("cc0 1 0",)),
)


class Index:
    """Positional postings of all mandatory words: word to (template, position). ``idf`` ranks the words of a file."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[str, int], n_docs: int, anchors: int = 3):
        self.templates = templates
        self.anchors = anchors
        self.words = [t.text.encode().split() for t in templates]
        self.must = [[self.place(ws, m.encode().split()) for m in t.must] for t, ws in zip(templates, self.words)]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        for k in range(len(templates)):
            at = sorted(must_places(self.must[k]))
            for i in at:
                self.postings[self.words[k][i]].append((k, i))
            self.needed.append(len({self.words[k][i] for i in at}))
        self.vocabulary = frozenset(self.postings)
        self.idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w.decode(), 0))) for w in self.vocabulary}

    @staticmethod
    def place(words: list[bytes], part: list[bytes]) -> tuple[int, list[bytes]]:
        for i in range(len(words) - len(part) + 1):
            if words[i : i + len(part)] == part:
                return i, part
        raise ValueError(f"a mandatory phrase isn't in its template: {part}")

    def rarest(self, words: list[bytes]) -> dict[int, list[tuple[bytes, int]]]:
        """For each template all of whose mandatory words the file holds, postings of the file's highest-IDF licence
        words in it, rarest first."""
        here = sorted(self.vocabulary.intersection(words), key=lambda w: (-self.idf[w], w))
        held: dict[int, set[bytes]] = defaultdict(set)
        chosen: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        for w in here:
            for k, i in self.postings[w]:
                held[k].add(w)
                if len(chosen[k]) < self.anchors:
                    chosen[k].append((w, i))
        return {k: chosen[k] for k in sorted(held) if len(held[k]) == self.needed[k]}

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word, share of the template's words in place), by template and place."""
        chosen = self.rarest(words)
        if not chosen:
            return []
        places: dict[bytes, list[int]] = {w: [] for found in chosen.values() for w, _ in found}
        for at, w in enumerate(words):
            if w in places:
                places[w].append(at)
        out = []
        for k, found in chosen.items():
            starts = set.intersection(*({at - i for at in places[w]} for w, i in found))
            ws = self.words[k]
            for start in sorted(starts):
                if all(start + i >= 0 and words[start + i : start + i + len(p)] == p for i, p in self.must[k]):
                    same = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(ws))
                    out.append((k, start, same / len(ws)))
        return out


def must_places(must: list[tuple[int, list[bytes]]]) -> set[int]:
    """The places of a template that its mandatory phrases fill."""
    return {i + n for i, part in must for n in range(len(part))}


def word_frequency(docs: DataFrame, text: Column, templates: tuple[Template, ...]) -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, over all documents, and their number. A row a task and word."""
    ship(docs.sparkSession)
    vocabulary = frozenset(w for t in templates for w in t.text.encode().split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = defaultdict(int)
        for batch in batches:
            seen[""] += batch.num_rows
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                for w in vocabulary.intersection(words_of(raw)):
                    seen[w.decode()] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(text.alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").sum("n").collect()
    found = {w: n for w, n in rows}
    return found, found.pop("", 0)


SCHEMA = "row_id {id}, n_words bigint, matches array<struct<label:string,start:bigint,end:bigint,share:double,base:boolean>>"


def scan_licenses(docs: DataFrame, row_id: Column, text: Column, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """One row for each row of ``docs``: ``row_id``, ``n_words`` and ``matches``: label, first word, end (exclusive),
    share of the template's words that stand in place, and whether the template is one of the base phrases. A template
    matches where all its mandatory phrases stand in place; its first word may lie before the text.

    Whole texts are read. Null and empty texts have no words and no matches; overlapping notices all count; repeated
    rows each get theirs; ids may be null; other columns aren't read. The templates are a bounded list, the words'
    frequencies at most one number for each of their words.
    """
    spark = docs.sparkSession
    ship(spark)
    frequency, n_docs = word_frequency(docs, text, templates)
    given = docs.select(row_id.alias("row_id"), text.alias("text"))
    parts = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, frequency, n_docs)
        for batch in batches:
            sizes, found = [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(raw)
                sizes.append(len(words))
                found.append([{"label": templates[k].label, "start": a, "end": a + len(index.words[k]), "share": s, "base": templates[k].base} for k, a, s in index.matches(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, parts)], ["row_id", "n_words", "matches"])

    return given.mapInArrow(scan, SCHEMA.format(id=given.schema["row_id"].dataType.simpleString()))
