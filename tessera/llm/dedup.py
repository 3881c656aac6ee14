"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its shingles of five words, each labelled with its occurrence number. A sketch is the least two
labelled k-mers under one hash, kept in text order, so equal sketches speak for a small edit distance. Texts that
share a sketch are candidates; a banded alignment of their words decides. Exact copies are one node from the start.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, remembered, scratch, settle, ship, words_of
from tessera.llm.graph import components

#: Words of a shingle; sketches of a text; the similarity asked for. Two texts of 200 words of which a share of words
#: taken at random differs have one of 64 sketches in common with chance 0.90 (20 % of the words), 0.96 (18 %), 0.99 (15 %).
WORDS, SKETCHES, SIMILAR = 5, 64, 0.8
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_STEP = _RNG.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _RNG.integers(1, 1 << 62, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 62, SKETCHES, dtype=np.uint64)
#: Members of a sketch, outside its largest class, that face all others one by one rather than by their words.
MINORS = 12
#: Ids that are sent to the texts rather than dealt with them; pairs of one leader that one task aligns.
FEW, ALIGNED = 50_000, 500
#: The 64-bit columns that hold the parities of a text's words; bins of the finer parities that crowded texts have.
LANES, BITS = [f"s{i}" for i in range(8)], 4096
#: Bands of a crowded text's words, hashes of a band, and texts of a band that one task takes on either side.
BANDS, BAND_ROWS, BLOCK = 48, 3, 1024
_BAND = _RNG.integers(1, 1 << 62, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SHIFT = _RNG.integers(0, 1 << 62, BANDS * BAND_ROWS, dtype=np.uint64)
#: Words whose hashes a task remembers.
REMEMBERED = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


def labelled_kmers(hashes: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of ``k`` words, in text order. Fewer than ``k`` words are one shingle."""
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x += hashes[i : i + n] * _STEP[i]
    x = mix(x)
    order = np.argsort(x, kind="stable")
    s = x[order]
    same = np.concatenate(([False], s[1:] == s[:-1]))
    if not same.any():
        return x
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(same, 0, at))
    x[order] = np.where(same, mix(s + (at - first).astype(np.uint64) * _GOLD), s)  # the first occurrence is as without labels
    return x


def order_minhash(x: np.ndarray) -> np.ndarray:
    """A key for each sketch: its two least k-mers, in text order, hashed together with the sketch's number."""
    keys = np.empty(SKETCHES, np.uint64)
    step = SKETCHES if len(x) < 8192 else 1
    for i in range(0, SKETCHES, step):
        v = x[None, :] * _FACTOR[i : i + step, None] + _SHIFT[i : i + step, None]
        row = np.arange(len(v))
        a = v.argmin(1)
        if len(x) == 1:
            keys[i : i + step] = x[0]
            continue
        v[row, a] = np.iinfo(np.uint64).max
        b = v.argmin(1)
        keys[i : i + step] = mix(x[np.minimum(a, b)]) * np.uint64(3) + x[np.maximum(a, b)]
    return mix(keys + np.arange(SKETCHES, dtype=np.uint64) * _GOLD)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most + 1``.

    Only cells within ``most`` of the diagonal are kept: the band is one bit vector that moves down the diagonal.
    """
    if len(a) < len(b):
        a, b = b, a
    lo = 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi_a, hi_b = len(a), len(b)
    while hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    a, b = a[lo:hi_a], b[lo:hi_b]
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    whole, most = most, min(most, n)
    for k in sorted({min(most, n - m + 8), min(most, n - m + 64), most}):
        d = _banded(a, b, k)
        if d <= k:
            return d
    return whole + 1


def _banded(a: list, b: list, k: int) -> int:
    n, m, width = len(a), len(b), 2 * k + 1
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << width) - 1
    up, down = full ^ ((1 << k) - 1), 0  # vertical +1 from the main diagonal on
    d, lowest, top = k, n - m, 1 << 2 * k
    side = 1 << (2 * k - 1) if k else 0
    for i, w in enumerate(b):
        x = places.get(w, 0)
        x = (x >> (i - k) if i >= k else x << (k - i)) & full
        d0 = ((((x & up) + up) ^ up) | x | down) & full
        hp = (down | ~(d0 | up)) & full
        hn = d0 & up
        if i < n - k:
            if not d0 & top:
                d += 1
                if d > 2 * k - lowest:  # the rest can't take it back
                    return k + 1
        else:
            if hp & side:
                d += 1
            elif hn & side:
                d -= 1
            side >>= 1
        up = (hn | ~((d0 >> 1) | hp)) & full
        down = (d0 >> 1) & hp
    return d if d <= k else k + 1


def similarity(a: list, b: list, least: float = SIMILAR) -> float:
    """1 less the edit distance over the longer length, if that is ``least`` or more; else 0."""
    longer = max(len(a), len(b))
    if not longer:
        return 0.0
    most = int(longer * (1 - least) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    if a != b:
        common = sum((Counter(a) & Counter(b)).values())
        if longer - common > most:
            return 0.0
    d = banded_distance(a, b, most)
    return 1 - d / longer if d <= most else 0.0


def sketches(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``doc_id``, ``content`` (hash of its words; null without any), ``keys`` (a key for each sketch)."""
    ship(docs.sparkSession)
    given = docs.select(doc_id.alias("doc_id"), text.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered("word hashes", WordHash)
        for batch in batches:
            content, keys = [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(raw)
                if not words:
                    content.append(None)
                    keys.append(None)
                    continue
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                content.append(xxhash.xxh3_128_digest(b" ".join(words)))
                keys.append(order_minhash(labelled_kmers(hashes)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "content", "keys"])

    return given.mapInArrow(scan, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, content binary, keys array<bigint>")


def labelled_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of each text's words, told apart by their occurrence."""
    known = remembered("word hashes", WordHash)
    for raw in texts.cast(pa.binary()).to_pylist():
        words = words_of(raw)
        yield labelled_kmers(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), 1) if words else np.empty(0, np.uint64)


def fingerprinted(texts: DataFrame) -> DataFrame:
    """``texts`` (``id``, ``text``) with ``n``, the number of words, and the parities of the words, in lanes of 64 bits."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, parities = [], np.zeros((batch.num_rows, len(LANES)), np.int64)
            for i, x in enumerate(labelled_words(batch.column(1))):
                lengths.append(len(x))
                bits = np.bincount((x >> np.uint64(32)).astype(np.int64) % (64 * len(LANES)), minlength=64 * len(LANES)) & 1
                parities[i] = np.packbits(bits.astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int32()), *[pa.array(parities[:, i]) for i in range(len(LANES))]], ["id", "text", "n", *LANES])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(take, f"id {kind}, text string, n int, {', '.join(f'{s} bigint' for s in LANES)}")


def may_align(least: float) -> Column:
    """Whether columns ``n`` and ``LANES`` of one text and those with ``_`` before of another let the two align: each
    bit in which parities differ tells of at least one word that the two don't share."""
    longer, shorter = F.greatest("n", "_n"), F.least("n", "_n")
    most = F.floor(longer * F.lit(1 - least) + F.lit(1e-9))
    differ = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"_{s}"))) for s in LANES), longer - shorter)
    return (longer - shorter <= most) & (differ <= 2 * most)


def _sent(ids: DataFrame, n: int) -> DataFrame:
    """``ids``, to be sent to the texts where they are few, rather than dealing texts by id."""
    return F.broadcast(ids) if n <= FEW else ids


def verified(pairs: DataFrame, n: int, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Of ``n`` ``pairs`` (``a``, ``b``) those whose ``texts`` (``id``, ``text``) align to ``least`` or more, with ``similarity``.

    An ``a`` of many pairs is dealt to a task for each ``ALIGNED`` of them, so no task has all pairs of one text."""
    wanted, ids = packed(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    own = packed(texts.join(_sent(wanted, ids), "id", "left_semi"), "texts")[0]
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / ALIGNED).cast("int").alias("parts"))
    left = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    right = own.join(_sent(parts, ids).withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = left.join(right, ["a", "part"]).join(own.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    if 2 * n <= FEW:  # a few pairs are little to deal anew, but long to align in one task
        both = both.repartition(n // ALIGNED + 1)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(words_of(x.as_py()), words_of(y.as_py()), least) for x, y in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()))]
            keep = pa.array([f > 0 for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"]).filter(keep)

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(align, f"a {kind}, b {kind}, similarity double")


class _Classes:
    """Links found so far, as the stars of their components, and the pairs already aligned."""

    def __init__(self, links: DataFrame, texts: DataFrame, least: float):
        self.texts, self.least, self.tried = texts, least, None
        self.stars = components(links, "a", "b")

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``c``, the component of ``rep``."""
        return rows.join(self.stars.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*rows.columns, F.coalesce("component", "rep").alias("c"))

    def face(self, pairs: DataFrame) -> None:
        """Align pairs (``a``, ``b``) not aligned before, but for those that fingerprints rule out, and link those that pass."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        prints = self.texts.select("id", "n", *LANES)
        pairs = pairs.join(prints.withColumnRenamed("id", "a"), "a").join(prints.select(F.col("id").alias("b"), *[F.col(k).alias(f"_{k}") for k in ("n", *LANES)]), "b")
        pairs = pairs.where(may_align(self.least)).select("a", "b")
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs, n = packed(pairs, "pairs")
        if not n:
            return
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        new, n = packed(verified(pairs, n, self.texts.select("id", "text"), self.least).select("a", "b"), "links")
        if n:
            self.stars = components(self.stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new), "a", "b")


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose ``key`` more than one ``rep`` has."""
    keys = rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    return packed(rows.join(keys, "key", "left_semi"), name)[0]


def _mixed(named: DataFrame) -> tuple[DataFrame, int]:
    """Rows of keys that several classes hold: with ``main`` (the row's class is the key's largest) and ``minors`` (how
    many rows of the key are of another)."""
    held = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("most"), F.count(F.lit(1)).alias("classes"))
    held = held.where("classes > 1").select("key", F.col("most.c").alias("major"), (F.col("all") - F.col("most.n")).alias("minors"))
    return packed(named.join(held, "key").withColumn("main", F.col("c") == F.col("major")).drop("major"), "mixed")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """``doc_id``, ``class_id`` for every row of ``docs``: the least id of its class of near-duplicates.

    Two texts are linked if the alignment of their words reaches ``least``; classes are connected by links. Candidates
    share one of ``SKETCHES`` sketches. First the least id of each sketch faces the others. Where a sketch then still
    holds several classes, members outside its largest one face all others, if they are few. If they are many, as with
    a passage that dissimilar texts share, its members meet by their words (``_face_by_words``), which misses a pair of
    them that aligns with a chance of 5e-8 at most. All of it are joins that can be split; no sketch is gathered in one task, and none
    is dropped or capped. What is missed are pairs without a sketch in common: see ``SKETCHES``.

    Rows of one id are one document. Texts without words (null, empty, punctuation) are alone in their class, rows
    with a null id have a null class; repeated rows each get their row; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    with scratch() as keep:
        sketched = settle(sketches(docs, F.col(doc_id), F.col(text)), "sketches")
        known = sketched.where("doc_id is not null and content is not null")
        reps = settle(known.groupBy("content").agg(F.min("doc_id").alias("rep")), "reps")
        arrays = known.join(reps.select("content", F.col("rep").alias("doc_id")), ["content", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "keys")
        level = _shared(arrays.select("rep", F.explode("keys").alias("key")), "members")
        texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(level.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
        texts = settle(fingerprinted(texts), "texts")
        # rows of one id are one document, whatever their texts
        twice = known.groupBy("doc_id").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo < hi").select("doc_id")
        links = known.join(twice, "doc_id", "left_semi").join(reps, "content").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        classes = _Classes(links, texts, least)
        leaders = level.groupBy("key").agg(F.min("rep").alias("a"))
        classes.face(level.join(leaders, "key").where("rep <> a").select("a", F.col("rep").alias("b")))
        mixed, n = _mixed(classes.named(level))
        if n:
            few = mixed.where(F.col("minors") <= MINORS)
            x, y = few.where("not main").select("key", F.col("rep").alias("a"), F.col("c").alias("ca")), few.select("key", F.col("rep").alias("b"), F.col("c").alias("cb"), "main")
            classes.face(x.join(y, "key").where("ca <> cb and (main or a < b)").select("a", "b"))
            crowd = mixed.where(F.col("minors") > MINORS).select("rep").distinct()
            _face_by_words(classes.named(crowd), classes)
        found = sketched.select("doc_id", "content").join(reps, "content", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
        found = found.join(classes.stars.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
        return keep(settle(found, "classes"))


def word_bands(x: np.ndarray) -> np.ndarray:
    """A key for each band of the labelled words ``x``: their least ones under ``BAND_ROWS`` hashes."""
    least = np.empty(len(_BAND), np.uint64)
    step = len(least) if len(x) < 4096 else 8
    for i in range(0, len(least), step):
        least[i : i + step] = (x[None, :] * _BAND[i : i + step, None] + _BAND_SHIFT[i : i + step, None]).min(1)
    keys = np.arange(BANDS, dtype=np.uint64)
    for m in least.reshape(BANDS, BAND_ROWS).T:
        keys = mix(keys * np.uint64(3) + m)
    return keys


def meetings(group: np.ndarray, x_side: np.ndarray, y_side: np.ndarray, band: int, c: np.ndarray, n: np.ndarray, bits: np.ndarray, keys: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of ``group`` on the x side those on the y side (later ones, if a row is on both) of another class that
    it may align to and has no earlier band in common with."""
    same = x_side is y_side
    x, y = group[x_side], group[y_side]
    for at, i in enumerate(x.tolist()):
        j = y[at + 1 :] if same else y
        longer, shorter = np.maximum(n[j], n[i]), np.minimum(n[j], n[i])
        spare = 2 * np.floor(longer * (1 - least) + 1e-9).astype(np.int64) - (longer - shorter)
        near = (c[j] != c[i]) & (longer - shorter <= spare)
        j, spare = j[near], spare[near]
        if len(j):
            j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64) <= spare]
            if band and len(j):
                j = j[~(keys[j, :band] == keys[i, :band]).any(1)]
            if len(j):
                yield i, j


def _face_by_words(crowd: DataFrame, classes: _Classes) -> None:
    """Align every two texts of ``crowd`` (``rep``, ``c``: its class) of two classes that can reach the similarity asked for.

    A pair that aligns to 0.8 has two thirds of its labelled words in common, so it shares one of ``BANDS`` bands of
    ``BAND_ROWS`` least words but for a chance of 5e-8. Texts of a band that several classes hold are compared by
    their lengths and the parities of their words in ``BITS`` bins, which rule out no pair that aligns. A pair comes
    out once, at the first band that it shares, and only if it may align: what is written follows the pairs to be
    aligned, not the square of a band. A band of more than ``BLOCK`` texts is dealt to a task for every two blocks of it.
    """
    crowd, n = packed(crowd, "crowd")
    if not n:
        return
    least, kind = classes.least, classes.texts.schema["id"].dataType.simpleString()
    texts = classes.texts.join(_sent(crowd.select(F.col("rep").alias("id"), F.xxhash64("c").alias("c")), n), "id").select("id", "text", "c", "n")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, keys = [], []
            for x in labelled_words(batch.column(1)):
                bits.append(np.packbits((np.bincount((x >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8)).tobytes())
                keys.append(word_bands(x).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "c", "n", "bits", "bands"])

    marked = settle(texts.mapInArrow(mark, f"id {kind}, c bigint, n int, bits binary, bands array<bigint>"), "crowded")
    rows = marked.select("id", "c", F.posexplode("bands").alias("band", "key"))
    held = packed(rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n"), "held")[0]
    parts: dict[int, list[int]] = {}
    for r in held.where(F.col("n") > BLOCK).collect():
        parts.setdefault(-(-r["n"] // BLOCK), []).append(r["key"])
    met = packed(rows.select("id", "band", "key").join(held.select("key"), "key", "left_semi"), "met")[0]
    large = F.col("key").isin([k for ks in parts.values() for k in ks])
    dealt = met.where(~large).select("id", "band", "key", F.lit(0).alias("own"), F.lit(0).alias("other"))
    for many, ks in sorted(parts.items()):
        split = met.where(F.col("key").isin(ks)).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int"))
        dealt = dealt.unionByName(split.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))))
    dealt = dealt.join(marked, "id").withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    dealt = dealt.select("key", "i", "j", "own", "band", "id", "c", "n", "bits", "bands").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        key, i, j, own, band, c, n = (table.column(k).to_numpy() for k in ("key", "i", "j", "own", "band", "c", "n"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
        bands = pc.list_flatten(table.column("bands")).to_numpy().reshape(len(key), -1)
        edges = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        a, b = [], []
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
            x_side = own[lo:hi] == i[lo]
            y_side = x_side if i[lo] == j[lo] else ~x_side
            for p, q in meetings(np.arange(lo, hi), x_side, y_side, int(band[lo]), c, n.astype(np.int64), bits, bands, least):
                a.append(np.full(len(q), p))
                b.append(q)
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        ids = table.column("id").combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the groups that have ended; rows of the last group wait for the next batch."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key, i, j = (table.column(k).to_numpy() for k in ("key", "i", "j"))
            other = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1])) if len(key) else []
            end = int(other[-1]) + 1 if len(other) else 0
            if end:
                yield pairs_of(table.slice(0, end).combine_chunks())
            rest = table.slice(end)
        if rest is not None and len(rest):
            yield pairs_of(rest.combine_chunks())

    classes.face(dealt.mapInArrow(meet, f"a {kind}, b {kind}"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, columns unchanged whatever their names, one of each class of near-duplicates: that of the
    least id. Rows with a null id all stay; of rows that repeat the least id the one stays whose text hashes least."""
    kept = near_duplicates(docs, doc_id, text).where("doc_id = class_id").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    given = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.struct("*").alias("row"))
    known = given.join(kept, "id")
    once = known.where("n = 1").select("row.*")
    again = known.where("n > 1").groupBy("id").agg(F.min_by("row", "hash").alias("row")).select("row.*")
    return once.unionByName(again).unionByName(docs.where(F.col(doc_id).isNull()))
