"""Language identification in two levels: a family by one linear machine a family, then a language within it by votes
of one-versus-one linear support vector machines between its closely related languages.

Features are hashed byte pairs and triples of the lower-cased text, as shares of all of them; every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ship
from tessera.llm.linear import linear_svm, sigmoid

# ISO 639-1 codes by family. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb fo yi".split(),
    "romance": "fr es pt it ro ca gl oc co la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu se".split(),
    "turkic": "tr az kk ky uz tk tt".split(),
    "semitic": "ar he mt am".split(),
    "indo-aryan": "hi bn ur pa gu mr ne si".split(),
    "dravidian": "ta te kn ml".split(),
    "sinitic": "zh yue".split(),
    "celtic": "ga cy gd br".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BINS = 1 << 13
#: Most rows a language, and in all, that the machines are fitted on; and most languages.
ROWS_PER_LANGUAGE, MOST_ROWS, MOST_LANGUAGES = 700, 5_000, 200
#: Shares are scaled to the size of a unit vector.
SCALE = 20.0
#: The part of a language's profile that is even over all bins; how far below the median, in nats a gram, a text is let
#: pass in any case; standard errors of a short text's mean that are let pass besides.
EVEN, NATS, ERRORS = 0.05, 2.5, 4.0
LETTER = regex.compile(r"\p{L}")
#: Letters stay; all else is a blank.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
PIECE = 1 << 21


def body_of(text: str) -> bytes:
    return b"  " + text.lower().encode().translate(LETTERS) + b" "


def grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the byte pairs and triples that start at each byte but the last two."""
    a = raw.astype(np.uint32)
    pair = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77)
    triple = pair * np.uint32(5) + a[2:] * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - 13)
    return pair >> shift, triple >> shift


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins that the whole text has, and its share of each, scaled."""
    raw = np.frombuffer(body_of(text), np.uint8)
    total = np.zeros(BINS, np.int64)
    for at in range(0, len(raw) - 2, PIECE):
        for g in grams(raw[at : at + PIECE + 2]):
            total += np.bincount(g, minlength=BINS)
    there = np.flatnonzero(total)
    return there.astype(np.uint16), (total[there] * (SCALE / (2 * (len(raw) - 2)))).astype(np.float32)


@dataclass
class Machines:
    """``weights``: bins + 1 by machines. ``families``: names in order of their machines; ``pairs``: (a, b) of the
    machines that follow, positive for a; ``members``: languages of each family. ``profiles``: bins + 1 by languages,
    each the logarithms of a language's shares; ``floors``: for each language the least mean of them that a text of it
    has, and their variance."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    profiles: np.ndarray
    floors: dict[str, tuple[int, float, float]]

    def knows(self, code: str, means: np.ndarray, size: int) -> bool:
        """Whether a text of ``size`` grams, told to be ``code``, is like what was learned of it."""
        at, least, variance = self.floors[code]
        return bool(means[at] >= least - ERRORS * np.sqrt(variance / max(size, 1)))

    def decide(self, margins: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) for each row of margins."""
        k = len(self.families)
        out = []
        odds = np.exp(2 * np.clip(margins[:, :k], -15, 15))
        sure = sigmoid(2 * margins[:, k:])
        place = {p: i for i, p in enumerate(self.pairs)}
        for i in range(len(margins)):
            f = int(np.argmax(margins[i, :k])) if k else 0
            langs = self.members[self.families[f]]
            p = odds[i, f] / odds[i].sum()
            if len(langs) == 1:
                out.append((langs[0], float(p)))
                continue
            votes, sums = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
            for a, b in combinations(langs, 2):
                q = float(sure[i, place[a, b]])
                votes[a if q >= 0.5 else b] += 1
                sums[a] += q
                sums[b] += 1 - q
            best = min(langs, key=lambda x: (-votes[x], -sums[x], x))
            out.append((best, float(p) * sums[best] / (len(langs) - 1)))
        return out


def margins_of(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Each machine's margin for each whole text; short texts go together, long ones piece by piece."""
    k = weights.shape[1]
    columns = [np.ascontiguousarray(weights[:-1, j], np.float32) for j in range(k)]
    out = np.zeros((len(texts), k))
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        raw = np.frombuffer(b"".join(b for _, b in group), np.uint8)
        lengths = np.array([len(b) for _, b in group])
        starts = np.cumsum(lengths) - lengths
        edges = np.stack([starts, starts + lengths - 2], 1).ravel()
        edges[-1] = min(edges[-1], len(raw) - 3)  # the last end is past the array
        last = edges[-1]
        g2, g3 = grams(raw)
        for j, w in enumerate(columns):
            value = w[g2] + w[g3]
            sums = np.add.reduceat(value, edges, dtype=np.float64)[::2]
            if last < starts[-1] + lengths[-1] - 2:
                sums[-1] += value[last]
            for (i, _), s in zip(group, sums):
                out[i, j] += s
        group.clear()

    total = np.zeros(len(texts))
    for i, text in enumerate(texts):
        body = body_of(text)
        total[i] = 2 * (len(body) - 2)
        for at in range(0, len(body) - 2, PIECE):
            part = body[at : at + PIECE + 2]
            group.append((i, part))
            size += len(part)
            if size >= PIECE:
                flush()
                size = 0
    flush()
    return out * (SCALE / np.maximum(total, 1))[:, None] + weights[-1]


def fit(docs: DataFrame, text: Column, language: Column, learn: Column, order: Column) -> Machines | None:
    """Machines fitted on a sample of at most ``MOST_ROWS`` rows (about ``ROWS_PER_LANGUAGE`` a language) for which
    ``learn`` holds, text is not null and language is not null. ``order`` only draws and sorts the sample. None if no row."""
    ship(docs.sparkSession)
    rows = docs.where(learn).select(text.alias("text"), language.alias("language"), F.xxhash64(order.cast("string")).alias("h")).where("text is not null and language is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("language").count().orderBy(F.desc("count"), "language").limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    share = min(ROWS_PER_LANGUAGE, MOST_ROWS // len(counts))
    limits = F.create_map(*[F.lit(x) for code, n in sorted(counts.items()) for x in (code, int(min(1.0, share / n) * (1 << 30)))])
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < limits[F.col("language")]).select("h", "language", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shares(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary())], ["h", "language", "bins", "shares"])

    sample = drawn.mapInArrow(featurise, "h bigint, language string, bins binary, shares binary").orderBy("h", "language", "bins", "shares").limit(MOST_ROWS).collect()
    if not sample:
        return None
    x = np.zeros((len(sample), BINS), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["bins"], np.uint16)] = np.frombuffer(r["shares"], np.float32)
    codes = np.array([r["language"] for r in sample])
    members: dict[str, list[str]] = {}
    for code in sorted(set(codes.tolist())):
        members.setdefault(FAMILY_OF.get(code, code), []).append(code)
    families = sorted(members)
    home = np.array([FAMILY_OF.get(c, c) for c in codes.tolist()])
    columns = [linear_svm(x, np.where(home == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(BINS + 1) for f in families]
    pairs = [p for f in families for p in combinations(members[f], 2)]
    for a, b in pairs:
        own = (codes == a) | (codes == b)
        columns.append(linear_svm(x[own], np.where(codes[own] == a, 1.0, -1.0)))
    profiles, floors = profiles_of(x, codes)
    return Machines(families, members, pairs, np.stack(columns, 1).astype(np.float32), profiles, floors)


def profiles_of(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, dict[str, tuple[int, float, float]]]:
    """``profiles`` and ``floors`` of the languages ``codes`` of the rows of ``x``, scaled shares.

    The least is that of the learning rows, each half of them seen by the profile of the other half, or ``NATS`` below
    their median if that is lower: it depends on one language's rows only, not on how many languages or families there
    are. One row alone sets no floor."""

    def profile(rows: np.ndarray) -> np.ndarray:
        return np.log((1 - EVEN) * rows.mean(0, dtype=np.float64) / SCALE + EVEN / BINS)

    columns, floors = [], {}
    for at, code in enumerate(sorted(set(codes.tolist()))):
        own = x[codes == code]
        log = profile(own)
        columns.append(np.append(log, 0.0))
        p = own.mean(0, dtype=np.float64) / SCALE
        variance = float(p @ log**2 - (p @ log) ** 2)
        least = -np.inf
        if len(own) > 1:
            means = np.concatenate([own[::2] @ profile(own[1::2]), own[1::2] @ profile(own[::2])]) / SCALE
            least = float(min(means.min(), np.median(means) - NATS))
        floors[code] = (at, least, variance)
    return np.stack(columns, 1).astype(np.float32), floors


def language_of(spark: SparkSession, machines: Machines | None, text: Column) -> Column:
    """A struct of ``language`` and ``score`` for each text, as ``identify`` tells. Only the text leaves the JVM."""
    ship(spark)
    sent = spark.sparkContext.broadcast(machines)

    @F.arrow_udf("struct<language:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for batch in batches:
            texts = batch.to_pylist()
            there = [i for i, t in enumerate(texts) if t and model is not None and LETTER.search(t)]
            language, score = ["und"] * len(texts), [0.0] * len(texts)
            if there:
                for i, (code, p) in zip(there, model.decide(margins_of([texts[i] for i in there], model.weights))):
                    language[i], score[i] = code, p
            yield pa.StructArray.from_arrays([pa.array(language, pa.string()), pa.array(score, pa.float64())], ["language", "score"])

    return predict(text)


def identify(docs: DataFrame, row_id: Column, text: Column, machines: Machines | None) -> DataFrame:
    """One row for each row of ``docs``: ``row_id``, ``language``, ``score`` (0 to 1: the family's probability times
    the mean probability of the language against its relatives).

    Null texts, and texts without a letter, are ``und`` with score 0, as are all if nothing could be learned. Ties go
    to the language first in the alphabet. Texts of any length are read whole, in pieces; repeated rows each get
    their row; empty tables give no rows; other columns aren't read.
    """
    found = docs.select(row_id.alias("row_id"), language_of(docs.sparkSession, machines, text).alias("found"))
    return found.select("row_id", "found.language", "found.score")


def known(spark: SparkSession, machines: Machines | None, text: Column) -> Column:
    """Whether each text is in a language that was learned: not ``und``, and as like the language told as its learning
    rows are. A language close to a learned one may pass for it."""
    ship(spark)
    sent = spark.sparkContext.broadcast(machines)

    @F.arrow_udf("boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for batch in batches:
            texts = batch.to_pylist()
            there = [i for i, t in enumerate(texts) if t and model is not None and LETTER.search(t)]
            kept = [False] * len(texts)
            if there:
                k = model.weights.shape[1]
                found = margins_of([texts[i] for i in there], np.hstack([model.weights, model.profiles]))
                for i, (code, _), means in zip(there, model.decide(found[:, :k]), found[:, k:] / SCALE):
                    kept[i] = model.knows(code, means, 2 * (len(body_of(texts[i])) - 2))
            yield pa.array(kept, pa.bool_())

    return predict(text)


def keep_known(docs: DataFrame, text: Column, machines: Machines | None) -> DataFrame:
    """Rows of ``docs``, columns unchanged, whose text is in a language that ``machines`` know, as ``known`` tells."""
    return docs.select(F.struct("*").alias("row"), known(docs.sparkSession, machines, text).alias("known")).where("known").select("row.*")
