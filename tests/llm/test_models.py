"""Language ID, toxicity, top-k search, near-dedup, sampling and the pipeline."""

from __future__ import annotations

import collections
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import dedup, language, pieces, queries, topk, toxicity
from tessera.llm.common import words_of

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = queries.op1_language_id(spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and len(held) > 200
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, odd, none, docs):
    m = language.fit(docs, F.col("text"), F.col("lang"), F.lit(True), F.col("doc_id"))
    got = language.identify(odd, F.col("doc_id"), F.col("text"), m).collect()
    assert len(got) == odd.count() and [r["language"] for r in got[:4]] == ["und"] * 4 and got[4]["language"] != "und"
    assert language.identify(none, F.col("doc_id"), F.col("text"), m).count() == 0 and language.fit(none, F.col("text"), F.col("lang"), F.lit(True), F.col("doc_id")) is None
    assert {r["language"] for r in language.identify(odd, F.col("doc_id"), F.col("text"), None).collect()} == {"und"}
    assert language.keep_known(odd, F.col("text"), m).columns == odd.columns


def test_unknown_languages_are_dropped(spark, docs):
    """Foreign and junk texts go; nearly all held-out ones stay."""
    m = language.fit(docs, F.col("text"), F.col("lang"), ~queries.held_out(), F.col("doc_id"))
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 3, "Все люди рождаются свободными и равными в своём достоинстве и правах. " * 3, "xqzj kvwq zzxq jqkx vvqz qqjx wxzk " * 8]
    given = spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string")
    assert language.keep_known(given, F.col("text"), m).count() == 0
    held = docs.where(queries.held_out()).where("text is not null")
    assert language.keep_known(held, F.col("text"), m).count() >= 0.99 * held.count()


def test_language_margins_by_hand(monkeypatch):
    """Margins of grouped, piecewise texts equal those of features taken text by text."""
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(language.BINS + 1, 3)).astype(np.float32)
    texts = ["Hello there", "x", "ß" * 50, "lorem ipsum " * 40, "a b"]
    want = []
    for t in texts:
        bins, share = language.shares(t)
        want.append(weights[bins].T.astype(float) @ share + weights[-1])
    for piece in (1 << 21, 64):
        monkeypatch.setattr(language, "PIECE", piece)
        assert np.allclose(language.margins_of(texts, weights), want, atol=1e-3)


def test_toxicity(spark, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    chain = toxicity.fit(docs, labels, "doc_id", "text", {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    got = {r["row_id"]: r["p_toxic"] >= chain.least[1] for r in toxicity.score(docs, F.col("doc_id"), F.col("text"), chain).collect()}
    told = labels.collect()
    hit = sum(got[r["doc_id"]] for r in told if r["toxic"])
    wrong = sum(got[r["doc_id"]] for r in told if not r["toxic"])
    assert hit / sum(r["toxic"] for r in told) > 0.7 and wrong / sum(not r["toxic"] for r in told) < 0.02
    assert len(chain.links[1]) == 2, "the later model takes the earlier probability"
    assert toxicity.score(odd, F.col("doc_id"), F.col("text"), chain).count() == odd.count() and toxicity.score(none, F.col("doc_id"), F.col("text"), chain).count() == 0
    empty = toxicity.fit(none, labels.limit(0), "doc_id", "text", {"toxic": F.col("toxic") == 1})
    assert toxicity.score(odd, F.col("doc_id"), F.col("text"), empty).count() == odd.count()


def test_toxicity_of_unseen_rows(spark):
    """Fitted on one half of the texts, judged on the other; copies of a text are on one side. Some labelled rows hold
    no word that tells them; with the 25 toxic rows that half of sf0.01 has to learn from, 0.62 are found."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(docs.select("doc_id", (F.xxhash64("text") % 2 == 0).alias("learn")), "doc_id")
    chain = toxicity.fit(docs, labels.where("learn"), "doc_id", "text", {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    got = {r["row_id"]: r["p_toxic"] >= chain.least[1] for r in toxicity.score(docs, F.col("doc_id"), F.col("text"), chain).collect()}
    told = labels.where("not learn and toxic is not null").collect()
    bad = [got[r["doc_id"]] for r in told if r["toxic"]]
    good = [got[r["doc_id"]] for r in told if not r["toxic"]]
    assert sum(bad) / len(bad) > 0.7 and sum(good) / len(good) < 0.02


def brute_top(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        qv = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_k(spark, monkeypatch):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + rng.choice([0, 0, 0.01]) for x in rng.choice(base)]) for i in range(900)]
    rows += [(1000, None), (1100, [1.0, None, 0.0, 0.0]), (1200, [float("nan"), 0.0, 0.0, 0.0]), (None, [9.0] * 4), (1300, [float("inf")] + [0.0] * 3), (1400, [100.0] * 4), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    monkeypatch.setattr(topk, "TREE", 200)
    monkeypatch.setattr(topk, "QUERIES", 4)
    got = topk.top_k(df, F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_top(rows))
    assert topk.top_k(df.limit(0), F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 100 == 0).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 100 == 0).count() == 2


def test_top_k_of_repeated_ids(spark, monkeypatch):
    """Rows of one id ask each for themselves; only the row that asks is left out, its equals are not."""
    rng = random.Random(5)
    rows = [(rng.choice([0, 100, 100, 200, *range(1, 40)]), [float(rng.randint(-2, 2)) for _ in range(2)]) for _ in range(400)]
    rows += [(100, [2.0, 2.0])] * 12 + [(300, [0.0, 0.0]), (400, [0.0, 0.0]), (400, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit(1))
    monkeypatch.setattr(topk, "TREE", 64)
    monkeypatch.setattr(topk, "QUERIES", 5)
    want = []
    for n, (q, v) in enumerate(rows):
        if q % 100 == 0:
            scored = sorted((-sum(int(a * 1024) * int(b * 1024) for a, b in zip(v, w)), i) for m, (i, w) in enumerate(rows) if m != n)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:10])]
    got = topk.top_k(df, F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    one = spark.createDataFrame(rows[-3:-2], "vec_id long, embedding array<double>")
    assert topk.top_k(one, F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 100 == 0).count() == 0


def test_pruning():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 3)) * 1e4
    points = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 3)) * 30)
    best, done = topk.dual_search(points[:50], np.arange(50), topk.query_tree(points[:50]), points, np.arange(4000), 10)
    assert done < 0.5 * 50 * 4000, "clustered points are pruned"


def full_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        c = [i + 1]
        for j, y in enumerate(b):
            c.append(min(p[j] + (x != y), p[j + 1] + 1, c[j] + 1))
        p = c
    return p[-1]


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        b = list(a)
        for _ in range(rng.randint(0, 7)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice("abcde")]])
        k = rng.randint(0, 10)
        assert dedup.banded_distance(a, b, k) == min(full_distance(a, b), k + 1)


def test_near_duplicates(spark, odd, none):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows, family = text(60), [], {}
    for i in range(60):  # families: a text, exact copies, and copies with a few words changed
        base = text(rng.randint(60, 200))
        for j in range(rng.choice([1, 2, 4])):
            t = list(base)
            for _ in range(rng.randint(0, len(t) // 40)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            family[len(rows)] = i
            rows.append(" ".join(t) if j % 2 else ". ".join(t).upper())
    for _ in range(80):  # dissimilar texts that share a passage
        family[len(rows)] = f"p{len(rows)}"
        rows.append(" ".join(passage + text(rng.randint(70, 100))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dedup.near_duplicates(df).collect()}
    want = {}
    for i, f in family.items():
        want.setdefault(f, i)
    assert got == {i: want[f] for i, f in family.items()}
    kept = dedup.keep_one(df.withColumn("class_id", F.lit("x")))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want.values()) and kept.columns == ["doc_id", "text", "class_id"]
    found = dedup.near_duplicates(odd).collect()
    assert len(found) == odd.count() and sum(r["class_id"] is None for r in found) == 1 and dedup.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """Texts that share a passage, each with a copy whose every third word outside it is another: the only sketches that
    a text and its copy have in common are the passage's, which all texts share."""
    rng = random.Random(21)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    passage, rows = text(90), []
    for _ in range(60):
        own = text(60)
        rows += [passage + own, passage + [f"z{rng.randrange(5000)}" if i % 3 == 1 else w for i, w in enumerate(own)]]
    assert all(dedup.similarity(a, b) for a, b in zip(rows[::2], rows[1::2]))
    keys = [set(dedup.order_minhash(dedup.labelled_kmers(np.array([dedup.WordHash()[w.encode()] for w in t], np.uint64))).tolist()) for t in rows]
    met = {i for i in range(0, len(rows), 2) if keys[i] & keys[i + 1]}
    assert len(met) > 40
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dedup.near_duplicates(df).collect()}
    assert all(got[i] == got[i + 1] == i for i in met) and all(got[i] == i for i in range(0, len(rows), 2))


def rows_of_joins(spark, after):
    """The most rows that a join of the queries after that number has made, and the number of queries so far."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for e in (runs.apply(i) for i in range(after, runs.size())):
        nodes, values = store.planGraph(e.executionId()).allNodes(), store.executionMetrics(e.executionId())
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, runs.size()


def test_a_crowd_makes_few_rows(spark, monkeypatch):
    """300 texts share one line 40 times, with 0.78 of their words the same: no two of them are near, which 45,000
    pairs must be told; two rewritten ones are found. Blocks are small, so that bands are dealt to several tasks."""
    rng = random.Random(4)
    line = "one two three four five six seven eight "
    vocabulary = [f"w{i}" for i in range(2_000)]
    own = [rng.sample(vocabulary, 90) for _ in range(300)]
    own += [["new"] * 9 + own[0][9:], own[1][:80] + ["old"] * 10]
    docs = spark.createDataFrame([(i, line * 40 + " ".join(w)) for i, w in enumerate(own)], "doc_id long, text string")
    monkeypatch.setattr(dedup, "BLOCK", 64)
    before = rows_of_joins(spark, 0)[1]
    got = {r["doc_id"]: r["class_id"] for r in dedup.near_duplicates(docs).collect()}
    assert got == {i: {300: 0, 301: 1}.get(i, i) for i in range(302)}
    most, after = rows_of_joins(spark, before)
    assert after > before and 0 < most < 302 * 302, most


def test_sketches_find_pairs_near_the_threshold():
    """Of pairs of 200 words that align to 0.80 to 0.85, words changed at random places, nine in ten share a sketch."""
    rng = np.random.default_rng(12)
    met = []
    for changed in range(30, 41):
        for _ in range(30):
            a = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
            b = a.copy()
            at = rng.choice(200, changed, replace=False)
            b[at] = rng.integers(0, 1 << 60, changed, dtype=np.uint64)
            assert dedup.similarity(a.tolist(), b.tolist())
            met.append((dedup.order_minhash(dedup.labelled_kmers(a)) == dedup.order_minhash(dedup.labelled_kmers(b))).any())
    assert np.mean(met) > 0.93 and np.mean(met[-90:]) > 0.85


def test_near_duplicates_by_brute_force(spark, docs):
    """Over a table: every pair that aligns to 0.8 and whose five-word shingles agree to one half is in one class; the
    classes are connected by such alignments."""
    texts = {r["doc_id"]: words_of(r["text"].encode()) for r in docs.collect()}
    classes = {r["doc_id"]: r["class_id"] for r in dedup.near_duplicates(docs).collect()}
    shingles = {d: set(zip(*[w[i:] for i in range(5)])) or {tuple(w)} for d, w in texts.items()}
    by = collections.defaultdict(list)
    for d, s in shingles.items():
        for x in s:
            by[x].append(d)
    pairs = collections.Counter((a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    linked = [(a, b) for (a, b), n in pairs.items() if n / (len(shingles[a]) + len(shingles[b]) - n) >= 0.5 and dedup.similarity(texts[a], texts[b])]
    assert linked and all(classes[a] == classes[b] for a, b in linked)
    for d, c in classes.items():
        assert c == d or any(dedup.similarity(texts[d], texts[e]) for e, f in classes.items() if f == c and e != d)


def test_sampling(spark, odd, none):
    model = queries.model_bytes()
    rows = pieces.sample_pieces(odd, F.col("doc_id"), F.col("text"), model, k=3)
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    back = pieces.decode(rows.withColumn("text", F.lit(1)), F.struct("row_id", "sample", "log_prob"), F.col("ids"), model).collect()
    assert {(r["row_id"]["row_id"], r["text"]) for r in back} == {(i, (t or "").replace("▁", " ")) for i, t in texts}
    got = [r.asDict() for r in rows.collect()]
    assert all(r["log_inclusion"] <= 0 and r["log_prob"] <= 1e-9 for r in got)
    again = sorted(map(str, pieces.sample_pieces(odd.repartition(3), F.col("doc_id"), F.col("text"), model, k=3).collect()))
    assert again == sorted(map(str, rows.collect())), "samples don't depend on partitions"
    assert pieces.sample_pieces(none, F.col("doc_id"), F.col("text"), model).count() == 0
    ids = pieces.encode(odd, F.col("doc_id"), F.col("text"), model)
    assert sorted(r["text"] for r in pieces.decode(ids, F.col("row_id"), F.col("ids"), model).collect()) == sorted((t or "").replace("▁", " ") for t in [r["text"] for r in odd.collect()])


def test_sampling_without_replacement():
    """First, second and third samples of a short text come as often as sequential draws without replacement do."""
    v = pieces.Vocabulary(queries.model_bytes())
    lat = pieces.Lattices(v)
    sp = pieces.load(queries.model_bytes())

    def all_of(s):
        if not s:
            return [((), 0.0)]
        out = []
        for n in range(1, min(16, len(s)) + 1):
            i = sp.piece_to_id(s[:n])
            if i and sp.id_to_piece(i) == s[:n]:
                out += [((i, *t), w + v.weight[i]) for t, w in all_of(s[n:])]
        return out

    segs = all_of("▁thnter▁on")
    total = np.logaddexp.reduce([w for _, w in segs])
    p = {s: math.exp(w - total) for s, w in segs}
    n = 20_000
    index, table = pieces.sample_texts(v, lat, ["thnter on"] * n, np.array([pieces.row_key(i, 1) for i in range(n)], np.uint64), 3)
    by = collections.defaultdict(dict)
    for i, r in zip(index, table.to_pylist()):
        by[i][r["sample"]] = tuple(r["ids"])
        assert abs(r["log_prob"] - math.log(p[tuple(r["ids"])])) < 1e-6
    assert all(len(set(b.values())) == 3 for b in by.values())
    for count, want in ((collections.Counter(b[1] for b in by.values()), p.get), (collections.Counter((b[1], b[2], b[3]) for b in by.values()), lambda t: p[t[0]] * p[t[1]] / (1 - p[t[0]]) * p[t[2]] / (1 - p[t[0]] - p[t[1]]))):
        for s, c in count.most_common(5):
            e = want(s)
            assert abs(c / n - e) < 5 * math.sqrt(e * (1 - e) / n) + 1e-4
    few = pieces.sample_texts(v, lat, ["", "é"], np.array([1, 2], np.uint64), 5)[1].to_pylist()
    assert [r["sample"] for r in few].count(1) == 2 and few[0]["log_inclusion"] == 0.0


def test_sampling_memory_is_bounded():
    """A million characters of words that are all different: a worker that took all at once would need over 200 MB."""
    v = pieces.Vocabulary(queries.model_bytes())
    lat = pieces.Lattices(v)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 12))) for _ in range(600)) for _ in range(190)]
    tracemalloc.start()
    rows = 0
    for lo, group in pieces.groups(pa.array([*texts, None])):
        rows += len(pieces.sample_texts(v, lat, group, np.arange(lo, lo + len(group), dtype=np.uint64), 2)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2 * len(texts) + 1 and peak < 120e6, peak


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd, none, at):
    """Every stage takes nulls, repeated ids, no rows, and columns named like its own; all but the last keep the columns."""
    name, stage = corpus_pipeline.STAGES[at]
    for given in (odd, none):
        given = given.select("*", F.length("text").alias("n_chars"), *[F.lit(1).alias(c) for c in ("__id", "__body", "spans", "body", "row", "id", "hash", "found")])
        out = stage(spark, given, "/root/testdata/sf0.001")
        assert at == 4 or out.columns == given.columns
        n = len(out.collect())
        assert n <= given.count() * (2 if at == 4 else 1), name
        assert at != 3 or n == given.count()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = stage(spark, now, sf)
        assert now.columns == docs.columns and set(r[0] for r in now.select("doc_id").collect()) <= set(r[0] for r in before.select("doc_id").collect()), name
    classes = dedup.near_duplicates(docs).where("doc_id = class_id")
    hit = queries.op4_benchmark_decontamination(spark, sf).where("not contaminated")
    want = {r[0] for r in classes.select("doc_id").collect()} & {r[0] for r in hit.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == want and out.groupBy("doc_id").count().where("count > 2").isEmpty()
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-dedup", "benchmark decontamination", "secret scan", "SentencePiece encoding"]


@pytest.mark.parametrize("name", ["op2_toxicity", "op10_token_count"])
def test_query_covers_its_table(spark, name):
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
