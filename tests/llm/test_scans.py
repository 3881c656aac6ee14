"""Decontamination, token counts, licences: against brute force, the library and SQL."""

from __future__ import annotations

import random
import re

import pytest
from compare import connect, same
from pyspark.sql import functions as F

from tessera.llm import decontam, licenses, queries, tokens
from tessera.llm.common import words_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


def test_words(odd):
    for r in odd.collect():
        assert [w.decode() for w in words_of(r["text"].encode() if r["text"] else None)] == words(r["text"])


def brute_hits(text, items, window=10):
    ws, hit, ids = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for n in ([window] if len(iw) >= window else [len(iw)] if iw else []):
            for j in range(len(iw) - n + 1):
                for i in range(len(ws) - n + 1):
                    if ws[i : i + n] == iw[j : j + n]:
                        hit |= set(range(i, i + n))
                        ids.add(str(item))
    return len(ws), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [1 << 19, 60])
def test_decontamination(spark, odd, none, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Two words"), (3, "!!"), (4, None), (None, "x y"), (5, "two WORDS"), (5, "two words"), (6, "é ü")]
    texts = ["zero one two three four five six seven eight nine ten", "ONE, two; three-four five six seven eight nine tenth", "say: Two   words! and two words", "caf é\nü é ü.", "nothing", None, "one two three four five six seven eight nine ten eleven twelve"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row_id"]: r for r in decontam.find_benchmark(given, bench, F.col("doc_id"), F.col("text")).collect()}
    real = [(i, t) for i, t in items if i is not None and t is not None]
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["item_ids"]) == brute_hits(t, real), t
        for s in got[i]["spans"]:
            assert words(t[s["start"] : s["end"]]) and t[s["start"]].isalnum() and t[s["end"] - 1].isalnum()
    assert decontam.drop_contaminated(given, bench, F.col("text")).count() == sum(1 for t in texts if not brute_hits(t, real)[1])
    assert decontam.find_benchmark(odd, bench.limit(0), F.col("doc_id"), F.col("text")).where("n_hit = 0").count() == odd.count()
    assert decontam.find_benchmark(none, bench, F.col("doc_id"), F.col("text")).count() == 0


def test_token_counts(spark, odd, none):
    model = queries.model_bytes()
    sp = tokens.load(model)
    rng, parts = random.Random(5), [" ", "  ", "a", "the", "▁", "\n", "é", "<s>", "<0x0A>", "😀", "ing", "thn", ".", "\x00", "中"]
    counts = tokens.Counts(sp, tokens.whole_tokens(model))
    for _ in range(5_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert tokens.count_tokens(t, counts) == len(sp.encode(t)), t
    for r, t in zip(tokens.token_limits(odd, F.col("doc_id"), F.col("text"), model, 100).collect(), [r["text"] for r in odd.collect()]):
        assert (r["n_bytes"], r["n_tokens"]) == (len((t or "").encode()), len(sp.encode(t or ""))) and r["over_limit"] == (r["n_tokens"] > 100)
    assert tokens.token_counts(none, F.col("doc_id"), F.col("text"), model).count() == 0


def test_token_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    model = queries.model_bytes()
    counts = tokens.Counts(tokens.load(model), tokens.whole_tokens(model))
    text = " ".join(f"zq{i}" for i in range(100))
    assert tokens.count_tokens(text, counts) == len(tokens.load(model).encode(text)) and len(counts) <= counts.most


def test_licenses(spark, odd, none):
    texts = ["Released under the MIT License.", "under the mit license under the MIT-license", "Apache License, Version 2.0 and CC BY-NC 4.0", "the mit license", None, "cc by", "This work is licensed under the GNU General Public License, version 3.", "cc by nc cc by nc"]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row_id"]: r for r in licenses.scan_licenses(given, F.col("doc_id"), F.col("text")).collect()}
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    for i, t in enumerate(texts):
        ws = words(t)
        want = sorted((j, label) for label, p in phrases.items() for j in range(len(ws)) if ws[j : j + len(p)] == p)
        assert sorted((m["start"], m["label"]) for m in got[i]["matches"] if m["base"]) == want and got[i]["n_words"] == len(ws)
    assert "gpl-3" in {m["label"] for m in got[6]["matches"]} and not got[4]["matches"]
    assert licenses.scan_licenses(odd, F.col("doc_id"), F.col("text")).count() == odd.count() and licenses.scan_licenses(none, F.col("doc_id"), F.col("text")).count() == 0


def brute_licenses(text):
    """(label, first word, share) of every template at every place where its mandatory phrases stand."""
    ws, out = words(text), []
    for t in licenses.BASE + licenses.NOTICES:
        own = t.text.split()
        parts = [(next(i for i in range(len(own)) if own[i : i + len(m.split())] == m.split()), m.split()) for m in t.must]
        for start in range(-len(own), len(ws)):
            if all(start + i >= 0 and ws[start + i : start + i + len(p)] == p for i, p in parts):
                out.append((t.label, start, sum(0 <= start + i < len(ws) and ws[start + i] == w for i, w in enumerate(own)) / len(own)))
    return sorted(out)


def test_licenses_by_brute_force(spark):
    """Whole, cut, mixed and stuttering notices; frequencies turn the rarest words round, and change no result."""
    rng = random.Random(8)
    notices = [t.text.split() for t in licenses.BASE + licenses.NOTICES]
    texts = []
    for _ in range(300):
        ws = []
        for _ in range(rng.randint(1, 4)):
            n = rng.choice(notices)
            a = rng.randint(0, 3)
            ws += [w for w in n[a : len(n) - rng.randint(0, 3)] if rng.random() > 0.02] * rng.choice((1, 1, 2)) + rng.choices(["the", "license", "of", "cc", "x"], k=rng.randint(0, 4))
        texts.append(" ".join(ws))
    for filler in ([], ["license version gnu mit"] * 500):
        given = spark.createDataFrame(list(enumerate(texts + filler)), "doc_id long, text string")
        got = {r["row_id"]: sorted((m["label"], m["start"], m["share"]) for m in r["matches"]) for r in licenses.scan_licenses(given, F.col("doc_id"), F.col("text")).collect()}
        assert all(got[i] == brute_licenses(t) for i, t in enumerate(texts)) and sum(map(len, got.values())) > 200


def test_license_places_over_a_table(spark, docs):
    got = queries.op8_license_scan(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    assert len(got) == len(texts)
    for r in got:
        ws = words(texts[r["doc_id"]])
        found = [(j, label) for label, p in phrases.items() for j, w in enumerate(ws) if w == p[0] and ws[j : j + len(p)] == p]
        assert (r["n_base"], r["base_labels"]) == (len(found), ",".join(sorted({x for _, x in found}))) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None)) and 0 <= r["score"] <= 1
