"""Filters against the independent evaluator: literal cases and seeded random ones."""

from __future__ import annotations

import random

import pytest
from evaluator import matches

from tessera.errors import QueryError
from tessera.functions.filters import literal_prefix, refused_part
from tessera.functions.ejson import Regex
from tessera.operators.find import find

NAN = float("nan")
DOCS = [
    {"_id": 1, "n": 5, "x": 1.5, "t": "abc", "a": [0, 10], "s": [{"k": 1, "v": "p"}, {"k": 9, "v": "q"}], "o": {"p": 1}, "b": True},
    {"_id": 2, "n": -7, "x": NAN, "t": "ab", "a": [], "s": [], "o": {"p": 2}, "b": False},
    {"_id": 3, "n": 3, "x": -0.0, "t": "", "a": [3], "s": [{"k": 3, "v": None}], "o": {"p": None}, "b": None},
    {"_id": 4, "n": None, "x": None, "t": None, "a": None, "s": None, "o": None, "b": None},
    {"_id": 5, "n": 10, "x": 100.25, "t": "Abc d", "a": [1, 2, 3, None], "s": [{"k": 1, "v": "q"}, {"k": 1, "v": "p"}], "o": {"p": 3}, "b": True},
]
SCHEMA = "_id long, n long, x double, t string, a array<long>, s array<struct<k:long,v:string>>, o struct<p:long>, b boolean"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).cache()


CASES = [
    {"a": {"$gt": 1, "$lt": 5}}, {"a": {"$elemMatch": {"$gt": 1, "$lt": 5}}}, {"a": 10}, {"a": [0, 10]}, {"a": None}, {"a": {"$ne": 3}}, {"a.0": 0}, {"a.1": {"$gte": 2}},
    {"n": {"$mod": [5, 0]}}, {"n": {"$mod": [4, -3]}}, {"x": {"$gte": NAN}}, {"x": {"$gt": 0}}, {"x": {"$lte": 0}}, {"x": 0}, {"x": NAN}, {"n": {"$in": [5, None]}}, {"n": {"$nin": [5, 3]}},
    {"t": {"$regex": "^ab"}}, {"t": {"$not": {"$regex": "c"}}}, {"t": {"$gt": 5}}, {"s.k": 1}, {"s": {"$elemMatch": {"k": 1, "v": "q"}}}, {"s.k": 1, "s.v": "q"}, {"s.0.v": "p"}, {"s": {"$size": 2}},
    {"o.p": None}, {"o.p": {"$exists": True}}, {"o": {"p": 1}}, {"b": True}, {"b": {"$ne": True}}, {"$or": [{"n": 3}, {"b": False}]}, {"$nor": [{"n": 5}, {"n": None}]},
    {"a": {"$all": [1, 2]}}, {"a": {"$all": []}}, {"n": 5.0}, {"n": 5.5}, {"n": {"$gt": 4.5}}, {"none": None}, {"none": {"$exists": False}}, {"a": {"$not": {"$gt": 2}}}, {"n": {"$gte": None}},
]


@pytest.mark.parametrize("spec", CASES, ids=str)
def test_cases(docs, spec):
    assert sorted(r["_id"] for r in find(docs, spec).collect()) == [d["_id"] for d in DOCS if matches(d, spec)]


def _random(rng: random.Random, depth: int = 0) -> dict:
    if depth < 2 and rng.random() < 0.3:
        return {rng.choice(["$and", "$or", "$nor"]): [_random(rng, depth + 1) for _ in range(rng.randint(1, 3))]}
    path = rng.choice(["n", "x", "t", "a", "s.k", "s.v", "o.p", "b", "a.0", "s.1.k"])
    value = lambda: rng.choice([None, 0, 1, 3, 5, 10, -7, 1.5, 100.25, "ab", "p", "q", "", True])
    op = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$not", "$all", "$size"])
    x = [value() for _ in range(rng.randint(1, 3))] if op in ("$in", "$nin", "$all") else rng.random() < 0.5 if op == "$exists" else rng.randint(0, 3) if op == "$size" else {"$gt": value()} if op == "$not" else value()
    return {path: {op: x}}


def test_random(docs):
    rng = random.Random(11)
    for _ in range(60):
        spec = {k: v for _ in range(rng.randint(1, 2)) for k, v in _random(rng).items()}
        assert sorted(r["_id"] for r in find(docs, spec).collect()) == [d["_id"] for d in DOCS if matches(d, spec)], spec


@pytest.mark.parametrize(("spec", "msg"), [
    ({"$where": "1"}, "unsupported query operator '$where' in v1"), ({"n": {"$foo": 1}}, "unknown operator: $foo"), ({"$foo": 1}, "unknown top level operator: $foo"),
    ({"$or": []}, "$and/$or/$nor must be a nonempty array"), ({"n": {"$in": 3}}, "$in needs an array"), ({"n": {"$mod": [0, 1]}}, "divisor cannot be 0"),
    ({"n": {"$size": -1}}, "$size may not be negative"), ({"t": {"$regex": "a(?=b)"}}, "Regular expression is invalid: (?= is not supported"), ({"n": {"$type": []}}, "$type must match at least one type"),
])
def test_refused(docs, spec, msg):
    with pytest.raises(QueryError) as e:
        find(docs, spec)
    assert e.value.msg == msg


def test_regex_parts():
    assert [refused_part(p) for p in (r"a\1", r"[+]+", r"a++", r"\++", r"(?<!x)", r"(?i)a")] == [r"\1", None, "++", None, "(?<!", None]
    assert [literal_prefix(Regex(p)) for p in ("^abc", "^ab*", "abc", "^a|b", "^ab.c")] == ["abc", "a", "", "", "ab"]


def test_pushed(spark, tmp_path):
    from tessera.plans.explain import explain_find, explain_pipeline

    spark.createDataFrame([(i, i % 7, f"v{i}") for i in range(100)], "_id long, k int, v string").write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    e = explain_find(df, '{"k": {"$gt": 3}, "v": {"$regex": "^v1"}}', projection='{"v": 1}')
    assert "GreaterThan(k,3)" in e["pushed"][0] and "StringStartsWith(v,v1)" in e["pushed"][0]
    e = explain_pipeline(df, '[{"$sort": {"k": 1}}, {"$skip": 1}, {"$skip": 2}, {"$limit": 5}, {"$project": {"k": 1}}]')
    assert e["stages"] == ["sort", "skip", "limit", "project"] and e["topk"] == 1 and "v:" not in e["read"][0]
