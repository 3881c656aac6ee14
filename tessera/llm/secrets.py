"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern; each candidate's hash is counted over the whole corpus by distinct repositories and
owners. A value that many owners hold is a widely copied example; one that few hold and that looks random is live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle


@dataclass(frozen=True)
class Kind:
    """A candidate pattern. ``value``: the group that holds the secret; ``least``: its least length; ``hint``: texts
    without a match of it (or, if ``literal``, without that string) have no match; ``base``: kept whatever its owners;
    ``frame``: what of the value is no secret, and is left out where values are counted and judged."""

    name: str
    pattern: str
    value: int
    least: int
    hint: tuple[str, ...] = ()
    base: bool = False
    mixed: bool = False
    frame: str = ""


# The base patterns of the contract, and public forms of provider tokens.
KINDS = (
    Kind("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",), base=True),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, base=True),
    Kind("provider", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 10, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "-----BEGIN ")),
    Kind("entropy", r"[A-Za-z0-9+/_-]{32,}", 0, 32, mixed=True),
)
_BEGIN = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_END = r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: A private key from its first line to its last; where the last is missing, as far as lines of the key go.
KEY = Kind("key", rf"{_BEGIN}(?:[^-]*+(?:-(?!----)[^-]*+)*+{_END}|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{{16,}}+)++)", 0, 10, ("PRIVATE KEY",), frame=rf"{_BEGIN}|{_END}|\s|\\[nr]")
#: KINDS are those of the query's SQL, which knows a private key by its first line only.
ALL_KINDS = (*KINDS, KEY)
#: A value that so many distinct owners hold is an example; one with fewer is its owners'.
COPIED_BY = 3
SPAN = "struct<kind:string,rank:int,start:bigint,end:bigint,vstart:bigint,vend:bigint,hash:bigint,random:boolean>"


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """Leftmost non-overlapping matches with code point offsets: the gaps between matches come from ``split``, the
    matches from ``regexp_extract_all``; a fold over both adds their lengths up."""
    pattern = F.lit(kind.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.value)) if kind.value else hits
    zipped = F.arrays_zip(F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        value = x["value"]
        secret = F.regexp_replace(value, kind.frame, "") if kind.frame else value
        # the value is the last group: it ends where the match ends
        span = F.struct(
            F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"),
            (end - F.length(value)).alias("vstart"), end.alias("vend"), F.xxhash64(secret).alias("hash"),
            (secret.rlike("[0-9]") & secret.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(secret, ""))) >= 8)).alias("random"),
        )
        keep = F.length(value) >= kind.least
        if kind.mixed:
            keep = keep & value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
        return F.struct(end.alias("pos"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.expr(f"cast(array() as array<{SPAN}>)")
    folded = F.aggregate(zipped, F.struct(F.lit(0).cast("bigint").alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    there = F.lit(False)
    for h in kind.hint:
        there = there | text.contains(h)
    return F.when(there if kind.hint else text.rlike(kind.pattern), folded).otherwise(none)


def scan_secrets(docs: DataFrame, row_id: Column, text: Column, repository: Column, owner: Column, copied_by: int = COPIED_BY, kinds: tuple[Kind, ...] = ALL_KINDS) -> DataFrame:
    """One row for each row of ``docs``: ``row_id``, ``body`` (hash of the text) and ``spans``, by start and then kind: kind, start, end (code
    points of the whole match, end exclusive), vstart, vend (of the secret itself), n_docs, n_repos, n_owners (of its
    value over the corpus) and class: ``example`` (``copied_by`` owners or more), ``live`` (fewer, and random-looking)
    or ``plain``. Base kinds always stay; spans of other kinds stay unless their value is an example.

    Null text is empty; a null repository or owner is one of its own, unknown. Rows with null ids are told apart by
    their text; repeated rows each get their row, and count as one document of their repository. Empty tables give no
    rows; columns not named aren't read. A value that a third of all rows hold is summed before it is shuffled.
    """
    body = F.coalesce(text, F.lit(""))
    given = docs.select(
        row_id.alias("row_id"), F.xxhash64(body).alias("body"), F.coalesce(repository.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        *[_spans(body, rank, k).alias(f"k{rank}") for rank, k in enumerate(kinds)],
    )
    found = settle(given.select("row_id", "body", "repo", "owner", F.concat(*[F.col(f"k{r}") for r in range(len(kinds))]).alias("spans")), "secrets")
    spans = found.where("size(spans) > 0").select("row_id", "body", "repo", "owner", F.explode("spans").alias("s"))
    holders = spans.select(F.col("s.hash").alias("hash"), "repo", "owner", "row_id", "body").groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    owned = holders.groupBy("hash").agg(F.sum("n").alias("n_found"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    base = [k.name for k in kinds if k.base]
    judged = (
        spans.select("row_id", "body", "s", F.col("s.hash").alias("hash")).join(owned, "hash")
        .where(F.col("s.kind").isin(base) | (F.col("n_owners") < copied_by))
        .select("row_id", "body", F.struct(
            F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.vstart").alias("vstart"), F.col("s.vend").alias("vend"), "n_found", "n_repos", "n_owners",
            F.when(F.col("n_owners") >= copied_by, "example").when(F.col("s.random"), "live").otherwise("plain").alias("class"),
        ).alias("span"))
        .groupBy("row_id", "body").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    )
    with_spans = found.where("size(spans) > 0").select("row_id", "body").alias("f").join(judged.alias("j"), F.expr("f.row_id <=> j.row_id and f.body = j.body"), "left").select("f.row_id", "f.body", F.coalesce("j.spans", F.expr("filter(j.spans, x -> false)")).alias("spans"))
    kind_of = with_spans.schema["spans"].dataType.simpleString()
    none = F.expr(f"cast(array() as {kind_of})")
    return with_spans.select("row_id", "body", F.coalesce("spans", none).alias("spans")).unionByName(found.where("size(spans) = 0").select("row_id", "body", none.alias("spans")))


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with the values of ``live`` spans replaced by ``mark``; overlapping values become one mark."""
    live = F.array_sort(F.transform(F.filter(spans, lambda s: s["class"] == "live"), lambda s: F.struct(s["vstart"].alias("a"), s["vend"].alias("b"))))

    def step(acc: Column, s: Column) -> Column:
        over = s["a"] < acc["pos"]
        gap = F.when(over, F.lit("")).otherwise(F.concat(F.substring(text, (acc["pos"] + 1).cast("int"), (s["a"] - acc["pos"]).cast("int")), F.lit(mark)))
        return F.struct(F.greatest(acc["pos"], s["b"]).alias("pos"), F.concat(acc["out"], gap).alias("out"))

    return F.when(F.size(live) == 0, text).otherwise(
        F.aggregate(live, F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text))))
    )


def redact_secrets(docs: DataFrame, doc_id: str, text: str, repository: str, owner: str, length: str | None = None) -> DataFrame:
    """``docs``, rows and columns unchanged, whatever their names, but for live secrets in ``text``, which are
    redacted, and ``length``, if given, which is then that text's. Rows without a live secret stay as they are, null
    texts, null ids and repeated rows too; empty tables give no rows."""
    found = scan_secrets(docs, F.col(doc_id), F.col(text), F.col(repository), F.col(owner))
    live = found.where(F.exists("spans", lambda s: s["class"] == "live")).dropDuplicates(["row_id", "body"])
    given = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), F.struct("*").alias("row"))
    joined = given.join(live, F.expr("id <=> row_id and hash = body"), "left").select("row", "body", "spans")
    row = {c: F.col("row").getField(c) for c in docs.columns}
    new = redact(row[text], F.col("spans"))
    put = {text: new} | ({length: F.length(new).cast(docs.schema[length].dataType)} if length is not None else {})
    changed = F.col("body").isNotNull()
    return joined.select(*[(F.when(changed, put[c]).otherwise(row[c]) if c in put else row[c]).alias(c) for c in docs.columns])
