"""Extended JSON: requests are parsed to Python values, results are formatted back."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from tessera.errors import bad

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class Regex:
    pattern: str
    options: str = ""


@dataclass(frozen=True)
class ObjectId:
    hex: str


@dataclass(frozen=True)
class Special:
    name: str


class Long(int):
    """A number given as a 64-bit integer."""


MIN_KEY, MAX_KEY, UNDEFINED = Special("minKey"), Special("maxKey"), Special("undefined")


def _date(v: object) -> datetime:
    if isinstance(v, str):
        d = datetime.fromisoformat(v.replace("Z", "+00:00"))
        return d if d.tzinfo else d.replace(tzinfo=timezone.utc)
    return EPOCH + timedelta(milliseconds=int(v))


# The wrappers of Extended JSON, by their key.
WRAPPERS = {
    "$numberInt": int,
    "$numberLong": Long,
    "$numberDouble": float,
    "$numberDecimal": Decimal,
    "$date": _date,
    "$oid": ObjectId,
    "$minKey": lambda _: MIN_KEY,
    "$maxKey": lambda _: MAX_KEY,
    "$undefined": lambda _: UNDEFINED,
    "$symbol": str,
}


def _object(pairs: list[tuple[str, object]]) -> object:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise bad("duplicate field name in document")
    if len(out) == 1:
        key, value = pairs[0]
        if key in WRAPPERS:
            try:
                return WRAPPERS[key](value)
            except (ValueError, TypeError, ArithmeticError) as e:
                raise bad(f"invalid {key} value") from e
        if key == "$regularExpression":
            return Regex(value["pattern"], value.get("options", ""))
    return out


def parse(text: object) -> object:
    """Values of Extended JSON text, field order kept; what isn't text is taken as parsed already."""
    if not isinstance(text, str):
        return text
    try:
        return json.loads(text, object_pairs_hook=_object)
    except json.JSONDecodeError as e:
        raise bad(f"invalid JSON: {e}") from e


def _plain(v: object, canonical: bool) -> object:
    if isinstance(v, dict):
        return {k: _plain(x, canonical) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x, canonical) for x in v]
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        if not canonical:
            return v
        return {"$numberInt": str(v)} if -(1 << 31) <= v < 1 << 31 and not isinstance(v, Long) else {"$numberLong": str(int(v))}
    if isinstance(v, float):
        text = "NaN" if v != v else "Infinity" if v == float("inf") else "-Infinity" if v == float("-inf") else None
        if text or canonical:
            return {"$numberDouble": text or repr(v)}
        return v
    if isinstance(v, Decimal):
        return {"$numberDecimal": str(v)}
    if isinstance(v, datetime):
        ms = round(((v if v.tzinfo else v.replace(tzinfo=timezone.utc)) - EPOCH) / timedelta(milliseconds=1))
        return {"$date": {"$numberLong": str(ms)}} if canonical else {"$date": (EPOCH + timedelta(milliseconds=ms)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"}
    if isinstance(v, ObjectId):
        return {"$oid": v.hex}
    if isinstance(v, Regex):
        return {"$regularExpression": {"pattern": v.pattern, "options": v.options}}
    if isinstance(v, Special):
        return {f"${v.name}": 1 if v.name != "undefined" else True}
    if hasattr(v, "asDict"):
        return _plain(v.asDict(recursive=False), canonical)
    raise bad(f"a {type(v).__name__} has no JSON form")


def format(value: object, canonical: bool = True) -> str:
    """Canonical or relaxed Extended JSON of a value, a row or a document."""
    return json.dumps(_plain(value, canonical), ensure_ascii=False, separators=(",", ":"))


def type_name(v: object) -> str:
    """The name that error texts give a value's type."""
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int" if -(1 << 31) <= v < 1 << 31 and not isinstance(v, Long) else "long"
    names = {dict: "object", list: "array", str: "string", float: "double", type(None): "null", datetime: "date", Decimal: "decimal", ObjectId: "objectId", Regex: "regex"}
    return v.name if isinstance(v, Special) else names.get(type(v), type(v).__name__)
