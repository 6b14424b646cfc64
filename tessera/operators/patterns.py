"""Regular expressions for one-line JSON records of a schema, as exact as the schema's bounds.

They hold for Java's and for Python's engine, so rows can be checked by ``rlike`` and text be generated under them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from ..errors import ParameterError

#: What may stand between tokens of a record.
GAP = " ?"
_CHARACTER = r'(?:[^"\\\x00-\x1F\x7F]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})'
_NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
_INTEGER = r"-?(?:0|[1-9]\d*)"
_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?"
_FORMATS = {"date": _DATE, "time": _TIME, "date-time": f"{_DATE}T{_TIME}", "uuid": r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"}


def _blocks(low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, k): the numbers from low (above 0) to high as few runs first..last of leading digits, k free digits behind.

    The largest power of ten that divides a number and fits below high gives its block; blocks that differ in their last
    leading digit only are one run.
    """
    run = None
    while low <= high:
        k = 0
        while low % 10 ** (k + 1) == 0 and low + 10 ** (k + 1) - 1 <= high:
            k += 1
        lead = low // 10**k
        if run and run[2] == k and run[1] + 1 == lead and run[0] // 10 == lead // 10:
            run = (run[0], lead, k)
        else:
            if run:
                yield run
            run = (lead, lead, k)
        low += 10**k
    if run:
        yield run


def _digits(low: int, high: int) -> Iterator[str]:
    for first, last, k in _blocks(low, high):
        head = str(first // 10) if first >= 10 else ""
        end = str(first % 10) if first == last else f"[{first % 10}-{last % 10}]"
        yield head + end + ("" if not k else r"\d" if k == 1 else rf"\d{{{k}}}")


def integers(low: int | None, high: int | None) -> str:
    """A pattern for the decimal numbers from low to high, both within; None is no bound.  Without a number between them, it matches nothing."""
    if low is None and high is None:
        return _INTEGER

    def positive(a: int, b: int | None) -> Iterator[str]:
        a = max(a, 1)
        if b is not None:
            yield from _digits(a, b)
            return
        whole = 10 ** len(str(a))
        yield from _digits(a, whole - 1)
        yield rf"[1-9]\d{{{len(str(whole)) - 1},}}"

    parts = []
    if low is None or low < 0:
        parts += [f"-{p}" for p in positive(1 if high is None or high >= 0 else -high, None if low is None else -low)]
    if (low is None or low <= 0) and (high is None or high >= 0):
        parts.append("0")
    if high is None or high > 0:
        parts += positive(low if low is not None and low > 0 else 1, high)
    return "(?:" + "|".join(parts) + ")" if parts else r"(?!)"


def _repeated(item: str, low: int, high: int | None) -> str:
    """low to high items with commas; nothing at all where low is 0."""
    if high is not None and high < max(low, 1):
        return "" if low == 0 else r"(?!)"
    more = f"{{{max(low - 1, 0)},{'' if high is None else high - 1}}}"
    some = f"{item}(?:{GAP},{GAP}{item}){more}"
    return f"(?:{some})?" if low == 0 else some


def _members(parts: list[tuple[str, bool]]) -> str:
    """Members in order, those that need not be there left out, with commas between what is there.

    Behind a member the rest needs a comma each; before the first one there is a choice of which is first.
    """
    rest = [""]  # from the i-th on, behind another member
    for text, needed in reversed(parts):
        rest.insert(0, (f"{GAP},{GAP}{text}" if needed else f"(?:{GAP},{GAP}{text})?") + rest[0])
    firsts = []
    for i, (text, needed) in enumerate(parts):
        firsts.append(text + rest[i + 1])
        if needed:
            return firsts[0] if len(firsts) == 1 else f"(?:{'|'.join(firsts)})"
    return f"(?:{'|'.join(firsts)})?" if firsts else ""


def _constant(value: object) -> str:
    """A constant as JSON; a string as it stands and with escapes."""
    forms = dict.fromkeys(json.dumps(value, ensure_ascii=a) for a in (False, True))
    return "|".join(map(re.escape, forms))


def _kind(rule: dict, kind: str) -> str:
    whole = lambda name: None if rule.get(name) is None else int(rule[name])
    if kind == "object":
        if "properties" in rule:
            needed = set(rule.get("required", []))
            return r"\{" + GAP + _members([(f'(?:{_constant(k)}){GAP}:{GAP}{schema_pattern_of(v)}', k in needed) for k, v in rule["properties"].items()]) + GAP + r"\}"
        value = rule.get("additionalProperties")
        pair = f'"{_CHARACTER}*"{GAP}:{GAP}{schema_pattern_of(value if isinstance(value, dict) else {})}'
        return r"\{" + GAP + _repeated(pair, whole("minProperties") or 0, whole("maxProperties")) + GAP + r"\}"
    if kind == "array":
        return r"\[" + GAP + _repeated(schema_pattern_of(rule.get("items", {})), whole("minItems") or 0, whole("maxItems")) + GAP + r"\]"
    if kind == "integer":
        low, high = rule.get("minimum"), rule.get("maximum")
        return integers(None if low is None else -int(-low // 1), None if high is None else int(high // 1))
    if kind == "string":
        if rule.get("format") is not None:
            if rule["format"] not in _FORMATS:
                raise ParameterError(f"no pattern for strings of format {rule['format']}")
            return f'"{_FORMATS[rule["format"]]}"'
        if rule.get("pattern") is not None:
            inner = rule["pattern"]
            return f'"(?:{inner.removeprefix("^").removesuffix("$")})"'
        low, high = whole("minLength") or 0, whole("maxLength")
        if high is not None and high < low:
            raise ParameterError("maxLength is below minLength")
        return f'"{_CHARACTER}{{{low},{"" if high is None else high}}}"'
    if kind not in ("number", "boolean", "null"):
        raise ParameterError(f"no pattern for type {kind}")
    return {"number": _NUMBER, "boolean": "(?:true|false)", "null": "null"}[kind]


def schema_pattern_of(rule: dict) -> str:
    """A pattern for one value; without a type, for any scalar."""
    if "enum" in rule:
        return "(?:" + "|".join(_constant(v) for v in rule["enum"]) + ")"
    kinds = rule.get("type") or ("object" if "properties" in rule else ["string", "number", "boolean", "null"])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    parts = [_kind(rule, k) for k in kinds]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def records_pattern(schema: dict, begin: str | None = None, end: str | None = None, single: bool = False) -> str:
    """Lines of records; with marks, groups of lines between them; with ``single``, only one record or group."""
    record = schema_pattern_of({"type": "object", **schema})
    if begin is not None and end is not None:
        record = f"{re.escape(begin)}(?:{record}\\n)+{re.escape(end)}"
    return record if single else f"(?:{record}\\n)+"
