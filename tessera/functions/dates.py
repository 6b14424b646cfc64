"""Date formats: inference, conversion, shifts."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataError

#: Formats that values are tried with where only a few are to be told apart.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss",
    "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "MMM dd, yyyy", "dd MMM yyyy", "yyyyMMdd", "HH:mm:ss", "HH:mm",
)
#: Shapes (digits and letters by their number) that a date or a time can have; there are finitely many.
_WORD, _MARK, _TIME = r"(?:9{1,2}|9{4}|A{3,9})", r"[/.\- ,]{1,2}", r"9{1,2}:99(?::99)?(?:\.9{1,9})?(?: ?AA)?(?:Z|[+-]99:?99)?"
POSSIBLE = rf"^(?:(?:9{{8}}|{_WORD}{_MARK}{_WORD}{_MARK}{_WORD})(?:[T ]{_TIME})?|{_TIME})$"


def shape(value: Column) -> Column:
    """The value with 9 for every digit and A for every letter."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\d", "9"), r"\p{L}", "A")


def _clock(token: str) -> list[str]:
    """Patterns of a time of day by its shape, with fraction and zone; empty for what is none."""
    m = re.fullmatch(r"(9{1,2}):(99)(:99)?(\.9{1,9})?( ?AA)?(Z|[+-]99:?99)?", token)
    if not m:
        return []
    hour, _, second, fraction, half, zone = m.groups()
    body = ("h" if half else "H") * len(hour) + ":mm" + (":ss" if second else "") + ("." + "S" * (len(fraction) - 1) if fraction else "")
    return [body + (half.replace("AA", "a") if half else "") + ("" if not zone else "XXX" if ":" in zone or zone == "Z" else "XX")]


def _day(token: str) -> list[str]:
    """Patterns of a date by its shape: every order of year, month and day that the numbers of digits allow, months before days."""
    parts = re.split(r"([/.\- ,]+)", token)
    words, marks = parts[::2], parts[1::2]
    if token == "99999999":
        return ["yyyyMMdd", "MMddyyyy", "ddMMyyyy"]
    if len(words) != 3:
        return []
    can = []
    for w in words:
        if re.fullmatch("A+", w):
            can.append(["MMM" if len(w) == 3 else "MMMM"])
        elif w == "9999":
            can.append(["yyyy"])
        elif w in ("9", "99"):
            can.append(["M" * len(w), "d" * len(w)] + (["yy"] if w == "99" else []))
        else:
            return []
    kinds = [c for c in product(*can) if sorted(x[0] for x in c) == ["M", "d", "y"]]
    order = {"yMd": 0, "Mdy": 1, "dMy": 2, "ydM": 3, "Myd": 4, "dyM": 5}
    kinds.sort(key=lambda c: order["".join(x[0] for x in c)])
    return ["".join(x for pair in zip(c, [*marks, ""]) for x in pair) for c in kinds]


def candidates(of_shape: str) -> list[str]:
    """The patterns that a value of this shape (of shape(), with the letters T and Z of a timestamp as they stand) may have."""
    for split, literal in ((r"(?<=99)T(?=9)", "'T'"), (r" (?=9{1,2}:)", " "), (r"T(?=9)", "'T'")):
        halves = re.split(split, of_shape, maxsplit=1)
        if len(halves) == 2:
            return [d + literal + c for d in _day(halves[0]) for c in _clock(halves[1])]
    return _day(of_shape) or _clock(of_shape)


def inferred_format(df: DataFrame, column: str, formats: tuple[str, ...] | None = None) -> str | None:
    """The pattern that most values have; None where none fits any.

    Without given formats, all orders of components are tried that the shapes of the values allow, whatever else the column holds.
    Equally good ones: the first, where year-month-day comes before month-day-year before day-month-year.
    """
    if formats is None:
        kept = F.regexp_replace(F.regexp_replace(shape(F.col(column)), r"(?<=99)A(?=99)", "T"), r"(?<=9)A$", "Z")
        shapes = df.filter(F.col(column).isNotNull()).groupBy(kept.alias("s")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("s").rlike(POSSIBLE)).orderBy(F.desc("n"), "s").collect()
        formats = tuple(dict.fromkeys(f for r in shapes for f in candidates(r["s"])))
        if not formats:
            return None
    hits = df.agg(*[F.count(F.try_to_timestamp(F.trim(F.col(column)), F.lit(f))).alias(f"f{i}") for i, f in enumerate(formats)]).first()
    best = max(range(len(formats)), key=lambda i: (hits[f"f{i}"], -i))
    return formats[best] if hits[f"f{best}"] else None


def parsed(value: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A timestamp by the first format that fits; nine or ten digits are seconds since 1970."""
    text = F.trim(value.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    unix = F.when(text.rlike(r"^\d{9,10}(\.\d+)?$"), F.timestamp_seconds(text.try_cast("double")))
    return F.coalesce(unix, *tries)


def reformatted(value: Column, fmt: str, formats: tuple[str, ...] = FORMATS) -> Column:
    """The value in another format; null where none fits it.  XXX at the end of a format is Z or an offset."""
    return F.date_format(parsed(value, formats), fmt)


def shifted_between(value: Column, fmt: str, low: int, high: int, *key, seed: int = 0) -> Column:
    """A date moved by low to high days, chosen by a hash of the key; its format stays."""
    days = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(high - low + 1)) + low).cast("int")
    return F.date_format(F.try_to_timestamp(value, F.lit(fmt)) + F.make_dt_interval(days), fmt)


def shifted(value: Column, fmt: str, most: int, *key, seed: int = 0) -> Column:
    """A date moved by 1 to most days, back or forth, by a hash of the key; its format stays."""
    h = F.xxhash64(F.lit(seed), *key)
    days = (F.pmod(h, F.lit(most)) + 1).cast("int") * F.when(F.pmod(F.shiftrightunsigned(h, 32), F.lit(2)) == 0, 1).otherwise(-1)
    at = F.try_to_timestamp(value, F.lit(fmt))
    return F.date_format(at + F.make_dt_interval(days), fmt)


def seconds_since_first(df: DataFrame, column: str) -> DataFrame:
    """The column as seconds since its earliest value; values of another format are null."""
    fmt = inferred_format(df, column)
    if fmt is None:
        raise DataError(f"no date format fits {column}")
    at = F.unix_timestamp(F.try_to_timestamp(column, F.lit(fmt)))
    first = df.agg(F.min(at)).first()[0]
    return df.withColumn(column, at - F.lit(first))


def to_seconds(value: Column, fmt: str) -> Column:
    """Epoch seconds, or seconds of the day for a pattern without a date."""
    if fmt == "elapsed_seconds":
        return value.try_cast("long")
    at = F.try_to_timestamp(value, F.lit(fmt))
    return F.unix_timestamp(at) if "y" in fmt else F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
