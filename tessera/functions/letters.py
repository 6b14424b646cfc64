"""Letters of Latin, Greek and Cyrillic scripts as ASCII, by a table that is applied inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks whose letters are taken apart: Latin with marks, Greek, Cyrillic, their extensions, wide forms and signs.
RANGES = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2000, 0x2070), (0x2070, 0x20A0), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
#: Letters that no decomposition takes apart, by their lower case.
PLAIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "ng", "ĸ": "k", "ŧ": "t", "ƀ": "b", "ɓ": "b", "ɖ": "d", "ɗ": "d", "ə": "e", "ɛ": "e", "ɣ": "g", "ɨ": "i", "ɲ": "n", "ɔ": "o", "ʃ": "sh", "ʒ": "zh", "ʼ": "'", "ſ": "s", "ȷ": "j"}
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split()))
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёђѓєѕіїјљњћќўџґ", ["a", "b", "v", "g", "d", "e", "zh", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "yu", "ya", "yo", "dj", "g", "ye", "dz", "i", "yi", "j", "lj", "nj", "c", "k", "u", "dz", "g"]))
MARKS = {"‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "‐": "-", "‑": "-", "…": "...", "«": "<<", "»": ">>", "€": "EUR", "№": "No"}


def _of(c: str, known: dict[str, str]) -> str | None:
    """The ASCII of a character: its own entry, that of its lower case with a capital, or what its decomposition gives."""
    if c.isascii():
        return c
    if c in known:
        return known[c]
    low = c.lower()
    if low != c and low in known:
        return known[low][:1].upper() + known[low][1:]
    if unicodedata.combining(c):
        return ""
    apart = unicodedata.normalize("NFKD", c)
    if apart == c:
        return None
    parts = [_of(x, known) for x in apart]
    return None if None in parts else "".join(parts)


def ascii_table() -> dict[str, str]:
    """Every character of RANGES that has an ASCII form, and the combining marks, which have none of their own."""
    known = PLAIN | GREEK | CYRILLIC | MARKS
    found = {c: a for first, end in RANGES for c in map(chr, range(first, end)) if (a := _of(c, known)) is not None}
    found |= {c: _of(c, known) for k in known for c in {k, k.upper()} if len(c) == 1 and not c.isascii()}
    return found | {chr(i): "" for i in range(0x300, 0x370)}


def ascii_of(value: Column) -> Column:
    """Text in ASCII.  What the table lacks (other scripts, signs) is left out; text in ASCII stays as it is.

    Characters that become one or none are translated at once; only those that become several go through a map,
    and only in texts that still have one.
    """
    table = ascii_table()
    one = {c: a for c, a in table.items() if len(a) == 1} | {c: "" for c, a in table.items() if not a}
    order = sorted(one, key=lambda c: one[c] == "")  # translate() drops the characters behind the replacement's end
    several = sorted((c, a) for c, a in table.items() if len(a) > 1)
    text = F.translate(value.cast("string"), "".join(order), "".join(one[c] for c in order))
    names = F.create_map(*[F.lit(x) for pair in several for x in pair])
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")
    rest = F.when(text.rlike(r"[^\x00-\x7F]"), spread).otherwise(text)
    return F.regexp_replace(rest, r"[^\x00-\x7F]", "")
