"""Functions of strings: masking, hashing, countries, and text statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParameterError
from .letters import ascii_of

#: Marks that end a sentence in several scripts.
SENTENCE_ENDS = r"[.!?。！？؟।]+"
WORD = r"((?U)\w+)"


def salted_hash(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def partial_mask(value: Column, left: int, mask: str, right: int, tolerance: int = 1) -> Column:
    """The first and last characters around a mask; at least one more than the tolerance stays hidden.

    What is too much of the ends is taken from both alike, the odd one from the left; what one end has not, the other gives.
    """
    if not mask or left < 0 or right < 0 or tolerance < 0:
        raise ParameterError("a mask and no negative number is needed")
    text = value.cast("string")
    excess = F.greatest(F.lit(left + right) - F.greatest(F.length(text) - tolerance - 1, F.lit(0)), F.lit(0))
    odd, even = F.ceil(excess / 2).cast("int"), F.floor(excess / 2).cast("int")
    first = F.lit(left) - F.least(F.lit(left), odd + F.greatest(even - right, F.lit(0)))
    last = F.lit(right) - F.least(F.lit(right), even + F.greatest(odd - left, F.lit(0)))
    return F.concat(F.substring(text, F.lit(1), first), F.lit(mask), F.right(text, last))


def normalized(value: Column, allow: str = "") -> Column:
    """Letters in ASCII (letters.ascii_of()); of these only word characters and the allowed ones stay."""
    kept = "".join("\\" + c for c in allow)
    return F.regexp_replace(ascii_of(value), f"[^\\w{kept}]", "")


def scrubbed(value: Column) -> Column:
    """Bytes as text without those that are no UTF-8; a string stays as it is."""
    text = F.make_valid_utf8(value.cast("string"))
    return F.when(F.is_valid_utf8(value.cast("string")), text).otherwise(F.replace(text, F.lit("\ufffd"), F.lit("")))


def top_level_domain(country: Column) -> Column:
    """'.xx' of a two-letter country code."""
    code = F.lower(country)
    return F.when(F.length(code) == 2, F.concat(F.lit("."), F.when(code == "gb", "uk").otherwise(code)))


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SENTENCE_ENDS), lambda s: F.trim(s) != ""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def words_per_sentence(text: Column) -> Column:
    return word_count(text) / F.greatest(F.lit(1), sentence_count(text))


def characters_per_word(text: Column) -> Column:
    """Null for a text without words."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(1))
    return F.when(F.size(words) > 0, F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.size(words))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def key_number(*key) -> Column:
    """A number from 0 to 2^60 of a key, equal for equal keys on every engine: the first 15 digits of an MD5."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


def picked(items: list[str], *key) -> Column:
    """One of the items by its key's number: equal keys give equal picks."""
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(key_number(*key), F.lit(len(items))) + 1).cast("int"))
