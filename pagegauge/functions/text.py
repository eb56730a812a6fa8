"""Text columns: browser-style trimming, entity decoding, snippets, word overlap, reading ease."""

from __future__ import annotations

import json
import string
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions.binding import let

WS = C.WHITESPACE_PATTERN
# Runs of white space but lone spaces. Most characters are told from white space by one comparison, not by the whole list.
_SPACE = rf"[[^\x21-\x7E]&&{WS}]"
_RUN = rf"\x20{_SPACE}++|[[^\x20-\x7E]&&{WS}]{_SPACE}*+"


def trim(col: Column) -> Column:
    return F.btrim(col, F.lit(C.WHITESPACE_CHARS))


def collapse(col: Column) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(col, _RUN, " "))


# Characters that numeric references 128 to 159 stand for: those of the Windows code page.
_C1 = {i: c for i in range(0x80, 0xA0) if (c := bytes([i]).decode("cp1252", "ignore"))}
# A character reference, or what lies between two.
REFERENCE_PATTERN = r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[a-zA-Z][a-zA-Z0-9]*+;?+)|[^&]++|&"


def _numeric_reference(piece: Column) -> Column:
    digits = F.regexp_extract(piece, "^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
    # More digits than any character has mean no character, however many they are.
    hex_code = F.when(F.length(digits) > 8, "FFFFFFFF").when(piece.rlike("^&#[xX]"), digits).otherwise(F.conv(digits, 10, 16))
    code = F.conv(hex_code, 16, 10).cast("bigint")
    char = F.decode(F.unhex(F.lpad(hex_code, 8, "0")), "UTF-32")
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    windows = F.create_map(*[F.lit(x) for pair in _C1.items() for x in pair])
    return F.when(code.between(0x80, 0x9F) & F.map_contains_key(windows, code.cast("int")), F.try_element_at(windows, code.cast("int"))).when(
        valid, char
    ).otherwise(F.lit("\ufffd"))


# A map is searched key by key, so names are spread over many small maps by their checksum.
_GROUPS = 1024


def _names() -> str:
    groups: list[dict[str, str]] = [{} for _ in range(_GROUPS)]
    for name, text in html5.items():
        groups[zlib.crc32(f"&{name}".encode()) % _GROUPS][f"&{name}"] = text
    return json.dumps(groups)


_NAMES = _names()


def decode_entities(col: Column) -> Column:
    """Character references decoded once: numeric ones of any length and all named ones.

    A name without its semicolon counts where the public table has it so; unknown names stay as they are.
    """
    # The table as one string, read when the query starts: thousands of literals would slow every plan down.
    groups = F.from_json(F.lit(_NAMES), "array<map<string,string>>")
    pieces = F.regexp_extract_all(col, F.lit(REFERENCE_PATTERN), F.lit(0))
    decoded = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(~F.startswith(p, F.lit("&")) | (F.length(p) == 1), p)
            .when(p == "&amp;", "&").when(p == "&nbsp;", "\u00a0").when(p == "&quot;", '"')
            .when(F.startswith(p, F.lit("&#")), _numeric_reference(p))
            .otherwise(F.coalesce(F.try_element_at(F.get(groups, F.pmod(F.crc32(p.cast("binary")), F.lit(_GROUPS)).cast("int")), p), p)),
        ),
        "",
    )
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)


def snippet(col: Column, limit: int = 200) -> Column:
    def cut(flat: Column) -> Column:
        return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)

    return let(collapse(col), cut)


def snippet_json(value: Column, limit: int = 200) -> Column:
    """Snippet of a structured value, shown as JSON."""
    return snippet(F.to_json(value), limit)


def word_set(col: Column) -> Column:
    """Distinct lower-case ASCII words of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def _word_overlap(left: Column, right: Column, one_empty: float, both_empty: float) -> Column:
    def compare(sets: Column) -> Column:
        a, b = sets["a"], sets["b"]
        common = F.size(F.array_intersect(a, b)).cast("double")
        return (
            F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(one_empty))
            .otherwise(common / (F.size(a) + F.size(b) - common))
        )

    return let(F.struct(word_set(left).alias("a"), word_set(right).alias("b")), compare)


def jaccard_schema(left: Column, right: Column) -> Column:
    """Word overlap; two empty sets agree fully."""
    return _word_overlap(left, right, one_empty=0.0, both_empty=1.0)


def jaccard_clarity(left: Column, right: Column) -> Column:
    """Word overlap; an empty set on either side agrees with nothing."""
    return _word_overlap(left, right, one_empty=0.0, both_empty=0.0)


# Fixed values of the reading-ease formula's word and sentence patterns. Letters are spelled out one by one: a set of single
# characters is looked up in a table, while every range in it is one more comparison of each character.
_LATIN = "".join(chr(c) for c in range(0xE0, 0x100))
_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0xE0)) + _LATIN
_VOWELS = "aeiouy" + _LATIN
WORD_PATTERN = f"[{_LETTERS}]++(?:'[{_LETTERS}]++)*+"
SENTENCE_PATTERN = "[.!?]+(?:" + WS + r"|\z)"
SILENT_ENDING = "(?:[^laeiouy]es|ed|[^laeiouy]e)$"
VOWELS = "[aeiouyà-ÿ]+"
# The silent ending of any word of a line.
_SILENT = "(?:ed|[^ laeiouy]es?)(?![^ ])"


def syllables(word: Column) -> Column:
    def count(letters: Column) -> Column:
        spoken = F.regexp_replace(F.regexp_replace(letters, SILENT_ENDING, ""), "^y", "")
        groups = F.size(F.regexp_extract_all(spoken, F.lit(VOWELS), F.lit(0)))
        return (
            F.when(F.length(letters) == 0, 0)
            .when(F.length(letters) <= 3, 1)
            .otherwise(F.greatest(F.lit(1), groups))
        )

    return let(F.regexp_replace(F.lower(word), "[^a-zà-ÿ]", ""), count)


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD_PATTERN), F.lit(0))


def syllable_total(word_list: Column) -> Column:
    """The sum of ``syllables`` over words as ``words`` finds them, from one line of them all: nothing is evaluated word by word.

    Every word keeps the space before it. A short word becomes one vowel; groups of vowels are counted by the length of what is left when
    each is one character, and words without any are found by themselves, so matches are few and none is kept as a text.
    """
    line = F.concat(F.lit(" "), F.lower(F.array_join(word_list, " ")))
    # What a word may hold besides the letters that are counted; a word of nothing else counts for none.
    line = F.regexp_replace(line, " ['×ß]++(?![^ ])", "")
    for other in "'×ß":
        line = F.replace(line, F.lit(other), F.lit(""))
    spoken = F.regexp_replace(F.regexp_replace(line, " [^ ]{1,3}+(?![^ ])", " a"), _SILENT, "")

    def total(spoken: Column) -> Column:
        # The leading vowel is one group too many.
        groups = F.length(F.regexp_replace(F.concat(F.lit("a"), spoken), f"[{_VOWELS}]++[^{_VOWELS}]*+", "a")) - 1
        return groups + F.regexp_count(spoken, F.lit(f" [^ {_VOWELS}]*+(?![^ ])"))

    return F.when(F.size(word_list) == 0, 0).otherwise(let(F.replace(spoken, F.lit(" y"), F.lit(" ")), total))


def sentence_total(col: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(col, F.lit(SENTENCE_PATTERN), F.lit(0))))


def flesch_from_counts(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Reading ease from counts, 0 below thirty words, clamped to 0-100."""
    w = n_words.cast("double")
    per_word = F.nullif(w, F.lit(0.0))
    ease = F.lit(206.835) - F.lit(1.015) * (w / n_sentences.cast("double")) - F.lit(84.6) * (
        n_syllables.cast("double") / per_word
    )
    return F.when(n_words < 30, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)))
