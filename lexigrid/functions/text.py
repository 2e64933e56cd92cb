"""Words, tokens and the restricted lower case, as Column -> Column functions. The grammars read alike in Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that the restricted lower case maps, and the token grammars.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0x410, 0x430))) + "Ё"
LOWER = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0x430, 0x450))) + "ё"

_NUMBER = r"[0-9](?:\.[0-9])*"
_LETTER_WIDE = r"[A-Za-z\x{0410}-\x{044F}\x{0401}\x{0451}\x{0370}-\x{03FF}\x{00B5}]"
_UNIT_WIDE = rf"(?:{_NUMBER}|{_LETTER_WIDE})"
_UNIT_INDEX = rf"(?:{_NUMBER}|[A-Za-z\x{{0400}}-\x{{047F}}])"
_PLAIN = r"[0-9A-Za-z\x{0410}-\x{042F}\x{0430}-\x{044F}\x{0401}\x{0451}]+"
#: `wide` is the stand-alone tokenizer's grammar, `index` that of index and search, `plain` that of the rank-frequency
#: analysis (after full lower-casing), `words` are runs without white space.
GRAMMARS = {
    "wide": rf"{_UNIT_WIDE}(?:[-\x{{2010}}\x{{2011}}\x{{2012}}\x{{2212}}+]?{_UNIT_WIDE}|['\x{{2019}}]{_LETTER_WIDE})*",
    "index": rf"{_UNIT_INDEX}(?:[-+']?{_UNIT_INDEX})*",
    "plain": rf"{_PLAIN}(?:[-_]{_PLAIN})*",
    "words": r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+",
}


#: In Java a group repeated as (...)* recurses at each step and runs out of stack on a token of some thousand letters. As
#: nothing follows the repetitions, making them possessive changes no match, and those are loops.
_JAVA = {name: pattern.replace(")*", ")*+") for name, pattern in GRAMMARS.items()}


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fold(text: Column | str) -> Column:
    """Lower case of A-Z, А-Я and Ё alone; every other character stays."""
    return F.translate(column(text), UPPER, LOWER)


def cased(text: Column | str, grammar: str) -> Column:
    """The text in the case that the grammar reads."""
    return {"wide": fold, "index": fold, "plain": lambda x: F.lower(column(x)), "words": column}[grammar](text)


def tokens(text: Column | str, grammar: str = "index") -> Column:
    """array<string>: the tokens of the text in order; null for a null text."""
    return F.regexp_extract_all(cased(text, grammar), F.lit(f"({_JAVA[grammar]})"), F.lit(1))


def terms(text: Column | str, grammar: str = "index") -> Column:
    """The distinct tokens of the text."""
    return F.array_distinct(tokens(text, grammar))


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.size(tokens(text, "words")), F.lit(0))


def body_bytes(text: Column | str) -> Column:
    """Bytes of the lines, each with its line end: one more than the text has if its last line lacks one."""
    t = column(text)
    return F.octet_length(t) + F.when((F.length(t) > 0) & ~t.endswith("\n"), 1).otherwise(0)


def has_cyrillic(text: Column | str) -> Column:
    return column(text).rlike(r"[\x{0400}-\x{047F}]")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The same text functions as DuckDB SQL.
def sql_tokens(text: str, grammar: str = "index") -> str:
    folded = {"wide": f"translate({text}, '{UPPER}', '{LOWER}')", "plain": f"lower({text})", "words": text}
    folded["index"] = folded["wide"]
    return f"regexp_extract_all({folded[grammar]}, '{GRAMMARS[grammar].replace(chr(39), chr(39) * 2)}')"
