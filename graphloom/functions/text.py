"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Property type names and the spellings accepted for them.
PROPERTY_TYPES = {
    "STRING": ("STR", "STRING", "TEXT"), "INTEGER": ("INT", "INTEGER", "LONG"), "FLOAT": ("FLOAT", "DOUBLE", "DECIMAL", "NUMBER"),
    "BOOLEAN": ("BOOL", "BOOLEAN"), "DATE_TIME": ("DATETIME", "DATE_TIME"), "DATE": ("DATE",), "TIME": ("TIME",),
    "DURATION": ("DURATION",), "POINT": ("POINT",), "LIST": ("LIST",), "MAP": ("MAP",),
}


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_identifier(c: Column) -> Column:
    """Stripped, without a leading colon, out of backticks."""
    c = F.regexp_replace(strip(c), r"^:\s*", "")
    return F.regexp_replace(c, r"^`(.*)`$", "$1")


def property_type(c: Column) -> Column:
    """The canonical name of a property type; empty: UNKNOWN; names beyond the list: upper case."""
    up = F.upper(F.translate(strip(F.coalesce(c, F.lit(""))), "- ", "__"))
    names = F.create_map(*[F.lit(x) for name, spellings in PROPERTY_TYPES.items() for s in spellings for x in (s, name)])
    return F.when(up == "", "UNKNOWN").otherwise(F.coalesce(F.element_at(names, up), F.when(up.startswith("LIST"), "LIST"), up))


# What counts as a word of an identifier and of a question, and words that say nothing.
IDENTIFIER_WORD = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+"
QUESTION_WORD = "[a-z0-9]+"
STOP_WORDS = (
    "all", "and", "are", "for", "from", "has", "have", "how", "list", "many", "name", "number", "that", "the", "their", "them", "there", "these",
    "was", "were", "what", "when", "where", "which", "who", "whose", "with",
)


def _telling(words: Column) -> Column:
    """Distinct words of at least 3 signs, without a last s where more than 3 signs are there, stop words aside."""
    short = F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_distinct(F.filter(short, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def identifier_words(c: Column) -> Column:
    """Words of a camel-case, snake-case or plain identifier."""
    return _telling(F.transform(F.regexp_extract_all(c, F.lit(IDENTIFIER_WORD), F.lit(0)), F.lower))


def question_words(c: Column) -> Column:
    """Words of a question."""
    return _telling(F.regexp_extract_all(F.lower(c), F.lit(QUESTION_WORD), F.lit(0)))


def without_end_of_turn(c: Column) -> Column:
    """A trailing <end_of_turn> cut off with the space around it; other texts unchanged."""
    mark = "<end_of_turn>"
    return F.when(c.endswith(mark), F.trim(F.substring(c, F.lit(1), F.length(c) - len(mark)))).otherwise(c)


def database_name(c: Column, dotted: bool) -> Column:
    return F.replace(c, F.lit("_"), F.lit(".")) if dotted else c


def node_text(label: Column, properties: Column) -> Column:
    """(:Label { name: TYPE, ... }) with names in order; properties: map."""
    return F.concat(F.lit("(:"), label, _properties(properties), F.lit(")"))


def relation_text(source: Column, type_: Column, target: Column, properties: Column) -> Column:
    return F.concat(F.lit("(:"), source, F.lit(")-[:"), type_, _properties(properties), F.lit("]->(:"), target, F.lit(")"))


def _properties(m: Column) -> Column:
    inner = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e.key, F.lit(": "), e.value)), ", ")
    return F.when(F.size(m) > 0, F.concat(F.lit(" { "), inner, F.lit(" }"))).otherwise("")


def section(header: str, lines: Column) -> Column:
    """A header and its distinct lines in order as bullets, or "- none"."""
    rows = F.transform(F.array_sort(F.array_distinct(lines)), lambda x: F.concat(F.lit("- "), x))
    return F.concat(F.lit(header + "\n"), F.when(F.size(lines) > 0, F.array_join(rows, "\n")).otherwise("- none"))


def chat_markup(messages: Column, open_: str, middle: str, close: str) -> Column:
    """Messages (role, content) one after another in a chat template's marks."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(open_), m.role, F.lit(middle), m.content, F.lit(close))), "")


def preview(c: Column, n: int) -> Column:
    return F.translate(F.substring(c, 1, n), "\n\r", "  ")


def duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced all at once, so braces inside values are safe; {{ and }} are braces."""
    from string import Formatter

    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def sampled_digest(c: Column, size: int = 1 << 16) -> Column:
    """SHA-256 of the first size signs of a value, and of the last ones where it is longer."""
    tail = F.when(F.length(c) > size, F.right(c, F.lit(size))).otherwise("")
    return F.sha2(F.concat(F.substring(c, 1, size), tail), 256)
