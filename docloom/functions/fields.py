"""Field instructions and durations as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import scalars as S

# Keywords of field instructions and the kinds that they name.
FIELD_KINDS = {
    "HYPERLINK": "Hyperlink", "INCLUDETEXT": "IncludeText", "INCLUDEPICTURE": "IncludePicture", "MERGEFIELD": "MergeField", "DATE": "Date", "REF": "Ref", "PAGEREF": "PageRef",
    "DDE": "Dde", "DDEAUTO": "DdeAuto", "AUTOTEXT": "AutoText", "AUTOCORRECT": "AutoCorrect",
}
ENTITIES = {"&amp;": "&", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">"}
MOST_MS = 4_294_967_295
BLANKS, MASKED = " \t\r\n", "\ue000\ue001\ue002\ue003"


def _masked(text: Column) -> Column:
    """``text`` with other characters for the blanks between quotes."""
    inside = lambda part, i: F.when(i % 2 == 1, F.translate(part, BLANKS, MASKED)).otherwise(part)
    return F.array_join(F.transform(F.split(text, '"'), inside), '"')


def _tokens(pieces: Column) -> Column:
    """Without quotes and empty ones, the blanks as they were."""
    return F.filter(F.transform(pieces, lambda p: F.translate(F.replace(p, F.lit('"'), F.lit("")), MASKED, BLANKS)), lambda t: t != "")


def _kind(tokens: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in FIELD_KINDS.items() for x in kv))
    return F.when(F.size(tokens) > 0, F.coalesce(F.try_element_at(kinds, F.upper(F.get(tokens, F.lit(0)))), F.lit("Unknown")))


def _rest(tokens: Column) -> Column:
    return F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))


def word_field(instruction: Column) -> tuple[Column, Column, Column]:
    """(kind, args, switches) of a word-processing field instruction, the kind null without any word.

    Words are parted by blanks outside quotes. Those that begin with a backslash are switches, of several backslashes one
    is kept; a tab anywhere is a ``\\t`` switch, and so are single letters of a HYPERLINK.
    """
    text = instruction
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    one = lambda s: F.regexp_replace(s, r"^\\+", r"\\")
    switch = lambda t: t.startswith("\\")
    outside = F.regexp_replace(text, r'"[^"]*("|$)', '"')
    inner = F.transform(F.filter(F.regexp_extract_all(outside, F.lit(r"(\\\S+)"), 1), lambda s: ~F.contains(s, F.lit('"'))), one)
    tab = F.when(F.contains(text, F.lit("\t")), F.array(F.lit("\\t"))).otherwise(F.array().cast("array<string>"))

    def read(kind, words):
        letter = lambda t: (kind == "Hyperlink") & t.rlike("^[A-Za-z]$")
        plain = F.filter(words, lambda t: ~switch(t))
        more = F.array_distinct(F.concat(inner, tab, F.transform(F.filter(plain, letter), lambda t: F.concat(F.lit("\\"), t))))
        switches = S.bound(F.transform(F.filter(words, switch), one), lambda given: F.concat(given, F.filter(more, lambda s: ~F.array_contains(given, s))))
        return F.struct(kind.alias("kind"), F.filter(plain, lambda t: ~letter(t)).alias("args"), switches.alias("switches"))

    tokens = _tokens(F.split(_masked(text), r"[ \t\r\n]+"))
    found = S.bound(tokens, lambda t: S.bound(F.struct(_kind(t).alias("kind"), _rest(t).alias("words")), lambda f: read(f["kind"], f["words"])))
    return found["kind"], found["args"], found["switches"]


def rtf_field(instruction: Column) -> tuple[Column, Column, Column]:
    """(kind, args, switches) of a rich-text field instruction: a backslash begins a switch even inside a word or quotes,
    up to a blank or a quote, and switches lose their first backslash."""
    tokens = _tokens(F.regexp_extract_all(_masked(instruction), F.lit(r'(\\[^\s"\ue000-\ue003]*|[^\s\\]+)'), 1))
    words = _rest(tokens)
    return _kind(tokens), F.filter(words, lambda t: ~t.startswith("\\")), F.transform(F.filter(words, lambda t: t.startswith("\\")), lambda t: t.substr(F.lit(2), F.length(t)))


def duration_ms(text: Column) -> Column:
    """``5ms``, ``1.5s`` or ``PT1.5S`` in milliseconds, null if it is none or does not fit 32 bits."""
    trimmed = F.trim(text)
    number = r"[+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    whole = F.regexp_extract(trimmed, "^[+]?([0-9]{1,10})ms$", 1).try_cast("long")
    seconds = F.coalesce(F.nullif(F.regexp_extract(trimmed, f"^({number})s$", 1), F.lit("")), F.nullif(F.regexp_extract(trimmed, f"^PT({number})S$", 1), F.lit(""))).try_cast("double")
    ms = F.coalesce(whole.cast("double"), F.floor(seconds * 1000 + 0.5).cast("double"))
    return F.when(ms <= MOST_MS, ms.cast("long"))
