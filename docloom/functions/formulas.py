"""Formulas of spreadsheets as security scans read them: DDE calls, array markers, function names and quoted references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import scalars as S

# The functions that are evaluated, and those reported apart.
SUPPORTED = ("SUM", "AVERAGE", "MIN", "MAX", "COUNT")
APART = ("DDE", "DDEAUTO")
ENTITIES = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
_BLANKS = " \t\n\x0b\f\r"
#: A quoted text with doubled quotes inside, a quote that is never closed, a parenthesis, a separator, or anything else.
_TOKEN = r"""("(?:[^"]|"")*"|'(?:[^']|'')*'|["']|[();,]|[^"'();,]+)"""


def odf_formula(attribute: Column) -> Column:
    """The formula of an attribute's value: entities resolved, without the namespace and blanks around it."""
    text = attribute
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(text, "^of:=?", ""), F.lit(_BLANKS))


def is_array_formula(formula: Column) -> Column:
    return formula.rlike("[{}]")


def function_names(formula: Column) -> Column:
    """Names before a parenthesis in upper case, in order, repeats included."""
    return F.transform(F.regexp_extract_all(formula, F.lit(r"([A-Za-z_][A-Za-z0-9_.$]*+)(?=\s*\()"), 1), F.upper)


def unsupported_functions(formula: Column) -> Column:
    return F.array_distinct(F.filter(function_names(formula), lambda n: ~n.isin(*SUPPORTED, *APART)))


def quoted_references(formula: Column) -> Column:
    """(type, target) of each quoted text that is an external target."""
    kind = F.when(F.contains(F.lower(formula), F.lit("hyperlink(")), "Hyperlink").otherwise("DataConnection")
    return F.transform(F.filter(S.quoted_strings(formula), S.is_external_target), lambda t: F.struct(kind.alias("type"), t.alias("target")))


def _inside(rest: Column) -> Column:
    """What stands before the parenthesis that closes the one just before ``rest``; null if there is none, as behind an
    unclosed quote."""
    tokens = F.regexp_extract_all(rest, F.lit(_TOKEN), 1)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("lost"))

    def step(s, t):
        done = (s["depth"] == 0) | s["lost"]
        depth = s["depth"] + F.when(done, 0).when(t == "(", 1).when(t == ")", -1).otherwise(0)
        at = s["at"] + F.when(done | (depth == 0), 0).otherwise(F.length(t))
        return F.struct(depth.alias("depth"), at.alias("at"), (s["lost"] | (~done & t.isin('"', "'"))).alias("lost"))

    return S.bound(F.aggregate(tokens, start, step), lambda end: F.when((end["depth"] == 0) & (end["at"] > 0), F.substring(rest, F.lit(1), end["at"])))


def _arguments(inside: Column) -> Column:
    """Arguments between separators outside of quotes, without quotes and blanks around them; null if there are none."""
    mark = "\x01"
    bare = lambda t: F.when(t.isin(";", ","), mark).when(t.startswith('"'), F.replace(t, F.lit('"'), F.lit(""))).when(t.startswith("'"), F.replace(t, F.lit("'"), F.lit(""))).otherwise(t)
    joined = F.array_join(F.transform(F.regexp_extract_all(inside, F.lit(_TOKEN), 1), bare), "")
    trimmed = lambda text: F.transform(F.split(text, mark), lambda a: F.btrim(F.btrim(F.btrim(a, F.lit(_BLANKS)), F.lit('"')), F.lit("'")))
    return S.bound(joined, lambda text: F.when(F.btrim(text, F.lit(_BLANKS)) != "", trimmed(text)))


def dde_call(formula: Column, anywhere: bool = True) -> Column:
    """(kind, application, topic, item) of a formula's first DDEAUTO call, else of its first DDE call; null without a whole one.

    ``anywhere``: the call may stand behind an operator, a blank or a separator; else only at the beginning.
    """
    lead = r"(?:.*?[=(,; \t+*/-])??" if anywhere else ""
    called = lambda name: rf"(?is)^{lead}{name}\((.*)$"
    auto, plain = called("DDEAUTO"), called("DDE")
    rest = lambda kind, text, form: F.when(text.rlike(form), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, form, 1).alias("rest")))
    more = lambda given, i: F.nullif(F.get(given, F.lit(i)), F.lit(""))
    parts = lambda kind, given: F.when(given.isNotNull(), F.struct(kind.alias("kind"), F.get(given, F.lit(0)).alias("application"), more(given, 1).alias("topic"), more(given, 2).alias("item")))
    read = lambda at: S.bound(_inside(at["rest"]), lambda inside: S.bound(_arguments(inside), lambda given: parts(at["kind"], given)))
    first = lambda text: F.coalesce(rest("DdeAuto", text, auto), rest("Dde", text, plain))
    return S.bound(F.btrim(formula, F.lit(_BLANKS)), lambda text: S.bound(first(text), read))
