"""Registered queries over formulas of spreadsheets, and their SQL twins. What each formula gives is written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import formulas as X
from docloom.operators import formulas
from docloom.plans import views as V
from docloom.plans.catalogue import query

#: formula: (DDE call, array, unsupported names, references), @ for the part's key.
FORMULAS = {
    'of:=DDE("soffice";"file:///tmp/@.ods";"A1")': ("Dde|soffice|file:///tmp/@.ods|A1", False, "", "DataConnection file:///tmp/@.ods"),
    'of:=IF([.A1];DDEAUTO("app@" , "t");0)': ("DdeAuto|app@|t|-", False, "IF", ""),
    'of:=NOTDDE("a";"b")': (None, False, "NOTDDE", ""),
    "of:={SUM([.A1:.A@])}": (None, True, "", ""),
    'of:=HYPERLINK("https://x.example/@";"it\'s")': (None, False, "HYPERLINK", "Hyperlink https://x.example/@"),
    'msoxl:=WEBSERVICE ("http://y.example")': (None, False, "WEBSERVICE", "DataConnection http://y.example"),
    'of:=DDE("unclosed;"x")': (None, False, "", ""),
    "of:=DDE()": (None, False, "", ""),
    'of:=DDE(\'a b\';"say ""hi""";)': ("Dde|a b|say hi|-", False, "", ""),
    "of:=sum([.A1])*Average ([.B1])+com.sun.Fn$X(1)": (None, False, "COM.SUN.FN$X", ""),
    'of:DDE(A@,(B1),"c)d")': ("Dde|A@|(B1)|c)d", False, "", ""),
    "": (None, False, "", ""),
    'of:=DDEAUTO("x" + DDE("y")': (None, False, "", ""),
    "of:=MIN(A1;'file:///etc/@')+VLOOKUP(1)+VLOOKUP(2)+IF(1)": (None, False, "VLOOKUP,IF", "DataConnection file:///etc/@"),
    "of:=&quot;x&quot;&amp;FOO(1)&amp;{1}": (None, True, "FOO", ""),
    'of:=1-dde("é";"ftp://z.example")': ("Dde|é|ftp://z.example|-", False, "", "DataConnection ftp://z.example"),
    "of:=DDE(  )": (None, False, "", ""),
}
V.SQL["odf_formulas"] = f"""SELECT p_partkey, p_partkey // 8 AS doc_id, p_partkey AS ord, dde, is_array, unsupported, refs FROM (SELECT *, CAST(p_partkey * 5 % {len(FORMULAS)} AS INT) AS i FROM part)
    JOIN (VALUES {", ".join(f"({i}, {V._list([v[0]])[1:-1]}, {v[1]}, '{v[2]}', '{v[3]}')" for i, v in enumerate(FORMULAS.values()))}) e(i, dde, is_array, unsupported, refs) USING (i)"""


def odf_formulas(spark, d) -> DataFrame:
    """(doc_id, ord, formula): eight formulas a document, one for each part."""
    k = F.col("p_partkey").cast("long")
    text = F.element_at(F.array(*(F.lit(f) for f in FORMULAS)), (k * 5 % len(FORMULAS) + 1).cast("int"))
    return V.spread(V.table(spark, d, "part").select("p_partkey")).select(F.floor(k / 8).alias("doc_id"), k.alias("ord"), F.replace(text, F.lit("@"), k.cast("string")).alias("formula"))


@query("odf_formula_scan", V.sql("SELECT p_partkey AS ord, replace(dde, '@', CAST(p_partkey AS VARCHAR)) AS dde, is_array, unsupported, replace(refs, '@', CAST(p_partkey AS VARCHAR)) AS refs FROM odf_formulas", "odf_formulas"))
def odf_formula_scan(spark, d):
    found = formulas.scanned(odf_formulas(spark, d))
    parts = F.array(*(F.coalesce(F.col(f"dde.{c}"), F.lit("-")) for c in ("kind", "application", "topic", "item")))
    refs = F.array_join(F.transform("references", lambda r: F.concat_ws(" ", r["type"], r["target"])), ",")
    return found.select("ord", F.when(F.col("dde").isNotNull(), F.array_join(parts, "|")).alias("dde"), "is_array", F.array_join("unsupported", ",").alias("unsupported"), refs.alias("refs"))


@query(
    "odf_formula_diagnostics",
    V.sql("""+names AS (SELECT doc_id, ord, unnest(string_split(unsupported, ',')) AS name, generate_subscripts(string_split(unsupported, ','), 1) AS i FROM odf_formulas WHERE unsupported <> ''),
        first AS (SELECT doc_id, name, min(ord * 100 + i) AS place FROM names GROUP BY ALL)
        SELECT doc_id, 'ODF_FORMULA_UNSUPPORTED_FUNCTION' AS code, 'Unsupported ODF formula functions detected: ' || string_agg(name, ', ' ORDER BY place) AS message FROM first GROUP BY doc_id
        UNION ALL SELECT DISTINCT doc_id, 'ODF_FORMULA_ARRAY', 'ODF array formula detected (not fully evaluated)' FROM odf_formulas WHERE is_array""", "odf_formulas"),
)
def odf_formula_diagnostics(spark, d):
    return formulas.diagnostics(formulas.scanned(odf_formulas(spark, d)))


#: Cell formula to its DDE call, which must stand at the beginning; by hand.
CELLS = {
    'DDE("excel@","sheet","r1c1")': "Dde|excel@|sheet|r1c1", ' ddeauto(cmd;"/c calc")': "DdeAuto|cmd|/c calc|-", '=DDE("a")': None, 'IF(DDE("a"))': None, 'DDE("a"': None, "DDE('x';'y;z')+1": "Dde|x|y;z|-",
    'DDEX("a")': None, 'DDE(";@")': "Dde|;@|-|-", "DDE(,b)": "Dde||b|-",
}


@query("dde_cell_formulas", f"SELECT p_partkey, replace(dde, '@', CAST(p_partkey AS VARCHAR)) AS dde FROM part JOIN (VALUES {', '.join(f'({i}, {V._list([v])[1:-1]})' for i, v in enumerate(CELLS.values()))}) e(i, dde) ON p_partkey % {len(CELLS)} = i")
def dde_cell_formulas(spark, d):
    k = F.col("p_partkey").cast("long")
    text = F.replace(F.element_at(F.array(*(F.lit(f) for f in CELLS)), (k % len(CELLS) + 1).cast("int")), F.lit("@"), k.cast("string"))
    found = V.spread(V.table(spark, d, "part").select("p_partkey")).select("p_partkey", X.dde_call(text, anywhere=False).alias("call"))
    parts = F.array(*(F.coalesce(F.col(f"call.{c}"), F.lit("-")) for c in ("kind", "application", "topic", "item")))
    return found.select("p_partkey", F.when(F.col("call").isNotNull(), F.array_join(parts, "|")).alias("dde"))
