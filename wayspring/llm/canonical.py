"""Mapping freely entered values to a canonical list.

Prefix-filter set-similarity join: each distinct value and each listed name is
folded to forms, a form to a token set; tokens are ordered by global rarity and
only a form's rare prefix is joined; length and positional filters cut the
candidates, Jaccard is verified exactly, and the best form of a value decides.
A fuzzy match must also lie within one edit. Values that fit two listed names
equally, or none, are reported as UNMATCHED.

Work is done on distinct values, so repeated rows cost nothing and a value that
fills a third of the table is one row here.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayspring.functions import visible
from wayspring.llm.han import Tables, romanised, tables
from wayspring.runtime import materialize, ship, table

UNMATCHED = "UNMATCHED"
#: Least similarity of a fuzzy match: one of two characters in place.
FUZZY = 1 / 3

_HAN = re.compile(r"[㐀-鿿豈-﫿]+")
_NOTE = re.compile(r"\((?:[^()]*)\)\s*$")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_KIND = re.compile(r"(?:市区|城区|地区|市)$")
_SEPARATOR = re.compile(r"\s*[/&→、;|+]\s*|\s+and\s+|,")
_LATIN_EXTRA = re.compile(r"^(?:city of|in)\s+|\s+city$|[,\s]+china$")


def fold(text: str, simplify: dict[int, int]) -> str:
    """Lower-cased compatibility form in simplified characters, without format
    characters, runs of white space single."""
    t = unicodedata.normalize("NFKC", text).lower().translate(simplify)
    t = "".join(ch for ch in t if unicodedata.category(ch) not in ("Cf", "Cc") or ch.isspace())
    return re.sub(r"\s+", " ", t).strip()


def _latin(t: str) -> str:
    before = None
    while t != before:
        before, t = t, _LATIN_EXTRA.sub("", _OUTER.sub("", t)).strip()
    return re.sub(r"[^a-zà-ɏ0-9]", "", t)


def forms_of_value(text: str, simplify: dict[int, int], sizes: tuple[int, ...] = (2, 3, 4)) -> list[tuple[str, bool]]:
    """(form, whole): the folded value without decoration, and its parts, which
    count only where they equal a listed name; sizes: the lengths names have."""
    t = fold(text, simplify)
    if _OUTER.sub("", _NOTE.sub("", t)):
        t = _NOTE.sub("", t)
    t = _OUTER.sub("", t)
    out: dict[str, bool] = {}
    if re.search("[a-z]", t):
        core = _latin(_HAN.sub("", t))
        if core:
            out[core] = True
        for part in _SEPARATOR.split(t):
            part = _latin(_HAN.sub("", part))
            if part:
                out.setdefault(part, False)
    runs = _HAN.findall(t.replace(" ", ""))
    if runs:
        if len(runs) == 1 and not re.search("[a-z]", t):
            core = re.sub(r"^在(?=..)", "", runs[0])
            if len(core) > 2:
                core = _KIND.sub("", core)
            out[core] = True
        for run in runs:
            for n in sizes:
                for i in range(len(run) - n + 1):
                    out.setdefault(run[i : i + n], False)
    return list(out.items())


def forms_of_name(name: str, simplify: dict[int, int]) -> str:
    t = fold(name, simplify)
    return _latin(t) if re.search("[a-z]", t) and not _HAN.search(t) else t.replace(" ", "")


def tokens(form: str) -> list[str]:
    """Latin: padded letter pairs; others: characters with their place. Repeated
    pairs are numbered, so the list is a set."""
    if not form:
        return []
    raw = [form_pair for form_pair in map("".join, zip("^" + form, form + "$"))] if re.match(r"[a-z0-9]", form) else [f"{i}{c}" for i, c in enumerate(form)]
    seen: dict[str, int] = {}
    out = []
    for x in raw:
        seen[x] = seen.get(x, 0) + 1
        out.append(x if seen[x] == 1 else f"{x}#{seen[x]}")
    return out


def _value_forms(values: DataFrame, han: Tables, sizes: tuple[int, ...]) -> DataFrame:
    longest = max(sizes, default=0) + 1  # a longer form is more than one edit away from every name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, f, w, tokens(f), romanised(f, han.readings) if len(f) <= longest else []) for v in b["value"] for f, w in forms_of_value(v, han.simplify, sizes)]
            yield pd.DataFrame(rows, columns=["value", "form", "whole", "toks", "roman"])

    return values.mapInPandas(run, "value string, form string, whole boolean, toks array<string>, roman array<string>")


def _name_forms(names: DataFrame, han: Tables) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for canonical, name in zip(b["canonical"], b["name"]):
                roman = romanised(fold(canonical, han.simplify), han.readings)
                for n in {forms_of_name(name, han.simplify), *(roman if name == canonical else ())}:
                    if n:
                        rows.append((canonical, n, tokens(n), roman))
            yield pd.DataFrame(rows, columns=["canonical", "name", "toks", "name_roman"])

    return names.mapInPandas(run, "canonical string, name string, toks array<string>, name_roman array<string>").dropDuplicates(["canonical", "name"])


def _prefixes(forms: DataFrame, id_col: str, rarity: DataFrame, least) -> DataFrame:
    """(id, n, toks, tok, at): each form's prefix of rare tokens, at from 0."""
    toks = forms.select(id_col, "toks", F.explode("toks").alias("tok"), least.alias("least")).join(rarity, "tok")
    ordered = toks.groupBy(id_col, "least").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("o"))
    n = F.size("o")
    return ordered.select(
        id_col, n.alias("n"), F.transform("o", lambda s: s["tok"]).alias("toks"),
        F.posexplode(F.slice("o", F.lit(1), (n - F.ceil(n * F.col("least") - F.lit(1e-9)) + 1).cast("int"))).alias("at", "s"),
    ).select(id_col, "n", "toks", F.col("s.tok").alias("tok"), "at")


def similar_forms(left: DataFrame, right: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """Exact set-similarity join of left (form, whole, toks) with right (name, toks):
    (form, name, jaccard) with jaccard >= fuzzy for whole forms and = 1 for parts."""
    both = left.select("toks").unionByName(right.select("toks"))
    rarity = both.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    a = _prefixes(left, "form", rarity, F.when(F.col("whole"), F.lit(fuzzy)).otherwise(F.lit(1.0)))
    b = _prefixes(right, "name", rarity, F.lit(fuzzy)).select("name", F.col("n").alias("m"), F.col("toks").alias("toks_b"), "tok", F.col("at").alias("at_b"))
    need = F.ceil(F.lit(fuzzy / (1 + fuzzy)) * (F.col("n") + F.col("m")) - F.lit(1e-9))
    cand = (
        a.join(b, "tok")
        .where((F.col("m") * fuzzy <= F.col("n") + 1e-9) & (F.col("n") * fuzzy <= F.col("m") + 1e-9))
        .where(1 + F.least(F.col("n") - F.col("at") - 1, F.col("m") - F.col("at_b") - 1) >= need)
        .dropDuplicates(["form", "name"])
    )
    same = F.size(F.array_intersect("toks", "toks_b"))
    return cand.select("form", "name", (same / (F.col("n") + F.col("m") - same)).alias("jaccard")).where(F.col("jaccard") >= fuzzy - 1e-9)


def map_to_canonical(values: DataFrame, reference: DataFrame, han: Tables | None = None, fuzzy: float = FUZZY) -> DataFrame:
    """(value, canonical) for the distinct non-blank strings of values.value.

    reference: (canonical, names array<string>); blank and null names are left
    out, padded ones trimmed. canonical is UNMATCHED where no name, or two names
    equally, fit; with an empty reference that is every value. Other columns of
    either side are ignored. han: tables of forms and readings, by default those
    of every Chinese character."""
    ship(values.sparkSession)
    han = han or tables(values.sparkSession)
    vals = values.select(F.col("value").cast("string").alias("value")).where(visible(F.col("value"))).distinct()
    names = reference.select("canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("names", F.array().cast("array<string>")))).alias("name"))
    names = _name_forms(names.where(visible(F.col("name")) & visible(F.col("canonical"))).distinct(), han)
    names = materialize(names, "names")  # read three times
    sizes = names.where(~F.col("name").rlike("^[a-z0-9]") & (F.length("name") > 1)).select(F.length("name")).distinct().collect()  # lengths of listed names
    vf = materialize(_value_forms(vals, han, tuple(sorted(r[0] for r in sizes))), "forms")  # read twice, folded once
    left = vf.groupBy("form").agg(F.max("whole").alias("whole"), F.first("toks").alias("toks"))
    right = names.groupBy("name").agg(F.first("toks").alias("toks"))
    hits = similar_forms(left, right, fuzzy)
    scored = vf.select("value", "form", "whole", "roman").join(hits, "form").join(names.select("canonical", "name", "name_roman"), "name")
    exact = F.col("jaccard") >= 1 - 1e-9
    edit = F.levenshtein("form", "name") <= 1
    near = F.col("whole") & edit & (F.length("form") >= F.when(F.col("form").rlike("^[a-z0-9]"), 3).otherwise(2))
    sounds = F.arrays_overlap("roman", "name_roman")
    rank = F.when(exact & F.col("whole"), 4.0).when(exact, 3.0).when(near, F.when(sounds, 2.0).otherwise(F.col("jaccard")))
    best = (
        scored.withColumn("rank", rank).where("rank is not null")
        .groupBy("value", "canonical").agg(F.max("rank").alias("rank"))
        .withColumn("top", F.max("rank").over(Window.partitionBy("value")))
        .where(F.col("rank") >= F.col("top") - 1e-9)
        .groupBy("value").agg(F.count("*").alias("n"), F.first("canonical").alias("canonical"))
    )
    out = vals.join(best, "value", "left")
    return out.select("value", F.when(F.col("n") == 1, F.col("canonical")).otherwise(UNMATCHED).alias("canonical"))


def typed_cities(contributions: DataFrame, city_meta: DataFrame) -> DataFrame:
    """(contribution_id, value, city) of contributions whose non-blank city is
    not, character for character, a listed one."""
    typed = contributions.select(F.col("id").alias("contribution_id"), F.col("city").alias("value")).where(visible(F.col("value"))).distinct()
    listed = city_meta.select(F.col("city").alias("value")).distinct()
    typed = typed.join(listed, "value", "left_anti")
    reference = city_meta.select(F.col("city").alias("canonical"), F.col("aliases").alias("names"))
    found = map_to_canonical(typed, reference)
    return typed.join(found, "value").select("contribution_id", "value", F.col("canonical").alias("city"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return typed_cities(table(spark, sf_dir, "contributions"), table(spark, sf_dir, "city_meta")).select("contribution_id", "city").distinct()


def p1_unmatched_values(spark, sf_dir: str) -> DataFrame:
    """Values that mean no listed city, with the rows that use them."""
    typed = typed_cities(table(spark, sf_dir, "contributions"), table(spark, sf_dir, "city_meta"))
    return typed.where(F.col("city") == UNMATCHED).groupBy("value").agg(F.countDistinct("contribution_id").alias("n"))


QUERIES = {"p1_found": p1_found, "p1_unmatched_values": p1_unmatched_values}
ORACLE: dict[str, str] = {}
