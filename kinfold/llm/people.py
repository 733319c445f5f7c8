"""Linking people and organisations: variant spellings to golden records, and rows of different sources to each other."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.llm import metric
from kinfold.llm.names import KIN, LEGAL_FORMS, LONGEST, Name, folded, full_forms, short_forms
from kinfold.session import cut, cut_counted

@lru_cache(65536)
def parsed(text: str) -> Name:
    return Name(text)


@lru_cache(65536)
def company_core(text: str | None) -> str | None:
    """First word of a company's folded name, without article, legal form and brackets."""
    if not text or text.strip().lower() in K.PLACEHOLDERS:
        return None
    words = [w for w in re.findall("[a-z]+", re.sub(r"\([^)]*\)?", " ", folded(text))) if w not in LEGAL_FORMS and w != "the" and len(w) > 1]
    return words[0] if words else None


def domain_core(email: str | None) -> str | None:
    """The name of a mail host under its top level domain; whether it is a company's is for the caller to find out."""
    if not email or "@" not in email:
        return None
    parts = email.rsplit("@", 1)[1].split(".")
    return parts[-2] if len(parts) > 1 else None


def _points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per word to look for and given name it leaves: the written-out words, or the first initial where none is written out.
    kind: `&` an organisation, `?` no word left, `+` two words joined, else 1 for the first word left, 2 where the name is one word and
    at most two more, 0 for the others."""
    for pdf in batches:
        rows = []
        for t in pdf["name"]:
            n = Name(t)
            for w, rest in n.points():
                if n.org or not rest:
                    rows.append((t, w, "*", "&" if n.org else "?", None, None))
                    continue
                whole = [x for x in rest if len(x) > 1]
                first = "2" if rest == n.words[1:] and len(rest) <= 2 and w == n.words[0] else "1"
                entries = [(x, first if x is rest[0] else "0") for x in whole or rest[:1]] + [(x + y, "+") for x, y in zip(whole, whole[1:])]
                if whole and first == "2" and whole[0] is not rest[0]:
                    entries.append((rest[0], "3"))
                rows += [(t, w, g, kind, sorted(full_forms(g)) or None, short_forms(g) or None) for g, kind in entries]
        yield pd.DataFrame(rows, columns=["name", "word", "given", "kind", "full", "short"])


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for t in pdf["name"]:
            n = Name(t)
            given = ("&" + "".join(w[0] for w in n.words[1:2]) if n.org else n.words[0]) if n.words else ""
            rows += [(t, w, given, (sorted(full_forms(given)) or None) if not n.org else None, (short_forms(given) or None) if not n.org else n.words[1:]) for w in n.keys() if w]
        yield pd.DataFrame(rows, columns=["name", "word", "c_given", "c_full", "c_short"])


_POINTS = "name string, word string, given string, kind string, full array<string>, short array<string>"
_KEYS = "name string, word string, c_given string, c_full array<string>, c_short array<string>"


def _near(a: str, b: str, most: int) -> str:
    return f"levenshtein({a}, {b}, {most}) between 0 and {most}"


#: SQL of names.same_given over (given, full, short) and (c_given, c_full, c_short): the forms a word may stand for, and those that
#: may stand for it.
SAME_GIVEN = f"""case when given = c_given then 1.0
 when length(given) = 1 or length(c_given) = 1 then if(substring(given, 1, 1) = substring(c_given, 1, 1), 0.5, 0.0)
 when greatest(length(given), length(c_given)) > {LONGEST} then 0.0
 when coalesce(array_contains(full, c_given), false) or coalesce(array_contains(c_full, given), false) or coalesce(arrays_overlap(full, c_full), false) then 0.9
 when concat(given, 'a') = c_given or concat(c_given, 'a') = given then {KIN}
 when {_near('given', 'c_given', 1)} then 0.8
 when least(length(given), length(c_given)) > 3 and {_near('given', 'c_given', 2)} and (least(length(given), length(c_given)) >= 6 or array_sort(split(given, '')) = array_sort(split(c_given, ''))) then 0.8
 when coalesce(exists(full, x -> {_near('x', 'c_given', 1)}), false) or coalesce(exists(c_full, x -> {_near('x', 'given', 1)}), false) then 0.7
 when (length(given) > 3 and coalesce(exists(c_short, x -> {_near('x', 'given', 1)}), false)) or (length(c_given) > 3 and coalesce(exists(short, x -> {_near('x', 'c_given', 1)}), false)) then 0.7
 else 0.0 end"""
#: SQL of names.agreement for one given name of a staged name that was looked for by the word q.
AGREEMENT = f"""case when c_given like '&%' then case when kind in ('&', '?') then 1.0
   when kind in ('2', '3') and substring(given, 1, 1) = substring(c_given, 2, 1) and not exists(c_short, x -> x = q) then 0.6 else 0.0 end
 when kind in ('&', '?', '3') then 0.0
 else get(transform(array({SAME_GIVEN}), s -> case when kind = '+' then s - 0.05
   when s = 0 and kind in ('1', '2') and length(given) between 5 and {LONGEST} and length(c_given) > 4 and levenshtein(substring(given, 1, length(given) - 1), c_given, 1) between 0 and 1 then 0.7 else s end), 0) end"""


def name_pairs(staged: DataFrame, golden: DataFrame) -> DataFrame:
    """(sname, cname, given, gap) of distinct spellings that can mean the same one; both frames have distinct texts `name`.

    gap counts a swap of letters as one edit; given is the agreement of the given names. The filed side is joined to the near words
    first: it is the smaller one, so that what meets the many staged words is judged at once and never shuffled unjudged."""
    points, filed = cut(staged.mapInPandas(_points, _POINTS)), cut(golden.mapInPandas(_keys, _KEYS))
    near = metric.radius_join(filed.select("word").distinct(), points.select("word").distinct())
    filed, points = filed.withColumnsRenamed({"name": "cname", "word": "f"}), points.withColumnsRenamed({"name": "sname", "word": "q"})
    gap = F.expr("case when gap = 2 and length(q) = length(f) and array_sort(split(q, '')) = array_sort(split(f, '')) then 1 else gap end")
    met = near.withColumn("gap", gap).join(filed, "f").drop("f")
    agreed = points.join(met, "q").select("sname", "cname", F.expr(AGREEMENT).cast("double").alias("given"), "gap").filter("given > 0")
    best = agreed.groupBy("sname", "cname").agg(F.max(F.struct("given", (-F.col("gap")).alias("near"))).alias("b"))
    return best.select("sname", "cname", "b.given", (-F.col("b.near")).alias("gap"))


def row_keys(df: DataFrame, row_id: str, columns: dict[str, str]) -> DataFrame:
    """(row_id, key) of canonical keys; shared mailboxes give none. columns: key kind -> column."""
    keyed = df.select(F.col(row_id).alias("row_id"), *[F.expr(K.KEY_BUILDERS[kind](column)).alias("k_" + kind) for kind, column in columns.items()])
    k = {kind: f"case when not {K.is_role_email('k_email')} then k_email end" if kind == "email" else "k_" + kind for kind in columns}
    return keyed.select("row_id", F.explode(F.array(*[F.expr(f"concat('{kind}:', {e})") for kind, e in k.items()])).alias("key")).filter("key is not null").distinct()


KEY_COLUMNS = {"email": "email", "phone": "phone", "linkedin_url": "linkedin_url", "handle": "handle"}


#: Evidence that a pair of names means one person: the terms of a log-odds score and their weights before any labelled pair is seen.
EVIDENCE = {
    "1": -1.9, "given": 4.4, "cast(given <= 0.15 as int)": -5.0, "cast(gap = 1 as int)": -0.7, "cast(gap = 2 as int)": -2.7, "cast(coalesce(company_same, false) as int)": 2.5, "cast(not coalesce(company_same, true) as int)": -0.8,
    "cast(coalesce(place_same, false) as int)": 0.8, "cast(coalesce(domain_same, false) as int)": 2.0, "cast(conflict as int)": -2.0,
}
#: What a key adds that only this contact holds.
SHARED = 8.0
#: Labelled pairs the weights above count for.
PRIOR_PAIRS = 50
#: What all labelled false pairs weigh at most, as a part of the true ones. A row has one contact however large the tables are, but the
#: more contacts, the more false ones are like it: unweighted they would outvote the true pairs and raise the bar with the size.
FALSE_SHARE = 1 / 15


def fit_evidence(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Logistic regression by Newton steps over rows that occur n times, held to the prior weights as strongly as PRIOR_PAIRS undecided
    pairs would."""
    w = prior.copy()
    hold = np.eye(len(w)) * PRIOR_PAIRS / 4

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (w - prior) @ hold @ (w - prior) / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + hold, x.T @ (n * (p - y)) + hold @ (w - prior))
        # a full step may overshoot: halve it until the loss falls
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if then >= now:
            break
        w, now = w - step, then
    return w


def balanced(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts n of labelled pairs with the false ones scaled down to FALSE_SHARE of the true ones, where they are more."""
    true, false = (n * y).sum(), (n * (1 - y)).sum()
    return np.where(y > 0, n, n * min(1.0, FALSE_SHARE * true / false)) if true and false else n


def place_core(text: str | None) -> str | None:
    """Last word before the first comma of a folded place."""
    words = re.findall("[a-z]+", folded(text).partition(",")[0]) if text and text.strip().lower() not in K.PLACEHOLDERS else []
    return words[-1] if words else None


def _read(*fields: str):
    """Cores of company, place and mail domain, once per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in fields:
                core = {"company": company_core, "place": place_core, "domain": domain_core}[f.rsplit("_", 1)[-1]]
                pdf[f] = [core(v) if isinstance(v, str) else None for v in pdf[f]]
            yield pdf

    return run


def _company(a: str, b: str) -> str:
    return f"({a} = {b} or (least(length({a}), length({b})) >= 5 and {_near(a, b, 2)}) or (least(length({a}), length({b})) >= 6 and (startswith({a}, {b}) or startswith({b}, {a}))))"


def link_variants(staging: DataFrame, contacts: DataFrame, identities: DataFrame, use_keys: bool = True, least: float = 0.0, margin: float = 0.5) -> DataFrame:
    """(staging_id, contact_id, logit, same): the contact each named staging row means, where one is clear; same: spelled alike.

    Blank names link to nothing; equal spellings are linked too (the caller may leave them out). A row that two contacts fit equally
    well is left open. Repeated rows and names are compared once per distinct spelling. Company, place, mail domain and keys are
    evidence on a candidate that the name join found, never a path beside it; their weights are fitted on the candidates of rows whose
    keys lead to one contact. Contacts of one name that are equal in all that is compared stand for each other, and tie, unless a key
    leads to one of them.
    """
    named = staging.filter(f"not {K.is_blank('full_name')}")
    golden = contacts.filter(f"not {K.is_blank('full_name')}").select(F.col("id").alias("contact_id"), F.col("full_name").alias("cname"), F.col("current_company").alias("c_company"), F.col("location").alias("c_place"), F.split_part("company_domain", F.lit("."), F.lit(1)).alias("c_domain"))
    pairs = cut(name_pairs(named.select(F.col("full_name").alias("name")).distinct(), golden.select(F.col("cname").alias("name")).distinct()))
    # keys of contacts; a key that several contacts hold singles out none
    held = cut(row_keys(identities.select(F.col("contact_id").alias("id"), *KEY_COLUMNS), "id", KEY_COLUMNS).withColumnRenamed("row_id", "contact_id"))
    owners = held.groupBy("key").agg(F.min("contact_id").alias("contact_id"), F.countDistinct("contact_id").alias("n")).filter("n = 1").drop("n")
    addressed = held.filter("key like 'linkedin_url:%'").select("contact_id").distinct().withColumn("c_url", F.lit(True))
    led = cut(row_keys(named, "id", KEY_COLUMNS).join(owners, "key").select("row_id", "contact_id").distinct().withColumn("alone", F.lit(True)))
    golden = cut(golden.mapInPandas(_read("c_company", "c_place"), golden.schema).join(addressed, "contact_id", "left"))
    email = K.email_key("email")
    rows = named.select(F.col("id").alias("row_id"), F.col("full_name").alias("sname"), "company", F.col("location").alias("place"), F.expr(email).alias("domain"), (F.expr(K.linkedin_key("linkedin_url")).isNotNull()).alias("url"))
    rows = rows.mapInPandas(_read("company", "place", "domain"), rows.schema)
    told = rows.join(pairs, "sname")
    alike = ["cname", "c_company", "c_place", "c_domain", "c_url"]
    kinds, crowd = cut_counted(golden.groupBy(*alike).agg(F.min("contact_id").alias("contact_id"), F.count("*").alias("n")), most=F.max("n"))
    both = told.join(kinds, "cname")
    if (crowd["most"] or 0) > 1:
        own = led.join(golden.join(kinds.filter("n > 1").select("cname").distinct(), "cname"), "contact_id").select("row_id", *alike, "contact_id", F.lit(1).cast("long").alias("n"))
        both = both.unionByName(told.join(own, ["row_id", "cname"])).dropDuplicates(["row_id", "contact_id", "n"])
    full = both.join(led, ["row_id", "contact_id"], "left").withColumn("shared", F.coalesce("alone", F.lit(False)) & (F.col("n") == 1)).drop("alone")
    flags = {
        "company_same": F.expr(_company("company", "c_company")), "place_same": F.expr("place = c_place"), "domain_same": F.expr(f"{_near('domain', 'c_company', 1)} or domain = c_domain"),
        "conflict": F.col("url") & F.coalesce("c_url", F.lit(False)) & ~F.col("shared"), "same": F.col("sname") == F.col("cname"),
    }
    weighed = cut(full.withColumns(flags).select("row_id", "contact_id", "same", "n", "shared", *[F.expr(e).cast("double").alias(f"e{i}") for i, e in enumerate(EVIDENCE)]))
    prior = np.array(list(EVIDENCE.values()))
    one = led.groupBy("row_id").agg(F.min("contact_id").alias("owner"), F.count("*").alias("k")).filter("k = 1").drop("k")
    # the evidence takes few values, so that all labelled pairs are some hundred rows with counts
    seen = weighed.filter("n = 1").join(one, "row_id").groupBy(*[f"e{i}" for i in range(len(prior))], (F.col("contact_id") == F.col("owner")).cast("double").alias("y")).agg(F.count("*").cast("double").alias("n"))
    known = np.array(seen.collect(), dtype=float).reshape(-1, len(prior) + 2)
    weights = fit_evidence(known[:, :-2], known[:, -2], balanced(known[:, -2], known[:, -1]), prior)
    logit = sum((F.col(f"e{i}") * float(w) for i, w in enumerate(weights)), F.lit(0.0)) + F.when(F.col("shared") & F.lit(use_keys), SHARED).otherwise(0.0)
    order = Window.partitionBy("row_id").orderBy(F.desc("logit"), "contact_id")
    ranked = weighed.withColumn("logit", logit).filter(F.col("logit") > least).withColumns({"k": F.row_number().over(order), "next": F.lead("logit").over(order)})
    return ranked.filter(f"k = 1 and n = 1 and (next is null or logit - next >= {margin})").select(F.col("row_id").alias("staging_id"), "contact_id", "logit", "same")
