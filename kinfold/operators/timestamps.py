"""Mixed timestamp formats and time zones brought to one UTC form.

A value contributes likelihood under each notation that reads it. Per source the weights of the notations are estimated by
expectation-maximisation over the counts of reading sets, which are aggregated map-side, so that a source of any size is a few
dozen rows. A source's declared day order is a prior that rules the other order out; where none is declared the posterior decides,
and values whose best reading stays under `sure` are marked ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import moments

#: Sources whose bare numbers count from 2001.
EPOCH_2001_SOURCES = ("imessage",)


def _sets(epoch_2001: tuple[str, ...]):
    @F.pandas_udf("string")
    def udf(source: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(["|".join(r[0] for r in moments.readings(t, s in epoch_2001)) for s, t in zip(source, text)])

    return udf


def _em(sure: float, rounds: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source: rows (mask, n, day_first). Weights start even, with one pseudo-count each."""
        declared = pdf["day_first"].iloc[0]
        ruled_out = set() if pd.isna(declared) else {"slash_mdy" if declared else "slash_dmy"}
        sets = [[f for f in m.split("|") if f and f not in ruled_out] for m in pdf["mask"]]
        families = sorted({f for s in sets for f in s})
        weight = {f: 1 / max(1, len(families)) for f in families}
        posts: list[dict[str, float]] = []
        for _ in range(rounds):
            mass = {f: 1.0 for f in families}
            posts = []
            for s, n in zip(sets, pdf["n"]):
                total = sum(weight[f] for f in s)
                posts.append({f: weight[f] / total for f in s})
                for f, p in posts[-1].items():
                    mass[f] += p * n
            weight = {f: v / sum(mass.values()) for f, v in mass.items()}
        rows = []
        for m, post in zip(pdf["mask"], posts):
            best = max(sorted(post), key=post.get, default=None)
            p = post[best] if best else 0.0
            rows.append((pdf["source"].iloc[0], m, best, p, "unreadable" if best is None else "read" if p >= sure else "ambiguous"))
        return pd.DataFrame(rows, columns=["source", "mask", "family", "posterior", "status"])

    return fit


@lru_cache(1024)
def _choices(text: str | None) -> dict[str, str]:
    return dict(line.split("\t") for line in text.split("\n")) if text else {}


def _utc(epoch_2001: tuple[str, ...]):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, t, tz, choice in zip(pdf["source"], pdf["text"], pdf["tz"], pdf["choice"]):
                found = None
                ways = moments.readings(t, s in epoch_2001)
                best = _choices(choice if isinstance(choice, str) else None).get("|".join(w[0] for w in ways))
                for family, wall, own in ways:
                    if family == best:
                        at = own or (moments.zone(tz) if isinstance(tz, str) else None)
                        found = moments.to_utc(wall, at) if at else None
                        break
                out.append(found.strftime("%Y-%m-%dT%H:%M:%S.%fZ").rjust(27, "0") if found else None)
            yield pd.DataFrame({"row_id": pdf["row_id"], "source": pdf["source"], "occurred_utc": out})

    return read


def reading_model(df: DataFrame, feeds: DataFrame, source: str, text: str, sure: float = 0.95, rounds: int = 25, epoch_2001: tuple[str, ...] = EPOCH_2001_SOURCES) -> DataFrame:
    """(source, mask, family, posterior, status) for every source and set of readings; at most sources x notations rows."""
    counted = df.select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text")).withColumn("mask", _sets(epoch_2001)("source", "text")).groupBy("source", "mask").agg(F.count("*").alias("n"))
    told = feeds.select("source", "day_first").dropDuplicates(["source"])
    return counted.join(F.broadcast(told), "source", "left").groupBy("source").applyInPandas(_em(sure, rounds), "source string, mask string, family string, posterior double, status string")


def normalise(df: DataFrame, feeds: DataFrame, row_id: str, source: str, text: str, sure: float = 0.95, epoch_2001: tuple[str, ...] = EPOCH_2001_SOURCES) -> DataFrame:
    """(row_id, source, occurred_utc): UTC text yyyy-MM-ddTHH:mm:ss.SSSSSSZ, null where no reading is sure.

    feeds: (source, tz, day_first), one row a source, a dimension of fixed size that is broadcast. Null, empty and unreadable texts,
    unknown zones and ambiguous readings give null. Repeated rows are kept. A value is read as the posterior of its own set of readings
    in its source says; a source's sure choices, one per set of readings, form one short string.
    """
    model = reading_model(df, feeds, source, text, sure, epoch_2001=epoch_2001)
    chosen = model.filter("status = 'read'").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.concat("mask", F.lit("\t"), "family"))), "\n").alias("choice"))
    told = feeds.select("source", "tz").dropDuplicates(["source"])
    rows = df.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    ready = rows.join(F.broadcast(told), "source", "left").join(F.broadcast(chosen), "source", "left")
    return ready.select("row_id", "source", "text", "tz", "choice").mapInPandas(_utc(epoch_2001), "row_id string, source string, occurred_utc string")


def status_report(df: DataFrame, feeds: DataFrame, source: str, text: str, sure: float = 0.95) -> DataFrame:
    """(source, status, family, rows): how the values of each source were read."""
    counted = df.select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text")).withColumn("mask", _sets(EPOCH_2001_SOURCES)("source", "text")).groupBy("source", "mask").agg(F.count("*").alias("n"))
    model = reading_model(df, feeds, source, text, sure)
    return counted.join(F.broadcast(model), ["source", "mask"]).groupBy("source", "status", "family").agg(F.sum("n").alias("rows"))
