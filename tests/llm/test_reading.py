import re
from collections import Counter
from math import exp, log

import numpy as np
import pandas as pd
import pytest

from kinfold.llm import reading as R
from kinfold.session import table


def test_sentences_of_prose():
    text = "From: a@b.c\nSubject: x\n\n# Head\n* item one two\n[2026-01-02 bot] We met in St. Vashkent today. It went well!\nMore at Foo Inc. tomorrow / then home again"
    assert R.sentences(text) == ["We met in St. Vashkent today.", "It went well!", "More at Foo Inc. tomorrow", "then home again"]
    assert R.sentences("") == [] and R.sentences("🙂 ...") == []


def test_a_label_leaves_the_sentences_behind_it():
    assert R.sentences("FYI: Pursuant to the terms, we agreed. It held.\nNote: More came later.\nCc: a@b.c\nSent: on Monday") == ["Pursuant to the terms, we agreed.", "It held.", "More came later."]


@pytest.fixture(scope="module")
def model(spark, sf):
    return R.fit(table(spark, sf, "documents"), table(spark, sf, "level_samples"))


def test_held_out_levels(spark, sf):
    """Half of the samples fits, the other half is graded."""
    samples = table(spark, sf, "level_samples")
    model = R.fit(table(spark, sf, "documents"), samples.filter("sample_id % 2 = 0"))
    rows = samples.filter("sample_id % 2 = 1").collect()
    levels = [model.level(r["text"]) for r in rows]
    grades = np.array([r["grade"] for r in rows])
    got = np.array([x[2] for x in levels])
    assert np.mean([x[0] == r["lang"] for x, r in zip(levels, rows)]) > 0.98
    assert np.mean((got >= 3.5) == (grades >= 4)) > 0.95 and np.abs(got - grades).mean() < 0.5


def test_levels_of_odd_texts(spark, sf, model):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "12 34 !!"), (5, "The cat sat. " * 20_000), (6, "字" * 50), (5, "The cat sat.")], "doc_id long, text string")
    got = [(r["doc_id"], r["sentences"], r["level"]) for r in R.reading_levels(docs, table(spark, sf, "level_samples")).collect()]
    assert {g[0]: g[2] for g in got if g[0] in (1, 2, 3, 4, 6)} == dict.fromkeys((1, 2, 3, 4, 6))
    assert len(got) == 7 and any(g[1] == 20_000 for g in got)


def test_no_samples(spark, sf):
    docs = spark.createDataFrame([(1, "The cat sat.")], "doc_id long, text string")
    assert R.reading_levels(docs, table(spark, sf, "level_samples").limit(0)).first()["level"] is None


class Counted:
    """A pattern that counts the letters it is asked to search."""

    def __init__(self, pattern):
        self.pattern, self.letters = pattern, 0

    def findall(self, text):
        self.letters += len(text)
        return self.pattern.findall(text)


def test_words_are_found_once_per_distinct_token(spark, sf, model, monkeypatch):
    text = "The cat sat on the mat. It was, as they said, well-known. " * 2_000
    words = Counted(R._WORD)
    monkeypatch.setattr(R, "_WORD", words)
    assert model.level(text)[1] == 4_000
    counts = pd.concat(R._count(model.languages)(iter([pd.DataFrame({"text": [text, text]})]))).groupby("word")["n"].sum()
    assert counts["the"] == counts["well"] == counts["known"] == counts[""] == 2
    assert words.letters < 1_000


def plain_levels(model, text):
    """What Model.levels says, sentence by sentence and word by word."""
    found = []
    for line in re.split(r"\n+|[ \t]/[ \t]", R._LABEL.sub("", R._NOT_PROSE.sub("", R._STAMP.sub("", text)))):
        start = 0
        for m in re.finditer(r"[.!?…]+[\"”»)]*\s+", line):
            if m.group().strip() != "." or not R._ABBREVIATION.search(line[max(0, m.start() - 12) : m.start() + 1]):
                found.append(R._WORD.findall(line[start : m.end()]))
                start = m.end()
        found.append(R._WORD.findall(line[start:]))
    found = [words for words in found if len(words) > 1]
    seen = Counter(w.lower() for words in found for w in words)
    known = [w for w in seen if w in model.languages.scores]
    totals = [sum(model.languages.scores[w][i] * seen[w] for w in known) for i in range(len(model.languages.names))]
    lang = model.languages.names[totals.index(max(totals))] if known else None
    if lang is None:
        return lang, len(found), None, None, None
    familiar = model.familiar.get(lang, set())
    counted = [w for words in found for i, w in enumerate(words) if w.lower() in familiar or i == 0 or lang in R.CAPITAL_NOUNS or not w[0].isupper()]
    odd = [w for w in counted if w.lower() not in familiar]
    x = [1.0, sum(map(len, odd)) / max(len(counted), 1), (sum(map(len, counted)) - sum(map(len, odd))) / max(len(counted), 1), log(1 + sum(map(len, found)) / len(found))]
    return lang, len(found), float(min(5.0, max(1.0, np.dot(model.constants[lang], x)))), len(odd) / max(len(counted), 1), exp(x[3]) - 1


def test_levels_are_those_of_the_plain_reading(spark, sf, model, monkeypatch):
    bits = ["The", "cat", "sat", "St.", "(Dr.", "S.A.", "A.", "No!", "…", 'what?!"', "end.)", "/", "\t/ ", "\n", "\n- ", "\n# ", "FYI: ", "\nFrom: a", "\n[2026-01-02 bot] ", "İstanbul", "ΟΔΟΣ.", "l’été", "don't", "well-known", "字", "🙂", "\r", "\x1c", "1)", ".", "x/y", "Straße", "und", "der", "el", "le", "É.", "_a_", "\x00"]
    pick = np.random.default_rng(7)
    texts = ["".join(bits[i] + " " * j for i, j in zip(pick.integers(0, len(bits), n), pick.integers(0, 3, n))) for n in pick.integers(0, 60, 3_000)]
    texts += [r["text"] for r in table(spark, sf, "documents").filter("text is not null").select("text").collect()]
    expected = [plain_levels(model, t) for t in texts]
    assert model.levels(texts, model.tokens()) == expected
    monkeypatch.setattr(R, "CHUNK", 50)
    monkeypatch.setattr(R, "REMEMBERED", 2_000)
    assert model.levels(texts, model.tokens()) == expected


def test_document_counts_of_words(spark, sf, model, monkeypatch):
    """The same whether counts are passed on and tokens forgotten in between or not; a word is counted once a document."""
    texts = [r["text"] for r in table(spark, sf, "documents").filter("text is not null").select("text").collect()] + ["the well-known, well known the.", "", "\x00 🙂"]
    docs, expected = Counter(), Counter()
    for t in texts:
        seen = Counter(R._WORD.findall(t.lower()))
        known = [w for w in seen if w in model.languages.scores]
        if known:
            totals = [sum(model.languages.scores[w][i] * seen[w] for w in known) for i in range(len(model.languages.names))]
            lang = model.languages.names[totals.index(max(totals))]
            docs[lang] += 1
            expected.update((lang, w) for w in seen)
    expected.update({(lang, ""): n for lang, n in docs.items()})
    for chunk, remembered in ((R.CHUNK, R.REMEMBERED), (50, 2_000)):
        monkeypatch.setattr(R, "CHUNK", chunk)
        monkeypatch.setattr(R, "REMEMBERED", remembered)
        got = pd.concat(R._count(model.languages)(iter([pd.DataFrame({"text": texts[:100]}), pd.DataFrame({"text": texts[100:]})]))).groupby(["lang", "word"])["n"].sum().to_dict()
        assert got == dict(expected)
