"""Reading level of each document by a familiar-word formula.

A word is familiar when it occurs in at least `share` of the corpus documents of its language. The level is linear in the letters of
unfamiliar words per word (their share, each weighted by its length), the letters of familiar words per word, and the logarithm of
the average sentence length. The constants are fitted per language on the graded samples, a fixed table of a few hundred rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import cut

#: A familiar word occurs in this share of a language's documents; at most (mean distinct words of a document) / share words can.
SHARE = 0.1
#: The corpus words one worker counts before it passes its counts on.
FLUSH = 200_000
#: Tokens and texts that are summed at once, and the letters of tokens a worker remembers; both are looked at between texts.
CHUNK, REMEMBERED = 1 << 17, 1 << 23
#: Labelled rows the fit may use; the samples are a fixed table far below it.
MOST_SAMPLES = 20_000

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# Abbreviations after which a full stop ends no sentence.
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:St|Inc|Ltd|Co|S\.A|G\.m\.b\.H|Dr|Mr|Mrs|Ms|Prof|Sr|Sra|Mme|[A-Z])\.$")
_STAMP = re.compile(r"^[ \t]*\[[^\]\n]{3,60}\][ \t]*", re.M)
_NOT_PROSE = re.compile(r"^[ \t]*(?:[#>*•|]+|-{1,3}|\d{1,2}[.)])[ \t].*$|^(?:From|To|Cc|Subject|Date|Sent):[ \t].*$", re.M)
_LABEL = re.compile(r"^[A-Z][\w-]{1,12}:[ \t]+", re.M)
_SLASH = re.compile(r"[ \t]/[ \t]")
_TOKEN = re.compile(r"\S+")
_STOP = re.compile(r"[.!?…]+[\"”»)]*$")


def running(text: str) -> list[str]:
    """The lines of the running text: stamps, headings, list items, mail headers and quoted lines are left out. Of a line with another
    label ("FYI: ...") only the label is left out."""
    if "[" in text:
        text = _STAMP.sub("", text)
    text = _NOT_PROSE.sub("", text)
    if ":" in text:
        text = _LABEL.sub("", text)
    lines = text.split("\n")
    return [part for line in lines for part in (_SLASH.split(line) if "/" in line else (line,))] if "/" in text else lines


def stops(token: str) -> bool:
    """Whether a sentence ends with this piece of text between white space."""
    m = _STOP.search(token)
    return bool(m) and not (m.group() == "." and _ABBREVIATION.search(token))


def sentences(text: str) -> list[str]:
    """The sentences of the running text, without pieces of fewer than two words."""
    out = []
    for line in running(text):
        start = 0
        for m in _TOKEN.finditer(line):
            if stops(m.group()):
                out.append(line[start : m.end()])
                start = m.end()
        out.append(line[start:])
    return [s.strip() for s in out if len(_WORD.findall(s)) > 1]


class Languages:
    """Which of the sample languages a text is in, by the document frequencies of the samples' words."""

    def __init__(self, samples: list[tuple[str, str]]):
        counts: dict[str, Counter] = defaultdict(Counter)
        size: Counter = Counter()
        for lang, text in samples:
            size[lang] += 1
            counts[lang].update({w.lower() for w in _WORD.findall(text)})
        words = {w for c in counts.values() for w in c}
        self.names = sorted(counts)
        # whole numbers, so that sums do not depend on the order of the words
        self.scores = {w: [round(log((counts[n][w] + 0.1) / (size[n] + 0.2)) * (1 << 32)) for n in self.names] for w in words}

    def evidence(self, words: Iterable[str]) -> list[int]:
        """The words that are in any sample, and the sum of their scores per language."""
        known = [s for s in map(self.scores.get, words) if s]
        return [len(known), *(sum(s[i] for s in known) for i in range(len(self.names)))]

    def best(self, evidence: np.ndarray) -> np.ndarray:
        """The place of the language in names per row of summed evidence; -1 for a text without a word of any sample."""
        return np.where(evidence[:, 0] > 0, evidence[:, 1:].argmax(1), -1) if self.names else np.full(len(evidence), -1)


class Tokens(dict):
    """Numbers of tokens, the pieces of text between white space. What has to be known of a token is worked out once for each distinct
    one, as a row of whole numbers, and only looked up where it occurs; no word crosses white space."""

    def __init__(self, width: int):
        self.letters, self.size, self.fresh, self.table = 0, 0, [], np.zeros((1024, width), dtype=np.int64)

    def add(self, row: list[int]) -> int:
        self.fresh.append(row)
        return self.size + len(self.fresh) - 1

    def rows(self) -> np.ndarray:
        if self.fresh:
            end = self.size + len(self.fresh)
            if end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(end, 2 * len(self.table)) - len(self.table), self.table.shape[1]), dtype=np.int64)])
            self.table[self.size : end] = self.fresh
            self.size, self.fresh = end, []
        return self.table

    def forget(self) -> None:
        self.clear()
        self.letters, self.size, self.fresh = 0, 0, []


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of whole numbers between neighbouring bounds; empty stretches give 0."""
    run = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


class Written(Tokens):
    """Tokens as written. Row: words, whether a sentence ends here, evidence of the languages, then per language: words that count,
    unfamiliar ones of them, letters of familiar and of unfamiliar words, and the letters of the first word if it counts at the
    beginning of a sentence only. Capitalised words inside a sentence are names, known to a reader, unless the language writes nouns so;
    they count for the sentence length only."""

    def __init__(self, languages: Languages, familiar: dict[str, set[str]]):
        self.languages, self.sets = languages, [familiar.get(n, set()) for n in languages.names]
        self.nouns = ["\0nouns" in s for s in self.sets]
        self.start = 3 + len(languages.names)
        super().__init__(self.start + 5 * len(self.sets))

    def __missing__(self, token: str) -> int:
        self.letters += len(token) + 64
        n = self[token] = self.add(self.row(token))
        return n

    def row(self, token: str) -> list[int]:
        words = _WORD.findall(token)
        low = [w.lower() for w in words]
        out = [len(words), stops(token), *self.languages.evidence(low)]
        for familiar, nouns in zip(self.sets, self.nouns):
            counted = odd = known = strange = first = 0
            for i, (w, v) in enumerate(zip(words, low)):
                if v in familiar:
                    counted += 1
                    known += len(w)
                elif nouns or not w[0].isupper():
                    counted += 1
                    odd += 1
                    strange += len(w)
                elif i == 0:
                    first = len(w)
            out += counted, odd, known, strange, first
        return out

    def features(self, texts: list[str | None], langs: list[str] | None = None) -> list[tuple]:
        """(language of the prose, or the given one, its sentences, unfamiliar letters a word, familiar letters a word, log of words a
        sentence, share of unfamiliar words) of each text."""
        out: list[tuple] = []
        ids: list[int] = []
        lines: list[int] = []
        ends = [0]

        def done() -> None:
            given = None if langs is None else np.array([self.languages.names.index(x) for x in langs[len(out) : len(out) + len(ends) - 1]], dtype=np.int64)
            out.extend(self._chunk(np.array(ids, dtype=np.int64), np.array(lines, dtype=np.int64), np.array(ends), given))
            ids.clear(), lines.clear()
            ends[:] = [0]
            if self.letters > REMEMBERED:
                self.forget()

        for text in texts:
            for line in running(text) if isinstance(text, str) else ():
                if tokens := line.split():
                    lines.append(len(ids))
                    ids.extend(map(self.__getitem__, tokens))
            ends.append(len(ids))
            if len(ids) + len(ends) > CHUNK:
                done()
        done()
        return out

    def _chunk(self, ids: np.ndarray, lines: np.ndarray, ends: np.ndarray, given: np.ndarray | None) -> Iterator[tuple]:
        table = self.rows()
        words = table[ids, 0]
        begins = np.zeros(len(ids), dtype=bool)
        begins[1:] = table[ids[:-1], 1] > 0
        begins[lines] = True
        starts = np.flatnonzero(begins)
        long = _sums(words, np.append(starts, len(ids))) > 1
        sentence = np.cumsum(begins) - 1
        kept = long[sentence]
        ids, words, sentence, ends = ids[kept], words[kept], sentence[kept], np.append(0, np.cumsum(kept))[ends]
        counts = _sums(np.diff(sentence, prepend=-1) != 0, ends)
        best = self.languages.best(np.stack([_sums(table[ids, i], ends) for i in range(2, self.start)], 1)) if given is None else given
        column = self.start + 5 * np.repeat(np.maximum(best, 0), np.diff(ends)) if self.sets else None
        parts = [table[ids, column + i] if self.sets else np.zeros(len(ids), dtype=np.int64) for i in range(5)]
        spoken = np.flatnonzero(words)
        head = spoken[np.diff(sentence[spoken], prepend=-1) != 0]
        first = parts.pop()[head]
        parts[0][head] += first > 0
        parts[1][head] += first > 0
        parts[3][head] += first
        for lang, n, total, counted, odd, known, strange in zip(best.tolist(), counts.tolist(), _sums(words, ends).tolist(), *(_sums(x, ends).tolist() for x in parts)):
            counted = max(counted, 1)
            yield self.languages.names[lang] if lang >= 0 else None, n, strange / counted, known / counted, log(1 + total / max(n, 1)), odd / counted


#: Languages that write every noun with a capital letter.
CAPITAL_NOUNS = ("de",)


class Model:
    def __init__(self, languages: Languages, familiar: dict[str, set[str]], constants: dict[str, np.ndarray]):
        self.languages, self.familiar, self.constants = languages, familiar, constants

    def tokens(self) -> Written:
        """What is remembered from text to text."""
        return Written(self.languages, self.familiar)

    def levels(self, texts: list[str | None], tokens: Written) -> list[tuple[str | None, int, float | None, float | None, float | None]]:
        """(language of the prose, its sentences, level from 1 to 5, share of unfamiliar words, words a sentence) of each text; no
        figures without a sentence or a language."""
        out = []
        for lang, n, *x, share in tokens.features(texts):
            if n and lang in self.constants:
                out.append((lang, n, float(min(5.0, max(1.0, np.dot(self.constants[lang], [1.0, *x])))), share, exp(x[2]) - 1))
            else:
                out.append((lang, n, None, None, None))
        return out

    def level(self, text: str) -> tuple[str | None, int, float | None, float | None, float | None]:
        return self.levels([text], self.tokens())[0]


class Lowered(Tokens):
    """Tokens in lower case; those of the same words have one number. Row: evidence of the languages."""

    def __init__(self, languages: Languages):
        self.languages = languages
        super().__init__(1 + len(languages.names))
        self.forget()

    def __missing__(self, token: str) -> int:
        self.letters += len(token) + 64
        words = tuple(_WORD.findall(token))
        n = self.numbers.get(words)
        if n is None:
            n = self.numbers[words] = self.add(self.languages.evidence(words))
            self.words.append(words[0] if len(words) == 1 else None)
            if len(words) != 1:
                self.apart[n] = words
        self[token] = n
        return n

    def forget(self) -> None:
        super().forget()
        self.numbers: dict[tuple[str, ...], int] = {}
        self.words: list[str | None] = []
        self.apart: dict[int, tuple[str, ...]] = {}


def _count(languages: Languages):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Lowered(languages)
        held: list[Counter] = [Counter() for _ in languages.names]
        docs = [0] * len(languages.names)
        ids: list[int] = []
        ends = [0]

        def chunk() -> None:
            if not languages.names:
                return
            table, at, bounds = tokens.rows(), np.array(ids, dtype=np.int64), np.array(ends)
            best = languages.best(np.stack([_sums(table[at, i], bounds) for i in range(table.shape[1])], 1))
            for lang, a, b in zip(best.tolist(), ends, ends[1:]):
                if lang >= 0:
                    found = set(ids[a:b])
                    for n in found & tokens.apart.keys():
                        found.discard(n)
                        found.update(map(tokens.__getitem__, tokens.apart[n]))
                    docs[lang] += 1
                    held[lang].update(found)

        def out() -> pd.DataFrame:
            rows = [(name, tokens.words[w], n) for name, c in zip(languages.names, held) for w, n in c.items()]
            return pd.DataFrame(rows + [(name, "", n) for name, n in zip(languages.names, docs) if n], columns=["lang", "word", "n"])

        def clear() -> None:
            for c in held:
                c.clear()
            docs[:] = [0] * len(docs)

        for pdf in batches:
            for text in pdf["text"]:
                ids.extend(map(tokens.__getitem__, text.lower().split()))
                ends.append(len(ids))
                if len(ids) + len(ends) > CHUNK:
                    chunk()
                    ids.clear()
                    ends[:] = [0]
                    if sum(map(len, held)) > FLUSH or tokens.letters > REMEMBERED:
                        yield out()
                        clear()
                        tokens.forget()
        chunk()
        yield out()

    return run


def familiar_words(docs: DataFrame, text: str, languages: Languages, share: float = SHARE) -> dict[str, set[str]]:
    """Per language the words in at least `share` of its documents, counted over all documents. Workers count per batch, so what is
    shuffled is words, not occurrences; the result is bounded by the mean distinct words of a document divided by `share`."""
    counts = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(_count(languages), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    totals = F.broadcast(counts.filter("word = ''").select("lang", F.col("n").alias("docs")))
    found: dict[str, set[str]] = defaultdict(set)
    for lang, word in counts.filter("word <> ''").join(totals, "lang").filter(F.col("n") >= F.col("docs") * share).select("lang", "word").collect():
        found[lang].add(word)
    for lang in CAPITAL_NOUNS:
        found[lang].add("\0nouns")
    return dict(found)


def fit(docs: DataFrame, samples: DataFrame, text: str = "text", share: float = SHARE) -> Model:
    rows = [(r["lang"], int(r["grade"]), r["text"]) for r in samples.filter("text is not null and grade is not null and lang is not null").orderBy(F.xxhash64("lang", "grade", "text"), "text").limit(MOST_SAMPLES).collect()]
    languages = Languages([(lang, t) for lang, _, t in rows])
    familiar = familiar_words(docs, text, languages, share)
    tokens = Written(languages, familiar)
    constants = {}
    for lang in languages.names:
        x = np.array([[1.0, *f[2:5]] for f in tokens.features([t for l, _, t in rows if l == lang], [lang] * len(rows))])
        y = np.array([g for l, g, _ in rows if l == lang], dtype=float)
        constants[lang] = np.linalg.solve(x.T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ y)
    return Model(languages, familiar, constants)


def reading_levels(docs: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, lang, sentences, level, unfamiliar, sentence_words) of every row; the last two are the parts of the plain formula. Null, empty and wordless texts have no level; the given language is not used,
    as it is often wrong or missing. Repeated rows are kept; empty samples give no level to any row."""
    model = fit(docs, samples, text, share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = model.tokens()
        for pdf in batches:
            rows = [(d, *x) for d, x in zip(pdf["doc_id"], model.levels(pdf["text"].tolist(), tokens))]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "sentences", "level", "unfamiliar", "sentence_words"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, lang string, sentences int, level double, unfamiliar double, sentence_words double")
