"""Parsing and comparing names typed by people: one folded form, given and family parts, and a true edit metric."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts that look like Latin ones, stroked letters, and digits typed for letters.
LOOKALIKES = str.maketrans("асеіјорѕхуукмтвнԁԛԝαεορτυνικ", "aceijopsxyykmtbhdqwaeoptuvik")
STROKES = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"})
DIGITS = str.maketrans("013457", "oleast")
# Words that are no part of a name.
TITLES = frozenset("dr prof professor mr mrs ms mx miss sir dame hon rev fr herr frau sr sra dipl ing phd ph mba md msc bsc ma ba cpa esq jr junior senior ii iii iv pmp cfa jd dds rn hiring".split())
PARTICLES = frozenset("de la van von der den del di da dos das du le el al bin ibn ter ten".split())
LEGAL_FORMS = frozenset("inc incorporated ltd limited llc gmbh ag sa co company corp corporation plc bv srl spa oy ab kg".split())
ORGANISATION_WORDS = frozenset("group grp capital health labs lab studio studios systems robotics partners energy foods biotech analytics logistics technologies tech media bank holdings ventures consulting solutions software services university institute foundation".split())
# Short forms of given names, by the full forms they may stand for.
NICKNAMES = {
    "alexander": "alex sasha sascha xander lex al sandro", "alexandra": "alex sasha sandra lexi alexa", "abigail": "abby abbie gail", "anthony": "tony ant toni", "andrew": "andy drew", "augustine": "gus august augie", "benjamin": "ben benny benji", "bogdan": "bodya dan",
    "charles": "charlie chuck chas chaz", "christopher": "chris kit topher", "christine": "chris tina", "daniel": "dan danny", "deborah": "deb debbie debby", "dmitri": "dima mitya", "dolores": "lola loli", "edward": "ed eddie ted ned teddy", "ekaterina": "katya kate katia", "elena": "lena", "elizabeth": "liz beth lizzie betty eliza lisa libby bess liza",
    "francisco": "paco pancho fran kiko curro cisco", "frederick": "fred freddie rick", "friederike": "fritzi rike friedel", "gabriella": "gabi gaby ella gabby", "gabriel": "gabe gabi", "giuseppe": "beppe peppe pino", "guillermo": "memo guille", "gregory": "greg", "hans": "hansi", "henry": "harry hank hal", "irina": "ira", "isabella": "bella isa", "ivan": "vanya", "ileana": "ilie", "ioana": "nana",
    "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "joan": "joanie jo", "johannes": "hans hannes jo johan", "john": "jack johnny jon", "jonathan": "jon jonny john", "joseph": "joe joey jo", "jose": "pepe", "jurgen": "jogi", "katherine": "kate kathy katie kat kay kitty cathy", "kathrin": "kathi", "karl": "kalle", "leonardo": "leo leon nardo", "ludmila": "mila luda", "magdalena": "lena magda", "malgorzata": "gosia malgosia", "margaret": "maggie meg peggy marge rita greta", "maria": "mia masha mary", "mateus": "teo", "matthew": "matt", "maximilian": "max maxi", "michael": "mike mick mickey micky", "mikhail": "misha mischa", "mohammed": "mo mohamed muhammad", "muhammad": "mo mohammed mohamed",
    "natalia": "natasha nata", "nicholas": "nick nicky nico niko", "olga": "olya", "oscar": "ozzie", "patricia": "pat patty trish tricia patsy", "patrick": "pat paddy", "pavel": "pasha", "peter": "pete", "philip": "phil pip", "phillip": "phil pip", "philippa": "pippa pip", "rebecca": "becky becca bex", "richard": "rick dick rich richie ricky", "robert": "bob rob bobby robbie bert", "samantha": "sam sammy", "samuel": "sam sammy", "sergei": "seryozha serge", "sofia": "sofie sophie", "stephen": "steve steph stevie", "steven": "steve stevie", "susannah": "sue susie suzy susan zannah", "tamara": "toma tammy", "theodore": "ted teddy theo", "thomas": "tom tommy", "victoria": "vicky vicki tori vic", "vladimir": "vova volodya", "wilhelm": "willi", "william": "bill billy will willy liam", "zsuzsanna": "zsuzsa zsuzsi", "zoe": "zo",
}
_SHORT: dict[str, set[str]] = {}
for _full, _forms in NICKNAMES.items():
    for _s in _forms.split():
        _SHORT.setdefault(_s, set()).add(_full)

_BRACKETS = re.compile(r"\([^)]*\)?|\[[^\]]*\]?|<[^>]*>?|\{[^}]*\}?")
_AFTER = re.compile(r"\s+(?:[-–—|/•·@]|at\b|bei\b|chez\b)\s.*$|\s*@.*$|\s*[|•·].*$")
_AFTER_MARKS = ("-", "–", "—", "|", "/", "•", "·", "@", "at", "bei", "chez")
_BEFORE = re.compile(r"^[^:]{2,60}:\s+")
_DOTTED = re.compile(r"\b(?:[a-z]\.\s?){2,}(?:[a-z]\b\.?)?")
_WORDS = re.compile(r"[a-z]+(?:['’`´\-‐‑][a-z]+)*")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])")
_REPAIR = re.compile("[Â-Åâ-å][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]")
#: Longer words are compared for equality only.
LONGEST = 64


def _read_again(m: re.Match) -> str:
    """Two characters that are the bytes of one letter, read once more as UTF-8."""
    pair = m.group()[0].upper() + m.group()[1]
    for code in ("cp1252", "latin-1"):
        try:
            return pair.encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return m.group()


_ANY_DIGIT = re.compile("[013457]")
_TYPED_DIGITS = re.compile("(?<=[a-z])[013457]+|[013457]+(?=[a-z])")


@lru_cache(65536)
def folded(text: str) -> str:
    """Lower case without accents, look-alike letters and digits typed for letters; doubly encoded text is read once more."""
    if text.isascii():
        low = text.replace("_", " ").lower()
        return _TYPED_DIGITS.sub(lambda m: m.group().translate(DIGITS), low) if _ANY_DIGIT.search(low) else low
    text = _REPAIR.sub(_read_again, text)
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).replace("_", " "))
    text = "".join(c for c in text if not unicodedata.combining(c))
    low = text.lower().translate(STROKES).translate(LOOKALIKES)
    return _TYPED_DIGITS.sub(lambda m: m.group().translate(DIGITS), low)


class Name:
    """given: given-name words; family: family-name words, particles left out; org: the core word of an organisation, or None."""

    __slots__ = ("words", "parts", "given", "family", "org", "comma")

    def __init__(self, text: str):
        raw = unicodedata.normalize("NFC", text).strip()
        if " " not in raw and "_" not in raw and "." not in raw and "-" not in raw:
            raw = _CAMEL.sub(" ", raw)
        s = folded(raw)
        # most names have none of the marks that the patterns look for
        if any(c in s for c in "([<{"):
            s = _BRACKETS.sub(" ", s)
        if ":" in s:
            s = _BEFORE.sub("", s)
        if any(c in s for c in _AFTER_MARKS):
            s = _AFTER.sub("", s)
        if "." in s:
            s = _DOTTED.sub(lambda m: m.group().replace(".", "").replace(" ", "") + " " if m.group().replace(".", "").replace(" ", "") in LEGAL_FORMS else m.group(), s)
        head, comma, tail = s.partition(",")
        parts = [[w for w in _WORDS.findall(x.replace(".", " "))] for x in (head, tail)]
        parts = [[w for w in x if w not in TITLES] for x in parts]
        self.comma = bool(comma and parts[1] and parts[0]) and not all(w in LEGAL_FORMS or w in ORGANISATION_WORDS for w in parts[1])
        words = parts[1] + parts[0] if self.comma else parts[0] + parts[1]
        flat = [w for x in words for w in (x,)]
        self.org = None
        if len(flat) > 1 and (any(w in LEGAL_FORMS for w in flat[1:]) or flat[-1] in ORGANISATION_WORDS):
            core = [w for w in flat if w not in LEGAL_FORMS and w != "the"]
            self.org = _join(core[0]) if core else None
        kept = [w for w in flat if w not in PARTICLES or len(flat) == 1]
        self.words = [_join(w) for w in kept]
        self.parts = [[_join(x) for x in re.split("[^a-z]+", w)] for w in kept]
        self.given = self.words[:1]
        self.family = self.words[1:]

    def points(self) -> list[tuple[str, list[str]]]:
        """(string to look for among family keys, the words it leaves for given names): every word and every part of a hyphened word.
        An organisation has its core word only."""
        if self.org:
            return [(self.org, [])]
        out: dict[str, list[str]] = {}
        for i, w in enumerate(self.words):
            rest = self.words[:i] + self.words[i + 1 :]
            for x in (w, *(self.parts[i] if len(self.parts[i]) > 1 else ())):
                if len(x) >= 2:
                    out.setdefault(x, rest)
        return list(out.items())

    def keys(self) -> list[str]:
        """The strings by which a record is filed: the organisation's core, or all family words joined and, for names of several
        parts, each longer part; a lone word stands for itself."""
        if self.org:
            return [self.org]
        long = [w for w in self.family if len(w) > 1]
        if not long:
            return self.words[:1]
        parts = [x for w in self.parts[1:] for x in w if len(x) >= 4]
        return list(dict.fromkeys(["".join(long), *(parts if len(parts) > 1 else [])]))


def _join(word: str) -> str:
    return re.sub("[^a-z]", "", word)


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, a metric; most + 1 as soon as it must exceed `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        return min(len(other) - (one in other), most + 1)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0], low = row[0], i, i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
            if row[j] < low:
                low = row[j]
        if low > most:
            return most + 1
    return min(row[-1], most + 1)


#: Score of two given names that differ by a closing a only, as those of kin do.
KIN = 0.15


@lru_cache(1 << 18)
def same_given(a: str, b: str) -> float:
    """How well two given names agree: 1 equal, 0.9 short form, 0.8 typing error, 0.5 initial, KIN for
    the forms of kin, 0 no."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 0.0
    if max(len(a), len(b)) > LONGEST:
        return 0.0
    if b in _SHORT.get(a, ()) or a in _SHORT.get(b, ()) or _SHORT.get(a, frozenset()) & _SHORT.get(b, frozenset()):
        return 0.9
    if a + "a" == b or b + "a" == a:
        return KIN
    most = 1 if min(len(a), len(b)) <= 3 else 2
    d = distance(a, b, most)
    if d <= most and (d < 2 or sorted(a) == sorted(b) or min(len(a), len(b)) >= 6):
        return 0.8
    for s, full in ((a, b), (b, a)):
        for f in _SHORT.get(s, ()):
            if distance(f, full, 1) <= 1:
                return 0.7
        if any(distance(s, x, 1) <= 1 for x in NICKNAMES.get(full, "").split()) and len(s) > 3:
            return 0.7
    return 0.0


def full_forms(word: str) -> frozenset[str] | set[str]:
    return _SHORT.get(word, frozenset())


def short_forms(word: str) -> list[str]:
    return NICKNAMES.get(word, "").split()


def radius(word: str) -> int:
    """Edits allowed in a family name by its length; the longest and the shortest must be equal."""
    return 0 if len(word) > LONGEST or len(word) < 4 else 2 if len(word) >= 8 else 1


def agreement(org: bool, words: list[str], rest: list[str], c_org: bool, c_words: list[str]) -> float:
    """Score in 0..1 of a staged name and a golden one whose family parts are near: org and words of each; rest: the staged words not
    used by the family part."""
    if c_org:
        if org or not rest:
            return 1.0
        if words and rest == words[1:] and len(rest) <= 2 and len(c_words) > 1 and rest[0][0] == c_words[1][0] and not any(same_given(words[0], x) >= 0.9 for x in c_words[1:]):
            return 0.6
        return 0.0
    if org or not c_words:
        return 0.0
    given = c_words[0]
    best = 0.0
    whole = [x for x in rest if len(x) > 1]
    # an initial speaks only where no given name is written out
    for i, x in enumerate(whole or rest[:1]):
        score = same_given(x, given)
        if not score and x is rest[0] and 4 < len(x) <= LONGEST and len(given) > 4 and distance(x[:-1], given, 1) <= 1:
            score = 0.7  # the space between the words slipped by a letter
        best = max(best, score)
        if i + 1 < len(whole):
            best = max(best, same_given(x + whole[i + 1], given) - 0.05)
    return best
