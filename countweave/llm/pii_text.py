"""Tokens of forum text for the personal-information tagger, and its lexical classes.

Candidates that have a form of their own (mail addresses however disguised, telephone numbers,
insurance and document numbers) are single tokens; whether they are what they look like is
left to the tagger. Words keep mojibake and inner hyphens. Positions are code points.
"""

from __future__ import annotations

import re
import unicodedata

LETTER = r"(?:Ã[\x80-\xbfŒ-Ÿ–-™]|[^\W\d_])"
AT = r"(?i:@|&\#64;|&\#x40;|\s?[\[({]\s?(?:at|ät|@|arobase|chiocciola)\s?[\])}]\s?|\s(?:ät|arobase|chiocciola)\s)"
DOT = r"(?i:\.|\s?[\[({]\s?(?:dot|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|punkt|point|punto)\s)"
SPOKEN_DOT = r"(?i:\s?[\[({]\s?(?:dot|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|punkt|point|punto)\s)"
LOCAL = r"[\w+'%-]+(?:\.[\w+'%-]+)*"
HOST = r"[\w-]+"
GAP = r"[  ./-]{0,2}"
TOKEN = re.compile(
    rf"""
    (?P<url>https?://\S+|www\.\S+)
  | (?P<email>(?<![\w.+-]){LOCAL}(?:{AT}{HOST}(?:{DOT}{HOST})*{DOT}[^\W\d_]{{2,24}}(?![\w-])|(?i:\sat\s){HOST}(?:{SPOKEN_DOT}{HOST})*{SPOKEN_DOT}[^\W\d_]{{2,24}}(?![\w-])))
  | (?P<ent>&(?:[a-zA-Z]{{2,8}}|\#\d{{1,6}}|\#x[0-9a-fA-F]{{1,5}});)
  | (?P<ahv>(?<![\w.])756(?P<sa>[  .]{{0,2}})\d{{4}}[  .]{{0,2}}\d{{4}}[  .]{{0,2}}\d{{2}}(?!\w))
  | (?P<pass>(?<![\w-])[A-Z][  ]{{0,2}}\d{{7}}(?!\w))
  | (?P<phone>(?<![\w+])(?<!\d[.,/-])(?:(?:\+|00)[1-9]\d{{0,2}}{GAP}(?:\(0\){GAP})?(?:\(?\d{{1,4}}\)?{GAP}){{2,5}}\d{{2,4}}|\+[1-9]\d{{8,13}}|00[1-9]\d{{8,13}}|(?:1[ .-])?\(?[2-9]\d{{2}}\)?[  .-]{{1,2}}\d{{3}}-\d{{4}}|\(?0[1-9]\d{{0,2}}\)?{GAP}\d{{2,4}}(?:{GAP}\d{{2,4}}){{1,4}}|0[1-9]\d{{8}})(?!\w)(?![./-]\d))
  | (?P<post>(?<!\w)[A-Z]{{1,2}}-\d{{4,5}}(?!\w))
  | (?P<init>(?<!\w)[A-ZÄÖÜÉÈÀÇ]\.(?:-?[A-ZÄÖÜÉÈÀÇ]\.)*(?=\s*\w))
  | (?P<word>{LETTER}+(?:[-'’]{LETTER}+)*(?![\d_])\.?)
  | (?P<num>\d+(?:[.,'’/:]\d+)*[a-zA-Z]?(?![\w]))
  | (?P<handle>\w+)
  | (?P<nl>\n+)
  | (?P<rule>-{{2,}}|_{{2,}})
  | (?P<sym>[^\s\w])
    """,
    re.VERBOSE,
)
# Forms of address, particles and street words of the languages of the forum.
TITLES = set("herr herrn frau fräulein mr mrs ms miss mister sir monsieur m mme madame mademoiselle mlle signor signora signore signorina sig dr prof ing lic familie fam".split())
PARTICLES = set("de di da del della von van der den zu zur vom le la du des dos do ten ter af".split())
STREET_END = tuple("strasse straße str gasse weg platz rain hag quai allee ring halde matt matte graben steig pfad ufer damm hof dorf bruecke steg unterfuehrung tunnel bahnhof gässli wegli street road lane avenue drive".split())
STREET_START = set("rue via chemin avenue av boulevard bd route ruelle place impasse allée quai viale piazza corso vicolo strada am im an".split())
ROLES = "stadtrat stadträtin gemeindepräsident gemeindepräsidentin präsident präsidentin president presidente président présidente direktor direktorin sindaco maire mayor nationalrat doktor professor minister vorsitzende kollege kollegin nachbar".split()

UPPER = "A-ZÀ-ÖØ-Þ"
SMALL = "(?i:(?:" + "|".join(sorted(PARTICLES)) + r")\s+|d['’])"
LOWER_TITLES = "|".join(sorted(TITLES))
# Sentences are the tagger's chains: cut at line ends and after the full stop of a word of five letters.
CUT = re.compile(r"\s(?:(?<=\n)\n*|(?<=[^\W\d_]{5}[.!?…]\s)(?<![sS][tT][rR][.]\s)\s*)")
# What any item must have: two capitals with at most particles between them, a capital beside a short
# number, digits enough for a number, a short number ahead of a street word ...
ANY = re.compile(
    rf"""[{UPPER}\d](?:
    (?<=\d)(?:[\s\u00a0().,/+-]{{0,3}}\d){{8}}
  | (?<=\d)\d{{0,2}}\s?[a-z]?,?\s{{1,2}}(?i:{"|".join(sorted(STREET_START))})\b
  | (?<=[{UPPER}])(?:\s{{0,2}}\d{{7}}|[^\s\d]*[\s,]{{0,3}}\d{{1,3}}(?!\d)|(?:[^\s.;:!?]*|\.(?:-?[{UPPER}]\.)*)[\s,("'«]*{SMALL}{{0,2}}[{UPPER}])
    )""",
    re.VERBOSE,
)
# ... a sign of mail, or a small form of address ahead of a capital.
MAIL = re.compile(rf"[\s\[({{](?:\s?(?i:at|ät|arobase|chiocciola)\s?[\])}}]|(?i:ät|arobase|chiocciola)\s|(?i:at)\s\S+\s?[\[({{]?\s?(?i:dot|punkt|point|punto)|(?:{LOWER_TITLES})\b\.?\s+{SMALL}{{0,2}}[{UPPER}])")


def holds(s: str) -> bool:
    return ANY.search(s) is not None or "@" in s or "&#" in s or MAIL.search(" " + s) is not None


CLASSES = "pad nl low cap up given fam morph init title part street strword house letter code post num email phone intl ahv pass handle bar comma dot colon rule quote bracket sym url".split()
CLS = {c: i for i, c in enumerate(CLASSES)}
SHAPES = "none low cap up mixed".split()


def unbroken(w: str) -> str:
    """Undo UTF-8 read as Latin-1 or Windows-1252 in one word."""
    if "Ã" not in w:
        return w
    for code in ("cp1252", "latin-1"):
        try:
            return w.encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return w


def fold(w: str) -> str:
    """Lower case, umlauts spelled out, other accents dropped."""
    w = unbroken(w).lower().translate({0xE4: "ae", 0xF6: "oe", 0xFC: "ue", 0xDF: "ss", 0x2019: "'"})
    return "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


def near(a: str, b: str, most: int = 2) -> bool:
    """Equal up to `most` changed, missing or swapped letters (a swap of neighbours is one)."""
    if abs(len(a) - len(b)) > most:
        return False
    prev2, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        prev2, prev = prev, row
    return prev[-1] <= most


def spellings(w: str) -> list[str]:
    """The word and all words with one letter less: similar words share one."""
    return [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]


class Lexicon:
    """Given and family names, and the beginnings and ends that family names are made of."""

    def __init__(self, given: list[str], family: list[str], least: int = 3) -> None:
        self.given = {fold(x) for x in given if x}
        self.family = {fold(x) for x in family if x}
        heads: dict[str, int] = {}
        tails: dict[str, int] = {}
        for f in self.family:
            for n in (4, 5):
                heads[f[:n]] = heads.get(f[:n], 0) + 1
            for n in (3, 4, 5):
                tails[f[-n:]] = tails.get(f[-n:], 0) + 1
        self.heads = {h for h, n in heads.items() if n >= least}
        self.tails = {t for t, n in tails.items() if n >= least}
        self.known: dict[str, tuple[int, int]] = {}

    def is_given(self, f: str) -> bool:
        return f in self.given or ("-" in f and all(p in self.given for p in f.split("-")))

    def is_family(self, f: str) -> bool:
        return f in self.family or ("-" in f and any(p in self.family for p in f.split("-")))

    def is_morph(self, f: str) -> bool:
        return any(len(p) > 5 and p[:4] in self.heads and any(p[-n:] in self.tails for n in (3, 4, 5)) for p in f.split("-"))

    def word(self, w: str) -> tuple[int, int]:
        """Class and shape of a word token."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[w] = self._word(w)
        return got

    def _word(self, w: str) -> tuple[int, int]:
        w = w.rstrip(".")
        f = fold(w)
        u = unbroken(w)
        letters = [c for c in u if c.isalpha()]
        upper = sum(c.isupper() for c in letters)
        shape = "low" if not upper else "up" if upper == len(letters) and len(letters) > 1 else "cap" if u[0].isupper() else "mixed"
        if f in TITLES or (f.endswith("in") and f in TITLES):
            c = "title"
        elif f in PARTICLES and shape != "up" or (shape == "up" and f in PARTICLES):
            c = "part"
        elif f in STREET_START:
            c = "strword"
        elif shape == "low":
            c = "letter" if len(u) == 1 else "low"
        elif self.is_given(f):
            c = "given"
        elif self.is_family(f):
            c = "fam"
        elif f.endswith(STREET_END) and len(f) > 5:
            c = "street"
        elif self.is_morph(f):
            c = "morph"
        else:
            c = "up" if shape == "up" else "cap"
        return CLS[c], SHAPES.index(shape)


SYM = {"|": "bar", ",": "comma", ";": "comma", ".": "dot", "!": "dot", "?": "dot", ":": "colon", ">": "quote", "<": "bracket", "[": "bracket", "]": "bracket", "(": "bracket", ")": "bracket"}


def other_class(kind: str, s: str) -> str:
    if kind == "num":
        digits = s.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
        if digits.isdigit():
            return "house" if len(digits) <= 3 else "code" if len(s) == 4 else "num"
        return "num"
    if kind == "phone" and s[0] == "+":
        return "intl"
    if kind == "ent":
        return "quote"
    if kind == "sym":
        return SYM.get(s, "sym")
    return kind


def sentences(text: str) -> list[tuple[int, int]]:
    """Bounds of the sentences that can hold an item at all; the others have none."""
    out, at = [], 0
    for m in CUT.finditer(text):
        if holds(text[at : m.start()]):
            out.append((at, m.start()))
        at = m.end()
    if holds(text[at:]):
        out.append((at, len(text)))
    return out


def tokens(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, text) of every token, line breaks included."""
    out = []
    for m in TOKEN.finditer(text):
        kind, s, a, b = m.lastgroup, m[0], m.start(), m.end()
        if kind == "sa":
            kind = "ahv"
        if kind == "word" and s[-1] == ".":
            f = s[:-1].lower()
            if f in TITLES or f.endswith("str") or f in STREET_START:
                pass  # the dot is the abbreviation's
            else:
                out.append(("word", a, b - 1, s[:-1]))
                out.append(("sym", b - 1, b, "."))
                continue
        out.append((kind, a, b, s))
    return out


def ahv_valid(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()]
    return len(d) == 13 and (10 - sum(x * (3 if i % 2 else 1) for i, x in enumerate(d[:12])) % 10) % 10 == d[12]
