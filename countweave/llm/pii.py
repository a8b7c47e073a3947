"""Personal information in free text: found by a skip-chain conditional random field.

Sentences are chains of tokens (pii_text) with the labels O, name, address (each begin/inside),
email, phone, id. Node potentials are tables over the lexical classes and cue words around a
token, edge potentials a transition table. Words of one document that are equal (folded case and
accents) or similar (up to one letter left out of each, or two neighbours swapped) are linked to the
previous occurrence by a skip edge; its potentials, for equal and for similar words, are learned as
the others are. Loopy message passing alternates exact chain passes (all sentences of a batch at
once, as arrays) with messages over the skip edges; links run from one occurrence to the one before,
so a word that occurs n times has n - 1 links, not n^2 / 2.

The tables are trained here (pii_train) on generated texts of another kind than any corpus
(pii_lines): no labelled text exists and none of the corpus is used. What was learned is a file of
this package, which `python -m countweave.llm.pii_train` makes anew. The name list is a lexicon
feature. It may be incomplete: beginnings and ends of its family names serve for others. A name of
unknown kind counts as either. The list goes to all tasks, so its rows are counted: beyond
`largest` (1 000 000, a parameter) it is refused by an error, never cut.

Sentences without anything that an item must have (pii_text.ANY: a sign of mail, digits, a form of
address, two capitals, ...) are not read token by token: the exact check below would take nothing
from them. That check follows decoding: it trims spans and drops what cannot be meant, such as lone
given names, names without any family name, addresses without house number, telephone numbers of a
wrong length, insurance numbers with a wrong check digit. The tokenizer offers mail addresses,
telephone, insurance and document numbers as single tokens by their form; the field decides
whether such a token is one, and no other token can be.

Null and empty texts have no spans. Placeholders are [EMAIL], [PHONE], [ID], [ADDRESS], [NAME].
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from countweave.functions.partitions import spread
from countweave.llm.pii_text import CLASSES, CLS, CUT, ROLES, SHAPES, Lexicon, ahv_valid, fold, near, other_class, sentences, spellings, tokens

LABELS = ["O", "BN", "IN", "BA", "IA", "E", "P", "D"]
K = len(LABELS)
C, S = len(CLASSES), len(SHAPES)
KINDS = {"BN": "name", "BA": "address", "E": "email", "P": "phone", "D": "id_number"}
PLACEHOLDER = {"name": "[NAME]", "address": "[ADDRESS]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]"}
FITTED = Path(__file__).with_name("pii_model.npz")
LARGEST_LIST = 1_000_000
ROUNDS = 3  # of loopy message passing
LEX_AT, CLS_AT, SHAPE_AT = (-2, -1, 0, 1, 2), (-2, -1, 0, 1, 2), (-1, 0, 1)
EQUAL, SIMILAR = 0, 1  # kinds of skip edges
# groups of label pairs whose potentials a kind of skip edge learns: both O, the same kind of item
BOTH_O = np.array([[a == b == "O" for b in LABELS] for a in LABELS])
SAME = np.array([[a != "O" and a[-1] == b[-1] for b in LABELS] for a in LABELS])


class Batch:
    """Index arrays of many lines: each line is a row of a box (token numbers, -1 pads). Lines that a
    skip edge touches have boxes of their own, `linked`: only these need message passing."""

    def __init__(self, lines: list[range], linked: list[bool], cls: np.ndarray, shape: np.ndarray, lex: np.ndarray) -> None:
        self.n = len(cls)
        alone = [line for line, k in zip(lines, linked) if not k]
        self.linked = self.boxes([line for line, k in zip(lines, linked) if k])
        self.groups = self.linked + self.boxes(alone)
        left = {1: np.full(self.n, -1), 2: np.full(self.n, -1)}
        right = {1: np.full(self.n, -1), 2: np.full(self.n, -1)}
        for box in self.groups:
            for d in (1, 2):
                if box.shape[1] > d:
                    a, b = box[:, :-d].ravel(), box[:, d:].ravel()
                    ok = b >= 0
                    left[d][b[ok]] = a[ok]
                    right[d][a[ok]] = b[ok]
        pick = lambda x, d: x if d == 0 else np.where((j := (left if d < 0 else right)[abs(d)]) >= 0, x[j], 0)
        c = {d: pick(cls, d) for d in CLS_AT}
        self.features = {f"c{d}": c[d] for d in CLS_AT}
        self.features |= {f"l{d}": pick(lex, d) for d in LEX_AT} | {f"s{d}": pick(shape, d) for d in SHAPE_AT}
        self.features |= {"p-": c[-1] * C + c[0], "p+": c[0] * C + c[1], "t": (c[-1] * C + c[0]) * C + c[1], "u": (c[0] * C + c[1]) * C + c[2], "v": (c[-2] * C + c[-1]) * C + c[0]}


    @staticmethod
    def boxes(lines: list[range]) -> list[np.ndarray]:
        """Rows of similar length share a rectangle."""
        lines = sorted(lines, key=len)
        out, at = [], 0
        while at < len(lines):
            width = max(8, int(len(lines[at]) * 1.5))
            end = at
            while end < len(lines) and len(lines[end]) <= width and (end - at) * width < 150_000:
                end += 1
            step = np.arange(len(lines[end - 1]))
            start, size = (np.array(x)[:, None] for x in zip(*((line.start, len(line)) for line in lines[at:end])))
            out.append(np.where(step < size, start + step, -1))
            at = end
        return out


def sizes(vocabulary: int) -> dict[str, int]:
    return {**{f"c{d}": C for d in CLS_AT}, **{f"l{d}": vocabulary for d in LEX_AT}, **{f"s{d}": S for d in SHAPE_AT}, "p-": C * C, "p+": C * C, "t": C**3, "u": C**3, "v": C**3}


ALLOWED = np.array([[not (b == "IN" and a not in ("BN", "IN") or b == "IA" and a not in ("BA", "IA")) for b in LABELS] for a in LABELS])
FIRST = np.array([b not in ("IN", "IA") for b in LABELS])


def chain(box: np.ndarray, psi: np.ndarray, a: np.ndarray, gradient: bool = False):
    """Marginals of all lines of a box (forward-backward, scaled); with the expected
    transitions and the log partition where a gradient is wanted."""
    rows, width = box.shape
    live = box >= 0
    node = np.where(live[..., None], psi[np.maximum(box, 0)], psi.dtype.type(1))
    a = a.astype(psi.dtype)
    alpha, beta = np.empty((width, rows, K), psi.dtype), np.empty((width, rows, K), psi.dtype)
    scale = np.empty((width, rows))
    x = node[:, 0] * FIRST
    for t in range(width):
        if t:
            x = (x @ a) * node[:, t]
            x = np.where(live[:, t, None], x, alpha[t - 1])
        s = x.sum(1)
        x = x / s[:, None]
        alpha[t], scale[t] = x, s
    y = np.ones((rows, K), psi.dtype)
    beta[-1] = y
    for t in range(width - 1, 0, -1):
        z = (node[:, t] * y) @ a.T
        z /= z.sum(1, keepdims=True)
        y = np.where(live[:, t, None], z, y)
        beta[t - 1] = y
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    if not gradient:
        return m.transpose(1, 0, 2)
    pairs = np.zeros((K, K))
    for t in range(1, width):
        on = live[:, t]
        q = alpha[t - 1][on][:, :, None] * a[None] * (node[on, t] * beta[t][on])[:, None, :]
        pairs += (q / q.sum((1, 2), keepdims=True)).sum(0)
    return m.transpose(1, 0, 2), pairs, np.log(scale[live.T]).sum()


def best(box: np.ndarray, psi: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Most likely label sequence of each line (Viterbi)."""
    rows, width = box.shape
    live = box >= 0
    node = np.log(np.where(live[..., None], psi[np.maximum(box, 0)], 1.0) + 1e-30).astype(np.float32)
    la = np.log(a + 1e-30).astype(np.float32)
    back = np.zeros((width, rows, K), dtype=np.int8)
    x = node[:, 0] + np.where(FIRST, 0.0, -1e9).astype(np.float32)
    for t in range(1, width):
        q = x[:, :, None] + la[None]
        back[t] = q.argmax(1)
        x = np.where(live[:, t, None], q.max(1) + node[:, t], x)
        back[t][~live[:, t]] = np.arange(K)
    out = np.zeros((rows, width), dtype=np.int64)
    y = x.argmax(1)
    for t in range(width - 1, -1, -1):
        out[:, t] = y
        if t:
            y = back[t][np.arange(rows), y]
    return out


class Model:
    def __init__(self, vocabulary: dict[str, int], tables: dict[str, np.ndarray] | None = None, edges: np.ndarray | None = None, skip: np.ndarray | None = None) -> None:
        self.vocabulary = vocabulary
        self.tables = tables or {k: np.zeros((n, K)) for k, n in sizes(len(vocabulary) + 1).items()}
        self.edges = np.zeros((K, K)) if edges is None else edges
        self.skip = np.zeros((2, 2)) if skip is None else skip  # kind of edge x (both O, same item)

    def parts(self) -> tuple:
        return self.vocabulary, self.tables, self.edges, self.skip

    def scores(self, b: Batch) -> np.ndarray:
        s = np.zeros((b.n, K), self.tables["c0"].dtype)
        for k, i in b.features.items():
            s += self.tables[k][i]
        return s

    def transitions(self) -> np.ndarray:
        return np.exp(self.edges) * ALLOWED

    def potentials(self, b: Batch) -> np.ndarray:
        s = self.scores(b)
        return np.exp(s - s.max(1, keepdims=True))

    def agreement(self) -> np.ndarray:
        """Potentials of label pairs by kind of skip edge."""
        return np.exp(self.skip[:, 0, None, None] * BOTH_O + self.skip[:, 1, None, None] * SAME)

    def messages(self, b: Batch, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Node potentials after ROUNDS of chain passes and messages over the links (i, j, kind), and
        for each link the beliefs of both ends without the other's message."""
        psi, a = self.potentials(b), self.transitions()
        i, j, kind = links
        agree = self.agreement().astype(psi.dtype)[kind]
        to_j, to_i = np.ones((len(i), K), psi.dtype), np.ones((len(j), K), psi.dtype)
        at_i = at_j = to_j
        node = psi
        for _ in range(ROUNDS):
            m = np.ones((b.n, K), node.dtype)
            for box in b.linked:
                got = chain(box, node, a)
                live = box >= 0
                m[box[live]] = got[live]
            at_i, at_j = m[i] / to_i, m[j] / to_j
            to_j, to_i = np.einsum("lx,lxy->ly", at_i, agree), np.einsum("lx,lxy->ly", at_j, agree)
            to_j /= to_j.sum(1, keepdims=True)
            to_i /= to_i.sum(1, keepdims=True)
            node = psi.copy()
            np.multiply.at(node, j, to_j)
            np.multiply.at(node, i, to_i)
        return node, at_i, at_j, agree

    def decode(self, b: Batch, links: np.ndarray) -> np.ndarray:
        """Labels of all tokens."""
        psi = self.messages(b, links)[0] if links.shape[1] else self.potentials(b)
        a, out = self.transitions(), np.zeros(b.n, dtype=np.int64)
        for box in b.groups:
            live = box >= 0
            out[box[live]] = best(box, psi, a)[live]
        return out


@lru_cache
def trained() -> Model:
    """The fitted model that comes with the package."""
    with np.load(FITTED) as z:
        words = [str(w) for w in z["words"]]
        n = sizes(len(words) + 1)
        tables = {}
        for k in n:  # rows that were never seen are zero and left out of the file
            tables[k] = np.zeros((n[k], K), dtype=np.float32)
            tables[k][z[f"at_{k}"]] = z[f"w_{k}"]
        return Model({w: i + 1 for i, w in enumerate(words)}, tables, z["edges"], z["skip"])


class Documents:
    """Gathers documents into one Batch. Sentences that recur are read once (a bounded table)."""

    def __init__(self, lexicon: Lexicon, vocabulary: dict[str, int]) -> None:
        self.lexicon, self.vocabulary = lexicon, vocabulary
        self.known: dict[tuple[str, str], tuple[int, int, int, str, list[str]]] = {}
        self.read: dict[str, tuple] = {}
        self.clear()

    def clear(self) -> None:
        self.cls: list[int] = []
        self.shape: list[int] = []
        self.lex: list[int] = []
        self.lines: list[range] = []
        self.linked: tuple[list[int], list[int], list[int]] = ([], [], [])
        self.held: list[list[tuple[int, int, list[tuple[str, int, int, str]]]]] = []

    def token(self, kind: str, s: str) -> tuple[int, int, int, str, list[str]]:
        """Class, shape and cue number of a token, the folded word and the spellings it is linked by."""
        if kind == "word":
            c, shape = self.lexicon.word(s)
            f = fold(s.rstrip("."))
            lex = self.vocabulary.get(f, 0)
            linked = not lex and shape > 1 and len(f) > 2
            return c, shape, lex, f, (spellings(f) if len(f) > 4 else [f]) if linked else []
        name = other_class(kind, s)
        if name == "ahv" and not ahv_valid(s):
            name = "num"
        return CLS[name], 0, self.vocabulary.get(s, 0) if name == "sym" else 0, "", []

    def sentence(self, text: str) -> tuple:
        """Tokens, classes, shapes and cues of a sentence, and its linked words (place, word, spellings)."""
        known, found = self.known, tokens(text)
        cls, shape, lex, words = [], [], [], []
        for n, (kind, _, _, s) in enumerate(found):
            t = known.get((kind, s))
            if t is None:
                if len(known) > 200_000:
                    known.clear()
                t = known[kind, s] = self.token(kind, s)
            cls.append(t[0])
            shape.append(t[1])
            lex.append(t[2])
            if t[4]:
                words.append((n, t[3], t[4]))
        return found, cls, shape, lex, words

    def add(self, text: str, whole: bool = False) -> list[tuple[int, int]]:
        """Adds a document's sentences that can hold an item (all of them where `whole`); the bounds
        of its tokens."""
        last: dict[str, tuple[int, str]] = {}
        mine, linked, read = [], self.linked, self.read
        for a, e in _all_sentences(text) if whole else sentences(text):
            part = text[a:e]
            got = read.get(part)
            if got is None:
                got = self.sentence(part)
                if len(part) <= 400:
                    if len(read) > 20_000:
                        read.clear()
                    read[part] = got
            found, cls, shape, lex, words = got
            base = len(self.cls)
            self.cls += cls
            self.shape += shape
            self.lex += lex
            mine.append((base, a, found))
            if found:
                self.lines.append(range(base, base + len(found)))
            for n, f, keys in words:
                before = max((last[k] for k in keys if k in last), default=None)
                if before:
                    linked[0].append(before[0])
                    linked[1].append(base + n)
                    linked[2].append(EQUAL if before[1] == f else SIMILAR)
                for k in keys:
                    last[k] = (base + n, f)
        self.held.append(mine)
        return [(a + x, a + y) for _, a, found in mine for _, x, y, _ in found]

    def links(self) -> np.ndarray:
        return np.array(self.linked, dtype=np.int64).reshape(3, -1)

    def batch(self) -> Batch:
        touched = np.zeros(len(self.cls) + 1, dtype=np.int64)
        touched[self.linked[0]] = touched[self.linked[1]] = 1
        upto = np.concatenate([[0], np.cumsum(touched)])
        return Batch(self.lines, [bool(upto[r.stop] > upto[r.start]) for r in self.lines], np.array(self.cls, dtype=np.int64), np.array(self.shape, dtype=np.int64), np.array(self.lex, dtype=np.int64))


def _all_sentences(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in CUT.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


ROLE_FOLDS = [fold(r) for r in ROLES]


ROLE_SEEN: dict[str, bool] = {}  # a plain table: functions of tasks travel by value, decorated ones would not


def _is_role(f: str) -> bool:
    """A role, or up to one letter off, two for long words."""
    got = ROLE_SEEN.get(f)
    if got is None:
        if len(ROLE_SEEN) > 100_000:
            ROLE_SEEN.clear()
        got = ROLE_SEEN[f] = len(f) > 4 and any(near(f, r, 2 if len(r) > 8 else 1) for r in ROLE_FOLDS)
    return got


def checked(kind: str, span: list[tuple[str, int, int, str]], before: list[tuple[str, int, int, str]], lexicon: Lexicon) -> tuple[int, int] | None:
    """The exact bounds of a span, None where it cannot be meant. before: the tokens ahead of it."""
    own = {"phone": ("phone",), "email": ("email",), "id_number": ("ahv", "pass")}
    if kind in own and span[0][0] not in own[kind]:
        return None
    if kind == "email":
        # a sentence that follows without a blank is not part of the host
        a, s = span[0][1], span[0][3]
        while (cut := s.rfind(".")) > 0 and s[cut + 1].isupper() and s[cut - 1].islower():
            s = s[:cut]
        return a, a + len(s)
    if kind == "phone":
        n = sum(c.isdigit() for c in span[0][3])
        return (span[0][1], span[0][2]) if 9 <= n <= 15 else None
    if kind == "id_number":
        return span[0][1], span[0][2]
    word = lambda t: t[0] in ("word", "init")
    if kind == "name":
        while span and lexicon.word(span[0][3])[0] == CLS["title"] and span[0][0] == "word":
            before, span = [*before, span[0]], span[1:]
        while span and not word(span[-1]):
            span = span[:-1]
        while span and not word(span[0]):
            span = span[1:]
        if not span or any(t[0] not in ("word", "init") and t[3] not in (",", ".") for t in span):
            return None
        plain = [t for t in span if t[0] == "word" and lexicon.word(t[3])[0] != CLS["part"] and len(t[3]) > 1]
        titled = bool(before) and before[-1][0] == "word" and lexicon.word(before[-1][3])[0] == CLS["title"]
        if not plain or not all(any(c.isupper() for c in t[3]) for t in plain) or any(_is_role(fold(t[3])) for t in plain if lexicon.word(t[3])[0] not in (CLS["given"], CLS["fam"])):
            return None
        classes = {lexicon.word(t[3])[0] for t in plain}
        if not classes & {CLS["given"], CLS["fam"], CLS["morph"]} and all(t[3].isupper() for t in plain):
            return None  # capitals throughout say nothing about a name
        if len(plain) == 1 and not any(t[0] == "init" for t in span):
            if not titled or lexicon.is_given(fold(plain[0][3])):
                return None
        return span[0][1], span[-1][2]
    # address: needs a house number; ends with it or with the town after the postcode
    if not any(t[0] == "num" for t in span):
        return None
    while span and span[-1][0] in ("sym", "rule", "nl"):
        span = span[:-1]
    while span and span[0][0] in ("sym", "rule", "nl"):
        span = span[1:]
    return (span[0][1], span[-1][2]) if len(span) > 1 else None


def spans_of(docs: Documents, labels: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Per held document: (kind, start, end) in order."""
    out = []
    for mine in docs.held:
        got = []
        for base, at, found in mine:
            y = labels[base : base + len(found)]
            for t in np.flatnonzero(y):
                name = LABELS[y[t]]
                if name not in KINDS:
                    continue
                e = t + 1
                if name in ("BN", "BA"):
                    while e < len(found) and LABELS[y[e]] == "I" + name[1]:
                        e += 1
                if bounds := checked(KINDS[name], found[t:e], found[max(0, t - 3) : t], docs.lexicon):
                    got.append((KINDS[name], bounds[0] + at, bounds[1] + at))
        out.append(got)
    return out


def lexicon_rows(names: DataFrame, largest: int = LARGEST_LIST) -> tuple[list[str], list[str]]:
    """Given and family names on the driver; an error beyond `largest` rows. A kind that is neither
    of the two, or null, counts as both."""
    rows = names.select("name", "name_kind").where("name IS NOT NULL").limit(largest + 1).collect()
    if len(rows) > largest:
        raise ValueError(f"name list of more than {largest} rows")
    kind = [(r[0], (r[1] or "").strip().lower()) for r in rows]
    return [n for n, k in kind if k != "family"], [n for n, k in kind if k != "given"]


def _finder(model: Model, given: list[str], family: list[str], most: int = 300_000):
    """Texts -> spans, in pieces of at most `most` characters or one text."""

    def find(texts: list[str | None]) -> Iterator[list[tuple[str, int, int]]]:
        docs = Documents(find.lexicon, model.vocabulary)
        size = held = 0
        for k, t in enumerate(texts):
            docs.add(t or "")
            size += len(t or "")
            held += 1
            if size >= most or k + 1 == len(texts):
                if docs.cls:
                    yield from spans_of(docs, model.decode(docs.batch(), docs.links()))
                else:
                    yield from ([] for _ in range(held))
                docs.clear()
                size = held = 0

    find.lexicon = Lexicon(given, family)
    return find


def found(df: DataFrame, key: str, text: str, names: DataFrame, largest: int = LARGEST_LIST) -> DataFrame:
    """key, kind, start_pos, end_pos (code points, end excluded) of every item in every text."""
    shared = df.sparkSession.sparkContext.broadcast((trained().parts(), *lexicon_rows(names, largest)))
    schema = T.StructType([df.schema[key], T.StructField("kind", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _of(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                rows = list(find(part.column(text).to_pylist()))
                at = np.repeat(np.arange(part.num_rows), [len(r) for r in rows])
                flat = [s for r in rows for s in r]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at)), pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.int32())], names=schema.names)

    return spread(df.select(key, text), key).mapInArrow(work, schema)


def redacted(df: DataFrame, key: str, text: str, names: DataFrame, largest: int = LARGEST_LIST) -> DataFrame:
    """key, text with typed placeholders, everything else as it was (null stays null)."""
    shared = df.sparkSession.sparkContext.broadcast((trained().parts(), *lexicon_rows(names, largest)))
    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType()), T.StructField("n_items", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _of(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = part.column(text).to_pylist()
                rows = list(find(texts))
                out = []
                for t, items in zip(texts, rows):
                    for kind, s, e in reversed(items):
                        t = t[:s] + PLACEHOLDER[kind] + t[e:]
                    out.append(t)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, pa.string()), pa.array([len(r) for r in rows], pa.int32())], names=schema.names)

    return spread(df.select(key, text), key).mapInArrow(work, schema)


def _of(shared: tuple):
    parts, given, family = shared
    return _finder(Model(*parts), given, family)
