"""Mixed timestamp formats and zones to one instant in UTC.

A text is reduced to its shape: digits become 9, letters a, all else stays. Each distinct shape
of a batch is mapped to a parser once; the parser then reads its fields from fixed positions
of all texts of that shape at a time (numpy arrays of code points). Wall-clock times without a
zone go through a versioned zone transition table (functions.zones), times with a stated zone
or offset are taken at their word. Canonical and foreign notations take the same way.

Results: `utc` in microseconds since 1970, null where the text is null, empty, of unknown shape or names no real time (month 13,
30 February, minute 75). Texts of any length are read; they are worked on by length, so that a long
one makes no others wide. Fractions are kept to the microsecond. Numeric dates with dots are day.month.year;
of all-digit texts, 9 or 10 digits are epoch seconds, 13 milli-, 16 micro-, 19 nanoseconds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countweave.functions.zones import HOUR, SECOND, ZoneTable, zone_table

SHORT, CELLS = 64, 4_000_000  # texts up to SHORT share an array; code points of one array at most
CANONICAL = "9999-99-99a99:99"
NONE = np.iinfo(np.int64).min

# Month names and their usual short forms in German, English, French, Italian.
MONTHS = {
    1: "januar jänner jan january janvier janv gennaio gen",
    2: "februar feb february février févr fevrier fév febbraio febbr",
    3: "märz mär mrz maerz march mar mars marzo",
    4: "april apr avril avr aprile",
    5: "mai may maggio mag",
    6: "juni jun june juin giugno giu",
    7: "juli jul july juillet juil luglio lug",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre settembre sett set",
    10: "oktober okt october oct octobre ottobre ott",
    11: "november nov novembre",
    12: "dezember dez december dec décembre déc decembre dicembre dic",
}
# Day names and short forms in the same languages.
DAYS = (
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so "
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lun mar mer jeu ven sam dim "
    "lunedì martedì mercoledì giovedì venerdì sabato domenica lunedi martedi mercoledi giovedi venerdi gio sab dom"
)
# Zone abbreviations and their hours east of UTC.
ZONES = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "mez": 1, "cet": 1, "mesz": 2, "cest": 2, "hec": 1, "hesc": 2}
MONTH_OF = {w: m for m, ws in MONTHS.items() for w in ws.split()}
DAY_NAMES = set(DAYS.split())
CLOCK_WORDS = {"uhr", "h"}

DATE = r"(?:(?P<y>9999)-(?P<m>99)-(?P<d>99)|(?P<y2>9999)/(?P<m2>99)/(?P<d2>99)|(?P<d3>99?)\. ?(?P<m3>99?)\. ?(?P<y3>9999)|(?:(?P<wd>a+)\.?,? )?(?P<d4>99?)\.? (?P<mn>a+)\.? (?P<y4>9999)|(?:(?P<wd2>a+)\.?,? )?(?P<mn2>a+)\.? (?P<d5>99?),? (?P<y5>9999)|(?P<y6>9999)(?P<m6>99)(?P<d6>99))"
TIME = r"(?P<H>99?)(?:[:.]|(?P<hm> ?a ?))(?P<M>99)(?:[:.](?P<S>99)(?:[.,](?P<f>9+))?)?|(?P<H2>99)(?P<M2>99)(?:(?P<S2>99)(?:[.,](?P<f2>9+))?)?"
ZONE = r"(?: ?(?P<z>a+)|(?: ?(?P<uhr>a+))? ?(?P<sign>[+-])(?P<zh>99):?(?P<zm>99)?)?"
LAYOUT = re.compile(rf"{DATE}(?:(?P<sep>a)| ?, ?| +(?:(?P<at>a+) )?)(?:{TIME}){ZONE}")
EPOCH = re.compile(r"(?P<e>9{9,10}|9{13}|9{16}|9{19})(?:\.(?P<ef>9{1,6}))?")

Parser = Callable[[np.ndarray, ZoneTable], np.ndarray]


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the date exists."""
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    ms = np.where(ok, m, 1)
    month = (np.where(ok, y, 1970) - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (ms - 1)
    first = month.astype("datetime64[D]").astype(np.int64)
    length = (month + 1).astype("datetime64[D]").astype(np.int64) - first
    return first + d - 1, ok & (d <= length)


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.int64)
    for c in range(*span):
        out = out * 10 + (codes[:, c].astype(np.int64) - 48)
    return out


def _words(codes: np.ndarray, span: tuple[int, int], table: dict[str, int]) -> np.ndarray:
    """Word -> number by table, -99 where unknown; each distinct word is looked up once."""
    block = np.ascontiguousarray(codes[:, span[0] : span[1]])
    text = block.view(f"<U{span[1] - span[0]}").ravel()
    distinct, inverse = np.unique(text, return_inverse=True)
    return np.array([table.get(str(w).lower(), -99) for w in distinct], dtype=np.int64)[inverse]


def _epoch(match: re.Match) -> Parser:
    digits = match.end("e")
    scale = {9: SECOND, 10: SECOND, 13: 1000, 16: 1}.get(digits)

    def parse(codes: np.ndarray, _: ZoneTable) -> np.ndarray:
        n = _number(codes, match.span("e"))
        us = n // 1000 if scale is None else n * scale
        if match["ef"] and scale == SECOND:
            us = us + _number(codes, match.span("ef")) * 10 ** (6 - len(match["ef"]))
        return us

    return parse


def parser_for(shape: str) -> Parser | None:
    """The parser of one shape, None if it has the shape of no time."""
    if e := EPOCH.fullmatch(shape):
        return _epoch(e)
    m = LAYOUT.fullmatch(shape)
    if not m:
        return None
    g = {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    field = lambda *names: next((g[n] for n in names if n in g), None)
    year, month, day = field("y", "y2", "y3", "y4", "y5", "y6"), field("m", "m2", "m3", "m6"), field("d", "d2", "d3", "d4", "d5", "d6")
    hour, minute, second, frac = field("H", "H2"), field("M", "M2"), field("S", "S2"), field("f", "f2")
    day_words = {w: 1 for w in DAY_NAMES}

    def parse(codes: np.ndarray, zone: ZoneTable) -> np.ndarray:
        mm = _number(codes, month) if month else _words(codes, field("mn", "mn2"), MONTH_OF)
        days, ok = days_from_civil(_number(codes, year), mm, _number(codes, day))
        h, mi = _number(codes, hour), _number(codes, minute)
        s = _number(codes, second) if second else np.zeros_like(h)
        ok &= (h < 24) & (mi < 60) & (s < 60)
        us = ((days * 24 + h) * 60 + mi) * 60 * SECOND + s * SECOND
        if frac:
            us = us + _number(codes, (frac[0], min(frac[1], frac[0] + 6))) * 10 ** max(0, 6 - (frac[1] - frac[0]))
        if wd := field("wd", "wd2"):
            ok &= _words(codes, wd, day_words) > 0
        if "sep" in g:
            ok &= _words(codes, g["sep"], {"t": 1}) > 0
        if "at" in g:
            ok &= _words(codes, g["at"], {w: 1 for w in ("um", "at", "à", "alle")}) > 0
        if "hm" in g:
            a, b = g["hm"]
            a += int(shape[a] == " ")
            ok &= _words(codes, (a, a + 1), {"h": 1}) > 0
        if "uhr" in g:
            ok &= _words(codes, g["uhr"], {w: 1 for w in (*CLOCK_WORDS, "utc", "gmt")}) > 0
        if "sign" in g:
            shift = _number(codes, g["zh"]) * 60 + (_number(codes, g["zm"]) if "zm" in g else 0)
            ok &= shift <= 18 * 60
            sign = np.where(codes[:, g["sign"][0]] == ord("-"), -1, 1)
            return np.where(ok, us - sign * shift * 60 * SECOND, NONE)
        local = zone.to_utc(us)
        if "z" in g:
            east = _words(codes, g["z"], {**ZONES, **{w: -98 for w in CLOCK_WORDS}})
            ok &= east != -99
            local = np.where(east == -98, local, us - east * HOUR)
        return np.where(ok, local, NONE)

    return parse


def _shape_codes(codes: np.ndarray) -> np.ndarray:
    """Code points -> shape code points; 0 pads."""
    out = codes.copy()
    out[(codes >= 48) & (codes <= 57)] = ord("9")
    low = codes < 128
    out[low & (((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122)))] = ord("a")
    high = ~low
    if high.any():
        letters = np.array([chr(c).isalpha() for c in codes[high]])
        out[high] = np.where(letters, ord("a"), codes[high])
    return out


def parse_texts(texts: pa.Array, zone: ZoneTable, parsers: dict[str, Parser | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds (NONE where unusable), and whether each text is canonical and valid."""
    n = len(texts)
    utc, canonical = np.full(n, NONE), np.zeros(n, dtype=bool)
    stripped = pc.utf8_trim_whitespace(texts)
    length = pc.fill_null(pc.utf8_length(stripped), 0).to_numpy(zero_copy_only=False)
    trimmed = pc.fill_null(pc.not_equal(pc.utf8_length(texts), pc.utf8_length(stripped)), False).to_numpy(zero_copy_only=False)
    width = SHORT
    while True:
        rows = np.flatnonzero((length > (0 if width == SHORT else width // 2)) & (length <= width))
        for lo in range(0, len(rows), max(1, CELLS // width)):
            some = rows[lo : lo + max(1, CELLS // width)]
            utc[some], same = _parse(stripped.take(pa.array(some)), zone, parsers)
            canonical[some] = same & ~trimmed[some]
        if width >= length.max(initial=0):
            return utc, canonical
        width *= 2


def _parse(texts: pa.Array, zone: ZoneTable, parsers: dict[str, Parser | None]) -> tuple[np.ndarray, np.ndarray]:
    """The same for stripped texts of about one length."""
    utc, canonical = np.full(len(texts), NONE), np.zeros(len(texts), dtype=bool)
    chosen = np.array(texts.to_pylist(), dtype=np.str_)
    width = chosen.dtype.itemsize // 4
    codes = chosen.view(np.uint32).reshape(len(texts), width)
    shapes, inverse = np.unique(np.ascontiguousarray(_shape_codes(codes)).view(f"<U{width}").ravel(), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[order], np.arange(len(shapes) + 1))
    for k, shape in enumerate(map(str, shapes)):
        if shape not in parsers:
            if len(parsers) > 10_000:
                parsers.clear()
            parsers[shape] = parser_for(shape)
        if (p := parsers[shape]) is None:
            continue
        at = order[starts[k] : starts[k + 1]]
        utc[at] = p(codes[at], zone)
        if shape == CANONICAL:
            canonical[at] = (utc[at] != NONE) & (codes[at][:, 10] == ord("T"))
    return utc, canonical


def normalise_texts(df: DataFrame, text: str, zone: str = "Europe/Zurich") -> DataFrame:
    """df with `utc_us` (long, null if unusable) and `canonical` (a valid time in that notation)."""
    z = zone_table(zone)
    keep = [c for c in df.columns if c not in ("utc_us", "canonical")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("utc_us", T.LongType()), T.StructField("canonical", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers: dict[str, Parser | None] = {}
        for b in batches:
            utc, canonical = parse_texts(b.column(text).cast(pa.string()), z, parsers)
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(utc, mask=utc == NONE), pa.array(canonical)], names=schema.names)

    return df.mapInArrow(work, schema)


def normalise_pairs(df: DataFrame, local: str, utc: str, zone: str = "Europe/Zurich") -> DataFrame:
    """df's other columns with `utc_us` (the instant of the wall-clock time `local`, null if that
    is null) and `agrees` (the stated `utc` is that instant)."""
    z = zone_table(zone)
    keep = [c for c in df.columns if c not in (local, utc)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("utc_us", T.LongType()), T.StructField("agrees", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        micros = lambda a: a.cast(pa.timestamp("us", tz=a.type.tz)).cast(pa.int64())
        for b in batches:
            wall, said = micros(b.column(local)), micros(b.column(utc))
            none = wall.is_null().to_numpy(zero_copy_only=False)
            right = z.to_utc(wall.fill_null(0).to_numpy(zero_copy_only=False))
            agrees = said.is_valid().to_numpy(zero_copy_only=False) & ~none & (said.fill_null(0).to_numpy(zero_copy_only=False) == right)
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(right, mask=none), pa.array(agrees)], names=schema.names)

    return df.mapInArrow(work, schema)


def utc_text(us: str) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ, fractions cut off, `invalid` for null; independent of the session's zone."""
    s = F.floor(F.col(us) / SECOND)
    day = F.floor(s / 86_400)
    rest = s - day * 86_400
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))
    return F.coalesce(text, F.lit("invalid"))
