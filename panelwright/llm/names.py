"""Typed names of places brought to comparable parts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short forms of leading words, of trailing words, words that tell the level, and rows that name no place.
LEADING = {
    "sto": "santo", "sta": "santa", "s": "san", "sn": "san", "mt": "mount", "gen": "general", "genl": "general", "gov": "governor",
    "pres": "president", "pto": "puerto", "nva": "nueva", "n": "nueva", "vlla": "villa", "v": "villa", "bag": "bagong", "bgng": "bagong", "bgo": "bagong",
}
TRAILING = {"s": "sur", "sr": "sur", "n": "norte", "nte": "norte", "or": "oriental", "ori": "oriental", "ortl": "oriental", "oc": "occidental", "occ": "occidental", "occtl": "occidental", "occl": "occidental"}
TITLES = ("santo", "santa", "san", "mount", "general", "governor", "president", "puerto", "nueva", "villa", "bagong")
LEVELS = {"city": "city", "cty": "city", "c": "city", "lungsod": "city", "municipality": "municipality", "mun": "municipality", "bayan": "municipality", "province": "province", "prov": "province", "lalawigan": "province", "pgo": "province"}
NO_PLACE = r"^(sub-?\s*totals?|grand totals?|provincial totals?|totals?|continued|see note.*|nothing follows|no submission|notes?\b.*|source\b.*|prepared by.*|page \d+.*|n/?a|nan|none|null|-+|\.+|)$"

_TITLE = re.compile(r"^(" + "|".join(TITLES) + r")(?=.{4,}$)")
_LEVEL_WORD = r"(city|cty|c|lungsod|municipality|mun|bayan|province|prov|lalawigan)"
_PREFIX = re.compile(rf"^(?:the\s+)?{_LEVEL_WORD}\.?\s+(?:of|ng)\s+")
_PGO = re.compile(r"^pgo\.?\s+")
_SUFFIX_OF = re.compile(rf"[,;]?\s*{_LEVEL_WORD}\.?\s+(?:of|ng)$")
_SUFFIX = re.compile(r"\s+(city|municipality|province|prov|mun)\.?$")
_PAREN = re.compile(r"\(([^)]*)(?:\)|$)")
_DISTRICT = re.compile(r"[-–,]?\s*\b(?:legislative\s+)?dist(?:rict)?\.?\s*(?:[ivx]+|\d+|[a-z])?\s*$")
_NOTE = re.compile(r"[*†‡]+|\b\d+/|\s\d+\)")
_NO = re.compile(NO_PLACE)
_OCR = str.maketrans("01568", "olsbb")
_FOLD = str.maketrans("vfcqzeowyj", "bpkksiuuih")
_FOLD_CONSONANTS = str.maketrans("vfcqz", "bpkks")
SPECIAL = {"ø": "o", "ł": "l", "đ": "d"}


def plain(text: str | None) -> str:
    """Lower case without accents; n~ and blanks of any kind made regular."""
    t = unicodedata.normalize("NFKD", (text or "").lower().replace("n~", "n"))
    t = "".join(SPECIAL.get(c, c) for c in t if not unicodedata.combining(c))
    return " ".join(t.replace("‘", "'").replace("’", "'").split())


def parse(name: str | None) -> tuple[str, str, str, str, str]:
    """``(compact, title, core, level, note)`` of a typed name.

    ``compact`` is all letters in order; ``core`` lacks a leading title word;
    ``level`` is told by words around the name, '' if none; ``note`` holds what
    stood in brackets. A row that names no place, null and '' give ''.
    """
    return _parse(name)[:5]


def words(name: str | None) -> str:
    """The words of a typed name in order, short forms spelt out, with blanks between them; without the blanks it is ``parse``'s first part."""
    return _parse(name)[5]


@lru_cache(maxsize=20_000)
def _parse(name: str | None) -> tuple[str, str, str, str, str, str]:
    t = _NOTE.sub(" ", plain(name))
    level, notes = "", []
    for p in _PAREN.findall(t):
        p = p.strip()
        w = p.rstrip(".")
        if w in ("mun", "municipality", "city", "province", "prov"):
            level = level or LEVELS[w]
        elif w not in ("capital", "continued", "cont", "cont'd"):
            notes.append(p)
    if "(continued)" in t and _NO.match(_PAREN.sub(" ", t).strip()):
        return "", "", "", "", "", ""
    t = _DISTRICT.sub("", " ".join(_PAREN.sub(" ", t).split())).strip(" .,;-–")
    if _NO.match(t):
        return "", "", "", "", "", ""
    for _ in range(3):
        m = _PREFIX.match(t)
        if m:
            level = level or LEVELS[m.group(1)]
            t = t[m.end() :]
        m = _PGO.match(t)
        if m:
            level = "province"
            t = t[m.end() :]
        m = _SUFFIX_OF.search(t)
        if m:
            level = level or LEVELS[m.group(1)]
            t = t[: m.start()]
        m = _SUFFIX.search(t)
        if m and m.start() > 0:
            level = level or LEVELS[m.group(1)]
            t = t[: m.start()]
        t = t.strip(" .,;-–")
    if "," in t:
        a, b = (x.strip() for x in t.split(",", 1))
        t = f"{b} {a}" if b else a
    t = re.sub(r"-\s*", "", t)
    words = re.findall(r"[a-z0-9']+", t.translate(_OCR) if re.search("[a-z]", t) else t)
    words = [w.replace("'", "") for w in words if w.replace("'", "")]
    if len(words) > 1:
        words[0] = LEADING.get(words[0], words[0])
        words[-1] = TRAILING.get(words[-1], words[-1])
        words = ["del" if w == "dl" else w for w in words]
    if not words:
        return "", "", "", "", "", ""
    title = words[0] if len(words) > 1 and words[0] in TITLES else ""
    core = "".join(words[1:]) if title else "".join(words)
    return title + core, title, core, level, " ".join(notes), " ".join(words)


def parts(compact: str) -> tuple[str, str, str, str]:
    """Title, core, skeleton and consonants (of the core) of a compact name, as ``with_parts`` makes them."""
    m = _TITLE.match(compact)
    title = m.group(1) if m else ""
    core = compact[len(title) :]
    return title, core, skeleton(compact), consonants(core)


def level_of(typed: str | None) -> str:
    """The level a type column tells: province, city, municipality or ''."""
    t = plain(typed)[:1]
    return {"p": "province", "c": "city", "m": "municipality"}.get(t, "")


def skeleton(compact: str) -> str:
    """Letters folded where typists and scanners confuse them, doubled ones once."""
    t = compact.replace("ny", "n").translate(_FOLD).replace("h", "")
    return re.sub(r"(.)\1+", r"\1", t)


def consonants(compact: str) -> str:
    """Folded consonants in order, doubled ones once."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[aeiou]|(?<=n)y", "", compact.translate(_FOLD_CONSONANTS)))


_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


@lru_cache(maxsize=20_000)
def region_key(region: str | None) -> str:
    """The number of a region if its text tells it, else the letters of its name; '' if there is none."""
    t = plain(region)
    if t in ("", "nan", "none", "null", "-"):
        return ""
    m = re.match(r"(?:region|reg\.?|r)\s*0*([ivxlc]+|\d+)\b", t)
    if m:
        x = m.group(1)
        if x.isdigit():
            return str(int(x))
        total = 0
        for a, b in zip(x, [*x[1:], ""], strict=True):
            v = _ROMAN[a]
            total += -v if b and _ROMAN.get(b, 0) > v else v
        return str(total)
    return re.sub(r"[^a-z]", "", t)


def grams(compact: str, buckets: int) -> list[int]:
    """Hashed token nodes of a value: letter trigrams with borders, bigrams and trigrams of its skeleton and of its consonants.

    The consonants keep their order when a vowel is lost, doubled, confused or swapped with its neighbour.
    """
    s, k = f"^{compact}$", f"^{skeleton(compact)}$"
    c = f"^{consonants(compact)}$"
    out = {f"t{s[i : i + 3]}" for i in range(len(s) - 2)} | {f"k{k[i : i + 2]}" for i in range(len(k) - 1)} | {f"q{k[i : i + 3]}" for i in range(len(k) - 2)}
    out |= {f"c{c[i : i + 2]}" for i in range(len(c) - 1)} | {f"d{c[i : i + 3]}" for i in range(len(c) - 2)}
    return sorted({xxhash.xxh64_intdigest(g) % buckets for g in out})


def name_similarity(a: tuple[str, str, str, str, str], b: tuple[str, str, str, str, str]) -> Column:
    """Similarity in [0, 1] of two names given the columns ``(title, core, compact, skeleton, consonants)`` of each.

    Edits are counted three times: over all letters, over folded letters and
    over the consonants, so likely slips cost less than others. They are
    counted behind the title word where both names have one, since titles are
    common and say little; different titles do not match.
    """
    (ta, ca, na, ka, xa), (tb, cb, nb, kb, xb) = (tuple(map(F.col, x)) for x in (a, b))
    rel = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    whole = (rel(na, nb) + rel(ka, kb) + rel(xa, xb)) / 3
    core = (rel(ca, cb) + rel(xa, xb)) / 2
    same = (ta != "") & (ta == tb)
    differ = (ta != "") & (tb != "") & (ta != tb)
    cut = F.when((F.least(F.length(na), F.length(nb)) >= 5) & (F.startswith(na, nb) | F.startswith(nb, na)), F.lit(0.8)).otherwise(F.lit(0.0))
    return F.when(na == nb, F.lit(1.0)).when(same, F.least(whole, core + 0.1)).when(differ, 0.5 * whole).otherwise(F.greatest(whole, cut))


def with_parts(df: DataFrame, c: str) -> DataFrame:
    """Columns ``<c>_ti, _co, _sk, _cc``: title, core, skeleton and consonants (of the core) of a compact name, by expressions alone."""
    title = F.regexp_extract(F.col(c), r"^(" + "|".join(TITLES) + r")(?=.{4,}$)", 1)
    core = F.when(F.length(f"{c}_ti") > 0, F.expr(f"substring({c}, length({c}_ti) + 1)")).otherwise(F.col(c))
    folded = F.translate(F.regexp_replace(F.col(c), "ny", "n"), "vfcqzeowyjh", "bpkksiuuih")
    sk = F.regexp_replace(F.regexp_replace(folded, "h", ""), r"(.)\1+", "$1")
    cons = F.regexp_replace(F.translate(F.col(f"{c}_co"), "vfcqz", "bpkks"), r"[aeiou]|(?<=n)y", "")
    return df.withColumn(f"{c}_ti", title).withColumn(f"{c}_co", core).withColumn(f"{c}_sk", sk).withColumn(f"{c}_cc", F.regexp_replace(cons, r"(.)\1+", "$1"))
