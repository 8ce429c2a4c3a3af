"""Text that was decoded with the wrong character encoding: found, and restored where that is possible.

Round-trip repair. Every run of non-ASCII characters is encoded again under
each candidate legacy encoding and strictly decoded as the encoding it was
meant to be, over and over for nested layers. A repair is accepted when the
garbling cost of the run in its place drops. The cost tells how odd characters
stand to their neighbours: an accented capital inside a lower-case word, box
drawing, control characters, scripts mixed inside a word.

Work is per run and its two neighbours, and runs repeat, so a worker decides
each distinct case once. There is no shuffle; documents of plain ASCII text are
passed by in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Legacy encodings a text may have been read in.
SINGLE = ("cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
DOUBLE = ("gbk", "big5", "shift_jis", "euc_kr")
#: Encodings other than UTF-8 that a text may have been meant in.
MEANT = ("cp1252", "mac_roman")
DROP, HINTED, REMEMBERED = 1.2, 0.9, 48

#: Characters that are common in texts of Western languages (fixed values).
COMMON_LOWER = set("áéíóúñüãõçâêôàèìòùäöëïîû")
#: Of these the ones that seldom begin or end a word; quotation marks turn into them.
EDGELESS = set("ìîöëïäûò")
OPENING, CLOSING, DASHES = set("“‘«¿¡"), set("”’»…"), set("–—")
LONE = set("éàáóúèêô")
SIGNS = set("₱±≈≥≤→←×÷°º§©®€£¥¢•·≠²³½¼¾µ")

_RUN = re.compile(r"[^\x00-\x7f]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}")


def _tables() -> tuple[dict, dict]:
    """Per single-byte encoding the byte of each character and the reverse; bytes it leaves undefined stand for themselves."""
    to_byte, to_char = {}, {}
    for enc in SINGLE:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(enc))
            except UnicodeDecodeError:
                chars.append(chr(b))
        to_char[enc] = chars
        to_byte[enc] = {c: b for b, c in reversed(list(enumerate(chars)))}
    return to_byte, to_char


def _kind(c: str) -> str:
    """A coarse class of a character: l u d s (space) p (ASCII punctuation) c (CJK) g (other script letter) x (other)."""
    if not c:
        return "s"
    o = ord(c)
    if o < 128:
        return "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "d" if c.isdigit() else "s" if c.isspace() else "p"
    if c == "\xa0":
        return "s"
    if 0x2E80 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7AF or 0xF900 <= o <= 0xFAFF or 0xFF00 <= o <= 0xFFEF:
        return "c"
    cat = unicodedata.category(c)
    if cat[0] == "L":
        if o < 0x250:
            return "u" if cat == "Lu" else "l"
        return "g"
    return "x"


def cost(left: str, run: str, right: str) -> float:
    """How garbled a run looks between its neighbours; clean text of any language costs little."""
    s = left[-1:] + run + right[:1]
    at = len(left[-1:])
    total = 0.0
    for i in range(at, at + len(run)):
        c, o = s[i], ord(s[i])
        a, b = (s[i - 1] if i else ""), (s[i + 1] if i + 1 < len(s) else "")
        if o < 128:
            continue  # letters that a double-byte decoding had swallowed
        ka, kb = _kind(a), _kind(b)
        alone = ka in "sp" and kb in "sp"
        word = ka in "lu" and kb in "lu"
        if c == "�" or 0x80 <= o < 0xA0:
            total += 4.0
        elif 0x2500 <= o <= 0x25FF or 0xE000 <= o <= 0xF8FF:
            total += 3.0
        elif c == "\xa0":
            total += 0.3
        elif c == "\xad" or unicodedata.category(c) in ("Mn", "Cf"):
            total += 2.0
        elif c in DASHES:
            total += 0.2 if (ka in "sdpcx" or kb in "sdpcx") and not word else 2.5
        elif c in OPENING:
            total += 0.2 if ka in "spcx" and kb in "ludcpx" and kb != "s" else 2.0
        elif c == "…":
            total += 0.3
        elif c in CLOSING:
            total += 0.2 if (ka in "ludpcx" and kb in "spcx") or (c == "’" and ka in "lud" and kb in "lus") else 2.0
        elif c == "₱":
            total += 0.1 if kb == "d" else 0.8
        elif c == "±":
            total += 0.2 if kb in "ds" and ka in "spd" else 2.0
        elif c == "º" or c == "ª" or c == "°":
            total += 0.3 if ka == "d" or (ka == "l" and kb in "sp") else 2.0
        elif c in SIGNS:
            total += 0.4 if ka in "sdpx" and kb in "sdpx" else 1.5 if not word else 2.5
        else:
            k = _kind(c)
            if k == "c":
                cjk_near = ka == "c" or kb == "c"
                total += 0.3 if cjk_near else 0.9 if not (ka == "l" or kb == "l") else 2.8
            elif k == "g":
                same = (ka == "g" and kb in "gsp") or (kb == "g" and ka in "gsp")
                total += 0.3 if same else 2.5
            elif k == "l":
                base = 0.1 if c in COMMON_LOWER else 1.6
                odd = 0.2 if alone and c in LONE else 2.4 if alone else 1.2 if (ka not in "lu" and kb not in "lu") or ka in "xgc" or kb in "xgc" else 0.0
                edge = 1.9 if c in EDGELESS and not word and not alone else 0.0
                # an apostrophe read as a letter: doesnít
                cut = 2.5 if c in "íÕ" and a == "n" and b == "t" and i == at + len(run) - 1 and len(right) > 1 and not right[1].isalpha() else 0.0
                total += base + odd + edge + cut + (0.6 if ka == "u" and kb == "u" else 0.0)
            elif k == "u":
                base = 0.2 if c.lower() in COMMON_LOWER else 1.6
                inside = ka == "l"
                odd = 0.2 if alone and c.lower() in LONE else 2.4 if alone else 1.0 if (kb not in "lu" and ka not in "lu") or ka in "xg" or kb in "xgc" else 0.0
                total += base + (2.0 if inside else 0.0) + odd
            else:
                total += 2.0
    return total


def _candidates(run: str) -> Iterator[tuple[str, str, str]]:
    """Round trips of a run: ``(text, read as, meant as)``; only what encodes and strictly decodes."""
    to_byte, to_char = _TABLES
    for enc in SINGLE:
        m = to_byte[enc]
        codes = [m.get(c) for c in run]
        if any(b is not None and b >= 0xC2 for b in codes):
            raw = bytes(255 if b is None else b for b in codes)
            out, last, hit = [], 0, False
            for f in _UTF8.finditer(raw):
                out += [run[last : f.start()], f.group().decode("utf-8")]
                last, hit = f.end(), True
            if hit:
                yield "".join(out) + run[last:], enc, "utf-8"
        if None not in codes:
            for meant in MEANT:
                if meant != enc:
                    yield "".join(to_char[meant][b] for b in codes), enc, meant
    for enc in DOUBLE:
        try:
            raw = run.encode(enc)
        except UnicodeEncodeError:
            continue
        for meant in ("utf-8", *MEANT[:1]):
            try:
                t = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            if t != run:
                yield t, enc, meant


_TABLES = _tables()


def repair_run(left: str, run: str, right: str, hint: str = "") -> tuple[str, tuple[str, ...]]:
    """The repaired run and the layers taken off, outermost first; the run itself if nothing lowers its cost enough.

    ``hint`` is the round trip that the rest of the text calls for; it is
    favoured, and a smaller drop of the cost is enough for it. Every layer
    lowers the cost by ``DROP - HINTED`` at least and no cost is negative, so
    layers are taken off until none is left, however deep they lie. Only runs
    of up to ``REMEMBERED`` characters are remembered by a worker, so that long
    ones, which do not repeat, take no memory.
    """
    return (_remembered if len(run) <= REMEMBERED else _repair_run)(left, run, right, hint)


def _repair_run(left: str, run: str, right: str, hint: str) -> tuple[str, tuple[str, ...]]:
    layers: list[str] = []
    while _RUN.search(run):
        now = cost(left, run, right)
        best, how, low = run, "", now - DROP
        for t, enc, meant in _candidates(run):
            name = f"{enc}>{meant}"
            # a repair between two legacy encodings proves less than a strict UTF-8 decode, so it has to gain more
            c = cost(left, t, right) + (0.0 if meant == "utf-8" else 0.5 if meant == "cp1252" else 1.0) - (HINTED if name == hint else 0.0)
            if c < low or (c == low and not how):
                best, how, low = t, name, c
        if not how:
            break
        run = best
        layers.append(how)
    return run, tuple(layers)


_remembered = lru_cache(maxsize=100_000)(_repair_run)


def repair(text: str) -> tuple[str, list[str], int]:
    """``(restored text, layers taken off, places that stay garbled)`` of one text.

    A first pass finds the round trip most runs call for; only a text that has
    one is gone over again with it as a hint.
    """
    votes: dict[str, int] = {}
    for m in _RUN.finditer(text):
        a, b = m.span()
        _, layers = repair_run(text[max(0, a - 1) : a], m.group(), text[b : b + 2])
        for x in layers[:1]:
            votes[x] = votes.get(x, 0) + 1
    hint = max(votes, key=lambda x: (votes[x], x.endswith("cp1252"), x)) if votes else ""
    used: dict[str, None] = {}
    lost = 0

    def sub(m: re.Match) -> str:
        nonlocal lost
        a, b = m.span()
        out, layers = repair_run(text[max(0, a - 1) : a], m.group(), text[b : b + 2], hint)
        used.update(dict.fromkeys(layers))
        if any(c == "\ufffd" or "\x80" <= c < "\xa0" or "\u2500" <= c <= "\u25ff" or "\ue000" <= c <= "\uf8ff" for c in out):
            lost += 1
        return out

    return _RUN.sub(sub, text), list(used), lost


def restore(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The affected documents: ``(key, restored, layers, n_lost, complete)``.

    A document is affected if a repair was accepted anywhere in it, or if it
    holds characters that only a wrong decoding leaves (the replacement
    character, C1 controls, box drawing in running text). ``complete`` tells that none of
    the latter remain; places that cannot be restored are left as they are.

    Defined results: null and empty texts are never affected; correct accents,
    signs and scripts of any language are left alone; texts of any length are
    read whole, character runs being decided one by one; repeated rows are all
    returned; extra columns are not read.
    """

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, texts, layers, lost = [], [], [], []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                r, used, n = repair(t)
                if used or n:
                    keys.append(k)
                    texts.append(r)
                    layers.append(used)
                    lost.append(n)
            yield pd.DataFrame({"k": pd.Series(keys, dtype=pdf["k"].dtype), "restored": pd.Series(texts, dtype=object), "layers": pd.Series(layers, dtype=object), "n_lost": pd.Series(lost, dtype="int64")})

    some = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7F]"))
    out = some.mapInPandas(fix, f"k {dict(docs.dtypes)[key]}, restored string, layers array<string>, n_lost bigint")
    return out.select(F.col("k").alias(key), "restored", "layers", "n_lost", (F.col("n_lost") == 0).alias("complete"))
