"""Garbled text from wrong character encoding.

Method: a hidden Markov model with one clean state, one state per encoding
pair and one for characters lost for good labels the characters of a text; each
labelled span gets its state's inverse transform.

The clean state emits a character with its frequency in the sound part of the
corpus.  The state of a pair (UTF-8 read as X) emits the characters that the
bytes of one sound character become under X, with the frequency of that sound
character; what is no such sequence it can't emit.  Text in ASCII is the same
in all states, so the path through a run of it is known beforehand: stay,
or change at its edge.  Viterbi decoding then needs only the other characters,
and a text in which no sequence of any pair occurs is clean without decoding
(the states of the pairs can't emit it).  Character frequencies are counted
over all texts; there are at most as many as Unicode has characters.

Defined results: null and empty texts are sound; sound text in any language is
left as it is; lost characters (U+FFFD) mark a text as damaged but stay; a
text that also holds lost characters is restored where possible.  Text of one
single-byte encoding read as another is not told from sound text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The encodings as which UTF-8 is mistaken, and those mistaken twice.
PAIRS = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-15"]
TWICE = PAIRS
LOST = "�"


def _to_byte(encoding: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control of the same number, as decoders pass them."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table[c] = b
    return table


_BYTES = {e: _to_byte(e) for e in PAIRS}


def _class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) if c.isascii() else c for c in sorted(set(chars))) + "]"


def _sequence(encoding: str) -> str:
    """Pattern of the characters that one non-ASCII character in UTF-8 becomes under the encoding."""
    t = _BYTES[encoding]
    of = lambda lo, hi: _class([c for c, b in t.items() if lo <= b <= hi])
    rest = of(0x80, 0xBF)
    return f"{of(0xC2, 0xDF)}{rest}|{of(0xE0, 0xEF)}{rest}{{2}}|{of(0xF0, 0xF4)}{rest}{{3}}"


def suspicious_pattern() -> str:
    """Pattern that every text with damage matches."""
    return "|".join([LOST, *(_sequence(e) for e in PAIRS)])


def _decode(run: str, encoding: str) -> str | None:
    t = _BYTES[encoding]
    try:
        return bytes(t[c] for c in run).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


_FINDERS = {e: re.compile(_sequence(e)) for e in PAIRS}


def _units(text: str, i: int, state: str) -> list[tuple[int, str]]:
    """(length, sound character) of what the state may emit at i."""
    enc, _, twice = state.partition("*")
    if not twice:
        m = _FINDERS[enc].match(text, i)
        d = _decode(m.group(), enc) if m else None
        return [(m.end() - i, d)] if d and len(d) == 1 else []
    out = []
    for n in range(4, 13):  # two to four characters of two or three bytes each
        once = _decode(text[i : i + n], enc) if i + n <= len(text) else None
        if once and 2 <= len(once) <= 4:
            d = _decode(once, enc)
            if d and len(d) == 1:
                out.append((n, d))
                break
    return out


STATES = [*PAIRS, *(f"{e}*2" for e in TWICE)]
_ENTER, _LEAVE = -6.0, -2.0


def label(text: str, logp: dict[str, float], unseen: float) -> list[tuple[int, int, str, str]]:
    """(begin, end, state, restored) of the damaged spans, from the best path through the states.

    restored: the sound text of the span; of the lost state the characters as they are.
    """
    n = len(text)
    # only positions that a path reaches are kept, so a long run of ASCII costs one entry
    best: defaultdict[int, dict[str, float]] = defaultdict(dict)
    back: defaultdict[int, dict[str, tuple[int, str, str]]] = defaultdict(dict)
    best[0][""] = 0.0
    i = 0
    marks = [m.start() for m in re.finditer(r"[^\x00-\x7f]", text)]
    stops = iter([*marks, n])
    nxt = next(stops)
    while i < n:
        here = best.pop(i, None)
        if not here:
            i += 1
            continue
        while nxt < i:
            nxt = next(stops)
        if nxt > i:  # a run of ASCII: states stay; a change is taken at the next character
            for s, v in here.items():
                if v > best[nxt].get(s, -math.inf):
                    best[nxt][s] = v
                    back[nxt][s] = (i, s, text[i:nxt])
            i = nxt
            continue
        clean = max(here.items(), key=lambda kv: kv[1] + (_LEAVE if kv[0] else 0.0))
        into_clean = clean[1] + (_LEAVE if clean[0] else 0.0)
        c = text[i]
        if c == LOST:
            to = into_clean + _ENTER
            if to > best[i + 1].get("lost", -math.inf):
                best[i + 1]["lost"] = to
                back[i + 1]["lost"] = (i, clean[0], c)
        else:
            v = into_clean + logp.get(c, unseen)
            if v > best[i + 1].get("", -math.inf):
                best[i + 1][""] = v
                back[i + 1][""] = (i, clean[0], c)
            for s in STATES:
                stay, enter = here.get(s, -math.inf), into_clean + _ENTER
                frm, v0 = (s, stay) if stay >= enter else (clean[0], enter)
                for length, d in _units(text, i, s):
                    v = v0 + logp.get(d, unseen)
                    if v > best[i + length].get(s, -math.inf):
                        best[i + length][s] = v
                        back[i + length][s] = (i, frm, d)
        i += 1
    state = max(best[n], key=lambda s: best[n][s] + (_LEAVE if s else 0.0))
    spans: list[tuple[int, int, str, str]] = []
    i = n
    while i > 0:
        j, before, sound = back[i][state]
        if state and not text[j:i].isascii():
            if spans and spans[-1][0] == i and spans[-1][2] == state:
                b, e, s, r = spans.pop()
                spans.append((j, e, s, sound + r))
            else:
                spans.append((j, i, state, sound))
        i, state = j, before
    return spans[::-1]


_RUN = re.compile(r"[^\x00-\x7f]+")
_SUSPICIOUS = re.compile(suspicious_pattern())
#: Every sequence of a pair has two characters outside ASCII side by side.
_COARSE = rf"[^\x00-\x7F]{{2}}|{LOST}"


# Blocks of characters that any corpus may hold; each counts as seen once.
COMMON = [(0xA0, 0x180), (0x391, 0x3CA), (0x401, 0x460), (0x2010, 0x2045), (0x2190, 0x2300)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    for b in batches:
        for text in b["__t"]:
            for run in _RUN.findall(text):
                counts.update(_SUSPICIOUS.sub("", run) if len(run) > 1 else run)
    yield pd.DataFrame({"c": list(counts), "n": list(counts.values())}).astype({"c": object, "n": "int64"})


def character_frequencies(texts: DataFrame, column: str) -> tuple[dict[str, float], float]:
    """Log frequency of each character outside ASCII in the parts of the texts that match no pair, and of one unseen."""
    t = F.col(f"`{column}`").alias("__t")
    size = texts.agg(F.sum(F.char_length(t)).alias("n")).first()["n"] or 0
    part = texts.select(t).where(F.col("__t").rlike(r"[^\x00-\x7F]")).mapInPandas(_count, "c string, n long")
    counts = part.groupBy("c").agg(F.sum("n").alias("n")).collect()
    total = size + 1e4
    seen = {chr(c): 1.0 for lo, hi in COMMON for c in range(lo, hi)}
    for r in counts:
        seen[r["c"]] = seen.get(r["c"], 0.01) + r["n"]
    return {c: math.log(n / total) for c, n in seen.items()}, math.log(0.01 / total)


def repair_encoding(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys + (restored, states, lost): the damaged records with their text restored where possible.

    states: the distinct states of the spans; lost: whether characters are lost for good.
    """
    base = df.select(*keys, F.col(f"`{column}`").alias("__t")).where("__t is not null")
    logp, unseen = character_frequencies(base, "__t")
    schema = T.StructType([*[base.schema[k] for k in keys], T.StructField("restored", T.StringType()), T.StructField("states", T.ArrayType(T.StringType())), T.StructField("lost", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, restored, states, lost = [], [], [], []
            for k, text in enumerate(b["__t"]):
                if LOST not in text and not any(len(r) > 1 and _SUSPICIOUS.search(r) for r in _RUN.findall(text)):
                    continue
                spans = label(text, logp, unseen)
                if not spans:
                    continue
                out, at = [], 0
                for x, y, _, sound in spans:
                    out += [text[at:x], sound]
                    at = y
                rows.append(k)
                restored.append("".join(out) + text[at:])
                states.append(sorted({s for _, _, s, _ in spans}))
                lost.append(any(s == "lost" for _, _, s, _ in spans))
            o = b[keys].iloc[rows].reset_index(drop=True)
            o["restored"], o["states"], o["lost"] = pd.Series(restored, dtype=object), pd.Series(states, dtype=object), pd.Series(lost, dtype=bool)
            yield o

    return base.where(F.col("__t").rlike(_COARSE)).mapInPandas(run, schema)
