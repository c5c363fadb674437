"""Repair of text from scanned pages.

Method.  Correction candidates for the distinct words come from an inverted
join over character q-grams; gradient-boosted trees rank them and choose the
replacements.  Pairs of lines are classified by two further boosted models:
whether a mark at a line end splits a word (over the distinct pairs of
fragments, those that furniture keeps apart included), and whether a line is
furniture (a running header or a page number) between its neighbours.

All models are trained here on damage simulated in a bounded sample of the
rows (`sample_rows`); word counts, candidates and decisions cover all rows.

Defined results: null and empty texts have no findings; texts without line
ends can only have misread words; codes (less than half letters) and words of
one or two characters are never replaced; the first and the last line of a
text interrupt nothing and are never furniture; a mark at a line end inside a designation (61850-, 9-2) joins nothing;
repeated rows give their findings once.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.edit import distance
from clausewright.llm.boosting import BoostedTrees
from clausewright.session import cut, join_checked

# Marks that split words at line ends.
MARKS = "-‐‑­¬"
_SPLIT = rf"(\p{{L}}+)[{MARKS}][ \t]*\r?\n[ \t]*(\p{{L}}+)"
_SPLIT_PY = re.compile(rf"([^\W\d_]+)[{MARKS}][ \t]*\r?\n[ \t]*([^\W\d_]+)")
#: What scanners read for a character, in lower case.
MISREAD = {"m": ["rn"], "n": ["ri"], "u": ["ii"], "o": ["0", "q"], "l": ["1", "|"], "i": ["1", "!"], "a": ["@"], "s": ["5"], "b": ["6"], "e": ["c"], "t": ["f"], "h": ["b"], "g": ["q"]}


# ---------------------------------------------------------------- words
def words(text: Column) -> Column:
    """Lower-case word tokens of a text; a word split at a line end is one token that no dictionary has."""
    whole = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, rf"[{MARKS}][ \t]*\r?\n\s*", "\x01")).otherwise(text)
    return F.split(F.lower(whole), r"[^\p{L}\p{N}@!|\x01]+")


def _usable(w: Column) -> Column:
    letters = F.length(F.regexp_replace(w, r"[^\p{L}]", ""))
    return (F.length(w) >= 3) & w.rlike(r"^[\p{L}\p{N}@!|]+$") & (letters * 2 >= F.length(w))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n): in how many distinct texts each word stands; copies of a text, however many, count once."""
    w = df.select(text).distinct().select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(_usable(F.col("word")))


def _grams(w: Column) -> Column:
    padded = F.concat(F.lit("^"), w, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.struct(F.substr(padded, i, F.lit(2)).alias("g"), i.cast("int").alias("at")))


def _least_shared(length: Column) -> Column:
    """How many grams a word must share with a target of this length."""
    return F.greatest(F.lit(2), F.ceil((length + 1) * 0.4))


def _shared(word: str, target: str) -> int:
    """Distinct grams of the word that the target has at the same place or one beside it."""
    at = {(t[i : i + 2], i) for t in (f"^{target}$",) for i in range(len(target) + 1)}
    w = f"^{word}$"
    return len({w[i : i + 2] for i in range(len(word) + 1) if any((w[i : i + 2], i + d) in at for d in (-1, 0, 1))})


def _index(trusted: DataFrame) -> DataFrame:
    """(g, at, len, target, m): the inverted index of the targets, by gram, place and length of the words to look up.

    A word that shares enough grams with a target shares one of any selection
    that leaves out fewer than it must share, so the commonest grams of each
    target are left out, which loses nothing.
    """
    t = trusted.select(F.col("word").alias("target"), F.col("n").alias("m"), F.explode(_grams(F.col("word"))).alias("q")).select("target", "m", "q.g", "q.at")
    often = t.select("target", "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    of = t.join(often.hint("merge"), "g").groupBy("target", "m", "g", "often").agg(F.collect_list("at").alias("places"))
    kinds = Window.partitionBy("target")
    of = of.withColumn("rank", F.row_number().over(kinds.orderBy("often", "g"))).withColumn("kinds", F.count(F.lit(1)).over(kinds))
    kept = of.where(F.col("rank") <= F.col("kinds") - _least_shared(F.length("target")) + 1)
    near = kept.select("target", "m", "g", F.explode(F.array_distinct(F.flatten(F.transform("places", lambda i: F.array(i - 1, i, i + 1))))).alias("at"))
    return near.select("g", "at", F.explode(F.sequence(F.length("target") - 2, F.length("target") + 2)).alias("len"), "target", "m")


_FEATURES = 7


def _features(word: str, n: int, target: str, m: int, shared: int) -> list[float]:
    d = distance(word, target)
    odd = sum(1 for c in word if not c.isalpha())
    return [d, np.log1p(m) - np.log1p(n), odd, len(target), shared / (len(target) + 1), d / len(target), abs(len(word) - len(target))]


def _ranker(vocabulary: list[tuple[str, int]], seed: int = 7) -> BoostedTrees:
    """Trees that tell the right replacement from others, from misreadings simulated in frequent words."""
    rng = random.Random(seed)
    names = [w for w, _ in vocabulary if w.isalpha()]
    count = dict(vocabulary)
    x, y = [], []
    often = lambda m: min(m, int(np.exp(rng.uniform(0, np.log1p(m)))))  # noqa: E731  # from once to as often as the word itself

    def shared(a: str, b: str) -> int:
        ga, gb = {f"^{a}$"[i : i + 2] for i in range(len(a) + 1)}, {f"^{b}$"[i : i + 2] for i in range(len(b) + 1)}
        return len(ga & gb)

    for _ in range(3000 if names else 0):
        w = rng.choice(names)
        spots = [i for i, c in enumerate(w) if c in MISREAD]
        if spots:
            t = list(w)
            for i in rng.sample(spots, 1 if rng.random() < 0.85 or len(spots) < 2 else 2):
                t[i] = rng.choice(MISREAD[t[i]])
            bad = "".join(t)
            if bad not in count:
                n = often(count[w])
                x.append(_features(bad, n, w, count[w], shared(bad, w)))
                y.append(1)
                # misread words are no replacements, neither of the right word nor of its other misreadings
                x.append(_features(w, count[w], bad, n, shared(w, bad)))
                y.append(0)
                t = list(w)
                i = rng.choice(spots)
                t[i] = rng.choice(MISREAD[t[i]])
                if (other := "".join(t)) != bad:
                    x.append(_features(other, rng.randint(1, n), bad, n, shared(other, bad)))
                    y.append(0)
        # sound words beside their neighbours: other words of the corpus, and rare ones one edit away
        v = rng.choice(names)
        if v != w and abs(len(v) - len(w)) <= 2:
            x.append(_features(v, rng.randint(1, count[v]), w, count[w], shared(v, w)))
            y.append(0)
        t = list(w)
        i = rng.randrange(len(w))
        letter = rng.choice("abcdefghijklmnopqrstuvwxyz")
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = letter
        elif kind == 1:
            t.insert(i, letter)
        else:
            t.pop(i)
        near = "".join(t)
        if near not in count and distance(near, w) >= 1:
            x.append(_features(near, often(count[w]), w, count[w], shared(near, w)))
            y.append(0)
    # frequent words that are one misreading apart are both sound
    usual = set(sorted(names, key=lambda w: (-count[w], w))[: len(names) // 2])
    for w in sorted(usual):
        for i, c in enumerate(w):
            for near in (w[:i] + m + w[i + 1 :] for m in MISREAD.get(c, []) if w[:i] + m + w[i + 1 :] in usual):
                if count[near] < count[w]:
                    for _ in range(20):  # beside as many rare misreadings of the same word
                        x.append(_features(near, count[near], w, count[w], shared(near, w)))
                        x.append(_features(near, rng.randint(1, max(1, count[w] // 50)), w, count[w], shared(near, w)))
                        y += [0, 1]
    if not x:
        x, y = [[9.0] * _FEATURES], [0]
    return BoostedTrees().fit(np.array(x, dtype=float), np.array(y, dtype=float))


def corrections(counts: DataFrame, ratio: int = 10, sample_words: int = 2000, least: int = 5) -> DataFrame:
    """(word, replacement): the misread words of a counted vocabulary.

    Trusted targets are words of letters only in at least `least` distinct
    texts; a candidate must stand in `ratio` times as many texts as the word,
    so a right word in fewer than `ratio` texts corrects nothing.  The ranker
    is fitted on the `sample_words` most frequent words.
    """
    trusted = counts.where(F.col("word").rlike(r"^\p{L}+$") & (F.col("n") >= least))
    top = [(r["word"], r["n"]) for r in trusted.where(F.col("word").rlike("^[a-z]+$")).orderBy(F.desc("n"), "word").limit(sample_words).collect()]
    model = _ranker(top)
    suspects = counts.where(F.col("n") * ratio <= (top[0][1] if top else 0)).select("word", "n", F.length("word").alias("len"), F.explode(_grams(F.col("word"))).alias("q")).select("word", "n", "len", "q.g", "q.at")
    found = join_checked(suspects, _index(trusted), ["g", "at", "len"]).where(F.col("m") >= ratio * F.col("n"))
    found = found.groupBy("word", "n", "target", "m").agg(F.lit(True).alias("__any")).drop("__any")

    @F.pandas_udf(T.IntegerType())
    def common(word: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([_shared(w, t) for w, t in zip(word, target, strict=True)], dtype="int32")

    found = found.withColumn("shared", common("word", "target")).where(F.col("shared") >= _least_shared(F.length("target")))

    @F.pandas_udf(T.DoubleType())
    def score(word: pd.Series, n: pd.Series, target: pd.Series, m: pd.Series, shared: pd.Series) -> pd.Series:
        if not len(word):
            return pd.Series([], dtype=float)
        return pd.Series(model.predict(np.array([_features(*r) for r in zip(word, n, target, m, shared, strict=True)])))

    ranked = found.withColumn("score", score("word", "n", "target", "m", "shared"))
    best = ranked.groupBy("word").agg(F.max_by(F.struct("target", "score"), F.struct("score", "m", "target")).alias("b"))
    return best.where("b.score > 0.5").select("word", F.col("b.target").alias("replacement"))


# ---------------------------------------------------------------- words split at line ends
def _join_features(a: str, b: str, joined: int, dashed: int, left: int, right: int) -> list[float]:
    return [np.log1p(joined), np.log1p(dashed), np.log1p(left), np.log1p(right), min(len(a), len(b)), len(a) + len(b), float(b[:1].islower())]


def _joiner(vocabulary: list[tuple[str, int]], seed: int = 11) -> BoostedTrees:
    """Trees that tell fragments of one word from two words, from words cut at random places and words set side by side."""
    rng = random.Random(seed)
    count = dict(vocabulary)
    names = [w for w in count if len(w) > 4 and w.isalpha()]
    x, y = [], []
    for _ in range(2500 if names else 0):
        w = rng.choice(names)
        i = rng.randint(2, len(w) - 2)
        a, b = w[:i], w[i:]
        # a tenth as words that stand nowhere else whole, told by fragments that are no words
        rare = rng.random() < 0.1 and not (count.get(a, 0) and count.get(b, 0))
        x.append(_join_features(a, b, 0 if rare else count[w], 0, count.get(a, 0), count.get(b, 0)))
        y.append(1)
        v, u = rng.choice(names), rng.choice(names)
        x.append(_join_features(v, u, count.get(v + u, 0), rng.randint(0, 200), count[v], count[u]))
        y.append(0)
    if not x:
        x, y = [[0.0] * 7], [0]
    return BoostedTrees(trees=25).fit(np.array(x, dtype=float), np.array(y, dtype=float))


def split_words(df: DataFrame, text: str, keys: list[str], counts: DataFrame, freed: DataFrame, sample_words: int = 2000) -> DataFrame:
    """keys + (left, right): the fragments of words that a mark splits at a line end.

    freed: keys + text of the records that had furniture, without it; a word may be split around such a line.
    """
    lines = df.select(*keys, text).unionByName(freed.select(*keys, text)).where(F.col(text).contains("\n"))
    pairs = lines.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_SPLIT), 0))).alias("__p"))
    pairs = pairs.select(*keys, F.regexp_extract("__p", _SPLIT, 1).alias("left"), F.regexp_extract("__p", _SPLIT, 2).alias("right")).distinct()
    dashed = df.where(F.col(text).contains("-")).select(F.explode(F.split(F.lower(text), r"[^\p{L}-]+")).alias("d")).where(F.col("d").contains("-")).groupBy("d").agg(F.count(F.lit(1)).alias("dashed"))
    kinds = pairs.select("left", "right").distinct()
    n = lambda c, name: counts.select(F.col("word").alias(c), F.col("n").alias(name))
    k = kinds.withColumn("w", F.lower(F.concat("left", "right"))).withColumn("d", F.lower(F.concat_ws("-", "left", "right"))).withColumn("l", F.lower("left")).withColumn("r", F.lower("right"))
    k = k.join(n("w", "joined"), "w", "left").join(dashed, "d", "left").join(n("l", "nl"), "l", "left").join(n("r", "nr"), "r", "left").na.fill(0)
    top = [(r["word"], r["n"]) for r in counts.where(F.col("word").rlike("^[a-z]+$")).orderBy(F.desc("n"), "word").limit(sample_words).collect()]
    model = _joiner(top)

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series, joined: pd.Series, dashed: pd.Series, nl: pd.Series, nr: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        return pd.Series(model.predict(np.array([_join_features(*r) for r in zip(a, b, joined, dashed, nl, nr, strict=True)])))

    good = k.withColumn("score", score("left", "right", "joined", "dashed", "nl", "nr")).where("score > 0.5").select("left", "right")
    return join_checked(pairs, cut(good, "split-pairs"), ["left", "right"]).select(*keys, "left", "right")


# ---------------------------------------------------------------- furniture
_PAGE = re.compile(r"^\W*(?:[^\W\d_]{1,6}\.?\s*)?\d{1,5}(?:\s*(?:/|[^\W\d_]{1,3})\s*\d{1,5})?\W*$")
_NUMBERED = re.compile(r"^\(?(?:\d{1,3}|[a-z])[.)]\s+[^\W\d_]")
_OPEN_DESIGNATION = re.compile(rf"\d[{MARKS}]\s*$")
_LINES = re.compile(r"\r?\n")


def _line_features(line: str, before: str, after: str) -> list[float]:
    s, p, a = line.strip(), before.rstrip(), after.lstrip()
    tokens = s.split()
    alpha = [t for t in tokens if t[:1].isalpha()]
    caps = sum(1 for t in alpha if t[0].isupper()) / len(alpha) if alpha else 1.0
    return [
        len(s),
        len(tokens),
        sum(c.isdigit() for c in s) / max(1, len(s)),
        float(s[:1].islower()),
        float(s[-1:] in ".;:,!?"),
        float(p[-1:].isalnum() or p[-1:] in MARKS + ",|)]–"),
        float(a[:1].islower()),
        caps,
        float(bool(_PAGE.match(s))),
        float(s.count("|")),
        float("...." in s),
        float("|" in p or "|" in a or "...." in p or "...." in a),
        float(not p) + float(not a),
        float(s[-1:] in MARKS),
        float(sum(s.count(x) for x in (". ", "; ", ", "))),
        float(bool(_NUMBERED.match(s))),
    ]


def _page_form(r: random.Random) -> str:
    n, m = r.randint(1, 700), r.randint(1, 900)
    return r.choice([f"- {n} -", f"– {n} –", f"[{n}]", f"({n})", f"{n}", f"Page {n} of {m}", f"Page {n}", f"p. {n}", f"pp. {n}", f"Sheet {n}/{m}", f"{n}/{m}", f"Seite {n}", f"Blatt {n} von {m}", f"Seite {n} / {m}", f"page {n}", f"Pág. {n}", f"{n} | Page"])


def _header_form(r: random.Random, names: list[str]) -> str:

    def title(k: int) -> str:
        words = [r.choice(names).capitalize() for _ in range(k)]
        if k > 1 and r.random() < 0.4:
            words.insert(k - 1, r.choice(["and", "of", "for", "to", "und"]))
        return " ".join(words)

    code = f"{''.join(r.choice('ABCDEFGHKLMNPQRSTVX') for _ in range(r.randint(1, 3)))}-{r.randint(10, 99999)}"
    h = r.choice([f"{title(r.randint(1, 2))} {code} | {title(r.randint(1, 3))}", f"{title(1)} {r.choice(['I', 'II', 'III', 'IV', 'V', '2', '3'])} {title(r.randint(1, 3))}", f"{title(r.randint(2, 4))} {code}", f"{title(1)} {code} – {title(2)}"])
    if r.random() < 0.3:
        h = h.upper()
    return f"{h}  {_page_form(r)}" if r.random() < 0.4 else h


def _furniture_model(texts: list[str], seed: int = 5) -> BoostedTrees:
    """Trees that tell furniture from lines of the text, from furniture set into lines of sampled texts."""
    r = random.Random(seed)
    names = sorted({w for t in texts[:500] for w in re.findall(r"\b[a-z]{4,12}\b", t)}) or ["general"]
    x, y = [], []
    for t in texts:
        lines = _LINES.split(t)
        plain = len(lines) < 3
        if plain:  # running text in one line: wrapped here
            ws = t.split(" ")
            w = r.randint(6, 14)
            lines = [" ".join(ws[i : i + w]) for i in range(0, len(ws), w)]
        for i in r.sample(range(len(lines)), min(10, len(lines))):
            if lines[i].strip():
                x.append(_line_features(lines[i], lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else ""))
                y.append(0)
        for _ in range(2):
            if len(lines) < 2:
                break
            i = r.randrange(1, len(lines))
            before, after = lines[i - 1], lines[i]
            if not before.strip() or not after.strip() or "...." in before + after:
                continue
            ws = before.split(" ")
            if before.rstrip()[-1:] in ".;:" and len(ws) > 3:
                before, after = " ".join(ws[:-2]), " ".join(ws[-2:]) + " " + after
            two = [_page_form(r), _header_form(r, names)] if r.random() < 0.3 else [r.choice([_page_form(r), _header_form(r, names)])]
            seq = [before, *two, after]
            for k in range(1, len(seq) - 1):
                x.append(_line_features(seq[k], seq[k - 1], seq[k + 1]))
                y.append(1)
    if not x:
        x, y = [[0.0] * 16], [0]
    xs, ys = np.array(x, dtype=float), np.array(y, dtype=float)
    first = BoostedTrees(trees=30, depth=3).fit(xs, ys)
    # the sampled rows hold real furniture too: what a first model takes for it is left out of the negatives
    keep = (ys == 1) | (first.predict(xs) < 0.3)
    return BoostedTrees(trees=60, depth=4).fit(xs[keep], ys[keep])


def _furniture_lines(texts: list[str], model: BoostedTrees) -> list[list[int]]:
    """The numbers of the furniture lines of each text."""
    rows, at, feats = [], [], []
    out: list[list[int]] = [[] for _ in texts]
    for k, t in enumerate(texts):
        lines = _LINES.split(t)
        for i, line in enumerate(lines):
            s = line.strip()
            if 0 < i < len(lines) - 1 and s:
                if not (s[0].islower() and not _PAGE.match(s) or s[-1] in MARKS and s[-2:-1].isalnum()):
                    if _OPEN_DESIGNATION.search(lines[i - 1]):
                        continue
                    rows.append(k)
                    at.append(i)
                    feats.append(_line_features(line, lines[i - 1], lines[i + 1]))
    if feats:
        for k, i, p in zip(rows, at, model.predict(np.array(feats)), strict=True):
            if p > 0.5:
                out[k].append(i)
    return out


def _without(text: str, lines: Iterable[int]) -> str:
    gone = set(lines)
    return "\n".join(x for i, x in enumerate(_LINES.split(text)) if i not in gone)


def furniture_model(df: DataFrame, text: str, sample_rows: int = 3000) -> BoostedTrees:
    """Fitted on at most sample_rows rows, chosen by the hash of the text, in expectation as many of each part of the data."""
    t = df.select(F.col(text).alias("t")).where(F.char_length("t") > 0)
    share = min(1.0, sample_rows / max(1, t.count()))
    place = F.pmod(F.xxhash64("t"), F.lit(1_000_000))
    chosen = t.where(place < F.lit(share * 1_000_000)).orderBy(place, "t").limit(sample_rows)
    return _furniture_model(sorted(r["t"] for r in chosen.collect()))


def furniture(df: DataFrame, text: str, keys: list[str], model: BoostedTrees) -> DataFrame:
    """keys + (lines, text): the numbers of the furniture lines of the texts that have any, and the text without them."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = _furniture_lines(b[text].tolist(), model)
            o = b[keys].copy()
            o["lines"] = found
            o[text] = [_without(t, f) if f else None for t, f in zip(b[text], found, strict=True)]
            yield o[[bool(f) for f in found]]

    return df.where(F.col(text).contains("\n")).select(*keys, text).mapInPandas(run, schema)


# ---------------------------------------------------------------- the whole
def scan_findings(df: DataFrame, text: str, keys: list[str], sample_rows: int = 3000) -> dict[str, DataFrame]:
    """furniture: keys + lines; splits: keys + (left, right); misread: keys + (word, replacement)."""
    base = df.where(F.col(text).isNotNull())
    counts = cut(word_counts(base, text), "word-counts")
    wrong = cut(corrections(counts), "corrections")
    tokens = base.select(*keys, F.explode(words(F.col(text))).alias("word"))
    lines = cut(furniture(base, text, keys, furniture_model(base, text, sample_rows)), "furniture")
    return {
        "furniture": lines.select(*keys, "lines"),
        "splits": split_words(base, text, keys, counts, lines),
        "misread": join_checked(tokens, wrong, ["word"]),
    }


def _cased(found: str, right: str) -> str:
    letters = [c for c in found if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right.capitalize() if found[:1].isupper() else right


def repair_scans(df: DataFrame, text: str, keys: list[str], sample_rows: int = 3000) -> DataFrame:
    """keys + (clean_text, furniture, splits, misread): the damaged records as continuous paragraphs, with counts of the repairs."""
    base = cut(df.select(*keys, text).distinct(), "texts")
    f = scan_findings(base, text, keys, sample_rows)
    none = F.lit(None)
    pair = lambda a, b: F.concat_ws("\t", a, b)
    marks = f["furniture"].select(*keys, F.col("lines").alias("__f"), none.cast("string").alias("__s"), none.cast("string").alias("__m"))
    marks = marks.unionByName(f["splits"].select(*keys, none.cast("array<int>").alias("__f"), pair("left", "right").alias("__s"), none.cast("string").alias("__m")))
    marks = marks.unionByName(f["misread"].select(*keys, none.cast("array<int>").alias("__f"), none.cast("string").alias("__s"), pair("word", "replacement").alias("__m")))
    # the findings meet first, so that each text moves once
    found = marks.groupBy(*keys).agg(F.first("__f", ignorenulls=True).alias("__f"), F.collect_set("__s").alias("__s"), F.collect_set("__m").alias("__m"))
    hurt = base.join(found, keys)
    schema = T.StructType([*[base.schema[k] for k in keys], T.StructField("clean_text", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("furniture", "splits", "misread")]])
    listed = lambda v: [] if v is None else list(v)
    token = re.compile(r"(?:[^\W_]|[@!|])+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, nf, ns, nm = [], [], [], []
            for t, fl, sl, ml in zip(b[text], b["__f"], b["__s"], b["__m"], strict=True):
                fl, sl, ml = listed(fl), {tuple(x.split("\t")) for x in listed(sl)}, dict(x.split("\t") for x in listed(ml))
                t = _without(t, fl)
                t = _SPLIT_PY.sub(lambda m: m[1] + m[2] if (m[1], m[2]) in sl else m[0], t)
                t = "\n\n".join(re.sub(r"(?<![\n])\n(?!\n|\s*(?:\d+[.)]|[-•*])\s)[ \t]*", " ", p) if "...." not in p and " | " not in p else p for p in re.split(r"\n[ \t]*\n", t))
                out.append(token.sub(lambda m: _cased(m[0], ml[m[0].lower()]) if m[0].lower() in ml else m[0], t))
                nf.append(len(fl))
                ns.append(len(sl))
                nm.append(len(ml))
            o = b[keys].copy()
            o["clean_text"], o["furniture"], o["splits"], o["misread"] = out, nf, ns, nm
            yield o

    return hurt.mapInPandas(run, schema)
