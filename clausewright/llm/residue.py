"""Template residue and error-page text.

Method: positive-unlabelled naive Bayes by expectation-maximization.  Records
that mostly consist of passages with sure signs (seed patterns) are trusted;
their passages with a sign are positive, those beside them begin with even
odds, and all others are unlabelled.  Every round re-estimates
the word and word-pair frequencies of both classes from the current
probabilities of all distinct passages, and the probabilities from the
frequencies.  Then the passages of all records are scored, and a record holds
residue if one of its passages does.

Features are hashed once per distinct passage and written as numbers; a round
only looks them up and adds.  The model is a table of `BUCKETS` hashed
features, so what the driver gathers and sends has a fixed size whatever the
corpus, and only the sums per feature move.

Defined results: null and empty texts hold no residue; passages longer than
any real notice are scored like others; repeated rows give one row; without
a trusted record no record is found.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.session import cut

# Sure signs of residue.
SEEDS = [
    r"\{\{.*?\}\}", r"\$\{\w+\}", r"@@\w+@@", r"<<\w+>>", r"(?<!\w)%[a-z]\w+%(?!\w)", r"\[(?:INSERT|ENTER|YOUR|ADD)\b[^\]]*\]", r"<(?:enter|insert|your|add) [^>]*>", r"\[[^\]]* goes here\]", r"(?<![\w}])\{\w+\}(?![\w{])",
    r"(?i)lorem ipsum", r"(?i)\b(?:asdf|qwer|qwertz|yxcv|xxxx)\b", r"(?i)your text here", r"(?i)click here to add", r"(?i)\bdummy (?:text|paragraph|wording)\b",
    r"(?i)^(?:http )?(?:error|fehler|erreur)(?: code)? \d{3}\b", r"(?i)\b(?:404|403|410|500|502|503)\b.*(?:not found|forbidden|gone|internal|unavailable)", r"(?i)^(?:page|file|document) not found", r"(?i)^oops\b", r"(?i)^access (?:denied|forbidden)", r"(?i)\bsomething went wrong\b", r"(?i)^too many requests",
    r"(?i)(?:enable|turn on|switch on|activate|aktivieren|activez|active) (?:sie )?java-?script", r"(?i)activation de java-?script", r"(?i)^type (?:the|your|a) .*(?:here|box)\.?$", r"(?i)^noscript\b", r"(?i)^(?:unhandled|uncaught) exception",
]
# Each sign above holds one of these, in lower case; most passages hold none and need no pattern.
HOLDS = ["{", "$", "@@", "<<", "%", "[", "<", "lorem ipsum", "asdf", "qwer", "yxcv", "xxxx", "your text here", "click here to add", "dummy", "error", "fehler", "erreur", "404", "403", "410", "500", "502", "503", "not found", "oops", "denied", "forbidden", "went wrong", "too many requests", "script", "type ", "exception"]
_SEED = re.compile("|".join(f"(?i:{s[4:]})" if s.startswith("(?i)") else f"(?:{s})" for s in SEEDS))
_END = re.compile(r"[.!?] +")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[{}<>\[\]$@%|_\"]+")
BUCKETS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGES = np.array([1, 2], dtype=np.uint64)  # before the first and after the last token


def passages(text: str) -> list[str]:
    """The lines and sentences of a text, trimmed."""
    out = []
    for line in text.split("\n"):
        at = 0
        for m in _END.finditer(line):
            out.append(line[at : m.start() + 1].strip())
            at = m.end()
        out.append(line[at:].strip())
    return [p for p in out if p]


def held(text: str) -> list[str]:
    """Which of HOLDS stand in a text."""
    low = text.lower()
    return [h for h in HOLDS if h in low]


def has_sign(passage: str, holds: list[str]) -> bool:
    """Whether a seed pattern occurs; holds: what its text holds."""
    if not holds:
        return False
    low = passage.lower()
    return any(h in low for h in holds) and _SEED.search(passage) is not None


class _Ids(dict):
    """Token to number; digits are one token, case doesn't matter."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[token] = 3 + zlib.crc32(b"#" if token.isdigit() else token.lower().encode())
        return n


_IDS = _Ids()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, buckets): the distinct words and word pairs of each passage, hashed; every passage has one at least."""
    ids = [list(map(_IDS.__getitem__, _TOKEN.findall(p))) for p in texts]
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint64, count=int(sizes.sum()))
    begin = np.cumsum(sizes + 2) - sizes - 2  # each passage with an edge on both sides
    line = np.empty(len(flat) + 2 * len(ids), dtype=np.uint64)
    of = np.repeat(np.arange(len(ids)), sizes + 2)
    inner = np.ones(len(line), dtype=bool)
    inner[begin] = inner[begin + sizes + 1] = False
    line[begin], line[begin + sizes + 1], line[inner] = _EDGES[0], _EDGES[1], flat
    follows = np.ones(len(line), dtype=bool)
    follows[begin + sizes + 1] = False
    at = np.flatnonzero(follows)
    hashed = np.concatenate([flat * _MIX, (line[at] * _MIX ^ line[at + 1]) * _MIX])
    hashed ^= hashed >> np.uint64(29)
    hashed = (hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)
    both = np.sort(np.concatenate([of[inner], of[at]]).astype(np.int64) * BUCKETS + hashed.astype(np.int64))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return np.searchsorted(both, np.arange(len(ids)) * BUCKETS), (both % BUCKETS).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _log_odds(sums: pd.DataFrame, strength: float = 50.0) -> np.ndarray:
    """Per feature the log ratio of its frequencies in residue and elsewhere; features never seen count for neither."""
    pos, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    pos[sums["f"]], every[sums["f"]] = sums["p"], sums["n"]
    neg = np.maximum(every - pos, 0)
    back = (every + 1e-3) / (every + 1e-3).sum()
    return np.log((pos + strength * back) / (pos.sum() + strength)) - np.log((neg + strength * back) / (neg.sum() + strength))


class ResidueModel:
    """Log odds per feature and of the class."""

    def __init__(self, odds: np.ndarray, prior: float) -> None:
        self.odds, self.prior = odds, prior

    def probabilities(self, texts: list[str], step: int = 4000) -> np.ndarray:
        """Of residue, for each passage; some thousands at a time, so that the work stays in the processor's caches."""
        out = []
        for i in range(0, len(texts), step):
            starts, f = features(texts[i : i + step])
            out.append(_sigmoid(self.prior + np.add.reduceat(self.odds[f], starts)))
        return np.concatenate(out)


def _distinct_passages(df: DataFrame, text: str, trusted_share: float, trusted_passages: int) -> DataFrame:
    """(p, trusted, sign): the distinct passages, whether most of their uses are in trusted records, and whether they hold a sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list] = {}  # uses, trusted uses, sign
            for t in b.column(0).to_pylist():
                here, holds = [], held(t or "")
                for p in passages(t or ""):
                    at = seen.get(p)
                    if at is None:
                        at = seen[p] = [0, 0, has_sign(p, holds)]
                    here.append(at)
                trusted = len(here) <= trusted_passages and sum(at[2] for at in here) >= trusted_share * len(here)
                for at in here:
                    at[0] += 1
                    at[1] += trusted
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array(c) for c in zip(*seen.values(), strict=True))], names=["p", "n", "t", "sign"])

    got = df.select(F.col(f"`{text}`")).mapInArrow(run, "p string, n long, t long, sign boolean")
    return got.groupBy("p").agg((F.sum("t") * 2 > F.sum("n")).alias("trusted"), F.bool_or("sign").alias("sign"))


def fit_residue(df: DataFrame, text: str, rounds: int = 4, trusted_share: float = 0.25, trusted_passages: int = 15) -> ResidueModel | None:
    """The model, from all distinct passages; None where no record can be trusted."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                starts, buckets = features(b.column("p").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("start"), pa.ListArray.from_arrays(np.append(starts, len(buckets)).astype(np.int32), buckets)], names=["start", "f"])

    # 1: positive; 0.5: beside a positive passage in a trusted record, even odds to begin with; 0: unlabelled
    start = F.when(F.col("trusted"), F.when(F.col("sign"), 1.0).otherwise(0.5)).otherwise(0.0)
    known = _distinct_passages(df, text, trusted_share, trusted_passages).select("p", start.alias("start"))
    known = cut(known.mapInArrow(hashed, "start double, f array<int>"), "passages")
    n = known.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("start") == 1).alias("t")).first()
    if not n["t"]:
        return None
    model = None
    for _ in range(rounds + 1):

        def sums(batches: Iterator[pa.RecordBatch], model: ResidueModel | None = model) -> Iterator[pa.RecordBatch]:
            pos, every, total = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0
            for b in batches:
                if not b.num_rows:
                    continue
                lists, start = b.column("f"), np.asarray(b.column("start"))
                f = np.asarray(lists.flatten())
                offsets = np.asarray(lists.offsets)
                offsets = offsets - offsets[0]
                w = start
                if model is not None:
                    w = _sigmoid(np.where(start > 0, 0.0, model.prior) + np.add.reduceat(model.odds[f], offsets[:-1]))
                    w = np.where(start == 1, 1.0, w)
                every += np.bincount(f, minlength=BUCKETS)
                pos += np.bincount(f, weights=np.repeat(w, np.diff(offsets)), minlength=BUCKETS)
                total += float(w.sum())
            at = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(pos[at], total)), pa.array(np.append(every[at], 0.0))], names=["f", "p", "n"])

        got = known.mapInArrow(sums, "f long, p double, n double").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toPandas()
        positive = float(got.loc[got["f"] == -1, "p"].iloc[0])
        share = min(0.5, max(positive, 1.0) / n["n"])
        model = ResidueModel(_log_odds(got[got["f"] >= 0]), float(np.log(share / (1 - share))))
    return model


def score_residue(df: DataFrame, text: str, keys: list[str], model: ResidueModel | None, threshold: float = 0.9) -> DataFrame:
    """keys + (residue, passages, passage): the records that hold residue, how many of their passages do, and the surest one."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("residue", T.IntegerType()), T.StructField("passages", T.IntegerType()), T.StructField("passage", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [passages(t) for t in b[text]]
            known: dict[str, int] = {}
            for ps in parts:
                for p in ps:
                    known.setdefault(p, len(known))
            rows, count, total, best = [], [], [], []
            if known:
                score = model.probabilities(list(known))
                hit = set(np.flatnonzero(score > threshold).tolist())
                for k, ps in enumerate(parts):
                    at = [i for i in map(known.__getitem__, ps) if i in hit]
                    if at:
                        rows.append(k)
                        count.append(len(at))
                        total.append(len(ps))
                        best.append(max((score[known[p]], p) for p in ps if known[p] in hit)[1])
            o = b[keys].iloc[rows].reset_index(drop=True)
            o["residue"], o["passages"], o["passage"] = count, total, best
            yield o.astype({"residue": "int32", "passages": "int32", "passage": object})

    base = df.select(*keys, text).where(F.col(text).isNotNull())
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    return base.mapInPandas(run, schema)
