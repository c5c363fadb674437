"""Splitting oversized texts at natural boundaries.

Method: pointer doubling.  All boundaries of a text are nodes; every node is
joined to its farthest legal successor (the end of the next piece, with the
overlap counted in), then the successor table is squared again and again.
The set of reached nodes doubles in depth with each squaring, so all greedy
cuts come out after log2(pieces) steps, in parallel for all texts of an Arrow
batch.  A text's boundaries never leave its row, so nothing is shuffled.

A piece ends after a paragraph break, else a sentence, else a line, if the
piece is then at least half full, else after the last word that fits; only
where the window has none, at the size limit.  A first piece that ends after a
word is longer than the overlap, so no piece holds the one before it whole,
and every piece but the first begins exactly `overlap` characters before the
end of the piece before it.

Defined results: null gives no piece; an empty text and a text within the
limit are one piece as they are; repeated rows give their pieces once;
columns of the input with the same names as result columns are left out
unless they are kept as keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+")
_LINE = re.compile(r"\n[^\S\n]*")
_WORD = re.compile(r"\s+")
_KINDS = (_PARAGRAPH, _SENTENCE, _LINE, _WORD)


def _nodes(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted boundary positions with their kind (0 paragraph to 3 word, 4 forced), 0 and the length included."""
    kind: dict[int, int] = {}
    for k in (3, 2, 1, 0):
        for m in _KINDS[k].finditer(text):
            kind[m.end()] = k
    n = len(text)
    kind.pop(0, None)
    kind.pop(n, None)
    at = np.array([0, *sorted(kind), n], dtype=np.int64)
    step = limit - overlap
    forced = []
    gaps = np.flatnonzero(np.diff(at) > step)
    for g in gaps:
        first = max(at[g] - overlap, 0) + limit
        forced.append(np.arange(first, at[g + 1], step))
    kinds = np.array([3, *(kind[p] for p in at[1:-1].tolist()), 3], dtype=np.int8)
    if forced:
        extra = np.concatenate(forced)
        at = np.concatenate([at, extra])
        kinds = np.concatenate([kinds, np.full(len(extra), 4, dtype=np.int8)])
        order = np.argsort(at, kind="stable")
        at, kinds = at[order], kinds[order]
    return at, kinds


def cut_points(texts: list[str], limit: int, overlap: int) -> list[np.ndarray]:
    """For each text the ends of its pieces, by pointer doubling over the boundaries of all texts at once."""
    parts, kinds, base, top = [], [], [], 0
    for t in texts:
        a, k = _nodes(t, limit, overlap)
        parts.append(a + top)
        kinds.append(k)
        base.append(top)
        top += len(t) + 2 * limit + 2
    at, kind = np.concatenate(parts), np.concatenate(kinds)
    sizes = np.array([len(p) for p in parts])
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    last = np.repeat(heads + sizes - 1, sizes)
    origin = np.repeat(np.array(base), sizes)
    start = np.maximum(at - overlap, origin)
    start[heads] = at[heads]
    bound = start + limit
    index = np.arange(len(at))
    farthest = np.searchsorted(at, bound, side="right") - 1
    succ = np.minimum(farthest, last)
    done = at[last] <= bound
    chosen = np.where(done, last, -1)
    for k in range(4):
        of_kind = np.flatnonzero(kind == k)
        if not len(of_kind):
            continue
        j = np.searchsorted(of_kind, succ, side="right") - 1
        node = np.where(j >= 0, of_kind[np.maximum(j, 0)], -1)
        least = np.maximum(at, start + (limit // 2 if k < 3 else overlap))
        ok = (chosen < 0) & (node > index) & (at[np.maximum(node, 0)] > least)
        chosen = np.where(ok, node, chosen)
    jump = np.where(chosen < 0, np.maximum(succ, np.minimum(index + 1, last)), chosen)
    reached = np.zeros(len(at), dtype=bool)
    reached[heads] = True
    while True:
        more = jump[reached]
        grown = not reached[more].all()
        reached[more] = True
        if not grown:
            break
        jump = jump[jump]
    out = []
    for h, s, b in zip(heads, sizes, base, strict=True):
        here = np.flatnonzero(reached[h : h + s])
        out.append(at[h + here][1:] - b)
    return out


def split_oversized(df: DataFrame, text: str, keys: list[str], limit: int = 1800, overlap: int = 250, with_text: bool = True) -> DataFrame:
    """keys + (piece, begin, end[, piece_text]): the pieces of every text, in order from piece 0."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    base = df.select(*keys, F.col(f"`{text}`").alias("__t")).where("__t is not null").distinct()
    fields = [*[base.schema[k] for k in keys], T.StructField("piece", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]
    if with_text:
        fields.append(T.StructField("piece_text", T.StringType()))
    schema = T.StructType(fields)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            texts = b["__t"].tolist()
            ends = cut_points(texts, limit, overlap)
            rows = np.repeat(np.arange(len(b)), [len(e) for e in ends])
            end = np.concatenate(ends)
            number = np.concatenate([np.arange(len(e)) for e in ends])
            begin = np.where(number == 0, 0, np.concatenate([np.concatenate([[0], e[:-1]]) for e in ends]) - overlap).clip(0)
            out = b[keys].iloc[rows].reset_index(drop=True)
            out["piece"], out["begin"], out["end"] = number, begin, end
            if with_text:
                out["piece_text"] = [texts[r][x:y] for r, x, y in zip(rows, begin, end, strict=True)]
            yield out

    size = F.char_length("__t")
    whole = base.where(size <= limit).select(*keys, F.lit(0).alias("piece"), F.lit(0).alias("begin"), size.alias("end"), *([F.col("__t").alias("piece_text")] if with_text else []))
    return whole.unionByName(base.where(size > limit).mapInPandas(pieces, schema))
