"""Token counts per section by offset-mapped attribution.

A whole document is encoded once. The byte spans of its tokens are joined to the
spans of its sections: the sections cover the text without gaps, so each token
meets one section, or several if it crosses a boundary. A crossing token counts
whole in one of them, by ``rule``: "first" gives it to the section of its first
byte, "most" to the section that holds most of its bytes (the earlier on a tie).
So the counts of a document's sections add up to its tokens.

A section is a line with its line end; the last may have none. Defined cases: a
null or empty text has one empty section (0, 0) with no tokens; repeated rows
and null ids keep their own rows; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm import texts as X
from linklens.llm.tokens import SegmentLengths, default_path, opened

RESULT = "doc_id long, section int, start int, end int, n_tokens long, n_crossing long"


def attribute(token_ends: np.ndarray, section_starts: np.ndarray, rule: str
              ) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses) for tokens and sections of one
    sequence of bytes, both without gaps; sections ascend and begin at 0."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_starts, starts, side="right") - 1
    last = np.searchsorted(section_starts, np.maximum(token_ends - 1, starts), side="right") - 1
    crosses = last > first
    if rule == "first" or not crosses.any():
        return first, crosses
    section = first.copy()
    bounds = np.append(section_starts, token_ends[-1])
    for t in np.flatnonzero(crosses):
        s = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[s + 1], token_ends[t]) - np.maximum(bounds[s], starts[t])
        section[t] = s[np.argmax(held)]
    return section, crosses


def token_counts(docs: DataFrame, tokenizer: str | None = None, rule: str = "first") -> DataFrame:
    """One row per section: (doc_id, section, start, end, n_tokens, n_crossing), where
    start and end are byte offsets and n_crossing of the tokens cross a boundary."""
    if rule not in ("first", "most"):
        raise ValueError(f"unknown rule: {rule}")
    path = tokenizer or default_path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = opened(SegmentLengths, path)
        for b in batches:
            for row, data, off in X.pieces(b.column(1)):
                raw = data.tobytes()
                lengths = [segments.lengths(raw[s:e])
                           for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
                ends = np.cumsum(np.frombuffer(b"".join(lengths), dtype=np.uint32).astype(np.int64))
                # a section begins where a text begins and after each line end inside it
                after = np.flatnonzero(data == 10) + 1
                after = after[~np.isin(after, off)]
                begins = np.concatenate([off[:-1], after])
                doc = np.concatenate([np.arange(len(off) - 1),
                                      np.searchsorted(off, after, side="right") - 1])
                order = np.lexsort((doc, begins))
                begins, doc = begins[order], doc[order]
                finish = np.append(begins[1:], len(data))
                tokens = np.zeros(len(begins), dtype=np.int64)
                crossing = np.zeros(len(begins), dtype=np.int64)
                if len(ends):
                    filled = np.flatnonzero(finish > begins)
                    section, crosses = attribute(ends, begins[filled], rule)
                    tokens[filled] = np.bincount(section, minlength=len(filled))
                    crossing[filled] = np.bincount(section[crosses], minlength=len(filled))
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row + doc)), pa.array(number.astype(np.int32)),
                     pa.array((begins - off[doc]).astype(np.int32)),
                     pa.array((finish - off[doc]).astype(np.int32)),
                     pa.array(tokens), pa.array(crossing)],
                    names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return rows.mapInArrow(count, RESULT)


def op5_token_counts(docs: DataFrame) -> DataFrame:
    """Counts of every section of every document."""
    return token_counts(docs)
