"""Token counts of fields and sections from one encoding of the whole document.

A document is its fields, joined by a line break. It is encoded once; each token's span of
code points is joined with the sections' intervals (every other field is one section, the
text has one for each line; a line break counts with what it ends). Tokens that cross a
boundary go to a section by the rule named: ``first`` (where the first code point is),
``largest`` (which holds most of it, the earlier one if equal), or ``split`` (each section's
share of its code points).

Defined cases: a null field is empty, and an empty section has no tokens; repeated rows are
counted each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackline.llm.tokens import ChunkOffsets

RULES = ("first", "largest", "split")


def attributed(spans: np.ndarray, edges: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of these cross one of its boundaries.

    spans: rows (start, end) by start. edges: the sections' starts and the last one's end.
    """
    n = len(edges) - 1
    starts = edges[:-1]
    begin = np.clip(np.searchsorted(starts, spans[:, 0], "right") - 1, 0, n - 1)
    final = np.clip(np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1, 0, n - 1)
    over = np.flatnonzero(final > begin)
    held = np.bincount(np.delete(begin, over), minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    for t in over:
        at = np.arange(begin[t], final[t] + 1)
        inside = np.minimum(edges[at + 1], spans[t, 1]) - np.maximum(edges[at], spans[t, 0])
        crossing[at[inside > 0]] += 1
        if rule == "first":
            held[begin[t]] += 1
        elif rule == "largest":
            held[at[inside.argmax()]] += 1
        else:
            held[at] += inside / inside.sum()
    return held, crossing


def section_tokens(documents: DataFrame, tokenizer: str, fields: tuple[str, ...] = ("source", "lang"), text_col: str = "text", id_col: str = "doc_id", rule: str = "largest") -> DataFrame:
    """A row for each field and each line of the text: its span, tokens and crossing tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = documents.schema[id_col].dataType.simpleString()
    names = [*fields, text_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkOffsets.of(tokenizer)
        for b in batches:
            at, field, section, edge, end, tokens, crossing, total = [], [], [], [], [], [], [], []
            for row in range(b.num_rows):
                values = [b.column(k + 1)[row].as_py() or "" for k in range(len(names))]
                lines = values[-1].split("\n")
                parts = [*(v + "\n" for v in values[:-1]), *(x + "\n" for x in lines[:-1]), lines[-1]]
                edges = np.cumsum([0, *map(len, parts)])
                spans = encoder.of_text("".join(parts))
                held, over = attributed(spans, edges, rule)
                at += [row] * len(parts)
                field += [*fields, *[text_col] * len(lines)]
                section += [*[0] * len(fields), *range(len(lines))]
                edge += edges[:-1].tolist()
                end += edges[1:].tolist()
                tokens += held.tolist()
                crossing += over.tolist()
                total += [len(spans)] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(section, pa.int32()), *(pa.array(x, pa.int64()) for x in (edge, end)), pa.array(tokens, pa.float64()), *(pa.array(x, pa.int64()) for x in (crossing, total))],
                names=["doc_id", "field", "section", "start", "end", "tokens", "n_crossing", "doc_tokens"],
            )

    schema = f"doc_id {kind}, field string, section int, start long, end long, tokens double, n_crossing long, doc_tokens long"
    out = documents.select(F.col(id_col).alias("__id"), *(F.col(c).cast("string").alias(f"__f{k}") for k, c in enumerate(names))).mapInArrow(count, schema)
    return out if rule == "split" else out.withColumn("tokens", F.col("tokens").cast("long"))
