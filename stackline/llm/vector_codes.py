"""Product codes of vectors, fitted in whole numbers, by tries over distinct parts.

Each vector is cut into equal consecutive parts, and each part position has a codebook. In a
round every part goes to its nearest entry, and each entry becomes the mean of its parts, rounded
down. Rows don't move: each task sorts the distinct parts of a block of its rows
lexicographically, which is a trie laid flat, and walks it depth first. The squared distances to
all entries, summed over the dimensions walked so far, are kept for a node and shared by all parts
below it; at a leaf the least gives the entry, and the part counts as often as it occurs. A task
sends one row of sums, the count last, for each entry it used, so a frequent vector costs no more than others;
only codebooks, whose size is fixed, reach the driver and the tasks.

Defined cases: a null vector, or one with null or non-finite components, is dropped; components
are held within +-2^26 after scaling, so that errors fit 64 bits; of vectors of several lengths
only those of the length of the first (by id) are kept; where the length is no multiple of the
parts, the first parts have one component more; with fewer vectors than entries the codebooks are
smaller; null ids come after all others; repeated rows are vectors of their own, ties of ids go by
components; null labels are one label; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackline.llm.staging import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = float(1 << 26)
#: Vectors of a block, whose parts make one trie, and leaves whose distances are held at once.
BLOCK, LEAVES = 16_384, 1_024


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, which of them each row is, and how often each occurs."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    ranked = rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (ranked[1:] != ranked[:-1]).any(1)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(first) - 1
    return ranked[first], which, np.bincount(which)


def nearest(rows: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of several) and squared distance, of distinct rows in lexicographic order.

    A node is a run of rows that agree in their first dimensions. ``total`` has the distances to
    all entries over these; children that are single leaves are finished together.
    """
    entry, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    agree = (rows[1:] != rows[:-1]).argmax(1) if rows.shape[1] else np.zeros(0, np.int64)
    stack = [(0, len(rows), 0, np.zeros(len(codebook), np.int64))]
    while stack:
        low, high, depth, total = stack.pop()
        starts = np.concatenate([[low], low + 1 + np.flatnonzero(agree[low : high - 1] == depth)])
        ends = np.append(starts[1:], high)
        alone = ends - starts == 1
        for at in np.split(starts[alone], range(LEAVES, alone.sum(), LEAVES)):
            sums = np.repeat(total[None], len(at), 0)
            for d in range(depth, rows.shape[1]):
                sums += (rows[at, d, None] - codebook[:, d]) ** 2
            entry[at] = sums.argmin(1)
            distance[at] = sums[np.arange(len(at)), entry[at]]
        for a, b in zip(starts[~alone][::-1].tolist(), ends[~alone][::-1].tolist()):
            stack.append((a, b, depth + 1, total + (rows[a, depth] - codebook[:, depth]) ** 2))
    return entry, distance


def part_sums(rows: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, how many of the rows are nearest to it and their sum by dimension."""
    leaves, _, times = distinct_rows(rows)
    entry, _ = nearest(leaves, codebook)
    counts, sums = np.zeros(len(codebook), np.int64), np.zeros(codebook.shape, np.int64)
    np.add.at(counts, entry, times)
    np.add.at(sums, entry, leaves * times[:, None])
    return counts, sums


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of the batches in blocks, and their components as a matrix."""
    held: list[pa.RecordBatch] = []

    def block():
        table = pa.Table.from_batches(held)
        held.clear()
        return table, table["components"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, dims)

    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            held.append(batch.slice(at, BLOCK))
            if sum(map(len, held)) >= BLOCK:
                yield block()
    if held and sum(map(len, held)):
        yield block()


def _edges(dims: int, parts: int) -> list[tuple[int, int]]:
    sizes = [dims // parts + (k < dims % parts) for k in range(parts)]
    return [(sum(sizes[:k]), sum(sizes[: k + 1])) for k in range(parts)]


def _summing(codebooks: list[np.ndarray], edges: list[tuple[int, int]]) -> Callable:
    def of(batches):
        totals = [(np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)) for c in codebooks]
        for _, block in _blocks(batches, edges[-1][1]):
            for (counts, sums), codebook, (a, b) in zip(totals, codebooks, edges):
                n, s = part_sums(block[:, a:b], codebook)
                counts += n
                sums += s
        rows = [(p, e, [*s[e].tolist(), int(c[e])]) for p, (c, s) in enumerate(totals) for e in np.flatnonzero(c).tolist()]
        part, entry, sums = zip(*rows) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(sums, pa.list_(pa.int64()))], ["part", "entry", "sums"])

    return of


def _coding(codebooks: list[np.ndarray], edges: list[tuple[int, int]]) -> Callable:
    def of(batches):
        for table, block in _blocks(batches, edges[-1][1]):
            codes, error = np.empty((len(block), len(edges)), np.uint8), np.zeros(len(block), np.int64)
            for p, (codebook, (a, b)) in enumerate(zip(codebooks, edges)):
                leaves, which, _ = distinct_rows(block[:, a:b])
                entry, distance = nearest(leaves, codebook)
                codes[:, p] = entry[which]
                error += distance[which]
            yield from table.select(["vec_id", "label"]).append_column("code", pa.array([c.tobytes().hex() for c in codes])).append_column("error", pa.array(error)).to_batches()

    return of


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label and integer components of each vector whose components are all finite numbers."""
    vector = F.col(vector_col)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x.cast("double") * float(scale)))).cast("int"))
    return embeddings.where(vector.isNotNull() & ~F.coalesce(odd, F.lit(True))).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), scaled.alias("components"))


def fitted(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of integer vectors of equal length after some rounds; none if there are no vectors.

    At most ``entries`` vectors are taken to the driver, and in each round a number of sums that
    depends on the codebooks' size alone.
    """
    first = [r["components"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "components").limit(entries).collect()]
    if not first:
        return []
    edges = _edges(len(first[0]), parts)
    codebooks = [np.array(first, np.int64).reshape(len(first), -1)[:, a:b] for a, b in edges]
    for _ in range(rounds):
        sums = vectors.select("components").mapInArrow(_summing(codebooks, edges), "part int, entry int, sums array<long>")
        added = sums.select("part", "entry", F.posexplode("sums").alias("dim", "x")).groupBy("part", "entry", "dim").agg(F.sum("x").alias("x")).collect()
        found = {(r["part"], r["entry"], r["dim"]): r["x"] for r in added}
        codebooks = [c.copy() for c in codebooks]
        for (part, entry, dim), x in found.items():
            if dim < codebooks[part].shape[1]:
                codebooks[part][entry, dim] = x // found[part, entry, codebooks[part].shape[1]]
    return codebooks


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of each integer vector."""
    edges = [(0, 0)]
    for c in codebooks:
        edges.append((edges[-1][1], edges[-1][1] + c.shape[1]))
    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(_coding(codebooks, edges[1:]), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, **columns: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector kept."""
    vectors = integer_vectors(embeddings, **columns)
    lead = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "components").limit(1).collect()
    vectors = staged(vectors.where(F.size("components") == (len(lead[0]["components"]) if lead else 0)), "vectors")
    codebooks = fitted(vectors, parts, entries, rounds)
    if not codebooks:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    codes = staged(coded(vectors, codebooks), "codes")
    # Rows of a frequent label are many: they are added up before they move, and the join splits them.
    sums = staged(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "of")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of the same, for vectors of one length that the parts divide."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, [floor(x::DOUBLE * {scale}) for x in embedding] AS c FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"part AS MATERIALIZED (SELECT vec_id, label, p, c[p * (len(c) // {parts}) + 1 : (p + 1) * (len(c) // {parts})]::DOUBLE[] AS v FROM kept, range({parts}) AS r(p))",
        f"book0 AS MATERIALIZED (SELECT p, (dense_rank() OVER (ORDER BY vec_id) - 1)::INT AS e, v FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]

    def nearest_in(k: int) -> str:
        squares = "list_inner_product(part.v, part.v) - 2 * list_inner_product(part.v, b.v) + list_inner_product(b.v, b.v)"
        return f"near{k} AS MATERIALIZED (SELECT part.vec_id, part.label, part.p, part.v, b.e, {squares} AS d FROM part JOIN book{k} AS b USING (p) QUALIFY row_number() OVER (PARTITION BY part.vec_id, part.p ORDER BY d, b.e) = 1)"

    for k in range(rounds):
        steps += [
            nearest_in(k),
            f"flat{k} AS (SELECT p, e, i, floor(sum(x) / count(*)) AS x FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k}) GROUP BY p, e, i)",
            f"mean{k} AS MATERIALIZED (SELECT p, e, list(x ORDER BY i) AS v FROM flat{k} GROUP BY p, e)",
            f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} AS b LEFT JOIN mean{k} AS m USING (p, e))",
        ]
    steps += [
        nearest_in(rounds),
        f"sha AS (SELECT sha256(string_agg(list_aggregate([x::BIGINT for x in v], 'string_agg', ','), ',' ORDER BY p, e)) AS s FROM book{rounds})",
        f"code AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT s FROM sha) AS codebooks_sha256 FROM code"
