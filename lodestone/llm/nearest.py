"""Maximum inner product search: score-aware anisotropic quantisation, four-bit table scans, exact reranking up to a bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import written
from lodestone.llm.words import tidied

#: Rows of the sample that codebooks are fitted on, about; codewords of a subspace (four bits); dimensions of a subspace.
SAMPLE_ROWS, CODEWORDS, SUB = 4096, 16, 2
#: Vectors of an index block, queries of a query block, and vectors of a block that are reranked for each query at first.
BLOCK, QUERIES, RERANK = 8192, 1024, 256
#: The share of the norm above which an inner product counts for the anisotropic weight.
THRESHOLD = 0.2


class AnisotropicQuantizer:
    """Product codebooks for the loss |r|^2 + (eta - 1) (r . x/|x|)^2 of the residual r, so that error along the vector,
    which shifts large inner products, weighs eta = (d - 1) t^2 / (1 - t^2) times the error across it."""

    def __init__(self, dims: int, books: np.ndarray | None = None, threshold: float = THRESHOLD) -> None:
        self.dims = dims
        self.parts = -(-dims // SUB)
        self.extra = max(0.0, (dims - 1) * threshold**2 / (1 - threshold**2) - 1)
        self.books = books

    def _split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * SUB))
        padded[:, : self.dims] = x
        return padded.reshape(len(x), self.parts, SUB)

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 5) -> AnisotropicQuantizer:
        rng = np.random.default_rng(seed)
        xs = self._split(x)
        pick = rng.integers(0, len(x), size=(self.parts, CODEWORDS))
        self.books = np.stack([xs[pick[m], m] for m in range(self.parts)])
        for _ in range(rounds):
            codes = self.encode(x, sweeps=1)
            self._update(xs, codes)
        return self

    def _along(self, xs: np.ndarray) -> np.ndarray:
        norm = np.sqrt((xs**2).sum(axis=(1, 2), keepdims=True))
        return xs / np.where(norm > 0, norm, 1)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n, parts): nearest codewords first, then each part in turn by the joint loss given the others."""
        xs = self._split(x)
        along = self._along(xs)
        near = [((xs[:, m, None] - self.books[m]) ** 2).sum(-1) for m in range(self.parts)]
        codes = np.stack([d.argmin(1) for d in near], axis=1)
        shift = [np.einsum("nks,ns->nk", xs[:, m, None] - self.books[m], along[:, m]) for m in range(self.parts)]
        rows = np.arange(len(x))
        total = sum(shift[m][rows, codes[:, m]] for m in range(self.parts))
        for _ in range(sweeps):
            for m in range(self.parts):
                rest = total - shift[m][rows, codes[:, m]]
                codes[:, m] = (near[m] + self.extra * (rest[:, None] + shift[m]) ** 2).argmin(1)
                total = rest + shift[m][rows, codes[:, m]]
        return codes.astype(np.uint8)

    def slack(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For each vector what a scan can be off by, for a query of norm 1: the residual's norm, and the rounding of a scan."""
        xs = self._split(x)
        rest = np.sqrt(((xs - self.books[np.arange(self.parts), codes]) ** 2).sum(axis=(1, 2)))
        return rest * (1 + 1e-9) + 1e-7 * (self.parts + 8) * (np.sqrt((xs**2).sum(axis=(1, 2))) + rest)

    def _update(self, xs: np.ndarray, codes: np.ndarray) -> None:
        """Each codeword to the least joint loss of its vectors, a small linear system."""
        along = self._along(xs)
        rows = np.arange(len(xs))[:, None]
        moved = xs - self.books[np.arange(self.parts), codes]
        total = (moved * along).sum(axis=(1, 2))
        del rows
        for m in range(self.parts):
            a = along[:, m]
            rest = total - (moved[:, m] * a).sum(1)
            for k in range(CODEWORDS):
                mine = codes[:, m] == k
                if mine.any():
                    u, v = a[mine], xs[mine, m]
                    left = mine.sum() * np.eye(SUB) + self.extra * u.T @ u
                    right = v.sum(0) + self.extra * (u * (rest[mine] + (u * v).sum(1))[:, None]).sum(0)
                    self.books[m, k] = np.linalg.solve(left, right)
            moved[:, m] = xs[:, m] - self.books[m, codes[:, m]]
            total = rest + (moved[:, m] * a).sum(1)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        if self.parts % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), dtype=np.uint8)], axis=1)
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, vectors): a table of 256 sums for each byte, one look-up a byte."""
        tables = np.einsum("qms,mks->qmk", self._split(queries), self.books).astype(np.float32)
        if self.parts % 2:
            tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], axis=1)
        both = (tables[:, 0::2, None, :] + tables[:, 1::2, :, None]).reshape(len(queries), -1, 256)
        out = np.zeros((len(queries), len(packed)), dtype=np.float32)
        for b in range(packed.shape[1]):
            out += np.take(both[:, b], packed[:, b], axis=1)
        return out


def _usable(vectors: DataFrame, dims: int) -> DataFrame:
    sound = F.expr(f"embedding is not null and size(embedding) = {dims} and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(embedding, v -> v <> 0)")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null").filter(F.coalesce(sound, F.lit(False)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sample(rows: DataFrame, total: int) -> np.ndarray:
    """About ``SAMPLE_ROWS`` of ``total`` vectors, chosen by a hash of the id, so by no order of the table; where a few ids
    fill the table and none is chosen, or too many, the first ones."""
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    for some in (chosen, rows):
        found = np.array([r[0] for r in some.select("embedding").limit(SAMPLE_ROWS * 5 // 4).collect()], dtype=np.float64)
        if len(found):
            break
    return found


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the ``k`` other rows of largest
    inner product, ties to the smaller vec_id; all others if there are fewer.

    Takes ``vec_id`` and ``embedding`` (array of float or double); others are not read. Rows with a null id, or a vector that
    is null, zero, of another length than most rows, or has null or non-finite components take no part; an empty
    table gives no rows. A vec_id in several rows is one query and one candidate, with the best score of its rows; a query's
    own id is never returned. Codebooks are fitted on about ``SAMPLE_ROWS`` rows of least hash; every row is indexed. Blocks of queries
    meet blocks of the index, each block pair a task of fixed size: codes are scanned, ``RERANK`` vectors a block (at least k)
    are scored exactly in double precision, then each other one whose scan and residual can still reach the k-th exact
    score, so none of the k best of a block is lost; they go on, and a top-k by query ends it.
    """
    spark = vectors.sparkSession
    sizes = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes or not sizes[0][0]:
        return spark.createDataFrame([], schema)
    dims, total = sizes[0]
    rows = _usable(vectors, dims)
    train = _sample(rows, total)
    if not len(train):
        return spark.createDataFrame([], schema)
    books = spark.sparkContext.broadcast(AnisotropicQuantizer(dims).fit(train).books)

    def block(limit: int, coded: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            quantizer = AnisotropicQuantizer(dims, books.value)
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def out(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                codes = quantizer.encode(x) if coded else None
                parts = (ids, x, quantizer.pack(codes), quantizer.slack(x, codes)) if coded else (ids, x, x[:0], x[:0])
                return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], type=pa.binary()) for p in parts], names=["ids", "x", "codes", "slack"])

            count = 0
            for batch in batches:
                held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), dims).astype(np.float64)))
                count += batch.num_rows
                while count >= limit:
                    ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    yield out(ids[:limit], x[:limit])
                    held, count = [(ids[limit:], x[limit:])], count - limit
            if count:
                yield out(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        return run

    blocks = "ids binary, x binary, codes binary, slack binary"
    rows = rows.dropDuplicates(["vec_id", "embedding"])  # dealt by a hash of both, so blocks mix the table
    few = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK)))  # partitions that fill a block
    index = written(rows.coalesce(few).mapInArrow(tidied(block(BLOCK, True)), blocks).withColumn("b", F.monotonically_increasing_id()), "ann-index")
    queries = written(rows.filter(f"vec_id % {every} = 0").coalesce(max(1, -(-total // (every * QUERIES)))).mapInArrow(tidied(block(QUERIES, False)), blocks).select(F.col("ids").alias("q_ids"), F.col("x").alias("q")), "ann-queries")
    names = index.select("b")
    pairs = index.join(queries.crossJoin(names), "b")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer = AnisotropicQuantizer(dims, books.value)
        for batch in batches:
            for ids, x, codes, slack, q_ids, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, q_ids, slack = np.frombuffer(ids, dtype=np.int64), np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(slack)
                x, q = np.frombuffer(x).reshape(-1, dims), np.frombuffer(q).reshape(-1, dims)
                packed = np.frombuffer(codes, dtype=np.uint8).reshape(len(ids), -1)
                single = bool((np.diff(ids) > 0).all())  # blocks are sorted by id
                keep = min(len(ids), max(2 * k + 2, min(RERANK, len(ids) // 8)))
                for lo in range(0, len(q), 64):
                    some, own = q[lo : lo + 64], q_ids[lo : lo + 64]
                    scores = quantizer.scan(some, packed)
                    got_q, got_v, got_s = [], [], []
                    for i, one in enumerate(some):
                        others = ids != own[i]
                        cut = np.partition(scores[i], len(ids) - keep)[len(ids) - keep]
                        near = _best(scores[i], cut, keep)
                        near = near[others[near]]
                        exact = _exact(x, near, one)
                        own_best = exact if single else _best_of_ids(ids[near], exact)[1]
                        least = np.partition(own_best, len(own_best) - k)[len(own_best) - k] if len(own_best) >= k else -np.inf
                        others[near] = False
                        more = np.flatnonzero(others & ~(scores[i] + slack * np.sqrt(one @ one) < least))
                        near, exact = np.concatenate([near, more]), np.concatenate([exact, _exact(x, more, one)])
                        found_ids = ids[near]
                        if not single:
                            found_ids, exact = _best_of_ids(found_ids, exact)
                        order = np.lexsort((found_ids, -exact))[:k]
                        got_q.append(np.full(len(order), own[i]))
                        got_v.append(found_ids[order])
                        got_s.append(exact[order])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (got_q, got_v, got_s)], names=["query_id", "vec_id", "score"])

    found = pairs.select("ids", "x", "codes", "slack", "q_ids", "q").mapInArrow(tidied(search), "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # ids in several rows count once
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(x: np.ndarray, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products row by row in one order of addition, so equal vectors have equal scores; many rows are not gathered."""
    return np.einsum("nd,d->n", x, query)[rows] if 5 * len(rows) > len(x) else np.einsum("nd,d->n", x[rows], query)


def _best_of_ids(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id once, with its largest score."""
    order = np.lexsort((-scores, ids))
    first = np.diff(ids[order], prepend=ids[order][:1] - 1) != 0
    return ids[order][first], scores[order][first]


def _best(scores: np.ndarray, cut: float, keep: int) -> np.ndarray:
    """Places of the ``keep`` largest scores, of those equal to the least of them the first."""
    over = np.flatnonzero(scores > cut)
    return np.concatenate([over, np.flatnonzero(scores == cut)[: keep - len(over)]])
