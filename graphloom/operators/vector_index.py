"""A stored vector index: k-means cells with residual codes, searched by probing cells.

Vectors are unit-scaled, dealt to the nearest of ``k`` centroids and written as Parquet by cell, each with its residual
from the centroid as one byte a dimension. A search reads the codes of the probed cells alone (partition pruning), ranks by
them, and compares the best few with their whole vectors. Rows carry the generation that wrote them: an insert
of known keys buries the old rows in the cells where they lie, and a generation counts once its mark is written, so a job that fails
half way leaves nothing behind that a search sees.

Layout under the index folder: ``centroids`` (cell, centroid, step, types), ``vectors/cell=`` (key, gen, code, v), ``gone/cell=``
(key, gen: rows of the key before that generation are dead), ``marks`` (gen, cell, rows, radius).

Bounds: at most MAX_CELLS centroids are held by the driver and sent to the tasks; they are fitted on at most SAMPLE_PER_CELL
vectors a cell. All vectors are indexed. A vector that is null, of another length or not finite is in no cell and never found;
a zero vector lies in the first cell and has a score of 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.resolve import pair_cosines

MAX_CELLS, SAMPLE_PER_CELL = 16_384, 64
#: Rows of a cell, and queries, that are compared in one task at a time.
CELL_ROWS, QUERY_ROWS = 8192, 2048
#: Queries of a range search that meet a cell's part at a time; they are few floats each, and every block of them is sent the part again.
WITHIN_ROWS = 16_384


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k unit centroids of unit vectors: spherical k-means; cells that run empty start again at the worst-placed vectors."""
    pick = np.random.default_rng(seed).permutation(len(sample))
    c = sample[pick[:k]].copy()
    for _ in range(rounds):
        best, score = _nearest_cell(sample, c)
        sums = np.zeros_like(c)
        np.add.at(sums, best, sample)
        n = np.bincount(best, minlength=len(c))
        worst = np.argsort(score, kind="stable")[: int((n == 0).sum())]
        sums[n == 0] = sample[worst]
        c = _unit(sums)
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest_cell(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, score = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), 4096):
        s = x[lo : lo + 4096] @ c.T
        best[lo : lo + 4096] = s.argmax(axis=1)
        score[lo : lo + 4096] = s.max(axis=1)
    return best, score


def _usable(vectors: DataFrame, dims: int, key: str, vec: str) -> DataFrame:
    """(key, v) of the vectors that can be indexed, as they are."""
    v = vectors.select(F.col(key).alias("key"), F.col(vec).alias("v"))
    return v.filter((F.size("v") == dims) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))


_MARK = "gen int, cell int, rows long, radius double"


class VectorIndex:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        self._centroids, self._step = np.array([r["centroid"] for r in rows], np.float64), rows[0]["step"]
        key, vec = rows[0]["key_type"], rows[0]["vec_type"]
        self._schemas = {"vectors": f"key {key}, code binary, v {vec}, dist double, gen int, cell int", "gone": f"key {key}, gen int, cell int", "marks": _MARK}

    @classmethod
    def build(cls, vectors: DataFrame, path: str, dims: int, key: str = "vec_id", vec: str = "embedding", cells: int | None = None, seed: int = 3) -> VectorIndex:
        """Fits the cells (about the square root of the number of vectors) and inserts all vectors; keys must be unique."""
        spark = vectors.sparkSession
        usable = _usable(vectors, dims, key, vec)
        n = usable.count()
        k = max(1, min(cells or math.isqrt(n), MAX_CELLS, max(n, 1)))
        # the sample is the smallest hashes of keys, so it is the same each time
        rows = usable.select("v").orderBy(F.xxhash64(F.col("key"), F.lit(seed))).limit(k * SAMPLE_PER_CELL).collect()
        sample = _unit(np.array([r[0] for r in rows], np.float64)) if rows else np.zeros((1, dims))
        c = fit_centroids(sample, k, seed=seed)
        best, _ = _nearest_cell(sample, c)
        # a step that covers nearly all residuals in 127 steps; larger ones are cut, and the whole vector corrects the score
        step = float(np.quantile(np.abs(sample - c[best]), 0.9999) / 127) or 1.0
        types = dict(usable.dtypes)
        frame = [(i, x.tolist(), step, types["key"], types["v"]) for i, x in enumerate(c)]
        spark.createDataFrame(frame, "cell int, centroid array<double>, step double, key_type string, vec_type string").write.parquet(f"{path.rstrip('/')}/centroids")
        index = cls(spark, path)
        index.insert(vectors, key, vec)
        return index

    def _placed(self, usable: DataFrame) -> DataFrame:
        """(key, cell, code, v, dist) of vectors."""
        c, step = self._centroids, self._step

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                x = _unit(np.stack(pdf["v"].to_list()).astype(np.float64)) if len(pdf) else np.zeros((0, c.shape[1]))
                cell, _ = _nearest_cell(x, c)
                rest = x - c[cell]
                code = np.clip(np.rint(rest / step), -127, 127).astype(np.int8)
                yield pd.DataFrame({"key": pdf["key"], "cell": cell.astype(np.int32), "code": [r.tobytes() for r in code], "v": pdf["v"], "dist": np.linalg.norm(rest, axis=1)})

        return usable.mapInPandas(run, f"key {dict(usable.dtypes)['key']}, cell int, code binary, v {dict(usable.dtypes)['v']}, dist double")

    def _table(self, name: str) -> DataFrame | None:
        jvm, conf = self._spark._jvm, self._spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return self._read(name) if at.getFileSystem(conf).exists(at) else None

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.schema(self._schemas[name]).parquet(f"{self.path}/{name}")

    def _generations(self) -> list[int]:
        marks = self._table("marks")
        return [] if marks is None else sorted(r[0] for r in marks.select("gen").distinct().collect())

    def insert(self, vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> int:
        """Adds vectors, replacing those with the same keys; returns the generation. Of keys repeated in the input one vector counts."""
        known, gen = self._generations(), self._next()
        fresh = _usable(vectors, self._centroids.shape[1], key, vec).groupBy("key").agg(F.min("v").alias("v"))
        placed = self._placed(fresh).withColumn("gen", F.lit(gen))
        # large cells are dealt to several tasks, small ones share one
        placed.hint("rebalance", F.col("cell")).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")
        mine = self._read("vectors").filter(F.col("gen") == gen)
        if known:
            self._bury(self._alive(None).select("key", "cell").join(mine.select("key"), "key", "left_semi"), gen)
        self._mark(mine.groupBy("cell").agg(F.lit(gen).alias("gen"), F.count(F.lit(1)).alias("rows"), F.max("dist").alias("radius")), gen)
        return gen

    def delete(self, keys: DataFrame, key: str = "vec_id") -> int:
        """Buries the vectors of the given keys; returns the generation."""
        gen = self._next()
        old = self._alive(None).select("key", "cell").join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
        self._bury(old, gen)
        self._mark(self._spark.createDataFrame([], _MARK), gen)
        return gen

    def _bury(self, old: DataFrame, gen: int) -> None:
        old.withColumn("gen", F.lit(gen)).hint("rebalance", F.col("cell")).write.mode("append").partitionBy("cell").parquet(f"{self.path}/gone")

    def _mark(self, cells: DataFrame, gen: int) -> None:
        """The generation counts from here on; the row of cell -1 stands for it where it has no vectors."""
        one = self._spark.createDataFrame([(gen, -1, 0, 0.0)], _MARK)
        cells.select("gen", "cell", "rows", "radius").union(one).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")

    def _next(self) -> int:
        """Greater than every generation, also those of jobs that failed."""
        t = self._table("vectors")
        return max([0, *self._generations(), *([] if t is None else [r[0] for r in t.select("gen").distinct().collect()])]) + 1

    def _alive(self, cells: Sequence[int] | None) -> DataFrame:
        """The rows of the given cells (None: all) that count."""
        gens = self._generations()
        t = self._read("vectors").filter(F.col("gen").isin(gens))
        gone = self._table("gone")
        if cells is not None:
            t = t.filter(F.col("cell").isin(list(cells)))
        if gone is not None:
            gone = gone.filter(F.col("gen").isin(gens))
            gone = gone if cells is None else gone.filter(F.col("cell").isin(list(cells)))
            dead = gone.groupBy("cell", "key").agg(F.max("gen").alias("until"))
            t = t.join(dead, ["cell", "key"], "left").filter("until IS NULL OR gen >= until").drop("until")
        return t

    def rows_by_cell(self) -> DataFrame:
        """(cell, rows, radius): rows ever written, and the greatest distance from the centroid."""
        marks = self._table("marks").filter("cell >= 0")
        return marks.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))

    def probed(self, query: Sequence[float], probes: int) -> list[int]:
        """The cells that a search of one vector reads, nearest first."""
        q = _unit(np.asarray([query], np.float64))[0]
        return [int(i) for i in np.argsort(-(self._centroids @ q), kind="stable")[:probes]]

    def search(self, query: Sequence[float], k: int = 10, probes: int = 8, refine: int = 4) -> DataFrame:
        """(key, score): the k vectors of greatest cosine to one query among those in the probed cells; ties by key."""
        q = _unit(np.asarray([query], np.float64))[0]
        cells = self.probed(query, probes)
        lead, step = {i: float(self._centroids[i] @ q) for i in cells}, self._step

        @F.pandas_udf("double")
        def rough(cell: pd.Series, code: pd.Series) -> pd.Series:
            m = np.frombuffer(b"".join(code), np.int8).reshape(len(code), -1)
            return pd.Series(np.array([lead[int(i)] for i in cell]) + step * (m @ q))

        alive = self._alive(cells)
        top = alive.select("cell", "key", rough("cell", "code").alias("s")).orderBy(F.desc("s"), "key").limit(k * refine).select("cell", "key")
        return self._best(alive.join(F.broadcast(top), ["cell", "key"], "left_semi"), query, k)

    @staticmethod
    def _best(rows: DataFrame, query: Sequence[float], k: int) -> DataFrame:
        """The k rows of greatest cosine, by their whole vectors."""
        score = S.cosine(F.col("v").cast("array<double>"), F.array(*[F.lit(float(x)) for x in query]))
        return rows.select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(k)

    def search_many(self, queries: DataFrame, k: int = 10, probes: int = 8, refine: int = 4, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
        """(query_id, id, score, rank): for every query the k nearest vectors among those in its probed cells.

        Queries go to the cells that they probe; of a cell at most CELL_ROWS vectors and QUERY_ROWS queries meet in a task, and each
        task keeps the best of a query by its codes. Nothing passes the driver.
        """
        dims, step, c = self._centroids.shape[1], self._step, self._centroids
        probes = min(probes, len(c))
        q = _usable(queries, dims, key, vec)
        key_type = dict(q.dtypes)["key"]

        def to_cells(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for lo in range(0, len(pdf), 1024):
                    part = pdf.iloc[lo : lo + 1024]
                    x = _unit(np.stack(part["v"].to_list()).astype(np.float64))
                    s = x @ c.T
                    near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame({"query_id": np.repeat(part["key"].to_numpy(), probes), "cell": near.ravel().astype(np.int32), "q": [x[i] for i in np.repeat(np.arange(len(x)), probes)]})

        asked = q.mapInPandas(to_cells, f"query_id {key_type}, cell int, q array<double>")
        sizes = self.rows_by_cell().select("cell", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("parts"))
        load = q.mapInPandas(lambda it: (x[["query_id", "cell"]] for x in to_cells(it)), f"query_id {key_type}, cell int").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
        grid = sizes.join(load, "cell")
        asked = asked.join(grid, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "block", "query_id", "q")
        held = self._alive(None).select("cell", "key", "code").join(grid, "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "part", "block", "key", "code")
        stored_type = dict(held.dtypes)["key"]
        m = k * refine

        def meet(group: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "id": [], "cell": [], "s": []})
            b = b.sort_values("key")
            x, y = np.stack(a["q"].to_list()), np.frombuffer(b"".join(b["code"]), np.int8).reshape(len(b), -1)
            s = (x @ c[group[0]])[:, None] + step * (x @ y.T.astype(np.float64))
            best = np.argsort(-s, axis=1, kind="stable")[:, :m]
            return pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), best.shape[1]), "id": b["key"].to_numpy()[best.ravel()], "cell": group[0], "s": np.take_along_axis(s, best, 1).ravel()})

        by = ["cell", "part", "block"]
        found = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(meet, f"query_id {key_type}, id {stored_type}, cell int, s double")
        rough = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "id"))).filter(F.col("r") <= m).select("query_id", "id", "cell")
        whole = rough.join(self._alive(None).select(F.col("key").alias("id"), "cell", F.col("v").alias("w")), ["cell", "id"]).join(q.select(F.col("key").alias("query_id"), "v"), "query_id")
        scored = whole.select("query_id", "id", S.cosine(F.col("w").cast("array<double>"), F.col("v").cast("array<double>")).alias("score"))
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)

    def search_within(self, queries: DataFrame, least: float, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
        """(query_id, id, score): for every query all vectors with a cosine of ``least`` (above 0) or more, exactly and however many they are.

        A query goes to the cells whose radius reaches to within the distance of that cosine, and there meets the whole vectors, at most CELL_ROWS of them and
        WITHIN_ROWS queries in a task. Where cells are wide, that is all of them. Nothing passes the driver but the radii.
        """
        if not 0 < least <= 1:
            raise ValueError("least must lie in (0, 1]")
        dims, c = self._centroids.shape[1], self._centroids
        q = _usable(queries, dims, key, vec)
        key_type = dict(q.dtypes)["key"]
        radius = np.full(len(c), -np.inf)
        for r in self.rows_by_cell().collect():
            radius[r["cell"]] = r["radius"]
        # of unit vectors the squared distance is 2 - 2 * cosine; more by what rounding may take
        reach = math.sqrt(2 - 2 * least) + 1e-6

        def to_cells(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for lo in range(0, len(pdf), 1024):
                    part = pdf.iloc[lo : lo + 1024]
                    x = _unit(np.stack(part["v"].to_list()).astype(np.float64))
                    far = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), 0.0))
                    i, j = np.nonzero(far - radius[None, :] <= reach)
                    yield pd.DataFrame({"query_id": part["key"].to_numpy()[i], "cell": j.astype(np.int32)})

        asked = q.mapInPandas(to_cells, f"query_id {key_type}, cell int")
        sizes = self.rows_by_cell().select("cell", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("parts"))
        grid = sizes.join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / WITHIN_ROWS).cast("int").alias("blocks")), "cell")
        asked = asked.join(grid, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(q.withColumnRenamed("key", "query_id"), "query_id")
        asked = asked.select("cell", "part", "block", "query_id", F.col("v").cast("array<double>").alias("v"))
        held = self._alive(None).select("cell", "key", "v").join(grid, "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "part", "block", "key", F.col("v").cast("array<double>").alias("v"))
        stored_type = dict(held.dtypes)["key"]

        def meet(_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": [], "id": [], "score": []})
            if not len(a) or not len(b):
                return none
            x, y = np.stack(a["v"].to_list()), np.stack(b["v"].to_list())
            ux, uy, out = _unit(x), _unit(y), [none]
            for lo in range(0, len(x), 512):
                i, j = np.nonzero(ux[lo : lo + 512] @ uy.T >= least - 1e-9)
                score = pair_cosines(x[lo : lo + 512], y, i, j)
                on = score >= least
                out.append(pd.DataFrame({"query_id": a["query_id"].to_numpy()[lo + i[on]], "id": b["key"].to_numpy()[j[on]], "score": score[on]}))
            return pd.concat(out[1:])

        by = ["cell", "part", "block"]
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(meet, f"query_id {key_type}, id {stored_type}, score double")

    def search_exact(self, query: Sequence[float], k: int = 10) -> DataFrame:
        """(key, score): the k nearest of all vectors. Cells are read nearest first, doubling in number, until none that is left can hold a nearer one.

        A cell's vectors lie within its radius of the centroid, so their distance from the query is at least that of the centroid less the radius.
        """
        q = _unit(np.asarray([query], np.float64))[0]
        radius = {r["cell"]: r["radius"] for r in self.rows_by_cell().collect()}
        far = np.linalg.norm(self._centroids - q, axis=1)
        # less what rounding may take
        least = sorted((max(float(far[i]) - r, 0.0) - 1e-9, i) for i, r in radius.items())
        n = 4
        while True:
            cells = [i for _, i in least[:n]]
            got = self._best(self._alive(cells), query, k)
            if n >= len(least):
                return got
            kth = [r["score"] for r in got.collect()]
            # of unit vectors the squared distance is 2 - 2 * cosine
            if len(kth) == k and least[n][0] > 0 and least[n][0] ** 2 > 2 - 2 * kth[-1]:
                return got
            n *= 2

    def compact(self, path: str) -> VectorIndex:
        """The living rows as a new index at ``path``, of one generation and without graves."""
        at = path.rstrip("/")
        self._spark.read.parquet(f"{self.path}/centroids").write.parquet(f"{at}/centroids")
        # rows that none of a generation's marks hold are left behind
        self._alive(None).withColumn("gen", F.lit(1)).hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{at}/vectors")
        mine = self._spark.read.schema(self._schemas["vectors"]).parquet(f"{at}/vectors")
        mine.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("dist").alias("radius")).select(F.lit(1).alias("gen"), "cell", "rows", "radius").coalesce(1).write.parquet(f"{at}/marks")
        return VectorIndex(self._spark, at)
