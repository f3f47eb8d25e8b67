"""A sample that matches target shares of categories: the cube method.

Each row's inclusion probability is its cell's wanted count over its available count. The flight phase
moves the vector of probabilities at random within the space that keeps all balancing sums (cells, their
registers, labels and models, and the size) until rows are decided. It runs on every partition by itself:
rows of one cell have equal columns, so the moves exchange probability within a cell and leave at most one
undecided row a cell, all others drawn at random. Undecided rows (at most cells x partitions) merge upward
in groups of ``FAN`` partitions, where the general flight goes on; at the top the landing phase gives up one
balancing variable after the other, the size last, until every row is decided. Cells that fall short are
read from the drawn sample.

Defined results: rows with a null in text, register, label or model are in no cell; a cell whose wanted
count exceeds what there is gives all its rows and is reported short, and the others take up its part in
proportion; an empty table gives an empty sample in which every cell is short; equal draws are impossible
as the order is by a hash of the id, ties by the id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.codepoints import mix
from lectern.plans.stage import written

FAN = 16
EPS = 1e-9


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved to 0 or 1 while the sums of ``x[:, k] * pi`` stay: at most rank(x) stay between.

    ``x`` holds one row of balancing values for each unit; the columns kept are those values themselves,
    so sums of the sample equal sums of the probabilities.
    """
    pi = pi.copy()
    open_ = [i for i in np.flatnonzero((pi > EPS) & (pi < 1 - EPS))]
    window: list[int] = []
    while True:
        window = [i for i in window if EPS < pi[i] < 1 - EPS]
        while open_ and len(window) < x.shape[1] + 1:
            window.append(open_.pop(0))
        if not window:
            return pi
        b = x[window].T
        _, s, vt = np.linalg.svd(b, full_matrices=True)
        rank = int((s > 1e-8 * max(s[0], 1)).sum()) if len(s) else 0
        if rank >= len(window):
            return pi
        u = vt[-1]
        u = np.where(np.abs(u) < 1e-10, 0, u)
        p = pi[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
        p = p + up * u if rng.random() * (up + down) < down else p - down * u
        pi[window] = np.where(p < EPS, 0, np.where(p > 1 - EPS, 1, p))


def landing(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides what the flight left, giving up balancing variables from the last column on; the first column goes last."""
    for k in range(x.shape[1], 0, -1):
        pi = flight(pi, x[:, :k], rng)
        if not ((pi > EPS) & (pi < 1 - EPS)).any():
            return pi
    return (rng.random(len(pi)) < pi).astype(float)


def balancing(cells: pd.DataFrame) -> dict[int, np.ndarray]:
    """Of each cell its balancing values, most important first: size, cell, register, label, model. Columns that say nothing new are left out."""
    columns = [np.ones(len(cells))]
    for by in (["cell_id"], ["register"], ["label"], ["model"]):
        for _, at in cells.groupby(by, dropna=False).groups.items():
            columns.append(cells.index.isin(at).astype(float))
    kept: list[np.ndarray] = []
    for c in columns:
        if np.linalg.matrix_rank(np.array([*kept, c])) > len(kept):
            kept.append(c)
    return dict(zip(cells["cell_id"].astype(int), np.array(kept).T))


def wanted(cells: pd.DataFrame, size: int) -> np.ndarray:
    """Wanted counts: target shares of the size, at least ``min_rows``, at most what there is.

    A cell with no more rows than its target gives them all; what short cells lack goes to the others in proportion.
    """
    have = cells["available"].to_numpy(float)
    share = cells["target_share"].to_numpy(float)
    least = np.minimum(np.maximum(cells["min_rows"].to_numpy(float), 0), have)
    target = np.maximum(least, np.floor(share * size))
    least = np.where(have <= target, have, least)
    lo, hi = 0.0, 1.0
    fill = lambda k: np.minimum(have, np.maximum(least, k * share * size))
    goal = min(float(size), float(have[(share > 0) | (least > 0)].sum()))
    while fill(hi).sum() < goal - 1e-6 and hi < 1e9:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fill(mid).sum() < goal else (lo, mid)
    return fill(hi)


def _exchange(a: float, b: float, u: float) -> tuple[float, float]:
    """The flight move of two units with equal balancing columns: their sum stays and one of them is decided."""
    total = a + b
    if total < 1:
        return (total, 0.0) if u * total < a else (0.0, total)
    return (1.0, total - 1) if u * (2 - total) < 1 - b else (total - 1, 1.0)


def _draw(probability: dict[int, float], seed: int):
    """The flight phase of one partition.

    Rows of one cell have equal balancing columns, so every move of the flight is an exchange between two of them.
    In hash order of the ids, m rows of a batch end with floor(m p) drawn and at most one undecided; that one goes
    on with the undecided row of the batches before. A task holds a batch and one row a cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, part])
        held: dict[int, tuple[int, float]] = {}

        def batch_of(ids: list, cells: list, p: list) -> pa.RecordBatch:
            where = np.full(len(ids), part, np.int32)
            columns = [pa.array(ids, pa.int64()), pa.array(cells, pa.int64()), pa.array(p, pa.float64()), pa.array(where)]
            return pa.RecordBatch.from_arrays(columns, names=["id", "cell_id", "p", "part"])

        for b in batches:
            ids, cell = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "cell_id"))
            order = np.lexsort((ids, mix(ids.view(np.uint64) + np.uint64(seed)), cell))
            ids, cell = ids[order], cell[order]
            value, first, count = np.unique(cell, return_index=True, return_counts=True)
            drawn, drawn_cell = [], []
            for c, f, m in zip(value.tolist(), first.tolist(), count.tolist()):
                total = m * probability[c]
                k = int(np.floor(total + EPS))
                drawn += ids[f : f + k].tolist()
                drawn_cell += [c] * k
                left = total - k
                if left <= EPS or k >= m:
                    continue
                other = (int(ids[f + k]), left)
                if c in held:
                    p, q = _exchange(held[c][1], left, rng.random())
                    both = [(held.pop(c)[0], p), (other[0], q)]
                    drawn += [i for i, x in both if x >= 1 - EPS]
                    drawn_cell += [c] * sum(x >= 1 - EPS for _, x in both)
                    rest = [(i, x) for i, x in both if EPS < x < 1 - EPS]
                    if rest:
                        held[c] = rest[0]
                else:
                    held[c] = other
            yield batch_of(drawn, drawn_cell, [1.0] * len(drawn))
        yield batch_of([i for i, _ in held.values()], list(held), [x for _, x in held.values()])

    return run


def _merge(x: dict[int, np.ndarray], seed: int, top: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell_id", "id"])
        rng = np.random.default_rng([seed, int(pdf["part"].iloc[0])])
        rows = np.array([x[int(c)] for c in pdf["cell_id"]])
        step = landing if top else flight
        return pdf.assign(p=step(pdf["p"].to_numpy(float), rows, rng))

    return run


class CubeSample:
    """A drawn sample: ``cells`` (the report) and ``rows`` (id, cell_id)."""

    def __init__(self, df: DataFrame, targets: DataFrame, id_col: str = "row_id", text_col: str = "text", fraction: int = 5, seed: int = 1):
        spark = df.sparkSession
        clean = lambda c: F.lower(F.trim(c))
        # The targets are a fixed table of cells.
        t = targets.select("cell_id", clean("register").alias("register"), "label", clean("model").alias("model"), "target_share", "min_rows").toPandas()
        keys = F.broadcast(spark.createDataFrame(t[["cell_id", "register", "label", "model"]], "cell_id long, register string, label int, model string"))
        rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), clean("register").alias("register"), "label", clean("model").alias("model"))
        placed = rows.join(keys, ["register", "label", "model"], "left").select("id", "cell_id")
        counts = {r[0]: r[1] for r in placed.groupBy("cell_id").count().collect()}
        total = sum(counts.values())
        self.size = total // fraction
        t["available"] = [counts.get(c, 0) for c in t["cell_id"]]
        t["target_rows"] = np.maximum(t["min_rows"], np.floor(t["target_share"] * self.size)).astype("int64")
        t["wanted"] = wanted(t, self.size)
        self.table = t
        probability = {int(c): min(1.0, w / a) if a else 0.0 for c, w, a in zip(t["cell_id"], t["wanted"], t["available"])}
        x = balancing(t)
        state = written(placed.filter("cell_id is not null and id is not null").mapInArrow(_draw(probability, seed), "id long, cell_id long, p double, part int"))
        taken = state.filter(F.col("p") >= 1 - EPS).select("id", "cell_id")
        open_ = state.filter((F.col("p") > EPS) & (F.col("p") < 1 - EPS))
        level = 0
        while True:
            # At most one row a cell and partition; each round leaves at most rank(x) rows a group.
            groups = open_.select("part").distinct().count()
            top = groups <= FAN
            level += 1
            keyed = open_.withColumn("part", F.lit(0) if top else F.floor(F.col("part") / FAN).cast("int"))
            moved = written(keyed.groupBy("part").applyInPandas(_merge(x, seed + level, top), "id long, cell_id long, p double, part int"))
            taken = taken.unionAll(moved.filter(F.col("p") >= 1 - EPS).select("id", "cell_id"))
            if top:
                break
            open_ = moved.filter((F.col("p") > EPS) & (F.col("p") < 1 - EPS))
        self.rows = taken

    def report(self) -> DataFrame:
        """One row a cell: target, available and sampled counts, the residual imbalance (sampled less wanted), and
        whether the cell is short: the drawn sample holds all its rows and they are fewer than its target."""
        spark = self.rows.sparkSession
        names = ["cell_id", "target_share", "min_rows", "target_rows", "available", "wanted"]
        kinds = "cell_id long, target_share double, min_rows long, target_rows long, available long, wanted double"
        t = spark.createDataFrame(self.table[names], kinds)
        drawn = self.rows.groupBy("cell_id").agg(F.count(F.lit(1)).alias("sampled"))
        joined = t.join(drawn, "cell_id", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
        short = (F.col("sampled") < F.col("target_rows")) & (F.col("sampled") >= F.col("available"))
        return joined.withColumn("short", short).withColumn("residual", F.col("sampled") - F.col("wanted"))
