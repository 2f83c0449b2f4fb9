"""Near duplicates of embeddings by int8 tile products with rigorous error bounds.

A unit vector x is kept as s * q with q in int8. With e = |x - s q| and a = |s q| the cosine of x and y differs from
s_x s_y (q_x . q_y) by at most (a_x + e_x)(a_y + e_y) - a_x a_y. Only the codes and three numbers per vector travel to the
comparison. Every two blocks meet in a task that multiplies them in tiles of integers (exact, whatever the number of
components): pairs whose bound lies above the threshold are links, those whose bound lies below are none. The ids of the
vectors of all other pairs leave the task; their full vectors, and no others, meet again for the same two blocks, and the
undecided pairs are computed in double precision. Links are counted and joined into stars inside a task, so no pair is ever
a row.

Blocks hold about the same number of components whatever the vectors are. The work is that of all pairs, as the method has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.components import connected_components
from reviewmill.llm.stars import Stars, lowest_ids
from reviewmill.session import settle

THRESHOLD, TILE, EXACT_COMPONENTS = 0.95, 512, 1024
# A block has at least the first number of components, as long as there are fewer than BLOCKS, and at most the second.
LEAST_COMPONENTS, MOST_COMPONENTS, BLOCKS = 1 << 19, 1 << 23, 64
SLACK = 1e-6  # above the rounding of all steps in single and double precision


def units(raw: np.ndarray) -> np.ndarray:
    """Vectors of length 1; lengths neither overflow nor vanish."""
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Codes:
    """Int8 codes of unit vectors with their scale s, length a of the approximation, and u = a + e."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray):
        self.ids = ids
        self.scale = np.abs(unit).max(1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.q * self.scale[:, None]
        self.a = np.linalg.norm(near, axis=1)
        self.u = self.a + np.linalg.norm(unit - near, axis=1)

    FIELDS = (("ids", np.int64), ("scale", np.float64), ("a", np.float64), ("u", np.float64), ("q", np.int8))

    def to_row(self) -> dict:
        return {name: getattr(self, name).tobytes() for name, _ in self.FIELDS}

    @classmethod
    def from_row(cls, row) -> Codes:
        self = cls.__new__(cls)
        for name, kind in cls.FIELDS:
            setattr(self, name, np.frombuffer(getattr(row, name), kind))
        self.q = self.q.reshape(len(self.ids), -1)
        return self


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of all rows of int8 codes, exact: a float32 sum of up to 1,040 of them is a whole number below 2^24."""
    dims = x.shape[1]
    parts = [x[:, k : k + EXACT_COMPONENTS].astype(np.float32) @ y[:, k : k + EXACT_COMPONENTS].astype(np.float32).T for k in range(0, dims, EXACT_COMPONENTS)]
    return parts[0] if len(parts) == 1 else np.sum(parts, axis=0, dtype=np.float64)


def tiles(x: Codes, y: Codes, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, whether surely linked) of the pairs that may be linked, tile by tile."""
    bound = x.u * y.u.max() - x.a * y.a.min()
    least = (threshold - 2 * SLACK - bound) / (x.scale * y.scale.max())
    for low in range(0, len(x.ids), TILE):
        for left in range(low if same else 0, len(y.ids), 8 * TILE):
            found = products(x.q[low : low + TILE], y.q[left : left + 8 * TILE])
            i, j = np.nonzero(found >= least[low : low + TILE, None])
            s, i, j = found[i, j], i + low, j + left
            if same:
                above = j > i
                s, i, j = s[above], i[above], j[above]
            s = s * x.scale[i] * y.scale[j]
            error = x.u[i] * y.u[j] - x.a[i] * y.a[j] + SLACK
            possible = s + error >= threshold
            yield i[possible], j[possible], (s - error >= threshold)[possible]


class Links:
    """Counts and stars of the vectors of one or two blocks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, same: bool):
        self.ids, self.shift = (x, 0) if same else (np.concatenate([x, y]), len(x))
        self.counts, self.stars = np.zeros(len(self.ids), np.int64), Stars(len(self.ids))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        j = j + self.shift
        self.counts += np.bincount(i, minlength=len(self.ids)) + np.bincount(j, minlength=len(self.ids))
        self.stars.link(i, j)

    def frame(self, wanted: np.ndarray | None = None) -> pd.DataFrame:
        """Linked vectors with their links and star, and the ids of those that are still to be compared."""
        some = self.counts > 0
        rows = pd.DataFrame({"id": self.ids[some], "links": self.counts[some], "root": lowest_ids(self.ids, self.stars.root)[some]})
        if wanted is None:
            return rows
        return pd.concat([rows, pd.DataFrame({"id": self.ids[wanted], "links": np.zeros(wanted.sum(), np.int64), "root": self.ids[wanted]})])


def sure_links(x: Codes, y: Codes, same: bool, threshold: float) -> pd.DataFrame:
    """(id, links, root) of pairs that the codes decide; rows with 0 links name the vectors of undecided ones."""
    found = Links(x.ids, y.ids, same)
    wanted = np.zeros(len(found.ids), bool)
    for i, j, sure in tiles(x, y, same, threshold):
        found.add(i[sure], j[sure])
        wanted[i[~sure]] = wanted[j[~sure] + found.shift] = True
    return found.frame(wanted)


def undecided_links(x: tuple, y: tuple, same: bool, threshold: float) -> pd.DataFrame:
    """(id, links, root) of the pairs of (ids, unit vectors) that the codes do not decide, in double precision."""
    found = Links(x[0], y[0], same)
    for i, j, sure in tiles(Codes(*x), Codes(*y), same, threshold):
        i, j = i[~sure], j[~sure]
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            near = np.einsum("ij,ij->i", x[1][a], y[1][b]) >= threshold
            found.add(a[near], b[near])
    return found.frame()


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    least_components: int = LEAST_COMPONENTS, most_components: int = MOST_COMPONENTS,
) -> DataFrame:
    """``key``, n_links, component_id, kept for every row of ``vectors``.

    Two vectors are linked if they have as many components and their cosine is at least ``threshold`` (above 0). Null,
    empty and zero vectors, vectors with a null or non-finite component, and rows without an id link with nothing;
    without an id component_id is null and the row is kept. An id stands for one vector: of repeated rows with different
    vectors the one that sorts first is compared, and all get its result. Other columns are not read.
    """
    number = F.col(vector)
    fit = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(number, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), number.cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & fit).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    rows = settle(rows, "vectors")
    components = rows.agg(F.sum("dim").alias("n")).first()["n"] or 1
    blocks = max(-(-components // most_components), min(BLOCKS, -(-components // least_components)))
    place = F.pmod(F.xxhash64("id"), F.lit(blocks))

    def read(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        group = group.sort_values("id")
        return group["id"].to_numpy(np.int64), units(np.stack(group["v"].to_numpy()).astype(np.float64))

    def store(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[0]
        return pd.DataFrame([{"dim": head["dim"], "block": head["block"], **Codes(*read(group)).to_row()}])

    kinds = ", ".join(f"{name} binary" for name, _ in Codes.FIELDS)
    stored = rows.withColumn("block", place).groupBy("dim", "block").applyInPandas(store, f"dim int, block long, {kinds}")
    stored = settle(stored, "codes")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [Codes.from_row(row) for row in group.sort_values("block").itertuples()]
        if len(parts) == 1 and key[1] != key[2]:  # the other block has no vectors of this length
            return pd.DataFrame({"dim": [], "low": [], "high": [], "id": [], "links": [], "root": []})
        found = sure_links(parts[0], parts[-1], len(parts) == 1, threshold)
        return found.assign(dim=key[0], low=key[1], high=key[2])[["dim", "low", "high", "id", "links", "root"]]

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    meetings = stored.withColumn("other", other).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    )
    cells = ["dim", "low", "high"]
    decided = meetings.groupBy(*cells).applyInPandas(compare, "dim int, low long, high long, id long, links long, root long")
    decided = settle(decided, "sure-links")

    def recompute(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        same = key[1] == key[2]
        x = read(group[group["block"] == key[1]])
        return undecided_links(x, x if same else read(group[group["block"] == key[2]]), same, threshold)

    open_ = decided.filter("links = 0").select(*cells, "id").join(rows.select("id", "v"), "id").withColumn("block", place)
    checked = open_.groupBy(*cells).applyInPandas(recompute, "id long, links long, root long")
    found = decided.filter("links > 0").select("id", "links", "root").unionByName(checked)
    found = settle(found, "vector-links")
    totals = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    members = connected_components(found, "id", "root")
    ids = vectors.select(F.col(key).alias(key), F.col(key).cast("long").alias("id"))
    result = ids.join(totals, "id", "left").join(members, "id", "left")
    component = F.coalesce("component", "id")
    return result.select(
        key, F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
