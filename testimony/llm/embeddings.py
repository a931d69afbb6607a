"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector x is rotated at random and coded by the signs c of its coordinates over sqrt(D), with the correction
factor f = <x, c> stored beside. For any other y, <c, y> / f is an unbiased estimate of <x, y> over rotations, with a
standard deviation of sqrt((1 - f^2) / f^2 * (1 - <x, y>^2) / (D - 1)). So that no vector has to travel, y goes as
4 bits a coordinate, rounded up or down at random, which keeps the estimate unbiased and adds at most step / (2 f).
A pair whose estimate lies more than ``errors`` standard deviations under the threshold is taken as under it;
at 6 that is wrong for fewer than 1 pair at the threshold in 10^7 (sub-Gaussian tails: 2 exp(-18) = 3e-8). Vectors with a partner that
is not ruled out are fetched, and their cosines computed in double precision: only those make links.

Equal vectors are one class. Classes are dealt into blocks and each pair of blocks meets in one task, with codes alone at first, then
with the vectors still in question; it returns counts and a spanning forest, never the links themselves. Blocks are formed around
pivots, with the widest angle from pivot to member kept beside; two blocks whose pivots are farther
apart than both widths and the threshold's angle together cannot hold a link and never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.llm.common import broadcast_if_small, components, settle

#: Vectors of one block on average.
ROWS_PER_BLOCK = 4_000
#: Most pivots; pairs of their cells are planned on the driver and broadcast.
PIVOTS = 256
#: Under so many dimensions a code says too little: all vectors of the length are compared exactly.
LEAST_DIMS = 16
LEVELS = 4
_TILE = 512


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(17).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    data = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(data, ((0, 0), (0, -data.shape[1] % 8))).view(np.uint64)


def encode(unit: np.ndarray, seed: int = 23) -> dict[str, np.ndarray]:
    """Of rotated unit vectors: ``code`` (words of sign bits), ``factor``, and the 4-bit form: ``planes`` (words of its
    bits, lowest first), ``low`` and ``step`` of its scale, ``total`` of its values."""
    turned = unit @ rotation(unit.shape[1]).T
    low, high = turned.min(axis=1), turned.max(axis=1)
    step = np.maximum(high - low, 1e-300) / ((1 << LEVELS) - 1)
    dice = np.random.default_rng(seed).random(turned.shape)
    q = np.minimum(np.floor((turned - low[:, None]) / step[:, None] + dice), (1 << LEVELS) - 1).astype(np.uint8)
    planes = np.concatenate([_words(q >> k & 1) for k in range(LEVELS)], axis=1)
    factor = np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])
    return {"code": _words(turned >= 0), "factor": factor, "planes": planes, "low": low, "step": step, "total": q.sum(axis=1, dtype=np.int64)}


def _bits(words: np.ndarray, dims: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, :dims]


def inner(x: dict[str, np.ndarray], y: dict[str, np.ndarray], dims: int) -> np.ndarray:
    """Sums of y's 4-bit values where x's bits are set: whole numbers, exact in single precision."""
    words = x["code"].shape[1]
    values = sum(_bits(y["planes"][:, k * words : (k + 1) * words], dims).astype(np.float32) * np.float32(1 << k) for k in range(LEVELS))
    return _bits(x["code"], dims).astype(np.float32) @ values.T


def estimates(x: dict[str, np.ndarray], y: dict[str, np.ndarray], dims: int) -> np.ndarray:
    """Estimated cosines of all x, by their codes and factors, with all y, by their 4-bit forms."""
    ones = np.bitwise_count(x["code"]).sum(axis=1, dtype=np.int64)
    product = 2 * y["step"] * inner(x, y, dims) + np.multiply.outer(2.0 * ones, y["low"]) - (y["step"] * y["total"] + dims * y["low"])
    return product / (np.sqrt(dims) * x["factor"][:, None])


def deviations(factor: np.ndarray, step: float | np.ndarray, dims: int, least: float) -> np.ndarray:
    """Standard deviations of estimates for pairs with a cosine of ``least``; above it they are less."""
    return np.sqrt((1 - factor**2) / factor**2 * (1 - least**2) / (dims - 1) + step**2 / (4 * factor**2))


def least_inner(x: dict[str, np.ndarray], y: dict[str, np.ndarray], dims: int, least: float, errors: float) -> np.ndarray:
    """The ``inner`` from which on a pair's estimate is at most ``errors`` deviations under ``least``, by the widest step of y."""
    low = np.sqrt(dims) * x["factor"] * (least - errors * deviations(x["factor"], y["step"].max(), dims, least))
    ones = 2.0 * np.bitwise_count(x["code"]).sum(axis=1, dtype=np.int64)
    one, other = np.stack([low, np.ones(len(low)), -ones], 1), np.stack([np.ones(len(y["low"])), y["step"] * y["total"] + dims * y["low"], y["low"]])
    return (one.astype(np.float32) @ (other / (2 * y["step"])).astype(np.float32)) - np.float32(0.01)


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_CODED = "node long, h long, cell int, angle double, code binary, factor double, planes binary, low double, step double, total long"
_MEETING = ["ci", "cj", "pi", "pj"]


def _encoded(pivots: np.ndarray):
    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, pdf in enumerate(batches):
            if len(pdf):
                unit = _unit(pdf["vector"])
                cos = np.clip(unit @ pivots.T, -1, 1)
                best = cos.argmax(axis=1)
                made = encode(unit, n)
                raw = {k: [r.tobytes() for r in v] if v.ndim == 2 else v for k, v in made.items()}
                yield pd.DataFrame({"node": pdf["node"], "h": pdf["h"], "cell": best.astype("int32"), "angle": np.arccos(cos[np.arange(len(pdf)), best]), **raw})

    return encoded


def _open(least: float, errors: float, dims: int):
    def open_(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of two blocks (or one with itself) the classes with a partner that the codes do not rule out."""
        side, node = pdf["side"].to_numpy(), pdf["node"].to_numpy()
        same = bool((pdf[["ci", "pi"]].to_numpy()[0] == pdf[["cj", "pj"]].to_numpy()[0]).all())
        parts = {k: np.frombuffer(b"".join(pdf[k]), np.uint64).reshape(len(pdf), -1) if k in ("code", "planes") else pdf[k].to_numpy() for k in ("code", "factor", "planes", "low", "step", "total")}
        of = lambda at: {k: v[at] for k, v in parts.items()}
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        some = np.zeros(len(pdf), bool)
        for i in range(0, len(a), _TILE):
            x, own = of(a[i : i + _TILE]), a[i : i + _TILE]
            for j in range(i if same else 0, len(b), _TILE):
                y, other = of(b[j : j + _TILE]), b[j : j + _TILE]
                near = np.ones((len(own), len(other)), bool)
                if dims >= LEAST_DIMS:
                    near = inner(x, y, dims) >= least_inner(x, y, dims, least, errors)
                if same:
                    near &= own[:, None] < other[None, :]
                some[own] |= near.any(axis=1)
                some[other] |= near.any(axis=0)
        return pdf.loc[some, [*_MEETING, "side", "node"]]

    return open_


def _cosines(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have a cosine of at least ``least``; those within rounding of it are summed pair by pair."""
    ok = np.empty((len(x), len(y)), bool)
    for a in range(0, len(x), _TILE):
        cos = x[a : a + _TILE] @ y.T
        ok[a : a + _TILE] = cos >= least
        i, j = np.nonzero(np.abs(cos - least) < 1e-9)
        ok[i + a, j] = np.einsum("ij,ij->i", x[i + a], y[j]) >= least
    return ok


def _forest(ok: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Pairs of ``ok`` that span its components, breadth first; columns are numbered after the rows unless they are the same."""
    n = len(ok)
    left, edges = np.arange(n if same else n + ok.shape[1]), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            if same:
                hit = left[ok[i, left]]
            elif i < n:
                over = left[left >= n]
                hit = over[ok[i, over - n]]
            else:
                over = left[left < n]
                hit = over[ok[over, i - n]]
            edges += [(i, int(j)) for j in hit]
            queue += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
    return edges


def _meet(least: float):
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks (or one block with itself): partial link counts and forest edges."""
        side = pdf["side"].to_numpy()
        same = bool((pdf[["ci", "pi"]].to_numpy()[0] == pdf[["cj", "pj"]].to_numpy()[0]).all())
        a = pdf[side == 0]
        b = a if same else pdf[side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "n": [], "to": []}).astype("int64")
        x = _unit(a["vector"])
        ok = _cosines(x, x if same else _unit(b["vector"]), least)
        if same:
            np.fill_diagonal(ok, False)
        ids = np.concatenate([a["node"].to_numpy(), [] if same else b["node"].to_numpy()]).astype(np.int64)
        n = ok @ b["copies"].to_numpy()
        if not same:
            n = np.concatenate([n, ok.T @ a["copies"].to_numpy()])
        counts = pd.DataFrame({"node": ids[n > 0], "n": n[n > 0], "to": 0})
        edges = np.array(_forest(ok, same), np.int64).reshape(-1, 2)
        return pd.concat([counts, pd.DataFrame({"node": ids[edges[:, 0]], "n": 0, "to": ids[edges[:, 1]]})])[["node", "n", "to"]].astype("int64")

    return meet


def link_embeddings(
    vectors: DataFrame, *, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_block: int = ROWS_PER_BLOCK, pivots: int = PIVOTS, errors: float = 6.0
) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is at least ``least``; codes rule pairs out with ``errors``
    standard deviations to spare (see above). n_links counts the
    other vectors linked directly, copies included; component_id is the smallest vec_id
    reachable by links, itself included; kept marks vec_id = component_id.

    Null, empty and zero vectors, those with null or non-finite components, and rows with a null id
    link with nothing: n_links 0, component_id their own id, kept true (null for a null id). Vectors
    of different lengths never link. Repeated rows are vectors of their own, linked with each
    other; different vectors under one id are one node, whose links add up. An empty table gives an empty result. Other columns are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    most = F.array_max(F.transform(v, F.abs))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("vector"), most.alias("_most"), F.exists(v, F.isnull).alias("_gap"))
    fine = F.col("_most").isNotNull() & ~F.col("_gap") & ~F.isnan("_most") & (F.col("_most") > 0) & (F.col("_most") < float("inf")) & F.col("vec_id").isNotNull()
    rows = rows.select("vec_id", F.coalesce(fine, F.lit(False)).alias("fine"), "vector", F.md5(F.to_json("vector").cast("binary")).alias("key"))
    # One class for equal vectors, named by its least id.
    classes = settle(rows.where("fine").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    sizes = {r.d: r.n for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = None
    for dims, n in sorted(sizes.items()):
        part = _links_of(classes.where(F.size("vector") == dims), dims, n, least, rows_per_block, pivots, errors)
        found = part if found is None else found.unionByName(part)
    member = rows.select("vec_id", "fine", F.when(F.col("fine"), F.col("key")).alias("key"))
    if found is None:
        return member.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    found = settle(found)
    links = found.where("n = 0").select(F.col("node").alias("a"), F.col("to").alias("b"))
    parts = components(links).withColumnRenamed("node", "_c")
    counts = found.where("n > 0").groupBy(F.col("node").alias("_n")).agg(F.sum("n").alias("n"))
    classes = classes.select("key", "node", "copies").join(broadcast_if_small(counts), F.col("node") == F.col("_n"), "left")
    classes = classes.join(broadcast_if_small(parts), F.col("node") == F.col("_c"), "left")
    classes = settle(classes.select(F.col("key").alias("_key"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "node").alias("_component")))
    out = member.join(broadcast_if_small(classes), F.col("key") == F.col("_key"), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )


def _links_of(classes: DataFrame, dims: int, n: int, least: float, rows_per_block: int, pivots: int, errors: float) -> DataFrame:
    """(node, n, to): link counts (n > 0) and forest edges (n = 0) between classes of one length."""
    few = min(pivots, max(1, -(-n // rows_per_block)))
    chosen = [r.vector for r in classes.orderBy(F.xxhash64("key")).limit(few).select("vector").collect()]
    centre = _unit(chosen)
    coded = settle(classes.select("node", "vector", F.xxhash64("key").alias("h")).mapInPandas(_encoded(centre), _CODED))
    cells = [(r.cell, max(1, round(r.n / rows_per_block)), r.width) for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("width")).collect()]
    reach = float(np.arccos(np.clip(least, -1, 1))) + 1e-6
    between = np.arccos(np.clip(centre @ centre.T, -1, 1))
    # Which cells may hold links: at most pivots^2 rows. A cell of many rows has parts, dealt by hash; which
    # parts meet follows from their numbers, so no list of them is made.
    near = [(c, parts, d, others) for c, parts, w in cells for d, others, v in cells if between[c, d] <= w + v + reach]
    plan = classes.sparkSession.createDataFrame(near, "cell int, parts int, other int, others int")
    met = coded.join(F.broadcast(plan), "cell").withColumn("part", F.pmod("h", F.col("parts")).cast("int"))
    met = met.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    own, other = F.struct(F.col("cell").alias("c"), F.col("part").alias("p")), F.struct(F.col("other").alias("c"), F.col("to").alias("p"))
    low, high = F.least(own, other), F.greatest(own, other)
    met = met.select(
        low.c.alias("ci"), high.c.alias("cj"), low.p.alias("pi"), high.p.alias("pj"), F.when(own <= other, 0).otherwise(1).alias("side"),
        "node", "code", "factor", "planes", "low", "step", "total",
    )
    meeting = "ci int, cj int, pi int, pj int, side int, node long"
    asked = settle(met.groupBy(*_MEETING).applyInPandas(_open(least, errors, dims), meeting))
    sent = asked.join(classes.select("node", "copies", "vector"), "node")
    return sent.groupBy(*_MEETING).applyInPandas(_meet(least), "node long, n long, to long")
