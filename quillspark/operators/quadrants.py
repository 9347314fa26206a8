"""Thresholds on two values at once: the best pair of all, by sweeps over blocks, without the grid of both.

Points (x, y, positives, negatives) pass a pair (u, g) if x >= u and y >= g. Both axes are cut into blocks of about equal
numbers of points, at most BLOCKS, whose counts the driver holds; a task holds the points of one block of x or one of y.
"""

from __future__ import annotations

from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ACCEPTANCE, THRESHOLD_PAD
from .ranks import prefix_sums

#: Points a block, as long as there are no more than BLOCKS of them an axis: beyond, blocks grow, as a 256th of the points.
POINTS, BLOCKS = 2048, 256
#: Sums of weights that fit 64 bits are machine integers, larger ones Python's.
EXACT = 1 << 62


class Quadrants:
    """points (x, y, p, n), a row for each pair of values, neither null; positives, negatives: of all, nulls included."""

    def __init__(self, points: DataFrame, positives: int, negatives: int, block: int = POINTS):
        self.p, self.n = positives, negatives
        number = min(BLOCKS, max(1, -(-points.count() // block)))
        cut = points.approxQuantile(["x", "y"], [i / number for i in range(1, number)], 0.25 / number) if number > 1 else [[], []]
        xs, ys = (np.unique(np.array(c, dtype=float)) for c in cut)

        def deal(batches):
            for pdf in batches:
                yield pdf.assign(a=np.searchsorted(xs, pdf.x.to_numpy()), b=np.searchsorted(ys, pdf.y.to_numpy()))

        self.points = points.mapInPandas(deal, "x double, y double, p long, n long, a long, b long")
        cells = self.points.groupBy("a", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()  # BLOCKS squared at most
        self.shape = len(xs) + 1, len(ys) + 1
        self.counts = np.zeros((2, *self.shape), dtype=np.int64)
        for r in cells:
            self.counts[:, r.a, r.b] = r.p, r.n
        # sums over blocks from (a, b) on, one row and column of zeros behind them
        whole = self.counts[:, ::-1, ::-1].cumsum(1).cumsum(2)[:, ::-1, ::-1]
        self.onward = np.pad(whole, ((0, 0), (0, 1), (0, 1)))

    def weights(self) -> tuple[int, int, type]:
        """What a positive and a negative add to the key that candidates are compared by: the balanced accuracy times
        2 * p * n, exactly, and among equals the false positives."""
        p, n = max(1, self.p), max(1, self.n)
        return n * (self.n + 1), -(p * (self.n + 1) + 1), np.int64 if p * n * (self.n + 1) * 4 < EXACT else object

    def best(self) -> tuple[float, float]:
        """(u, g) of the largest balanced accuracy; of equals the fewest false positives, the largest g, the largest u."""
        wp, wn, kind = self.weights()
        onward, strips = self.onward, self.shape[1]

        def key(p, n):
            return np.asarray(p).astype(kind) * wp + np.asarray(n).astype(kind) * wn

        def across(pdf: pd.DataFrame) -> pd.DataFrame:
            """A block of x: of its values, those that can be best in a strip of y, given the strips above it.

            Between two points of the strip all values gain the same in it, so the best by what lies above stays so."""
            a = int(pdf.a.iloc[0])
            values, at = np.unique(pdf.x.to_numpy(), return_inverse=True)
            strip, p, n = pdf.b.to_numpy(), pdf.p.to_numpy(), pdf.n.to_numpy()
            order = np.argsort(strip, kind="stable")
            edges = np.searchsorted(strip[order], np.arange(strips + 1))
            above, out = np.zeros((2, len(values)), dtype=np.int64), []
            for b in range(strips - 1, -1, -1):
                rows = order[edges[b] : edges[b + 1]]
                starts = np.unique(np.concatenate([[0], at[rows] + 1]))
                starts = starts[starts < len(values)]
                k = key(*above)
                most = np.maximum.reduceat(k, starts)
                same = k == np.repeat(most, np.diff(np.append(starts, len(values))))
                kept = np.maximum.reduceat(np.where(same, np.arange(len(values)), -1), starts)
                out.append(pd.DataFrame({"b": b, "point": False, "x": values[kept], "y": 0.0, "p": above[0][kept] + onward[0, a + 1, b + 1], "n": above[1][kept] + onward[1, a + 1, b + 1]}))
                if len(rows):
                    out.append(pd.DataFrame({"b": b, "point": True, "x": values[at[rows]], "y": pdf.y.to_numpy()[rows], "p": p[rows], "n": n[rows]}))
                    for side, w in enumerate((p, n)):
                        new = np.zeros(len(values), dtype=np.int64)
                        np.add.at(new, at[rows], w[rows])
                        above[side] += new[::-1].cumsum()[::-1]
            return pd.concat(out)

        def along(pdf: pd.DataFrame) -> pd.DataFrame:
            """A strip of y from its largest value on: each point adds to all x up to its own; parts of sums share what
            is added to the whole of them."""
            some = pdf[~pdf.point].sort_values("x")
            u, k = some.x.to_numpy(), key(some.p.to_numpy(), some.n.to_numpy())
            points = pdf[pdf.point].sort_values("y", ascending=False, kind="stable")
            upto, gain, ys = np.searchsorted(u, points.x.to_numpy(), side="right"), key(points.p.to_numpy(), points.n.to_numpy()), points.y.to_numpy()
            size = max(1, int(len(u) ** 0.5))
            firsts = np.arange(0, len(u), size)
            lazy, most = np.zeros(len(firsts), dtype=kind), np.maximum.reduceat(k, firsts)
            top = -inf, inf, inf  # a strip has points
            for i in range(len(ys)):
                part, rest = divmod(int(upto[i]), size)
                lazy[:part] += gain[i]
                most[:part] += gain[i]
                if rest:
                    lo = part * size
                    k[lo : lo + rest] += gain[i]
                    most[part] = k[lo : lo + size].max() + lazy[part]
                if i + 1 == len(ys) or ys[i + 1] != ys[i]:
                    now = most.max()
                    if now > top[0]:
                        j = int(np.flatnonzero(most == now)[-1])
                        lo = j * size
                        top = now, float(ys[i]), float(u[lo + np.flatnonzero(k[lo : lo + size] + lazy[j] == now)[-1]])
            return pd.DataFrame({"k": pd.Series([str(top[0])], dtype=object), "g": [top[1]], "u": [top[2]]})

        passed_on = self.points.groupBy("a").applyInPandas(across, "b long, point boolean, x double, y double, p long, n long")
        found = passed_on.groupBy("b").applyInPandas(along, "k string, g double, u double").collect()  # a row a strip
        k, g, u = max([(0, inf, inf), *[(int(r.k), r.g, r.u) for r in found]])
        return u, g

    def strictest(self) -> tuple[float, float] | None:
        """The largest g at which some u has the recall and the false-positive rate that acceptance asks for, with the
        best u there; None without any. (Both imply the balanced accuracy that it asks for.)

        The largest u that leaves the recall high enough has the fewest false positives. It rises as g falls, so it goes
        through at most as many tiles (a block of x, a strip of y) as both axes have blocks."""
        p, n = max(1, self.p), max(1, self.n)
        least, most = int(ACCEPTANCE["recall"] * p), int(ACCEPTANCE["false_positive_rate"] * n) + 1
        while least / p < ACCEPTANCE["recall"]:
            least += 1
        while most / n > ACCEPTANCE["false_positive_rate"]:
            most -= 1
        onward, (blocks, strips) = self.onward, self.shape
        reached = [int((onward[0, :blocks, b] >= least).sum()) - 1 for b in range(strips + 1)]  # the block of that u, -1: none
        tiles = [(a, b) for b in range(strips) for a in range(max(0, reached[b + 1]), reached[b] + 1)]
        if not tiles:
            return None
        of_block, of_strip = [[] for _ in range(blocks)], [[] for _ in range(strips)]
        for i, (a, b) in enumerate(tiles):
            of_block[a].append((b, i))
            of_strip[b].append((a, i))

        def spread(batches):
            for pdf in batches:
                rows, at = [], []
                for i, (a, b) in enumerate(zip(pdf.a, pdf.b)):
                    here = [t for s, t in of_block[a] if s <= b] + [t for c, t in of_strip[b] if c < a]
                    rows += [i] * len(here)
                    at += here
                yield pdf.iloc[rows].assign(tile=np.array(at, dtype=np.int64))

        def descend(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = tiles[int(pdf.tile.iloc[0])]
            inside, strip = pdf.a.to_numpy() == a, pdf.b.to_numpy() == b
            values = np.unique(pdf.x.to_numpy()[inside])
            sums = np.zeros((2, len(values)), dtype=np.int64)
            for side, w in enumerate((pdf.p.to_numpy(), pdf.n.to_numpy())):
                np.add.at(sums[side], np.searchsorted(values, pdf.x.to_numpy()[~strip]), w[~strip])
            sums = sums[:, ::-1].cumsum(1)[:, ::-1].copy()
            right = [int(onward[0, a + 1, b + 1]), int(onward[1, a + 1, b + 1])]
            rows = pdf[strip].sort_values("y", ascending=False)
            x, ys, adds, own = rows.x.to_numpy(), rows.y.to_numpy(), (rows.p.to_numpy(), rows.n.to_numpy()), rows.a.to_numpy() == a
            place = np.searchsorted(values, x)
            for i in range(len(ys)):
                for side in (0, 1):
                    if own[i]:
                        sums[side, : place[i] + 1] += adds[side][i]
                    else:
                        right[side] += int(adds[side][i])
                if (i + 1 == len(ys) or ys[i + 1] != ys[i]) and right[0] < least and len(values) and sums[0, 0] + right[0] >= least:
                    lo, hi = 0, len(values)  # the last place with enough positives
                    while hi - lo > 1:
                        mid = (lo + hi) // 2
                        lo, hi = (mid, hi) if sums[0, mid] + right[0] >= least else (lo, mid)
                    if sums[1, lo] + right[1] <= most:
                        return pd.DataFrame({"g": [float(ys[i])]})
            return pd.DataFrame({"g": np.zeros(0)})

        dealt = self.points.mapInPandas(spread, self.points.schema.simpleString()[7:-1].replace(":", " ") + ", tile long")
        g = dealt.groupBy("tile").applyInPandas(descend, "g double").agg(F.max("g")).first()[0]
        if g is None:
            return None
        ties = self.points.where(F.col("y") >= g).groupBy("x").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        rows = prefix_sums(ties, [], "x", ["p", "n"])
        tp, fp = (F.col(f"{s}_all") - F.col(f"{s}_upto") + F.col(s) for s in "pn")
        big = lambda c, k: c.cast("decimal(19,0)") * F.lit(k).cast("decimal(19,0)")
        u = rows.where((tp >= least) & (fp <= most)).agg(F.max_by("x", F.struct(big(tp, n) - big(fp, p), -fp, "x"))).first()[0]
        return u, g

    def thresholds(self, u: float, g: float) -> tuple[float, float]:
        """Half-way to the value before; beyond the first or the last value by a small step."""
        below = self.points.agg(*[f for c, at in (("x", u), ("y", g)) for f in (F.max(F.when(F.col(c) < at, F.col(c))).alias(f"{c}_below"), F.max(c).alias(f"{c}_last"))]).first()
        one = lambda at, low, last: last + THRESHOLD_PAD if at == inf else at - THRESHOLD_PAD if low is None else (low + at) / 2
        return one(u, below.x_below, below.x_last), one(g, below.y_below, below.y_last)
