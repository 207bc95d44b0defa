"""Truncation of ranked lists by their scores: filters that drop a tail and never reorder.

A list is the rows of one qid, in the order of `rank` (from 1). Every method is a window expression over lists, so a batch of
lists is cut in one pass; what is kept is a boolean column, and a method never adds or moves a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parameters that a method needs at least, and how many it takes by default.
NEEDED = {"abs": 1, "ratio": 1, "gap": 0, "knee": 0, "mad": 0, "source": 1}
DEFAULTS = {"gap": (0.5,), "mad": (3.0,)}
#: A curve of fewer points has no knee, a list of fewer scores no spread.
KNEE_POINTS, MAD_POINTS = 4, 3


@dataclass(frozen=True)
class Spec:
    """A method with its parameters: name[:p1[,p2]]; off keeps everything."""

    name: str
    params: tuple[float, ...] = ()

    @staticmethod
    def parse(text: str | None) -> Spec:
        """Raises ValueError for an unknown name, a parameter that is no number, or too few parameters."""
        if not text or text == "off":
            return Spec("off")
        name, _, rest = text.partition(":")
        if name not in NEEDED:
            raise ValueError(f"no such truncation: {name}")
        params = tuple(float(x) for x in rest.split(",") if x)
        if len(params) < NEEDED[name]:
            raise ValueError(f"{name} needs {NEEDED[name]} parameter(s)")
        return Spec(name, params or DEFAULTS.get(name, ()))


def _list(*by: str):
    return Window.partitionBy(*by)


def keep(spec: Spec, mode: str = "hybrid", by: tuple[str, ...] = ("qid",)) -> Column:
    """Whether a row stays, as an expression over rank, score and, in hybrid mode, sources."""
    return {"off": lambda *_: F.lit(True), "abs": _floor, "ratio": _ratio, "gap": _gap, "knee": _knee, "mad": _mad, "source": _source}[spec.name](spec.params, mode, by)


def _floor(p, mode, by) -> Column:
    return F.col("score") >= p[0]


def _ratio(p, mode, by) -> Column:
    return F.col("score") >= p[0] * F.first("score").over(_list(*by).orderBy("rank"))


def _points(by) -> tuple[Column, Column]:
    """The list's scores in order, and a row's own place among them (from 1)."""
    order = _list(*by).orderBy("rank")
    return F.collect_list("score").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.row_number().over(order)


def _gap(p, mode, by) -> Column:
    """Up to the first score below p times the one before it."""
    points, place = _points(by)
    falls = F.filter(F.transform(points, lambda s, i: F.when((i > 0) & (F.get(points, i - 1) > 0) & (s < p[0] * F.get(points, i - 1)), i)), lambda i: i.isNotNull())
    return F.coalesce(place <= F.get(falls, F.lit(0)), F.lit(True))


def _knee(p, mode, by) -> Column:
    """Up to the first point furthest below the line from the first to the last score. Flat and short lists stay whole."""
    points, place = _points(by)
    n = F.size(points)
    first, last = F.get(points, F.lit(0)), F.get(points, n - 1)
    # depth below the line at place i; only depths over -1 count, else the cut is before place 1
    depth = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.struct((first + (last - first) * (i / F.greatest(n - 1, F.lit(1))) - F.get(points, i)).alias("d"), i.alias("i")))
    start = F.struct(F.lit(-1.0).alias("d"), F.lit(1).alias("i"))
    cut = F.aggregate(depth, start, lambda best, x: F.when(x["d"] > best["d"], x).otherwise(best), lambda best: best["i"])
    return F.when((n < KNEE_POINTS) | (first - last <= 0), True).otherwise(place <= cut)


def _mad(p, mode, by) -> Column:
    """At least p median absolute deviations above the median; lists without spread stay whole."""
    whole = _list(*by)
    scores = F.collect_list("score").over(whole)
    middle = lambda values: F.when(F.size(values) % 2 == 1, F.get(values, F.floor(F.size(values) / 2).cast("int"))).otherwise((F.get(values, F.floor(F.size(values) / 2).cast("int") - 1) + F.get(values, F.floor(F.size(values) / 2).cast("int"))) / 2)
    median = middle(F.sort_array(scores))
    spread = middle(F.sort_array(F.transform(scores, lambda s: F.abs(s - median))))
    odd = F.exists(scores, lambda s: F.isnan(s) | (F.abs(s) == float("inf")))
    return F.when((F.size(scores) < MAD_POINTS) | odd | (spread <= 0), True).otherwise(F.col("score") >= median + p[0] * spread)


def _source(p, mode, by) -> Column:
    """Hybrid: one of the arms present reaches its own floor. One arm: its score reaches the floor."""
    if mode == "hybrid":
        if len(p) < 2:
            raise ValueError("source needs two parameters for hybrid lists")
        reaches = lambda arm, floor: F.coalesce(F.try_element_at(F.col("sources"), F.lit(arm)) >= floor, F.lit(False))
        return reaches("vector", p[0]) | reaches("lexical", p[1])
    return F.col("score") >= (p[1] if mode == "lexical" and len(p) > 1 else p[0])


def truncate(lists: DataFrame, spec: str | Spec | None, mode: str = "hybrid", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The rows of lists that stay. Ranks keep their values, so a second cut sees the same order."""
    parsed = spec if isinstance(spec, Spec) else Spec.parse(spec)
    if parsed.name == "off":
        return lists
    return lists.withColumn("_keep", keep(parsed, mode, by)).where("_keep").drop("_keep")


def calibrated(lists: DataFrame, floor: float | None, mode: str = "hybrid", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The corpus floor, where one is known, and then the knee of what is left."""
    return truncate(lists if floor is None else truncate(lists, Spec("abs", (floor,)), mode, by), "knee", mode, by)


def calibrated_soft(lists: DataFrame, floor: float, share: float = 0.98, cap: int = 5, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Scores of almost the floor, the first few of them; for analysis."""
    rows = truncate(lists, Spec("abs", (share * floor,)), by=by)
    return rows.withColumn("_n", F.row_number().over(_list(*by).orderBy("rank"))).where(F.col("_n") <= cap).drop("_n")


def min_score(lists: DataFrame, least: float | Column | None) -> DataFrame:
    """Rows of at least that score; null keeps all."""
    if least is None:
        return lists
    floor = least if isinstance(least, Column) else F.lit(least)
    return lists.where(floor.isNull() | (F.col("score") >= floor))
