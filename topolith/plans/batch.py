"""Running rules by name, alone or in batches, and reporting on them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import lines, points, polygons, transforms
from ..operators.transforms import line_of
from ..schema import COORDS, RINGS


@dataclass(frozen=True)
class RuleSpec:
    """A rule on named inputs. ``crs`` holds the reference systems of inputs where known."""

    family: str
    rule: str
    inputs: dict[str, DataFrame]
    crs: dict[str, str | None] = field(default_factory=dict)
    cell: float | None = None

    def check(self) -> None:
        """Inputs must share a reference system; one that is missing fits any."""
        known = {v for k, v in self.crs.items() if v is not None}
        if len(known) > 1:
            raise ValueError(f"{self.rule}: inputs have different reference systems: {', '.join(f'{k} {v}' for k, v in sorted(self.crs.items()))}")


def _part(coords: Column | None = None, rings: Column | None = None) -> Column:
    return F.array(
        F.struct(
            (F.lit(None).cast(COORDS) if coords is None else coords).alias("coords"),
            (F.lit(None).cast(RINGS) if rings is None else rings).alias("rings"),
        )
    )


def _points(df: DataFrame) -> DataFrame:
    return df.select(F.lit("Point").alias("kind"), _part(line_of(F.col("x"), F.col("y"))).alias("parts"))


def _segments(df: DataFrame) -> DataFrame:
    return df.select(F.lit("LineString").alias("kind"), _part(line_of(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))).alias("parts"))


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.lit("LineString").alias("kind"), _part(F.col("coords")).alias("parts"))


def _polygons(df: DataFrame) -> DataFrame:
    return df.select(F.lit("Polygon").alias("kind"), _part(rings=F.col("rings")).alias("parts"))


def _intersect(i: dict, cell) -> DataFrame:
    found, stretches = lines.must_not_intersect(i["lines"], cell)
    return _points(found).unionByName(_segments(stretches))


#: What each rule needs and does: input names, and the errors as kind and parts.
RULES: dict[tuple[str, str], tuple[tuple[str, ...], Callable[[dict, float | None], DataFrame]]] = {
    ("point", "must-not-overlap"): (("points",), lambda i, c: _points(points.must_not_overlap(i["points"]))),
    ("point", "must-not-overlap-with"): (("points", "other"), lambda i, c: _points(points.must_not_overlap_with(i["points"], i["other"]))),
    ("point", "must-be-inside"): (("points", "polygons"), lambda i, c: _points(points.must_be_inside(i["points"], i["polygons"], c))),
    ("line", "must-not-overlap"): (("lines",), lambda i, c: _segments(lines.must_not_overlap(i["lines"], c))),
    ("line", "must-not-overlap-with"): (("lines", "other"), lambda i, c: _segments(lines.must_not_overlap_with(i["lines"], i["other"], c))),
    ("line", "must-not-self-overlap"): (("lines",), lambda i, c: _segments(lines.must_not_self_overlap(i["lines"]))),
    ("line", "must-not-intersect"): (("lines",), _intersect),
    ("line", "must-not-have-dangles"): (("lines",), lambda i, c: _points(lines.must_not_have_dangles(i["lines"], c))),
    ("line", "must-be-inside"): (("lines", "polygons"), lambda i, c: _lines(lines.must_be_inside(i["lines"], i["polygons"], c))),
    ("polygon", "must-not-overlap"): (("polygons",), lambda i, c: _polygons(polygons.must_not_overlap(i["polygons"], c))),
    ("polygon", "must-not-overlap-with"): (("polygons", "other"), lambda i, c: _polygons(polygons.must_not_overlap_with(i["polygons"], i["other"], c))),
    ("polygon", "must-not-have-gaps"): (("polygons",), lambda i, c: _segments(polygons.must_not_have_gaps(i["polygons"], c))),
    ("geometry", "must-not-be-multipart"): (("features",), lambda i, c: transforms.multiparts(i["features"]).select("kind", "parts")),
}

#: How features of a file become the input of a name.
FLATTEN = {
    "point": {"points": transforms.flatten_points, "other": transforms.flatten_points, "polygons": transforms.flatten_polygons},
    "line": {"lines": transforms.flatten_lines, "other": transforms.flatten_lines, "polygons": transforms.flatten_polygons},
    "polygon": {"polygons": transforms.flatten_polygons, "other": transforms.flatten_polygons},
    "geometry": {"features": lambda df: df},
}


def run_rule(spec: RuleSpec, name: str | None = None) -> DataFrame:
    """The errors that a rule finds: ``rule, kind, parts``; no row means valid."""
    if (spec.family, spec.rule) not in RULES:
        raise ValueError(f"no rule {spec.rule} for {spec.family}")
    wanted, run = RULES[spec.family, spec.rule]
    if set(wanted) != set(spec.inputs):
        raise ValueError(f"{spec.family} {spec.rule} takes {', '.join(wanted)}; got {', '.join(sorted(spec.inputs)) or 'nothing'}")
    spec.check()
    return run(spec.inputs, spec.cell).select(F.lit(name or spec.rule).alias("rule"), "kind", "parts")


def run_batch(specs: list[RuleSpec]) -> DataFrame:
    """All rules' errors in one frame, rules named by their place: ``1-must-not-overlap``."""
    if not specs:
        raise ValueError("no rules")
    seen: list[tuple] = []
    for s in specs:
        key = (s.family, s.rule, {k: id(v) for k, v in s.inputs.items()})
        if key in seen:
            raise ValueError(f"{s.family} {s.rule} is there twice with the same inputs")
        seen.append(key)
    return reduce(DataFrame.unionByName, [run_rule(s, f"{k}-{s.rule}") for k, s in enumerate(specs, 1)])


def summary(errors: DataFrame) -> DataFrame:
    """``rule, kind, n``: errors by rule and kind."""
    return errors.groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("n"))


def is_valid(errors: DataFrame) -> bool:
    return errors.isEmpty()


def errors_of(errors: DataFrame, kind: str) -> DataFrame:
    """The errors of one kind."""
    return errors.where(F.col("kind") == kind)


_LABELS = {"Point": "Point", "LineString": "Linestring", "Polygon": "Polygon", "MultiPoint": "MultiPoint", "MultiLineString": "MultiLinestring", "MultiPolygon": "MultiPolygon"}


def summary_text(errors: DataFrame, rules: list[str]) -> str:
    """A banner for each rule with its counts; rules without errors are named too."""
    counts: dict[str, list] = {}
    for r in summary(errors).orderBy("rule", "kind").collect():  # a row for each rule and kind
        counts.setdefault(r["rule"], []).append(f"{r['n']} {_LABELS.get(r['kind'], r['kind'])} errors")
    out = []
    for rule in rules:
        out += ["=" * 60, rule, "=" * 60, *(counts.get(rule) or ["No topology errors found."])]
    return "\n".join(out)


def timed(action: Callable, *args):
    """The result of an action, and the seconds it took."""
    began = time.perf_counter()
    return action(*args), time.perf_counter() - began
