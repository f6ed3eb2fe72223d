"""Command line: ``python -m topolith FAMILY RULE name=path ... [--out PATH]``.

    python -m topolith point must-be-inside points=a.geojson polygons=b.gpkg --out errors.gpkg
    python -m topolith batch 'point must-not-overlap points=a.geojson' 'line must-not-have-dangles lines=l.shp' --out errors.gpkg
    python -m topolith utilities merge-linestrings lines=l.shp --out merged.geojson
    python -m topolith drivers [read|write]

``batch`` without rules reads them line by line from the input, up to a line ``summary``.
"""

from __future__ import annotations

import argparse
import os
import shlex
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import merge, transforms
from .plans import batch
from .sources import drivers, readers, writers


def _pairs(words: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for w in words:
        key, eq, value = w.partition("=")
        if not eq or not key or not value:
            raise SystemExit(f"not name=path: {w}")
        key = key.lower().replace("-", "_")
        if key in out:
            raise SystemExit(f"{key} is given twice")
        out[key] = value
    return out


def _driver(spark: SparkSession, path: str, named: str | None, by_content: bool) -> str | None:
    return drivers.driver_of_content(spark, path).name if by_content and not named else named


def _spec(spark: SparkSession, family: str, rule: str, words: list[str], driver: str | None, by_content: bool = False) -> batch.RuleSpec:
    if family not in batch.FLATTEN or (family, rule) not in batch.RULES:
        raise SystemExit(f"no rule {rule} for {family}")
    paths = _pairs(words)
    unknown = set(paths) - set(batch.RULES[family, rule][0])
    if unknown:
        raise SystemExit(f"{family} {rule} takes {', '.join(batch.RULES[family, rule][0])}")
    named = {k: _driver(spark, p, driver, by_content) for k, p in paths.items()}
    inputs = {k: batch.FLATTEN[family][k](readers.require_features(readers.read_features(spark, p, named[k]))) for k, p in paths.items()}
    return batch.RuleSpec(family, rule, inputs, {k: readers.probe_crs(spark, p, named[k]) for k, p in paths.items()})


def _rules(lines: Iterable[str]) -> list[str]:
    """Rules line by line, up to a line ``summary`` or the end; blank lines don't count."""
    out = []
    for line in lines:
        line = line.strip()
        if line.lower() == "summary":
            break
        if line:
            out.append(line)
    return out


def _lines(df: DataFrame) -> DataFrame:
    rings = F.lit(None).cast("array<array<struct<x:double,y:double>>>")
    return df.select(F.lit("LineString").alias("kind"), F.array(F.struct("coords", rings.alias("rings"))).alias("parts"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="topolith", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("what", choices=[*batch.FLATTEN, "batch", "utilities", "drivers"])
    p.add_argument("words", nargs="*")
    p.add_argument("--driver", default=os.environ.get("TOPOLITH_DRIVER"), help="name of the format, where extensions don't tell")
    p.add_argument("--out", help="where errors or results go")
    p.add_argument("--epsg", type=int, default=os.environ.get("TOPOLITH_EPSG"), help="reference system written to a GeoPackage")
    p.add_argument("--by-content", action="store_true", help="tell formats by the files' first bytes, not by extensions")
    p.add_argument("--elapsed", action="store_true", help="tell the seconds it took")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("topolith").getOrCreate()

    def work() -> None:
        if a.what == "drivers":
            only = {"read": {"read": True}, "write": {"write": True}}.get(a.words[0] if a.words else "", {})
            for r in drivers.list_drivers(spark, **only).collect():
                print(f"{r['driver']}: {r['extensions']}")
            return
        if a.what == "utilities":
            name, found = a.words[0], _pairs(a.words[1:])
            features = readers.require_features(readers.read_features(spark, found["lines"], _driver(spark, found["lines"], a.driver, a.by_content)))
            lines = transforms.flatten_lines(features)
            if name == "merge-linestrings":
                result = _lines(merge.merge_lines(lines))
            elif name == "explode-linestrings":
                segs = transforms.explode_lines(lines)
                result = _lines(segs.select(transforms.line_of(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("coords")))
            else:
                raise SystemExit(f"no utility {name}")
            if not a.out:
                raise SystemExit("utilities need --out")
            writers.write_features(result, a.out, layer=name.replace("-", "_"), epsg=a.epsg)
            return
        if a.what == "batch":
            specs = []
            for w in a.words or _rules(sys.stdin):
                family, rule, *rest = shlex.split(w)
                specs.append(_spec(spark, family, rule, rest, a.driver, a.by_content))
            errors, names = batch.run_batch(specs), [f"{k}-{s.rule}" for k, s in enumerate(specs, 1)]
        else:
            spec = _spec(spark, a.what, a.words[0], a.words[1:], a.driver, a.by_content)
            errors, names = batch.run_rule(spec), [spec.rule]
        errors = errors.persist()
        print(batch.summary_text(errors, names))
        if a.out and not batch.is_valid(errors):
            writers.write_features(errors, a.out, epsg=a.epsg)
        errors.unpersist()

    _, seconds = batch.timed(work)
    if a.elapsed:
        print(f"{seconds:.2f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
