"""Commands: scenario, roof-parameters, roof-slopes and green-roof-query."""

from __future__ import annotations

import argparse
import dataclasses
import sys


def parser() -> argparse.ArgumentParser:
    """Options of all commands; those of `scenario` are the fields of its settings."""
    from .plans.scenario import Scenario

    out = argparse.ArgumentParser(prog="rastrel")
    commands = out.add_subparsers(dest="command", required=True)
    scenario = commands.add_parser("scenario", help="model what greener roofs change")
    for f in dataclasses.fields(Scenario):
        if f.name == "metrics":
            continue
        name, kind = "--" + f.name, str(f.type).split(" |")[0]
        if kind == "bool":
            scenario.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            needed = f.default is dataclasses.MISSING
            scenario.add_argument(name, type={"int": int, "float": float}.get(kind, str), required=needed, default=None if needed else f.default)
    params = commands.add_parser("roof-parameters", help="mean indices of green roofs")
    for name in ("--l2-folder", "--green-roofs", "--out", "--summary-csv"):
        params.add_argument(name, required=True)
    params.add_argument("--id-field", default="gml_id")
    for name, default in (("--all-touched", True), ("--mask-with-lst", True), ("--keep-lst-water", False), ("--drop-missing", False), ("--lonlat", True)):
        params.add_argument(name, action=argparse.BooleanOptionalAction, default=default)
    slopes = commands.add_parser("roof-slopes", help="slopes of CityGML roofs joined to buildings")
    for name in ("--buildings", "--citygml-dir", "--out"):
        slopes.add_argument(name, required=True)
    slopes.add_argument("--id-field", default="gml_id")
    slopes.add_argument("--gml-pattern", default="*.gml")
    slopes.add_argument("--low-slope-threshold-deg", type=float, default=15.0)
    slopes.add_argument("--replace-existing-fields", action="store_true")
    slopes.add_argument("--overwrite-output", action="store_true")
    ask = commands.add_parser("green-roof-query", help="print the Overpass text that asks for green roofs")
    where = ask.add_mutually_exclusive_group(required=True)
    where.add_argument("--osm-relation-id", type=int)
    where.add_argument("--bbox", help="south,west,north,east")
    ask.add_argument("--include-building-parts", action="store_true")
    ask.add_argument("--timeout", type=int, default=180)
    return out


def main(argv: list[str] | None = None) -> None:
    """Runs one command in the session that is active, or in a new one."""
    args = parser().parse_args(argv)
    if args.command == "green-roof-query":
        from .sources.osm import green_roof_query

        bbox = tuple(map(float, args.bbox.split(","))) if args.bbox else None
        print(green_roof_query(relation=args.osm_relation_id, bbox=bbox, parts=args.include_building_parts, timeout=args.timeout))
        return
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import scenario
    from .sources import citygml, files

    spark = SparkSession.builder.appName("rastrel").getOrCreate()
    if args.command == "scenario":
        config = scenario.Scenario(**{f.name: getattr(args, f.name) for f in dataclasses.fields(scenario.Scenario) if f.name != "metrics"})
        scenario.run(spark, config)
    elif args.command == "roof-parameters":
        roofs, summary = scenario.roof_parameters(
            spark, args.l2_folder, args.green_roofs, lonlat=args.lonlat, id_field=args.id_field, all_touched=args.all_touched,
            mask_with_lst=args.mask_with_lst, keep_water=args.keep_lst_water, drop_missing=args.drop_missing,
        )
        files.write_geojson_lines(roofs, args.out, mode="overwrite")
        summary.coalesce(1).write.mode("overwrite").csv(args.summary_csv, header=True)
    else:
        layer = scenario.features(spark, args.buildings)
        layer = layer.select(F.col("properties").getItem(args.id_field).alias(args.id_field), "properties", "polygons")
        stats = citygml.slope_stats(citygml.read_roof_planes(spark, args.citygml_dir, args.gml_pattern), layer, args.id_field, args.low_slope_threshold_deg)
        rows = citygml.enrich(layer, stats, args.id_field, args.replace_existing_fields)
        files.write_geojson_lines(rows, args.out, mode="overwrite" if args.overwrite_output else "errorifexists")


if __name__ == "__main__":
    main(sys.argv[1:])
