"""Workflows from the command line: python -m equireach.cli <workflow> --help."""

from __future__ import annotations

import argparse
import os

from equireach.operators import facilities
from equireach.operators.concentration import AnalysisSpec
from equireach.plans import workflows
from equireach.session import session
from equireach.sources import providers, sinks, yearly


def _years(text: str) -> list[int]:
    """2014-2024, or 2014,2018."""
    first, _, last = text.partition("-")
    return list(range(int(first), int(last) + 1)) if last else [int(y) for y in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="equireach", description=__doc__)
    sub = p.add_subparsers(dest="workflow", required=True)

    def add(workflow: str, /, **options: dict) -> None:
        s = sub.add_parser(workflow)
        for option, settings in options.items():
            s.add_argument(f"--{option.replace('_', '-')}", **settings)

    needed, years = {"required": True}, {"type": _years, "default": list(range(2014, 2025))}
    add("stats", input=needed, output=needed, years=years)
    add("ci", input=needed, output=needed, years=years, rank={"default": "GDP_per"}, name={"default": "gdp"}, rule={"default": "gt0"})
    add("panel", cities=needed, gdp=needed, flow=needed, density=needed, provincial=needed, city=needed, county=needed, output=needed, first={"type": int, "default": 2014}, last={"type": int, "default": 2024}, county_key={"default": "县级"})
    add("models", input=needed, output=needed)
    add("decompose", config=needed, root={"default": "."}, output=needed, method={"default": "banzhaf_rescaled"})
    add("geocode", input=needed, output=needed, url=needed, key_env={"default": "GEOCODER_KEY"}, address={"default": "addr"})
    add("convert", input=needed, output=needed, lng={"default": "lng_bd08"}, lat={"default": "lat_bd08"})
    add("clean-years", input=needed, output=needed)
    add("assign-years", input=needed, output=needed)
    add("merge-metadata", base=needed, supplemental=needed, output=needed)
    add("accessibility", boundaries=needed, grids=needed, hospitals=needed, output=needed, router={"default": None}, od={"default": None}, all_levels={"action": "store_true"}, scale={"type": float, "default": 10_000.0}, reach_km={"type": float, "default": None})
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = session()
    if a.workflow == "stats":
        workflows.accessibility_stats(spark, a.input, a.output, a.years)
    elif a.workflow == "ci":
        workflows.concentration_analysis(spark, a.input, a.output, a.years, AnalysisSpec(a.name, a.rank, valid_rank_rule=a.rule))
    elif a.workflow == "panel":
        workflows.city_panel(spark, a.cities, a.gdp, a.flow, a.density, a.provincial, a.city, a.county, a.output, a.first, a.last, a.county_key)
    elif a.workflow == "models":
        workflows.expansion_models(spark, a.input, a.output)
    elif a.workflow == "decompose":
        workflows.decompose(spark, a.config, a.root, a.output, a.method)
    elif a.workflow == "geocode":
        ask = providers.http_geocoder(a.url, os.environ[a.key_env])
        sinks.write_csv(providers.geocode(yearly.csv(spark, a.input, line_breaks=True), ask, a.address), a.output)
    elif a.workflow == "convert":
        sinks.write_csv(facilities.to_wgs84(yearly.csv(spark, a.input, line_breaks=True), a.lng, a.lat), a.output)
    elif a.workflow == "clean-years":
        whole, review, complete = facilities.clean_construction_years(yearly.csv(spark, a.input, line_breaks=True).cache())
        sinks.write_split({"all": whole, "review": review, "complete": complete}, a.output)
    elif a.workflow == "assign-years":
        sinks.write_by(facilities.assign_to_years(yearly.csv(spark, a.input, line_breaks=True)), a.output, ["year"])
    elif a.workflow == "merge-metadata":
        sinks.write_csv(facilities.merge_metadata(yearly.csv(spark, a.base, line_breaks=True), yearly.csv(spark, a.supplemental, line_breaks=True)), a.output)
    else:
        if a.od:
            times = providers.TableTimes(spark.read.parquet(a.od))
        else:
            times = providers.ServiceTimes(providers.http_router(a.router)) if a.router else providers.DistanceTimes()
        grids = dict(x.split("=", 1) for x in a.grids.split(","))  # region=file, comma between
        workflows.accessibility_dataset(spark, a.boundaries, grids, a.hospitals, times, a.output, not a.all_levels, a.scale, a.reach_km)


if __name__ == "__main__":
    main()
