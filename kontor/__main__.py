"""python -m kontor: the stages over a directory in a folder, from recorded inputs."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from kontor import schemas
from kontor.plans import collect as C
from kontor.plans.directory import Directory, in_departments, may_guess, parse_categories, parse_cities, parse_departments, resolve_sources
from kontor.plans.export import write_csv
from kontor.sources import files, maps, places, register, search


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kontor", description=__doc__)
    top.add_argument("--db", default="directory", help="folder of the directory's tables")
    sub = top.add_subparsers(dest="command", required=True)
    named = {}
    for name in ("collect", "guess", "crawl", "verify", "export", "stats", "categories", "requests", "run"):
        named[name] = sub.add_parser(name)
    for p in (named["collect"], named["run"]):
        p.add_argument("--sources", default="auto", help="osm, sirene, gmaps, search, file, or auto: the open ones and those that there is a file for")
        p.add_argument("--osm", help="JSON lines of map elements")
        p.add_argument("--sirene", help="JSON lines of register results, with category and naf")
        p.add_argument("--gmaps", help="JSON lines of places, with category")
        p.add_argument("--search", help="JSON lines of hits: url, title, category, city, ingest_seq")
        p.add_argument("--file", help="list of sites: .csv, or a line each")
        p.add_argument("--file-category", default="autre")
    for p in (named["collect"], named["requests"], named["run"]):
        p.add_argument("--categories", help="names separated by commas, or all")
        p.add_argument("--country", default="FR")
        p.add_argument("--depts", help="codes of departments separated by commas; all by default")
        p.add_argument("--osm-area", help="an area in the map service's own language instead of the country")
        p.add_argument("--cities", help="towns to ask places and search for, separated by commas, or all")
        p.add_argument("--keywords", help="what to ask for instead of the categories' keywords")
    named["requests"].add_argument("--to", default="requests", help="folder of what to ask each source: register, map, places")
    named["run"].add_argument("--no-guess", action="store_true")
    named["run"].add_argument("--no-verify", action="store_true")
    for p in (named["guess"], named["run"]):
        p.add_argument("--dns", help="Parquet of answers: domain, ok")
    named["guess"].add_argument("--limit", type=int)
    for p in (named["crawl"], named["run"]):
        p.add_argument("--pages", help="Parquet of pages: url, status, content_type, html or body and charset")
        p.add_argument("--robots", help="Parquet of robots rules: origin, status, body")
        p.add_argument("--user-agent", default="kontor")
        p.add_argument("--max-pages", type=int, default=10)
        p.add_argument("--deep-pages", type=int, default=60)
        p.add_argument("--deep", action="store_true", help="read every site as a whole")
        p.add_argument("--limit", type=int, help="read so many sites only")
        p.add_argument("--no-partners", action="store_true")
        p.add_argument("--retry-failed", action="store_true")
        p.add_argument("--recrawl-no-email", action="store_true")
    for p in (named["verify"], named["run"]):
        p.add_argument("--mx", help="Parquet of answers: domain, rcode, hosts, has_address")
        p.add_argument("--recheck", action="store_true")
    for p in (named["export"], named["run"]):
        p.add_argument("-o", "--output", default="leads.csv")
        p.add_argument("--pro-only", action="store_true")
        p.add_argument("--mx-only", action="store_true")
        p.add_argument("--role-only", action="store_true")
        p.add_argument("--no-dedupe", action="store_true")
        p.add_argument("--sep", default=";")
        p.add_argument("--telephones", action="store_true", help="one row for each business with a telephone instead, also without address")
        p.add_argument("--opt-out", help="text file of addresses and domains that no export holds")
    named["export"].add_argument("--categories", dest="export_categories", help="names separated by commas, or all")
    return top


def _payload(spark: SparkSession, path: str, name: str, *more: str) -> DataFrame:
    schema = schemas.table(name)
    for column in more:
        schema = schema.add(column, "long" if column == "ingest_seq" else "string")
    return spark.read.schema(schema).json(path)


def _categories(text: str | None) -> list[str] | None:
    return None if text == "all" else parse_categories(text)


def chosen(args: argparse.Namespace) -> set[str]:
    return resolve_sources(args.sources, args.country, bool(args.search), bool(args.gmaps), bool(args.file))


def sources(spark: SparkSession, args: argparse.Namespace) -> list[DataFrame]:
    wanted, use = _categories(args.categories), chosen(args)
    found = []
    if args.osm and "osm" in use:
        found.append(maps.businesses(_payload(spark, args.osm, "map"), wanted, args.country))
    if args.sirene and "sirene" in use:
        rows = register.businesses(_payload(spark, args.sirene, "register", "category", "naf"))
        found.append(in_departments(rows, parse_departments(args.depts)))
    if args.gmaps and "gmaps" in use:
        found.append(places.businesses(_payload(spark, args.gmaps, "places", "category"), args.country))
    if args.search and "search" in use:
        found.append(search.businesses(_payload(spark, args.search, "hits", "category", "city", "ingest_seq"), args.country))
    if args.file and "file" in use:
        found.append(files.businesses(files.read_sites(spark, args.file), args.file_category))
    return found


def export(spark: SparkSession, d: Directory, args: argparse.Namespace) -> None:
    out = spark.read.text(args.opt_out) if args.opt_out else None
    categories = _categories(getattr(args, "export_categories", None))
    if args.telephones:
        rows = d.phones(out, categories=categories)
    else:
        rows = d.leads(out, pro_only=args.pro_only, mx_only=args.mx_only, role_only=args.role_only, dedupe=not args.no_dedupe, categories=categories)
    print(f"{write_csv(rows, args.output, args.sep)} rows: {args.output}", file=sys.stderr)


def requests(spark: SparkSession, args: argparse.Namespace) -> None:
    wanted, departments = _categories(args.categories), parse_departments(args.depts)
    words = [x.strip() for x in (args.keywords or "").split(",") if x.strip()] or None
    asked = {"register": register.requests(spark, wanted, departments), "places": places.requests(spark, parse_cities(args.cities), wanted, words)}
    asked["map"] = maps.requests(spark, wanted, args.country, departments, args.osm_area or "")
    for name, rows in asked.items():
        rows.write.mode("overwrite").json(f"{args.to}/{name}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kontor").getOrCreate()
    d = Directory(spark, args.db)
    does = [args.command] if args.command != "run" else ["collect", *(["guess"] if args.dns and not args.no_guess and may_guess(chosen(args)) else []), *(["crawl"] if args.pages else []), *(["verify"] if args.mx and not args.no_verify else []), "export", "stats"]
    for step in does:
        if step == "collect":
            print(f"{d.collect(*sources(spark, args))} new businesses", file=sys.stderr)
        elif step == "guess":
            print(f"{d.guess(spark.read.parquet(args.dns), args.limit if args.command == 'guess' else None)} new sites", file=sys.stderr)
        elif step == "crawl":
            robots = spark.read.parquet(args.robots) if args.robots else None
            n = d.crawl(
                spark.read.parquet(args.pages), robots, args.user_agent, most_rounds=1 if args.no_partners else 3, retry_failed=args.retry_failed,
                again_without_email=args.recrawl_no_email, limit=args.limit, deep=args.deep, max_pages=args.max_pages, deep_pages=args.deep_pages,
            )
            print(f"{n} new addresses", file=sys.stderr)
        elif step == "verify":
            d.verify(spark.read.parquet(args.mx), args.recheck)
        elif step == "export":
            export(spark, d, args)
        elif step == "requests":
            requests(spark, args)
        elif step == "stats":
            d.stats().orderBy("metric", "key").show(200, truncate=False)
        else:
            C.categories(spark).show(50, truncate=False)


if __name__ == "__main__":
    main()
