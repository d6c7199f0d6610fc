"""Elements of an open map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.names import refine_category
from kontor.functions.url import blank_null
from kontor.policy import DEFAULT, ContactPolicy, departments
from kontor.schemas import businesses_like


def selectors(categories: list[str] | None = None, policy: ContactPolicy = DEFAULT) -> list[tuple[str, str, str]]:
    """(key, value, category) in order; of categories that share a tag, the first has it."""
    found: dict[tuple[str, str], str] = {}
    for name in categories or policy.categories:
        for tag in policy.categories[name][2]:
            found.setdefault(tuple(tag), name)
    return [(*tag, name) for tag, name in found.items()]


def _tag(*names: str) -> Column:
    return F.coalesce(*(blank_null(F.try_element_at(F.col("tags"), F.lit(n))) for n in names), F.lit(""))


def businesses(elements: DataFrame, categories: list[str] | None = None, country: str = "FR", policy: ContactPolicy = DEFAULT) -> DataFrame:
    """Elements with a wanted tag, and a name, a site or an address."""
    category = F.coalesce(*(F.when(F.try_element_at(F.col("tags"), F.lit(k)) == v, F.lit(c)) for k, v, c in selectors(categories, policy)), F.lit(None).cast("string"))
    siret = F.regexp_replace(_tag("ref:FR:SIRET"), r"\D", "")
    center = {c: F.coalesce(F.col(c), F.col(f"center.{c}")) for c in ("lat", "lon")}
    emails = F.filter(F.split(_tag("email", "contact:email"), r"(?U)[;,\s]+"), lambda e: e.contains("@"))
    rows = elements.withColumns({"found": category, "name": _tag("name", "brand", "operator"), "website": _tag("website", "contact:website", "url"), "emails": emails})
    rows = rows.where(F.col("found").isNotNull() & ((F.col("name") != "") | (F.col("website") != "") | (F.size("emails") > 0)))
    return businesses_like(
        rows.select(
            F.lit("osm").alias("source"),
            F.concat_ws("/", "type", F.col("id").cast("string")).alias("source_id"),
            "name",
            refine_category(F.col("found"), F.col("name"), policy).alias("category"),
            F.concat_ws(" ", blank_null(_tag("addr:housenumber")), blank_null(_tag("addr:street"))).alias("address"),
            _tag("addr:postcode").alias("postal_code"),
            _tag("addr:city").alias("city"),
            F.lit(country).alias("country"),
            _tag("phone", "contact:phone").alias("phone"),
            "website",
            "emails",
            F.when(F.length(siret) >= 9, F.left(siret, F.lit(9))).otherwise("").alias("siren"),
            F.lit("").alias("naf"),
            *(c.alias(n) for n, c in center.items()),
            F.col("id").alias("ingest_seq"),
        )
    )


def area(country: str = "", department: str = "", custom: str = "") -> str:
    """The statement that names the area a request is for."""
    if custom:
        return custom.strip().rstrip(";").removesuffix("->.a") + "->.a;"
    if department:
        return f'area["boundary"="administrative"]["admin_level"="6"]["ref:INSEE"="{department}"]->.a;'
    return f'area["ISO3166-1"="{country.upper()}"]["admin_level"="2"]->.a;'


def request(where: str, tags: list[tuple[str, str]], timeout: int = 900) -> str:
    """The request for all elements with one of the tags in an area: selection and projection are the server's work."""
    lines = [f"[out:json][timeout:{timeout}];", where, "(", *(f'  nwr["{k}"="{v}"](area.a);' for k, v in tags), ");", "out center tags;"]
    return "\n".join(lines)


def requests(spark: SparkSession, categories: list[str] | None = None, country: str = "FR", chosen: list[str] | None = None, custom: str = "", policy: ContactPolicy = DEFAULT) -> DataFrame:
    """(label, request): one for a custom area, for each department, or for each category of another country."""
    tags = [(k, v) for k, v, _ in selectors(categories, policy)]
    if custom:
        jobs = [(custom, request(area(custom=custom), tags))]
    elif chosen or country.upper() == "FR":
        jobs = [(d, request(area(department=d), tags)) for d in chosen or departments()]
    else:
        jobs = [(c, request(area(country), policy.categories[c][2])) for c in categories or policy.categories if policy.categories[c][2]]
    return spark.createDataFrame(jobs if tags else [], "label string, request string")
