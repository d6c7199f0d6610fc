"""Companies of the public register, one business for each active establishment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.names import refine_category
from kontor.functions.url import blank_null
from kontor.policy import DEFAULT, ContactPolicy, departments
from kontor.schemas import businesses_like

PER_PAGE, MAX_PAGES = 25, 400


def businesses(results: DataFrame, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """From results with the category and naf that were asked for, as columns. Companies that may not be disclosed go."""
    legal = F.coalesce(blank_null(F.col("nom_complet")), blank_null(F.col("nom_raison_sociale")), F.lit(""))
    active = F.filter(F.coalesce("matching_etablissements", F.array()), lambda e: F.coalesce(e["etat_administratif"], F.lit("A")) == "A")
    rows = results.withColumn("legal", legal).where((F.col("legal") != "") & ~F.upper("legal").contains("NON-DIFFUSIBLE"))
    rows = rows.withColumn("places", active).withColumn("places", F.when(F.size("places") > 0, F.col("places")).otherwise(F.array("siege")))
    rows = rows.select("*", F.posexplode("places").alias("pos", "e"))
    sign = F.coalesce(blank_null(F.get("e.liste_enseignes", F.lit(0))), blank_null(F.col("e.nom_commercial")))
    name = F.coalesce(sign, "legal")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return businesses_like(
        rows.select(
            F.lit("sirene").alias("source"),
            F.coalesce(blank_null(F.col("e.siret")), "siren").alias("source_id"),
            name.alias("name"),
            F.when(sign.isNotNull(), F.col("legal")).otherwise("").alias("alt_name"),
            refine_category(F.col("category"), name, policy).alias("category"),
            text("e.adresse").alias("address"),
            text("e.code_postal").alias("postal_code"),
            text("e.libelle_commune").alias("city"),
            F.lit("FR").alias("country"),
            F.lit("").alias("phone"),
            F.lit("").alias("website"),
            text("siren").alias("siren"),
            F.coalesce(blank_null(F.col("e.activite_principale")), blank_null(F.col("activite_principale")), "naf").alias("naf"),
            F.expr("try_cast(e.latitude AS DOUBLE)").alias("lat"),
            F.expr("try_cast(e.longitude AS DOUBLE)").alias("lon"),
            F.col("pos").cast("long").alias("ingest_seq"),
        )
    )


def requests(spark: SparkSession, categories: list[str] | None = None, chosen: list[str] | None = None, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """(naf, department, category): each activity code and department once, for the first category that has the code."""
    codes: dict[str, str] = {}
    for name in categories or policy.categories:
        for naf in policy.categories[name][1]:
            codes.setdefault(naf, name)
    asked = spark.createDataFrame(list(codes.items()), "naf string, category string")
    where = spark.createDataFrame([(d,) for d in chosen or departments()], "department string")
    return asked.crossJoin(F.broadcast(where)).select("naf", "department", "category")


def pages_of(total_pages: int | None) -> range:
    """The pages to ask for after the first."""
    return range(2, min(total_pages or 1, MAX_PAGES) + 1)
