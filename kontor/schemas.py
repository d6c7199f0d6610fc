"""The engine's tables and the payloads of its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def _schema(text: str) -> StructType:
    return _parse_datatype_string(" ".join(text.split()))


#: What every source delivers. ingest_seq orders rows within a source: the first row of a key wins.
BUSINESS_DDL = """source string, source_id string, name string, alt_name string, category string, address string, postal_code string,
  city string, country string, phone string, website string, siren string, naf string, lat double, lon double, emails array<string>, ingest_seq bigint"""
TABLES = {
    "businesses": "id bigint, source string, source_id string, name string, alt_name string, category string, address string, postal_code string, city string, country string, phone string, website string, site_key string, siren string, naf string, lat double, lon double, ingest_seq bigint",
    "sites": "site_key string, url string, guessed boolean, status string, final_url string, pages bigint, ingest_seq bigint",
    "guesses": "business_id bigint, site_key string, tokens array<string>, verified boolean",
    "emails": "email string, domain string, site_key string, business_id bigint, kind string, is_role boolean, source_url string, ingest_seq bigint",
    "site_phones": "site_key string, phone string",
    "dns_checked": "domain string, ok boolean, ingest_seq bigint",
    "mx": "domain string, ok boolean, ingest_seq bigint",
}
PAYLOADS = {
    "map": "type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>",
    "register": """siren string, nom_complet string, nom_raison_sociale string, activite_principale string,
      siege struct<siret: string, etat_administratif: string, liste_enseignes: array<string>, nom_commercial: string, adresse: string, code_postal: string, libelle_commune: string, activite_principale: string, latitude: string, longitude: string>,
      matching_etablissements array<struct<siret: string, etat_administratif: string, liste_enseignes: array<string>, nom_commercial: string, adresse: string, code_postal: string, libelle_commune: string, activite_principale: string, latitude: string, longitude: string>>""",
    "places": """id string, displayName struct<text: string>, formattedAddress string, addressComponents array<struct<longText: string, types: array<string>>>,
      websiteUri string, nationalPhoneNumber string, businessStatus string, location struct<latitude: double, longitude: double>""",
    "hits": "url string, title string",
    "pages": "url string, status int, content_type string, body binary, charset string",
    "robots": "origin string, status int, body string",
    "dns": "domain string, ok boolean",
    "mx_answers": "domain string, rcode string, hosts array<string>, has_address boolean",
}


def table(name: str) -> StructType:
    """The schema of one of the engine's tables, or of a payload."""
    return _schema(TABLES.get(name) or PAYLOADS[name])


def businesses_like(df: DataFrame) -> DataFrame:
    """`df` with exactly the columns that sources deliver; missing ones are null."""
    fields = _schema(BUSINESS_DDL).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
