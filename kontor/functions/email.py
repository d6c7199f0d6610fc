"""E-mail addresses: cleaning, finding them in pages however hidden, and what kind they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions import let
from kontor.functions import text as T
from kontor.functions.url import domain_in, registrable
from kontor.policy import DEFAULT, MAX_SCAN, ContactPolicy

# What hides an address, and what one looks like.
LOCAL_TAIL = r"(?iu)([a-z0-9._%+-]{1,64})\z"
DOMAIN_HEAD = r"(?iu)^ ?((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})(?![a-z0-9-])"
PROTECTED = (r"data-cfemail=[\"']([0-9a-fA-F]+)[\"']", r"/cdn-cgi/l/email-protection#([0-9a-fA-F]+)")
MAIL_LINK = r"(?iUu)mailto:([^\"'<>\s]+)"
CARD = r"(?iUu)data:text/(?:x-)?vcard[^,\"']*,[^\"'<>\s]+"
CARD_ADDRESS = r"(?iu)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,24}"
AT = r"(?:\s*[\[\(\{]\s*(?:at|arobase|@)\s*[\]\)\}]\s*|\s+arobase\s+)"
DOT = r"(?:\s*[\[\(\{]\s*(?:dot|point|\.)\s*[\]\)\}]\s*|\s+point\s+|\.)"
SPELT = rf"(?iUu)(?<![a-z0-9._%+-])([a-z0-9][a-z0-9._%+-]{{0,63}}){AT}([a-z0-9-]+(?:{DOT}[a-z0-9-]+)+)"
SPELT_DOT = r"(?iUu)\s*[\[\(\{]\s*(?:dot|point|\.)\s*[\]\)\}]\s*|\s+point\s+"
CONCATENATED = r"(?U)(['\"])\s*\+\s*\1"
ATTRIBUTES = r"(?iu)data-(?:user|name|mail-?user|local)=[\"']([a-z0-9._%+-]+)[\"'][^>]{0,200}?data-(?:domain|host|mail-?domain)=[\"']([a-z0-9.-]+\.[a-z]{2,24})[\"']"


def clean_email(raw: Column, policy: ContactPolicy = DEFAULT) -> Column:
    """The address in its normal form, or null where it is invalid or a placeholder."""
    e = F.regexp_replace(raw, r"(?U)^\s+|\s+\z", "")
    e = F.lower(F.regexp_replace(e, r"""^[.,;:'"<>()\[\]{}]+|[.,;:'"<>()\[\]{}]+\z""", ""))

    def of_address(e: Column) -> Column:
        parts = F.split(e, "@", -1)
        local = F.regexp_replace(F.get(parts, F.lit(0)), r"^[._%+-]+|[._%+-]+\z", "")
        domain = F.regexp_replace(F.get(parts, F.lit(1)), r"^[.-]+|[.-]+\z", "")
        return F.when((F.size(parts) == 2) & (F.length(e) <= 254), let(F.array(local, domain), of_parts))

    def of_parts(both: Column) -> Column:
        local, domain = F.get(both, F.lit(0)), F.get(both, F.lit(1))
        valid = (
            (F.length(local) <= 64)
            & local.rlike(r"^[a-z0-9._%+-]+\z")
            & domain.rlike(r"^[a-z0-9.-]*\.[a-z]{2,}\z")
            & ~local.contains("..")
            & ~domain.contains("..")
            & ~F.substring_index(domain, ".", -1).isin(*policy.bad_tlds)
            & ~domain.rlike(policy.placeholder_domain.replace("$", r"\z"))
            & ~domain_in(domain, policy.bad_domains)
            & ~local.isin(*policy.bad_locals)
            & ~local.rlike(policy.bad_local)
            & ~local.rlike(r"^[0-9a-f]{20,}\z")
        )
        return F.when(valid, F.concat(local, F.lit("@"), domain))

    return let(F.regexp_replace(e, r"^mailto:", ""), of_address)


def protected_decode(hexadecimal: Column) -> Column:
    """Text whose bytes are combined by XOR with the first one; empty where the digits are not pairs."""
    byte = lambda at: F.conv(F.substring(hexadecimal, at, F.lit(2)), 16, 10).cast("int")
    key = byte(F.lit(1))
    pairs = F.floor(F.length(hexadecimal) / 2).cast("int")
    letters = F.transform(F.sequence(F.lit(2), pairs), lambda i: F.char(byte(2 * i - 1).bitwiseXOR(key)))
    return F.when((pairs >= 2) & hexadecimal.rlike(r"^[0-9a-fA-F]+\z"), F.array_join(letters, "")).otherwise("")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _pairs(text: Column, pattern: str, domain=lambda d: d) -> Column:
    return F.zip_with(_all(text, pattern, 1), _all(text, pattern, 2), lambda a, b: F.concat(a, F.lit("@"), domain(b)))


def at_signs(text: Column) -> Column:
    """A candidate for each at-sign: what stands right before and right after it, one space aside."""

    def around(parts: Column) -> Column:
        def one(i: Column) -> Column:
            left = F.right(F.regexp_replace(F.right(F.get(parts, i), F.lit(65)), r" \z", ""), F.lit(64))
            local, domain = F.regexp_extract(left, LOCAL_TAIL, 1), F.regexp_extract(F.get(parts, i + 1), DOMAIN_HEAD, 1)
            return F.when((local != "") & (domain != ""), F.concat(local, F.lit("@"), domain))

        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), one)).otherwise(_none())

    return let(F.split(text, "@", -1), around)


def _none() -> Column:
    return F.array().cast("array<string>")


def _cleaned(candidates: Column, policy: ContactPolicy) -> Column:
    return F.array_distinct(F.array_compact(F.transform(candidates, lambda c: clean_email(c, policy))))


def plain_emails(text: Column, policy: ContactPolicy = DEFAULT) -> Column:
    """Addresses that stand in a text as such or spelt out. Spark's own expressions only."""
    spelt = F.when(text.rlike(r"(?iUu)[\[\(\{]\s*(?:at|arobase|@)\s*[\]\)\}]|\barobase\b"), _pairs(text, SPELT, lambda d: F.regexp_replace(d, SPELT_DOT, "."))).otherwise(_none())
    return _cleaned(F.concat(at_signs(text), spelt), policy)


def with_emails(rows: DataFrame, html: str = "html", to: str = "emails", policy: ContactPolicy = DEFAULT) -> DataFrame:
    """`rows` with the distinct addresses of a page, in every form that pages hide them in.

    Functions of Python see only the texts that need them; the others are null there.
    """
    kept = [F.col(c) for c in rows.columns if c != to]
    rows = rows.select(*kept, F.left(html, F.lit(MAX_SCAN)).alias("_scanned"))
    scripts = T.script_unescape(F.when(F.col("_scanned").rlike(r"\\u00|\\x"), F.col("_scanned")))
    rows = rows.withColumn("_plain", F.coalesce(scripts, "_scanned"))
    rows = rows.withColumn("_shown", F.coalesce(T.html_unescape(F.when(F.col("_plain").contains("&"), F.col("_plain"))), "_plain"))
    shown = F.when(F.col("_shown").contains("+"), F.regexp_replace("_shown", CONCATENATED, "")).otherwise(F.col("_shown"))
    rows = rows.withColumn("_shown", shown)
    text = F.col("_shown")
    cards = F.transform(_all(text, CARD, 0), lambda c: F.struct(F.lower(c).contains(";base64").alias("coded"), F.regexp_extract(c, r"^[^,]*,(.*)\z", 1).alias("body")))
    body = lambda coded: F.transform(F.filter("_cards", lambda c: c["coded"] == coded), lambda c: c["body"])
    # A separator that no address holds keeps the targets of links apart while they are decoded.
    rows = rows.withColumn("_cards", cards).withColumn("_links", F.array_join(F.filter(_all(text, MAIL_LINK), lambda x: x != ""), "\n"))
    rows = rows.withColumn("_open", F.array_join(body(False), "\n"))
    for c in ("_links", "_open"):
        rows = rows.withColumn(c, F.coalesce(T.percent_decode(F.when(F.col(c).contains("%"), F.col(c))), c))
    mailed = F.flatten(F.transform(F.split("_links", "\n"), lambda t: F.split(F.substring_index(t, "?", 1), ",")))
    closed = F.transform(body(True), lambda b: F.decode(F.try_to_binary(_padded(b), F.lit("base64")), "ISO-8859-1"))
    carded = _all(F.concat_ws("\n", "_open", F.array_join(closed, "\n")), CARD_ADDRESS, 0)
    protected = F.transform(F.concat(*(_all(F.col("_scanned"), p) for p in PROTECTED)), protected_decode)
    found = F.array_distinct(F.concat(_cleaned(F.concat(protected, _pairs(text, ATTRIBUTES), carded, mailed), policy), plain_emails(text, policy)))
    return rows.withColumn(to, F.coalesce(found, _none())).select(*kept, to)


def _padded(code: Column) -> Column:
    return F.concat(code, F.repeat(F.lit("="), F.pmod(-F.length(code), F.lit(4)).cast("int")))


def domain_of(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def email_kind(email: Column, site_domains: Column, policy: ContactPolicy = DEFAULT) -> Column:
    """gratuit (a free provider), domaine_site (the site's own domain) or pro."""
    domain = domain_of(email)
    own = F.coalesce(F.array_contains(site_domains, registrable(domain, policy)), F.lit(False))
    return F.when(domain.isin(*policy.free_domains), "gratuit").when(own, "domaine_site").otherwise("pro")


def is_role(email: Column, policy: ContactPolicy = DEFAULT) -> Column:
    """Whether an address names a function, not a person."""
    return F.substring_index(F.substring_index(email, "@", 1), "+", 1).isin(*policy.role_locals)


def kind_rank(kind: Column) -> Column:
    from kontor.policy import KIND_RANK

    rank = F.lit(9)
    for name, r in KIND_RANK.items():
        rank = F.when(kind == name, r).otherwise(rank)
    return rank
