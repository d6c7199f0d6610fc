"""Names of businesses: their words, the domains they may have, their category, the tokens that prove them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions import let
from kontor.functions.text import nfkd_ascii
from kontor.policy import DEFAULT, ContactPolicy


def words(name: Column, policy: ContactPolicy = DEFAULT) -> Column:
    """The words of a name, plain letters and digits, without brackets and legal forms. Decomposition needs Python."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"\(.*?\)", " ")
    return words_of_ascii(nfkd_ascii(bare), policy)


def words_of_ascii(plain: Column, policy: ContactPolicy = DEFAULT) -> Column:
    """Like `words`, for names that are ASCII already. Spark's own expressions only."""
    plain = F.replace(F.lower(F.regexp_replace(plain, r"\(.*?\)", " ")), F.lit("&"), F.lit(" et "))
    return F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*policy.legal_forms))


def candidate_domains(name_words: Column, city_words: Column, tlds: tuple[str, ...] = ("fr", "com"), policy: ContactPolicy = DEFAULT) -> Column:
    """Domains that a business may have, from the words of its name and town; empty for generic names."""
    n = F.size(name_words)
    city = F.slice(city_words, 1, 3)
    core = F.filter(name_words, lambda w: ~w.isin(*policy.generic_words))

    def joined(ws: Column, when: Column | None = None) -> Column:
        both = F.array(F.array_join(ws, ""), F.array_join(ws, "-"))
        return both if when is None else F.when(when, both).otherwise(F.array().cast("array<string>"))

    tail = F.slice(name_words, F.greatest(n - F.size(city) + 1, F.lit(1)), F.greatest(F.size(city), F.lit(1)))
    with_city = (F.size(city) > 0) & ~(tail == city)
    short = (F.size(core) > 0) & (F.size(core) < n) & (F.length(F.array_join(core, "")) >= 5)
    main = joined(name_words)
    bases = F.concat(
        main,
        joined(F.concat(name_words, city), with_city),
        joined(core, short),
        joined(F.concat(core, F.array(F.lit("auto"))), short),
        joined(F.concat(F.array(F.lit("garage")), core), short & (F.get(name_words, F.lit(0)) != "garage")),
    )

    def fits(xs: Column) -> Column:
        return F.filter(F.array_sort(F.array_distinct(xs)), lambda b: F.length(b).between(4, 63))

    found = F.flatten(F.transform(fits(bases), lambda b: F.array(*(F.concat(b, F.lit("." + t)) for t in tlds))))
    found = F.concat(found, F.transform(fits(main), lambda b: F.concat(b, F.lit(".net"))))
    generic = (n == 0) | (n > 5) | (F.size(core) == 0)
    return F.when(generic, F.array().cast("array<string>")).otherwise(found)


def business_tokens(postal_code: Column, siren: Column) -> Column:
    """What proves a site: a postal code of five digits, a company number of nine."""
    code, number = F.trim(postal_code), F.trim(siren)
    return F.array_compact(F.array(F.when(code.rlike(r"^\d{5}\z"), code), F.when(number.rlike(r"^\d{9}\z"), number)))


def verify_tokens(text: Column, tokens: Column) -> Column:
    """Whether a text holds one of the tokens, not as a part of a longer number; company numbers may be spaced."""
    digits = F.regexp_replace(text, r"(?U)(?<=\d)[\s. -](?=\d)", "")
    alone = lambda t: F.concat(F.lit(r"(?U)(?<!\d)"), t, F.lit(r"(?!\d)"))
    found = let(F.array(text, digits), lambda both: F.exists(tokens, lambda t: F.rlike(F.get(both, F.when(F.length(t) == 9, 1).otherwise(0)), alone(t))))
    return F.coalesce(found, F.lit(False))


def refine_category(category: Column, name: Column, policy: ContactPolicy = DEFAULT) -> Column:
    """A general category made precise by the first pattern that the name fits."""
    fine = category
    for precise, pattern in reversed(policy.name_patterns()):
        fine = F.when(name.rlike("(?iUu)" + pattern), precise).otherwise(fine)
    return F.when(category.isin(*policy.refined_from) & (F.coalesce(name, F.lit("")) != ""), fine).otherwise(category)
