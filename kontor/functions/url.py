"""Hosts, domains, site keys and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions import let
from kontor.policy import DEFAULT, ContactPolicy

IPV4 = r"^\d{1,3}(\.\d{1,3}){3}\z"


def blank_null(c: Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(c, F.lit(""))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def host_of(url: Column) -> Column:
    """Host of a URL, lower case, without user, port and final dots; empty where there is none."""
    name = F.regexp_replace(F.regexp_replace(authority_of(F.coalesce(url, F.lit(""))), r"^.*@", ""), r":[^:\]]*\z", "")
    return F.regexp_replace(F.lower(name), r"\.+\z", "")


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def registrable(host: Column, policy: ContactPolicy = DEFAULT) -> Column:
    """The domain that can be registered, by rule of thumb: two labels, three under a reserved second level."""

    def of_labels(labels: Column) -> Column:
        n = F.size(labels)
        three = (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*policy.second_level)
        return F.array_join(F.slice(labels, F.greatest(n - F.when(three, 2).otherwise(1), F.lit(1)), F.lit(3)), ".")

    def of_name(name: Column) -> Column:
        return F.when(name.rlike(IPV4), name).otherwise(let(F.split(name, r"\."), lambda labels: F.when(F.size(labels) <= 2, name).otherwise(of_labels(labels))))

    return let(without_www(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^\.+|\.+\z", "")), of_name)


def suffixes(host: Column) -> Column:
    """The host and all its parents."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def domain_in(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.arrays_overlap(suffixes(host), F.array(*map(F.lit, domains))) if domains else F.lit(False)


def site_from_url(raw: Column, policy: ContactPolicy = DEFAULT) -> Column:
    """struct<site_key, url> of a site's raw address; both null where it is unusable or blocked."""

    def of_full(full: Column) -> Column:
        path, scheme = path_of(full), scheme_of(full)
        segments = F.filter(F.split(path, "/"), lambda s: s != "")

        def of_host(host: Column) -> Column:
            shared = host.isin(*policy.shared_hosts)
            usable = scheme.isin("http", "https") & host.contains(".") & F.when(shared, F.size(segments) > 0).otherwise(~domain_in(host, policy.blocked_sites))
            key = F.when(shared, F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, 2), "/"))).otherwise(without_www(host))
            url = F.concat(scheme, F.lit("://"), authority_of(full), F.when(path == "", "/").otherwise(path))
            return F.struct(F.when(usable, key).alias("site_key"), F.when(usable, url).alias("url"))

        return let(host_of(full), of_host)

    first = F.nullif(F.get(F.split(F.regexp_replace(raw, r"(?U)^\s+|\s+\z", ""), r"(?U)[\s;,|]+"), F.lit(0)), F.lit(""))
    return let(F.when(first.contains("://"), first).otherwise(F.concat(F.lit("https://"), F.regexp_replace(first, "^/+", ""))), of_full)


def page_identity(url: Column) -> Column:
    """What makes two URLs one page: host without www., path without final slashes, query."""
    return F.concat(without_www(F.regexp_replace(host_of(url), r"\.+\z", "")), F.regexp_replace(path_of(url), r"/+\z", ""), F.lit("?"), query_of(url))


def home_candidates(url: Column) -> Column:
    """Addresses to try for a site's home page, in order."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    scheme, name = scheme_of(full), authority_of(full)
    other = F.when(scheme == "https", "http").otherwise("https")
    path = F.when(path_of(full) == "", "/").otherwise(path_of(full))
    path = F.concat(path, F.when(query_of(full) != "", F.concat(F.lit("?"), query_of(full))).otherwise(""))
    www = ~F.startswith(name, F.lit("www.")) & ~name.rlike(r"^[\d.:]+\z")
    return F.array_compact(
        F.array(
            F.concat(scheme, F.lit("://"), name, path),
            F.when(www, F.concat(scheme, F.lit("://www."), name, path)),
            F.concat(other, F.lit("://"), name, path),
            F.when(path != "/", F.concat(scheme, F.lit("://"), name, F.lit("/"))),
        )
    )
