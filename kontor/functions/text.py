"""What Spark has no expression for, as Arrow-batched functions over the standard library."""

from __future__ import annotations

import codecs
import contextlib
import html
import re
import unicodedata
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns)], dtype=object)


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return _each(html.unescape, s)


def html_unescape(text: Column) -> Column:
    """HTML entities as characters. Texts without an ampersand never enter Python's parser, but the batch does."""
    return _unescape(text)


@F.pandas_udf(StringType())
def nfkd_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without anything beyond ASCII."""
    return _each(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), s)


def _join(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def url_join(base: pd.Series, href: pd.Series) -> pd.Series:
    """A reference resolved against its page; null where it is no URL."""
    return _each(_join, base, href)


@F.pandas_udf(StringType())
def percent_decode(s: pd.Series) -> pd.Series:
    """Percent escapes as UTF-8, invalid bytes replaced; a plus sign stays."""
    return _each(unquote, s)


#: Where a page names its charset, and how far it is looked for. Fixed values.
_META = re.compile(rb"<meta[^>]+charset=[\"']?([a-zA-Z0-9_-]+)", re.IGNORECASE)
META_BYTES = 4096


def _codec(name: str | None) -> str | None:
    """The codec of a charset name; null where there is none."""
    try:
        return codecs.lookup(name).name if name else None
    except (LookupError, ValueError):
        return None


def _decoded(body: bytes, charset: str | None) -> str:
    """By the rule of the survey: a named charset decides, with replacements; without one, strict UTF-8 and then Windows-1252."""
    own = None if charset else _META.search(body[:META_BYTES])
    named = _codec(charset or (own and own[1].decode("ascii")))
    plan = [(named, "replace")] if named else [("utf-8", "strict"), ("cp1252", "replace")]
    for codec, errors in plan:
        with contextlib.suppress(UnicodeDecodeError):
            return codecs.decode(body, codec, errors)
    return ""


@F.pandas_udf(StringType())
def decode_body(body: pd.Series, charset: pd.Series) -> pd.Series:
    """A page's bytes as text: by the header's charset, the page's own, UTF-8, or Windows-1252."""
    return pd.Series([None if b is None else _decoded(bytes(b), c) for b, c in zip(body, charset)], dtype=object)


#: Escapes of scripts. Fixed value.
_ESCAPE = re.compile(r"\\u00([0-9a-fA-F]{2})|\\x([0-9a-fA-F]{2})")


@F.pandas_udf(StringType())
def script_unescape(s: pd.Series) -> pd.Series:
    r"""\u00XX and \xXX as characters."""
    return _each(lambda x: _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), x), s)


@F.pandas_udf(BooleanType())
def can_fetch(status: pd.Series, body: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    """Whether robots rules let an agent read a URL: no answer or an error allows all, 401 and 403 nothing."""
    from urllib.robotparser import RobotFileParser

    rules: dict[str, RobotFileParser] = {}  # of a batch: pages of one origin share their rules

    def read(text: str) -> RobotFileParser:
        if text not in rules:
            rules[text] = RobotFileParser()
            rules[text].parse(text.splitlines())
        return rules[text]

    def allowed(code, text, name, at) -> bool:
        if code is None or pd.isna(code):
            return True
        if code in (401, 403):
            return False
        return code >= 400 or text is None or read(text).can_fetch(name, at)

    return pd.Series([allowed(*row) for row in zip(status, body, agent, url)], dtype=bool)


def register(spark: SparkSession) -> None:
    """SQL names for the functions above."""
    for name, f in (("html_unescape", _unescape), ("nfkd_ascii", nfkd_ascii), ("url_join", url_join), ("percent_decode", percent_decode), ("decode_body", decode_body), ("script_unescape", script_unescape), ("can_fetch", can_fetch)):
        spark.udf.register(name, f)
