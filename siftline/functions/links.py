"""Addresses of links by the rules of RFC 3986, as column expressions (TXT-19, SRC-22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L = F.lit
#: The parts of a reference: 2 scheme, 3 with slashes and 4 authority, 5 path, 6 with its mark query.
PARTS = r"^(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what climbs above the root stays at the root."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    walked = F.aggregate(segments, L(""), lambda acc, s: F.when(s == ".", acc).when(s == "..", F.regexp_replace(acc, "/[^/]*$", "")).otherwise(F.concat(acc, L("/"), s)))
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(walked, L("/"))).otherwise(walked)


def resolved(href: Column, base: Column) -> Column:
    """Absolute address of a link on a page, without its fragment: scheme and host in lower case, an empty path as ``/``.

    Addresses of other kinds than http (mail, script) are null, as are links on pages whose
    own address has no scheme.
    """
    href, base = F.trim(href), F.trim(base)
    scheme, authority, path, query = (_part(href, n) for n in (2, 3, 5, 6))
    own_path = F.when(_part(base, 5) == "", "/").otherwise(_part(base, 5))
    merged = F.concat(F.regexp_replace(own_path, "[^/]*$", ""), path)
    relative = (scheme == "") & (authority == "")
    to_path = F.when(~relative, path).when(path == "", own_path).when(F.startswith(path, L("/")), path).otherwise(merged)
    to_query = F.when(relative & (path == "") & (query == ""), _part(base, 6)).otherwise(query)
    to_scheme = F.lower(F.when(scheme == "", _part(base, 2)).otherwise(scheme))
    to_authority = F.lower(F.when(relative, _part(base, 3)).otherwise(authority))
    return F.when(to_scheme.isin("http", "https") & (F.length(to_authority) > 2), F.concat(to_scheme, L(":"), to_authority, without_dots(to_path), to_query))
