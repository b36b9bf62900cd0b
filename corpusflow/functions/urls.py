"""Column expressions over URLs and links."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Links that are never followed.
SKIP_PREFIXES = ["mailto:", "javascript:", "#"]
SKIP_SUFFIXES = [".png", ".svg", ".jpg", ".jpeg", ".gif"]

_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
_PARTS = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]+)?"


def _part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, _PARTS, i)


def normalize_url(c: Column) -> Column:
    """Drop one trailing slash."""
    return F.regexp_replace(c, r"/\z", "")


def base_path(c: Column) -> Column:
    """The URL without a file name, query and fragment; the whole URL when it names no file."""
    path = _part(c, 3)
    # parameters behind ";" belong to the last segment, not to the path
    path = F.regexp_replace(path, r"(?s);[^/]*\z", "")
    last = F.substring_index(path, "/", -1)
    folder = F.regexp_replace(path, r"(?s)/?[^/]*\z", "")
    site = F.concat(F.lower(_part(c, 1)), F.lit("://"), _part(c, 2), folder)
    return F.when(last.contains("."), normalize_url(site)).otherwise(normalize_url(c))


def clean_url(c: Column) -> Column:
    """The URL without its fragment (an empty query goes as well)."""
    bare = F.regexp_replace(c, r"(?s)#.*\z", "")
    return F.when(bare.rlike(r"(?s)\A[^?]*\?\z"), F.regexp_replace(bare, r"\?\z", "")).otherwise(bare)


def _squash(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    joined = F.array_join(F.when(ends_in_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    rooted = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(path.rlike(r"(?:\A|/)\.\.?(?:/|\z)"), rooted).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """The absolute form of ``href`` found on page ``base``."""
    scheme, host, path, query = (_part(base, i) for i in (1, 2, 3, 4))
    root = F.concat(scheme, F.lit("://"), host)
    h_path, h_query = _part(href, 3), _part(href, 4)
    h_rest = F.regexp_extract(href, r"(?s)(#.+)\z", 1)
    folder = F.regexp_replace(path, r"(?s)[^/]*\z", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    merged = F.regexp_replace(F.concat(folder, h_path), r"/{2,}", "/")
    same_page = F.concat(root, path, F.when(h_query == "", query).otherwise(h_query), h_rest)
    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(h_path == "", same_page)
        .when(h_path.startswith("/"), F.concat(root, _squash(h_path), h_query, h_rest))
        .otherwise(F.concat(root, _squash(merged), h_query, h_rest))
    )


def quote_seed(c: Column) -> Column:
    """Percent-encode all characters but letters, digits, ``_.-~``, slash and colon."""
    out = F.url_encode(c)
    for found, put in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%3A", ":")]:
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def with_https(c: Column) -> Column:
    return F.when(c.startswith("https://"), c).otherwise(F.concat(F.lit("https://"), c))


def keep_link(href: Column) -> Column:
    """Whether a link leads to a page: no mail, script, in-page or picture link."""
    keep = F.lit(True)
    for prefix in SKIP_PREFIXES:
        keep = keep & ~href.startswith(prefix)
    for suffix in SKIP_SUFFIXES:
        keep = keep & ~href.endswith(suffix)
    return keep


def under_base(link: Column, base: Column) -> Column:
    """Plain prefix test: ``/docs2`` is under ``/docs``."""
    return link.startswith(base)
