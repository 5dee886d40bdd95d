"""URL columns: parts, site key, fragment removal, reference resolution, page test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The generic URI pattern of RFC 3986, appendix B. parse_url raises on spaces and drops the port.
_URI = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Endings of paths that are not HTML pages.
NON_HTML_EXTENSIONS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg",
    ".zip", ".rar", ".exe", ".dmg", ".apk", ".tar.gz", ".7z",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".mkv",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt",
    ".rtf", ".csv", ".ico", ".css", ".js", ".json", ".xml",
]

# Fixed value: the address that shows one video inside another page.
EMBED_PREFIX = "https://www.youtube.com/embed/"


def _col(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URI, 1))


def netloc(url: Column) -> Column:
    """Host with port and user as written; empty when the URL has none."""
    return F.regexp_extract(url, _URI, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URI, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _URI, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _URI, 5)


def url_parts(url: Column) -> Column:
    return F.struct(
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        path(url).alias("path"),
        query(url).alias("query"),
        fragment(url).alias("fragment"),
    )


def site_key(url: Column) -> Column:
    """The name under which a site's runs are kept: its host without any ``www.``."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def defragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def same_site(a: Column | str, b: Column | str) -> Column:
    """Equal hosts, port and ``www.`` included."""
    return netloc(_col(a)) == netloc(_col(b))


def is_html_page(url: Column) -> Column:
    """False for paths that end like an image, archive, document, script or style file."""
    endings = "|".join(e.replace(".", r"\.") for e in NON_HTML_EXTENSIONS)
    plain = F.regexp_replace(F.lower(path(url)), r"(?s);[^/]*$", "")
    return ~plain.rlike(rf"(?:{endings})\z")


def _normal_path(path: Column) -> Column:
    """Fold ``.`` and ``..`` out of a path."""

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    # a path that ends in a dot segment is a folder
    closed = F.when(path.rlike(r"/\.{1,2}\z"), F.concat(path, F.lit("/"))).otherwise(path)
    folded = F.aggregate(F.split(closed, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.regexp_replace(F.array_join(folded, "/"), "^/", ""))


def resolve_url(base: Column | str, href: Column) -> Column:
    """The absolute URL of ``href`` found under ``base``.

    ``base`` is either the root of the site (a string) or the URL column of the page that
    holds the link; the two give different results for links without a leading slash.
    """
    base = _col(base)
    written = F.regexp_replace(F.regexp_replace(href, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")

    def folder(base_path: Column) -> Column:
        # without the name after the last slash
        return F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(base_path, "^/", "")), r"[^/]*$", "")

    def resolved(ref: Column) -> Column:
        def joined(ref_path: Column) -> Column:
            # doubled slashes go only where a folder and a relative path are joined
            relative = F.regexp_replace(F.concat(folder(path(base)), ref_path), r"(?<=.)/{2,}", "/")
            return F.when(ref_path.startswith("/"), ref_path).otherwise(relative)

        def normal(p: Column) -> Column:
            return F.when(p.rlike(r"/\.{1,2}(?:/|\z)"), _normal_path(p)).otherwise(p)

        after = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)  # query and fragment
        origin = F.concat(scheme(base), F.lit("://"), netloc(base))
        return (
            F.when(ref == "", base)
            .when(scheme(ref) != "", ref)
            .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
            .when(ref.startswith("?"), F.concat(origin, path(base), ref))
            .when(ref.startswith("#"), F.concat(defragment(base), ref))
            .otherwise(F.concat(origin, let(let(path(ref), joined), normal), after))
        )

    return let(written, resolved)


def video_id(link: Column) -> Column:
    return F.element_at(F.split(link, "v="), -1)


def video_embed(link: Column) -> Column:
    return F.concat(F.lit(EMBED_PREFIX), video_id(link))
