"""URL handling as column expressions that return null on junk and never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outings.functions.text import blank_to_null, let

# scheme, authority, path, ;params, ?query, #fragment
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*?)(;[^/?#]*)?(\?[^#]*)?(#.*)?$"


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _PARTS, index)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def query_of(url: Column) -> Column:
    return F.substr(_part(url, 5), F.lit(2))


def without_query(url: Column) -> Column:
    """The URL less its parameters, query and fragment."""
    return F.concat(
        F.when(_part(url, 1) != "", F.concat(F.lower(_part(url, 1)), F.lit(":"))).otherwise(""),
        _part(url, 2), path_of(url),
    )


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    segments = F.split(F.substr(path, F.lit(2)), "/")
    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_in_dots = F.element_at(segments, -1).isin(".", "..") & (F.size(folded) > 0)
    return F.concat(F.lit("/"), F.array_join(folded, "/"), F.when(ends_in_dots, "/").otherwise(""))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen from ``base``."""

    def absolute(h: Column) -> Column:
        scheme, host, path = _part(base, 1), _part(base, 2), path_of(base)
        root = F.concat(scheme, F.lit(":"), host)
        folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")

        def joined(p: Column) -> Column:
            tail = F.concat(_part(h, 4), _part(h, 5), _part(h, 6))
            full = F.when(p.startswith("/"), p).otherwise(F.concat(folder, p))
            return F.concat(root, F.when(full.rlike(r"(^|/)\.\.?(/|$)"), _fold_dots(full)).otherwise(full), tail)

        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h == "", base)
            .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
            .when(h.startswith("?"), F.concat(root, path, h))
            .otherwise(joined(path_of(h)))
        )

    return let(F.regexp_replace(F.trim(href), r"[\t\r\n]", ""), absolute)


def with_query_param(url: Column, name: str, value: Column) -> Column:
    """Drop every ``name`` parameter, keep the others in order (blank and repeated ones too), add it last."""
    kept = F.filter(F.split(query_of(url), "&"),
                    lambda p: (p != "") & (F.substring_index(p, "=", 1) != name))
    kept = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    pairs = F.concat(kept, F.array(F.concat(F.lit(name + "="), value)))
    return F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("?"), F.array_join(pairs, "&"),
                    _part(url, 6))


def section_by_path(url: Column) -> Column:
    """Collector rule: the path starts with the section."""
    p = path_of(url)
    return F.when(p.startswith("/theatre/"), "theatre").when(p.startswith("/cinema/"), "cinema")


def section_by_contains(url: Column) -> Column:
    """Import rule: the URL holds the section anywhere, cinema first."""
    return F.when(url.contains("/cinema/"), "cinema").when(url.contains("/theatre/"), "theatre")


def detail_url(href: Column, section: Column, base_url: str, detail_paths: dict[str, str]) -> Column:
    """Clean absolute detail URL of the section, null when the link is something else."""

    def checked(u: Column) -> Column:
        is_detail = F.lit(False)
        for name, pattern in detail_paths.items():
            is_detail = is_detail | ((section == name) & path_of(u).rlike(pattern))
        return F.when(is_detail, without_query(u))

    return let(resolve(F.lit(base_url), blank_to_null(href)), checked)
