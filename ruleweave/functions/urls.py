"""URL column functions, by the generic URI syntax rather than a strict parser."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ruleweave import vocab
from ruleweave.functions.text import col, let

URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URI, group)


def _parts(url: Column) -> Column:
    return F.struct(
        F.lower(_part(url, 1)).alias("scheme"),
        _part(url, 2).alias("authority"),
        _part(url, 3).alias("path"),
        _part(url, 4).alias("query"),
        url.rlike(r"^[^#]*\?").alias("has_query"),
    )


def host_of(url: Column | str) -> Column:
    authority = F.regexp_replace(_part(col(url), 2), r"^.*@", "")
    return F.lower(F.regexp_replace(authority, r":[^:\]]*$", ""))


def path_of(url: Column | str) -> Column:
    return _part(col(url), 3)


def _without_dots(path: Column) -> Column:
    segments = F.split(path, "/", -1)
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.array_append(acc, seg)),
    )
    joined = F.array_join(walked, "/")
    directory = F.element_at(segments, -1).isin(".", "..")
    tidy = F.when(directory & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), tidy).otherwise(path)


def _clean_query(query: Column) -> Column:
    def decode(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    def encode(part: Column) -> Column:
        return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def key(pair: Column) -> Column:
        return decode(F.substring_index(pair, "=", 1))

    def value(pair: Column) -> Column:
        return decode(F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1))

    tracking = "^(?i)(" + "|".join(vocab.TRACKING_KEYS) + ")$|^(?i)utm_"
    kept = F.filter(F.split(query, "&", -1), lambda pair: (pair != "") & ~key(pair).rlike(tracking))
    return F.array_join(F.transform(kept, lambda pair: F.concat(encode(key(pair)), F.lit("="), encode(value(pair)))), "&")


def canonical_url(value: Column | str, base: Column | str) -> Column:
    """Absolute https URL without fragment, credentials and tracking keys, else NULL."""
    link = F.btrim(col(value))

    def resolve(rel: Column, origin: Column) -> Column:
        folder = F.regexp_replace(F.when(origin["path"] == "", "/").otherwise(origin["path"]), r"[^/]*$", "")
        foreign = (rel["scheme"] != "") & (rel["scheme"] != origin["scheme"]) | (rel["authority"] != "")
        path = (
            F.when(foreign, rel["path"])
            .when(rel["path"] == "", origin["path"])
            .when(F.startswith(rel["path"], F.lit("/")), _without_dots(rel["path"]))
            .otherwise(_without_dots(F.concat(folder, rel["path"])))
        )
        own_query = foreign | (rel["path"] != "") | rel["has_query"]
        return F.struct(
            F.when(rel["scheme"] != "", rel["scheme"]).otherwise(origin["scheme"]).alias("scheme"),
            F.when(foreign, rel["authority"]).otherwise(origin["authority"]).alias("authority"),
            F.regexp_replace(path, r";[^/]*$", "").alias("path"),
            F.when(own_query, rel["query"]).otherwise(origin["query"]).alias("query"),
        )

    def render(url: Column) -> Column:
        port = F.regexp_extract(url["authority"], r":([^:\]]*)$", 1)
        valid = (
            (url["scheme"] == "https")
            & url["authority"].rlike(r"^[^@:]")
            & ~F.contains(url["authority"], F.lit("@"))
            & let(port, lambda p: (p == "") | (p.rlike("^[0-9]+$") & (p.try_cast("int") <= 65535)))
        )
        query = let(
            _clean_query(url["query"]), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")
        )
        path = F.when(url["path"] == "", "/").otherwise(url["path"])
        return F.when(valid, F.concat(F.lit("https://"), url["authority"], path, query))

    return let(
        _parts(link), lambda rel: let(_parts(col(base)), lambda origin: let(resolve(rel, origin), render))
    )


def allowed_host(url: Column | str, base_url: Column | str, hosts: Column) -> Column:
    """Host equals, or is a subdomain of, the base host or one of the approved hosts."""
    approved = F.array_append(F.transform(hosts, lambda item: F.lower(item)), host_of(base_url))
    return let(
        host_of(url),
        lambda host: (host != "")
        & F.exists(approved, lambda item: (host == item) | F.endswith(host, F.concat(F.lit("."), item))),
    )


def media_type(content_type: Column | str) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(col(content_type), F.lit("")), F.lit(";"), F.lit(1))))


def document_kind(url: Column | str, content_type: Column | str | None = None) -> Column:
    media = media_type(content_type) if content_type is not None else F.lit("")
    path = F.lower(path_of(url))
    return (
        F.when(media.isin(*vocab.HTML_TYPES), "html")
        .when((media == vocab.PDF_TYPE) | F.endswith(path, F.lit(".pdf")), "pdf")
        .when(
            media.isin(*vocab.SHEET_TYPES) | F.endswith(path, F.lit(".xlsx")) | F.endswith(path, F.lit(".xls")),
            "xlsx",
        )
        .otherwise("other")
    )


def linked_kind(url: Column | str) -> Column:
    """A link without a known suffix is a page until its response says otherwise."""
    kind = document_kind(url)
    return F.when(kind == "other", "html").otherwise(kind)


def file_suffix(content_type: Column | str, url: Column | str) -> Column:
    media = media_type(content_type)
    suffix = F.lower(F.regexp_extract(path_of(url), r"[^/](\.[^./]+)$", 1))
    return (
        F.when(media.isin(*vocab.HTML_TYPES), ".html")
        .when(media == vocab.PDF_TYPE, ".pdf")
        .when(media == vocab.SHEET_TYPES[0], ".xlsx")
        .when(media == vocab.SHEET_TYPES[1], ".xls")
        .when(suffix.isin(".html", ".htm", ".pdf", ".xlsx", ".xls"), suffix)
        .otherwise(".bin")
    )
