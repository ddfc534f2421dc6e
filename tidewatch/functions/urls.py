"""Canonical addresses and locators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import let, trim_all

# Query parameters that only carry attribution.
TRACKING_PARAMS = (
    "fbclid gbraid gclid igshid mkt_tok msclkid ref ref_src referrer wbraid yclid _hsenc _hsmi"
).split()

# Prefixes of campaign parameters.
TRACKING_PREFIXES = ["utm_", "mc_", "mtm_", "pk_", "hsa_", "at_"]

_SPLIT = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


_UNSAFE_IN_PATH = r'[^!-~]|["<>`{}^]'


def _percent(path: Column) -> Column:
    """Percent-encode what a path may not hold, leaving all other characters alone."""

    def one(ch: Column) -> Column:
        encoded = F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
        return F.when(ch.rlike(_UNSAFE_IN_PATH), encoded).otherwise(ch)

    chars = F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0))
    return F.when(path.rlike(_UNSAFE_IN_PATH), F.array_join(F.transform(chars, one), "")).otherwise(path)


def _clean_path(path: Column) -> Column:
    single = F.regexp_replace(let(let(path, _percent), _resolve_dots), "/{2,}", "/")
    return F.regexp_replace(single, "/+$", "")


def _form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _resolve_dots(path: Column) -> Column:
    """Apply ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    start = F.filter(segments, lambda s: F.lit(False))
    folded = F.aggregate(
        segments,
        start,
        lambda acc, s: F.when(F.lower(s).isin(".", "%2e"), acc)
        .when(
            F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"),
            F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
        )
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.array_join(folded, "/")).otherwise(path)


def _kept_query(query: Column) -> Column:
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")

    def parse(pair: Column) -> Column:
        halves = F.split(pair, "=", 2)
        key, value = F.get(halves, 0), F.coalesce(F.get(halves, 1), F.lit(""))
        return let(F.struct(_form_decode(key).alias("k"), _form_decode(value).alias("v")), ordered)

    def ordered(p: Column) -> Column:
        # Parameters sort by key, then value, in the root collation.
        return F.struct(
            F.collate(p["k"], "UNICODE").alias("k_order"), F.collate(p["v"], "UNICODE").alias("v_order"),
            p["k"].alias("k"), p["v"].alias("v"),
        )

    def wanted(p: Column) -> Column:
        key = F.lower(p["k"])
        campaign = F.lit(False)
        for prefix in TRACKING_PREFIXES:
            campaign = campaign | key.startswith(prefix)
        return ~(key.isin(TRACKING_PARAMS) | campaign)

    def encode(p: Column) -> Column:
        return F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))

    kept = F.array_sort(F.filter(F.transform(pairs, parse), wanted))
    joined = F.array_join(F.transform(kept, encode), "&")
    return F.when(
        F.length(query) > 1, let(joined, lambda j: F.when(j != "", F.concat(F.lit("?"), j)).otherwise(F.lit("")))
    ).otherwise(F.lit(""))


def canonical_url(c: Column) -> Column:
    """One spelling per http(s) document; null when the input addresses none."""
    text = F.regexp_replace(trim_all(c), r"[\t\r\n]", "")

    def from_text(t: Column) -> Column:
        schemed = F.when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), t).otherwise(
            F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", ""))
        )
        return F.when(t != "", let(schemed, from_schemed))

    def from_schemed(u: Column) -> Column:
        authority = F.regexp_replace(F.regexp_extract(u, _SPLIT, 2), r"^.*@", "")
        parts = F.struct(
            F.lower(F.regexp_extract(u, _SPLIT, 1)).alias("scheme"),
            F.lower(F.regexp_replace(authority, r":[^:\]]*$", "")).alias("host"),
            F.regexp_replace(F.regexp_extract(authority, r":([^:\]]*)$", 1), "^0+(?=.)", "").alias("port"),
            _clean_path(F.regexp_replace(F.regexp_extract(u, _SPLIT, 3), r"\\", "/")).alias("path"),
            _kept_query(F.regexp_extract(u, _SPLIT, 4)).alias("query"),
        )
        return let(parts, from_parts)

    def from_parts(p: Column) -> Column:
        default = F.when(p["scheme"] == "http", F.lit("80")).otherwise(F.lit("443"))
        port = F.when((p["port"] == "") | (p["port"] == default), F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
        valid = (
            p["scheme"].isin("http", "https")
            & (p["host"] != "")
            & ~p["host"].rlike(r"[\x00-\x20#/<>?@\\^|%]")
            & p["port"].rlike("^[0-9]{0,5}$")
            & (F.coalesce(p["port"].try_cast("int"), F.lit(0)) <= 65535)
        )
        host = F.regexp_replace(p["host"], r"^www\.", "")
        return F.when(valid, F.concat(p["scheme"], F.lit("://"), host, port, p["path"], p["query"]))

    return let(text, from_text)


def url_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def repo_locator(c: Column) -> Column:
    """``owner/repo`` from a bare locator or a repository url; null when it is neither."""
    path = F.regexp_replace(trim_all(c), r"(?i)^https?://(www\.)?github\.com/", "")
    path = F.regexp_replace(F.regexp_replace(path, r"\.git$", ""), "/+$", "")
    parts = F.split(path, "/")
    owner, repo = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.when((owner != "") & (repo != ""), F.concat_ws("/", owner, repo))


def last_hop(c: Column) -> Column:
    """Client key from a forwarded-for header: the last non-empty hop."""
    hops = F.filter(F.transform(F.split(c, ","), trim_all), lambda h: h != "")
    return F.coalesce(F.try_element_at(hops, F.lit(-1)), F.lit("local"))
