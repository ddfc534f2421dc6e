"""Landed payloads (feeds, releases, advisories) to item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import html_to_text, parse_date, trim_all, truncate
from tidewatch.functions.urls import repo_locator
from tidewatch.schemas import CVE_PAYLOAD, RELEASE_PAYLOAD

ITEM_COLUMNS = ["source_id", "position", "external_id", "url", "title", "author", "content", "published_at"]

_TEXT = "struct<_VALUE: string, _type: string>"
_LINK = "struct<_VALUE: string, _rel: string, _href: string>"
_RSS_ITEM = f"""struct<
  title: array<string>, link: array<{_LINK}>, guid: array<{_TEXT}>, id: array<string>,
  `content:encoded`: array<string>, content: array<{_TEXT}>, description: array<string>,
  summary: array<{_TEXT}>, pubDate: array<string>, published: array<string>, `dc:date`: array<string>,
  updated: array<string>, `dc:creator`: array<string>,
  author: array<struct<_VALUE: string, name: string>>>"""

_ENTRY = r"(?is)<(item|entry)(?:\s[^>]*)?>.*?</\1\s*>"


def _body(text: Column, max_chars: int | None) -> Column:
    """The whole text, or its start where the caller asks for a cut."""
    return text if max_chars is None else truncate(text, max_chars)


def _present(c: Column) -> Column:
    text = trim_all(c)
    return F.when(text != "", text)


def feed_items(payloads: DataFrame, max_chars: int | None = None) -> DataFrame:
    """RSS 2.0, RDF and Atom entries in one shape. Each entry is cut from the document and parsed
    on its own, so one broken entry costs one row. ``payloads``: source_id, payload. Bodies stay whole
    unless ``max_chars`` is given."""
    entries = payloads.select(
        "source_id", F.posexplode(F.regexp_extract_all("payload", F.lit(_ENTRY), F.lit(0))).alias("position", "xml")
    )
    # Atom bodies may be inline markup; keep them as text for the flattener.
    wrapped = F.regexp_replace(
        "xml", r'(?is)(<content[^>]*type="xhtml"[^>]*>)(.*?)(</content>)', "$1<![CDATA[$2]]>$3"
    )
    e = entries.select(
        "source_id",
        "position",
        F.from_xml(wrapped, _RSS_ITEM, {"mode": "PERMISSIVE", "attributePrefix": "_"}).alias("e"),
    )

    def first(name: str, field: str | None = None) -> Column:
        head = F.get(F.col("e").getField(name), 0)
        return head.getField(field) if field else head

    links = F.filter(
        F.col("e.link"),
        lambda x: (F.coalesce(trim_all(x["_VALUE"]), F.lit("")) != "")
        | (x["_href"].isNotNull() & (x["_rel"].isNull() | (x["_rel"] == "alternate"))),
    )
    link = F.get(links, 0)
    guid = F.coalesce(_present(first("guid", "_VALUE")), _present(first("id")))
    address = F.coalesce(
        _present(link["_VALUE"]), link["_href"], F.when(guid.startswith("http"), guid)
    )
    body = F.coalesce(
        first("content:encoded"), first("content", "_VALUE"), first("description"), first("summary", "_VALUE")
    )
    author = F.coalesce(
        _present(first("dc:creator")), _present(first("author", "name")), _present(first("author", "_VALUE"))
    )
    dated = F.coalesce(first("pubDate"), first("published"), first("dc:date"), first("updated"))
    return (
        e.select(
            "source_id",
            "position",
            guid.alias("external_id"),
            address.alias("url"),
            _present(first("title")).alias("title"),
            author.alias("author"),
            _body(html_to_text(F.coalesce(body, F.lit(""))), max_chars).alias("content"),
            parse_date(dated).alias("published_at"),
        )
        .withColumn(
            "reject_reason",
            F.when(F.col("title").isNull() | F.col("url").isNull(), "entry without a usable title or link"),
        )
        .withColumn("title", html_to_text(F.col("title")))
    )


def release_items(payloads: DataFrame, include_prereleases: Column | None = None, max_chars: int | None = None) -> DataFrame:
    """Release lists of a repository. ``payloads``: source_id, locator, payload."""
    prereleases = F.lit(False) if include_prereleases is None else include_prereleases
    rows = payloads.select(
        "source_id",
        repo_locator(F.col("locator")).alias("repo"),
        prereleases.alias("pre"),
        F.posexplode_outer(F.from_json("payload", RELEASE_PAYLOAD)).alias("position", "r"),
    )
    shaped = rows.filter(
        F.col("r.id").isNotNull() & F.col("r.html_url").isNotNull() & F.col("r.tag_name").isNotNull()
    ).filter(~F.coalesce("r.draft", F.lit(False)) & (~F.coalesce("r.prerelease", F.lit(False)) | F.col("pre")))
    name = F.coalesce(_present(F.col("r.name")), F.col("r.tag_name"))
    body = F.coalesce(
        _present(F.col("r.body")), F.concat(F.lit("Release "), F.col("r.tag_name"), F.lit(" published."))
    )
    return shaped.select(
        "source_id",
        "position",
        F.concat(F.lit("github:"), "repo", F.lit(":"), F.col("r.id").cast("string")).alias("external_id"),
        F.col("r.html_url").alias("url"),
        F.concat_ws(" ", "repo", name).alias("title"),
        F.col("r.author.login").alias("author"),
        _body(body, max_chars).alias("content"),
        parse_date(F.coalesce("r.published_at", "r.created_at")).alias("published_at"),
    )


def advisory_items(payloads: DataFrame, min_score: Column | None = None, max_chars: int | None = None) -> DataFrame:
    """Vulnerability pages. ``payloads``: source_id, payload. Unscored entries always stay."""
    floor = F.lit(None).cast("double") if min_score is None else min_score
    rows = payloads.select(
        "source_id",
        floor.alias("floor"),
        F.posexplode(F.from_json("payload", CVE_PAYLOAD)["vulnerabilities"]["cve"]).alias("position", "c"),
    ).filter(F.col("c.id").isNotNull())
    metric = F.coalesce(F.get("c.metrics.cvssMetricV31", 0), F.get("c.metrics.cvssMetricV30", 0))
    english = F.get(F.filter("c.descriptions", lambda d: d["lang"] == "en"), 0)
    description = F.coalesce(
        trim_all(F.coalesce(english, F.get("c.descriptions", 0))["value"]), F.lit("")
    )
    score, severity = metric["cvssData"]["baseScore"], metric["cvssData"]["baseSeverity"]
    heading = F.when(score.isNotNull(), F.format_string("%s %.1f", severity, score)).otherwise("unscored")
    links = F.transform(
        F.slice(F.col("c.references"), 1, 5), lambda r: F.concat(F.lit("- "), r["url"])
    )
    linked = F.when(F.size(links) > 0, F.concat(F.lit("References:\n"), F.array_join(links, "\n")))
    content = F.concat_ws(
        "\n\n", F.when(description != "", description), F.concat(F.lit("CVSS: "), heading), linked
    )
    return rows.filter(score.isNull() | F.col("floor").isNull() | (score >= F.col("floor"))).select(
        "source_id",
        "position",
        F.col("c.id").alias("external_id"),
        F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "c.id").alias("url"),
        F.concat(F.col("c.id"), F.lit(" ("), heading, F.lit(")")).alias("title"),
        F.lit(None).cast("string").alias("author"),
        _body(content, max_chars).alias("content"),
        parse_date(F.coalesce("c.published", "c.lastModified")).alias("published_at"),
    )


def check_config(sources: DataFrame) -> DataFrame:
    """Validate each source's JSON config by kind. Adds the settings with defaults applied and
    ``config_error``; a bad config fails that source only."""
    raw = F.coalesce("config", F.lit("{}"))
    v = F.try_parse_json(raw)

    def kind_of(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def number(path: str) -> Column:
        return F.try_variant_get(v, path, "double")

    numeric = "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"
    pre, lookback, floor = kind_of("$.includePrereleases"), kind_of("$.lookbackDays"), kind_of("$.minCvssScore")
    days, score = number("$.lookbackDays"), number("$.minCvssScore")
    bad_days = lookback.isNotNull() & ~F.coalesce(
        lookback.rlike(numeric) & days.between(1, 120) & (days == F.floor(days)), F.lit(False)
    )
    bad_score = floor.isNotNull() & ~F.coalesce(floor.rlike(numeric) & score.between(0, 10), F.lit(False))
    shape = F.schema_of_variant(v)
    error = (
        F.when(v.isNull(), "malformed config JSON")
        .when(~shape.rlike("^(OBJECT|VOID)"), "config: expected an object")
        .when((F.col("kind") == "github") & pre.isNotNull() & (pre != "BOOLEAN"), "includePrereleases: expected a boolean")
        .when((F.col("kind") == "nvd") & bad_days, "lookbackDays: expected an integer from 1 to 120")
        .when((F.col("kind") == "nvd") & bad_score, "minCvssScore: expected a number from 0 to 10")
    )
    return sources.withColumns(
        {
            "config_error": error,
            "include_prereleases": F.coalesce(F.try_variant_get(v, "$.includePrereleases", "boolean"), F.lit(False)),
            "lookback_days": F.coalesce(days, F.lit(30)).cast("int"),
            "min_cvss_score": score,
        }
    )


def incremental(items: DataFrame, cursors: DataFrame, key: str = "source_id", limit: int | None = None,
                tie: str = "position") -> DataFrame:
    """Rows newer than the source's cursor (strictly) or undated, newest first. ``cursors``: key, since
    (null = no bound). With a ``limit`` a source hands over its *oldest* dated rows first, so that the
    cursor can follow them (see :func:`advance_cursor`) and nothing is passed over."""
    fresh = items.join(cursors.select(key, "since"), key, "left").filter(
        F.col("since").isNull() | F.col("published_at").isNull() | (F.col("published_at") > F.col("since"))
    )
    newest = F.desc(F.coalesce(F.unix_micros("published_at"), F.lit(0)))
    if limit is not None:
        # Rows of one instant go together: the cursor cannot stop between them.
        nth = F.rank().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("published_at")))
        fresh = fresh.withColumn("_nth", nth).filter(F.col("_nth") <= limit).drop("_nth")
    w = Window.partitionBy(key).orderBy(newest, F.col(tie))
    return fresh.withColumn("batch_rank", F.row_number().over(w)).drop("since")


def rewind(sources: DataFrame, hours: int = 24) -> DataFrame:
    """The lower bound of the next run: the stored cursor minus the overlap."""
    return sources.withColumn("since", F.col("last_fetched_at") - F.expr(f"interval {hours} hours"))


def advance_cursor(sources: DataFrame, report: DataFrame, started_at: Column, taken: DataFrame | None = None) -> DataFrame:
    """Move the cursor to the start of the run, for sources that succeeded. ``taken``: what a limited
    :func:`incremental` handed over; a source that is in it only moves to the newest of its rows."""
    ok = report.filter("status = 'ok'").select("source_id", F.lit(True).alias("_ok"))
    moved = sources.join(ok, "source_id", "left")
    to = started_at
    if taken is not None:
        moved = moved.join(taken.groupBy("source_id").agg(F.max("published_at").alias("_seen"), F.lit(True).alias("_some")), "source_id", "left")
        to = F.when(F.col("_some"), F.least(F.coalesce("_seen", "last_fetched_at"), started_at)).otherwise(started_at)
    return moved.withColumn("last_fetched_at", F.when(F.col("_ok"), to).otherwise(F.col("last_fetched_at"))).select(*sources.columns)


def select_sources(sources: DataFrame, kind: str | None = None, match: str | None = None) -> DataFrame:
    out = sources
    if kind:
        out = out.filter(F.col("kind") == kind)
    if match:
        out = out.filter(F.lower(F.concat_ws(" ", "name", "url")).contains(match.lower()))
    return out
