"""Validation of externally produced annotations. A model's raw reply is an input column; it is
used only when it passes, otherwise the deterministic column stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import pinned
from tidewatch.functions.text import citations, quote_is_grounded, strip_code_fence
from tidewatch.operators.sinks import count_attempts
from tidewatch.schemas import (
    CATEGORIES,
    CELL_LEVELS,
    CHANGE_KINDS,
    DIMENSIONS,
    MAX_ENRICH_ATTEMPTS,
    MIN_QUOTE_CHARS,
)
from tidewatch.session import settle

_NUMERIC = "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


class Reply:
    """Strictly typed access to one JSON reply column: ``3.0`` is an integer, ``"3"`` is not."""

    def __init__(self, df: DataFrame, raw: str):
        # Parsed once into a column; every rule below reads that column.
        self.df = pinned(df, {"_reply": F.try_parse_json(strip_code_fence(F.col(raw)))})
        self.json = F.col("_reply")
        self.shape = F.schema_of_variant(self.json)
        self.problems: list[Column] = []

    def kind(self, name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.json, f"$.{name}", "variant"))

    def value(self, name: str, kind: str = "string") -> Column:
        return F.try_variant_get(self.json, f"$.{name}", kind)

    def _require(self, ok: Column, message: str) -> None:
        self.problems.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)))

    def one_of(self, name: str, allowed: list[str]) -> None:
        ok = (self.kind(name) == "STRING") & self.value(name).isin(allowed)
        self._require(ok, f"{name}: not an allowed value")

    def text(self, name: str, optional: bool = False, nullable: bool = False) -> None:
        kind = self.kind(name)
        ok = (kind == "STRING") & (F.length(self.value(name)) > 0)
        if optional or nullable:
            ok = ok | kind.isNull()
        if nullable:
            ok = ok | (kind == "VOID")
        self._require(ok, f"{name}: expected a non-empty string")

    def integer(self, name: str, low: int, high: int) -> None:
        number = self.value(name, "double")
        ok = self.kind(name).rlike(_NUMERIC) & (number == F.floor(number)) & number.between(low, high)
        self._require(ok, f"{name}: expected an integer from {low} to {high}")

    def members(self, name: str) -> Column:
        return F.coalesce(self.value(name, "array<variant>"), F.array().cast("array<variant>"))

    def text_list(self, name: str) -> None:
        texts = F.forall(
            self.members(name),
            lambda m: (F.schema_of_variant(m) == "STRING") & (F.length(F.try_variant_get(m, "$", "string")) > 0),
        )
        kind = self.kind(name)
        self._require(kind.isNull() | (kind.startswith("ARRAY") & texts), f"{name}: expected non-empty strings")

    def integer_list(self, name: str) -> None:
        def whole(m: Column) -> Column:
            number = F.try_variant_get(m, "$", "double")
            return F.schema_of_variant(m).rlike(_NUMERIC) & (number == F.floor(number))

        kind = self.kind(name)
        self._require(
            kind.isNull() | (kind.startswith("ARRAY") & F.forall(self.members(name), whole)),
            f"{name}: expected integers",
        )

    def texts(self, name: str) -> Column:
        return F.transform(self.members(name), lambda m: F.try_variant_get(m, "$", "string"))

    def integers(self, name: str) -> Column:
        return F.transform(self.members(name), lambda m: F.try_variant_get(m, "$", "double").cast("bigint"))

    def reason(self) -> Column:
        found = F.filter(F.array(*self.problems), lambda p: p.isNotNull())
        return (
            F.when(self.json.isNull(), F.lit("invalid JSON"))
            .when(~self.shape.startswith("OBJECT"), F.lit("schema mismatch — expected an object"))
            .when(F.size(found) > 0, F.concat(F.lit("schema mismatch — "), F.array_join(found, "; ")))
        )


def validate_enrichment(df: DataFrame, raw: str = "completion") -> DataFrame:
    """Column-shaped enrichment with ``status`` ok/quarantined. Invalid rows carry the lowest
    impact, no text and the reason; they are never shown."""
    r = Reply(df, raw)
    r.one_of("category", CATEGORIES)
    r.text_list("vendors")
    r.text_list("products")
    r.integer("impact_score", 1, 5)
    r.text("summary")
    r.text("why_it_matters")
    r.text("rationale", optional=True)
    out = pinned(r.df, {"quarantine_reason": r.reason()})
    ok = F.col("quarantine_reason").isNull()
    empty = F.array().cast("array<string>")
    return out.withColumns(
        {
            "status": F.when(ok, "ok").otherwise("quarantined"),
            "category": F.when(ok, r.value("category")).otherwise("Ecosystem"),
            "vendors": F.when(ok, r.texts("vendors")).otherwise(empty),
            "products": F.when(ok, r.texts("products")).otherwise(empty),
            "impact_score": F.when(ok, r.value("impact_score", "double").cast("int")).otherwise(1),
            "summary": F.when(ok, r.value("summary")).otherwise(""),
            "why_it_matters": F.when(ok, r.value("why_it_matters")).otherwise(""),
            "rationale": F.when(ok, r.value("rationale")),
        }
    ).drop("_reply")


def pending(raw: DataFrame, derived: DataFrame, retry_quarantined: bool = True, max_attempts: int | None = MAX_ENRICH_ATTEMPTS) -> DataFrame:
    """Items without a derived row, with a stale one (whole seconds) or a quarantined one that
    has attempts left (``max_attempts`` None: however often it was tried). raw: raw_item_id, fetched_at; derived: raw_item_id, created_at, status,
    attempts (several rows per item, such as chunks, are folded first)."""
    second = lambda c: F.floor(F.unix_millis(c) / 1000)
    folded = derived.groupBy("raw_item_id").agg(
        F.max("created_at").alias("_created"),
        F.max_by("status", "created_at").alias("_status"),
        F.max("attempts").alias("_attempts"),
    )
    stale = second(F.col("_created")) < second(F.col("fetched_at"))
    why = F.when(F.col("_created").isNull(), "missing").when(stale, "stale")
    if retry_quarantined:
        retry = F.col("_status") == "quarantined"
        if max_attempts is not None:
            retry = retry & (F.col("_attempts") < max_attempts)
        why = F.coalesce(why, F.when(retry, "retry"))
    return (
        raw.join(folded, "raw_item_id", "left")
        .withColumn("pending_reason", why)
        .filter("pending_reason is not null")
        .drop("_created", "_status", "_attempts")
    )


def work_list(items: DataFrame, at: str = "published_at", newest_first: bool = True, limit: int | None = None, key: str = "raw_item_id") -> DataFrame:
    """Items in the order a run takes them, undated ones last when newest come first and first
    otherwise. With a ``limit``, that many and their ``position``."""
    order = [F.desc_nulls_last(at) if newest_first else F.asc_nulls_first(at), F.asc(key)]
    ordered = items.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def with_positions(items: DataFrame, at: str = "published_at", newest_first: bool = True, key: str = "raw_item_id", order: list[Column] | None = None) -> DataFrame:
    """All items with their ``position`` in the order of ``work_list``, or another one. Ranges of the order are numbered side by side."""
    order = order or [F.desc_nulls_last(at) if newest_first else F.asc_nulls_first(at), F.asc(key)]
    dealt = settle(items.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    position = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").withColumn("position", position).drop("_range", "_before")


def by_ids(items: DataFrame, ids: DataFrame, key: str = "raw_item_id") -> DataFrame:
    """Exactly the given items."""
    return items.join(ids.select(key), key, "left_semi")


def save_enrichment(stored: DataFrame, validated: DataFrame) -> DataFrame:
    return count_attempts(stored, validated, "raw_item_id")


def run_report(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def validate_change(df: DataFrame, raw: str, shown: str, trigger: str) -> DataFrame:
    """Change verdicts may cite only ids that were shown, and any kind but ``new`` needs another
    item's id. Adds ``verdict`` (null when rejected) and ``reject_reason``."""
    r = Reply(df, raw)
    r.one_of("kind", CHANGE_KINDS)
    r.one_of("dimension", DIMENSIONS)
    r.text("before", nullable=True)
    r.text("after")
    r.integer("materiality", 1, 5)
    r.text("rationale")
    r.integer_list("evidence_item_ids")
    evidence = r.integers("evidence_item_ids")
    unknown = F.array_except(evidence, F.col(shown))
    prior = F.filter(evidence, lambda x: x != F.col(trigger))
    reason = F.coalesce(
        r.reason(),
        F.when(F.size(unknown) > 0, "evidence was not shown"),
        F.when((r.value("kind") != "new") & (F.size(prior) == 0), "claims a prior state without a prior item"),
    )
    verdict = F.struct(
        r.value("kind").alias("kind"),
        r.value("dimension").alias("dimension"),
        r.value("before").alias("before"),
        r.value("after").alias("after"),
        r.value("materiality", "double").cast("int").alias("materiality"),
        r.value("rationale").alias("rationale"),
        evidence.alias("evidence_item_ids"),
    )
    return (
        pinned(r.df, {"reject_reason": reason})
        .withColumn("verdict", F.when(F.col("reject_reason").isNull(), verdict))
        .drop("_reply")
    )


def validate_conflict(df: DataFrame, raw: str, a: str, b: str) -> DataFrame:
    """``contradict`` needs a verbatim span of each statement. ``judged`` is null when unusable."""
    r = Reply(df, raw)
    r.one_of("verdict", ["contradict", "consistent"])
    for side in ("evidenceA", "evidenceB"):
        kind = r.kind(side)
        r._require(kind.isNull() | (kind == "STRING"), f"{side}: expected a string")
    spans = [quote_is_grounded(r.value(e), F.col(s), 3) for e, s in (("evidenceA", a), ("evidenceB", b))]
    grounded = spans[0] & spans[1]
    usable = r.reason().isNull() & ((r.value("verdict") == "consistent") | grounded)
    return r.df.withColumn("judged", F.when(usable, r.value("verdict") == "contradict")).drop("_reply")


_CLAIM = "struct<text: string, sourceId: bigint, quote: string>"
DRAFT = f"""struct<summary: string, claims: array<{_CLAIM}>,
  conflicts: array<struct<topic: string, sides: array<{_CLAIM}>, note: string>>>"""


def _claim_ok(m: Column) -> Column:
    def text(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(m, f"$.{name}", "variant"))
        return (kind == "STRING") & (F.length(F.try_variant_get(m, f"$.{name}", "string")) > 0)

    number = F.try_variant_get(m, "$.sourceId", "double")
    numeric = F.schema_of_variant(F.try_variant_get(m, "$.sourceId", "variant")).rlike(_NUMERIC)
    return F.coalesce(text("text") & text("quote") & numeric & (number == F.floor(number)), F.lit(False))


def validate_brief_draft(df: DataFrame, raw: str = "draft_json") -> DataFrame:
    """Shape check of a drafted brief (two or more sides per conflict); adds ``draft``."""
    r = Reply(df, raw)
    r.text("summary")
    for name in ("claims", "conflicts"):
        kind = r.kind(name)
        r._require(kind.isNull() | kind.startswith("ARRAY"), f"{name}: expected a list")
    r._require(F.forall(r.members("claims"), _claim_ok), "claims: malformed claim")

    def conflict_ok(m: Column) -> Column:
        sides = F.try_variant_get(m, "$.sides", "array<variant>")
        texts = [
            F.coalesce(F.length(F.try_variant_get(m, f"$.{n}", "string")) > 0, F.lit(False))
            for n in ("topic", "note")
        ]
        return texts[0] & texts[1] & F.coalesce((F.size(sides) >= 2) & F.forall(sides, _claim_ok), F.lit(False))

    r._require(F.forall(r.members("conflicts"), conflict_ok), "conflicts: malformed conflict")
    parsed = F.from_json(strip_code_fence(F.col(raw)), DRAFT)
    return (
        pinned(r.df, {"reject_reason": r.reason()})
        .withColumn("draft", F.when(F.col("reject_reason").isNull(), parsed))
        .drop("_reply")
    )


def audit_draft(drafts: DataFrame, sources: DataFrame, key: str = "brief_id") -> DataFrame:
    """Grounding audit of drafted briefs. drafts: key, draft; sources: key, id, title, content.

    A draft stands when every citation names a source of its brief, every claim quotes its source
    verbatim, and every conflict has two or more sides from distinct, grounded sources.
    """
    claims = drafts.select(key, F.explode("draft.claims").alias("c")).select(
        key, F.lit(-1).alias("conflict_no"), "c.*"
    )
    sides = (
        drafts.select(key, F.posexplode("draft.conflicts").alias("conflict_no", "f"))
        .select(key, "conflict_no", F.explode("f.sides").alias("c"))
        .select(key, "conflict_no", "c.*")
    )
    body = sources.select(key, F.col("id").alias("sourceId"), F.concat_ws("\n", "title", "content").alias("_src"))
    checked = (
        claims.unionByName(sides)
        .join(body, [key, "sourceId"], "left")
        .withColumn("_ok", F.coalesce(quote_is_grounded(F.col("quote"), F.col("_src"), MIN_QUOTE_CHARS), F.lit(False)))
    )
    per_conflict = checked.groupBy(key, "conflict_no").agg(
        F.bool_and("_ok").alias("_ok"), F.countDistinct("sourceId").alias("_sources")
    )
    quotes = per_conflict.groupBy(key).agg(
        F.bool_and(F.col("_ok") & ((F.col("conflict_no") < 0) | (F.col("_sources") >= 2))).alias("quotes_ok")
    )
    cited = drafts.select(key, F.explode(citations(F.col("draft.summary"))).alias("sourceId"))
    stray = cited.join(body.select(key, "sourceId"), [key, "sourceId"], "left_anti")
    strays = stray.groupBy(key).agg(F.count("*").alias("_stray"))
    return (
        drafts.join(quotes, key, "left")
        .join(strays, key, "left")
        .withColumn(
            "grounded",
            F.col("draft").isNotNull() & F.coalesce("quotes_ok", F.lit(True)) & F.col("_stray").isNull(),
        )
        .drop("quotes_ok", "_stray")
    )


def validate_cell_draft(df: DataFrame, raw: str, driving_id: str) -> DataFrame:
    """A drafted matrix cell must use a closed level and cite exactly the driving signal."""
    r = Reply(df, raw)
    r.one_of("level", CELL_LEVELS)
    r.text("note")
    cited = citations(r.value("note"))
    usable = r.reason().isNull() & (F.size(cited) > 0) & F.forall(cited, lambda x: x == F.col(driving_id))
    cell = F.struct(r.value("level").alias("level"), r.value("note").alias("note"))
    return r.df.withColumn("drafted", F.when(usable, cell)).drop("_reply")


def accept_or_fallback(live: Column, valid: Column, deterministic: Column) -> Column:
    return F.when(F.coalesce(valid, F.lit(False)), live).otherwise(deterministic)


def cites_only(text: Column, allowed: Column, need_one: bool = True) -> Column:
    cited = citations(F.coalesce(text, F.lit("")))
    inside = F.size(F.array_except(cited, allowed)) == 0
    return inside & (F.size(cited) > 0) if need_one else inside


