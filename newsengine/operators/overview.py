"""Overviews of event versions: bullets, sections, gates, teasers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsengine.functions import lexicons as L
from newsengine.functions import text as X
from newsengine.operators.claims import VERSION


def section_of(status: Column, kind: Column) -> Column:
    return F.when(status == "INSUFFICIENT", "que_falta").when(status == "DISPUTED", "en_disputa").when(kind.isin("FACT", "QUANT"), "que_paso").otherwise("contexto")


def overview_bullets(claims: DataFrame) -> DataFrame:
    """Claims with at least one quote, with their section and citation_refs.

    ``claims`` has ord (its order in the version), quotes ARRAY<STRUCT> with
    article_id; other citation fields are taken where they are there.
    """
    return claims.where(F.size("quotes") > 0).select(*VERSION, "ord", "claim_id", "claim_text", "claim_type", "status", section_of(F.col("status"), F.col("claim_type")).alias("section"), F.col("quotes").alias("citation_refs"))


def flag_sums() -> list[Column]:
    return [F.count("*").alias("claims_count"), F.sum(F.greatest(F.size("quotes"), F.lit(0))).alias("quotes_count"), F.count_if(F.col("status") == "SUPPORTED").alias("supported_count"), F.count_if(F.col("status") == "DISPUTED").alias("disputed_count"), F.count_if(F.size("quotes") > 0).alias("bullets")]


def evidence_rate() -> Column:
    return F.coalesce(F.try_divide("supported_count", "claims_count"), F.lit(0.0))


def quality_flags(claims: DataFrame) -> DataFrame:
    """Counts per version: claims, quotes, supported, disputed, evidence_rate."""
    return claims.groupBy(*VERSION).agg(*flag_sums()).withColumn("evidence_rate", evidence_rate())


def overview_gate(supported: Column, bullets: Column) -> Column:
    return F.when((supported >= 2) & (bullets > 0), "PASS").otherwise("FAIL")


def overview_sections(claims: DataFrame) -> DataFrame:
    """One row per version: gate_status, four sections of bullets in claim order, and the counts.

    Counts and sections come from one grouping. A failed gate empties the
    first two sections.
    """
    cited = F.when(F.size("quotes") > 0, section_of(F.col("status"), F.col("claim_type")))
    item = F.struct("ord", "claim_id", F.col("claim_text").alias("text"), "claim_type", "status", F.col("quotes").alias("citation_refs"))
    lists = [F.array_sort(F.collect_list(F.when(F.col("__section") == k, item))).alias(k) for k, _ in L.SECTIONS]
    joined = claims.withColumn("__section", cited).groupBy(*VERSION).agg(*flag_sums(), *lists).withColumn("evidence_rate", evidence_rate())
    gate = overview_gate(F.col("supported_count"), F.col("bullets"))
    kind = joined.schema["que_paso"].dataType
    none = F.array().cast(kind)
    own = lambda k: F.when((gate == "FAIL") & F.lit(k in ("que_paso", "contexto")), none).otherwise(F.coalesce(k, none))
    sections = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(k).alias("key"), F.transform(own(k), lambda b: b.dropFields("ord")).alias("bullets")) for k, t in L.SECTIONS])
    return joined.select(*VERSION, gate.alias("gate_status"), sections.alias("sections"), "claims_count", "quotes_count", "evidence_rate", "supported_count", "disputed_count")


def evidence_gate(sources: Column, quotes: Column) -> Column:
    return F.array_compact(F.array(F.when(sources < 2, "SINGLE_SOURCE"), F.when(quotes < 2, "MISSING_QUOTES")))


def evidence_counts(claims: DataFrame) -> DataFrame:
    """(event_id, version_id, sources, quotes, reasons): distinct outlets and quotes of a version's claims."""
    rows = claims.select(*VERSION, F.explode_outer("quotes").alias("q"))
    per = rows.groupBy(*VERSION).agg(F.countDistinct("q.media_id").alias("sources"), F.count("q").alias("quotes"))
    return per.withColumn("reasons", evidence_gate(F.col("sources"), F.col("quotes")))


def content_gate(what_happened: Column, context: Column, in_dispute: Column) -> Column:
    filled = lambda c: F.coalesce(F.exists(c, lambda s: X.trim_ws(X.text_or_empty(s)) != ""), F.lit(False))
    return F.array_compact(F.array(F.when(~filled(what_happened), "EMPTY_WHAT_HAPPENED"), F.when(~filled(context), "EMPTY_CONTEXT"), F.when(~filled(in_dispute), "EMPTY_IN_DISPUTE")))


def insufficient_overview(reasons: Column) -> Column:
    texts = F.array().cast("array<string>")
    return F.struct(
        F.lit("").alias("overview"),
        F.array(F.lit(L.INSUFFICIENT_TEXT)).alias("what_happened"),
        texts.alias("context"),
        texts.alias("in_dispute"),
        F.lit("No concluyente").alias("confidence_label"),
        F.concat(F.lit("Bloqueado por gates: "), F.array_join(reasons, ", ")).alias("why"),
        F.lit("INSUFFICIENT_EVIDENCE").alias("status"),
    )


AI_OVERVIEW = "overview string, what_happened array<string>, context array<string>, in_dispute array<string>, confidence_label string, why string, disputes array<struct<topic:string,point_a:string,point_b:string,why_disputed:string,confidence:double>>, consensus array<struct<claim_text:string,why_consensus:string,confidence:double>>"


def normalize_ai_overview(json: Column) -> Column:
    """An external overview in its declared shape: unknown labels and non-arrays fall back, confidences stay within [0, 1]."""
    o = F.from_json(json, AI_OVERVIEW)
    texts = lambda k: F.coalesce(o[k], F.array().cast("array<string>")).alias(k)
    fit = lambda x: x.withField("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["confidence"], F.lit(0.0)))))
    label = F.when(o["confidence_label"].isin(L.CONFIDENCE_LABELS), o["confidence_label"]).otherwise("No concluyente")
    rows = lambda k: F.coalesce(F.transform(o[k], fit), F.filter(F.transform(F.from_json(F.lit('{"disputes":[{}],"consensus":[{}]}'), AI_OVERVIEW)[k], fit), lambda x: F.lit(False))).alias(k)
    return F.struct(F.coalesce(o["overview"], F.lit("")).alias("overview"), texts("what_happened"), texts("context"), texts("in_dispute"), label.alias("confidence_label"), F.coalesce(o["why"], F.lit("")).alias("why"), rows("disputes"), rows("consensus"))


def overview_dedup(versions: DataFrame, stored: DataFrame) -> DataFrame:
    """Versions (version_id, claims_hash) whose overview is not stored under the same hash."""
    now = versions.withColumn("overview_hash", X.overview_hash(F.col("version_id"), F.col("claims_hash")))
    return now.join(stored.where("ai_overview is not null").select("version_id", "overview_hash"), ["version_id", "overview_hash"], "left_anti")


def enrich_published(events: DataFrame, latest: DataFrame, articles: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, overviews, marks) for the latest versions of published events that are not marked as done.

    ``articles`` has event_id; ``latest`` one (event_id, version_id) per event.
    """
    from newsengine.operators.claims import build_claims

    todo = latest.join(events.where("state = 'PUBLISHED'").select("event_id"), "event_id", "left_semi").join(marks.select("version_id"), "version_id", "left_anti").select("event_id", "version_id")
    claims = build_claims(articles.join(todo, "event_id"))
    return claims, overview_sections(claims), todo.select("event_id", "version_id")
