"""Claims, their quotes, contradictions and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsengine.functions import lexicons as L
from newsengine.functions import text as X

VERSION = ["event_id", "version_id"]


def source_text(title: Column, snippet: Column) -> Column:
    return F.concat(X.text_or_empty(title), F.lit(". "), X.text_or_empty(snippet))


def quote_span(source: Column, sentence: Column) -> Column:
    """STRUCT(span_start, span_end): where the sentence begins, from 0, and at most 240 characters on; nulls if it is not there."""
    at = F.nullif(F.position(sentence, source) - 1, F.lit(-1))
    return F.struct(at.alias("span_start"), (at + F.least(F.length(sentence), F.lit(L.MAX_QUOTE))).alias("span_end"))


def claim_sentences(articles: DataFrame) -> DataFrame:
    """One row per article and claim: (event_id, version_id, article_id, media_id, ord, sentence, norm, span).

    Sentences of at least 40 characters; of those that normalize alike in one
    article the first stays. Texts are dealt out by event, once, before they are
    split: all that follows up to status and sections is by event and version,
    so nothing is shuffled or written again. The size limit of events bounds
    what a task holds. Spans are found on the spot, so no sentence carries its
    article's text any further.
    """
    dealt = articles.select(*VERSION, "article_id", "media_id", source_text(F.col("title"), F.col("snippet")).alias("source")).repartition("event_id")
    rows = dealt.select("*", F.posexplode(X.split_sentences(F.col("source"))).alias("pos", "sentence")).where(F.length("sentence") >= L.MIN_SENTENCE)
    rows = rows.select(*VERSION, "article_id", "media_id", "pos", "sentence", X.normalize_claim(F.col("sentence")).alias("norm"), F.struct("article_id", "pos").alias("ord"), quote_span(F.col("source"), F.col("sentence")).alias("span"))
    w = Window.partitionBy(*VERSION, "article_id", "norm").orderBy("pos")
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "pos")


def claim_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in VERSION], "norm"), 256), 1, 24)


def extract_claims(articles: DataFrame) -> DataFrame:
    """Claims with quotes: (event_id, version_id, claim_id, claim_text, claim_type, ord, media_count, quotes).

    Articles come with event_id and version_id; a claim's text is the
    normalized sentence, its type that of its first occurrence.
    """
    rows = claim_sentences(articles).withColumn("kind", X.classify_claim(F.col("sentence")))
    quote = F.struct("ord", "article_id", "media_id", F.substring("sentence", 1, L.MAX_QUOTE).alias("quote_text"), "span", X.quote_role(F.col("kind")).alias("role"))
    per = rows.groupBy(*VERSION, "norm").agg(F.min_by("kind", "ord").alias("claim_type"), F.min("ord").alias("ord"), F.size(F.collect_set("media_id")).cast("long").alias("media_count"), F.array_sort(F.collect_list(quote)).alias("q"))
    quotes = F.transform("q", lambda x: F.struct(x["article_id"].alias("article_id"), x["media_id"].alias("media_id"), x["quote_text"].alias("quote_text"), x["span"]["span_start"].alias("span_start"), x["span"]["span_end"].alias("span_end"), X.quote_strength(x["quote_text"], F.col("media_count")).alias("strength"), x["role"].alias("role")))
    return per.select(*VERSION, claim_id().alias("claim_id"), F.col("norm").alias("claim_text"), "claim_type", "ord", "media_count", quotes.alias("quotes"))


def token_ranks(text: Column, k: int) -> Column:
    """ARRAY<STRUCT(token, freq)> of the ``k`` words over three letters that come first by frequency.

    At a tie whole numbers come first in order of value, then words in order
    of first appearance. Words are sorted once; runs of equal ones are counted
    by where they begin.
    """
    placed = F.array_sort(F.transform(F.filter(F.split(text, f"{X.WS}+"), lambda t: F.length(t) > 3), lambda t, i: F.struct(t.alias("token"), i.alias("pos"))))

    def starts(words: Column) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(w["token"].alias("token"), w["pos"].alias("pos"), i.alias("at")))
        return F.filter(numbered, lambda w: (w["at"] == 0) | (F.get(words, w["at"] - 1)["token"] != w["token"]))

    def ranked(words: Column, runs: Column) -> Column:
        def row(r: Column, i: Column) -> Column:
            number = r["token"].rlike("^(0|[1-9][0-9]{0,8}|[1-3][0-9]{9})$")
            freq = (F.coalesce(F.get(runs, i + 1)["at"], F.size(words)) - r["at"]).cast("long")
            return F.struct((-freq).alias("less"), (~number).alias("word"), F.coalesce(F.when(number, r["token"].cast("long")), F.lit(0)).alias("value"), r["pos"].alias("pos"), r["token"].alias("token"))

        return F.slice(F.array_sort(F.transform(runs, row)), 1, k)

    top = X.let(placed, lambda words: X.let(starts(words), lambda runs: ranked(words, runs)))
    return F.transform(top, lambda r: F.struct(r["token"].alias("token"), (-r["less"]).alias("freq")))


def top_tokens(claims: DataFrame, k: int = 5, keys: tuple[str, ...] = (*VERSION, "claim_id")) -> DataFrame:
    """(keys, token, freq, rank): the ``token_ranks`` of each claim, a row each."""
    rows = claims.select(*keys, F.posexplode(token_ranks(F.col("claim_text"), k)).alias("pos", "t"))
    return rows.select(*keys, "t.token", "t.freq", (F.col("pos") + 1).alias("rank"))


def combinations(words: Column) -> tuple[Column, Column]:
    """(all pairs, all triples) of a sorted array of at most five words, each joined by spaces."""
    rest = lambda at: F.slice(words, at + 2, 5)
    pairs = F.flatten(F.transform(words, lambda x, i: F.transform(rest(i), lambda y: F.concat_ws(" ", x, y))))
    threes = F.flatten(F.transform(words, lambda x, i: F.flatten(F.transform(rest(i), lambda y, j: F.transform(rest(i + j + 1), lambda z: F.concat_ws(" ", x, y, z))))))
    return pairs, threes


def with_contradictions(claims: DataFrame) -> DataFrame:
    """``claims`` with contradicted: whether another claim of the version contradicts it.

    Claims contradict if they share two top tokens, both have numbers and the
    sets differ, or if they share three and just one says "no". No two claims
    meet: a claim counts towards each pair and each triple of its at most five
    top tokens, and where those of one pair have two number sets, or those of
    one triple are split on "no", every one of them has an opponent. So the
    work is twenty small rows a claim, however many claims share a word; the
    claim itself goes along in a row of its own, so that it is made once and
    never joined.
    """
    no = r"(?<![A-Za-z0-9_])no(?![A-Za-z0-9_])"
    kept = F.struct(*claims.columns)
    kind = claims.select(kept.alias("c")).schema["c"].dataType
    item = lambda claim, shared, told: F.struct(claim.alias("claim"), shared.alias("shared"), told.alias("told"))
    text = F.lit(None).cast("string")

    def asked(facts: Column) -> Column:
        # A pair asks for the numbers of claims that have some, a triple for whether they say "no".
        pairs, threes = combinations(facts["words"])
        every = lambda shared, told: F.transform(shared, lambda s: F.struct(s.alias("shared"), told.alias("told")))
        return F.concat(every(F.when(facts["nums"] != "", pairs).otherwise(F.array().cast("array<string>")), facts["nums"]), every(threes, facts["neg"]))

    nums = F.array_join(F.array_sort(F.array_distinct(X.extract_numbers(F.col("claim_text")))), " ")
    words = F.array_sort(F.transform(token_ranks(F.col("claim_text"), 5), lambda t: t["token"]))
    # What is bound by let is computed once a claim.
    facts = F.struct(nums.alias("nums"), F.col("claim_text").rlike(no).cast("string").alias("neg"), words.alias("words"))
    others = F.transform(X.let(facts, asked), lambda a: item(F.lit(None).cast(kind), a["shared"], a["told"]))
    # Numbered before they are laid out, so that all rows of a claim have its number.
    rows = claims.withColumn("__id", F.monotonically_increasing_id()).select(*VERSION, "__id", F.inline(F.concat(F.array(item(kept, text, text)), others)))
    same = Window.partitionBy(*VERSION, "shared")
    split = F.coalesce(F.min("told").over(same) != F.max("told").over(same), F.lit(False))
    found = rows.withColumn("__bad", split).where("__bad or claim is not null")
    per = found.groupBy(*VERSION, "__id").agg(F.first("claim", ignorenulls=True).alias("claim"), F.max("__bad").alias("contradicted"))
    # By the grouping's own columns, by which the rows are dealt out already.
    return per.select(*[c if c in VERSION else F.col(f"claim.{c}").alias(c) for c in claims.columns], "contradicted")


def detect_contradictions(claims: DataFrame) -> DataFrame:
    """(event_id, version_id, claim_id) of claims that contradict another one of their version."""
    return with_contradictions(claims).where("contradicted").select(*VERSION, "claim_id")


def status_of(contradicted: Column) -> Column:
    """DISPUTED, SUPPORTED or INSUFFICIENT of a claim with quotes."""
    medium = F.filter("quotes", lambda q: q["strength"] == "MEDIUM")
    strong = F.exists("quotes", lambda q: q["strength"] == "STRONG")
    both = (F.size(medium) >= 2) & (F.size(F.array_distinct(F.transform(medium, lambda q: q["media_id"]))) >= 2)
    return F.when(contradicted, "DISPUTED").when(strong | both, "SUPPORTED").otherwise("INSUFFICIENT")


def claim_status(claims: DataFrame, contradicted: DataFrame) -> DataFrame:
    """``claims`` with status: DISPUTED, SUPPORTED or INSUFFICIENT."""
    flag = contradicted.select(*VERSION, "claim_id").withColumn("__bad", F.lit(True))
    return claims.join(flag, [*VERSION, "claim_id"], "left").withColumn("status", status_of(F.col("__bad"))).drop("__bad")


def build_claims(articles: DataFrame) -> DataFrame:
    """All of it for one set of event versions; the texts are read, dealt out and split once."""
    return with_contradictions(extract_claims(articles)).withColumn("status", status_of(F.col("contradicted"))).drop("contradicted")


EXTRACTION = "claims array<struct<claim_text:string,claim_type:string,polarity:string,confidence:double,evidence:array<struct<source_url:string,quote:string>>>>"


def claims_from_extraction(extractions: DataFrame, articles: DataFrame) -> DataFrame:
    """Claims with quotes from (event_id, version_id, json) of an external extractor.

    Items without text, evidence or a confidence within [0, 1] go, and so do
    repeats of a normalized text. Evidence is matched to the event's articles
    by URL; unmatched and empty quotes go. JSON that cannot be read has no claims.
    """
    items = extractions.select(*VERSION, F.posexplode(F.from_json("json", EXTRACTION)["claims"]).alias("pos", "c"))
    ok = (F.coalesce("c.claim_text", F.lit("")) != "") & (F.size("c.evidence") > 0) & F.col("c.confidence").between(0, 1)
    rows = items.where(F.coalesce(ok, F.lit(False))).withColumn("norm", X.normalize_claim(F.col("c.claim_text")))
    first = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*VERSION, "norm").orderBy("pos"))).where("__rn = 1")
    kind = F.when(F.col("c.claim_type").isin(L.CLAIM_TYPES), F.col("c.claim_type")).otherwise(X.classify_claim(F.col("c.claim_text")))
    base = first.select(*VERSION, "pos", "norm", F.col("c.claim_text").alias("claim_text"), kind.alias("claim_type"), F.col("c.polarity").alias("polarity"), F.col("c.confidence").alias("confidence"), F.posexplode("c.evidence").alias("epos", "e"))
    cited = base.join(articles.select("event_id", F.col("url").alias("__url"), "article_id", "media_id", source_text(F.col("title"), F.col("snippet")).alias("source")), (base["event_id"] == articles["event_id"]) & (F.col("e.source_url") == F.col("__url")), "left").drop(articles["event_id"])
    text = F.substring(F.coalesce("e.quote", F.lit("")), 1, L.MAX_QUOTE)
    at = F.nullif(F.position(F.substring(text, 1, 60), F.col("source")) - 1, F.lit(-1))
    quote = F.when(F.col("article_id").isNotNull() & (text != ""), F.struct("epos", "article_id", "media_id", text.alias("quote_text"), at.alias("span_start"), (at + F.length(text)).alias("span_end")))
    per = cited.groupBy(*VERSION, "pos", "norm", "claim_text", "claim_type", "polarity", "confidence").agg(F.countDistinct("media_id").alias("media_count"), F.array_sort(F.array_compact(F.collect_list(quote))).alias("q"))
    strength = lambda q: F.when(F.col("media_count") >= 2, "STRONG").when(F.length(q["quote_text"]) >= 80, "MEDIUM").otherwise("WEAK")
    quotes = F.transform("q", lambda q: F.struct(q["article_id"].alias("article_id"), q["media_id"].alias("media_id"), q["quote_text"].alias("quote_text"), q["span_start"].alias("span_start"), q["span_end"].alias("span_end"), strength(q).alias("strength"), X.quote_role(F.col("claim_type")).alias("role")))
    status = F.when((F.col("confidence") >= 0.7) & (F.col("media_count") >= 2), "SUPPORTED").when(F.col("confidence") >= 0.5, "SUPPORTED").when(F.col("polarity") == "deny", "DISPUTED").otherwise("INSUFFICIENT")
    return per.select(*VERSION, claim_id().alias("claim_id"), "claim_text", "claim_type", "media_count", status.alias("status"), quotes.alias("quotes"))


def version_claims_hash(articles: DataFrame) -> DataFrame:
    """(event_id, version_id, claims_hash) over the articles' ids and times."""
    pair = F.concat(F.col("article_id").cast("string"), F.lit(":"), X.text_or_empty(X.iso(F.col("created_at"))))
    return articles.groupBy(*VERSION).agg(X.claims_hash(F.collect_list(pair)).alias("claims_hash"))
