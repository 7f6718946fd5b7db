"""Column functions over text: tokens, sentences, pages, claims, junk and small formats."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsengine.functions import lexicons as L

EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: White space as the pages and texts have it: ASCII, no-break and other Unicode spaces.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bounded(pattern: str) -> str:
    """A junk pattern as a Java pattern: W becomes an ASCII word boundary, case and accents fold."""
    return "(?iu)" + pattern.replace("W", EDGE)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; printable ASCII is passed over first."""
    return F.regexp_replace(c, f"(?![!-~]){WS}+", " ")


def holds(c: Column, words: str) -> Column:
    """Whether a text holds any of some plain words with bars between them."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words.split("|")])


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def tokenize_letters(c: Column) -> Column:
    """Lower-cased runs of letters; other characters vanish, white space separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\s\u00A0]", ""), f"{WS}+"), lambda t: t != "")


def whitespace_tokens(c: Column) -> Column:
    """Lower-cased pieces between white space; a leading one may be empty and counts."""
    return F.split(F.lower(text_or_empty(c)), f"{WS}+")


def strip_accents(c: Column) -> Column:
    return F.translate(c, "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ", "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY")


def is_spanish(c: Column) -> Column:
    """False without words; true without stop words; else by the share of Spanish among stop words."""
    hits = lambda t, ws: F.size(F.filter(t, lambda x: x.isin(ws)))
    share = lambda es, en: F.when(es + en == 0, True).otherwise(es / F.greatest(es + en, F.lit(1)) >= L.SPANISH_SHARE)
    return let(tokenize_letters(c), lambda t: F.when(F.size(t) == 0, False).otherwise(let(F.struct(hits(t, L.SPANISH_STOP_WORDS).alias("es"), hits(t, L.ENGLISH_STOP_WORDS).alias("en")), lambda n: share(n["es"], n["en"]))))


def strip_html(c: Column) -> Column:
    return trim_ws(squeeze(F.regexp_replace(c, "<[^>]+>", "")))


def decode_entities(c: Column) -> Column:
    """Five references, the ampersand first, so ``&amp;lt;`` ends as ``<``."""
    for ref, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(ref), F.lit(char))
    return c


def first_group(c: Column, pattern: str) -> Column:
    """The first group of the first match, null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def extract_meta(page: Column, prop: str) -> Column:
    name = prop.replace(".", r"\.")
    key, content = rf"(?:property|name)=[\"']{name}[\"']", r"content=[\"']([^\"']+)[\"']"
    return decode_entities(F.coalesce(first_group(page, rf"(?i)<meta[^>]+{key}[^>]+{content}"), first_group(page, rf"(?i)<meta[^>]+{content}[^>]+{key}")))


def extract_h1(page: Column) -> Column:
    return strip_html(first_group(page, r"(?is)<h1[^>]*>(.*?)</h1>"))


def extract_lead_paragraph(page: Column) -> Column:
    """The first paragraph of a class with ``lead``, else the first with over 40 characters."""
    lead = strip_html(first_group(page, r'(?is)<p[^>]*class="[^"]*lead[^"]*"[^>]*>(.*?)</p>'))
    found = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), strip_html)
    return F.coalesce(lead, F.get(F.filter(found, lambda p: F.length(p) > 40), F.lit(0)))


def split_sentences(c: Column) -> Column:
    """Pieces that end in . ; or : before white space; dots of abbreviations do not count."""
    mark = "\ue000"
    # Found from the dots on, which are few; no abbreviation holds one.
    held = F.regexp_replace(text_or_empty(c), rf"(?i)\.(?<=(?:{L.ABBREVIATIONS})\.)", mark)
    return F.filter(F.transform(F.split(held, rf"(?<=[.;:]){WS}+"), lambda s: trim_ws(F.replace(s, F.lit(mark), F.lit(".")))), lambda s: s != "")


def normalize_claim(c: Column) -> Column:
    return squeeze(F.regexp_replace(trim_ws(F.lower(c)), r"(?![a-z0-9 ])[^\p{L}\p{N}\s\u00A0]", ""))


def classify_claim(c: Column) -> Column:
    kind = let(F.lower(c), lambda low: F.when(holds(low, L.ALLEGATION), "ALLEGATION").when(holds(low, L.FORECAST), "FORECAST").when(holds(low, L.OPINION), "OPINION").otherwise("FACT"))
    return F.when(c.rlike("[0-9]"), "QUANT").otherwise(kind)


def quote_strength(c: Column, media_count: Column) -> Column:
    kind = let(F.lower(c), lambda low: F.when(holds(low, L.ATTRIBUTED), "STRONG").when(holds(low, L.HEDGED), "WEAK").when(F.length(c) >= 80, "MEDIUM").otherwise("WEAK"))
    return F.when((media_count >= 2) | c.rlike("[0-9]"), "STRONG").otherwise(kind)


def quote_role(claim_type: Column) -> Column:
    return F.when(claim_type.isin("ALLEGATION", "OPINION"), "ATTRIBUTION").otherwise("EVIDENCE")


def extract_numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))


def extract_entities(c: Column) -> Column:
    """Lower-cased runs of capitalised words, joined by connectives, and quoted stretches of 3 to 50 characters."""
    capital, small = "[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]+", "(?:de|del|la|el|los|las|y|en)"
    named = F.regexp_extract_all(text_or_empty(c), F.lit(rf"{capital}(?:{WS}+(?:{small}{WS}+)*{capital})*"), F.lit(0))
    quoted = F.regexp_extract_all(text_or_empty(c), F.lit('"([^"]{3,50})"'), F.lit(1))
    return F.array_union(F.transform(named, lambda x: trim_ws(F.lower(x))), F.transform(quoted, lambda x: trim_ws(F.lower(x))))


def hits(c: Column, patterns: list[str]) -> Column:
    return sum((F.coalesce(c, F.lit("")).rlike(bounded(p)).cast("int") for p in patterns), F.lit(0))


def junk_score(url: Column, title: Column, snippet: Column, author: Column | None = None) -> Column:
    """STRUCT(score, signals) of how much an article looks like an advert; nulls count as empty."""
    title, snippet = text_or_empty(title), text_or_empty(snippet)
    n_url, n_title, n_seo = hits(url, L.JUNK_URL), hits(title, L.JUNK_TITLE), hits(F.concat(title, F.lit(" "), snippet), L.JUNK_SEO)
    n_author = F.lit(0) if author is None else hits(author, L.JUNK_AUTHOR)
    w = L.JUNK_WEIGHTS
    brief = F.length(snippet) < 100
    raw = (
        F.when(n_url > 0, w["url"]).otherwise(0.0)
        + F.when(n_author > 0, w["author"]).otherwise(0.0)
        + F.when(n_title >= 2, w["title"]).when(n_title == 1, w["title"] * 0.5).otherwise(0.0)
        + F.when(n_seo > 0, w["seo"]).otherwise(0.0)
        + F.when(brief, w["short"]).otherwise(0.0)
    )
    told = lambda name, n: F.when(n > 0, F.concat(F.lit(f"{name}("), n.cast("string"), F.lit(")")))
    signals = F.array_compact(F.array(told("url_pattern", n_url), told("author_section", n_author), told("title_keywords", n_title), told("seo_spam", n_seo), F.when(brief, "short_snippet")))
    return F.struct(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 10).alias("score"), signals.alias("signals"))


def junk_classify(score: Column) -> Column:
    return F.when(score >= L.JUNK_EXCLUDE, "excluded").when(score >= L.JUNK_PENALTY, "penalized").otherwise("normal")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def derive_teaser(bullets: Column, most: int = 140) -> Column:
    """Non-blank bullets joined; cut at the last space past half the length, with an ellipsis."""
    joined = trim_ws(squeeze(F.array_join(F.filter(F.coalesce(bullets, F.array().cast("array<string>")), lambda s: trim_ws(s) != ""), " ")))
    cut = F.substring(joined, 1, most - 1)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    boundary = F.when((F.instr(cut, " ") > 0) & (last > most * 0.5), last).otherwise(most - 1)
    return F.when(F.length(joined) <= most, joined).otherwise(F.concat(F.regexp_replace(joined.substr(F.lit(1), boundary), rf"{WS}+\z", ""), F.lit("…")))


def iso(ts: Column) -> Column:
    """UTC time as 2024-01-31T12:00:00.000Z; the session's time zone is to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def encode_cursor(ts: Column, id_: Column) -> Column:
    return F.base64(F.encode(F.concat(iso(ts), F.lit("|"), id_.cast("string")), "UTF-8"))


def decode_cursor(cursor: Column) -> Column:
    """STRUCT(published_at, event_id); null parts where the cursor is not valid."""
    plain = F.call_function("try_to_binary", cursor, F.lit("base64")).cast("string")
    at = F.instr(plain, "|")
    when = F.try_to_timestamp(F.when(at > 1, F.substring_index(plain, "|", 1)))
    rest = F.when(at > 1, plain.substr(at + 1, F.length(plain)))
    return F.struct(when.alias("published_at"), F.when(when.isNotNull() & (rest != ""), rest).alias("event_id"))


def valid_cursor(cursor: Column) -> Column:
    """No cursor is valid; else base64 of ``time|id``."""
    return cursor.isNull() | F.coalesce(decode_cursor(cursor)["event_id"].isNotNull(), F.lit(False))


def relative_time(seconds: Column) -> Column:
    whole = lambda n: F.floor(seconds / n).cast("string")
    return F.when(seconds < 60, "hace un momento").when(seconds < 3600, F.concat(F.lit("hace "), whole(60), F.lit(" min"))).when(seconds < 86400, F.concat(F.lit("hace "), whole(3600), F.lit("h"))).when(seconds.isNotNull(), F.concat(F.lit("hace "), whole(86400), F.lit("d")))


def history_segment(state: Column, t_last: Column, now: Column) -> Column:
    stale = F.coalesce((F.unix_millis(now) - F.unix_millis(t_last)) > 7 * 86_400_000, F.lit(False))
    return F.when(state == "CLOSED", "cerrados").when(state.isin("PUBLISHED", "UPDATING"), "en_desarrollo").when(stale, "cerrados").otherwise("vistos")


def claims_hash(pairs: Column) -> Column:
    """16 hex digits over the sorted ``id:time`` strings."""
    return F.substring(F.sha2(F.concat(F.lit(f"claims:{L.PROMPT_VERSION}:"), F.array_join(F.array_sort(pairs), "|")), 256), 1, 16)


def overview_hash(version_id: Column, claims: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"overview:{L.PROMPT_VERSION}:"), version_id.cast("string"), F.lit(":"), claims), 256), 1, 16)


def hash_token(token: Column, slots: int = 256) -> Column:
    """31 * h + c over the characters in 32-bit two's complement, its magnitude modulo ``slots``."""
    h = F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)) % slots
