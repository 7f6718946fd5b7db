import base64

import pytest
from pyspark.sql import functions as F

from newsengine.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("", False), (None, False), ("Bogotá Medellín", True), ("the house of the people in the city", False), ("la casa de los niños en el parque", True), ("de la el the and", True), ("de la the and", False)],
)
def test_is_spanish(spark, text, want):
    assert one(spark, X.is_spanish(F.col("t")), t=text) is want


def test_page_parts(spark):
    page = '<html><meta content="A &amp; B" property="og:title"><meta name=\'og:description\' content=\'D &amp;lt; E\'><h1 class=x> <b>Head</b>\n line </h1><p>short</p><p class="big lead x"> The lead </p></html>'
    assert one(spark, X.extract_meta(F.col("t"), "og:title"), t=page) == "A & B"
    assert one(spark, X.extract_meta(F.col("t"), "og:description"), t=page) == "D < E"
    assert one(spark, X.extract_meta(F.col("t"), "og:none"), t=page) is None
    assert one(spark, X.extract_h1(F.col("t")), t=page) == "Head line"
    assert one(spark, X.extract_lead_paragraph(F.col("t")), t=page) == "The lead"
    plain = "<p>short</p><P>This paragraph has <i>more</i> than forty characters in it.</P>"
    assert one(spark, X.extract_lead_paragraph(F.col("t")), t=plain) == "This paragraph has more than forty characters in it."
    assert one(spark, X.extract_h1(F.col("t")), t="<p>x") is None


def test_sentences(spark):
    text = "El Dr. Gómez habló. Luego: nada; fin. Sr. X no.  Adiós"
    assert one(spark, X.split_sentences(F.col("t")), t=text) == ["El Dr. Gómez habló.", "Luego:", "nada;", "fin.", "Sr. X no.  Adiós"]
    assert one(spark, X.split_sentences(F.col("t")), t=None) == []


def test_claim_wording(spark):
    kind = lambda t: one(spark, X.classify_claim(F.col("t")), t=t)
    assert [kind(t) for t in ("Subió 5%", "El ministro dijo eso", "Se espera lluvia", "El senador criticó", "Llueve")] == ["QUANT", "ALLEGATION", "FORECAST", "OPINION", "FACT"]
    assert one(spark, X.normalize_claim(F.col("t")), t="  El PIB, ¡subió   1.5%! ") == "el pib subió 15"
    strength = lambda t, n: one(spark, X.quote_strength(F.col("t"), F.lit(n)), t=t)
    assert [strength("x", 2), strength("hay 3", 1), strength("al parecer no", 1), strength("y" * 80, 1), strength("y" * 79, 1)] == ["STRONG", "STRONG", "WEAK", "MEDIUM", "WEAK"]


def test_hash_token(spark):
    assert one(spark, X.hash_token(F.col("t"), 1 << 31), t="reforma") == 1085367754
    assert one(spark, X.hash_token(F.col("t")), t="reforma") == 1085367754 % 256


def test_entities(spark):
    got = one(spark, X.extract_entities(F.col("t")), t='El Ministerio de Salud y "la casa azul" con Juan Pérez, "ab"')
    assert got == ["el ministerio de salud", "juan pérez", "la casa azul"]


def test_junk(spark):
    def junk(url="https://m.co/politica/nota-1", title="Noticia", snippet="z" * 100, author=""):
        r = one(spark, X.junk_score(F.col("u"), F.col("t"), F.col("s"), F.col("a")), u=url, t=title, s=snippet, a=author)
        return round(r["score"], 4), r["signals"]

    assert junk() == (0.0, [])
    assert junk(url="https://m.co/patrocinado/x") == (0.35, ["url_pattern(1)"])
    assert junk(url="https://m.co/patrocinadora/x") == (0.0, [])
    assert junk(title="Gran OFERTA") == (0.15, ["title_keywords(1)"])
    assert junk(title="Oferta gratis: inscríbete y gana")[0] == 0.30
    assert junk(author="Redacción Comercial") == (0.45, ["author_section(1)"])
    assert junk(snippet="corto") == (0.10, ["short_snippet"])
    assert junk(url="https://m.co/CUPÓN", title="Compra y gana", snippet="seo", author="aliado") == (1.0, ["url_pattern(1)", "author_section(1)", "title_keywords(2)", "seo_spam(1)", "short_snippet"])


def test_teaser(spark):
    teaser = lambda *t: one(spark, X.derive_teaser(F.col("t")), t=list(t))
    assert teaser("a  b", " ", "c") == "a b c"
    assert one(spark, X.derive_teaser(F.lit(None).cast("array<string>")), t="x") == ""
    long = teaser("palabra " * 40)
    assert len(long) <= 140 and long.endswith("palabra…")
    assert teaser("x" * 200) == "x" * 139 + "…"


def test_cursor(spark):
    enc = lambda s: base64.b64encode(s.encode()).decode()
    valid = lambda c: one(spark, X.valid_cursor(F.col("c")), c=c)
    good = enc("2024-01-02T03:04:05.000Z|ev1")
    assert [valid(c) for c in (None, good, enc("nopipe"), enc("|x"), enc("yesterday|x"), enc("2024-01-02T03:04:05Z|"), "%%%")] == [True, True, False, False, False, False, False]
    made = one(spark, X.encode_cursor(F.lit("2024-01-02 03:04:05").cast("timestamp"), F.col("e")), e="ev1")
    assert made == good


def test_times(spark):
    ago = lambda s: one(spark, X.relative_time(F.lit(s)), t="x")
    assert [ago(s) for s in (59, 60, 3600, 86399, 86400 * 3)] == ["hace un momento", "hace 1 min", "hace 1h", "hace 23h", "hace 3d"]
    now = F.lit("2024-01-20").cast("timestamp")
    seg = lambda st, t: one(spark, X.history_segment(F.lit(st), F.lit(t).cast("timestamp"), now), t="x")
    assert [seg("CLOSED", None), seg("PUBLISHED", None), seg("DETECTED", "2024-01-12"), seg("DETECTED", "2024-01-13"), seg("DETECTED", None)] == ["cerrados", "en_desarrollo", "cerrados", "vistos", "vistos"]
