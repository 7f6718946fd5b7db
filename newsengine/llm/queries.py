"""Queries that apply the training-data operators to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsengine.llm.bpe import bpe_round_trip
from newsengine.llm.chat import fit_hmm, format_chats
from newsengine.llm.frames import cut
from newsengine.llm.html import extract_main_text, fit_labeller
from newsengine.llm.licenses import SIMILARITY, TEMPLATES, default_templates, scan_licenses
from newsengine.llm.mixing import domain_posteriors, fit_domains, fit_rates, mix, targets_met
from newsengine.llm.neardup import near_duplicates
from newsengine.llm.ngrams import fit_ngrams, held_out, score_texts
from newsengine.llm.quality import COUNTS, fit_forests, judge_quality
from newsengine.llm.repeats import remove_repeats
from newsengine.llm.tiff import tiff_pages, tiff_store
from newsengine.llm.trie import shared_prefix_trie
from newsengine.llm.urls import ALLOW_LIMITS, UrlRule, judge_urls, mine_rules
from newsengine.llm.whitening import fit_whitener, whiten

#: Vocabulary file of the encoding query.
BPE_FILE = "byte_bpe_50k.json"
#: The stated rules of the URL query.
URL_RULES = [
    UrlRule("block", "com", "en/"),
    UrlRule("allow", "example.com", "en/7"),
    UrlRule("allow", "net", "de/"),
    UrlRule("block", "example.net", "de/8"),
    UrlRule("block", "org", "es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = BPE_FILE) -> str:
    """Path of a public vocabulary on the machine that calls this: workers find their own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every URL of ``pages``; rules of both verdicts are mined from pages whose id is labelled (blocked: quality 0)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("blocked"))
    labelled = pages.join(labels, "page_id")
    mined = mine_rules(labelled).union(mine_rules(labelled, ALLOW_LIMITS, verdict="allow"))
    return judge_urls(pages, URL_RULES, mined).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: ``source/lang/k/j/doc_id.txt`` with k and j the id by ten thousands and hundreds.

    A document of at most 16 words that states a licence is a licence file and
    sits two directories higher, in ``source/lang``.
    """
    brief = F.size(F.array_remove(F.split("text", "[\\s]+"), "")) <= 16
    named = brief & F.lower("text").rlike("licen[cs]e")
    top = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")))
    low = F.concat_ws("/", top, F.floor(F.col("doc_id") / 10000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"))
    return docs.select("doc_id", "text", F.concat(F.when(named, top).otherwise(low), F.lit("/"), F.when(named, "LICENSE-").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, its own or its nearest directory's."""
    files = document_files(table(spark, sf_dir, "documents"))
    return scan_licenses(files, default_templates(spark))


def licence_sql() -> str:
    """The same scan for an SQL engine: templates as values, cosines of all sentences by joins on tokens."""
    quoted = lambda t: t.replace("'", "''")
    values = ", ".join(f"({i}, '{quoted(n)}', '{quoted(t)}')" for i, (n, t) in enumerate(TEMPLATES))
    pattern = "'[a-z0-9]+(?:[.-][a-z0-9]+)*'"
    return rf"""
WITH tpl(template_id, license, text) AS (VALUES {values}),
ttf AS (SELECT template_id, license, token, count(*) AS tf FROM (SELECT template_id, license, unnest(regexp_extract_all(lower(text), {pattern})) AS token FROM tpl) GROUP BY ALL),
tdf AS (SELECT token, ln((1 + {len(TEMPLATES)}) / (1 + count(*))) + 1 AS idf FROM ttf GROUP BY 1),
tw AS (SELECT template_id, license, token, tf * idf AS w FROM ttf JOIN tdf USING (token)),
tn AS (SELECT template_id, license, token, w / sqrt(sum(w * w) OVER (PARTITION BY template_id)) AS part FROM tw),
d AS (SELECT doc_id, text, len(list_filter(string_split_regex(text, '[\s]+'), lambda x: x <> '')) <= 16 AND regexp_matches(lower(text), 'licen[cs]e') AS named, coalesce(source, '_') || '/' || coalesce(lang, '_') AS top FROM documents),
p AS (SELECT doc_id, text, named, CASE WHEN named THEN top ELSE top || '/' || (doc_id // 10000) || '/' || (doc_id // 100) END AS dir FROM d),
se AS (SELECT doc_id, unnest(list_distinct(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda x: trim(x)))) AS sentence FROM p),
st AS (SELECT sentence, token, count(*) AS tf FROM (SELECT sentence, unnest(regexp_extract_all(lower(sentence), {pattern})) AS token FROM (SELECT DISTINCT sentence FROM se)) GROUP BY ALL),
sw AS (SELECT sentence, token, tf * coalesce(idf, ln(1.0 + {len(TEMPLATES)}) + 1) AS w FROM st LEFT JOIN tdf USING (token)),
sn AS (SELECT sentence, sqrt(sum(w * w)) AS norm FROM sw GROUP BY 1),
sc AS (SELECT sentence, template_id, license, round(sum(w * part) / any_value(norm), 6) AS similarity FROM sw JOIN tn USING (token) JOIN sn USING (sentence) GROUP BY ALL),
b AS (SELECT sentence, license, similarity FROM sc QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY similarity DESC, template_id) = 1),
own AS (SELECT doc_id, license, similarity FROM se JOIN b USING (sentence) WHERE similarity >= {SIMILARITY} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, license DESC) = 1),
f AS (SELECT p.doc_id, dir, dir || '/' || CASE WHEN named THEN 'LICENSE-' ELSE '' END || p.doc_id || '.txt' AS path, named, license AS own_license, similarity FROM p LEFT JOIN own USING (doc_id)),
h AS (SELECT dir AS held, own_license AS dir_license FROM f WHERE named AND own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, path) = 1),
nr AS (SELECT dir, held, dir_license FROM (SELECT DISTINCT dir FROM f) JOIN h ON dir = held OR starts_with(dir, held || '/') OR held = '' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(held) DESC) = 1)
SELECT doc_id, path, own_license, similarity, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NOT NULL THEN 'header' WHEN held IS NOT NULL THEN 'directory' END AS basis, CASE WHEN own_license IS NULL THEN held END AS from_dir FROM f LEFT JOIN nr USING (dir)"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every whole text of ``documents`` with forests calibrated on ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forests = fit_forests(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs, forests, keep=["doc_id"]).select("doc_id", *COUNTS[:5], "base_failed", "kept", F.round("score", 6).alias("score"))


#: Target shares of tokens; the tokens of clean documents keep their number.
MIX = {"clean": 0.97, "low": 0.02, "toxic": 0.01}


def label_domains(labels: DataFrame) -> DataFrame:
    """Domain of each label: toxic, else low quality, else clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("toxic") == 0) & (F.col("quality") == 1), "clean").alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of every document so that expected tokens of the label domains meet ``MIX``; ``met`` says whether they do."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_domains(docs, label_domains(table(spark, sf_dir, "labels")))
    posteriors = cut(domain_posteriors(docs, model, keep=["doc_id"]))
    steps, target, reached = fit_rates(posteriors, model.domains, MIX, anchor="clean")
    rated = mix(posteriors, steps)
    return rated.select("doc_id", "n_tokens", *[F.round(F.col("posterior")[k], 6).alias(f"p_{x}") for k, x in enumerate(model.domains)], F.round("rate", 6).alias("rate"), F.lit(targets_met(target, reached)).alias("met"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    model = fit_labeller(pages)
    return extract_main_text(pages, model, keep=["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document: near-duplicates share the least id of their class."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as transcripts: turns lose their role, three of four say who speaks, in one of four styles."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    names = {"user": ["User: ", "Human: ", "[user] ", "Q: "], "assistant": ["Assistant: ", "AI: ", "[assistant] ", "A: "], "system": ["System: ", "Context: ", "[system] ", "Instructions: "]}
    mark = F.lit("")
    for role, marks in names.items():
        mark = F.when(F.col("role") == role, F.array(*[F.lit(m) for m in marks])[style.cast("int")]).otherwise(mark)
    said = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) > 0
    return conversations.withColumn("text", F.concat(F.when(said, mark).otherwise(""), F.coalesce("text", F.lit(""))))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recover the roles of every conversation's transcript and render its turns.

    Each half of the conversations is decoded by the model of the other half.
    """
    given = transcripts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    half = F.pmod(F.xxhash64("conv_id"), F.lit(8)) < 4
    done = [format_chats(given.where(here).drop("role"), fit_hmm(given.where(~here))) for here in (half, ~half)]
    return done[0].unionByName(done[1])


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every whole text of ``documents`` as a TIFF page, read it back and digest it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    stored = tiff_store(sized, keep=["doc_id", "n_bytes"])
    pages = tiff_pages(stored, keep=["doc_id", "n_bytes", "media"])
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every 400-byte string of ``documents`` that occurs twice or more, wherever it occurs.

    n_repeat_words tells of passages by words, over 50 of them: many of those have under 400 bytes and stay.
    """
    done = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], words=51)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeat_words")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of ``conversations``, each rebuilt on the first turns of its hundred's first."""
    return shared_prefix_trie(table(spark, sf_dir, "conversations"))


def trie_sql() -> str:
    """The same nodes for an SQL engine: prefixes as texts, subtrees by the prefixes of each node's least member."""
    steps = "list_prepend(i, range(8))"
    return f"""
WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce({steps}, lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entry),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT)), lambda a, b: xor(a >> 8, entry[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
b AS (SELECT c.conv_id, 0 AS k, p, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h UNION ALL SELECT conv_id, 1, p, r, x FROM t JOIN c USING (conv_id) WHERE p > h),
s AS (SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY k, p) AS depth FROM b),
m AS (SELECT conv_id, depth, length(x) AS chars, md5(array_to_string(list(length(r) || ':' || r || length(x) || ':' || x) OVER (PARTITION BY conv_id ORDER BY depth), '')) AS node FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max_by(node, depth) AS node FROM m GROUP BY 1),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved FROM m GROUP BY 1, 2),
u AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1),
k AS (SELECT parent AS node, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
z AS (SELECT m.node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves FROM w JOIN m ON m.conv_id = w.conv_id AND m.depth <= w.depth GROUP BY 1),
d AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM e GROUP BY 1)
SELECT w.conv_id, w.depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM w JOIN z USING (node) LEFT JOIN d USING (node) LEFT JOIN u USING (node) LEFT JOIN n AS a ON a.node = u.parent"""


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents`` by the n-grams of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return score_texts(docs, fit_ngrams(docs.where("not held_out")), keep=["doc_id", "held_out"])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every vector of ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(vectors, fit_whitener(vectors), keep=["vec_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_license_scans, op3_quality_rules, op4_mixing, op5_html, op6_minhash, op7_chat_formatting, op8_tiff, op9_repeats, op10_bpe, op11_prefix_trie, op12_lm_scoring, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that have one; the others are held against brute force, round trips or held-out rows in the tests."""
    return {"op2_license_scans": licence_sql(), "op11_prefix_trie": trie_sql()}
