"""The queries of this subpackage by name, over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.llm import (
    bm25,
    bpe,
    decontaminate,
    fill_in_middle,
    gap_packing,
    html_text,
    language,
    packing,
    quotes,
    sharding,
    simhash_dedup,
    sketch_search,
    token_counts,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id_remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def toxicity_may_learn() -> Column:
    """Which documents' toxicity labels may be seen: the other third is held out."""
    return _id_remainder(3) != 1


def language_may_learn() -> Column:
    """Which documents' languages may be seen: the other fifth is held out."""
    return _id_remainder(5) != 0


def byte_bpe() -> tuple[str, str]:
    """Ranks and splitting pattern of the vocabulary that documents are encoded with."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def byte_bpe_added() -> dict[str, int]:
    import public_tokenizers as public

    return bpe.added_tokens(public.path("byte_bpe_50k.json"))


@query
def op1_packing(spark, sf):
    """Pieces of documents in windows of 2,048 tokens."""
    return packing.pack(table(spark, sf, "documents"), *byte_bpe(), added=byte_bpe_added())


@query
def op2_toxicity(spark, sf):
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs.where(toxicity_may_learn()), table(spark, sf, "labels"))
    scored = toxicity.add_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (~toxicity_may_learn()).alias("held_out"), "score", "predicted")


@query
def op3_html_extraction(spark, sf):
    """Main text of every page."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html_text.add_main_text(pages, html_text.fit(pages))


@query
def op4_quotation_linking(spark, sf):
    """Every message without quotations, in the order of its conversation's replies."""
    return quotes.whole_reply_order(table(spark, sf, "conversations"))


@query
def op5_language_id(spark, sf):
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf, "documents")
    profiles = language.learn(docs, language_may_learn())
    found = language.add_language(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (~language_may_learn()).alias("held_out"), "lang_pred", "score")


@query
def op6_hilbert_sharding(spark, sf):
    """Documents in 40 runs of equal bytes along a Hilbert curve through language, source and size."""
    placed = sharding.hilbert_shards(table(spark, sf, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query
def op7_benchmark_decontamination(spark, sf):
    """Benchmark items that windows of a document repeat."""
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_bm25_top_k(spark, sf):
    """The ten best documents for every fiftieth document's whole text."""
    return bm25.top_k(table(spark, sf, "documents"), F.col("doc_id") % 50 == 0)


@query
def op9_simhash_near_dedup(spark, sf):
    """Groups of documents whose fingerprints of three-word shingles differ in at most three bits."""
    return simhash_dedup.simhash_groups(table(spark, sf, "documents"))


@query
def op10_token_counts(spark, sf):
    """Tokens of every line of every document."""
    import public_tokenizers as public

    return token_counts.section_tokens(table(spark, sf, "documents"), public.path("byte_bpe_50k.json"))


@query
def op11_ranked_search(spark, sf):
    """The twenty best documents for every benchmark item."""
    return sketch_search.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op12_fill_in_middle(spark, sf):
    """Every document cut into lines and rearranged, and the text that is got back from the result."""
    made = fill_in_middle.fill_in_middle(table(spark, sf, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


@query
def op13_best_fit_packing(spark, sf):
    """Whole documents in as few windows of 2,048 tokens as possible."""
    return gap_packing.pack_whole(table(spark, sf, "documents"), *byte_bpe(), byte_bpe_added())


ORACLES["op11_ranked_search"] = r"""
WITH words AS (
    SELECT row_number() OVER () AS doc, doc_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
),
postings AS (SELECT doc, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc, count(*) AS n FROM words GROUP BY doc),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
factors AS (SELECT doc, 100 - 25 + (25 * n * docs) // terms AS m FROM lengths, corpus),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM postings, corpus GROUP BY term, docs
),
asked AS (
    SELECT item_id, term, count(*) AS repeats
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM (SELECT DISTINCT item_id, text FROM benchmark))
    GROUP BY ALL
),
scores AS (
    SELECT item_id, doc, doc_id,
           sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN factors USING (doc)
    GROUP BY ALL
),
ranks AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks WHERE rank <= 20
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
),
units AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^
]*
|[^
]+') AS u,
           ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
           ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4
    FROM docs
),
cuts AS (
    SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM units
),
parts AS (
    SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS prefix, coalesce(array_to_string(u[low + 1:high], ''), '') AS middle,
           coalesce(array_to_string(u[high + 1:], ''), '') AS suffix
    FROM cuts
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
