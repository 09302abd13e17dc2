"""The queries of the text operators and their SQL, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import lm_scoring, quality, toxicity
from vigilframe.llm.common import held_out, materialize, shared_dir, table, word_count
from vigilframe.llm.embedding_dedup import near_vectors
from vigilframe.llm.exact_dedup import content_sort_dedup
from vigilframe.llm.filter_audit import audit_documents
from vigilframe.llm.line_dedup import line_dedup, passages_of
from vigilframe.llm.mixing import mix_sources
from vigilframe.llm.packing import pack_documents
from vigilframe.llm.simhash import simhash_groups
from vigilframe.llm.suffix_dedup import repeated_strings
from vigilframe.llm.token_alignment import align_tokenizers
from vigilframe.llm.token_rollup import TokenRollup, counted, deletes, inserts, revisions, token_count


def _rolled_up(spark: SparkSession, sf_dir: str, counters: dict) -> DataFrame:
    """Totals after several commits and folds.

    Documents come in with counts estimated from n_chars and are revised to exact counts; the
    revision is committed twice, which changes nothing. Those without a word are deleted and,
    after the totals were folded, inserted again.
    """
    docs = table(spark, sf_dir, "documents")
    guess = F.ceil(F.coalesce("n_chars", F.lit(0)) / 6).cast("long")
    exact = F.struct(*[c.alias("_".join(v)) for v, c in counters.items()])
    rows = materialize(docs.select("source", "lang", guess.alias("guess"), exact.alias("n"), (word_count(F.col("text")) == 0).alias("blank")), "rollup-counts")
    exactly = {v: F.col("n")["_".join(v)] for v in counters}
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/vigilframe/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", inserts(counted(rows, {v: F.col("guess") for v in counters})))
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.lit(v).alias("version"), F.col("guess").alias("old_tokens"), n.alias("new_tokens")) for (t, v), n in exactly.items()]))
    change = revisions(rows.select("source", "lang", pairs.alias("x")).select("source", "lang", "x.*"))
    rollup.commit("exact", change)
    rollup.commit("exact", change)
    blank = counted(rows.where("blank"), exactly)
    rollup.commit("blank out", deletes(blank))
    rollup.fold()
    rollup.commit("blank in", inserts(blank))
    return rollup.totals()


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a public tokenizer, and words, by source, language and tokenizer version."""
    return _rolled_up(spark, sf_dir, {("byte_bpe", "50k"): token_count(F.col("text"), tokenizer_path()), ("words", "1"): word_count(F.col("text"))})


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup over counts that SQL can take: words, and runs of letters."""
    letters = F.coalesce(F.regexp_count("text", F.lit("[A-Za-z]+")), F.lit(0)).cast("long")
    return _rolled_up(spark, sf_dir, {("words", "1"): word_count(F.col("text")), ("letters", "1"): letters})


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources take weights 3, 1, 2 in turn and share 150 % of all words, each at most twice its own."""
    return mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).drop("row_hash")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts equal but for the case of A-Z; the largest doc_id stays."""
    return content_sort_dedup(table(spark, sf_dir, "documents"), keep="max")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without passages of two or more lines, or one long line, that an earlier document or passage has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_lines=1, detail_col="found", pieces=passages_of).select("doc_id", F.col("found.lines").alias("n_lines"), "found.removed_lines", "found.removed_chunks", "text")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, whatever their label, at a cosine of 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def _may_learn(doc_id: Column) -> Column:
    return ~held_out(doc_id, 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that labels.quality is 1; predicted at 0.3."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(spark, docs, table(spark, sf_dir, "labels"), learn_from=_may_learn)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that labels.toxic is 1; predicted at 0.5."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"), learn_from=_may_learn)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1024 ids; each document ends with id 0."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), window=1024, end_id=0, emit={"ids_crc32": F.crc32("ids")})


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32 modulo 5 is not 1 and scores all."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 1)
    return lm_scoring.score(docs, lm_scoring.fit(spark, docs.where(~out)), held_out=out)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles; fingerprints link at three or fewer differing bits."""
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3, budget=3)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of 400 bytes that occur elsewhere too go."""
    found = repeated_strings(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte-level tokenizer with 50,257 ids against one of 32,000 pieces."""
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, by source."""
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_rollup": op1_token_rollup,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_pack_documents": op8_pack_documents,
    "op9_lm_scores": op9_lm_scores,
    "op10_simhash": op10_simhash,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_filter_audit": op13_filter_audit,
    "token_rollup_words": token_rollup_words,
}

LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))"

#: Failures of A to D as a number whose bits are A = 1, B = 2, C = 4, D = 8.
TEXT_MASK = """(len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT"""

ORACLES = {
    "op13_filter_audit": f"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
        m AS (SELECT doc_id, part, {TEXT_MASK} + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        h AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT v.name || w.name || x.name || y.name || z.name AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
              FROM f v JOIN f w ON w.bit <> v.bit JOIN f x ON x.bit NOT IN (v.bit, w.bit) JOIN f y ON y.bit NOT IN (v.bit, w.bit, x.bit) JOIN f z ON z.bit NOT IN (v.bit, w.bit, x.bit, y.bit)),
        s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS earlier FROM o, range(1, 6) r(step)),
        r AS (SELECT part, filter_order, step, bit,
                     sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM h, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM r
    """,
    "token_rollup_words": f"""
        WITH d AS (SELECT source, lang, {WORDS} AS w1, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS w2 FROM documents),
        v AS (SELECT source, lang, 'words' AS tokenizer, w1 AS tokens FROM d UNION ALL SELECT source, lang, 'letters', w2 FROM d)
        SELECT source, lang, tokenizer, '1' AS version, count(*) AS documents, sum(tokens)::BIGINT AS tokens
        FROM v GROUP BY ALL
    """,
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER_AZ} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g ON d.norm = g.norm
    """,
}
