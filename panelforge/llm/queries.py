"""The contract queries of this package: op<N>_<name>, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, langid, packing, quotes, simhash, sstable, subspace, warc
from panelforge.llm.automaton import dedup_words
from panelforge.llm.suffix_array import dedup_bytes
from panelforge.session import ship


BYTE_BPE = "byte_bpe_50k.json"


def vocabulary(name: str = BYTE_BPE) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.store(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return sstable.checksums(manifest)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.read_chunks(warc.store(table(spark, sf_dir, "pages"))))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "reply_to", "root_turn", "depth", "n_quotes", F.sha2("own_text", 256).alias("own_sha256"))


def op8_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_duplicates(table(spark, sf_dir, "embeddings"))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs.where(~held_out("doc_id"))))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array,
        op2_sstable,
        op3_decontamination,
        op4_warc,
        op5_simhash,
        op6_packing,
        op7_quotations,
        op8_subspace,
        op9_language,
        op10_suffix_automaton,
    )
}
#: The rest is not SQL: byte windows, vocabularies, XXH64, compression, edit distance, packing (tests/llm has brute force).
ORACLE: dict[str, str] = {
    "op4_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM q""",
    "op8_subspace": """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9), reach AS (SELECT i, j FROM l UNION SELECT r.i, l.j FROM reach r JOIN l ON r.j = l.i),
 n AS (SELECT i, count(*) AS n FROM l GROUP BY i), c AS (SELECT i, min(j) AS c FROM reach GROUP BY i)
 SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept FROM v LEFT JOIN n ON vec_id = n.i LEFT JOIN c ON vec_id = c.i""",
    "op10_suffix_automaton": r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 x AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) t(i)), c AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1), hit AS (SELECT r, i FROM x SEMI JOIN c USING (k)),
 gone AS (SELECT DISTINCT r, i + o AS p FROM hit, range(0, 35) t(o)), words AS (SELECT r, p, w[p] AS t FROM d, unnest(range(1, len(w) + 1)) t(p)), kept AS (SELECT r, string_agg(t, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
}
