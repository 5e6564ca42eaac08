"""The queries of the operators: thin uses of each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decomposition, embedding_dedup, exact_dedup, language_model, merkle, mixing, near_dedup, packing, quality, suffix_dedup, warc, whitening
from .common import shared_folder, table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Limits of a packed sequence besides its 2048 tokens: documents, and the sum of squared lengths (attention within documents). At these
#: no sequence more is needed than for tokens alone, and all three residuals weigh in the choice of a bin.
PACKING = {"max_docs": 2048, "max_cost": 2048 * 2048}


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their component of near duplicates: 85 of 100 shingles of five words in common."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=(85, 100))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their group of equal texts, of which the largest id stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes that strings of 50 cover which stand in a document of a smaller id."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with how often each is in the mix of their sources."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and one of control strings, dealt as logs, folded, rendered and read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    one = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for t, r in enumerate(("user", "assistant"))]))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), one.alias("x")).select("conv_id", "x.turn", "x.role", "x.text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(chat.table_events(rows)).withColumn("turns", chat.read_back(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "")
    out = out.select("conv", F.size("turns").cast("long").alias("n_turns"), turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select(
        F.col("conv").alias("conv_id"),
        "n_turns",
        F.sha2(F.encode("turns", "UTF-8"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learnt", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as compressed WARC records, equal payloads once, and read back."""
    records = warc.plan_records(table(spark, sf_dir, "pages"))
    manifest = warc.write_archives(records, f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}")
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by an interpolated trigram model of those that aren't held out."""
    out = language_model.score(table(spark, sf_dir, "documents"), train=remainder("doc_id", 10) != 0, order=3)
    return out.withColumn("held_out", remainder("doc_id", 10) == 0)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with their links and component."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), **PACKING)


def remainder(id_col: str, of: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored for quality by a classifier that has learnt from labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=remainder("doc_id", 4) != 2)
    out = quality.score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened coordinates of each vector; an exact deviation beyond a long is an error of the cast."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), scale=1024, offset=100_000).withColumn("deviation", F.col("deviation").cast("long"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of all documents, verified against rows of which one in seven was changed."""
    tampered = F.coalesce(remainder("doc_id", 7) == 0, F.lit(False))
    seen = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], seen=seen)


def op13_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into sequences whose lengths are powers of two."""
    return decomposition.decompose(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_exact_dedup, op3_suffix_dedup, op4_mixing, op5_warc, op6_lm_scoring, op7_embedding_dedup, op8_chat, op9_packing, op10_quality, op11_whitening, op12_merkle, op13_decomposition)}


#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda r, b: list_reduce([xor(r, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"


def _merkle_sql() -> str:
    fields = lambda chars: " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", chars, "text"))
    return f"""
        WITH RECURSIVE d AS (
            SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n, row_number() OVER () AS r
            FROM (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS k, sha256({fields("n_chars")}) AS leaf,
                         CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 7 = 0 THEN sha256({fields("(n_chars + 1)")}) END AS changed FROM documents)),
        node AS (SELECT k, 0 AS lvl, pos, n, leaf AS h FROM d
            UNION ALL SELECT k, any_value(lvl) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY k, pos // 2),
        sub AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
        top AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM sub
            UNION ALL SELECT any_value(lvl) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 2),
        step AS (
            SELECT r, l AS nth, (d.pos >> l) & 1 AS odd, s.h AS sib FROM (SELECT d.*, unnest(range(0, (SELECT max(lvl) FROM node WHERE node.k = d.k)))::INT AS l FROM d) d
                LEFT JOIN node s ON s.k = d.k AND s.lvl = d.l AND s.pos = xor(d.pos >> d.l, 1)
            UNION ALL SELECT r, 1000 + l, (u.pos >> l) & 1, s.h FROM d JOIN (SELECT sub.*, unnest(range(0, (SELECT max(lvl) FROM top)))::INT AS l FROM sub) u ON u.k = d.k
                LEFT JOIN top s ON s.lvl = u.l AND s.pos = xor(u.pos >> u.l, 1)),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY nth) AS go FROM step),
        fold AS (SELECT r, 1 AS go, coalesce(changed, leaf) AS h FROM d
            UNION ALL SELECT f.r, f.go + 1, sha256(CASE WHEN o.sib IS NULL THEN f.h WHEN o.odd = 1 THEN o.sib || f.h ELSE f.h || o.sib END) FROM fold f JOIN ordered o ON o.r = f.r AND o.go = f.go),
        proof AS (SELECT r, string_agg(sib, '' ORDER BY go) AS sibs FROM ordered GROUP BY r),
        root AS (SELECT h AS root FROM top WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(sibs, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
        FROM d JOIN sub USING (k) JOIN (SELECT r, arg_max(h, go) AS h FROM fold GROUP BY r) f USING (r) LEFT JOIN proof USING (r), root"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_merkle": _merkle_sql(),
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op8_chat": r"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                   sum(12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
                       + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11)::BIGINT AS formatted_chars
            FROM c GROUP BY conv_id""",
    }
