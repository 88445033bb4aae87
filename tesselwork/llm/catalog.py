"""Queries of the training-data operators on the driver tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselwork.llm import chat, html_text, media, pii, quality_model
from tesselwork.llm.mixing import mix_sources
from tesselwork.llm.near_dup import near_duplicates
from tesselwork.llm.packing import pack
from tesselwork.llm.quality_rules import quality_rules
from tesselwork.llm.sharding import shuffle_shards
from tesselwork.sources.tables import table


def op1_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


def op2_hypergeometric_shards(spark: SparkSession, folder: str) -> DataFrame:
    out = shuffle_shards(table(spark, folder, "documents"), shards=40)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def vocabulary() -> str:
    """The public vocabulary file that the contract names; the package that holds it is on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_first_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary(), length=1024)


def op4_layout_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op5_transport_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Each text muxed to a stream, and everything below read back from the stream."""
    out = media.demux(media.mux(table(spark, folder, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "access")


#: Conversation -1 of the contract: control strings inside texts.
INJECTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify(table(spark, folder, "documents"))


def op7_event_sourced_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as a log of streamed and regenerated messages, folded, rendered, and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(INJECTED, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.formatted(chat.log_of_turns(turns)))


def op8_adaptive_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = quality_rules(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_odd_sketch_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=2)


def op10_sainte_lague_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_weak_supervision_pii, op2_hypergeometric_shards, op3_first_fit_packing, op4_layout_text, op5_transport_streams, op6_weak_label_quality, op7_event_sourced_chat, op8_adaptive_quality, op9_odd_sketch_near_dup, op10_sainte_lague_mix)}

_CONTROL = r"<\|[a-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>|\\"
_AROUND = len(chat.BEGIN + chat.BETWEEN + chat.END)

#: Only what SQL can say over whole tables: the others hash, sketch, draw, tokenize or parse.
ORACLES: dict[str, str] = {
    "op7_event_sourced_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES {", ".join(str(r) for r in INJECTED)}),
     a AS (SELECT conv_id, count(*) AS n_turns,
                  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                  sum({_AROUND} + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')))::BIGINT AS formatted_chars
           FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a""",
    "op9_odd_sketch_near_dup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, run FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS run FROM w)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     rare AS (SELECT run, count(*) AS df FROM s GROUP BY run),
     r AS (SELECT s.doc_id, s.run, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, s.run) AS nth FROM s JOIN rare USING (run)),
     prefix AS (SELECT doc_id, run FROM r JOIN n USING (doc_id) WHERE nth <= n - (4 * n + 4) // 5 + 1),
     candidate AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.run = b.run AND a.doc_id < b.doc_id),
     shared AS (SELECT a, b, count(*) AS k FROM candidate JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.run = x.run GROUP BY a, b),
     link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
     e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
     reach AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, root FROM reach JOIN e ON node = e.a),
     c AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id""",
}
