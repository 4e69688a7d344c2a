"""The registered queries of this folder, and SQL twins where SQL can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.llm.alignment import Tokenizers, link_counts
from logsluice.llm.common import WORD, let, table, text_or_empty
from logsluice.llm.conversations import VERDICT, repair
from logsluice.llm.kneser_ney import classify
from logsluice.llm.licences import licence_paragraphs
from logsluice.llm.minhash import fingerprint, fingerprints, likeness
from logsluice.llm.mixing import mixing_plan
from logsluice.llm.nearest import nearest
from logsluice.llm.packing import pack
from logsluice.llm.quality_rules import RULES, quality_rules
from logsluice.llm.repeats import repeats
from logsluice.llm.sharding import byte_size, shard_by_bytes
from logsluice.llm.simhash import simhash_groups
from logsluice.llm.sql_twins import CONVERSATIONS, FINGERPRINTS
from logsluice.llm.successors import with_next
from logsluice.llm.token_files import TokenizerFile, read_token_files, write_token_files
from logsluice.session import scratch

Query = Callable[[SparkSession, str], DataFrame]

#: The tokenizer of op1: it folds case and cuts marks off from letters.
WORD_BPE = TokenizerFile(public_tokenizers.path("word_bpe_49k.json"), True, r"[.,;:!?#*$%&|]+")


#: The tokenizers of op12.
BYTES_AND_PIECES = Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(write_token_files(docs, scratch(spark, "tokens"), WORD_BPE))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=("doc_id",))
    return judged.select(
        "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines",
        "quality.n_repeat_words", "quality.base_failed", "quality.kept",
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licence_paragraphs(docs).select("doc_id", "paragraph", "family", "probability", "similarity")
    first = found.groupBy("doc_id").agg(
        F.min_by(F.struct("family", "paragraph", "probability", "similarity"),
                 F.struct(F.col("family") == "unknown", -F.col("similarity"), F.col("paragraph"))).alias("best"),
        F.array_sort(F.collect_set("family")).alias("families"), F.count("*").alias("n_paragraphs"),
    )
    return docs.select("doc_id").join(first, "doc_id", "left").select(
        "doc_id", "best.*", F.array_join("families", ",").alias("families"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs")
    )


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component.doc_id").alias("component_id"),
    )


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors)


def op7_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", byte_size().alias("size"), F.crc32(text_or_empty("text")).alias("text_crc32")
    )
    return shard_by_bytes(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing_plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return classify(table(spark, sf_dir, "documents"), trusted)


def op10_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))

    def compared(own: Column, after: Column) -> Column:
        n = F.char_length(own["text"])
        end = F.shiftright(n, 2)
        edited = F.concat(F.substring(own["text"], F.lit(1), n - end), F.substring(after["text"], F.lit(1), end))

        def of_edited(text: Column) -> Column:
            return let(fingerprint(text), lambda other: F.struct(
                n.cast("long").alias("n_chars"), F.sha2(text, 256).alias("edited_sha256"),
                F.lower(F.hex(own["fingerprint"])).alias("fingerprint"), F.lower(F.hex(other)).alias("edited_fingerprint"),
                likeness(own["fingerprint"], other).alias("near_edited"),
                likeness(own["fingerprint"], after["fingerprint"]).alias("near_next"),
            ))

        return let(edited, of_edited)

    return with_next(fingerprints(docs), F.struct("text", "fingerprint"), compared)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"n_a": "a_ids", "n_b": "b_ids", "n_groups": "a_ends", "n_links": "link_a"}

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in batch.column("groups").to_pylist()]
        for name, of in names.items():
            batch = batch.append_column(name, pc.list_value_length(batch.column(of)).cast(pa.int64()))
        return batch.append_column("groups_sha256", pa.array(sums, pa.string()))

    added = ", ".join([*[f"{name} long" for name in names], "groups_sha256 string"])
    return link_counts(table(spark, sf_dir, "documents"), BYTES_AND_PIECES, also=digests, added=added)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with known faults, as a number hashed from conversation and turn says; ``times`` 0 for a row dropped, 2 for one repeated."""

    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text = F.when(case == 1, F.lit("")).when(case == 2, F.translate(or_space("text"), ".!?", "")).otherwise(or_space("text"))
    return conversations.select(
        "conv_id", "turn", F.when(case == 4, F.lit("user")).otherwise(or_space("role")).alias("role"), text.alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("times"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair(damaged(table(spark, sf_dir, "conversations")), times="times")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each conversation; its lines are hashed as they come."""
        sha, first = hashlib.sha256(), True
        for batch in batches:
            ended, sums = [], []
            for n, (role, text, edit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("role", "text", "edit")))):
                if edit is None:
                    ended.append(n)
                    sums.append(sha.hexdigest())
                    sha, first = hashlib.sha256(), True
                else:
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            if ended:
                done = batch.select(["conv", "verdict"]).take(pa.array(ended))
                yield pa.RecordBatch.from_arrays([*done.columns, pa.array(sums)], names=["conv", "verdict", "repaired_sha256"])

    schema = f"conv long, verdict {VERDICT.simpleString()}, repaired_sha256 string"
    return repaired.mapInArrow(digests, schema).select(F.col("conv").alias("conv_id"), "verdict.*", "repaired_sha256")


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_quality_rules": op2_quality_rules,
    "op3_licences": op3_licences,
    "op4_pack": op4_pack,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_nearest": op6_nearest,
    "op7_shard_by_bytes": op7_shard_by_bytes,
    "op8_mix_sources": op8_mix_sources,
    "op9_perplexity": op9_perplexity,
    "op10_without_repeats": op10_without_repeats,
    "op11_fingerprints": op11_fingerprints,
    "op12_alignment": op12_alignment,
    "op13_repair": op13_repair,
}

_QUANTILES = {"q10": 10, "q50": 50, "q90": 90}
_SKETCHED = ", ".join(f"min(b) FILTER (100 * upto >= {n} * total) AS {name}" for name, n in _QUANTILES.items())

ORACLES = {
    "op11_fingerprints": FINGERPRINTS,
    "op13_repair": CONVERSATIONS,
    "op2_quality_rules": f"""
        WITH base AS (
          SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
          FROM documents),
        windows AS (
          SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM (
            SELECT doc_id, list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' ')) AS g
            FROM base WHERE len(w) >= 8)),
        repeated AS (SELECT doc_id, unnest(places) AS i FROM (
          SELECT doc_id, list(i) AS places FROM windows GROUP BY doc_id, g HAVING count(*) > 1)),
        covered AS (
          SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY doc_id),
        counted AS (
          SELECT *, list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
        figures AS (
          SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
            CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
            CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutters,
            CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
          FROM counted LEFT JOIN covered USING (doc_id)),
        failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures),
        valued AS (
          SELECT doc_id, lang, source, base_failed, unnest([
            {{f: 'symbols', v: n_symbols * 10000 // greatest(word_chars, 1)}},
            {{f: 'dup_lines', v: n_dup_lines * 10000 // greatest(n_lines, 1)}},
            {{f: 'repeats', v: n_repeat_words * 10000 // greatest(n_words, 1)}},
            {{f: 'stutter', v: n_stutters * 10000 // greatest(n_words, 1)}},
            {{f: 'word_length', v: word_chars * 1000 // greatest(n_words, 1)}}], recursive := true)
          FROM failed),
        sketch AS (
          SELECT lang, source, f, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS b, count(*) AS n
          FROM valued WHERE NOT base_failed GROUP BY ALL),
        own AS (
          SELECT lang, source, f, {_SKETCHED}, max(total) AS n
          FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, f ORDER BY b) AS upto,
            sum(n) OVER (PARTITION BY lang, source, f) AS total FROM sketch) GROUP BY ALL),
        by_lang AS (
          SELECT lang, f, {_SKETCHED}, max(total) AS n
          FROM (SELECT *, sum(n) OVER (PARTITION BY lang, f ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, f) AS total
            FROM (SELECT lang, f, b, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL),
        by_all AS (
          SELECT f, {_SKETCHED}
          FROM (SELECT *, sum(n) OVER (PARTITION BY f ORDER BY b) AS upto, sum(n) OVER (PARTITION BY f) AS total
            FROM (SELECT f, b, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL),
        rules(f, spread, least, low) AS (
          VALUES {", ".join(f"('{r.figure}', {r.spread}, {r.least}, {r.low})" for r in RULES)}),
        chosen AS (
          SELECT o.lang, o.source, o.f,
            {", ".join(f"CASE WHEN o.n >= 200 THEN o.{q} WHEN l.n >= 200 THEN l.{q} ELSE a.{q} END AS {q}" for q in _QUANTILES)}
          FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.f = l.f JOIN by_all a ON o.f = a.f),
        limits AS (
          SELECT lang, source, f, CASE WHEN low THEN q10 - spread * greatest(q50 - q10, least) ELSE -1 END AS lowest,
            q90 + spread * greatest(q90 - q50, least) AS highest
          FROM chosen JOIN rules USING (f)),
        outside AS (
          SELECT v.doc_id, bool_or(v.v < m.lowest OR v.v > m.highest) AS out
          FROM valued v JOIN limits m ON v.lang IS NOT DISTINCT FROM m.lang AND v.source IS NOT DISTINCT FROM m.source AND v.f = m.f
          GROUP BY v.doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND NOT coalesce(out, false) AS kept
        FROM failed LEFT JOIN outside USING (doc_id)""",
    # The polynomial is CRC-32's; its table of remainders comes from the rule, the digits of the bytes from the text.
    "op7_shard_by_bytes": """
        WITH steps AS (
          SELECT list(crc ORDER BY b) AS crcs FROM (
            SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k:
              CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc
            FROM (SELECT unnest(range(256)) AS b))),
        sized AS (
          SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
            list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
              lambda h: CAST('0x' || h AS BIGINT)) AS bytes
          FROM documents),
        hashed AS (
          SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b:
            xor(c // 256, crcs[xor(c % 256, b) + 1]))) AS text_crc32
          FROM sized, steps),
        summed AS (
          SELECT *, CAST(sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before,
            CAST(sum(size) OVER () AS BIGINT) AS total
          FROM hashed),
        cut AS (
          SELECT *, CAST(least(15, (16 * (2 * before + size)) // (2 * total)) AS INTEGER) AS shard FROM summed)
        SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
          row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM cut""",
    "op6_nearest": """
        WITH v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
          FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op8_mix_sources": f"""
        WITH sized AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size
          FROM documents),
        sources AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
            CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
          FROM sized GROUP BY source),
        limits AS (
          SELECT *, source_size * 3.0::DOUBLE AS lim, source_size * 3.0::DOUBLE / weight AS ratio,
            row_number() OVER (ORDER BY source NULLS LAST) AS pos,
            CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights
          FROM sources),
        levels AS (
          SELECT *, (total - coalesce(sum(lim) OVER earlier, 0)) / (weights - coalesce(sum(weight) OVER earlier, 0)) AS level
          FROM limits
          WINDOW earlier AS (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        flat AS (
          SELECT arg_min(level, (ratio, pos)) AS common FROM levels WHERE weight * level < lim),
        targets AS (
          SELECT source, source_size,
            CASE WHEN weight * level >= lim THEN lim ELSE weight * common END AS target
          FROM levels, flat),
        rated AS (
          SELECT doc_id, size, source_size, target,
            CASE WHEN source_size > 0 THEN target / source_size ELSE 1 END AS rate,
            CAST('0x' || substr(md5('mix-0-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT)
              / 281474976710656.0::DOUBLE AS unit
          FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
        SELECT doc_id, size, source_size, target,
          size * CAST(floor(rate) + CASE WHEN unit < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
        FROM rated""",
}
