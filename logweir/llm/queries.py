"""The registered queries: each operator on its whole table, with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats, read_chats
from .fill_in_middle import fill_in_middle, restored
from .language import identify_language
from .line_dedup import dedup_lines
from .mixing import mix
from .ngram_score import score_texts
from .periodic_runs import periodic_runs
from .pieces import decode, encode, load_pieces
from .pseudonyms import pseudonymise
from .quality import judge_quality
from .shingle_join import near_duplicates
from .text import let, table, words_of
from .token_counts import count_tokens
from .vector_search import nearest


def remainder(divisor: int):
    """The checksum of the document's id, as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), key="a key of this corpus")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = identify_language(table(spark, sf_dir, "documents"), learn_from=remainder(4) != 2)
    return told.select("doc_id", (~F.col("learned")).alias("held_out"), "lang_pred", "score")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    coded = encode(table(spark, sf_dir, "documents"), pieces)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.sha2(F.coalesce(written, F.lit("")), 256).alias("ids_sha256"),
        decode(F.col("ids"), pieces).eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op10_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), learn_from=remainder(5) != 1)
    return scored.withColumn("held_out", ~F.col("learned")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: A conversation whose texts are the template's own control strings.
TRAP = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], turns.schema)
    chats = read_chats(format_chats(turns.unionByName(trap), public_tokenizers.path("byte_bpe_50k.json")))
    written = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = F.array_join("trained", "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(written, ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("formatted", 256).alias("output_sha256"),
        F.sha2(restored(F.col("formatted"), F.col("form")), 256).alias("restored_sha256"),
    )


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the words of each tenth text, by the checksum of its id, made periodic."""
    h, w = F.crc32(F.col("doc_id").cast("string")), F.col("words")
    n = F.size(w)

    def planted(a):
        period = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % period).cast("int"))))

    rows = docs.select("doc_id", "text", (h % 10).alias("rest"), F.floor(h / 10).alias("g"), words_of(F.col("text")).alias("words"))
    text = F.when((F.col("rest") == 0) & (n > 0), F.array_join(let(F.col("g") % n, planted), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))
    rank = lambda r: F.struct(-r["length"], r["start"], r["period"], r.alias("run"))
    longest = F.array_min(F.transform("runs", rank))["run"]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("longest")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    name: query for name, query in globals().items() if name.startswith("op") and name[2].isdigit()
}
