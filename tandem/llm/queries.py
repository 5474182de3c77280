"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import (
    bpe, brown, exact, fingerprints, idfiles, packing, quality, search, sharding, simhash, suffixes,
    toxicity, variants)
from tandem.llm.common import ID, read_table
from tandem.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors unless they find it as the driver does."""
    root = Path(__file__).resolve().parents[2]
    seen = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if "site-packages" in root.parts or str(root) in map(os.path.realpath, seen):
        return
    context = spark.sparkContext
    if not getattr(context, "_tandem_shipped", False):
        package = Path(tempfile.mkdtemp(prefix="tandem-package-")) / "tandem.zip"  # read by the driver only
        with zipfile.ZipFile(package, "w") as archive:
            for file in sorted((root / "tandem").rglob("*.py")):
                archive.write(file, file.relative_to(root))
        context.addPyFile(str(package))
        context._tandem_shipped = True


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark, sf_dir):
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select(ID, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "sequence_tokens", "sequence_cost")


@query
def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    coded = bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(coded, ranks).select(
        ID, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_id_files(spark, sf_dir):
    path = scratch_path(spark, "ids")
    shards = idfiles.write(read_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return idfiles.read(spark, path, shards).select(
        ID, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_weighted_fingerprints(spark, sf_dir):
    return fingerprints.edited(read_table(spark, sf_dir, "documents"))


@query
def op5_quality(spark, sf_dir):
    return quality.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op6_simhash(spark, sf_dir):
    return simhash.components(read_table(spark, sf_dir, "documents")).select(
        ID, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_kd_shards(spark, sf_dir):
    return sharding.shard(read_table(spark, sf_dir, "documents"), 40).select(
        ID, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_brown_classes(spark, sf_dir):
    return brown.scores(read_table(spark, sf_dir, "documents"))


@query
def op9_exact_dedup(spark, sf_dir):
    return exact.mark(read_table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark, sf_dir):
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op11_spelling_variants(spark, sf_dir):
    return variants.group(read_table(spark, sf_dir, "documents"))


@query
def op12_lexical_search(spark, sf_dir):
    return search.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op13_suffix_dedup(spark, sf_dir):
    cut = suffixes.dedup(read_table(spark, sf_dir, "documents"))
    return cut.select(
        ID, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


_TERMS = """regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

ORACLES: dict[str, str] = {
    "op12_lexical_search": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS terms FROM documents),
        whole AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
        tf AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (
            SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, n, term),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM tf, whole GROUP BY term, docs),
        asked AS (SELECT DISTINCT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM benchmark),
        scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (
                1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length)))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tf USING (term), whole GROUP BY item_id, doc_id)
        SELECT item_id, rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
            FROM scores WHERE score > 0) WHERE rank <= 10""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
