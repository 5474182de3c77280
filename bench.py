"""Headline timings: one JSON line. BENCH_SF_DIR, BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tandem.operators.decode import align  # noqa: E402
from tandem.operators.em import train  # noqa: E402
from tandem.operators.evaluate import evaluate  # noqa: E402
from tandem.operators.pairs import cooccurrence  # noqa: E402
from tandem.operators.vocab import bitext_lines, encode_bitext, first_seen_vocab  # noqa: E402
from tandem.plans.encode import corpus_growth, corpus_words, encode_corpus  # noqa: E402
from tandem.session import build_session, cut_lineage  # noqa: E402
from tandem.sources.tables import (  # noqa: E402
    document_lines, held_out_bitext, look_alike_gold, training_bitext)

ROUNDS = 20


def consume(df):
    """Run the whole plan without gathering its rows."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("tandem-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, fn):
        start = time.time()
        result = fn()
        times[name] = round(time.time() - start, 3)
        return result

    lines = document_lines(spark, sf_dir)
    consume(lines)  # start-up cost of the session
    timed("vocab_first_seen", lambda: consume(first_seen_vocab(lines, corpus_words())))
    timed("vocab_growth", lambda: consume(corpus_growth(lines)))
    timed("encode_corpus", lambda: consume(encode_corpus(lines)[1]))

    words, held = training_bitext(spark, sf_dir), held_out_bitext(spark, sf_dir)
    both = words.unionByName(held.withColumn("sid", F.col("sid") + F.lit(1 << 61)))
    vocab = cut_lineage(first_seen_vocab(bitext_lines(both), F.col("words")))
    bitext = timed("encode_bitext", lambda: cut_lineage(encode_bitext(words, vocab)))
    test = cut_lineage(encode_bitext(held, vocab))
    timed("cooccurrence", lambda: consume(cooccurrence(bitext)))
    model = timed(f"em_{ROUNDS}_shuffle", lambda: train(bitext, ROUNDS, "shuffle"))
    links = timed("align", lambda: align(test, model))
    gold = cut_lineage(look_alike_gold(held))
    timed("evaluate", lambda: evaluate(links, gold, test).collect())

    print(json.dumps({
        "metric": "parallel text: encode, train, align, score", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "rounds": ROUNDS, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
