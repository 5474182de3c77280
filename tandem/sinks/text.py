"""Text outputs. Every writer leaves a directory of part files, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.links import link_text
from tandem.functions.text import envelope_body, envelope_prefix, envelope_suffix, split_spaces
from tandem.operators.vocab import encode_lines, encode_rows, vocab_fits
from tandem.session import shuffle_partitions


def write_lines(df: DataFrame, path: str, line: Column, *order_by: str,
                compression: str | None = None) -> None:
    """Write one line per row. Range partitions keep the order across part files."""
    if order_by:
        n = shuffle_partitions(df.sparkSession)
        df = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    writer = df.select(line.alias("value")).write
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """``word id`` per line, in id order."""
    write_lines(vocab, path, F.concat_ws(" ", "word", F.col("id").cast("string")), "id")


def read_vocab(df_lines: DataFrame) -> DataFrame:
    """``word, id`` from vocabulary lines; the id is what follows the last blank."""
    return df_lines.select(
        F.regexp_extract("value", r"^(.*) (\d+)$", 1).alias("word"),
        F.regexp_extract("value", r"^(.*) (\d+)$", 2).cast("long").alias("id"))


def encoded_lines(lines: DataFrame, vocab: DataFrame, line: str = "line",
                  value: str = "value", broadcast_limit: int | None = None) -> DataFrame:
    """``line, encoded``: ids in place of words, the sentence envelope kept as is."""
    text = F.col(value)
    words, pre, post = split_spaces(envelope_body(text)), envelope_prefix(text), envelope_suffix(text)
    frame = lines.select(line, pre.alias("_pre"), post.alias("_post"))
    if vocab_fits(vocab, broadcast_limit):
        ids = encode_lines(lines, words, vocab, line, broadcast_limit)
        joined = frame.join(ids.withColumnRenamed("line", line), line, "left")
    else:  # prefix and suffix go with their line's words; a line without a number has no ids
        rows = encode_rows(lines.withColumnRenamed(line, "line"), words, vocab, pre.alias("_pre"), post.alias("_post"))
        joined = rows.withColumn("ids", F.when(F.col("line").isNotNull(), F.col("ids"))).withColumnRenamed("line", line)
    body = F.coalesce(F.array_join("ids", " "), F.lit(""))
    return joined.select(line, F.concat("_pre", body, F.lit(" "), "_post").alias("encoded"))


def write_encoded(encoded: DataFrame, path: str, line: str = "line",
                  compression: str | None = None) -> None:
    write_lines(encoded, path, F.col("encoded"), line, compression=compression)


def write_encoded_by_file(encoded: DataFrame, path: str, line: str = "line", file: str = "file") -> None:
    """One folder ``file=n`` per file, its lines in order, all by one job."""
    n = shuffle_partitions(encoded.sparkSession)
    (encoded.repartitionByRange(n, file, line).sortWithinPartitions(file, line)
     .select(file, F.col("encoded").alias("value")).write.partitionBy(file).text(path))


def links_as_text(links: DataFrame, strength: str | None = None) -> DataFrame:
    """``sid, links``: the links of a sentence on one line, by target then source.

    A sentence has no more links than position pairs; the row is its own size.
    """
    text = link_text(F.col("e_pos"), F.col("f_pos"), F.col("sure"),
                     None if strength is None else F.col(strength))
    item = F.struct("f_pos", "e_pos", text.alias("text"))
    return links.groupBy("sid").agg(F.array_sort(F.collect_list(item)).alias("_l")).select(
        "sid", F.array_join(F.transform("_l", lambda x: x["text"]), " ").alias("links"))


def write_links(links: DataFrame, path: str, compression: str | None = None) -> None:
    """``sid<TAB>f-e f-e-P …`` per sentence."""
    write_lines(links_as_text(links), path,
                F.concat_ws("\t", F.col("sid").cast("string"), "links"), "sid",
                compression=compression)


def write_gold(links: DataFrame, path: str) -> None:
    """``sid e f S|P``, 1-based, as the gold reader takes it."""
    line = F.concat_ws(
        " ", F.col("sid").cast("string"), (F.col("e_pos") + 1).cast("string"),
        (F.col("f_pos") + 1).cast("string"), F.when(F.col("sure"), "S").otherwise("P"))
    write_lines(links, path, line, "sid", "e_pos", "f_pos")


def write_pipe_bitext(bitext: DataFrame, path: str) -> None:
    """``e e e | f f f`` per pair, in ``sid`` order."""
    side = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ") for c in ("src", "tgt")}
    write_lines(bitext, path, F.concat(side["src"], F.lit(" | "), side["tgt"]), "sid")


def write_paired_bitext(bitext: DataFrame, base: str, src_ext: str, tgt_ext: str,
                        tagged: bool = False, compression: str | None = None) -> None:
    """``base.src_ext`` and ``base.tgt_ext`` with the same lines in the same order."""
    for column, ext in (("src", src_ext), ("tgt", tgt_ext)):
        line = F.array_join(column, " ")
        if tagged:
            line = F.concat(F.lit("<s snum="), F.col("sid").cast("string"), F.lit("> "), line, F.lit(" </s>"))
        write_lines(bitext, f"{base}.{ext}", line, "sid", compression=compression)
