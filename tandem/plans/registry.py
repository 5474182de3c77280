"""Queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.constants import EM_ROUNDS, SRC_EXT, TGT_EXT
from tandem.functions.links import link_state, link_text
from tandem.functions.model import position_prior
from tandem.functions.text import (
    envelope_body,
    envelope_prefix,
    envelope_suffix,
    map_tokens,
    sgml_id,
    sgml_words,
    split_single_whitespace,
    split_spaces,
    split_whitespace,
)
from tandem.operators import counts as C
from tandem.operators import evaluate as V
from tandem.operators import links as L
from tandem.operators import order as O
from tandem.operators import sets as S
from tandem.operators.decode import align
from tandem.operators.display import format_pair as display_pair
from tandem.operators.em import posterior, train
from tandem.operators.em import top_translations as most_likely
from tandem.operators.pairs import append_null, cooccurrence
from tandem.operators.render import position_grid, render_alignment
from tandem.operators.vocab import bitext_lines, encode_bitext, first_seen_vocab
from tandem.plans.encode import corpus_growth, corpus_words, encode_corpus, encode_files
from tandem.plans.job import align_and_score, run
from tandem.session import cut_lineage, scratch_path
from tandem.sinks import text as K
from tandem.sources import bitext as B
from tandem.sources import lines as N
from tandem.sources.folders import SourceFrames, source_health
from tandem.sources.gold import read_gold_links
from tandem.sources.tables import (
    document_lines,
    held_out_bitext,
    look_alike_gold,
    table,
    training_bitext,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Reports of fixed size, as the operators offer them.
FIRST_LINES = 3
SKIPPED, TAKEN = 40, 60
SHARDS = 8
# Decimals at which logarithms of probabilities are compared, so that ties are ties everywhere.
DIGITS = 6


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(column)


def _log_p() -> Column:
    """A model's cells span many orders of magnitude, so they are compared by logarithm."""
    return F.when(F.col("p") > 0, F.round(F.log("p"), DIGITS)).alias("log_p")


def _r6(column: str) -> Column:
    return F.round(column, 6).alias(column)


def _vocab(bitext: DataFrame) -> DataFrame:
    return first_seen_vocab(bitext_lines(bitext), F.col("words"))


def _encoded(bitext: DataFrame) -> DataFrame:
    return encode_bitext(bitext, _vocab(bitext))


def _last_name(column: str) -> Column:
    return F.regexp_extract(column, r"([^/]*)$", 1)


# --- sources and sinks ------------------------------------------------------

@query
def text_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    K.write_lines(document_lines(spark, sf_dir), path, F.col("value"), "line")
    return N.text_lines(spark, path).select("line_no", "value")


@query
def gzip_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "lines_gz")
    K.write_lines(document_lines(spark, sf_dir), path, F.col("value"), "line", compression="gzip")
    return N.text_lines(spark, path).select("line_no", F.length("value").alias("n_chars"))


@query
def pipe_bitext(spark, sf_dir):
    path = scratch_path(spark, "pipe")
    K.write_pipe_bitext(_encoded(training_bitext(spark, sf_dir)), path)
    return B.read_pipe_bitext(spark, path).select("sid", _joined("src"), _joined("tgt"))


def _write_two_bases(spark, sf_dir, root, tagged=False):
    for name, bitext in (("one", training_bitext(spark, sf_dir)), ("two", held_out_bitext(spark, sf_dir))):
        K.write_paired_bitext(bitext, f"{root}/{name}", SRC_EXT, TGT_EXT, tagged)


@query
def paired_bitext(spark, sf_dir):
    root = scratch_path(spark, "paired")
    _write_two_bases(spark, sf_dir, root)
    return B.read_paired_bitext(spark, root).select(
        "sid", _last_name("source_file").alias("base"), "line_no", _joined("src"), _joined("tgt"))


@query
def bitext_files(spark, sf_dir):
    root = scratch_path(spark, "named")
    _write_two_bases(spark, sf_dir, root, tagged=True)
    return B.read_bitext_files(spark, f"{root}/two.{SRC_EXT}", f"{root}/two.{TGT_EXT}").select(
        "sid", "line_no", _joined("src"), _joined("tgt"))


@query
def multi_source(spark, sf_dir):
    first, second = scratch_path(spark, "source"), scratch_path(spark, "source")
    K.write_paired_bitext(held_out_bitext(spark, sf_dir), f"{first}/x", SRC_EXT, TGT_EXT, compression="gzip")
    K.write_paired_bitext(training_bitext(spark, sf_dir), f"{second}/a", SRC_EXT, TGT_EXT)
    return B.read_paired_bitext(spark, [first, second], offset=SKIPPED).select(
        "sid", "source_idx", "line_no", F.size("src").alias("n_src"), F.size("tgt").alias("n_tgt"))


@query
def one_source_of_three(spark, sf_dir):
    """The second source's only base; the files of the others are not opened."""
    roots = [scratch_path(spark, f"source{n}") for n in range(3)]
    for root, make in zip(roots, (training_bitext, held_out_bitext, training_bitext)):
        K.write_paired_bitext(make(spark, sf_dir), f"{root}/talk", SRC_EXT, TGT_EXT, tagged=True)
    return SourceFrames(spark, roots)[1, "talk"].select("sid", "line_no", _joined("src"), _joined("tgt"))


@query
def source_states(spark, sf_dir):
    """Pairs, a file without partner, a pair of empty files, a folder that is not there."""
    roots = [scratch_path(spark, f"state{n}") for n in range(3)]
    held, trained = held_out_bitext(spark, sf_dir), training_bitext(spark, sf_dir)
    K.write_paired_bitext(held, f"{roots[0]}/full", SRC_EXT, TGT_EXT)
    K.write_lines(trained, f"{roots[0]}/lone.{SRC_EXT}", F.array_join("src", " "), "sid")
    K.write_paired_bitext(trained.filter("sid < 0"), f"{roots[1]}/hollow", SRC_EXT, TGT_EXT)
    return source_health(spark, roots)


@query
def gold_links(spark, sf_dir):
    path = scratch_path(spark, "gold")
    K.write_gold(look_alike_gold(held_out_bitext(spark, sf_dir)), path)
    return read_gold_links(spark, path)


@query
def vocab_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "vocab")
    K.write_vocab(first_seen_vocab(document_lines(spark, sf_dir), corpus_words()), path)
    return K.read_vocab(spark.read.text(path))


@query
def encoded_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "encoded")
    _, encoded = encode_corpus(document_lines(spark, sf_dir))
    K.write_encoded(encoded, path, compression="gzip")
    return N.text_lines(spark, path).select("line_no", "value")


@query
def link_lines(spark, sf_dir):
    path = scratch_path(spark, "links")
    K.write_links(look_alike_gold(held_out_bitext(spark, sf_dir)), path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.get(parts, 0).cast("long").alias("sid"), F.get(parts, 1).alias("links"))


# --- projections and checks -------------------------------------------------

@query
def sgml_parse(spark, sf_dir):
    value = F.col("value")
    return document_lines(spark, sf_dir).select(
        "line", sgml_id(value).alias("sid"), F.array_join(sgml_words(value), " ").alias("words"))


@query
def sgml_envelope(spark, sf_dir):
    value = F.col("value")
    return document_lines(spark, sf_dir).select(
        "line", envelope_prefix(value).alias("prefix"),
        F.length(envelope_body(value)).alias("n_body"), envelope_suffix(value).alias("suffix"))


@query
def tokenizers(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(split_spaces(text)).alias("n_blank"),
        F.size(split_single_whitespace(text)).alias("n_single"),
        F.size(split_whitespace(text)).alias("n_runs"))


@query
def synthetic_ids(spark, sf_dir):
    root = scratch_path(spark, "half_tagged")
    bitext = training_bitext(spark, sf_dir)
    tag = F.when(F.size("tgt") > 150, F.concat(F.lit("<s snum="), F.col("sid").cast("string"), F.lit("> "))).otherwise("")
    for column, ext in (("src", SRC_EXT), ("tgt", TGT_EXT)):
        K.write_lines(bitext, f"{root}/x.{ext}", F.concat(tag, F.array_join(column, " ")), "sid")
    return B.read_paired_bitext(spark, root).select("sid", "line_no")


@query
def id_mismatch(spark, sf_dir):
    root = scratch_path(spark, "mismatch")
    bitext = training_bitext(spark, sf_dir)
    for column, ext, own in (("src", SRC_EXT, F.col("sid")), ("tgt", TGT_EXT, F.col("sid") + F.pmod(F.size("tgt"), F.lit(3)))):
        line = F.concat(F.lit("<s snum="), own.cast("string"), F.lit("> "), F.array_join(column, " "))
        K.write_lines(bitext, f"{root}/x.{ext}", line, "sid")
    parsed = B.parse_pairs(B.paired_lines(
        B.side_lines(spark, root, SRC_EXT), B.side_lines(spark, root, TGT_EXT)))
    return B.id_mismatches(parsed).select("line_no", "src_id", "tgt_id")


@query
def line_count_report(spark, sf_dir):
    root = scratch_path(spark, "lengths")
    talk = table(spark, sf_dir, "conversations").withColumn("line", F.translate("text", "\n\r", "  "))
    for base, roles in (("x", ("user", "assistant")), ("y", ("system", "user")), ("z", ("user", "user"))):
        for role, ext in zip(roles, (SRC_EXT, TGT_EXT)):
            K.write_lines(talk.filter(F.col("role") == role), f"{root}/{base}.{ext}", F.col("line"), "conv_id", "turn")
    report = B.line_count_report(B.side_lines(spark, root, SRC_EXT), B.side_lines(spark, root, TGT_EXT))
    return report.select(_last_name("base").alias("base"), "n_src", "n_tgt", "n_pairs")


@query
def duplicate_ids(spark, sf_dir):
    return B.duplicate_ids(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sid")))


@query
def pair_filter(spark, sf_dir):
    return B.accept_pairs(training_bitext(spark, sf_dir), F.size("tgt") <= 4 * F.size("src")).select(
        "sid", F.size("src").alias("n_src"), F.size("tgt").alias("n_tgt"))


@query
def bitext_reverse(spark, sf_dir):
    return B.reverse_bitext(training_bitext(spark, sf_dir)).select("sid", _joined("src"), _joined("tgt"))


def _gold(spark, sf_dir):
    return look_alike_gold(held_out_bitext(spark, sf_dir))


def _shifted(spark, sf_dir):
    """Gold moved two positions to the left, so some positions are negative."""
    return _gold(spark, sf_dir).withColumn("e_pos", F.col("e_pos") - 2)


@query
def invalid_links(spark, sf_dir):
    return L.invalid_links(_shifted(spark, sf_dir))


@query
def links_build(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    possible = gold.withColumn("sure", F.lit(False))
    return L.build_links(possible.unionByName(gold).unionByName(_shifted(spark, sf_dir)),
                         L.link_tasks(held_out_bitext(spark, sf_dir)))


@query
def links_reverse(spark, sf_dir):
    return L.reverse_links(_gold(spark, sf_dir))


@query
def links_for_source(spark, sf_dir):
    return L.links_for_source(_gold(spark, sf_dir), 3)


@query
def link_states(spark, sf_dir):
    """State and text of every gold link and of every link one word to its right."""
    gold, tasks = _gold(spark, sf_dir), L.link_tasks(held_out_bitext(spark, sf_dir))
    moved = gold.select("sid", (F.col("e_pos") + 1).alias("e_pos"), "f_pos").unionByName(gold.select(*L.KEYS)).repartition(
        tasks, *L.KEYS).distinct()
    marked = moved.join(gold, L.KEYS, "left")
    state = link_state(F.col("sure"), F.col("sure").isNotNull())
    strength = F.when(F.col("sure").isNull(), F.lit(0.5))
    return marked.select(*L.KEYS, state.alias("state"),
                         link_text(F.col("e_pos"), F.col("f_pos"), F.col("sure"), strength).alias("text"))


@query
def format_pair(spark, sf_dir):
    lines = F.split("text", "\n")  # words hold no line end
    return display_pair(training_bitext(spark, sf_dir)).select(
        "sid", F.get(lines, 0).alias("src_line"), F.get(lines, 1).alias("tgt_line"))


@query
def null_word(spark, sf_dir):
    return append_null(_encoded(training_bitext(spark, sf_dir))).select("sid", _joined("src"))


@query
def priors(spark, sf_dir):
    """Weight of every position of the training sentences, the NULL word last."""
    sentences = append_null(training_bitext(spark, sf_dir)).select(
        "sid", F.size("src").alias("n"), F.posexplode("src").alias("e_pos", "e"))
    prior = position_prior(F.col("e_pos") == F.col("n") - 1, F.col("n"))
    return sentences.select("sid", "e_pos", F.round(prior, 6).alias("prior"))


@query
def default_lookup(spark, sf_dir):
    model = C.normalize_rows(cooccurrence(training_bitext(spark, sf_dir), with_null=False))
    cells = cooccurrence(held_out_bitext(spark, sf_dir), with_null=False).select("e", "f")
    return C.lookup_cells(cells, model).select("e", "f", _r6("p"))


@query
def token_transform(spark, sf_dir):
    """Every word as its first two letters and its length."""
    words = map_tokens(F.col("src"), lambda w: F.concat(F.substring(w, 1, 2), F.length(w).cast("string")))
    return training_bitext(spark, sf_dir).select("sid", F.array_join(words, " ").alias("shapes"))


# --- joins ------------------------------------------------------------------

@query
def zip_lines(spark, sf_dir):
    """n-th user turn with n-th assistant turn."""
    talk = table(spark, sf_dir, "conversations")

    def side(role, name):
        rows = talk.filter(F.col("role") == role).select("conv_id", "turn", F.length("text").alias(name))
        return O.with_global_index(rows, "conv_id", "turn", name="line_no").select("line_no", name)

    return B.zip_lines(side("user", "n_user"), side("assistant", "n_assistant"), ["line_no"])


@query
def gold_join(spark, sf_dir):
    held = held_out_bitext(spark, sf_dir)
    return V.gold_of_sentences(held, look_alike_gold(held).filter("sure"))


@query
def dictionary_join(spark, sf_dir):
    """Held-out words in the ids of the training vocabulary."""
    vocab = _vocab(training_bitext(spark, sf_dir))
    return encode_bitext(held_out_bitext(spark, sf_dir), vocab).select("sid", _joined("src"), _joined("tgt"))


@query
def position_cells(spark, sf_dir):
    held = held_out_bitext(spark, sf_dir)
    gold = look_alike_gold(held)
    return position_grid(held, gold, L.reverse_links(gold)).select(
        "sid", "f_pos", "word", F.array_join("cells", "").alias("cells"))


@query
def link_membership(spark, sf_dir):
    gold = cut_lineage(_gold(spark, sf_dir))
    return L.link_membership(L.reverse_links(gold), gold)


# --- counts -----------------------------------------------------------------

@query
def cooccurrences(spark, sf_dir):
    return cooccurrence(_encoded(training_bitext(spark, sf_dir)))


@query
def merged_counts(spark, sf_dir):
    return C.merge_counts(cooccurrence(training_bitext(spark, sf_dir)), cooccurrence(held_out_bitext(spark, sf_dir)))


@query
def normalized_rows(spark, sf_dir):
    return C.normalize_rows(cooccurrence(held_out_bitext(spark, sf_dir))).select("e", "f", _r6("p"))


@query
def upsert_counts(spark, sf_dir):
    return C.upsert_counts(cooccurrence(training_bitext(spark, sf_dir)), cooccurrence(held_out_bitext(spark, sf_dir)))


@query
def upsert_arrivals(spark, sf_dir):
    """Turns per role and first word, overwritten by the length of the last turn that has them.

    Turns of one number are one version; in it the conversations arrive by their number.
    """
    talk = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("e"), F.get(F.split(F.lower("text"), " "), 0).alias("f"), "conv_id", "turn",
        F.length("text").cast("long").alias("n"))
    counts = talk.groupBy("e", "f").agg(F.count(F.lit(1)).alias("n"))
    return C.upsert_counts(counts, talk.filter("n % 3 > 0"), version="turn", arrival="conv_id")


@query
def row_arrays(spark, sf_dir):
    """Union, sum and order by a comparison inside the rows of the training pairs."""
    ordered = S.sorted_in_row(F.array_distinct("src"), F.length, lambda w: F.substring(w, -1, 1), lambda w: w, reverse=True)
    return training_bitext(spark, sf_dir).select(
        "sid", F.array_join(F.array_sort(S.union_in_row("src", "tgt")), " ").alias("both"),
        S.total_in_row(F.transform("src", lambda w: F.length(w).cast("long"))).alias("letters"),
        F.array_join(ordered, " ").alias("ordered"))


@query
def sharded(spark, sf_dir):
    return C.with_shard(training_bitext(spark, sf_dir).select("sid"), SHARDS)


@query
def shard_footprint(spark, sf_dir):
    return C.shard_footprint(C.with_shard(training_bitext(spark, sf_dir), SHARDS)).select(
        "e", "n_shards", F.array_join(F.transform("shards", lambda x: x.cast("string")), " ").alias("shards"))


@query
def vocab_growth(spark, sf_dir):
    return corpus_growth(document_lines(spark, sf_dir))


@query
def pair_count(spark, sf_dir):
    return B.pair_count(training_bitext(spark, sf_dir))


@query
def group_to_list(spark, sf_dir):
    """Line items of every order as a list; orders without any get an empty one."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lists = C.group_to_list(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", orders)
    return lists.select("l_orderkey", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("lines"))


@query
def null_safe_sum(spark, sf_dir):
    """Characters per language; a sum over nothing is 0."""
    none = F.when(F.col("n_chars") < 0, F.col("n_chars"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        C.null_safe_sum(F.col("n_chars")).alias("total"), C.null_safe_sum(none).alias("nothing"))


@query
def total_chars(spark, sf_dir):
    return C.total(table(spark, sf_dir, "documents"), F.col("n_chars"))


# --- order, sets ------------------------------------------------------------

@query
def token_positions(spark, sf_dir):
    return S.with_position(training_bitext(spark, sf_dir), "tgt", "sid")


@query
def vocab_first_seen(spark, sf_dir):
    return first_seen_vocab(document_lines(spark, sf_dir), corpus_words())


@query
def take_per_partition(spark, sf_dir):
    """The first pairs of each of SHARDS partitions that the query itself lays out."""
    pairs = training_bitext(spark, sf_dir).select("sid", F.pmod("sid", F.lit(SHARDS)).cast("int").alias("part"))
    return O.take_per_partition(
        pairs.repartitionById(SHARDS, F.col("part")).sortWithinPartitions("sid"), FIRST_LINES)


@query
def take_per_file(spark, sf_dir):
    root = scratch_path(spark, "per_file")
    _write_two_bases(spark, sf_dir, root)
    first = O.take_per_file(B.side_lines(spark, root, SRC_EXT), FIRST_LINES)
    return first.select(_last_name("base").alias("base"), "line_no", "value")


@query
def take_first(spark, sf_dir):
    return O.take_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", n=TAKEN)


@query
def skip_then_take(spark, sf_dir):
    return O.skip_take(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey",
                       offset=SKIPPED, limit=TAKEN)


@query
def skip_rest(spark, sf_dir):
    """All orders but the first ones."""
    return O.skip_take(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", offset=SKIPPED)


@query
def short_input(spark, sf_dir):
    return O.short_input_report(table(spark, sf_dir, "customer"), 10_000)


@query
def ordered_files(spark, sf_dir):
    """Lines of all files in reading order, numbered over all of them."""
    talk = table(spark, sf_dir, "conversations").select(F.col("role").alias("base"), "conv_id", "turn")
    return O.with_global_index(talk, "base", "conv_id", "turn")


@query
def sort_desc(spark, sf_dir):
    words = S.with_position(training_bitext(spark, sf_dir), "tgt", "sid").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))
    ranked = words.withColumn("_neg", -F.col("n"))
    return O.with_global_index(ranked, "_neg", "token", name="rank").select("rank", "token", "n")


def _as_written(spark, rows, line):
    """Rows of a sorted frame with their numbers, by writing it and reading it back."""
    path = scratch_path(spark, "sorted")
    K.write_lines(rows, path, line)
    return N.text_lines(spark, path).select("line_no", "value")


@query
def sorted_words(spark, sf_dir):
    """Words by falling count, as ``sort_rows`` leaves them."""
    words = S.with_position(training_bitext(spark, sf_dir), "tgt", "sid").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))
    return _as_written(spark, O.sort_rows(words, F.desc("n"), "token"),
                       F.concat_ws(" ", "token", F.col("n").cast("string")))


@query
def reading_order(spark, sf_dir):
    """Pairs of two files in reading order, as ``ordered_pairs`` leaves them."""
    root = scratch_path(spark, "order")
    _write_two_bases(spark, sf_dir, root)
    return _as_written(spark, B.ordered_pairs(B.read_paired_bitext(spark, root)), F.array_join("src", " "))


@query
def lexicographic_sort(spark, sf_dir):
    return O.with_global_index(
        table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"),
        "l_partkey", "l_orderkey", "l_linenumber")


def _words(spark, sf_dir, make):
    return S.with_position(make(spark, sf_dir), "src", "sid").select("token")


@query
def set_union(spark, sf_dir):
    return S.set_union(_words(spark, sf_dir, training_bitext), _words(spark, sf_dir, held_out_bitext))


@query
def concat_ordered(spark, sf_dir):
    return S.concat_ordered(training_bitext(spark, sf_dir).select("sid"), held_out_bitext(spark, sf_dir).select("sid"))


@query
def flatten_two_level(spark, sf_dir):
    """Every line of every document."""
    docs = table(spark, sf_dir, "documents")
    return S.flatten_two_level(docs, F.split("text", "\n"), "doc_id", "line")


@query
def link_intersection(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    return L.link_intersection(L.reverse_links(gold), gold, sure_only=True)


# --- the model --------------------------------------------------------------

@query
def encoded_corpus(spark, sf_dir):
    return encode_corpus(document_lines(spark, sf_dir))[1]


@query
def encoded_files(spark, sf_dir):
    """Documents dealt over three files, encoded together, read back from what was written."""
    root = scratch_path(spark, "encode")
    lines = document_lines(spark, sf_dir)
    paths = [f"{root}/text{n}" for n in range(3)]
    for n, path in enumerate(paths):
        K.write_lines(lines.filter(F.pmod("line", F.lit(3)) == n), path, F.col("value"), "line")
    encode_files(spark, f"{root}/dictionary", paths)
    return N.text_lines(spark, [f"{path}.out" for path in paths]).select(
        _last_name("dataset").alias("file"), "line_no", "value")


@query
def posterior_one_round(spark, sf_dir):
    held = _encoded(held_out_bitext(spark, sf_dir))
    shares = posterior(held, C.normalize_rows(cooccurrence(held)))
    return shares.select("sid", "e", "f", _r6("share"))


def _em(spark, sf_dir, rounds, **options):
    model = train(_encoded(training_bitext(spark, sf_dir)), rounds, **options)
    return model.select("e", "f", _log_p())


@query
def em_1(spark, sf_dir):
    return _em(spark, sf_dir, 1, strategy="broadcast")


@query
def em_3(spark, sf_dir):
    return _em(spark, sf_dir, 3)


@query
def em_20(spark, sf_dir):
    return _em(spark, sf_dir, 20)


@query
def em_shuffle_3(spark, sf_dir):
    return _em(spark, sf_dir, 3, strategy="shuffle")


@query
def em_20_broadcast(spark, sf_dir):
    return _em(spark, sf_dir, 20, strategy="broadcast")


@query
def em_20_null_growth(spark, sf_dir):
    return _em(spark, sf_dir, 20, null_growth=True)


@query
def em_3_null_growth(spark, sf_dir):
    return _em(spark, sf_dir, 3, null_growth=True)


_MODELS: dict[tuple[str, str], DataFrame] = {}


def _model(spark, sf_dir):
    """The model after all rounds, trained once a session for all queries on it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _MODELS:
        _MODELS[key] = train(training_bitext(spark, sf_dir), EM_ROUNDS)
    return _MODELS[key]


def _aligned(spark, sf_dir, strategy="auto"):
    return align(held_out_bitext(spark, sf_dir), _model(spark, sf_dir), strategy, digits=DIGITS)


@query
def best_link(spark, sf_dir):
    return _aligned(spark, sf_dir, "broadcast")


@query
def align_held_out(spark, sf_dir):
    return _aligned(spark, sf_dir, "shuffle").select("sid", "e_pos", "f_pos")


@query
def confusion_counts(spark, sf_dir):
    held = held_out_bitext(spark, sf_dir)
    return V.confusion(V.compare_links(_aligned(spark, sf_dir), look_alike_gold(held), held))


def _scores(spark, sf_dir, by_sentence):
    held = held_out_bitext(spark, sf_dir)
    scores = V.evaluate(_aligned(spark, sf_dir), look_alike_gold(held), held, by_sentence)
    return scores.select(*(["sid"] if by_sentence else []), _r6("precision"), _r6("recall"), _r6("aer"))


@query
def metrics_overall(spark, sf_dir):
    return _scores(spark, sf_dir, by_sentence=False)


@query
def metrics_per_sentence(spark, sf_dir):
    return _scores(spark, sf_dir, by_sentence=True)


@query
def rendered_grid(spark, sf_dir):
    held = held_out_bitext(spark, sf_dir)
    return render_alignment(held, look_alike_gold(held), _aligned(spark, sf_dir))


@query
def whole_job(spark, sf_dir):
    """Encode, train, align and score, all in ids."""
    trained, held = training_bitext(spark, sf_dir), held_out_bitext(spark, sf_dir)
    both = trained.unionByName(held.withColumn("sid", F.col("sid") + F.lit(1 << 61)))
    vocab = _vocab(both)
    outcome = align_and_score(encode_bitext(trained, vocab), encode_bitext(held, vocab),
                              look_alike_gold(held), digits=DIGITS)
    return outcome.metrics.select(_r6("precision"), _r6("recall"), _r6("aer"))


@query
def job_on_files(spark, sf_dir):
    """The whole job from files: ``e e | f f`` lines to train, a tagged pair of files to align, gold links."""
    root = scratch_path(spark, "job")
    trained, held = training_bitext(spark, sf_dir), held_out_bitext(spark, sf_dir)
    vocab = _vocab(trained.unionByName(held.withColumn("sid", F.col("sid") + F.lit(1 << 61))))
    K.write_pipe_bitext(encode_bitext(trained, vocab), f"{root}/train")
    test = encode_bitext(held, vocab)
    K.write_paired_bitext(test, f"{root}/test/talk", SRC_EXT, TGT_EXT, tagged=True)
    K.write_gold(look_alike_gold(held), f"{root}/test.wa")
    outcome = run(spark, f"{root}/train", f"{root}/test", f"{root}/test.wa", digits=DIGITS)
    return outcome.metrics.select(_r6("precision"), _r6("recall"), _r6("aer"))


@query
def top_translations(spark, sf_dir):
    """The three most likely target words of every source word."""
    ranked = most_likely(_model(spark, sf_dir).filter("p > 0").withColumn("p", F.round(F.log("p"), DIGITS)), 3)
    return ranked.select("e", "f", F.col("p").alias("log_p"), "rank")
