"""The same results in plain SQL (DuckDB) on the given tables."""

from __future__ import annotations

from tandem.constants import EM_ROUNDS


def _tok(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w <> '')"


def _turns(name: str, first: str, second: str) -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT a.conv_id * 1000000 + a.turn AS sid, {_tok('a.text')} AS src, {_tok('b.text')} AS tgt
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
      WHERE a.role = '{first}' AND b.role = '{second}')"""


TRAIN = _turns("bt", "user", "assistant")
HELD = _turns("held", "assistant", "user")


def _positions(bitext: str, side: str, pos: str, word: str) -> str:
    return (f"SELECT sid, unnest(range(len({side})))::INT AS {pos}, unnest({side}) AS {word} "
            f"FROM {bitext}")


def _vocab(bitext: str, name: str = "vocab") -> str:
    """Ids in order of first appearance: source side, then target side."""
    return f"""{name} AS MATERIALIZED (
      SELECT w AS word, row_number() OVER (ORDER BY line, pos) AS id FROM (
        SELECT w, min(line) AS line, arg_min(pos, (line, pos)) AS pos FROM (
          SELECT sid AS line, unnest(range(len(src))) AS pos, unnest(src) AS w FROM {bitext}
          UNION ALL
          SELECT sid + 4611686018427387904, unnest(range(len(tgt))), unnest(tgt) FROM {bitext})
        GROUP BY w))"""


def _encode(bitext: str, vocab: str, name: str) -> str:
    def side(column: str) -> str:
        return f"""(SELECT sid, list(coalesce(v.id, -1) ORDER BY pos) AS ids
          FROM ({_positions(bitext, column, 'pos', 'w')}) t LEFT JOIN {vocab} v ON v.word = t.w
          GROUP BY sid)"""
    return f"""{name} AS MATERIALIZED (
      SELECT b.sid, coalesce(s.ids, []) AS src, coalesce(t.ids, []) AS tgt
      FROM {bitext} b LEFT JOIN {side('src')} s ON s.sid = b.sid LEFT JOIN {side('tgt')} t ON t.sid = b.sid)"""


def _pairs(bitext: str, name: str, null: str | None) -> str:
    """Distinct (sid, e, f) with multiplicities; NULL word unless ``null`` is None."""
    nulls = "" if null is None else f"UNION ALL SELECT sid, {null}, 1 FROM {bitext}"
    return f"""{name} AS MATERIALIZED (
      SELECT e.sid, e.w AS e, f.w AS f, e.n AS ne, f.n AS nf, b.l AS l
      FROM (SELECT sid, w, count(*) AS n FROM (SELECT sid, unnest(src) AS w FROM {bitext}) GROUP BY ALL
            {nulls}) e
      JOIN (SELECT sid, w, count(*) AS n FROM (SELECT sid, unnest(tgt) AS w FROM {bitext}) GROUP BY ALL) f
        ON e.sid = f.sid
      JOIN (SELECT sid, len(src) AS l FROM {bitext}) b ON b.sid = e.sid)"""


def _cooc(pairs: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT e, f, sum(ne * nf)::BIGINT AS n FROM {pairs} GROUP BY e, f)"


def _normal(counts: str, name: str, value: str = "n") -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT e, f, {value}::DOUBLE / sum({value}::DOUBLE) OVER (PARTITION BY e) AS p FROM {counts})"""


def _shares(pairs: str, table: str, null: str, n_null: int = 1) -> str:
    weight = f"""t.p * (CASE WHEN c.e = {null} THEN c.ne * {n_null} * 0.2::DOUBLE
                        ELSE c.ne * (0.8::DOUBLE / (c.l + {n_null} + 1)) END)"""
    return f"""SELECT c.sid, c.e, c.f, c.nf,
        {weight} / sum({weight}) OVER (PARTITION BY c.sid, c.f) AS share
      FROM {pairs} c JOIN {table} t ON t.e = c.e AND t.f = c.f"""


def _em(pairs: str, rounds: int, null: str, growth: bool = False) -> str:
    """CTEs t0 … t<rounds>; pairs must hold the NULL word."""
    parts = [_cooc(pairs, "c0"), _normal("c0", "t0")]
    for k in range(1, rounds + 1):
        parts.append(f"""c{k} AS MATERIALIZED (
          SELECT e, f, sum(nf * share) AS n FROM ({_shares(pairs, f't{k - 1}', null, k + 1 if growth else 1)})
          GROUP BY e, f)""")
        parts.append(_normal(f"c{k}", f"t{k}"))
    return ", ".join(parts)


def _links(bitext: str, table: str, null: str, name: str) -> str:
    """Best link of every target position; NULL first, then leftmost, by six decimals of the logarithm."""
    return f"""{name} AS MATERIALIZED (
      SELECT sid, e_pos, f_pos FROM (
        SELECT sid, f_pos, e_pos, prob,
               row_number() OVER (PARTITION BY sid, f_pos ORDER BY round(ln(prob), 6) DESC, e_pos) AS rn
        FROM (SELECT * FROM (
          SELECT f.sid, f.f_pos, e.e_pos,
                 t.p * (CASE WHEN e.e_pos < 0 THEN 0.2::DOUBLE ELSE 0.8::DOUBLE / (b.l + 1) END) AS prob
          FROM (SELECT sid, e_pos, e FROM ({_positions(bitext, 'src', 'e_pos', 'e')})
                UNION ALL SELECT sid, -1, {null} FROM {bitext}) e
          JOIN ({_positions(bitext, 'tgt', 'f_pos', 'f')}) f ON f.sid = e.sid
          JOIN (SELECT sid, len(src) AS l FROM {bitext}) b ON b.sid = e.sid
          JOIN {table} t ON t.e = e.e AND t.f = f.f) WHERE prob > 0))
      WHERE rn = 1 AND e_pos >= 0)"""


def _gold(bitext: str, name: str = "gold") -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT a.sid, e_pos, f_pos, e = f AS sure
      FROM ({_positions(bitext, 'src', 'e_pos', 'e')}) a
      JOIN ({_positions(bitext, 'tgt', 'f_pos', 'f')}) b
        ON a.sid = b.sid AND substr(e, 1, 2) = substr(f, 1, 2))"""


NULL_WORD = "'<null>'"
TRAIN_IDS = ", ".join([TRAIN, _vocab("bt"), _encode("bt", "vocab", "enc")])
TRAIN_PAIRS = TRAIN_IDS + ", " + _pairs("enc", "pairs", "0")
HELD_GOLD = HELD + ", " + _gold("held")
MODEL = ", ".join([TRAIN, _pairs("bt", "pairs", NULL_WORD), _em("pairs", EM_ROUNDS, NULL_WORD)])
ALIGNED = ", ".join([MODEL, HELD, _links("held", f"t{EM_ROUNDS}", NULL_WORD, "links"), _gold("held")])
COMPARED = ALIGNED + """, cmp AS MATERIALIZED (
      SELECT sid, e_pos, f_pos, bool_or(a) AS a, bool_or(s) AS s, bool_or(p) AS p FROM (
        SELECT sid, e_pos, f_pos, true AS a, false AS s, false AS p FROM links
        UNION ALL SELECT sid, e_pos, f_pos, false, sure, true FROM gold)
      GROUP BY ALL)"""
_COUNTS = """count(*) FILTER (a AND s) AS a_s, count(*) FILTER (a AND p) AS a_p,
             count(*) FILTER (a) AS a, count(*) FILTER (s) AS s"""
_METRICS = """round(a_p::DOUBLE / nullif(a, 0), 6) AS precision,
              round(a_s::DOUBLE / nullif(s, 0), 6) AS recall,
              round(1 - (a_s + a_p)::DOUBLE / nullif(s + a, 0), 6) AS aer"""

DOC_LINES = """lines AS MATERIALIZED (
      SELECT doc_id AS line, source AS file, '<s snum=' || lpad(doc_id::VARCHAR, 8, '0') || '> ' AS prefix,
             translate(text, chr(10) || chr(13), '  ') AS body, ' </s>' AS suffix
      FROM documents)"""
_BLANK = """CASE WHEN {0} <> '' AND rtrim({0}, ' ') = '' THEN [] ELSE string_split(rtrim({0}, ' '), ' ') END"""
DOC_TOKENS = DOC_LINES + f""", toks AS MATERIALIZED (
      SELECT line, file, unnest(range(len(ws))) AS pos, unnest(ws) AS w
      FROM (SELECT line, file, {_BLANK.format('body')} AS ws FROM lines))"""
DOC_VOCAB = DOC_TOKENS + """, vocab AS MATERIALIZED (
      SELECT w AS word, row_number() OVER (ORDER BY line, pos) AS id
      FROM (SELECT w, min(line) AS line, arg_min(pos, (line, pos)) AS pos FROM toks GROUP BY w))"""
DOC_ENCODED = DOC_VOCAB + """, encoded AS MATERIALIZED (
      SELECT l.line, prefix || coalesce(ids, '') || ' ' || suffix AS encoded
      FROM lines l LEFT JOIN (
        SELECT line, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids
        FROM toks JOIN vocab ON word = w GROUP BY line) i ON i.line = l.line)"""

_IDS = "array_to_string({0}, ' ')"
_SRC_TGT = "array_to_string(src, ' ') AS src, array_to_string(tgt, ' ') AS tgt"
_LINK_TEXT = "f_pos || '-' || e_pos || CASE WHEN sure THEN '' ELSE '-P' END"
_TRIM_WS = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _cells(proposed: str) -> str:
    """Grid rows of the held-out bitext for gold and the links of ``proposed``."""
    return f"""grid AS (
      SELECT f.sid, f.f_pos, f.f AS word, string_agg(
          CASE WHEN g.sure THEN '[' WHEN g.sid IS NOT NULL THEN '(' ELSE ' ' END
          || CASE WHEN a.sid IS NOT NULL THEN '#' ELSE ' ' END
          || CASE WHEN g.sure THEN ']' WHEN g.sid IS NOT NULL THEN ')' ELSE ' ' END,
          '' ORDER BY e.e_pos) AS cells
      FROM ({_positions('held', 'tgt', 'f_pos', 'f')}) f
      JOIN ({_positions('held', 'src', 'e_pos', 'e')}) e ON e.sid = f.sid
      LEFT JOIN gold g ON g.sid = f.sid AND g.f_pos = f.f_pos AND g.e_pos = e.e_pos
      LEFT JOIN ({proposed}) a ON a.sid = f.sid AND a.f_pos = f.f_pos AND a.e_pos = e.e_pos
      GROUP BY ALL)"""


_REVERSED_SURE = "SELECT sid, f_pos AS e_pos, e_pos AS f_pos FROM gold WHERE sure"
_REVERSED = "SELECT sid, f_pos AS e_pos, e_pos AS f_pos, sure FROM gold"
# a model's cells span many orders of magnitude, so they are compared by logarithm
_LOG_P = "CASE WHEN p > 0 THEN round(ln(p), 6) END"
_CELLS_ROUNDED = "SELECT e, f, round(p, 6) AS p FROM {0}"


def _both_counts(null: str | None) -> str:
    return ", ".join([TRAIN, HELD, _pairs("bt", "p1", null), _cooc("p1", "k1"),
                      _pairs("held", "p2", null), _cooc("p2", "k2")])


def _em_query(rounds: int, growth: bool = False) -> str:
    return (f"WITH {TRAIN_PAIRS}, {_em('pairs', rounds, '0', growth)} "
            f"SELECT e::INT AS e, f::INT AS f, {_LOG_P} AS log_p FROM t{rounds}")


ORACLES: dict[str, str] = {
    "text_lines": f"""WITH {DOC_LINES} SELECT row_number() OVER (ORDER BY line) AS line_no,
        prefix || body || suffix AS value FROM lines""",
    "gzip_roundtrip": f"""WITH {DOC_LINES} SELECT row_number() OVER (ORDER BY line) AS line_no,
        length(prefix || body || suffix)::INT AS n_chars FROM lines""",
    "pipe_bitext": f"WITH {TRAIN_IDS} SELECT row_number() OVER (ORDER BY sid) AS sid, {_SRC_TGT} FROM enc",
    "paired_bitext": f"""WITH {TRAIN}, {HELD}, both_ AS (
        SELECT 'one' AS base, * FROM bt UNION ALL SELECT 'two', * FROM held)
        SELECT -row_number() OVER (ORDER BY base, sid) AS sid, base,
               row_number() OVER (PARTITION BY base ORDER BY sid) AS line_no, {_SRC_TGT} FROM both_""",
    "bitext_files": f"""WITH {HELD} SELECT sid, row_number() OVER (ORDER BY sid) AS line_no, {_SRC_TGT} FROM held""",
    "multi_source": f"""WITH {TRAIN}, {HELD}, both_ AS (
        SELECT 0 AS source_idx, * FROM held UNION ALL SELECT 1, * FROM bt), numbered AS (
        SELECT row_number() OVER (ORDER BY source_idx, sid) AS rn, source_idx,
               row_number() OVER (PARTITION BY source_idx ORDER BY sid) AS line_no,
               len(src)::INT AS n_src, len(tgt)::INT AS n_tgt FROM both_)
        SELECT -rn AS sid, source_idx, line_no, n_src, n_tgt FROM numbered WHERE rn > 40""",
    "one_source_of_three": f"""WITH {HELD} SELECT sid, row_number() OVER (ORDER BY sid) AS line_no, {_SRC_TGT}
        FROM held""",
    "source_states": f"""WITH {HELD} SELECT 0 AS source_idx, 'full' AS base, count(*) AS n_pairs,
        CASE WHEN count(*) > 0 THEN 'ok' ELSE 'no pairs' END AS state FROM held
        UNION ALL SELECT 0, 'lone', 0, 'no partner' UNION ALL SELECT 1, 'hollow', 0, 'no pairs'
        UNION ALL SELECT 2, '', 0, 'missing'""",
    "gold_links": f"WITH {HELD_GOLD} SELECT sid, e_pos, f_pos, sure FROM gold",
    "vocab_roundtrip": f"WITH {DOC_VOCAB} SELECT word, id FROM vocab",
    "encoded_roundtrip": f"""WITH {DOC_ENCODED} SELECT row_number() OVER (ORDER BY line) AS line_no,
        encoded AS value FROM encoded""",
    "link_lines": f"""WITH {HELD_GOLD} SELECT sid, string_agg({_LINK_TEXT}, ' ' ORDER BY f_pos, e_pos) AS links
        FROM gold GROUP BY sid""",
    "sgml_parse": f"""WITH {DOC_LINES} SELECT line, line AS sid, array_to_string(list_filter(
        string_split_regex({_TRIM_WS.format('prefix || body || suffix')}, '\\s+'),
        lambda w: w <> '<s' AND w <> '</s>' AND NOT starts_with(w, 'snum=')), ' ') AS words FROM lines""",
    "sgml_envelope": f"WITH {DOC_LINES} SELECT line, prefix, length(body)::INT AS n_body, suffix FROM lines",
    "tokenizers": f"""SELECT doc_id, len({_BLANK.format('text')})::INT AS n_blank,
        len(string_split_regex({_TRIM_WS.format('text')}, '\\s'))::INT AS n_single,
        len(string_split_regex({_TRIM_WS.format('text')}, '\\s+'))::INT AS n_runs FROM documents""",
    "synthetic_ids": f"""WITH {TRAIN}, n AS (SELECT *, row_number() OVER (ORDER BY sid) AS line_no FROM bt)
        SELECT CASE WHEN len(tgt) > 150 THEN sid ELSE -line_no END AS sid, line_no FROM n""",
    "id_mismatch": f"""WITH {TRAIN} SELECT * FROM (SELECT row_number() OVER (ORDER BY sid) AS line_no,
        sid AS src_id, sid + len(tgt) % 3 AS tgt_id FROM bt) WHERE src_id <> tgt_id""",
    "line_count_report": """WITH n AS (SELECT count(*) FILTER (role = 'user') AS u,
        count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'system') AS s FROM conversations)
        SELECT * FROM (SELECT 'x' AS base, u AS n_src, a AS n_tgt, least(u, a) AS n_pairs FROM n
        UNION ALL SELECT 'y', s, u, least(s, u) FROM n UNION ALL SELECT 'z', u, u, u FROM n)
        WHERE n_src <> n_tgt""",
    "duplicate_ids": "SELECT conv_id AS sid, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1",
    "pair_filter": f"""WITH {TRAIN} SELECT sid, len(src)::INT AS n_src, len(tgt)::INT AS n_tgt FROM bt
        WHERE len(tgt) <= 4 * len(src)""",
    "bitext_reverse": f"""WITH {TRAIN} SELECT sid, array_to_string(tgt, ' ') AS src,
        array_to_string(src, ' ') AS tgt FROM bt""",
    "invalid_links": f"""WITH {HELD_GOLD} SELECT sid, (e_pos - 2)::INT AS e_pos, f_pos, sure FROM gold
        WHERE e_pos < 2""",
    "links_build": f"""WITH {HELD_GOLD} SELECT sid, e_pos, f_pos, bool_or(sure) AS sure FROM (
        SELECT * FROM gold UNION ALL SELECT sid, (e_pos - 2)::INT, f_pos, sure FROM gold WHERE e_pos >= 2)
        GROUP BY ALL""",
    "links_reverse": f"WITH {HELD_GOLD} {_REVERSED}",
    "links_for_source": f"WITH {HELD_GOLD} SELECT sid, e_pos, f_pos FROM gold WHERE sure AND e_pos = 3",
    "link_states": f"""WITH {HELD_GOLD}, moved AS (
        SELECT sid, (e_pos + 1)::INT AS e_pos, f_pos FROM gold UNION SELECT sid, e_pos, f_pos FROM gold)
        SELECT m.sid, m.e_pos, m.f_pos,
          CASE WHEN g.sure THEN 'SURE' WHEN g.sid IS NOT NULL THEN 'POSS' ELSE 'OFF' END AS state,
          m.f_pos || '-' || m.e_pos || CASE WHEN g.sid IS NULL THEN '-0.5' WHEN g.sure THEN '' ELSE '-P' END AS text
        FROM moved m LEFT JOIN gold g ON g.sid = m.sid AND g.e_pos = m.e_pos AND g.f_pos = m.f_pos""",
    "format_pair": f"""WITH {TRAIN}, s AS (SELECT sid, string_agg(pos || ':' || w || ' ', '' ORDER BY pos) AS x
        FROM ({_positions('bt', 'src', 'pos', 'w')}) GROUP BY sid), t AS (
        SELECT sid, string_agg(pos || ':' || w || ' ', '' ORDER BY pos) AS x
        FROM ({_positions('bt', 'tgt', 'pos', 'w')}) GROUP BY sid)
        SELECT b.sid, coalesce(s.x, '') AS src_line, coalesce(t.x, '') AS tgt_line
        FROM bt b LEFT JOIN s ON s.sid = b.sid LEFT JOIN t ON t.sid = b.sid""",
    "null_word": f"WITH {TRAIN_IDS} SELECT sid, array_to_string(list_append(src, 0), ' ') AS src FROM enc",
    "priors": f"""WITH {TRAIN} SELECT sid, e_pos, round(0.8::DOUBLE / (l + 2), 6) AS prior FROM (
        SELECT sid, len(src) AS l, unnest(range(len(src)))::INT AS e_pos FROM bt)
        UNION ALL SELECT sid, len(src)::INT, 0.2::DOUBLE FROM bt""",
    "default_lookup": f"""WITH {_both_counts(None)}, {_normal('k1', 't')}
        SELECT k2.e, k2.f, coalesce(round(t.p, 6), 0) AS p FROM k2 LEFT JOIN t ON t.e = k2.e AND t.f = k2.f""",
    "token_transform": f"""WITH {TRAIN} SELECT sid,
        array_to_string(list_transform(src, lambda w: substr(w, 1, 2) || length(w)), ' ') AS shapes FROM bt""",
    "zip_lines": """WITH u AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, length(text)::INT AS n
        FROM conversations WHERE role = 'user'), a AS (
        SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, length(text)::INT AS n
        FROM conversations WHERE role = 'assistant')
        SELECT u.line_no, u.n AS n_user, a.n AS n_assistant FROM u JOIN a ON a.line_no = u.line_no""",
    "gold_join": f"""WITH {HELD_GOLD} SELECT h.sid, count(g.sid) AS n_possible, count(g.sid) AS n_sure,
        count(g.sid) > 0 AS has_gold FROM held h LEFT JOIN gold g ON g.sid = h.sid AND g.sure GROUP BY h.sid""",
    "dictionary_join": f"WITH {TRAIN}, {_vocab('bt')}, {HELD}, {_encode('held', 'vocab', 'enc')} SELECT sid, {_SRC_TGT} FROM enc",
    "position_cells": f"WITH {HELD_GOLD}, {_cells(_REVERSED_SURE)} SELECT sid, f_pos, word, cells FROM grid",
    "link_membership": f"""WITH {HELD_GOLD} SELECT sid, e_pos, f_pos, bool_or(s) AS in_sure, bool_or(p) AS in_possible
        FROM (SELECT sid, e_pos, f_pos, false AS s, false AS p, true AS asked FROM ({_REVERSED})
              UNION ALL SELECT sid, e_pos, f_pos, sure, true, false FROM gold)
        GROUP BY sid, e_pos, f_pos HAVING bool_or(asked)""",
    "cooccurrences": f"WITH {TRAIN_PAIRS}, {_cooc('pairs', 'c')} SELECT e::INT AS e, f::INT AS f, n FROM c",
    "merged_counts": f"""WITH {_both_counts(NULL_WORD)} SELECT e, f, sum(n)::BIGINT AS n
        FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2) GROUP BY e, f""",
    "normalized_rows": f"""WITH {HELD}, {_pairs('held', 'p', NULL_WORD)}, {_cooc('p', 'c')}, {_normal('c', 't')}
        {_CELLS_ROUNDED.format('t')}""",
    "upsert_counts": f"""WITH {_both_counts(NULL_WORD)} SELECT coalesce(k2.e, k1.e) AS e, coalesce(k2.f, k1.f) AS f,
        coalesce(k2.n, k1.n) AS n FROM k1 FULL JOIN k2 ON k1.e = k2.e AND k1.f = k2.f""",
    "upsert_arrivals": """WITH talk AS (SELECT role AS e, string_split(lower(text), ' ')[1] AS f, conv_id, turn,
            length(text)::BIGINT AS n FROM conversations),
        last AS (SELECT e, f, arg_max(n, (turn, conv_id)) AS n FROM talk WHERE n % 3 > 0 GROUP BY e, f)
        SELECT c.e, c.f, coalesce(l.n, c.n) AS n FROM (SELECT e, f, count(*) AS n FROM talk GROUP BY e, f) c
        LEFT JOIN last l ON l.e = c.e AND l.f = c.f""",
    "row_arrays": f"""WITH {TRAIN}, o AS (
          SELECT sid, string_agg(w, ' ' ORDER BY length(w) DESC, right(w, 1) DESC, w DESC) AS ordered
          FROM (SELECT DISTINCT sid, unnest(src) AS w FROM bt) GROUP BY sid)
        SELECT sid, array_to_string(list_sort(list_distinct(list_concat(src, tgt))), ' ') AS both,
          coalesce(list_sum(list_transform(src, lambda w: length(w))), 0)::BIGINT AS letters,
          coalesce(ordered, '') AS ordered FROM bt LEFT JOIN o USING (sid)""",
    "sharded": f"WITH {TRAIN} SELECT sid, (sid % 8 + 1)::INT AS shard FROM bt",
    "shard_footprint": f"""WITH {TRAIN} SELECT e, count(*)::INT AS n_shards,
        string_agg(shard::VARCHAR, ' ' ORDER BY shard) AS shards FROM (
        SELECT DISTINCT sid % 8 + 1 AS shard, unnest(src) AS e FROM bt) GROUP BY e""",
    "vocab_growth": f"""WITH {DOC_TOKENS}, firsts AS (SELECT w, min(file) AS file FROM toks GROUP BY w)
        SELECT file, n_new, sum(n_new) OVER (ORDER BY file)::BIGINT AS n_words FROM (
        SELECT f.file, count(firsts.w) AS n_new FROM (SELECT DISTINCT file FROM toks) f
        LEFT JOIN firsts ON firsts.file = f.file GROUP BY f.file)""",
    "pair_count": f"WITH {TRAIN} SELECT count(*) AS n_pairs FROM bt",
    "group_to_list": """SELECT o_orderkey AS l_orderkey,
        coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS lines
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "null_safe_sum": """SELECT lang, sum(n_chars)::BIGINT AS total, 0::BIGINT AS nothing
        FROM documents GROUP BY lang""",
    "total_chars": "SELECT coalesce(sum(n_chars), 0)::BIGINT AS total FROM documents",
    "token_positions": f"WITH {TRAIN} {_positions('bt', 'tgt', 'pos', 'token')}",
    "vocab_first_seen": f"WITH {DOC_VOCAB} SELECT word, id FROM vocab",
    "take_per_file": f"""WITH {TRAIN}, {HELD} SELECT base, line_no, array_to_string(src, ' ') AS value FROM (
        SELECT 'one' AS base, src, row_number() OVER (ORDER BY sid) AS line_no FROM bt
        UNION ALL SELECT 'two', src, row_number() OVER (ORDER BY sid) FROM held) WHERE line_no <= 3""",
    "take_first": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 60",
    "skip_then_take": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 60 OFFSET 40",
    "sorted_words": f"""WITH {TRAIN} SELECT row_number() OVER (ORDER BY n DESC, token) AS line_no,
        token || ' ' || n AS value FROM (
        SELECT token, count(*) AS n FROM (SELECT unnest(tgt) AS token FROM bt) GROUP BY token)""",
    "reading_order": f"""WITH {TRAIN}, {HELD} SELECT row_number() OVER (ORDER BY base, sid) AS line_no,
        array_to_string(src, ' ') AS value FROM (
        SELECT 'one' AS base, * FROM bt UNION ALL SELECT 'two', * FROM held)""",
    "skip_rest": "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 40",
    "short_input": """SELECT count(*) AS available, 10000::BIGINT AS "offset", count(*) < 10000 AS too_short FROM customer""",
    "ordered_files": """SELECT role AS base, conv_id, turn, row_number() OVER (ORDER BY role, conv_id, turn) AS idx
        FROM conversations""",
    "sort_desc": f"""WITH {TRAIN} SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, token, n FROM (
        SELECT token, count(*) AS n FROM ({_positions('bt', 'tgt', 'pos', 'token')}) GROUP BY token)""",
    "lexicographic_sort": """SELECT l_partkey, l_orderkey, l_linenumber,
        row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber) AS idx FROM lineitem""",
    "take_per_partition": f"""WITH {TRAIN} SELECT sid, (sid % 8)::INT AS part FROM bt
        QUALIFY row_number() OVER (PARTITION BY sid % 8 ORDER BY sid) <= 3""",
    "set_union": f"WITH {TRAIN}, {HELD} SELECT unnest(src) AS token FROM bt UNION SELECT unnest(src) FROM held",
    "concat_ordered": f"WITH {TRAIN}, {HELD} SELECT sid, 0 AS part_idx FROM bt UNION ALL SELECT sid, 1 FROM held",
    "flatten_two_level": """SELECT doc_id, unnest(range(len(ls)))::INT AS pos, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""",
    "link_intersection": f"""WITH {HELD_GOLD} SELECT sid, f_pos AS e_pos, e_pos AS f_pos FROM gold
        INTERSECT SELECT sid, e_pos, f_pos FROM gold WHERE sure""",
    "encoded_corpus": f"WITH {DOC_ENCODED} SELECT line, encoded FROM encoded",
    "encoded_files": f"""WITH {DOC_ENCODED.replace("SELECT doc_id AS line", "SELECT doc_id % 3 * 1099511627776 + doc_id AS line")}
        SELECT 'text' || (line // 1099511627776) || '.out' AS file,
               row_number() OVER (PARTITION BY line // 1099511627776 ORDER BY line) AS line_no, encoded AS value FROM encoded""",
    "posterior_one_round": f"""WITH {HELD}, {_vocab('held')}, {_encode('held', 'vocab', 'enc')},
        {_pairs('enc', 'pairs', '0')}, {_em('pairs', 0, '0')}
        SELECT sid, e::INT AS e, f::INT AS f, round(share, 6) AS share FROM ({_shares('pairs', 't0', '0')})""",
    "em_1": _em_query(1),
    "em_3": _em_query(3),
    "em_20": _em_query(20),
    "em_shuffle_3": _em_query(3),
    "em_20_broadcast": _em_query(20),
    "em_20_null_growth": _em_query(20, growth=True),
    "em_3_null_growth": _em_query(3, growth=True),
    "best_link": f"WITH {ALIGNED} SELECT sid, e_pos, f_pos, true AS sure FROM links",
    "align_held_out": f"WITH {ALIGNED} SELECT sid, e_pos, f_pos FROM links",
    "confusion_counts": f"WITH {COMPARED} SELECT {_COUNTS} FROM cmp",
    "metrics_overall": f"WITH {COMPARED} SELECT {_METRICS} FROM (SELECT {_COUNTS} FROM cmp)",
    "metrics_per_sentence": f"""WITH {COMPARED} SELECT sid, {_METRICS}
        FROM (SELECT sid, coalesce(a_s, 0) AS a_s, coalesce(a_p, 0) AS a_p, coalesce(a, 0) AS a, coalesce(s, 0) AS s
              FROM (SELECT DISTINCT sid FROM held) LEFT JOIN (SELECT sid, {_COUNTS} FROM cmp GROUP BY sid) USING (sid))""",
    "rendered_grid": f"""WITH {ALIGNED}, {_cells('SELECT * FROM links')}
        SELECT sid, 0 AS part, f_pos AS i, cells || '| ' || word AS line FROM grid
        UNION ALL SELECT sid, 1, 0, repeat('---', len(src)) || '''' FROM held
        UNION ALL SELECT sid, 2, i::INT, string_agg(CASE WHEN length(e) > i
            THEN ' ' || substr(e, i::INT + 1, 1) || ' ' ELSE '   ' END, '' ORDER BY e_pos)
          FROM (SELECT sid, src, unnest(range(list_max(list_transform(src, lambda w: length(w))))) AS i FROM held) d
          JOIN ({_positions('held', 'src', 'e_pos', 'e')}) w USING (sid) GROUP BY sid, i""",
    "whole_job": f"WITH {COMPARED} SELECT {_METRICS} FROM (SELECT {_COUNTS} FROM cmp)",
    "job_on_files": f"WITH {COMPARED} SELECT {_METRICS} FROM (SELECT {_COUNTS} FROM cmp)",
    "top_translations": f"""WITH {MODEL} SELECT e, f, log_p, rank FROM (
        SELECT e, f, log_p, row_number() OVER (PARTITION BY e ORDER BY log_p DESC, f)::INT AS rank
        FROM (SELECT e, f, {_LOG_P} AS log_p FROM t{EM_ROUNDS} WHERE p > 0)) WHERE rank <= 3""",
}
