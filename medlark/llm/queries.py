"""The registered queries of the subpackage, one an operator, and their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, conversations, exact_dedup, idfiles, merkle, mixing, order_minhash, packing, secrets, spans, tokens, toxicity, warc
from .common import read_table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, read_table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(spark, read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read_table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.id_files(spark, read_table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, read_table(spark, sf_dir, "documents"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.cleaned(spark, read_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "links", "kept")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secrets(read_table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(spark, conversations.damaged(read_table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_fingerprints": op3_fingerprints,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_id_files": op7_id_files,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_order_minhash": op10_order_minhash,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, sha256(b) AS k FROM p),
        g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY k, payload_bytes) ELSE page_id END AS keeper FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN keeper <> page_id THEN keeper END AS refers_to
        FROM g""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        r AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op13_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
        w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        cut AS (SELECT lang, phrase, a, w, k, unnest(generate_series(1, k - 1)) AS j FROM c),
        s AS (SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score FROM cut
              JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
        m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        inner_runs AS (SELECT lang, a, unnest(list_transform(generate_series(1, k - z + 1), lambda i: array_to_string(w[i:i + z - 1], ' '))) AS phrase FROM c, (VALUES (2), (3)) v(z) WHERE z < k),
        longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_runs GROUP BY ALL)
        SELECT m.lang, CAST(row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS BIGINT) AS rank, m.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM m LEFT JOIN longer x ON x.lang = m.lang AND x.phrase = m.phrase JOIN n ON n.lang = m.lang
        WHERE x.longer IS NULL OR 100 * x.longer < 80 * a QUALIFY rank <= 2000""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        bits AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
        lookup AS (SELECT list(v ORDER BY i) AS l FROM bits),
        u AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(l[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 20 AS u FROM o, lookup),
        d AS (SELECT conv_id, turn, CASE u WHEN 4 THEN 'user' ELSE role END AS role, CASE u WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE u WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM u WHERE u <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
        f AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS x, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM r),
        moves(a, b, code, ins, cost, made) AS (
            SELECT * FROM (VALUES ('', '', 'D', '', 4, ''), ('s', 's', 'D', '', 4, ''), ('u', 'u', 'D', '', 4, ''), ('a', 'a', 'D', '', 4, ''),
            ('', 's', '', '', 0, 's'), ('', 'u', '', '', 0, 'u'), ('s', 'u', '', '', 0, 'u'), ('a', 'u', '', '', 0, 'u'), ('u', 'a', '', '', 0, 'a'),
            ('', 'a', 'I', 'u', 3, 'a'), ('s', 'a', 'I', 'u', 3, 'a'), ('a', 'a', 'I', 'u', 3, 'a'), ('u', 'u', 'I', 'a', 3, 'u')) v),
        dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS state, 0 AS cost, '' AS audit, '' AS body FROM r GROUP BY conv_id
            UNION ALL
            SELECT conv_id, i, state, cost, audit, body FROM (
                SELECT dp.conv_id, f.i, m.b AS state,
                       dp.cost + m.cost + CASE WHEN m.code = 'D' THEN 0 ELSE e.more + CASE f.fault WHEN 't' THEN 3 ELSE 0 END END AS cost,
                       dp.audit || m.code || CASE WHEN m.code = 'D' THEN '' ELSE e.letter END AS audit,
                       dp.body || CASE m.ins WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END || CASE WHEN m.code = 'D' THEN '' ELSE chr(10) || CASE WHEN e.letter = 'K' THEN f.role WHEN m.made = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text END AS body
                FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
                JOIN moves m ON m.a = dp.state
                JOIN (VALUES ('K', 0), ('R', 3)) e(letter, more) ON (m.code = 'D' AND e.letter = 'K') OR (m.code <> 'D' AND f.fault NOT IN ('b', 'd') AND CASE WHEN e.letter = 'K' THEN f.x = m.made ELSE m.made IN ('u', 'a') END)
                QUALIFY row_number() OVER (PARTITION BY dp.conv_id, m.b ORDER BY dp.cost + m.cost + CASE WHEN m.code = 'D' THEN 0 ELSE e.more + CASE f.fault WHEN 't' THEN 3 ELSE 0 END END, dp.audit || m.code || CASE WHEN m.code = 'D' THEN '' ELSE e.letter END) = 1) x),
        n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        best AS (SELECT dp.conv_id, cost + CASE state WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END AS cost, audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
                        body || CASE state WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END AS body
                 FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i
                 QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost + CASE state WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END, audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END) = 1)
        SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(body, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM o) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
