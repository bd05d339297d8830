"""Queries of this package, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(
    r"""
    WITH w AS (
        SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
    ), g AS (
        SELECT doc_id, pos, word, string_agg(word, ' ') OVER nxt AS run, count(*) OVER nxt AS n
        FROM w WINDOW nxt AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
    ), r AS (
        SELECT doc_id, pos, word,
            n = 20 AND row_number() OVER (PARTITION BY run, n ORDER BY doc_id, pos) > 1 AS again
        FROM g
    ), c AS (
        SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
        FROM r
    )
    SELECT d.doc_id, count(c.pos) AS n_words, count(c.pos) FILTER (c.gone) AS n_removed,
        sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.pos) FILTER (NOT c.gone), '')) AS kept_sha256
    FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
    """
)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SHARD_BYTES = 1 << 20


@query(
    f"""
    WITH h AS (
        SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
            ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
        FROM documents
    ), s AS (
        SELECT doc_id, n_bytes, h, d, sum(n_bytes) OVER part AS load, min(h) OVER part = max(h) OVER part AS one
        FROM h, range(61) AS depths(d) WINDOW part AS (PARTITION BY d, h >> (60 - d))
    ), b AS (SELECT doc_id, n_bytes, h, min(d) AS d FROM s WHERE load <= {SHARD_BYTES} OR one GROUP BY ALL)
    SELECT doc_id, CAST(d AS BIGINT) AS shard_depth, n_bytes AS shard_row_bytes,
        substr(lpad(bin(h), 60, '0'), 1, CAST(d AS INTEGER)) AS shard
    FROM b
    """
)
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).select("doc_id", "shard", "shard_depth", "shard_row_bytes")


@query(
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM t WINDOW same AS (PARTITION BY t)
    """
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import copies

    return copies(table(spark, sf_dir, "documents")).drop("bucket")


@query(
    r"""
    WITH l AS (
        SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
    ), k AS (
        SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM l
    ), s AS (
        SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), m AS (SELECT k.*, s.last IS NOT NULL AND s.last <> doc_id AS gone FROM k LEFT JOIN s ON s.key = k.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_lines

    kept = drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (
        SELECT p.a, p.b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
        ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
        WHERE 100 * p.both >= 90 * (na.n + nb.n - p.both)
    ), reach AS (
        SELECT a AS doc_id, b AS other FROM links
        UNION
        SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
    )
    SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(d.doc_id, min(r.other)) AS component_id
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
    """
)
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, predict

    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "labelled_share")


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query()
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    b AS (
        SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM d
    ), w AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM b),
    g AS (
        SELECT r, pos, string_agg(word, ' ') OVER few AS few, count(*) OVER few AS n_few,
            string_agg(word, ' ') OVER many AS many, count(*) OVER many AS n_many
        FROM w WINDOW few AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
            many AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 100 FOLLOWING)
    ), a AS (
        SELECT r, pos, n_few = 3 AND count(*) OVER (PARTITION BY r, few, n_few) > 1 AS again,
            n_many = 101 AND count(*) OVER (PARTITION BY r, many, n_many) > 1 AS far
        FROM g
    ), c AS (
        SELECT r, far, bool_or(again) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS held FROM a
    ), s AS (SELECT r, count(*) FILTER (held) AS held, bool_or(far) AS far FROM c GROUP BY r),
    f AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
            coalesce(CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
            CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            coalesce(held, 0) AS n_repeat_words, coalesce(far, false) AS far
        FROM b LEFT JOIN s ON s.r = b.r
    )
    SELECT * EXCLUDE (far), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_repeat_words <= 40 * n_words AND NOT far AS kept
    FROM f
    """
)
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


@query(
    r"""
    WITH i AS (
        SELECT item, item_id, term, count(*) AS times
        FROM (
            SELECT row_number() OVER () AS item, item_id,
                unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ) GROUP BY ALL
    ), d AS (
        SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), c AS (SELECT count(*) AS n_all, CAST(sum(len(terms)) AS BIGINT) AS l_all FROM d WHERE len(terms) > 0),
    p AS (
        SELECT r, doc_id, n, term, count(*) AS tf
        FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
    ), w AS (
        SELECT term, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM p, c WHERE term IN (SELECT term FROM i) GROUP BY term, n_all
    ), s AS (
        SELECT i.item, i.item_id, p.r, p.doc_id,
            CAST(sum(i.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * c.n_all) // c.l_all)))) AS BIGINT) AS score
        FROM i JOIN p ON p.term = i.term JOIN w ON w.term = i.term, c GROUP BY ALL
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
    WHERE rank <= 20
    """
)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""
    WITH crc AS (
        SELECT list(v ORDER BY i) AS t
        FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS x(i))
    ), o AS (
        SELECT conv_id, list(struct_pack(key := md5(md5(coalesce(role, '')) || coalesce(text, '')),
            words := CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT))
            ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || coalesce(text, ''))) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), h AS (
        SELECT conv_id, turns, xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, x: xor(crc.t[(xor(c, x) & 255) + 1], c >> 8))) % 4 AS h
        FROM o, crc
    ), c AS (
        SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns
        FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20
    ), m AS (
        SELECT conv_id, d, len(turns) = d AS ends, array_to_string(list_transform(turns[1:d], lambda x: x.key), '') AS path,
            CASE WHEN d = 0 THEN 0 ELSE turns[d].words END AS words
        FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM c)
    ), n AS (
        SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM m GROUP BY d, path
    ), k AS (
        SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.path[:32 * n.d] = n.path) AS n_children
        FROM n LEFT JOIN n up ON up.d = n.d - 1 AND up.path = n.path[:32 * (n.d - 1)]
    ), s AS (
        SELECT u AS d, path[:32 * u] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
        FROM (SELECT k.*, unnest(range(d + 1)) AS u FROM k) GROUP BY ALL
    )
    SELECT k.conv_id, k.d AS depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends_sha256
    FROM k JOIN s ON s.d = k.d AND s.path = k.path
    """
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversations, prefix_trie, rebuilt

    return prefix_trie(rebuilt(conversations(table(spark, sf_dir, "conversations"))))
