"""Registered queries of the operators, each with the SQL it must equal where SQL can say it."""

import os

from postloom.llm import (
    bpe, chat, dedup, forest, hmm, jaccard, language, licenses, mixing, strata, toxicity,
    warc, ztrie)

QUERIES, ORACLES = {}, {}


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tokenizer(name="word_bpe_49k.json"):
    """A public tokenizer file; the folder can be set by TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_bpe_lexicon")
def bpe_lexicon(spark, folder):
    return bpe.digests(table(spark, folder, "documents"), tokenizer())


@query("op2_exact_dedup", """
WITH folded AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS content
    FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
FROM folded WINDOW same AS (PARTITION BY content)
""")
def exact_dedup(spark, folder):
    return dedup.exact_dedup(table(spark, folder, "documents")).drop("keep_locator")


@query("op3_ngram_jaccard", r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingled AS (
    SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
                                 ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i
          FROM worded WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
    FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
""")
def ngram_jaccard(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents"))


@query("op4_pareto_mixing", r"""
WITH sized AS (
    SELECT doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
    FROM sized GROUP BY source
), levels AS (
    SELECT *, (3 * source_size)::DOUBLE AS cap,
           (sum(source_size) OVER ()
            - 3 * (sum(source_size) OVER up - source_size))
           / (sum(weight) OVER () - sum(weight) OVER up + weight) AS level
    FROM sources WINDOW up AS (ORDER BY source_size / weight, source
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), targets AS (
    SELECT source, source_size, least(cap, weight * (
        SELECT level FROM levels WHERE level * weight <= cap
        ORDER BY source_size / weight, source LIMIT 1)) AS target
    FROM levels
), wanted AS (
    SELECT doc_id, s.source, size, source_size, target,
           floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS copies,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS f,
           (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
               / 4503599627370496::DOUBLE AS u
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), keyed AS (
    SELECT *, CASE WHEN f - copies > 0
                   THEN u / (1 - u) / ((f - copies) / (1 - (f - copies))) END AS quotient
    FROM wanted
), placed AS (
    SELECT *, coalesce(sum(size) OVER (
        PARTITION BY source ORDER BY quotient / (1 + quotient), doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
    FROM keyed
)
SELECT doc_id, size, source_size, target,
       (copies + CASE WHEN quotient IS NOT NULL AND middle <= target - copies * source_size
                      THEN 1 ELSE 0 END) * size AS taken
FROM placed
""")
def pareto_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).drop("copies")


@query("op9_language_id")
def language_id(spark, folder):
    return language.languages_of(table(spark, folder, "documents"))


@query("op5_chat_format", r"""
WITH rows_ AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, length(role) + length(text) + 24 + length(regexp_extract_all(
        role || chr(1) || text, '\\|<\||<s>|</s>|\[INST\]|\[/INST\]')) AS chars
    FROM rows_
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn, role, text)
                    FILTER (WHERE role = 'assistant'), '') AS loss,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM whole
""")
def chat_format(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    return chat.digests(rows.unionByName(fixed))


@query("op6_warc_ranges", """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit'
            ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM firsts
""")
def warc_ranges(spark, folder):
    return warc.roundtrip(table(spark, folder, "pages"))


@query("op8_license_diagonals")
def license_diagonals(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


# All pairs, which a table of this size allows SQL; the given vectors hold no link, so links are
# proved by the tests on planted clumps and chains.
@query("op10_projection_forest", """
WITH RECURSIVE parts AS (
    SELECT vec_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
    FROM embeddings
), sound AS (
    SELECT vec_id, list(x ORDER BY pos) AS v FROM parts GROUP BY vec_id
    HAVING bool_and(x IS NOT NULL AND isfinite(x)) AND max(abs(x)) > 0
), links AS (
    SELECT a.vec_id AS one, b.vec_id AS two FROM sound a JOIN sound b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION SELECT vec_id, two FROM reach JOIN links ON one = other
)
SELECT vec_id, (SELECT count(*) FROM links WHERE one = vec_id) AS n_links,
       min(other) AS component_id, vec_id = min(other) AS kept
FROM reach GROUP BY vec_id
""")
def projection_forest(spark, folder):
    return forest.near_vectors(table(spark, folder, "embeddings"))


@query("op7_toxicity_grades")
def toxicity_grades(spark, folder):
    return toxicity.severities(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_hidden_markov")
def hidden_markov(spark, folder):
    return hmm.text_scores(table(spark, folder, "documents"))


@query("op11_zfast_trie", """
WITH ordered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
               length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(
            string_split(conv_id::VARCHAR, ''),
            lambda c: list_prepend(ascii(c)::BIGINT, list_transform(range(8), lambda i: -1::BIGINT))))),
        lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
                            WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END)) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM ordered)
), turns AS (
    SELECT c.conv_id, o.k, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.k <= c.h
    UNION ALL
    SELECT c.conv_id, o.k, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.k > c.h
), placed AS (
    SELECT conv_id, text, sha256(length(role)::VARCHAR || ':' || role || text) AS digest,
           row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth
    FROM turns
), prefixes AS (
    SELECT conv_id, depth, length(text) AS chars,
           string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix,
           depth = max(depth) OVER (PARTITION BY conv_id) AS is_end
    FROM placed
    UNION ALL
    SELECT conv_id, 0, 0, '', NOT EXISTS (SELECT 1 FROM placed p WHERE p.conv_id = c.conv_id)
    FROM convs c
), nodes AS (
    SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * any_value(chars) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                           FILTER (WHERE is_end), '')) AS ends_sha256
    FROM prefixes GROUP BY depth, prefix
), children AS (
    SELECT depth - 1 AS depth, substr(prefix, 1, length(prefix) - 64) AS prefix, count(*) AS n
    FROM nodes WHERE depth > 0 GROUP BY 1, 2
), counted AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, prefix)
), sums AS (
    SELECT a.depth, a.prefix, sum(b.saved) AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves
    FROM counted a JOIN counted b ON b.depth >= a.depth AND substr(b.prefix, 1, 64 * a.depth) = a.prefix
    GROUP BY 1, 2
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums USING (depth, prefix)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = substr(n.prefix, 1, 64 * (n.depth::INT - 1))
""")
def zfast_trie(spark, folder):
    return ztrie.prefix_trie(table(spark, folder, "conversations"))


@query("op13_length_strata", r"""
WITH doc_terms AS (
    SELECT doc_id, row_, term, count(*) AS tf, any_value(n) AS n FROM (
        SELECT doc_id, row_, len(found) AS n, unnest(found) AS term FROM (
            SELECT doc_id, row_number() OVER () AS row_, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents))
    GROUP BY ALL
), corpus AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM (SELECT row_, any_value(n) AS n FROM doc_terms GROUP BY 1)
), weighed AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM doc_terms GROUP BY 1), corpus
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
    SELECT item_id, row_, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (
        1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
    FROM asked JOIN weighed USING (term) JOIN doc_terms USING (term), corpus
    GROUP BY item_id, row_
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0) WHERE rank <= 20
""")
def length_strata(spark, folder):
    return strata.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
