"""The corpus operators over the driver tables, with production parameters and, where SQL can say it, its statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import chat, decontaminate, fillmiddle, langid, linededup, multiindex, neardup, packing, pii, prefixtrie, substring, tokencount, warc
from cellweave.llm.common import table
from cellweave.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bind(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@bind("op1_pii")
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


@bind("op2_language")
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.report(spark, table(spark, folder, "documents"))


@bind("op3_lines")
def op3_lines(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.report(table(spark, folder, "documents"))


@bind("op4_pack")
def op4_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), *byte_bpe())


def byte_bpe() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@bind("op5_tokens")
def op5_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), fresh_path(spark, "token-cache"))


@bind("op6_near_duplicates", r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[a:a + 3], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS a FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN k ON k.doc_id = d.doc_id
""")
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.report(table(spark, folder, "documents"), words=4)


@bind("op7_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
k AS (SELECT *, CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS keeper FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM k
""")
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.report(table(spark, folder, "pages"))


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@bind("op8_decontaminate", rf"""
WITH i AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, len, array_to_string(w[a:a + len - 1], ' ') AS gram
      FROM (SELECT item_id, w, least(10, len(w)) AS len, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a
            FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({SQL_WORDS}, []) AS w FROM documents),
p AS (SELECT doc_id, w, l.len, unnest(range(1, len(w) - l.len + 2)) AS a
      FROM d, (SELECT DISTINCT len FROM g) l WHERE len(w) >= l.len),
h AS (SELECT doc_id, a, x.len, item_id
      FROM (SELECT doc_id, len, a, array_to_string(w[a:a + len - 1], ' ') AS gram FROM p) x JOIN g ON g.len = x.len AND g.gram = x.gram),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + len)) AS k FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
""")
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@bind("op9_chat", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(k)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM c),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '(\[\\*/?(INST|SYS|ROLE)\])|(\[\\*TEXT\])|(<\\*/?s>)'))
             + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
               ELSE 23 + length(role) + len(regexp_extract_all(role, '(\[\\*/?(INST|SYS|ROLE)\])|(\[\\*TEXT\])|(<\\*/?s>)')) END AS size FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars,
       regexp_matches(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY n),
                      '^s?(ua)*ua?$') AS valid
FROM e GROUP BY conv_id
""")
def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return chat.read_back(chat.format_conversations(rows))


@bind("op10_embeddings")
def op10_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return multiindex.report(table(spark, folder, "embeddings"))


@bind("op11_prefix_trie", r"""
WITH RECURSIVE t AS (SELECT i, 0 AS k, i AS v FROM range(256) r(i)
                     UNION ALL SELECT i, k + 1, CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8),
c AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 1 AS p, 4294967295 AS crc FROM conversations WHERE conv_id IS NOT NULL
      UNION ALL SELECT conv_id, s, p + 1, xor(crc >> 8, v) FROM c JOIN t ON k = 8 AND i = (xor(crc, ord(s[p])) & 255) WHERE p <= length(s)),
h AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM c WHERE p = length(s) + 1),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations),
b AS (SELECT h.conv_id, p AS d, role, text FROM h JOIN o ON o.conv_id = base AND p <= h),
n AS (SELECT conv_id, max(d) AS n FROM b GROUP BY 1),
a AS (SELECT * FROM b UNION ALL SELECT h.conv_id, coalesce(n, 0) + p - h, role, text FROM h JOIN o ON o.conv_id = h.conv_id AND p > h LEFT JOIN n ON n.conv_id = h.conv_id),
g AS (SELECT conv_id, 0 AS d, '' AS g, 0 AS words FROM h UNION ALL
      SELECT conv_id, d, md5(string_agg(md5(length(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)),
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM a),
m AS (SELECT g, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM g GROUP BY g, d),
u AS (SELECT m.*, p.g AS up, q.conv_id AS parent FROM m LEFT JOIN g p ON p.conv_id = m.conv_id AND p.d = m.d - 1 LEFT JOIN m q ON q.g = p.g),
k AS (SELECT up AS g, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT g.g, count(*) FILTER (k.g IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved
      FROM m JOIN g ON g.conv_id = m.conv_id AND g.d <= m.d LEFT JOIN k ON k.g = m.g GROUP BY 1),
l AS (SELECT conv_id, arg_max(g, d) AS g FROM g GROUP BY 1),
e AS (SELECT g, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM l GROUP BY 1)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u LEFT JOIN k USING (g) JOIN s USING (g) LEFT JOIN e USING (g)
""")
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixtrie.trie(table(spark, folder, "conversations"))


@bind("op12_fill_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""")
def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fillmiddle.report(table(spark, folder, "documents"))


@bind("op13_substrings", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, a, md5(array_to_string(w[a:a + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS a FROM d WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS low FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
h AS (SELECT DISTINCT doc_id, unnest(range(a, a + 50)) AS k FROM p JOIN m USING (g) WHERE doc_id > low),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
r AS (SELECT doc_id, count(*) AS n_words, count(h.k) AS n_removed, string_agg(word, ' ' ORDER BY x.k) FILTER (h.k IS NULL) AS kept
      FROM x LEFT JOIN h USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""")
def op13_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substring.report(table(spark, folder, "documents"))
