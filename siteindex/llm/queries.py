"""The registered queries of these operators and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteindex.llm import (
    ann,
    chat,
    decontaminate,
    divergence,
    line_dedup,
    mixing,
    prefix_trie,
    quality,
    sharding,
    simhash,
    substring,
    tokens,
    toxicity,
)
from siteindex.llm.common import LOWER, UPPER, table
from siteindex.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; it is installed where the workers run."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return tokens.read_tokens(tokens.write_tokens(docs, tokenizer_file("word_bpe_49k.json")))


@query
def op2_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op2_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
),
lines AS (
  SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM split
),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.keeper AS dropped
  FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_decontaminate(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items)


@query
def op5_chat(spark, sf_dir):
    return chat.chat_texts(table(spark, sf_dir, "conversations"))


ORACLES["op5_chat"] = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
wholes AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn) AS said,
         count(*) AS n_turns
  FROM turns GROUP BY conv_id
),
prefixes AS (
  SELECT DISTINCT said[1:k] AS said
  FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM wholes)
),
kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_equal
  FROM wholes WHERE said NOT IN (SELECT said FROM prefixes) GROUP BY said, n_turns
),
placed AS (
  SELECT t.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM turns t
)
SELECT conv_id, n_turns, n_equal, place // 1024 AS part,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '')
                  || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, n_turns, n_equal, place // 1024
"""


@query
def op6_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0)


#: Domains of the labelled table, and the share of tokens that each is to have.
TARGETS = {"prose": 0.85, "poor": 0.08, "toxic": 0.07}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """A domain for each labelled document: toxic, else by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "prose")
    return labels.select("doc_id", domain.when(F.col("quality") == 0, "poor").alias("domain"))


@query
def op7_mixing(spark, sf_dir):
    labelled = labelled_domains(table(spark, sf_dir, "labels"))
    rates = mixing.mixture(table(spark, sf_dir, "documents"), labelled, TARGETS)
    return mixing.mixed_report(rates, TARGETS)


@query
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", quality.held_out().alias("held_out"), quality.score(docs, model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query
def op9_substring_dedup(spark, sf_dir):
    kept = substring.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op9_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
  SELECT doc_id, s, array_to_string(words[s + 1:s + 20], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS s FROM split WHERE len(words) >= 20)
),
repeated AS (
  SELECT doc_id, s FROM windows
  QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, s) > 1
),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS place FROM repeated),
placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM split
),
kept AS (SELECT * FROM placed ANTI JOIN covered USING (doc_id, place)),
joined AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM kept GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN joined USING (doc_id)
"""


@query
def op10_sharding(spark, sf_dir):
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


@query
def op11_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_divergence"] = rf"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         row_number() OVER () AS number
  FROM documents
),
words AS (
  SELECT lang, source, number,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                   '{UPPER}', '{LOWER}') AS term
  FROM docs
),
kept AS (
  SELECT lang, term, count(*) AS n FROM words
  GROUP BY lang, term HAVING count(DISTINCT number) >= 3
),
counted AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term)
  GROUP BY ALL
),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
sources AS (
  SELECT d.lang, d.source, coalesce(max(l.v), 0) AS v, coalesce(max(c.total), 0) AS total
  FROM docs d LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL) c
    ON c.lang = d.lang AND c.source = d.source
  GROUP BY d.lang, d.source
),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.total + s.v))::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v))::HUGEINT AS q
  FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(value), 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
    GROUP BY ALL
  ) t ON t.lang = a.lang AND t.source = a.source AND t.item = b.source
  GROUP BY ALL
),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares
  WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER
    AS rank
  FROM parts
)
WHERE part = 'pair' OR rank <= 200
"""


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = """
WITH owned AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(10) || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
crc_table AS (
  SELECT k, list_reduce(
    list_prepend(k, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  ) AS c
  FROM (SELECT unnest(range(256)) AS k)
),
crcs AS (SELECT list(c ORDER BY k) AS t FROM crc_table),
hashed AS (
  SELECT conv_id, own, xor(list_reduce(
    list_prepend(4294967295::BIGINT,
                 list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])
  ), 4294967295) % 6 AS h
  FROM owned, crcs
),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS said
  FROM hashed c LEFT JOIN owned b ON b.conv_id = c.conv_id - c.conv_id % 100
),
members AS (
  SELECT conv_id, said[1:d] AS prefix, d, len(said) AS n
  FROM (SELECT conv_id, said, unnest(range(len(said) + 1)) AS d FROM built)
),
nodes AS (
  SELECT prefix, d, min(conv_id) AS conv, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), ''))
           AS ends
  FROM members GROUP BY prefix, d
),
edges AS (
  SELECT c.*, p.conv AS parent FROM nodes c LEFT JOIN nodes p ON c.d > 0 AND p.prefix = c.prefix[1:c.d - 1]
),
full_nodes AS (
  SELECT e.*, count(k.d) AS children FROM edges e
  LEFT JOIN edges k ON k.d = e.d + 1 AND k.parent = e.conv GROUP BY ALL
),
above AS (
  SELECT prefix[1:a] AS prefix, children = 0 AS leaf,
         CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[d].t) END AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes)
),
sums AS (
  SELECT prefix, count(*) FILTER (leaf) AS leaves, sum(saved) AS saved FROM above GROUP BY prefix
)
SELECT conv AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, children AS n_children,
       leaves AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM full_nodes JOIN sums USING (prefix)
"""


@query
def op13_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", toxicity.held_out().alias("held_out"), toxicity.score(docs, model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))
