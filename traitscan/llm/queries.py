"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscan.llm import langid, linededup, urlfilter
from traitscan.llm.alignment import cross_token_links
from traitscan.llm.bpe import encode_documents
from traitscan.llm.editcounts import edited_counts, hashed_edits
from traitscan.llm.embeddings import near_vectors
from traitscan.llm.minhash import near_duplicates
from traitscan.llm.negatives import mine_hard_negatives
from traitscan.llm.packing import pack_documents
from traitscan.llm.records import read_token_records, write_token_records
from traitscan.llm.search import bm25_search, build_index
from traitscan.llm.sharding import histogram_shards
from traitscan.tables import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def word_bpe_path() -> str:
    return tokenizer_path("word_bpe_49k.json")


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every document whose id 100 divides, by its whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index, n, mean = build_index(docs)
    found = bm25_search(index, n, docs.where("doc_id % 100 = 0"), k=10, query_id="doc_id", mean=mean)
    return found.withColumn("score", F.round("score", 6))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return histogram_shards(docs, 24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", hashed_edits())
    return edited_counts(docs, word_bpe_path())


#: Share of a site's pages from which on a line is boilerplate, and the fewest pages.
BOILERPLATE_RATIO, BOILERPLATE_PAGES = 0.1, 3
#: The share as measured: see "Line ratios" in the README. op4_line_dedup keeps the ratio of its SQL.
SITE_LINE_RATIO = 0.01


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs, BOILERPLATE_RATIO, BOILERPLATE_PAGES)


def op4_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that over 1 % of their source's documents hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs, SITE_LINE_RATIO, BOILERPLATE_PAGES)


#: The rules of the URL filter, as (verdict, rule).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The list of blocked sites, as such lists are published: advertising, spam, gambling, pills and adult sites.
BLOCKED_SITES = ["ads-track.example.com", "adult-x.example.net", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com"]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL: the longest rule's, else whether its site or its canonical URL is listed.

    The URLs of the list are those that serve a document labelled toxic.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    sites = urlfilter.site_table(spark, BLOCKED_SITES)
    toxic = urlfilter.pages_of_documents(pages, table(spark, sf_dir, "labels").where("toxic = 1"))
    listed = urlfilter.rule_table(spark, URL_RULES).select(*sites.columns).union(sites).union(toxic.select(*sites.columns))
    return urlfilter.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return encode_documents(table(spark, sf_dir, "documents"), word_bpe_path())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 4096 tokens; one row per piece."""
    return pack_documents(table(spark, sf_dir, "documents"), word_bpe_path(), window=4096, end_id=2)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: two-word shingles, similarity 0.8."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def held_out_third(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out_third(), F.lit(False)))
    prototypes = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs, prototypes, keep=["doc_id", "held_out"]).drop("likeness", "n_grams")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within each label, cosine 0.98 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every anchor of embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    component = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.floor(256 * x))
    rows = rows.select("vec_id", moved.alias("label"), F.transform(F.col("embedding").cast("array<double>"), component).alias("values"))
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0, id_col="vec_id", n_positives=5, n_negatives=10, low=30, high=90)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every document."""
    docs = table(spark, sf_dir, "documents")
    return cross_token_links(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record of token ids, written and read back."""
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    write_token_records(table(spark, sf_dir, "documents"), path, word_bpe_path(), end_id=2)
    return read_token_records(spark, path).select(F.col("key").cast("long").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_search": op1_search,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op4_site_lines": op4_site_lines,
    "op5_url_filter": op5_url_filter,
    "op9_language": op9_language,
    "op10_embeddings": op10_embeddings,
    "op8_minhash": op8_minhash,
    "op6_bpe": op6_bpe, "op7_packing": op7_packing,
    "op11_negatives": op11_negatives,
    "op12_alignment": op12_alignment,
    "op13_records": op13_records,
}
OP4_SQL = f"""
WITH l AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL),
c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL HAVING count(*) >= {BOILERPLATE_PAGES}),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
bad AS (SELECT c.source, list(line) AS lines FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n > pages * {BOILERPLATE_RATIO} GROUP BY ALL),
d AS (SELECT doc_id, documents.source, string_split(text, chr(10)) AS lines, coalesce(bad.lines, []) AS gone
      FROM documents LEFT JOIN bad ON documents.source IS NOT DISTINCT FROM bad.source),
k AS (SELECT doc_id, source, lines, list_filter(lines, lambda x: NOT list_contains(gone, x)) AS left_ FROM d)
SELECT doc_id, source, array_to_string(left_, chr(10)) AS text, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(left_), 0) AS n_dropped FROM k
"""

OP4_SITE_SQL = OP4_SQL.replace(f"n > pages * {BOILERPLATE_RATIO}", f"n > pages * {SITE_LINE_RATIO}")

OP5_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS pre FROM rules),
f AS (SELECT page_id, arg_max(rule, length(h) * 10000 + length(pre)) AS rule, arg_max(verdict, length(h) * 10000 + length(pre)) AS verdict
      FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY ALL),
t AS (SELECT DISTINCT regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') AS h, regexp_replace(path, '/+$', '') AS p FROM q
      WHERE host <> '' AND TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT q.page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN t.h IS NOT NULL OR regexp_matches(host, '(^|\.)(ads-track\.example\.com|adult-x\.example\.net|casino-win\.example\.com|cheap-pills\.example\.com|free-bets\.example\.com|spam-farm\.example\.com)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN f USING (page_id) LEFT JOIN t ON t.h = regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') AND t.p = regexp_replace(path, '/+$', '')
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20]+')"

OP1_SQL = f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM w GROUP BY ALL),
len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM len),
idf AS (SELECT t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY t, n),
s AS (SELECT q.doc_id AS query_id, tf.doc_id AS doc_id, sum(q.tf * idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
      FROM tf q JOIN tf USING (t) JOIN idf USING (t) JOIN len ON len.doc_id = tf.doc_id, n WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS k FROM s)
SELECT query_id, k AS rank, doc_id, round(score, 6) AS score FROM r WHERE k <= 10
"""

OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM w, (SELECT unnest(range(1, (SELECT max(len(w)) + 1 FROM w))) AS i) WHERE i < len(w) OR (len(w) = 1 AND i = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m ON id = doc_id
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY ALL), k AS (SELECT a, count(*) AS n FROM l GROUP BY ALL)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON id = vec_id LEFT JOIN k ON a = vec_id
"""

OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT::DOUBLE) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, s.b AS n, p.s AS ps, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, r::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10
"""

ORACLES: dict[str, str] = {"op1_search": OP1_SQL, "op4_line_dedup": OP4_SQL, "op4_site_lines": OP4_SITE_SQL, "op5_url_filter": OP5_SQL, "op8_minhash": OP8_SQL, "op10_embeddings": OP10_SQL, "op11_negatives": OP11_SQL}
