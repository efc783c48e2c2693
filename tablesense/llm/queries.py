"""Named queries of the operators in this package, and their oracle SQL.

``load()`` returns (queries, oracle): each query takes (spark, sf_dir) and
applies one operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.llm import bpe, chat, cube, exactdedup, fm, hostrep, langid, patience, plsh, resample, setjoin, variants, warc
from tablesense.llm.common import fold, narrow, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load():
    return QUERIES, ORACLE


# -- 1: URL filter ---------------------------------------------------------------

URL_RULES = [hostrep.Rule("block", "net", "/"), hostrep.Rule("allow", "example.net", "/en/"),
             hostrep.Rule("block", "example.com", "/de/"), hostrep.Rule("allow", "org", "/fr/")]


def _shrink_sql(name: str, source: str, p: hostrep.Reputation) -> str:
    """CTEs <name>_w (one weight) and <name> (alpha, beta) over ``source``
    (n, good, mu)."""
    return f"""
{name}_m AS (
  SELECT sum(n * pow(good / n - mu, 2)) AS s, sum(mu * (1 - mu)) AS v, sum(mu * (1 - mu) * (n - 1)) AS d
  FROM {source} WHERE n > 0),
{name}_w AS (
  SELECT CASE WHEN v IS NULL THEN {p.least_weight}
    ELSE greatest({p.least_weight}, least({p.most_weight},
      CASE WHEN d > 0 AND s > v THEN d / (s - v) - 1 ELSE {p.most_weight} END)) END AS w FROM {name}_m),
{name} AS (
  SELECT x.*, good + w * mu AS alpha, n - good + w * (1 - mu) AS beta FROM {source} x, {name}_w)"""


def _url_sql(p: hostrep.Reputation) -> str:
    longs = ", ".join(f"'{x}'" for x in hostrep.LONG_SUFFIXES)
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN i > 0 THEN substr(url, i + 3) ELSE '' END AS r
  FROM (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS i FROM pages)),
h AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
lab AS (
  SELECT doc_id AS id, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
hosts0 AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good
  FROM h LEFT JOIN lab ON lab.id = h.page_id GROUP BY host),
hosts1 AS (
  SELECT *, CASE WHEN list_contains([{longs}], array_to_string(list_slice(l, -2, -1), '.'))
                 THEN 2 ELSE 1 END AS k
  FROM (SELECT *, string_split(host, '.') AS l FROM hosts0)),
hosts AS (
  SELECT host, n, good, array_to_string(list_slice(l, -least(k, len(l)), -1), '.') AS suffix,
         array_to_string(list_slice(l, -least(k + 1, len(l)), -1), '.') AS domain FROM hosts1),
suf AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good,
         (SELECT (coalesce(sum(good), 0) + {p.root_good}) / (coalesce(sum(n), 0) + {p.root_good + p.root_bad}) FROM hosts) AS mu
  FROM hosts GROUP BY suffix),
{_shrink_sql("sufs", "suf", p)},
dom AS (
  SELECT d.*, s.alpha / (s.alpha + s.beta) AS mu
  FROM (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL) d JOIN sufs s USING (suffix)),
{_shrink_sql("doms", "dom", p)},
hst AS (
  SELECT h.*, d.alpha / (d.alpha + d.beta) AS mu FROM hosts h JOIN doms d USING (suffix, domain)),
{_shrink_sql("hsts", "hst", p)},
rep AS (
  SELECT host, n::BIGINT AS n, 1 / (1 + exp(-(ln(alpha / beta) + {p.z} * sqrt(1 / alpha + 1 / beta)))) AS bound FROM hsts),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}) t(verdict, host, path)),
hit AS (
  SELECT h.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM h) h
  JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
  GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, hit.rule,
       coalesce(hit.verdict, CASE WHEN rep.bound >= {p.min_rate} THEN 'allow' ELSE 'block' END) AS verdict,
       rep.n AS n, round(rep.bound, 6) AS bound
FROM h JOIN rep USING (host) LEFT JOIN hit USING (page_id)"""


@query("op1_url_filter", _url_sql(hostrep.Reputation()))
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rules and its host's reputation. A page's
    outcome is the label row of the same id: good if quality 1 and not toxic."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    lab = read(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("id"), good.alias("good"))
    out = hostrep.url_filter(read(spark, sf_dir, "pages"), lab, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.col("n").cast("long").alias("n"), F.round("bound", 6).alias("bound"))


# -- 2: license scan ---------------------------------------------------------------


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best license match of every text: doc_id, license, coverage, first_word,
    last_word, n_matches, licenses (of all matches, in order)."""
    out = patience.scan_licenses(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "license", "coverage", "first_word", "last_word", F.size("matches").cast("long").alias("n_matches"),
                      F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"))


# -- 3: n-gram Jaccard join -----------------------------------------------------------


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of texts linked by at least 90 % of their 3-word shingles."""
    return setjoin.jaccard_join(read(spark, sf_dir, "documents"), k=3, p=90, q=100)


# -- 4: toxicity ------------------------------------------------------------------------


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text; labels of held-out ids are not learnt from."""
    docs = read(spark, sf_dir, "documents")
    held = fold("doc_id", 3, 1)
    lab = read(spark, sf_dir, "labels").where(~held).select(F.col("doc_id").alias("id"), "toxic")
    model = fm.train(docs, lab)
    out = fm.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", fm.toxic(F.col("score")).alias("predicted"))


# -- 5: language ID -----------------------------------------------------------------------


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; held-out rows are not learnt from."""
    docs = read(spark, sf_dir, "documents")
    held = fold("doc_id", 4, 2)
    model = langid.train(docs.where(~held))
    return langid.identify(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


# -- 6: near-duplicate vectors ----------------------------------------------------------------


@query("op6_embedding_dedup")
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of vectors of one label linked by cosine 0.93 or more."""
    return plsh.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.93)


# -- 7: source mixing -------------------------------------------------------------------------


@query("op7_source_mix")
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of 150 % of all words."""
    out = cube.mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return narrow(out.select("doc_id", "size", "source_size", "target", "taken"))


# -- 8: chat formatting ------------------------------------------------------------

NASTY = "\\### Assistant: </turn> ok"


@query("op8_chat_format", """
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\\', ''))
    + (length(text) - length(replace(text, '### ', ''))) // 4
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + (length(text) - length(replace(text, '<|', ''))) // 2 AS escaped,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM m)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn)) AS loss_sha256,
       sum(4 + length(role) + 2 + escaped + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and conversation -7; read back turns and the
    text under the loss mask from the formatted text."""
    talk = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(NASTY).alias("text"))
    out = chat.chat_format(talk.unionByName(extra).withColumn("parts", chat.text_part(F.col("text"))))
    line = lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))
    out = (out.withColumn("turns", chat.parse(F.col("formatted")))
           .withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_spans"))))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


# -- 9: exact deduplication ----------------------------------------------------------


@query("op9_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts of all documents; the largest doc_id stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exactdedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# -- 10: byte-level BPE ----------------------------------------------------------------


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the public multilingual ranks."""
    path, pattern = bpe.public_vocabulary()
    return bpe.bpe(read(spark, sf_dir, "documents"), path, pattern, keep_ids=False, keep_decoded=False, keep=["doc_id"])


# -- 11: WARC ------------------------------------------------------------------------------


@query("op11_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, strlen(h)::BIGINT AS n, max(page_id) OVER (PARTITION BY h) AS top, count(*) OVER (PARTITION BY h) AS same,
  row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS r FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND same > 1 AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND same > 1 AND r > 1 THEN top END AS refers_to FROM g""")
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back, and say what each record holds."""
    pages = read(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return warc.round_trip(pages).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


# -- 12: importance resampling -----------------------------------------------------------------

# crc32 in SQL: the table of the reflected polynomial, applied byte by byte.
CRC_TABLE = """crc AS (SELECT list(list_reduce([b, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab
  FROM (SELECT range AS b FROM range(256)))"""


def _crc(text: str) -> str:
    """crc32 of a text's UTF-8 bytes; crc.tab must be in scope."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RESAMPLE_SQL = f"""
WITH {CRC_TABLE},
w AS (SELECT 'd' AS side, doc_id AS id, rowid AS row, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents_r
  UNION ALL SELECT 'b', NULL, rowid, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark_r),
fs AS (SELECT f, {_crc("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM w), crc),
n AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM w JOIN fs USING (f) GROUP BY b),
sums AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM n),
gain AS (SELECT b, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS g FROM n, sums),
d AS (SELECT row, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
  FROM w JOIN fs USING (f) JOIN gain USING (b) WHERE side = 'd' GROUP BY row),
sc AS (SELECT r.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, r.rowid AS row,
    ('0x' || substr(sha256('2024:' || coalesce(r.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents_r r LEFT JOIN d ON d.row = r.rowid),
sd AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM sc),
rk AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank, count(*) OVER () AS n FROM sd WHERE n_features >= 20)
SELECT sd.doc_id, n_features, weight, score, CASE WHEN rk.rank <= 10 * rk.n // 100 THEN rk.rank END::BIGINT AS rank
FROM sd LEFT JOIN rk USING (row)""".replace("WITH crc", """WITH documents_r AS (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents),
benchmark_r AS (SELECT row_number() OVER () AS rowid, text FROM benchmark),
crc""", 1)


@query("op12_resample", RESAMPLE_SQL)
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw 10 % of the documents of 20 words or more, towards the benchmark's words."""
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024,
                             buckets=10_000, max_n=1).select("doc_id", "n_features", "weight", "score", "rank")


# -- 13: spelling variants ---------------------------------------------------------------------

VARIANTS_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT i, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS i, {LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, n, {_crc("x")} AS h FROM (SELECT run, n, i || ':' || run AS x FROM r), crc),
e AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS MATERIALIZED (SELECT DISTINCT word, n, u.i, substr(word, 1, u.i) || substr(word, u.i + 2) AS cut FROM v, unnest(range(length(word))) AS u(i)),
p AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, v.n, k.word, k.n FROM v JOIN k ON k.cut = v.word
  UNION SELECT k.word, k.n, v.word, v.n FROM v JOIN k ON k.cut = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, row(-near_n, near)) AS best, max(near_n) AS best_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM v LEFT JOIN b USING (word)),
c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM f JOIN c USING (word) JOIN f AS z ON z.word = c.root AND z.form IS NULL"""


@query("op13_spelling_variants", VARIANTS_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, one run in 97 cut by a letter, with their near words, forms and roots."""
    return variants.spelling_variants(read(spark, sf_dir, "documents"), least_length=5, least_count=3, ratio=2, drop_every=97).select(
        "word", "form", "root", "n", "n_near", "form_n")
