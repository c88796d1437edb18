"""The registered queries of the training-data operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.bpe import bpe_decode, bpe_encode
from pulseloom.llm.common import LOWER_AZ, UPPER_AZ, table
from pulseloom.llm.exact_dedup import exact_dedup
from pulseloom.llm.html_wrapper import extract_main_text
from pulseloom.llm.line_dedup import line_dedup
from pulseloom.llm.ngram_join import ngram_jaccard_join
from pulseloom.llm.packing import pack
from pulseloom.llm.quality_rules import quality_rules
from pulseloom.llm.secrets import scan_secrets
from pulseloom.llm.toxicity import learn, toxicity
from pulseloom.llm.url_filter import url_filter

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Rules of the URL filter: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_spec(path: str = TOKENIZER) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_spec())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, *learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = tokenizer_spec()
    decoded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), spec), spec)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def secrets_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op4, which SQL can express."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op10, which SQL can express."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_main_text": op2_main_text,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
    "secrets_counts": secrets_counts,
    "quality_base": quality_base,
}

#: White space of the contracts, and words between it, in SQL.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"[^\x20\x09-\x0D]+"

SQL = {
    "op1_ngram_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '{_WORDS}') AS w FROM documents),
        sets AS (SELECT rn, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
        nodes AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY ALL),
        held AS (SELECT node, n, unnest(s) AS g FROM nodes),
        pairs AS (SELECT a.node AS a, b.node AS b FROM held a JOIN held b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a AS node, least(a, min(b)) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE coalesce(least.component_id, nodes.node) END AS component_id
        FROM sets LEFT JOIN nodes ON nodes.s = list_sort(sets.s) LEFT JOIN least ON least.node = nodes.node""",
    "secrets_counts": r"""
        SELECT doc_id, len(list_filter(regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
            len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "quality_base": f"""
        WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT rn, doc_id, t, regexp_extract_all(t, '{_WORDS}') AS w FROM d),
        u AS (SELECT rn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
        g AS (SELECT rn, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY rn ORDER BY i)),
        k AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, a, b, c) AS times FROM g WHERE c IS NOT NULL),
        r AS (SELECT rn, count(DISTINCT i + o) AS n FROM k, range(3) AS r(o) WHERE times > 1 GROUP BY rn),
        x AS (SELECT rn, unnest(string_split(t, chr(10))) AS line FROM d), l AS (SELECT rn, count(*) - count(DISTINCT line) AS n FROM x WHERE regexp_matches(line, '{_WORDS}') GROUP BY rn),
        f AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN l USING (rn) LEFT JOIN r USING (rn))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f""",
    "op5_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, rn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM (SELECT doc_id, text, row_number() OVER () AS rn FROM documents)),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER_AZ}', '{LOWER_AZ}') AS k FROM lines),
        common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rn) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common c USING (k) GROUP BY rn, doc_id""",
    "op7_url_filter": """
        WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        rest AS (SELECT page_id, row_number() OVER () AS rn, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT page_id, rn, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        fits AS (SELECT rn, u.host || u.path AS rule, u.verdict, row_number() OVER (PARTITION BY rn ORDER BY length(u.host) + length(u.path) DESC, length(u.host) DESC) AS k
            FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (rn)""",
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}') AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
}
