"""One query per operator over its whole table, and the DuckDB text where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The tokenizer that op1 and the pipeline use; another file may be given to the operator.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_bpe_encode_decode")
def bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import bpe

    return bpe.digest(bpe.encode_documents(table(spark, folder, "documents"), tokenizer_path()))


#: The URL rules of op5: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query(
    "op5_url_filter",
    """
    WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    placed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    places AS (SELECT DISTINCT host, path FROM placed),
    hits AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
             FROM places JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
    SELECT page_id, placed.host, placed.path, rule, coalesce(verdict, 'allow') AS verdict FROM placed LEFT JOIN hits ON placed.host = hits.host AND placed.path = hits.path
    """,
)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import url_rules

    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_rules.filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op7_host_rules",
    r"""
    WITH split AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    lines AS (SELECT doc_id, sum(n - 1) AS again FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
    tokens AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM split),
    windows AS (SELECT doc_id, i, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
    covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM counted, (VALUES (0), (1), (2)) AS t(j) WHERE n > 1 GROUP BY doc_id),
    base AS (
      SELECT split.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(again, 0) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM split LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
    hosts AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS f FROM judged GROUP BY source),
    spread AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS v FROM hosts),
    prior AS (SELECT m, greatest(1.0, least(1000.0, CASE WHEN v > 1e-9 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS w FROM spread),
    verdicts AS (SELECT source, (f + m * w) / (n + w) <= 0.8 AS host_kept FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
    FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
    """,
)
def host_rules(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import host_rules as rules

    judged = rules.judge_documents(table(spark, folder, "documents"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept")


@query("op2_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import quality

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.train(docs, labels)
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op9_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import languages

    docs = table(spark, folder, "documents")
    return languages.identify(docs, languages.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


@query(
    "op8_near_duplicates",
    r"""
    WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    tokens AS (SELECT doc_id, len(words) AS n, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM split),
    wide AS (SELECT doc_id, a || ' ' || lead(a) OVER w || ' ' || lead(a, 2) OVER w || ' ' || lead(a, 3) OVER w || ' ' || lead(a, 4) OVER w AS shingle FROM tokens WHERE n >= 5 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    shingles AS (SELECT DISTINCT doc_id, shingle FROM wide WHERE shingle IS NOT NULL UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM split WHERE len(words) BETWEEN 1 AND 4),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a),
    least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.other, d.doc_id) AS kept
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
    """,
)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import near_duplicates as near

    return near.near_duplicates(table(spark, folder, "documents"), percent=85)


@query("op4_toxicity")
def toxicity_score(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import toxicity

    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels"))).select("doc_id", "held_out", "score", "predicted")


@query(
    "op10_line_dedup",
    r"""
    WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
    counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines),
    placed AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS BIGINT) AS start FROM counted WHERE words > 0),
    ahead AS (SELECT doc_id, pos, max(pos) OVER w AS last, list(line) OVER w AS run, sum(words) OVER w AS total FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
    back AS (SELECT doc_id, min(pos) OVER w AS pos, pos AS last, list(line) OVER w AS run, sum(words) OVER w AS total FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY start + words RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
    runs AS (SELECT * FROM ahead WHERE total >= 50 UNION SELECT * FROM back WHERE total >= 50),
    whole AS (SELECT *, first_value(doc_id) OVER f AS held_doc, first_value(pos) OVER f AS held_pos, first_value(last) OVER f AS held_last FROM runs WINDOW f AS (PARTITION BY run ORDER BY doc_id, pos)),
    spans AS (SELECT doc_id, CASE WHEN doc_id = held_doc THEN greatest(pos, held_last + 1) ELSE pos END AS first, last FROM whole WHERE doc_id <> held_doc OR pos <> held_pos),
    gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(first, last + 1)) AS pos FROM spans)),
    kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS text, count(gone.pos) AS removed_lines FROM lines l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(removed_lines, 0) AS INT) AS removed_lines FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
    """,
)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import line_dedup as lines

    return lines.remove_repeated_lines(table(spark, folder, "documents")).select("doc_id", "text", "removed_lines")


@query(
    "op3_embedding_near_dedup",
    """
    WITH RECURSIVE numbers AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    usable AS (SELECT vec_id, label, v FROM numbers WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
    reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
    least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
    counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.other, e.vec_id)) AS component_id, e.vec_id <= coalesce(l.other, e.vec_id) AS kept
    FROM embeddings e LEFT JOIN counts c ON c.vec_id = e.vec_id LEFT JOIN least l ON l.vec_id = e.vec_id
    """,
)
def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import embeddings

    return embeddings.near_embeddings(table(spark, folder, "embeddings"))


@query("op6_mix_to_targets")
def mix_to_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Domains are languages: the sources of these tables do not differ in their words."""
    from assayloom.llm import mixing

    docs = table(spark, folder, "documents")
    return mixing.rate_documents(docs, docs, "lang")


@query("op11_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files go to a new folder beside the checkpoints and are read back from there."""
    from assayloom.llm import token_files as files
    from assayloom.session import shared_folder

    target = shared_folder(spark, "tokens")
    files.write_tokens(table(spark, folder, "documents"), target, tokenizer_path())
    read = files.read_tokens(spark, target)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@query(
    "op12_filter_audit",
    r"""
    WITH base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    tested AS (SELECT doc_id, part, CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT)
                      + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask FROM base),
    marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
    masks AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM tested LEFT JOIN marks ON marks.doc_id = tested.doc_id GROUP BY ALL),
    letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    steps AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) t(step)),
    summed AS (
      SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM masks, steps GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM summed
    """,
)
def filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import filter_audit as audit

    return audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op13_conversation_repair",
    r"""
    WITH RECURSIVE bytes AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)),
    told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS signs FROM conversations),
    drawn AS (SELECT told.*, xor(list_reduce(list_concat([4294967295], list_transform(signs, lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(crc[CAST((xor(c, b) & 255) + 1 AS INT)], c >> 8)), 4294967295) % 20 AS draw FROM told, bytes),
    damaged AS (SELECT conv_id AS conv, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE draw WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE draw <> 0),
    numbered AS (SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 AS again, ini || lead(ini) OVER (PARTITION BY conv ORDER BY k) AS pair FROM numbered),
    rows AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN again THEN 2 WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM seen),
    ins(f, t, price, letters, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'),
      (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
    edits(f, t, kind, ini, given) AS (VALUES (0, 0, 'D', '', ''), (1, 1, 'D', '', ''), (2, 2, 'D', '', ''), (3, 3, 'D', '', ''), (0, 1, 'K', 's', ''), (0, 2, 'K', 'u', ''), (1, 2, 'K', 'u', ''), (2, 3, 'K', 'a', ''), (3, 2, 'K', 'u', ''),
      (0, 2, 'R', 'u', 'user'), (1, 2, 'R', 'u', 'user'), (2, 3, 'R', 'a', 'assistant'), (3, 2, 'R', 'u', 'user')),
    convs AS (SELECT DISTINCT conv_id AS conv FROM conversations),
    reach AS (
      SELECT conv, CAST(0 AS BIGINT) AS k, 0 AS state, {'cost': 0, 'audit': '', 'text': ''} AS best FROM convs
      UNION ALL
      SELECT r.conv, d.k, e.t, min({'cost': r.best.cost + i.price + CASE e.kind WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN d.fault = 3 AND e.kind <> 'D' THEN 5 ELSE 0 END, 'audit': r.best.audit || i.letters || e.kind,
                                   'text': r.best.text || i.lines || CASE e.kind WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || d.role || ':' || d.text ELSE chr(10) || e.given || ':' || d.text END})
      FROM reach r JOIN rows d ON d.conv IS NOT DISTINCT FROM r.conv AND d.k = r.k + 1 JOIN ins i ON i.f = r.state
      JOIN edits e ON e.f = i.t AND (e.kind = 'D' OR d.fault IN (0, 3) AND (e.kind = 'K' AND e.ini = d.ini OR e.kind = 'R' AND e.ini <> d.ini))
      GROUP BY r.conv, d.k, e.t),
    counts AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
                      count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv),
    ends AS (SELECT c.conv, min({'cost': r.best.cost + i.price, 'audit': r.best.audit || i.letters, 'text': r.best.text || i.lines}) AS best
             FROM convs c LEFT JOIN counts n ON n.conv IS NOT DISTINCT FROM c.conv JOIN reach r ON r.conv IS NOT DISTINCT FROM c.conv AND r.k = coalesce(n.n, 0) JOIN ins i ON i.f = r.state AND i.t IN (0, 3) GROUP BY c.conv)
    SELECT e.conv AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substr(best.text, 2)) AS repaired_sha256
    FROM ends e LEFT JOIN counts n ON n.conv IS NOT DISTINCT FROM e.conv
    """,
)
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from assayloom.llm import conversations

    return conversations.repair_damaged(table(spark, folder, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
