"""The registered queries of these operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from playtrail.llm import (
    alignment,
    ann,
    bpe,
    credentials,
    decontaminate,
    hardnegatives,
    langid,
    pii,
    revisits,
    shards,
    simhash,
    tokenfile,
    urltree,
)
from playtrail.llm.shared import table
from playtrail.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_decontaminate_tiling(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"),
                        F.size("tiles").cast("bigint").alias("n_tiles"))


@query
def op2_token_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    tokenfile.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op4_nearest_by_collisions(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_warc_revisits(spark, sf_dir):
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical", "ts", "outcome", "full_id",
                        revisits.header_text(F.col("headers")).alias("headers"))


_CAPTURES = """c AS (
  SELECT page_id * 4 + visit AS record_id, page_id % 1000 + page_id % 7 + visit * 1000 AS ts, visit, page_id,
    (visit = 0 AND page_id % 11 <> 0) OR (visit = 2 AND page_id % 5 = 0) AS full_response,
    CASE WHEN visit >= 2 AND page_id % 5 = 0 THEN 1 ELSE 0 END AS version,
    split_part(url, '#', 1) AS base, regexp_extract(url, '(?s)#.*') AS fragment, url, html
  FROM pages CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS visit)),
d AS (
  SELECT *, '"' || md5(html || version) || '"' AS tag,
    CASE visit WHEN 1 THEN base || '#again' WHEN 2 THEN regexp_replace(url, '^https?://', 'HTTP://')
      WHEN 3 THEN base || CASE WHEN contains(base, '?') THEN '&' ELSE '?' END || 'utm_campaign=x' || fragment ELSE url END AS seen,
    CASE WHEN page_id % 2 = 0 THEN 'day ' || version END AS modified FROM c),
e AS (
  SELECT *, regexp_replace(regexp_replace(seen, '(?s)#.*', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
    CASE WHEN page_id % 13 = 0 THEN NULL WHEN visit = 3 AND page_id % 7 = 0 THEN '"other"'
      WHEN visit = 3 AND page_id % 3 = 0 THEN 'W/' || tag ELSE tag END AS etag FROM d),
f AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?]*\\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS params FROM e),
g AS (
  SELECT record_id, ts, full_response, etag, modified, ts::HUGEINT * 1000000000000 + record_id AS place,
    host || CASE WHEN path = '' THEN '/' ELSE path END
      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical,
    ts::VARCHAR AS h_date, CASE WHEN visit <> 1 THEN 'max-age=' || visit * 60 END AS h_cache,
    CASE WHEN full_response THEN length(html)::VARCHAR END AS h_length,
    CASE WHEN full_response THEN 'text/html' WHEN page_id % 4 = 0 THEN 'text/plain' END AS h_type,
    CASE WHEN visit = 2 THEN 'a=b' END AS h_cookie, CASE WHEN visit = 3 THEN 'accept' END AS h_vary FROM f)"""

ORACLES["op5_warc_revisits"] = f"""WITH {_CAPTURES},
j AS (
  SELECT r.*, o.record_id AS full_id, CASE WHEN o.record_id IS NULL THEN 'missing'
      WHEN r.etag IS NOT NULL AND o.etag IS NOT NULL THEN
        CASE WHEN regexp_replace(r.etag, '^W/', '') = regexp_replace(o.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
      WHEN r.modified IS NOT NULL AND o.modified IS NOT NULL THEN
        CASE WHEN r.modified = o.modified THEN 'resolved' ELSE 'mismatch' END
      ELSE 'unverified' END AS outcome,
    concat_ws(chr(10), 'cache-control: ' || coalesce(r.h_cache, o.h_cache), 'content-length: ' || o.h_length,
      'content-type: ' || o.h_type, 'date: ' || coalesce(r.h_date, o.h_date), 'etag: ' || coalesce(r.etag, o.etag),
      'last-modified: ' || coalesce(r.modified, o.modified), 'set-cookie: ' || o.h_cookie,
      'vary: ' || coalesce(r.h_vary, o.h_vary)) AS merged
  FROM (SELECT * FROM g WHERE NOT full_response) r
  ASOF LEFT JOIN (SELECT * FROM g WHERE full_response) o ON r.canonical = o.canonical AND r.place > o.place)
SELECT record_id, canonical, ts, outcome, full_id, CASE WHEN outcome IN ('resolved', 'unverified') THEN merged END AS headers
FROM j"""


# The fixed rules of the query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op6_url_template_tree(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urltree.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def _url_sql() -> str:
    """The query above in DuckDB, level by level."""
    names = [f"s{i}" for i in range(urltree.DEPTH)]

    def shaped(s):
        return (f"CASE WHEN regexp_full_match({s}, '[0-9]+') THEN '<n>' "
                f"WHEN regexp_full_match({s}, '[0-9]+\\.[A-Za-z0-9]+') THEN '<n>.' || regexp_extract({s}, '\\.([^.]*)$', 1) "
                f"WHEN regexp_matches({s}, '[0-9]') THEN '<id>' ELSE {s} END")

    columns = [f"{shaped(f'parts[{i + 1}]')} AS s{i}" for i in range(urltree.DEPTH - 1)]
    columns.append(f"CASE WHEN len(parts) > {urltree.DEPTH} THEN '**' ELSE {shaped(f'parts[{urltree.DEPTH}]')} END AS s{urltree.DEPTH - 1}")
    rules = ""
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        host, slash, rest = rule.partition("/")
        rules += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{rest}') THEN '{rule}'"
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in URL_RULES)
    parts = [f"""u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      '{urltree._UPPER}', '{urltree._LOWER}') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)""",
             f"""r AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts, CASE{rules} END AS rule FROM u)""",
             f"""v AS (SELECT *, CASE rule {verdicts} END AS given, {", ".join(columns)} FROM r)""",
             f"""t0 AS (SELECT host, {", ".join(names)}, count(*) AS urls, count(given) AS labelled,
      count_if(given = 'block') AS bad, '' AS node FROM v GROUP BY ALL)"""]
    for i, name in enumerate(names):
        share = "(nb / nullif(nl, 0))"
        parts += [
            f"b{i} AS (SELECT host, node, {name}, sum(urls) AS urls, sum(labelled) AS labelled, sum(bad) AS bad FROM t{i} GROUP BY ALL)",
            f"w{i} AS (SELECT host, node, sum(labelled) AS nl, sum(bad) AS nb FROM b{i} GROUP BY ALL)",
            f"""j{i} AS (SELECT b.host, b.node, b.{name} AS seg, CASE WHEN b.{name} IS NULL THEN '' WHEN urls < {urltree.SUPPORT} THEN
        CASE WHEN labelled > 0 THEN '/*' ELSE '/?' END
      WHEN labelled < nl AND nb BETWEEN 1 AND nl - 1 AND
        coalesce(abs(bad / nullif(labelled, 0) - {share}) <= {urltree.DEVIATIONS} * sqrt({share} * (1 - {share}) / nullif(labelled, 0)), false)
      THEN '/+' ELSE '/' || b.{name} END AS step FROM b{i} b JOIN w{i} w ON b.host = w.host AND b.node = w.node)""",
            f"""t{i + 1} AS (SELECT t.* REPLACE (t.node || j.step AS node) FROM t{i} t JOIN j{i} j
      ON t.host = j.host AND t.node = j.node AND t.{name} IS NOT DISTINCT FROM j.seg)"""]
    unknown = f"((n.urls - n.labelled) * {urltree.UNLABELLED})"
    last, same = f"t{urltree.DEPTH}", " AND ".join(f"v.{n} IS NOT DISTINCT FROM t.{n}" for n in names)
    parts.append(f"n AS (SELECT host, node, sum(urls) AS urls, sum(labelled) AS labelled, sum(bad) AS bad FROM {last} GROUP BY ALL)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.page_id, v.host, v.path, v.rule, t.node AS template,
  coalesce(v.given, CASE WHEN (n.bad + {unknown} / 2 + 1) / (n.labelled + {unknown} + 2) > {urltree.REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM v JOIN {last} t ON v.host = t.host AND {same} JOIN n ON n.host = t.host AND n.node = t.node"""


ORACLES["op6_url_template_tree"] = _url_sql()


def _shown(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _counted(spans, kinds):
    def of(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return [of(k) for k in kinds]


@query
def op7_pii_bilstm_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", *_counted("base", pii.KINDS), F.sha2(_shown("base"), 256).alias("base_sha256"),
                        _shown(pii.all_spans()).alias("spans"))


@query
def op8_secret_linking(spark, sf_dir):
    found = credentials.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_counted("base", credentials.KINDS[:3]), F.sha2(_shown("base"), 256).alias("base_sha256"),
                        _shown(credentials.all_spans()).alias("spans"))


@query
def op9_simhash_near_duplicates(spark, sf_dir):
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_of(groups["fp"]).alias("fingerprint"), "component_id")


@query
def op10_byte_level_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN)
    return found.select(
        "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_tokenizer_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


@query
def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.when(finite, F.transform(values, lambda x: F.floor(x * 256)))
    rows = rows.select("vec_id", label.alias("label"), whole.alias("vec"))
    return hardnegatives.mine(rows, F.col("vec_id") % 50 == 0)


ORACLES["op12_hard_negatives"] = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS positive, list_inner_product(a.vec, r.vec)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT * FROM s WHERE positive QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.positive AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""


@query
def op13_shuffled_shards(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "shards")
    shards.write_shards(docs, path, 24)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return shards.read_shards(spark, path, docs.schema).select(
        "record.doc_id", F.col("bytes").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
