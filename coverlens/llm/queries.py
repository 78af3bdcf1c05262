"""One query per operator over its whole table, with SQL to compare with where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.llm import centroids, collocations, decontamination, embeddings, html, minhash, mixing, quality, secrets, sharding, suffixtree, urls, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_hypergeometric_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in 24 shards. No SQL: the draw is tested for its properties. A missing text has no CRC."""
    return sharding.shard(table(spark, sf, "documents"), 24).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """How many words the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op8_source_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), rounds AS (
  SELECT 0 AS step, source, source_size, cap, weight, false AS above, 0::DOUBLE AS share FROM sources
  UNION ALL
  SELECT step + 1, source, source_size, cap, weight, share2 * weight > cap, share2 FROM (
    SELECT *, (sum(source_size) OVER () - sum(CASE WHEN above THEN cap ELSE 0 END) OVER ())::DOUBLE
              / (sum(CASE WHEN above THEN 0 ELSE weight END) OVER ())::DOUBLE AS share2 FROM rounds WHERE step < 40)
), rates AS (
  SELECT source, source_size, CASE WHEN above THEN cap::DOUBLE ELSE share * weight END AS target,
         CASE WHEN source_size = 0 THEN 0 WHEN above THEN 3
              ELSE least(share * weight / source_size, 3) END::DOUBLE AS rate
  FROM rounds WHERE step = 40
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + (('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':mix')[1:13])::BIGINT::DOUBLE
                               / 4503599627370496 < rate - floor(rate))::INT))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""


@query
def op10_aho_corasick_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """What every document has of the benchmark."""
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op10_aho_corasick_decontamination"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, win)
), hits AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op5_hierarchical_bayes_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's evidence, site and verdict. No SQL: tested by held-out accuracy."""
    found = quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "evidence", "site_share", "quality_score", "accepted")


@query
def op7_minmax_hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's near-duplicate group."""
    found = minhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


# Connected components in SQL: the smallest id spreads over the links, one step per round, until nothing changes.
ORACLES["op7_minmax_hash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), groups AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN groups USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


@query
def op2_redirect_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's verdict."""
    pages = table(spark, sf, "pages")
    return urls.verdicts(pages, urls.page_edges(pages)).select("page_id", "host", "path", "rule", "verdict", "alias_of")


@query
def op3_page_differencing(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's main text. No SQL: tested on pages with known articles, and the alignment against brute force."""
    return html.extracted(table(spark, sf, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ORACLES["op2_redirect_equivalence"] = r"""
WITH split AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT *, translate(coalesce(regexp_extract(rest, '(?s)^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path,
         list_filter(string_split(regexp_extract(regexp_replace(rest, '(?s)#.*$', ''), '(?s)\?(.*)$', 1), '&'),
                     lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|gclid|fbclid|ref|source)(?:=|$)')) AS params FROM split
), named AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN 'https://' || regexp_replace(host, ':(?:80|443)$', '') || regexp_replace(path, '/+$', '')
                 || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canon,
         regexp_replace(host, ':(?:80|443)$', '') AS canon_host, regexp_replace(path, '/+$', '') AS canon_path FROM parts
), ruled AS (
  SELECT *, {own} AS rule, {canon} AS canon_rule FROM named
), groups AS (
  SELECT canon, CASE WHEN bool_or(url <> canon) THEN least(canon, min(url)) END AS alias_of,
         bool_or(url <> canon) AND bool_or(coalesce(rule LIKE 'example%' OR rule = 'com/de/', false)
                                           OR coalesce(canon_rule LIKE 'example%' OR canon_rule = 'com/de/', false)) AS hit
  FROM ruled WHERE canon IS NOT NULL GROUP BY canon
)
SELECT page_id, host, path, rule, alias_of,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN hit THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN groups USING (canon)
"""


def _sql_rule(host: str, path: str) -> str:
    rules = sorted(((h, p) for _, h, p in urls.RULES), key=lambda r: -len(r[0] + r[1]))
    cases = [f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h}{p}'" for h, p in rules]
    return f"CASE {' '.join(cases)} END"


ORACLES["op2_redirect_equivalence"] = (
    ORACLES["op2_redirect_equivalence"].replace("{own}", _sql_rule("host", "path")).replace("{canon}", _sql_rule("canon_host", "canon_path"))
)


@query
def op4_external_index_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as read back from the archives, with its place in the merged index."""
    found = warc.archived(table(spark, sf, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


ORACLES["op4_external_index_merge"] = r"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), keyed AS (
  SELECT *, array_to_string(list_reverse(string_split(translate(coalesce(regexp_extract(rest, '(?s)^([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',')
            || ')' || coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS url_key,
         CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM payloads
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
FROM keyed
"""


@query
def op6_int8_tile_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's links and group."""
    return embeddings.near_duplicate_vectors(table(spark, sf, "embeddings"))


ORACLES["op6_int8_tile_dedup"] = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), groups AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN groups USING (vec_id)
"""


@query
def op9_probabilistic_suffix_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's scores. No SQL for the tree: tested against brute force, and that its distributions sum to 1."""
    return suffixtree.scored(table(spark, sf, "documents"))


@query
def op11_dynamic_itemset_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.collocations(table(spark, sf, "documents"))


ORACLES["op11_dynamic_itemset_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang
), phrases AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) t(k) WHERE len(w) >= k)
), counts AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM phrases GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, f FROM candidates UNION ALL SELECT lang, array_to_string(w[2:k], ' '), f FROM candidates
  ) GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * f
), cuts AS (
  SELECT lang, phrase, f, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)
), scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, n, (1000 * cuts.f * n) // (x.f * y.f) AS score
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = head JOIN counts y ON y.lang = cuts.lang AND y.phrase = tail JOIN sizes ON sizes.lang = cuts.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase)::BIGINT AS rank, phrase,
       f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000
"""


@query
def op12_ptolemaic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's cluster."""
    return centroids.clustered(table(spark, sf, "embeddings"))


def _cluster_sql(rounds: int) -> str:
    parts = [
        """kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, p FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, p FROM kept ORDER BY h LIMIT 8)
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, k.p, cluster, list_sum(list_transform(list_zip(k.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
  FROM kept k CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS p FROM (
      SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
        SELECT cluster, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(range(64)) AS i, unnest(p) AS x FROM a{i}) GROUP BY ALL
    )) GROUP BY cluster
  ) m USING (cluster)
)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


ORACLES["op12_ptolemaic_clusters"] = _cluster_sql(centroids.ROUNDS)


@query
def op13_blob_ledger_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's secrets."""
    found = secrets.secrets(table(spark, sf, "documents"))

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = [r.kind for r in secrets.BASE]
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(joined(of(*base)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, joined("spans").alias("spans"))


# Matches are put between two control characters; the lengths of what stands before give their places.
ORACLES["op13_blob_ledger_secrets"] = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), pieces AS (
  {pieces}
), placed AS (
  SELECT *, string_split(piece, chr(2))[1] AS match, length(replace(piece, chr(2), '')) AS size,
         sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id, kind ORDER BY j) AS upto FROM pieces
), found AS (
  SELECT doc_id, kind, place, kind || ':' || (upto - size) || ':' || (upto - size + length(match)) AS span, upto - size AS start
  FROM placed WHERE j > 1 AND long_enough
), joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans
  FROM found GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (doc_id)
""".replace(
    "{pieces}",
    "\n  UNION ALL\n  ".join(
        "SELECT *, length(regexp_extract(string_split(piece, chr(2))[1], '{p}', {g})) >= {n} AS long_enough"
        " FROM (SELECT doc_id, '{k}' AS kind, {i} AS place, unnest(l) AS piece, generate_subscripts(l, 1) AS j"
        " FROM (SELECT doc_id, string_split(regexp_replace(text, '({p})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS l FROM texts))".format(
            k=r.kind, i=i, p=r.pattern.replace("'", "''"), g=r.group, n=r.least
        )
        for i, r in enumerate(secrets.RULES)
    ),
)
