"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, fertility, filter_audit, fingerprint, language_id, license_scan, merkle, mixing, packing, secret_scan, sharding, simhash, url_filter
from .common import read

#: The rules that ``op7_url_filters`` judges pages by: host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Shards that ``op3_sharding`` fills.
SHARDS = 16


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read(spark, sf_dir, "documents"), SHARDS)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), listed)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(read(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(read(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def fertility_vocabularies() -> tuple[str, ...]:
    """All public vocabularies; ``byte_bpe_50k.json`` is the same as the ``.tiktoken`` of that name, and splits slower."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json")))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(read(spark, sf_dir, "documents"), fertility_vocabularies())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_mixing, op3_sharding, op4_fingerprints, op5_packing, op6_license_scans, op7_url_filters,
    op8_language_id, op9_simhash, op10_embedding_dedup, op11_merkle_manifest, op12_quality_rules, op13_filter_audit,
)}


def _sql_string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _url_sql() -> str:
    rules = ", ".join(f"({_sql_string(h)}, {_sql_string(p)}, {_sql_string(v)})" for h, p, v in URL_RULES)
    return f"""
    WITH rules(h, p, v) AS (VALUES {rules}),
    u AS (
      SELECT row_number() OVER () AS rid, page_id,
        coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    best AS (
      SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (rid)
    """


def _license_sql() -> str:
    known = ", ".join(f"({_sql_string(said)}, {_sql_string(name)})" for name, said in license_scan.SENTENCES.items())
    found = []
    for i, (licence, _, wanted) in enumerate(license_scan.RULES):
        said = _sql_string("".join(f" {x} " for x in wanted))
        found.append(f"CASE WHEN contains(s{i}, {said}) THEN {_sql_string(licence)} END")
    steps = "".join(
        f", r{i + 1} AS (SELECT *, replace(s{i}, {_sql_string(''.join(f' {x} ' for x in wanted))}, ' # ') AS s{i + 1} FROM r{i})" for i, (_, _, wanted) in enumerate(license_scan.RULES)
    )
    names = list(dict.fromkeys(n for n, _, _ in license_scan.RULES))
    order = "[" + ", ".join(map(_sql_string, names)) + "]"
    kinds = " ".join(
        f"WHEN list_has_any(hits, [{', '.join(_sql_string(x) for x in dict.fromkeys(n for n, k, _ in license_scan.RULES if k == level))}]) THEN '{level}'"
        for level in ("restricted", "noncommercial", "copyleft", "permissive")
    )
    return f"""
    WITH known(said, name) AS (VALUES {known}),
    d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
    parts AS (
      SELECT rid, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (
        SELECT rid, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.!?]+[\\x20\\x09-\\x0D]+|[\\x0A-\\x0D]+') AS ss FROM d WHERE text IS NOT NULL)),
    ids AS (
      SELECT rid, list(name ORDER BY i) AS ids FROM parts JOIN known ON said = trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) GROUP BY rid),
    r0 AS (SELECT d.rid, doc_id, coalesce(ids, []) AS ids, ' ' || array_to_string(list_filter(coalesce(ids, []), lambda x: x <> '{license_scan.OTHERWISE[2]}'), '  ') || ' ' AS s0 FROM d LEFT JOIN ids ON d.rid = ids.rid)
    {steps},
    hit AS (SELECT doc_id, ids, list_filter([{', '.join(found)}], lambda x: x IS NOT NULL) AS raw FROM r{len(license_scan.RULES)}),
    h AS (
      SELECT doc_id, ids, CASE WHEN len(raw) = 0 AND list_contains(ids, '{license_scan.OTHERWISE[2]}') THEN ['{license_scan.OTHERWISE[0]}'] ELSE list_filter({order}, lambda n: list_contains(raw, n)) END AS hits FROM hit)
    SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(hits, ',') AS licenses,
      CASE {kinds} END AS strictest FROM h
    """


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    leaf = lambda n: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n, "text"))) + ")"
    crc = "4294967295 - list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, c: list_reduce([xor(a, c)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1))))"
    parents = "list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
    beside = "list_extract(nodes, xor((pos >> level)::BIGINT, 1) + 1)"
    return f"""
    WITH RECURSIVE leaves AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS grp, {leaf('n_chars')} AS leaf,
        CASE WHEN ({crc}) % 7 = 0 AND n_chars IS NOT NULL THEN {leaf('(n_chars + 1)')} END AS changed
      FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM leaves),
    tree AS (
      SELECT grp, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY grp
      UNION ALL
      SELECT grp, level + 1, {parents} FROM tree WHERE len(nodes) > 1),
    subroots AS (SELECT grp, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS gpos FROM tree WHERE len(nodes) = 1),
    top AS (
      SELECT 0 AS level, list(subroot ORDER BY gpos) AS nodes FROM subroots
      UNION ALL
      SELECT level + 1, {parents} FROM top WHERE len(nodes) > 1),
    steps AS (
      SELECT rid, level, pos >> level AS spot, {beside} AS beside FROM placed JOIN tree USING (grp) WHERE len(nodes) > 1
      UNION ALL
      SELECT rid, height + level, spot, beside FROM placed JOIN (
        SELECT grp, height, level, gpos >> level AS spot, list_extract(nodes, xor((gpos >> level)::BIGINT, 1) + 1) AS beside FROM subroots, top WHERE len(nodes) > 1) USING (grp)),
    paths AS (SELECT rid, list(struct_pack(odd := spot % 2 = 1, beside := beside) ORDER BY level) AS path FROM steps GROUP BY rid),
    folded AS (
      SELECT rid, coalesce(changed, leaf) AS h, coalesce(path, []) AS path, 1 AS k FROM placed LEFT JOIN paths USING (rid)
      UNION ALL
      SELECT rid, CASE WHEN path[k].odd THEN sha256(path[k].beside || h) ELSE sha256(h || coalesce(path[k].beside, '')) END, path, k + 1 FROM folded WHERE k <= len(path))
    SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(coalesce(array_to_string(list_transform(path, lambda s: coalesce(s.beside, '')), ''), '')) AS proof_sha256, h AS folded_root, h = nodes[1] AS verified
    FROM placed JOIN subroots USING (grp) JOIN (SELECT rid, h, path FROM folded WHERE k > len(path)) USING (rid), (SELECT nodes FROM top WHERE len(nodes) = 1)
    """


def _audit_sql() -> str:
    words = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {words} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (
      SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
    f(f) AS (VALUES (1), (2), (3), (4), (5)),
    orders AS (
      SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    each AS (
      SELECT part, o, step, fails[o[step]] AS failed, list_contains(list_transform(o[1:step - 1], lambda i: fails[i]), true) AS gone,
        list_sum(list_transform(fails, lambda x: x::INT)) AS k, n, good, toxic
      FROM counted, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    told AS (
      SELECT part, o, step, coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed AND k = 1), 0) AS unique_fails,
        coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS toxic_lost
      FROM each GROUP BY part, o, step)
    SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
      unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
    FROM told
    """


ORACLE_SQL = {"op6_license_scans": _license_sql(), "op7_url_filters": _url_sql(), "op11_merkle_manifest": _merkle_sql(), "op13_filter_audit": _audit_sql()}
