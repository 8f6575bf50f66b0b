"""The registered queries of the numbered operators, and SQL where it can tell the
same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import infilling, licenses, linededup, merkle, mixing, neighbours, online_packing, packing, quality, simhash, tokens, urls, warc
from ..sources.shared import new_path
from .common import table


def op1_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path))
    field = lambda name: F.nullif(F.map_from_entries(F.get("metadata", F.lit(0))["fields"])[name], F.lit("")).cast("long")
    is_revisit = F.col("response.type") == "revisit"
    return captures.select(
        field("page-id").alias("page_id"),
        F.when(is_revisit, F.regexp_extract("response.http", r"(?i)\nContent-Length: *(\d+)", 1).cast("long")).otherwise(F.octet_length("response.payload").cast("long")).alias("payload_bytes"),
        F.when(is_revisit, F.regexp_replace("response.payload_digest", "^sha256:", "")).otherwise(F.sha2("response.payload", 256)).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("first-page-id").alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"),
        F.col("request.record_id").alias("request_id"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = licenses.scan(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    store = tokens.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(tokens.NULL_KEY)).alias("key")).distinct()
    return store.read(keys, with_ids=False).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return df.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_lines", "n_dropped", "all_words", "kept_words", F.md5("text").alias("kept_md5"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(chosen, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    df = merkle.manifest(table(spark, sf_dir, "documents"), changed={"n_chars": changed})
    df = df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("changed_leaf"), F.col("path")).alias("folded_root"))
    return df.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = online_packing.pack_online(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = infilling.infill(table(spark, sf_dir, "documents"))
    restored = infilling.restore(F.col("output"), F.col("form"))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES = {
    "op1_warc_captures": op1_warc_captures,
    "op2_license_scan": op2_license_scan,
    "op3_token_shards": op3_token_shards,
    "op4_url_filter": op4_url_filter,
    "op5_simhash": op5_simhash,
    "op6_permutation_index": op6_permutation_index,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_soft_mixing": op9_soft_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_online_packing": op12_online_packing,
    "op13_infilling": op13_infilling,
}


def _urn_sql(kind: str, page: str = "page_id") -> str:
    h = f"md5('{kind}|' || coalesce({page}::VARCHAR, '-') || '|' || digest)"
    parts = " || '-' || ".join(f"substr({h}, {i}, {n})" for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {parts} || '>'"


OP1_SQL = f"""WITH p AS (SELECT page_id, url, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
  f AS (SELECT *, CASE WHEN n >= {warc.LEAST_REVISIT} THEN min(coalesce(page_id, 9223372036854775807)) OVER (PARTITION BY digest, n >= {warc.LEAST_REVISIT}) END AS first FROM p),
  r AS (SELECT *, coalesce(first < coalesce(page_id, 9223372036854775807), false) AS revisit FROM f)
  SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to,
    trim(regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g')) AS target_uri, {_urn_sql("request")} AS request_id FROM r"""


def _op2_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in licenses.SENTENCES.items())
    told = "(' ' || array_to_string(ids, ' ') || ' ')"
    fits = [f"regexp_matches({told}, {quote(' ' + ' (?:.* )?'.join(need) + ' ')})" for _, need in licenses.RULES]
    by_name: dict[str, list[str]] = {}
    for i, (name, need) in enumerate(licenses.RULES):
        above = [fits[j] for j, (_, other) in enumerate(licenses.RULES[:i]) if set(need) <= set(other)]
        by_name.setdefault(name, []).append("(" + " AND NOT ".join([fits[i], *above]) + ")")
    names = ", ".join(f"CASE WHEN {' OR '.join(c)} THEN {quote(n)} END" for n, c in by_name.items())
    def plain(x: str) -> str:
        x = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
        for pattern, common in licenses.HOLDERS:
            x = f"regexp_replace({x}, {quote(pattern)}, {quote(common)})"
        return f"MAP {{{known}}}[{x}]"

    tag, plain_tag = licenses.SPDX_TAG
    name, reserved = licenses.NO_LICENCE
    return f"""WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), {quote(tag)}, {quote(plain_tag)}, 'g'), {quote(licenses.SENTENCE_END)}) AS parts FROM documents),
  k AS (SELECT doc_id, list_transform(parts, lambda x: CASE WHEN {plain("x")} IS NOT NULL THEN [{plain("x")}] ELSE list_transform(string_split(x, chr(10)), lambda y: {plain("y")}) END) AS found FROM s),
  i AS (SELECT doc_id, list_filter(flatten(found), lambda x: x IS NOT NULL) AS ids FROM k),
  l AS (SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS told FROM i)
  SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ' ') AS sentence_ids, CASE WHEN len(told) = 0 AND list_contains(ids, {quote(reserved)}) THEN {quote(name)} ELSE array_to_string(told, ' ') END AS licences FROM l"""


def _op4_sql() -> str:
    """Plain counts of whole contexts, with the operator's constants."""
    o, quote = urls.ORDER, lambda x: "'" + x.replace("'", "''") + "'"
    fits = [(r, v, h, "/" + p) for r, v in sorted(urls.RULES, key=lambda x: -len(x[0])) for h, _, p in [r.partition("/")]]
    rule = " ".join(f"WHEN (host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)}) THEN {{'rule': {quote(r)}, 'verdict': {quote(v)}}}" for r, v, h, p in fits)
    levels = ", ".join(f"t{n} AS (SELECT substr(gram, {o + 1 - n}) AS gram, sum(allow) AS allow, sum(block) AS block FROM counted GROUP BY 1)" for n in range(o + 1))
    mixed = lambda k, p: f"(t.{k} + {p} * {urls.BACKOFF}) / (c.{k} + {urls.BACKOFF}) AS p_{k}"
    estimates = []
    for n in range(o + 1):
        context = f"(SELECT substr(gram, 1, {n}) AS context, sum(allow) AS allow, sum(block) AS block FROM t{n} GROUP BY 1) c"
        p = (f"b.p_{k}" for k in ("allow", "block")) if n else iter([repr(1.0 / urls.ALPHABET)] * 2)
        shorter = f" JOIN e{n - 1} b ON b.gram = substr(t.gram, 2)" if n else ""
        estimates.append(f"e{n} AS (SELECT t.gram, {mixed('allow', next(p))}, {mixed('block', next(p))} FROM t{n} t JOIN {context} ON c.context = substr(t.gram, 1, {n}){shorter})")
    return f"""WITH parts AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
  ruled AS (SELECT *, CASE {rule} END AS r FROM parts),
  met AS (SELECT DISTINCT url, r.verdict AS verdict FROM ruled),
  padded AS (SELECT url, verdict, verdict IS NOT NULL AND substr(md5(url), 1, 1) < '8' AS trains, repeat(chr(2), {o}) || translate(regexp_replace(url, '[^\\x00-\\x7F]', chr(128), 'g'), chr(2) || chr(3) || '123456789', chr(1) || chr(1) || '000000000') || chr(3) AS p FROM met),
  placed AS (SELECT *, length(p) - {o} AS n, unnest(range(1, length(p) - {o} + 1)) AS i FROM padded),
  each AS (SELECT url, verdict, trains, n, substr(p, i, {o + 1}) AS gram FROM placed),
  counted AS (SELECT gram, count(*) FILTER (trains AND verdict = 'allow') AS allow, count(*) FILTER (trains AND verdict = 'block') AS block FROM each GROUP BY 1),
  {levels}, {", ".join(estimates)},
  ratios AS (SELECT gram, round(ln(p_allow / p_block) * {urls.SCALE})::BIGINT AS lr FROM e{o}),
  scores AS (SELECT url, verdict, sum(lr)::BIGINT / n / {urls.SCALE} AS score FROM each JOIN ratios USING (gram) WHERE NOT trains GROUP BY url, verdict, n),
  steps AS (SELECT floor(score * {urls.STEPS})::BIGINT AS s, count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'block') AS block FROM scores WHERE verdict IS NOT NULL GROUP BY 1),
  shares AS (SELECT s, lag(s) OVER (ORDER BY s) AS last, 1 - coalesce(sum(allow) OVER w, 0) / sum(allow) OVER () + coalesce(sum(block) OVER w, 0) / sum(block) OVER () AS judged FROM steps WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  least AS (SELECT coalesce(max(t), '-infinity'::DOUBLE) AS t FROM (SELECT coalesce((s + last + 1) / 2, s) / {urls.STEPS} AS t FROM shares WHERE judged IS NOT NULL ORDER BY judged DESC, s LIMIT 1))
  SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
  FROM ruled LEFT JOIN scores ON scores.url = ruled.url CROSS JOIN least"""


def _told_sql(n_chars: str = "n_chars") -> str:
    told = (f"coalesce(strlen(({n_chars if c == 'n_chars' else c})::VARCHAR) || ':' || ({n_chars if c == 'n_chars' else c})::VARCHAR, '-')" for c in merkle.COLUMNS)
    return f"sha256({' || '.join(told)})"


#: Whole levels, one after the other, of all trees and then of the tree over them; a leaf's siblings by its place at each level.
OP11_SQL = f"""WITH RECURSIVE crc AS (SELECT i, crc FROM (WITH RECURSIVE t(i, k, crc) AS (SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END FROM t WHERE k < 8) SELECT i, crc FROM t WHERE k = 8)),
  steps(doc_id, k, crc) AS (SELECT DISTINCT doc_id, 0, 4294967295::UBIGINT FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT s.doc_id, s.k + 1, xor(s.crc >> 8, c.crc) FROM steps s JOIN crc c ON c.i = xor(s.crc & 255, ascii(substr(s.doc_id::VARCHAR, s.k + 1, 1))::UBIGINT) WHERE s.k < length(s.doc_id::VARCHAR)),
  chosen AS (SELECT doc_id FROM steps WHERE k = length(doc_id::VARCHAR) AND xor(crc, 4294967295::UBIGINT) % 7 = 0),
  told AS (SELECT d.doc_id, coalesce('=' || lang, '') AS tree, {_told_sql()} AS leaf, {_told_sql("n_chars::HUGEINT + (c.doc_id IS NOT NULL)::INT")} AS changed FROM documents d LEFT JOIN chosen c USING (doc_id)),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM told),
  nodes(tree, level, idx, hash, n) AS (SELECT tree, 0, idx, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
    UNION ALL SELECT tree, level + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n),
  subroots AS (SELECT tree, level, hash, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx FROM nodes WHERE n = 1),
  over_nodes(level, idx, hash, n) AS (SELECT 0, idx, hash, count(*) OVER () FROM subroots
    UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (n + 1) // 2 FROM over_nodes WHERE n > 1 GROUP BY level, idx // 2, n),
  root AS (SELECT level AS top, hash AS root FROM over_nodes WHERE n = 1),
  ways AS (SELECT l.tree, l.idx, s.level AS height, s.hash AS subroot, s.idx AS place, top, root, s.level + top AS steps, leaf, changed, doc_id FROM leaves l JOIN subroots s USING (tree), root),
  each AS (SELECT tree, idx, height, place, unnest(range(steps)) AS step FROM ways),
  beside AS (SELECT e.tree, e.idx, e.step, coalesce(a.hash, b.hash) AS hash, CASE WHEN step < height THEN (e.idx >> step) % 2 ELSE (place >> (step - height)) % 2 END = 1 AS on_left FROM each e
    LEFT JOIN nodes a ON step < height AND a.tree = e.tree AND a.level = step AND a.idx = xor(e.idx >> step, 1)
    LEFT JOIN over_nodes b ON step >= height AND b.level = step - height AND b.idx = xor(place >> (step - height), 1)),
  proofs AS (SELECT tree, idx, sha256(coalesce(string_agg(hash, '' ORDER BY step), '')) AS proof FROM beside GROUP BY ALL),
  folds(tree, idx, step, hash) AS (SELECT tree, idx, 0, changed FROM ways
    UNION ALL SELECT tree, idx, f.step + 1, sha256(CASE WHEN b.hash IS NULL THEN f.hash WHEN on_left THEN b.hash || f.hash ELSE f.hash || b.hash END) FROM folds f JOIN beside b USING (tree, idx) WHERE b.step = f.step)
  SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = root AS verified
  FROM ways w JOIN folds f ON f.tree = w.tree AND f.idx = w.idx AND f.step = steps LEFT JOIN proofs p ON p.tree = w.tree AND p.idx = w.idx"""


def _op13_sql() -> str:
    unit = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    draws = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    bare = " OR ".join(f"contains(text, '{x}')" for x in (infilling.PREFIX, infilling.SUFFIX, infilling.MIDDLE))
    p, s, m = infilling.PREFIX, infilling.SUFFIX, infilling.MIDDLE
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{unit}') AS units, sha256('{infilling.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  n AS (SELECT *, len(units) AS n, {draws} FROM d),
  f AS (SELECT *, CASE WHEN text = '' OR {bare} OR h3 % 100 >= {infilling.RATE} THEN 'plain' WHEN h4 % 100 < {infilling.SPM} THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
  c AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f)
  SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""


#: The other queries stand on a tokenizer, learned models, trees or iteration; tests hold them against brute force.
ORACLE_SQL = {"op1_warc_captures": OP1_SQL, "op2_license_scan": _op2_sql(), "op4_url_filter": _op4_sql(), "op11_merkle_manifest": OP11_SQL, "op13_infilling": _op13_sql()}
