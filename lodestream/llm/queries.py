"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from . import bpe, exact_dedup, licenses, lzprint, neardup, packing, quality, sharding, suffixes, warc
from .common import read_table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op2_weak_label_quality(spark, sf_dir):
    return quality.score_documents(read_table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"))


def op4_license_notices(spark, sf_dir):
    return licenses.scan_documents(read_table(spark, sf_dir, "documents"))


def op5_lz_fingerprint(spark, sf_dir):
    return lzprint.edit_fingerprints(read_table(spark, sf_dir, "documents"))


def op6_rendezvous_shards(spark, sf_dir):
    return sharding.shard_records(read_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    return suffixes.repeat_digests(read_table(spark, sf_dir, "documents"))


def op8_warc_fixity(spark, sf_dir):
    return warc.fixity_report(read_table(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), threshold=85)


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_weak_label_quality, op3_bpe_round_trip, op4_license_notices, op5_lz_fingerprint, op6_rendezvous_shards, op7_suffix_dedup, op8_warc_fixity, op9_minhash_near_dedup, op10_best_fit_packing)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op7_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
        t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
        g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS fresh FROM w WHERE m IN (FROM t)),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM g) GROUP BY doc_id, no),
        k AS (SELECT doc_id, a, b, h, n, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM s JOIN d USING (doc_id)),
        x AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k GROUP BY doc_id)
        SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)""",
    "op8_warc_fixity": """
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(concat(coalesce(page_id::VARCHAR, ''), ' ', coalesce(url, ''))) AS m FROM pages),
        h AS (SELECT page_id, url, m, concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(html)::VARCHAR, chr(13), chr(10), chr(13), chr(10), html) AS http FROM p),
        r AS (SELECT page_id, url, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Date: 2024-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Record-ID: <urn:uuid:',
                concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12)), '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
                'Content-Type: application/http; msgtype=response', chr(13), chr(10), 'Content-Length: ', strlen(http)::VARCHAR, chr(13), chr(10), chr(13), chr(10), http, chr(13), chr(10), chr(13), chr(10)) AS record FROM h),
        d AS (SELECT page_id, url, strlen(record) AS n, sha256(record) AS hash, sha256(CASE
                WHEN page_id % 401 = 7 THEN NULL
                WHEN page_id % 97 = 13 THEN concat(substr(record, 1, (length(record) // 2 - 1)), chr(1), substr(record, length(record) // 2 + 1))
                WHEN page_id % 211 = 5 THEN substr(record, 1, length(record) - 7) ELSE record END) AS copy FROM r),
        o AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, url, hash) - 1 AS no FROM d)
        SELECT page_id, (no // 256)::BIGINT AS file, (sum(n) OVER f - n)::BIGINT AS start, (sum(n) OVER f)::BIGINT AS stop, hash AS record_sha256, copy AS replica_sha256, hash IS DISTINCT FROM copy AS damaged
        FROM o WINDOW f AS (PARTITION BY no // 256 ORDER BY no)""",
    "op9_minhash_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
        n AS (SELECT d.doc_id, count(s.s) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
        SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, n.doc_id = min(r.root) AS kept FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n""",
}
