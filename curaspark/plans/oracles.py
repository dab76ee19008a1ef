"""SQL that says the same as the queries, for an engine that shares nothing with this one."""

from __future__ import annotations

SIDES = ("xmin", "ymin", "xmax", "ymax")


def framed(*parts: str) -> str:
    one = lambda p: f"unhex(printf('%016x', strlen({p}))) || encode({p})"
    return f"sha256({' || '.join(map(one, parts))})"


IMAGES = """
images AS (
  SELECT 'img/' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '.png' AS image_path, k AS content_key, sha256('content:' || k) AS image_sha256,
         320 + 160 * (k % 4) AS image_width, 240 + 120 * (k % 3) AS image_height, CASE WHEN o_orderkey % 97 = 13 THEN 'ERROR' ELSE 'OK' END AS image_status
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS k FROM orders))"""
RAW = (
    IMAGES
    + """,
boxes AS (
  SELECT l_orderkey, ((l_partkey * 37) % 2600) / 4.0 - 20 AS xmin, ((l_suppkey * 53) % 1600) / 4.0 - 20 AS ymin, ((l_partkey + 11 * l_linenumber) % 320) / 4.0 AS bw,
         ((l_suppkey + 5 * CAST(trunc(l_quantity) AS BIGINT)) % 240) / 4.0 AS bh, CAST(l_quantity AS DOUBLE) / 50 AS s, l_linenumber,
         (l_partkey + 31 * l_suppkey + l_linenumber) % (SELECT count(*) FROM embeddings) AS vec_id
  FROM lineitem),
twice AS (SELECT *, s AS score FROM boxes UNION ALL SELECT *, s / 2 FROM boxes WHERE l_linenumber = 1),
raw AS (
  SELECT i.*, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmin + bw AS DOUBLE) AS xmax, CAST(ymin + bh AS DOUBLE) AS ymax, score, CASE WHEN l_linenumber = 7 THEN NULL ELSE 0 END AS raw_class_id, vec_id
  FROM images i JOIN twice ON content_key = l_orderkey)"""
)
_CLIP = "least(greatest(xmin, 0.0), image_width) AS xmin, least(greatest(ymin, 0.0), image_height) AS ymin, least(greatest(xmax, 0.0), image_width) AS xmax, least(greatest(ymax, 0.0), image_height) AS ymax"
KEPT = (
    RAW
    + f""",
clipped AS (SELECT image_path, image_sha256, image_width, image_height, image_status, {_CLIP}, least(greatest(score, 0.0), 1.0) AS score, raw_class_id, vec_id FROM raw WHERE score >= 0.35),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY score DESC, xmin, ymin, xmax, ymax, coalesce(raw_class_id, -1), vec_id) AS det_rank
  FROM clipped WHERE xmax - xmin >= 1 AND ymax - ymin >= 1 QUALIFY det_rank <= 3)"""
)
INSTANCES = (
    KEPT
    + f""",
keyed AS (SELECT *, printf('%.4f,%.4f,%.4f,%.4f', xmin, ymin, xmax, ymax) AS bbox_key FROM kept WHERE image_status <> 'ERROR'),
counted AS (SELECT *, row_number() OVER (PARTITION BY image_path, bbox_key ORDER BY det_rank) - 1 AS occurrence FROM keyed),
with_key AS (SELECT *, {framed("image_sha256", "bbox_key", "'sig'", "CAST(occurrence AS VARCHAR)")} AS instance_key FROM counted),
instances AS (SELECT *, 'di_' || substr({framed("image_path", "instance_key")}, 1, 16) AS instance_id FROM with_key)"""
)
VECTORS = """
parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY label),
centroids AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS c FROM means),
vectors AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)),
assigned AS (
  SELECT vec_id, u, CAST(c.label AS INTEGER) AS cluster_id, least(1.0, greatest(-1.0, list_inner_product(u, c))) AS cosine
  FROM vectors v CROSS JOIN centroids c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(u, c) DESC, c.label) = 1)"""
CLUSTERED = INSTANCES + "," + VECTORS + ",\nclustered AS (SELECT i.*, cluster_id, round(cosine, 6) AS cosine_to_centroid FROM instances i JOIN assigned USING (vec_id))"
RANKED = (
    CLUSTERED
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cosine_to_centroid DESC NULLS LAST, score DESC, instance_id) AS cluster_rank, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM clustered),
leads AS (SELECT * FROM clustered QUALIFY row_number() OVER (PARTITION BY image_path ORDER BY score DESC, instance_id) = 1),
ordered AS (SELECT image_path, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY cosine_to_centroid DESC, score DESC, instance_id) AS review_order FROM leads)"""
)
STATUS = """,
per AS (SELECT image_path, count(*) AS n FROM kept GROUP BY 1),
states AS (SELECT i.* EXCLUDE (image_status), coalesce(n, 0) AS n_detections, CASE WHEN image_status = 'OK' AND n IS NULL THEN 'NO_DETECTION' ELSE image_status END AS image_status FROM images i LEFT JOIN per USING (image_path))"""
_XYWH = "floor(xmin)::INT AS x, floor(ymin)::INT AS y, greatest(ceil(xmax) - floor(xmin), 0)::INT AS w, greatest(ceil(ymax) - floor(ymin), 0)::INT AS h"
FAILED = """,
tried AS (SELECT *, CASE WHEN instance_key[1] IN ('0', '1', '2') THEN 'ERROR' WHEN instance_key[1] < '8' THEN 'CACHED' ELSE 'COMPUTED' END AS embedding_status FROM instances)"""
_GROW = ", ".join(
    f"least(greatest({k} {'-' if k.endswith('min') else '+'} 0.25 * ({k[0]}max - {k[0]}min), 0.0), {'image_width' if k[0] == 'x' else 'image_height'}) AS grown_{k}" for k in SIDES
)


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


PATHS = r"""
named AS (SELECT page_id, page_id % 10 AS k, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS tail FROM pages),
paths AS (
  SELECT page_id, CASE k WHEN 0 THEN tail || '/.hidden/a.png' WHEN 1 THEN tail || '/__MACOSX/a.png' WHEN 2 THEN tail || '/Thumbs.db' WHEN 3 THEN tail || '/../a.png' WHEN 4 THEN 'x\' || page_id || '\B.JPEG'
         WHEN 5 THEN tail || '//b.Jpg' WHEN 6 THEN tail || '/_u.png' ELSE tail || '/c.gif' END AS raw FROM named),
split AS (SELECT page_id, string_split(replace(raw, '\', '/'), '/') AS all_parts FROM paths),
clean AS (SELECT page_id, list_filter(all_parts, lambda x: x NOT IN ('', '.')) AS parts FROM split)"""

ORACLES = {
    "eligible_paths": _with(
        PATHS,
        r"""SELECT page_id, array_to_string(parts, '/') AS image_path FROM clean
WHERE NOT list_contains(parts, '..') AND len(parts) > 0 AND len(list_filter(parts, lambda x: x[1] = '.' OR x = '__MACOSX')) = 0
  AND lower(parts[-1]) NOT IN ('thumbs.db', 'desktop.ini') AND regexp_extract(lower(parts[-1]), '.(\.[^.]*)$', 1) IN ('.jpg', '.jpeg', '.png')""",
    ),
    "detections_postprocess": _with(KEPT, "SELECT image_path, vec_id, det_rank, score, raw_class_id, xmin, ymin, xmax, ymax FROM kept"),
    "bbox_xywh": _with(
        RAW + f", c AS (SELECT image_path, vec_id, score, image_width, image_height, {_CLIP} FROM raw)",
        f"SELECT image_path, vec_id, score, {_XYWH}, greatest(xmax - xmin, 0.0) * greatest(ymax - ymin, 0.0) AS area, xmax <= xmin OR ymax <= ymin AS degenerate, {_GROW} FROM c",
    ),
    "letterbox_geometry": _with(
        KEPT
        + f""", g AS (SELECT *, {_GROW} FROM kept),
a AS (SELECT *, greatest(0, least(image_width - 1, floor(grown_xmin))) AS cx, greatest(0, least(image_height - 1, floor(grown_ymin))) AS cy FROM g),
b AS (SELECT *, greatest(cx + 1, least(image_width, ceil(grown_xmax))) AS dx, greatest(cy + 1, least(image_height, ceil(grown_ymax))) AS dy FROM a),
s AS (SELECT *, least(512.0::DOUBLE / (dx - cx), 512.0::DOUBLE / (dy - cy)) AS scale FROM b),
r AS (SELECT *, greatest(1, least(512, round_even((dx - cx) * scale, 0)))::INT AS rw, greatest(1, least(512, round_even((dy - cy) * scale, 0)))::INT AS rh FROM s),
l AS (SELECT *, ((512 - rw) // 2)::INT AS pl, ((512 - rh) // 2)::INT AS pt, rw / (dx - cx) AS sx, rh / (dy - cy) AS sy FROM r)""",
        """SELECT image_path, vec_id, det_rank, cx::DOUBLE AS crop_xmin, cy::DOUBLE AS crop_ymin, dx::DOUBLE AS crop_xmax, dy::DOUBLE AS crop_ymax, rw AS resized_width, rh AS resized_height, pl AS pad_left, pt AS pad_top,
  round(least(greatest((xmin - cx) * sx + pl, 0.0), 512), 6) AS map_xmin, round(least(greatest((ymin - cy) * sy + pt, 0.0), 512), 6) AS map_ymin,
  round(least(greatest((xmax - cx) * sx + pl, 0.0), 512), 6) AS map_xmax, round(least(greatest((ymax - cy) * sy + pt, 0.0), 512), 6) AS map_ymax FROM l""",
    ),
    "instance_identity": _with(INSTANCES, "SELECT image_path, vec_id, det_rank, occurrence, bbox_key, instance_key, instance_id FROM instances"),
    "image_identity": _with(
        IMAGES + f", k AS (SELECT image_path, {framed('image_sha256', chr(39) + 'full_image_v1' + chr(39))} AS instance_key FROM images WHERE image_status <> 'ERROR')",
        f"SELECT image_path, instance_key, 'di_' || substr({framed('image_path', 'instance_key')}, 1, 16) AS instance_id FROM k",
    ),
    "duplicate_content": _with(INSTANCES, "SELECT instance_key, count(*) AS n_instances, count(DISTINCT image_path) AS n_images FROM instances GROUP BY 1 HAVING count(*) > 1"),
    "cache_hits": _with(INSTANCES, "SELECT instance_key, instance_id FROM instances WHERE instance_key[1] < '8'"),
    "cache_misses": _with(INSTANCES, "SELECT instance_key, instance_id FROM instances WHERE instance_key[1] >= '8'"),
    "cache_counters": _with(INSTANCES, "SELECT count(*) FILTER (instance_key[1] < '8') AS hits, count(*) FILTER (instance_key[1] >= '8') AS misses FROM instances"),
    "l2_normalize": _with(VECTORS, "SELECT vec_id, generate_subscripts(u, 1) - 1 AS pos, round(unnest(u), 6) AS x FROM vectors"),
    "centroid_assign": _with(VECTORS, "SELECT vec_id, cluster_id, round(cosine, 6) AS cosine_to_centroid FROM assigned"),
    "canonical_cluster_ids": _with(
        CLUSTERED + ", best AS (SELECT *, max(cosine_to_centroid) OVER (PARTITION BY cluster_id) AS m FROM clustered), reps AS (SELECT cluster_id, min(instance_id) AS representative FROM best WHERE m - cosine_to_centroid <= 1e-8 GROUP BY 1)",
        "SELECT cluster_id AS old_cluster_id, representative, CAST(row_number() OVER (ORDER BY representative, cluster_id) - 1 AS INTEGER) AS cluster_id FROM reps",
    ),
    "cluster_rank": _with(RANKED, "SELECT instance_id, cluster_id, cosine_to_centroid, cluster_rank, cluster_size FROM ranked"),
    "review_order": _with(RANKED, "SELECT image_path, cluster_id, review_order FROM ordered"),
    "review_rows": _with(
        RANKED
        + STATUS
        + f""",
d AS (SELECT image_path, det_rank, score, {_XYWH} FROM kept WHERE image_status <> 'ERROR'),
dets AS (SELECT image_path, count(*) AS n, string_agg(x || ',' || y || ',' || w || ',' || h || ':defect', ';' ORDER BY det_rank) AS boxes, sum(round(score, 8)) AS s FROM d GROUP BY 1),
e AS (SELECT image_path, instance_id, score, cluster_id, cluster_rank, {_XYWH} FROM ranked),
ins AS (SELECT image_path, string_agg(x || ',' || y || ',' || w || ',' || h || ':' || cluster_id, ';' ORDER BY score DESC, instance_id) AS cluster_boxes, string_agg(instance_id || ':' || cluster_rank, ';' ORDER BY score DESC, instance_id) AS instances FROM e GROUP BY 1)""",
        """SELECT image_path, image_status, image_width, image_height, coalesce(n, 0) AS num_defects, o.cluster_id AS primary_cluster_id, review_order, coalesce(boxes, '') AS boxes, coalesce(cluster_boxes, '') AS cluster_boxes,
  coalesce(instances, '') AS instances, CASE WHEN image_status = 'ERROR' THEN 'IMAGE_DECODE_FAILED' END AS error_code, 'run' AS run_id, round(coalesce(s, 0.0), 4) AS score_sum
FROM states LEFT JOIN dets USING (image_path) LEFT JOIN ins USING (image_path) LEFT JOIN ordered o USING (image_path)""",
    ),
    "status_derivation": _with(KEPT + STATUS, "SELECT image_path, image_status, n_detections FROM states"),
    "cluster_summary": _with(
        CLUSTERED,
        """SELECT cluster_id, count(*) AS cluster_size, first(instance_id ORDER BY cosine_to_centroid DESC, instance_id) AS representative_instance_id, round(avg(cosine_to_centroid), 6) AS mean_cosine_to_centroid,
  round(min(cosine_to_centroid), 6) AS min_cosine_to_centroid, round(max(cosine_to_centroid), 6) AS max_cosine_to_centroid FROM clustered GROUP BY 1""",
    ),
    "embedding_statuses": _with(
        INSTANCES + STATUS + FAILED + ", f AS (SELECT image_path, count(*) AS n, count(*) FILTER (embedding_status = 'ERROR') AS bad FROM tried GROUP BY 1)",
        """SELECT image_path, CASE WHEN n = bad AND image_status <> 'ERROR' THEN 'ERROR' ELSE image_status END AS image_status,
  CASE WHEN image_status = 'ERROR' THEN 'IMAGE_DECODE_FAILED' WHEN n = bad THEN 'ALL_INSTANCE_EMBEDDINGS_FAILED' END AS error_code,
  CASE WHEN bad > 0 AND bad < n THEN 'PARTIAL_INSTANCE_EMBEDDING_FAILURES' ELSE '' END AS warnings FROM states LEFT JOIN f USING (image_path)""",
    ),
    "run_counts": _with(
        INSTANCES + STATUS + FAILED,
        """SELECT * FROM (SELECT count(*) AS images, count(*) FILTER (image_status = 'OK') AS ok_images, count(*) FILTER (image_status = 'NO_DETECTION') AS no_detection_images, count(*) FILTER (image_status = 'ERROR') AS error_images,
  CAST(coalesce(sum(n_detections) FILTER (image_status <> 'ERROR'), 0) AS BIGINT) AS detections FROM states),
 (SELECT count(*) AS instances, count(*) FILTER (embedding_status <> 'ERROR') AS embedded_instances, count(*) FILTER (embedding_status = 'ERROR') AS failed_instances FROM tried)""",
    ),
    "failure_fraction": _with(IMAGES, "SELECT count(*) AS n_images, count(*) FILTER (image_status = 'ERROR') AS n_errors, round(avg((image_status = 'ERROR')::INT), 6) AS failure_fraction FROM images"),
    "observed_classes": _with(RAW, "SELECT string_agg(DISTINCT CAST(raw_class_id AS VARCHAR), ',') AS class_ids FROM raw"),
    "failures_log": r"""WITH m AS (
  SELECT event_id % 3 AS k, 'img/' || event_id AS image_path, 'cannot  open /data/in put/' || event_type || '/' || user_id || '.png:' || chr(10) || chr(9) || repeat(coalesce(props, ''), CASE WHEN event_id % 3 = 1 THEN 40 ELSE 1 END) AS t FROM events),
r AS (SELECT k, image_path, trim(regexp_replace(regexp_replace(t, '(?:(?:[A-Za-z]:)?[/\\](?:[^\s:''"]+[/\\])+[^\s:''"]*)', '<redacted-path>', 'g'), '\s+', ' ', 'g')) AS t FROM m)
SELECT image_path, CASE k WHEN 0 THEN 'read' WHEN 1 THEN 'decode' ELSE 'detection' END AS stage, CASE k WHEN 0 THEN 'IMAGE_READ_FAILED' WHEN 1 THEN 'IMAGE_DECODE_FAILED' ELSE 'DETECTOR_FAILED' END AS error_code,
  CASE WHEN length(t) > 500 THEN substr(t, 1, 499) || '…' ELSE t END AS sanitized_message, 0 AS retry_count FROM r""",
    "source_changed": _with(
        IMAGES + ", n AS (SELECT image_path, CAST(substr(image_path, 5, 8) AS BIGINT) AS k FROM images)",
        "SELECT image_path, CASE WHEN k % 41 = 7 THEN 'IMAGE_REREAD_FAILED' ELSE 'IMAGE_CHANGED_DURING_RUN' END AS error_code, 'embedding_read' AS stage FROM n WHERE k % 41 = 7 OR k % 29 = 3",
    ),
    "embedding_row": _with(INSTANCES, "SELECT image_path, det_rank, instance_id, row_number() OVER (ORDER BY image_path, det_rank) - 1 AS embedding_row FROM instances"),
    "cluster_sizes": _with(VECTORS, "SELECT CAST(r.range AS INTEGER) AS cluster_id, count(vec_id) AS cluster_size FROM range(12) r LEFT JOIN assigned ON cluster_id = r.range GROUP BY 1"),
    "lloyd_step": _with(VECTORS, "SELECT cluster_id, pos, round(avg(x), 6) AS mean FROM (SELECT cluster_id, generate_subscripts(u, 1) - 1 AS pos, unnest(u) AS x FROM assigned) GROUP BY ALL"),
    "lloyd_objective": _with(VECTORS, "SELECT round(sum(cosine), 4) AS objective FROM assigned"),
    "fractional_weights": _with(
        KEPT
        + """, b AS (SELECT image_path, vec_id, xmin % 256 AS x0, ymin % 256 AS y0, least(xmin % 256 + (xmax - xmin), 512) AS x1, least(ymin % 256 + (ymax - ymin), 512) AS y1 FROM kept WHERE det_rank = 1),
w AS (SELECT image_path, vec_id, r.range * 8 + c.range AS patch, greatest(0.0, least((r.range + 1) * 64, y1) - greatest(r.range * 64, y0)) * greatest(0.0, least((c.range + 1) * 64, x1) - greatest(c.range * 64, x0)) / 4096 AS weight FROM b, range(8) r, range(8) c)""",
        "SELECT * FROM w WHERE weight > 0",
    ),
    "pooled_vector": """WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
q AS (SELECT vec_id, i // 16 AS channel, (i % 16) // 4 AS r, i % 4 AS c, x FROM p),
u AS (SELECT *, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id, r, c)), 1e-12) AS v FROM q),
w AS (SELECT *, greatest(0, least((c + 1) * 16, (vec_id % 5) * 8 + 24) - greatest(c * 16, (vec_id % 5) * 8)) * greatest(0, least((r + 1) * 16, (vec_id % 3) * 8 + 20) - greatest(r * 16, (vec_id % 3) * 8)) / 256.0 AS w FROM u),
m AS (SELECT vec_id, channel, sum(v * w) / sum(w) AS y FROM w GROUP BY ALL)
SELECT vec_id, channel, round(y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 4) AS x FROM m""",
    "audit_counts": "SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS n_correct FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "audit_bound": """WITH RECURSIVE a AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1),
b AS (SELECT source, n, k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM a UNION ALL
  SELECT source, n, k, CASE WHEN tail > 0.05 THEN lo ELSE mid END, CASE WHEN tail > 0.05 THEN mid ELSE hi END, step + 1 FROM (
    SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) AS tail FROM b WHERE step < 50))
SELECT source, n, k AS n_correct, CASE WHEN k = 0 THEN 0.0 ELSE round(lo, 6) END AS lower_bound FROM b WHERE step = 50""",
    "bundle_validate": """SELECT * FROM (VALUES ('b.bin', 'digest differs'), ('c.bin', 'missing'), ('../d.bin', 'unsafe path'), ('e.bin', 'malformed digest')) t(name, error)""",
}
