"""SQL definitions of the derived tables, in dependency order (DuckDB dialect)."""

SQL_TABLES: dict[str, str] = {
    "patches": """
        SELECT vec_id, vec_id // 10 AS image_id, CAST(vec_id % 10 AS BIGINT) AS patch_id,
               CAST((vec_id % 10) // 5 AS BIGINT) AS py, CAST(vec_id % 5 AS BIGINT) AS px,
               CAST(embedding AS DOUBLE[]) AS e, label,
               CASE WHEN (vec_id // 10) % 5 = 0 THEN 'query' ELSE 'ref' END AS role
        FROM embeddings""",
    "patch_long": """
        SELECT vec_id, image_id, patch_id, py, px, label, role,
               generate_subscripts(e, 1) AS d, unnest(e) AS v FROM patches""",
    "segment_patches": """
        SELECT p.image_id, s.seg_id, p.patch_id FROM patches p,
               (SELECT unnest(range(5)) AS seg_id) s
        WHERE (p.px = s.seg_id OR p.px = (s.seg_id + 1) % 5)
          AND (p.image_id % 7 <> 3 OR s.seg_id <= 2)""",
    "segments": """
        SELECT sp.image_id, sp.seg_id, count(*) AS n_patch,
               1000 * avg(p.e[1]) AS cx, 1000 * avg(p.e[2]) AS cy
        FROM segment_patches sp JOIN patches p USING (image_id, patch_id) GROUP BY ALL""",
    "vocabulary_long": """
        SELECT label AS cluster, d, avg(v) AS c FROM patch_long WHERE role = 'ref' GROUP BY ALL""",
    "vocabulary": """
        SELECT cluster, list(c ORDER BY d) AS centroid, sqrt(sum(c * c)) AS cnorm
        FROM vocabulary_long GROUP BY cluster""",
    "cosines": """
        SELECT p.vec_id, p.image_id, p.patch_id, p.role, v.cluster,
               list_dot_product(p.e, v.centroid) / v.cnorm AS s, sqrt(list_dot_product(p.e, p.e)) AS enorm
        FROM patches p, vocabulary v""",
    "assigned": """
        SELECT vec_id, image_id, patch_id, role, cluster, s FROM cosines
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) = 1""",
    "segment_vectors": """
        SELECT image_id, seg_id, role, list(t ORDER BY d) AS vec FROM (
          SELECT sp.image_id, sp.seg_id, p.role, p.d, sum(p.v) AS t
          FROM segment_patches sp JOIN patch_long p USING (image_id, patch_id) GROUP BY ALL) x
        GROUP BY ALL""",
    "segment_edges": """
        SELECT image_id, seg_a, seg_b, small FROM (
          SELECT a.image_id, a.seg_id AS seg_a, b.seg_id AS seg_b, false AS small
          FROM segments a JOIN segments b USING (image_id)
          WHERE (SELECT count(*) FROM segments n WHERE n.image_id = a.image_id) > 3 AND (a.seg_id = b.seg_id OR EXISTS (
            SELECT 1 FROM segments c WHERE c.image_id = a.image_id AND c.seg_id NOT IN (a.seg_id, b.seg_id)
              AND (SELECT count(*) FROM segments p WHERE p.image_id = a.image_id AND p.seg_id NOT IN (a.seg_id, b.seg_id, c.seg_id)
                AND sign((b.cx - a.cx) * (c.cy - a.cy) - (b.cy - a.cy) * (c.cx - a.cx)) * (
                  (a.cx - p.cx) * ((b.cy - p.cy) * ((c.cx - p.cx) ** 2 + (c.cy - p.cy) ** 2) - (c.cy - p.cy) * ((b.cx - p.cx) ** 2 + (b.cy - p.cy) ** 2))
                  - (a.cy - p.cy) * ((b.cx - p.cx) * ((c.cx - p.cx) ** 2 + (c.cy - p.cy) ** 2) - (c.cx - p.cx) * ((b.cx - p.cx) ** 2 + (b.cy - p.cy) ** 2))
                  + ((a.cx - p.cx) ** 2 + (a.cy - p.cy) ** 2) * ((b.cx - p.cx) * (c.cy - p.cy) - (c.cx - p.cx) * (b.cy - p.cy))) > 0) = 0))
          UNION ALL
          SELECT a.image_id, a.seg_id, b.seg_id, true FROM segments a JOIN segments b USING (image_id)
          WHERE (SELECT count(*) FROM segments n WHERE n.image_id = a.image_id) <= 3
            AND (SELECT count(*) FROM segments n WHERE n.image_id = a.image_id AND n.seg_id < b.seg_id) < 2) x""",
    "hops3": """
        SELECT image_id, seg_a, seg_b, min(hops) AS hops FROM (
          SELECT image_id, seg_a, seg_b, CASE WHEN seg_a = seg_b THEN 0 ELSE 1 END AS hops FROM segment_edges
          UNION ALL SELECT a.image_id, a.seg_a, b.seg_b, 2 FROM segment_edges a
            JOIN segment_edges b ON b.image_id = a.image_id AND b.seg_a = a.seg_b AND NOT b.small
          UNION ALL SELECT a.image_id, a.seg_a, c.seg_b, 3 FROM segment_edges a
            JOIN segment_edges b ON b.image_id = a.image_id AND b.seg_a = a.seg_b AND NOT b.small
            JOIN segment_edges c ON c.image_id = a.image_id AND c.seg_a = b.seg_b) x GROUP BY ALL""",
    "super_patches": """
        SELECT DISTINCT h.image_id, h.seg_a AS seg_id, sp.patch_id FROM hops3 h
        JOIN segment_patches sp ON sp.image_id = h.image_id AND sp.seg_id = h.seg_b""",
    "knn_pairs": """
        SELECT q.image_id AS q_image, q.patch_id AS q_seg, r.image_id AS r_image, r.patch_id AS r_seg,
               list_sum(list_transform(range(1, 65), lambda i: (q.e[i] - r.e[i]) * (q.e[i] - r.e[i]))) AS sq_dist
        FROM patches q, patches r WHERE q.role = 'query' AND r.role = 'ref'""",
    "knn_matches": """
        SELECT *, row_number() OVER (PARTITION BY q_image, q_seg ORDER BY sq_dist, r_image, r_seg) AS rank
        FROM knn_pairs QUALIFY rank <= 20""",
    "matches": """
        SELECT q_image, q_seg, r_image, r_image * 10 + r_seg AS r_seg, rank, 2 - sq_dist AS sim FROM knn_matches""",
    "normed_matches": """
        SELECT *, (sim - (SELECT min(sim) FROM matches))
                  / ((SELECT max(sim) FROM matches) - (SELECT min(sim) FROM matches)) AS nsim
        FROM matches""",
    "vote_scores": """
        SELECT q_image, r_image, sum(nsim) AS score, min(rank) AS best_rank, min({'r': rank, 's': q_seg}).s AS first_seg
        FROM normed_matches GROUP BY ALL""",
    "predictions": """
        SELECT q_image, r_image, score,
               row_number() OVER (PARTITION BY q_image ORDER BY round(score, 9) DESC, best_rank, first_seg, r_image) AS rank
        FROM vote_scores QUALIFY rank <= 5""",
    "poses": """
        SELECT image_id, role, 250 * avg(e[1]) AS x, 250 * avg(e[2]) AS y, 250 * avg(e[3]) AS z,
               180 * avg(e[4]) AS a, 180 * avg(e[5]) AS b, 180 * avg(e[6]) AS c
        FROM patches GROUP BY ALL""",
    "gt": """
        SELECT q.image_id AS q_image, r.image_id AS r_image,
               sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)) AS dist
        FROM poses q, poses r WHERE q.role = 'query' AND r.role = 'ref'
          AND (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) <= 25""",
    "gt_wide": """
        SELECT q.image_id AS q_image, r.image_id AS r_image FROM poses q, poses r
        WHERE q.role = 'query' AND r.role = 'ref'
          AND (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) <= 400""",
    "query_images": "SELECT DISTINCT image_id AS q_image FROM patches WHERE role = 'query'",
    "ref_images": "SELECT DISTINCT image_id AS r_image FROM patches WHERE role = 'ref'",
    "pixels": """
        SELECT image_id, patch_id AS seg_id, (d - 1) // 8 AS y, (d - 1) % 8 AS x, v FROM patch_long""",
    "paths": """
        SELECT image_id, role, 'db/@' || CAST(CAST(round(x, 3) AS DECIMAL(18,3)) AS VARCHAR) || '@'
               || CAST(CAST(round(y, 3) AS DECIMAL(18,3)) AS VARCHAR) || '@' || image_id || '.jpg' AS path
        FROM poses""",
    "manifest": """
        SELECT DISTINCT image_id, role, CASE WHEN image_id % 2 = 0 THEN 'cph' ELSE 'sf' END AS city,
               'train_val/' || CASE WHEN image_id % 2 = 0 THEN 'cph' ELSE 'sf' END || '/' || role
               || '/images/img' || image_id || '.jpg' AS path
        FROM patches""",
    "boxes": """
        SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seg_id,
               CAST(l_partkey % 40 AS DOUBLE) AS x0, CAST(l_suppkey % 40 AS DOUBLE) AS y0,
               l_partkey % 40 + 20 + l_quantity AS x1, l_suppkey % 40 + 20 + l_quantity AS y1,
               (20 + l_quantity) * (20 + l_quantity) AS area,
               CAST(0.80 AS DOUBLE) + 2 * l_discount AS predicted_iou,
               CAST(0.91 AS DOUBLE) + l_tax AS stability_score,
               CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 10.0 ELSE 20.0 END AS crop_x0,
               CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 10.0 ELSE 20.0 END AS crop_y0,
               CASE l_returnflag WHEN 'A' THEN 100.0 WHEN 'N' THEN 80.0 ELSE 120.0 END AS crop_x1,
               CASE l_returnflag WHEN 'A' THEN 100.0 WHEN 'N' THEN 90.0 ELSE 120.0 END AS crop_y1
        FROM lineitem""",
    "places": """
        SELECT user_id AS place_id, event_id AS image_id, event_type AS city_id,
               CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, event_id % 360 AS northdeg,
               value AS lat, value / 2 AS lon, 'pano' || event_id AS panoid
        FROM events""",
}
