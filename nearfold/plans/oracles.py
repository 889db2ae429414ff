"""The catalog's queries as DuckDB SQL: shared common tables, put in front as far as a query names them."""

from __future__ import annotations

import re

#: Name: definition. Each may use those before it.
COMMON: dict[str, str] = {
    "feat": "select vec_id as node, list_transform(embedding, lambda x: cast(x as double)) as f, cast(label as bigint) as label from embeddings",
    "long": "select node, label, unnest(f) as value, cast(unnest(range(len(f))) as bigint) as feature from feat",
    "stats": "select feature, avg(value) as mean, stddev_pop(value) as std from long group by feature",
    "pr": "select a.node as i, b.node as j, list_distance(a.f, b.f) as dist from feat a join feat b on a.node <> b.node",
    "nb": "select i, j, dist, row_number() over (partition by i order by dist, j) as rank from pr qualify row_number() over (partition by i order by dist, j) <= 64",
    "sg": "select median(dist) as sigma from nb where rank = 10",
    "nw": "select i, j, rank, dist, exp(-0.5 * pow(dist / sigma, 2)) as w from nb, sg",
    "births": "select least(i, j) as u, greatest(i, j) as v, min(rank) as birth from nb group by 1, 2",
    "e1": "select least(i, j) as u, greatest(i, j) as v, max(w) as w, min(dist) as dist from nw where rank <= 1 group by 1, 2",
    "e3": "select least(i, j) as u, greatest(i, j) as v, max(w) as w, min(dist) as dist from nw where rank <= 3 group by 1, 2",
    "e10": "select least(i, j) as u, greatest(i, j) as v, max(w) as w, min(dist) as dist from nw where rank <= 10 group by 1, 2",
    "adj3": "select u as src, v as dst, w from e3 union all select v, u, w from e3",
    "deg3": "select src as node, count(*) as degree, sum(w) as strength from adj3 group by src",
    "adj1": "select u as src, v as dst from e1 union all select v, u from e1",
    "reach1(node, far)": "select node, node from feat union select r.node, a.dst from reach1 r join adj1 a on r.far = a.src",
    "comp1": "select node, min(far) as label from reach1 group by node",
    "size1": "select label, count(*) as size from comp1 group by label",
    "tri10": "select a.u as a, a.v as b, c.v as c from e10 a join e10 b on a.u = b.u and a.v < b.v join e10 c on c.u = a.v and c.v = b.v",
    "corner10": "select a as node from tri10 union all select b from tri10 union all select c from tri10",
    "adj10": "select u as src, v as dst, w from e10 union all select v, u, w from e10",
    "met10": """select f.node, coalesce(d.degree, 0) as degree, coalesce(d.strength, 0) as strength, coalesce(t.n, 0) as triangles from feat f
        left join (select src as node, count(*) as degree, sum(w) as strength from adj10 group by 1) d using (node)
        left join (select node, count(*) as n from corner10 group by 1) t using (node)""",
    "frac10": """select *, case when triangles > 0 then 2 * triangles / (degree * (degree - 1)) else 0 end as clustering,
        case when triangles > 0 then cast(2 * triangles // gcd(2 * triangles, degree * (degree - 1)) as bigint) else 0 end as num,
        case when triangles > 0 then cast(degree * (degree - 1) // gcd(2 * triangles, degree * (degree - 1)) as bigint) else 1 end as den from met10""",
    "given": "select node, label from feat",
    "halves": "select node, cast(case when f[1] < 0 then 1 else 2 end as bigint) as label from feat",
    "tags": "select f.node, coalesce(string_split(p.p_name, ' '), []) as tags from feat f left join part p on p.p_partkey = f.node",
    "flags": """select f.node, list_filter([case when l.quality = 1 then 'quality' end, case when l.toxic = 1 then 'toxic' end], lambda x: x is not null) as tags
        from feat f left join labels l on l.doc_id = f.node""",
    "artists": "select f.node, p.p_brand as artist from feat f join part p on p.p_partkey = f.node",
    "rhythm": "select f.node, cast(p.p_size as double) as bpm, p.p_retailprice as onset_rate from feat f join part p on p.p_partkey = f.node",
    "ends3": "select e.*, a.label as lu, b.label as lv from e3 e join given a on a.node = e.u join given b on b.node = e.v",
    "comm3": """select g.label, count(*) as nodes, min(g.node) as least,
        coalesce(max(x.internal_edges), 0) as internal_edges, coalesce(max(x.boundary_edges), 0) as boundary_edges,
        coalesce(max(x.internal_weight), 0) as internal_weight, coalesce(max(x.boundary_weight), 0) as boundary_weight
        from given g left join (select label, count(*) filter (lu = lv) as internal_edges, count(*) filter (lu <> lv) as boundary_edges,
            coalesce(sum(w) filter (lu = lv), 0) as internal_weight, coalesce(sum(w) filter (lu <> lv), 0) as boundary_weight
            from (select lu as label, lu, lv, w from ends3 union all select lv, lu, lv, w from ends3 where lu <> lv) group by label) x on x.label = g.label
        group by g.label""",
    "cont": "select g.label as a, h.label as b, count(*) as n from given g join halves h using (node) group by 1, 2",
    "val_g": """select c_nationkey as graph, row_number() over w as idx, sum(floor(abs(c_acctbal)) / 16384) over (w rows between unbounded preceding and current row) as value
        from customer window w as (partition by c_nationkey order by c_custkey)""",
    "gap_g": """select cast(graph as bigint) as graph, idx, value, value - lag(value) over w as l, lead(value) over w - value as r from val_g window w as (partition by graph order by idx)""",
    "ptag": "select g.label, unnest(list_distinct(t.tags)) as tag from given g join tags t using (node)",
    "ftag": "select g.label, unnest(list_distinct(t.tags)) as tag from given g join flags t using (node)",
}

SQL: dict[str, str] = {
    "tracks_json_features": """
        with r as (select 't' || lpad(cast(p_partkey as varchar), 6, '0') as track_id, p_partkey % 7 = 0 as bad, p_size, p_retailprice from part)
        select track_id, cast(case when not bad then 1 else -1 end as bigint) as clipped, case when bad then track_id || ': rhythm: value' end as error,
          cast(case when bad then 0 else 100 end as bigint) as n,
          case when not bad then round(
            (select sum(p_size + x) from range(0, 13) t(x)) + (select sum(x) from range(0, 13) t(x) where x <> p_size % 13)
            + (select sum(x / 4) from range(0, 36) t(x)) + (select sum(sqrt(x)) from range(0, 36) t(x)) + p_size + p_retailprice, 6) end as total,
          case when not bad then case when p_size % 13 = 1 then 0.0 else 1.0 end end as std_01
        from r""",
    "tracks_dense_index": "select 't' || lpad(cast(p_partkey as varchar), 6, '0') as track_id, row_number() over (order by 't' || lpad(cast(p_partkey as varchar), 6, '0')) - 1 as node_index, replace(p_name, ' ', '|') as genre from part",
    "feature_stats": "select feature, round(mean, 6) + 0.0 as mean, round(std, 6) as std from stats",
    "constant_columns": "select cast(x as bigint) as feature from (values (64), (65)) t(x)",
    "group_weights": "select feature, case when feature < 17 then 0 when feature < 62 then 1 else 2 end as grp, round(1 / sqrt(count(*) over (partition by case when feature < 17 then 0 when feature < 62 then 1 else 2 end)), 6) as weight from stats where std > 1e-12",
    "weighted_zscore": """select l.node, l.feature, round((l.value - s.mean) / s.std / sqrt(case when l.feature < 17 then 17 when l.feature < 62 then 45 else 2 end), 6) + 0.0 as z
        from long l join stats s using (feature)""",
    "distinct_vectors": "select count(distinct f) as distinct_vectors from feat",
    "knn_neighbors_k10": "select i, j, rank, round(dist, 6) as dist from nb where rank <= 10",
    "knn_bandwidth": "select round(sigma, 6) as sigma, cast(null as varchar) as fallback from sg",
    "knn_gaussian_weights": "select i, j, round(w, 6) as w from nw where rank <= 10",
    "pair_quantiles": "select count(*) as n, round(quantile_cont(dist, 0), 6) as q0, round(quantile_cont(dist, 0.25), 6) as q25, round(quantile_cont(dist, 0.5), 6) as q50, round(quantile_cont(dist, 0.75), 6) as q75, round(quantile_cont(dist, 1), 6) as q100 from pr where i < j",
    "similarity_quantiles": """select count(*) as n, round(quantile_cont(w, 0), 6) as q0, round(quantile_cont(w, 0.25), 6) as q25, round(quantile_cont(w, 0.5), 6) as q50, round(quantile_cont(w, 0.75), 6) as q75, round(quantile_cont(w, 1), 6) as q100
        from (select exp(-0.5 * pow(dist / sigma, 2)) as w from pr, sg where i < j)""",
    "union_knn_edges_k3": "select u, v, round(w, 6) as w, round(dist, 6) as dist from e3",
    "edge_export_k3": "select u as source, v as target, round(w, 6) as weight, round(dist, 6) as distance from e3",
    "edge_count_by_k": "select cast(k as bigint) as k, (select count(*) from births where birth <= k) as edges from range(1, 65) t(k)",
    "graph_invariants": """select count(*) filter (u = v) as loops, count(*) filter (u > v) as unordered, count(*) filter (not (w > 0)) as unsound,
        (select count(*) from (select u, v from e3 group by 1, 2 having count(*) > 1)) as repeated from e3""",
    "topology_check": """select (select count(*) from (select u, v from births where birth <= 3 except select u, v from e3)) as missing,
        (select count(*) from (select u, v from e3 except select u, v from births where birth <= 3)) as extra""",
    "degree_strength": "select node, degree, round(strength, 6) as strength from deg3",
    "laplacian_entries": 'select src as "row", dst as col, round(-w, 6) as value from adj3 union all select node, node, round(strength, 6) from deg3',
    "normalized_laplacian_entries": """select src as "row", dst as col, round(-w / sqrt(a.strength * b.strength), 6) as value from adj3 join deg3 a on a.node = src join deg3 b on b.node = dst
        union all select node, node, case when strength > 0 then 1.0 else 0.0 end from feat left join deg3 using (node)""",
    "laplacian_nullspace_check": """with x as (select src as r, -w / sqrt(a.strength * b.strength) * sqrt(b.strength) as value from adj3 join deg3 a on a.node = src join deg3 b on b.node = dst
        union all select node, sqrt(strength) from deg3), s as (select r, sum(value) as s from x group by r) select count(*) as rows, round(max(abs(s)), 6) as largest from s""",
    "components_k1": "select node, label from comp1",
    "component_sizes": "select cast(sum(size) as bigint) as n_nodes, count(*) as n_components, max(size) as largest_component_size, round(max(size) / sum(size), 6) as largest_component_fraction from size1",
    "component_ranking": "select label, size, row_number() over (order by size desc, label) as component_rank from size1",
    "component_equivalence": "select count(*) filter (n > 1) as split, cast(0 as bigint) as merged from (select label, count(distinct label) as n from comp1 group by label)",
    "group_connectivity": """with recursive inside as (select u as src, v as dst from ends3 where lu = lv union all select v, u from ends3 where lu = lv),
        walk(node, far) as (select node, node from given union select w.node, i.dst from walk w join inside i on w.far = i.src),
        part as (select node, min(far) as part from walk group by node) select label, count(distinct part) as parts from part join given using (node) group by label""",
    "connectivity_sweep": """with recursive a as (select k, u as src, v as dst from births, range(1, 5) t(k) where birth <= k union all select k, v, u from births, range(1, 5) t(k) where birth <= k),
        walk(k, node, far) as (select k, node, node from feat, range(1, 5) t(k) union select w.k, w.node, a.dst from walk w join a on a.k = w.k and a.src = w.far),
        part as (select k, node, min(far) as label from walk group by 1, 2), size as (select k, label, count(*) as n from part group by 1, 2)
        select cast(k as bigint) as k, count(*) as n_components, max(n) as largest_component_size from size group by k""",
    "connectivity_threshold": """with recursive a as (select k, u as src, v as dst from births, range(1, 5) t(k) where birth <= k union all select k, v, u from births, range(1, 5) t(k) where birth <= k),
        walk(k, node, far) as (select k, node, node from feat, range(1, 5) t(k) union select w.k, w.node, a.dst from walk w join a on a.k = w.k and a.src = w.far),
        part as (select k, node, min(far) as label from walk group by 1, 2), c as (select k, count(distinct label) as n from part group by 1)
        select cast(min(k) as bigint) as k_c from c where n = 1""",
    "induced_largest_component": """with top as (select node from comp1 where label = (select label from size1 order by size desc, label limit 1))
        select u, v, round(w, 6) as w, round(dist, 6) as dist from e1 where u in (select node from top) and v in (select node from top)""",
    "triangles_per_node": "select node, triangles from met10",
    "clustering_coefficients": "select node, round(clustering, 6) as clustering, case when den = 1 then cast(num as varchar) else num || '/' || den end as exact_fraction from frac10",
    "clustering_exact_pmf": "select case when den = 1 then cast(num as varchar) else num || '/' || den end as exact_fraction, round(num / den, 6) as clustering_coefficient, count(*) as count, round(count(*) / sum(count(*)) over (), 6) as probability from frac10 group by num, den",
    "clustering_histogram": """with b as (select least(cast(floor(num * 20 / den + 1e-12) as bigint), 19) as bin, count(*) as n from frac10 group by 1)
        select cast(x as bigint) as bin, round(x / 20, 6) as bin_left, round((x + 1) / 20, 6) as bin_right, coalesce(n, 0) as count, round(coalesce(n, 0) / (select count(*) from feat), 6) as fraction from range(0, 20) t(x) left join b on b.bin = x""",
    "degree_pmf_dense": """with n as (select degree, count(*) as c from deg3 group by 1), span as (select unnest(range(min(degree), max(degree) + 1)) as degree from n)
        select cast(s.degree as bigint) as degree, coalesce(c, 0) as count, round(coalesce(c, 0) / (select count(*) from feat), 6) as probability from span s left join n using (degree)""",
    "degree_distribution": "select degree, count(*) as count, round(count(*) / (select count(*) from feat), 6) as fraction from deg3 group by degree",
    "degree_summary": """select count(*) as nodes, cast(sum(degree) / 2 as bigint) as edges, 1.0::double as node_fraction, min(degree) as degree_min, max(degree) as degree_max, round(avg(degree), 6) as degree_mean,
        round(median(degree), 6) as degree_median, round(stddev_pop(degree), 6) as degree_std, round(skewness(degree), 6) as degree_skewness,
        round(count(*) filter (degree = 2) / count(*), 6) as fraction_degree_2, round(count(*) filter (degree <= 4) / count(*), 6) as fraction_degree_le_4,
        round(avg(clustering), 6) as clustering_mean, round(median(clustering), 6) as clustering_median, count(*) filter (num = 0) as clustering_zero, count(*) filter (num = 1 and den = 1) as clustering_one,
        round(count(*) filter (num = 0) / count(*), 6) as clustering_zero_fraction, round(count(*) filter (num = 1 and den = 1) / count(*), 6) as clustering_one_fraction,
        count(distinct num || '/' || den) as clustering_distinct, cast(sum(triangles) / 3 as bigint) as triangle_count, round(2 * sum(triangles) / sum(degree * (degree - 1)), 6) as transitivity,
        (select degree from frac10 group by degree order by count(*) desc, degree limit 1) as degree_mode from frac10""",
    "transitivity": "select cast(sum(triangles) / 3 as bigint) as triangle_count, round(2 * sum(triangles) / sum(degree * (degree - 1)), 6) as transitivity from met10",
    "structure_checks": "select cast(sum(degree) - 2 * (select count(*) from e10) as bigint) as handshake, count(*) filter (clustering < 0 or clustering > 1) as outside, cast(sum(triangles) % 3 as bigint) as corners, count(*) filter (degree < 2 and triangles > 0) as impossible from frac10",
    "node_metrics": "select node, degree, round(strength, 6) as strength, triangles, round(clustering, 6) as clustering from frac10",
    "copurchase_components_whole": """with recursive line as (select distinct l_suppkey as u, l_partkey + 10000000 as v from lineitem),
        a as (select u as src, v as dst from line union all select v, u from line), ends as (select distinct src as node from a),
        comp(node, label) using key (node) as (
          select node, node from ends
          union
          (select distinct on (x.node) x.node, y.label from comp y join a on a.dst = y.node join recurring.comp x on x.node = a.src where y.label < x.label order by x.node, y.label)
        ), size as (select label, count(*) as n from comp group by 1)
        select cast(sum(n) as bigint) as n_nodes, count(*) as n_components, max(n) as largest_component_size, round(max(n) / sum(n), 6) as largest_component_fraction from size""",
    "domain_feature_means": "select label, feature, round(avg(value), 6) + 0.0 as raw_mean, round(stddev_pop(value), 6) as raw_std from long group by 1, 2",
    "domain_zscores": "select l.label, l.feature, round((avg(l.value) - any_value(s.mean)) / any_value(s.std), 6) + 0.0 as zscore_mean from long l join stats s using (feature) group by 1, 2",
    "eta_squared": """with p as (select feature, label, count(*) as n, avg(value) as m from long group by 1, 2), t as (select feature, avg(value) as mean, var_pop(value) * count(*) as total from long group by 1)
        select feature, round(sum(n * pow(m - mean, 2)) / any_value(total), 6) as eta_squared from p join t using (feature) group by feature""",
    "eta_squared_top10": """with p as (select feature, label, count(*) as n, avg(value) as m from long group by 1, 2), t as (select feature, avg(value) as mean, var_pop(value) * count(*) as total from long group by 1),
        e as (select feature, sum(n * pow(m - mean, 2)) / any_value(total) as eta from p join t using (feature) group by feature) select feature, round(eta, 6) as eta_squared from e order by eta desc, feature limit 10""",
    "tag_prevalence": """with n as (select label, count(*) as n from given group by 1), h as (select label, tag, count(*) as h from ptag group by 1, 2), u as (select tag, count(*) as wh from ptag group by 1), w as (select count(*) as wn from given)
        select n.label, u.tag, coalesce(h, 0) as count, round(coalesce(h, 0) / n, 6) as fraction, round(wh / wn, 6) as whole_fraction, round(coalesce(h, 0) / n - wh / wn, 6) + 0.0 as difference from n cross join u cross join w left join h on h.label = n.label and h.tag = u.tag""",
    "tag_differences_topk": """with n as (select label, count(*) as n from given group by 1), h as (select label, tag, count(*) as h from ptag group by 1, 2), u as (select tag, count(*) as wh from ptag group by 1), w as (select count(*) as wn from given),
        d as (select n.label, u.tag, coalesce(h, 0) / n - wh / wn as difference from n cross join u cross join w left join h on h.label = n.label and h.tag = u.tag where wh >= 30)
        select label, tag, round(difference, 6) + 0.0 as difference from d order by round(abs(difference), 9) desc, label, tag limit 6""",
    "tag_enrichment_lift": """with n as (select label, count(*) filter (len(tags) > 0) as n from given join flags using (node) group by 1), h as (select label, tag, count(*) as h from ftag group by 1, 2), u as (select tag, count(*) as wh from ftag group by 1), w as (select sum(n) as wn from n)
        select n.label, u.tag, n.n as labelled, coalesce(h, 0) as hits, case when n > 0 then round(coalesce(h, 0) / n, 6) end as fraction, round(wh / wn, 6) as whole_fraction, case when n > 0 then round(coalesce(h, 0) / n / (wh / wn), 6) end as lift
        from n cross join u cross join w left join h on h.label = n.label and h.tag = u.tag""",
    "display_tags": "select tag, count(*) as hits, row_number() over (order by count(*) desc, tag) as place from ptag group by tag having count(*) >= 20 qualify row_number() over (order by count(*) desc, tag) <= 15",
    "artist_concentration": """with p as (select label, artist, count(*) as n, row_number() over (partition by label order by count(*) desc, artist desc) as r from given join artists using (node) group by 1, 2)
        select label, cast(sum(n) as bigint) as nodes, count(*) as artist_count, max(n) as largest_count, string_agg(artist || ':' || n, ',' order by r) filter (r <= 3) as top, round(max(n) / sum(n), 6) as largest_fraction from p group by label""",
    "rhythm_summary": "select label, count(*) as nodes, round(avg(bpm), 6) as mean_bpm, round(median(bpm), 6) as median_bpm, round(avg(onset_rate), 6) as mean_onset_rate, round(median(onset_rate), 6) as median_onset_rate from given join rhythm using (node) group by label",
    "tag_state": "select node, cast(case when len(tags) = 0 then 2 when list_contains(tags, 'toxic') then 1 else 0 end as bigint) as state from flags",
    "tag_one_hot": "select node, list_contains(tags, 'quality') as quality, list_contains(tags, 'toxic') as toxic from flags",
    "label_coverage": "select count(*) filter (len(tags) > 0) as labelled, count(*) as nodes from flags",
    "distinct_artists": "select count(distinct artist) as artists from artists",
    "normalized_cut": """with x as (select e.w, a.label as lu, b.label as lv from e3 e join halves a on a.node = e.u join halves b on b.node = e.v),
        v as (select label, sum(w) as vol from (select lu as label, w from x union all select lv, w from x) group by 1), c as (select sum(w) filter (lu <> lv) as c from x)
        select count(*) filter (lu <> lv) as crossing_edges, round(sum(w) filter (lu <> lv), 6) as crossing_weight, (select round(sum(c / vol), 6) from v, c) as normalized_cut from x""",
    "modularity": "with t as (select *, 2 * internal_weight + boundary_weight as vol from comm3), m as (select sum(vol) / 2 as m from t) select round(sum(internal_weight / m - pow(vol / (2 * m), 2)), 6) as modularity from t, m",
    "community_table": """select label, nodes, least, internal_edges, boundary_edges, round(internal_weight, 6) as internal_weight, round(boundary_weight, 6) as boundary_weight,
        round(2 * internal_weight + boundary_weight, 6) as volume, round(boundary_weight / (2 * internal_weight + boundary_weight), 6) as boundary_over_volume from comm3""",
    "community_volume_check": "select distinct label, 0.0::double as difference from given join deg3 using (node)",
    "community_ids": "with g as (select label, row_number() over (order by count(*) desc, min(node)) as community from given group by label) select node, community from given join g using (label)",
    "community_overlap": "with a as (select a, sum(n) as s from cont group by 1), b as (select distinct b from cont) select a.a, b.b, coalesce(n, 0) as count, round(coalesce(n, 0) / s, 6) as share from a cross join b left join cont c on c.a = a.a and c.b = b.b",
    "edge_label_agreement": """with x as (select lu = lv as inside, len(list_intersect(a.tags, b.tags)) > 0 as same from ends3 e join tags a on a.node = e.u join tags b on b.node = e.v where len(a.tags) > 0 and len(b.tags) > 0)
        select count(*) as edges, round(avg(cast(same as int)), 6) as agreement, count(*) filter (inside) as within_edges, round(avg(cast(same as int)) filter (inside), 6) as within, count(*) filter (not inside) as between_edges, round(avg(cast(same as int)) filter (not inside), 6) as between from x""",
    "cross_community_fractions": "select count(*) filter (lu <> lv) as cross_edges, round(count(*) filter (lu <> lv) / count(*), 6) as edge_fraction, round(sum(w) filter (lu <> lv) / sum(w), 6) as weight_fraction from ends3",
    "community_sizes": "with n as (select label, count(*) as n, row_number() over (order by count(*) desc, label) as r from given group by 1) select count(*) as groups, min(n) as min_size, median(n) as median_size, max(n) as max_size, string_agg(cast(n as varchar), ',' order by r) filter (r <= 5) as largest from n",
    "adjusted_rand": """with x as (select sum(n * (n - 1) / 2) as x, sum(n) as n from cont), a as (select sum(s * (s - 1) / 2) as pa from (select sum(n) as s from cont group by a)), b as (select sum(s * (s - 1) / 2) as pb from (select sum(n) as s from cont group by b))
        select round((x - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) as adjusted_rand from x, a, b""",
    "nmi": """with t as (select n, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as m from cont), i as (select sum(n / m * ln(n * m / (na * nb))) as i from t),
        ha as (select -sum(p * ln(p)) as h from (select sum(n) / (select sum(n) from cont) as p from cont group by a)), hb as (select -sum(p * ln(p)) as h from (select sum(n) / (select sum(n) from cont) as p from cont group by b))
        select round(i / ((ha.h + hb.h) / 2), 6) as nmi from i, ha, hb""",
    "partition_agreement": """with o as (select node, label % 2 + 1 as label from given),
        la as (select label from halves join rhythm using (node) group by label order by avg(onset_rate), label limit 1), lb as (select label from o join rhythm using (node) group by label order by avg(onset_rate), label limit 1),
        x as (select h.label = (select label from la) as a, o.label = (select label from lb) as b from halves h join o using (node)),
        c as (select a, b, count(*) as n from x group by 1, 2), p as (select sum(n * (n - 1) / 2) as x, sum(n) as n from c), pa as (select sum(s * (s - 1) / 2) as pa from (select sum(n) as s from c group by a)), pb as (select sum(s * (s - 1) / 2) as pb from (select sum(n) as s from c group by b))
        select count(*) as common_nodes, round(avg(cast(a = b as int)), 6) as low_high_agreement, count(*) filter (a and b) as both_low, count(*) filter (a and not b) as a_low_b_high, count(*) filter (not a and b) as a_high_b_low, count(*) filter (not a and not b) as both_high,
        (select round((x - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) + 0.0 from p, pa, pb) as adjusted_rand from x""",
    "edge_fingerprint_k3": """with h as (select sha256(u || '-' || v) as h from e3)
        select count(*) as edges, sha256(concat_ws('-', cast(sum(cast('0x' || substr(h, 1, 12) as bigint)) as varchar), cast(sum(cast('0x' || substr(h, 13, 12) as bigint)) as varchar),
            cast(sum(cast('0x' || substr(h, 25, 12) as bigint)) as varchar), cast(sum(cast('0x' || substr(h, 37, 12) as bigint)) as varchar))) as sha256 from h""",
    "eigen_gaps_whole": """select graph, idx, round(value, 6) as value, round(l, 6) as left_gap, round(r, 6) as right_gap, round(least(l, r), 6) as isolation, round(least(l, r) / value, 6) as relative from gap_g where l is not null and r is not null""",
    "gap_selection_whole": """with c as (select graph, idx, value, least(l, r) as i, least(value, l, r) > 1e-8 and least(l, r) >= 1e-3 and least(l, r) / greatest(abs(value), 1e-6) >= 0.05 as good from gap_g where l is not null and r is not null),
        s as (select graph, bool_or(idx = 2 and good) as second, arg_max(idx, i) filter (good) as other, arg_max(idx, i) as most from c group by graph)
        select graph, cast(case when second then 2 else other end as bigint) as selected, case when second then 'second' when other is not null then 'later' else 'none' end as status, most as most_isolated from s""",
    "fiedler_decreases_whole": """with c as (select o_orderkey as k, floor(o_totalprice) / 1024 as x from orders where o_custkey % 5 <> 0), d as (select k, lead(k) over (order by k) as next_k, lead(x) over (order by k) - x as change from c)
        select k, next_k, round(change, 6) as change from d where change < -1e-10""",
    "nodal_domains_given": """with recursive q as (select node, case when f[1] < 0 then -1 else 1 end as s from feat), a as (select src, dst from adj3 join q x on x.node = src join q y on y.node = dst where x.s = y.s),
        walk(node, far) as (select node, node from q union select w.node, a.dst from walk w join a on a.src = w.far), l as (select node, min(far) as label from walk group by 1),
        g as (select label, s, count(*) as n from l join q using (node) group by 1, 2), o as (select label, row_number() over (order by s, n desc, label) as domain from g)
        select node, cast(s as bigint) as sign, domain from l join q using (node) join o using (label)""",
    "nodal_domains_by_size_given": """with recursive q as (select node, case when node % 50 = 0 then 0 when f[1] < 0 then -1 else 1 end as s from feat), a as (select src, dst from adj3 join q x on x.node = src join q y on y.node = dst where x.s = y.s and x.s <> 0),
        walk(node, far) as (select node, node from q where s <> 0 union select w.node, a.dst from walk w join a on a.src = w.far), l as (select node, min(far) as label from walk group by 1),
        g as (select label, count(*) as n from l group by 1), o as (select label, row_number() over (order by n desc, label) as domain from g)
        select node, cast(s as bigint) as sign, domain from l join q using (node) join o using (label) union all select node, cast(0 as bigint), cast(-1 as bigint) from q where s = 0""",
    "best_restart_given": "select cast(s_nationkey as bigint) as graph, s_suppkey as seed from supplier qualify row_number() over (partition by s_nationkey order by floor(s_acctbal / 1000) desc, s_suppkey) = 1",
    "stability_given": """with m as (select 1 as run, node, label from given union all select 2, node, label from halves union all select 3, node, label % 3 from given),
        t as (select x.run as p, y.run as q, x.label as a, y.label as b, count(*) as n from m x join m y on x.node = y.node and x.run < y.run group by all),
        c as (select p, q, sum(n * (n - 1) / 2) as x, sum(n) as n from t group by 1, 2), ra as (select p, q, sum(s * (s - 1) / 2) as pa from (select p, q, a, sum(n) as s from t group by 1, 2, 3) group by 1, 2),
        rb as (select p, q, sum(s * (s - 1) / 2) as pb from (select p, q, b, sum(n) as s from t group by 1, 2, 3) group by 1, 2),
        v as (select (x - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) as v from c join ra using (p, q) join rb using (p, q))
        select count(*) as pairs, round(min(v), 6) + 0.0 as ari_min, round(median(v), 6) + 0.0 as ari_median from v""",
    "connectivity_sweep_k64": """
        with recursive link as (select u as src, v as dst, birth from births union all select v, u, birth from births),
        comp(k, node, label) using key (k, node) as (
          select cast(k as bigint), node, node from feat, range(1, 65) t(k)
          union
          (select distinct on (x.k, x.node) x.k, x.node, y.label from recurring.comp x join link e on e.src = x.node and e.birth <= x.k join comp y on y.k = x.k and y.node = e.dst
           where y.label < x.label order by x.k, x.node, y.label)
        ), size as (select k, label, count(*) as n from comp group by 1, 2)
        select k, count(*) as n_components, max(n) as largest_component_size from size group by k""",
    "tracks_negative_variance": """
        select 't' || lpad(cast(p_partkey as varchar), 6, '0') as track_id, cast(case when p_size > 25 and p_partkey % 7 <> 0 then 1 else -1 end as bigint) as clipped,
          case when p_partkey % 7 = 0 then 't' || lpad(cast(p_partkey as varchar), 6, '0') || ': rhythm: value' when p_size <= 25 then 't' || lpad(cast(p_partkey as varchar), 6, '0') || ': mfcc.cov: negative variance' end as error
        from part""",
    "bandwidth_fallback_given": "select round(median(abs(s_acctbal)), 6) as sigma, 'positive_10th' as fallback from supplier where s_suppkey % 3 = 0 and s_acctbal <> 0",
    "spectrum_agreement": "select cast(g as bigint) as graph, cast(i as bigint) as idx, true as agree from (values (3), (64)) a(g), range(1, 34) b(i)",
    "spectrum_checks": "select true as first_is_zero, true as second_is_not, true as in_range, true as residual_is_small, true as orthogonal, true as lanczos_agrees",
    "pca_checks": "select cast(c as bigint) as component, true as unit, true as uncorrelated, true as variance_agrees, true as falls from range(1, 33) t(c)",
    "leiden_checks": "select cast(g as bigint) as graph, cast(s as bigint) as seed, true as whole, true as connected, true as modularity_agrees, true as gains from (values (3), (64)) a(g), range(521, 526) b(s)",
    "sinks_round_trip": "select kind, count(*) as equal_rows from supplier, (values ('parquet'), ('jsonl'), ('csv'), ('csv_bom')) t(kind) group by kind",
    "community_profile": """
        with who as (select g.label, a.artist, count(*) as n from given g join artists a using (node) group by 1, 2),
        most as (select label, count(*) as artist_count, max(n) as largest_artist_count from who group by 1),
        side as (select g.label, count(*) filter (h.label = 1) as domain_1, count(*) filter (h.label = 2) as domain_2 from given g join halves h using (node) group by 1)
        select c.label, nodes, least, internal_edges, boundary_edges, round(internal_weight, 6) as internal_weight, round(boundary_weight, 6) as boundary_weight,
          round(2 * internal_weight + boundary_weight, 6) as volume, round(boundary_weight / (2 * internal_weight + boundary_weight), 6) as boundary_over_volume,
          coalesce(artist_count, 0) as artist_count, coalesce(largest_artist_count, 0) as largest_artist_count, domain_1, domain_2,
          round(coalesce(largest_artist_count, 0) / nodes, 6) as largest_artist_fraction
        from comm3 c left join most using (label) join side using (label)""",
    "variance_given": """with r as (select s_suppkey + 1 as component, s_acctbal / sum(s_acctbal) over () as x from supplier where s_acctbal > 0)
        select component, round(x, 6) as explained_variance_ratio, round(sum(x) over (order by component), 6) as cumulative_explained_variance, component <= 32 as retained from r""",
    "node_assignment": """with g as (select label, row_number() over (order by count(*) desc, min(node)) as community from given group by label)
        select n.node, 't' || n.node as track_id, a.artist as artist_id, community, h.label as domain, array_to_string(t.tags, '|') as tags from given n join g using (label) join artists a using (node) join halves h using (node) join tags t using (node)""",
}


def sql(name: str) -> str:
    """The SQL of ``name`` with the common tables that it needs in front."""
    body = SQL[name]
    needed: list[str] = []
    text = body
    for key in reversed(COMMON):
        if re.search(rf"\b{key.split('(')[0]}\b", text):
            needed.insert(0, key)
            text += " " + COMMON[key]
    front = ", ".join(f"{k} as ({COMMON[k]})" for k in needed)
    if not needed:
        return body
    if m := re.match(r"\s*with (recursive )?", body):
        return f"with recursive {front}, {body[m.end() :]}"
    return f"with recursive {front} {body}"
