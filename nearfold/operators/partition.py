"""What groups of nodes have in common, how good a partition is, and how far two agree.

Partitions are (node, label). Tags are (node, tags array<string>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import long_form


def _all():
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def feature_means(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, feature, raw_mean, raw_std, zscore_mean): zscores within all nodes of the partition, 0 for constant features."""
    x = long_form(features).join(labels, "node")
    whole = x.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    part = x.groupBy("label", "feature").agg(F.avg("value").alias("raw_mean"), F.stddev_pop("value").alias("raw_std"))
    z = F.when(F.col("s") > 0, (F.col("raw_mean") - F.col("m")) / F.col("s")).otherwise(0.0)
    return part.join(whole, "feature").select("label", "feature", "raw_mean", "raw_std", z.alias("zscore_mean"))


def eta_squared(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(feature, eta_squared): between-group over total sum of squares, 0 without variance; the boundary, -1, is left out."""
    x = long_form(features).join(labels.where("label <> -1"), "node")
    part = x.groupBy("feature", "label").agg(F.count("value").alias("n"), F.avg("value").alias("m"))
    whole = x.groupBy("feature").agg(F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("total"))
    between = part.join(whole, "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"), F.first("total").alias("total"))
    return between.select("feature", F.when(F.col("total") > 0, F.col("between") / F.col("total")).otherwise(0.0).alias("eta_squared"))


def ranked(eta: DataFrame, n: int = 10) -> DataFrame:
    return eta.orderBy(F.desc("eta_squared"), "feature").limit(n)


def tag_universe(tags: DataFrame, labels: DataFrame) -> DataFrame:
    """(tag, hits) over the nodes of the partition."""
    return tags.join(labels.select("node"), "node", "left_semi").select("node", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("hits"))


def _hits(tags: DataFrame, labels: DataFrame, labelled_only: bool) -> DataFrame:
    """(label, tag, hits, n, whole_hits, whole_n) with zeros."""
    t = labels.join(tags, "node", "left").select("label", F.coalesce(F.array_distinct("tags"), F.array().cast("array<string>")).alias("tags"))
    counted = F.count_if(F.size("tags") > 0) if labelled_only else F.count(F.lit(1))
    sizes = t.groupBy("label").agg(counted.alias("n")).withColumn("whole_n", F.sum("n").over(_all()))
    per = t.select("label", F.explode("tags").alias("tag")).groupBy("label", "tag").agg(F.count(F.lit(1)).alias("h"))
    universe = per.groupBy("tag").agg(F.sum("h").alias("whole_hits"))
    # groups by tags, neither of which grows with the nodes
    return sizes.crossJoin(universe).join(per, ["label", "tag"], "left").select("label", "tag", F.coalesce("h", F.lit(0)).cast("long").alias("hits"), "n", "whole_hits", "whole_n")


def tag_prevalence(tags: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, tag, count, fraction, whole_fraction, difference) of all nodes."""
    h = _hits(tags, labels, False)
    return h.select("label", "tag", F.col("hits").alias("count"), (F.col("hits") / F.col("n")).alias("fraction"), (F.col("whole_hits") / F.col("whole_n")).alias("whole_fraction"), (F.col("hits") / F.col("n") - F.col("whole_hits") / F.col("whole_n")).alias("difference"), "whole_hits")


def largest_differences(prevalence: DataFrame, support: int = 30, n: int = 6) -> DataFrame:
    return prevalence.where(F.col("whole_hits") >= support).orderBy(F.desc(F.round(F.abs("difference"), 9)), "label", "tag").limit(n)


def tag_enrichment(tags: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, tag, labelled, hits, fraction, whole_fraction, lift) of the nodes that have tags; null without any."""
    h = _hits(tags, labels, True)
    p, base = F.try_divide("hits", "n"), F.try_divide("whole_hits", "whole_n")
    return h.select("label", "tag", F.col("n").alias("labelled"), "hits", p.alias("fraction"), base.alias("whole_fraction"), F.try_divide(p, base).alias("lift"))


def display_tags(universe: DataFrame, support: int = 20, n: int = 15) -> DataFrame:
    """(tag, hits, place): the commonest tags."""
    return universe.where(F.col("hits") >= support).withColumn("place", F.row_number().over(Window.orderBy(F.desc("hits"), "tag"))).where(F.col("place") <= n)


def artist_concentration(artists: DataFrame, labels: DataFrame, top: int = 3) -> DataFrame:
    """(label, nodes, artist_count, largest_count, largest_fraction, top array<struct<artist, count>>): by count and then id, both
    downwards, from (node, artist)."""
    per = labels.join(artists, "node").groupBy("label", "artist").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), F.desc("artist")))
    firsts = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "artist", "n")))), lambda s: F.struct(s["artist"].alias("artist"), s["n"].alias("count")))
    g = per.withColumn("rank", rank).groupBy("label").agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("artist_count"), F.max("n").alias("largest_count"), firsts.alias("top"))
    return g.withColumn("largest_fraction", F.col("largest_count") / F.col("nodes"))


def rhythm_summary(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, nodes, mean_bpm, median_bpm, mean_onset_rate, median_onset_rate) from (node, bpm, onset_rate)."""
    return labels.join(values, "node").groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.avg("bpm").alias("mean_bpm"), F.median("bpm").alias("median_bpm"), F.avg("onset_rate").alias("mean_onset_rate"), F.median("onset_rate").alias("median_onset_rate"))


def tag_state(tags: Column, tag: str) -> Column:
    """2 without any tag, 1 with this one, else 0."""
    return F.when(F.coalesce(F.size(tags), F.lit(0)) < 1, 2).when(F.array_contains(tags, tag), 1).otherwise(0)


def one_hot(tags: DataFrame, names: list[str]) -> DataFrame:
    """(node, one boolean for each name)."""
    return tags.select("node", *(F.coalesce(F.array_contains("tags", t), F.lit(False)).alias(t) for t in names))


def label_coverage(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count_if(F.coalesce(F.size("tags"), F.lit(0)) > 0).alias("labelled"), F.count(F.lit(1)).alias("nodes"))


def canonical(labels: DataFrame) -> DataFrame:
    """(node, community): numbers from 1 by size downwards and then smallest member."""
    g = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    g = g.withColumn("community", F.row_number().over(Window.orderBy(F.desc("n"), "least"))).select("label", "community")
    return labels.join(g, "label").select("node", "community")


def _ends(edges: DataFrame, labels: DataFrame) -> DataFrame:
    u, v = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "uv")
    return edges.join(u, "u").join(v, "v")


def community_table(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, nodes, least, internal_edges, boundary_edges, internal_weight, boundary_weight, volume, boundary_over_volume)."""
    e = _ends(edges, labels).withColumn("inside", F.col("lu") == F.col("lv"))
    sides = e.select(F.col("lu").alias("label"), "inside", "w").unionAll(e.where("not inside").select("lv", "inside", "w"))
    per = sides.groupBy("label").agg(
        F.count_if("inside").alias("internal_edges"),
        F.count_if(~F.col("inside")).alias("boundary_edges"),
        F.coalesce(F.sum(F.when(F.col("inside"), F.col("w"))), F.lit(0.0)).alias("internal_weight"),
        F.coalesce(F.sum(F.when(~F.col("inside"), F.col("w"))), F.lit(0.0)).alias("boundary_weight"),
    )
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("least"))
    out = size.join(per, "label", "left").na.fill(0, ["internal_edges", "boundary_edges", "internal_weight", "boundary_weight"])
    out = out.withColumn("volume", 2 * F.col("internal_weight") + F.col("boundary_weight"))
    return out.withColumn("boundary_over_volume", F.try_divide("boundary_weight", "volume"))


def community_profile(edges: DataFrame, labels: DataFrame, artists: DataFrame, domains: DataFrame, names: tuple[int, ...] = (1, 2)) -> DataFrame:
    """community_table() with artist_count, largest_artist_count, largest_artist_fraction from (node, artist), and domain_1, ... the
    nodes in each domain of (node, domain)."""
    a = labels.join(artists, "node").groupBy("label", "artist").agg(F.count(F.lit(1)).alias("n"))
    a = a.groupBy("label").agg(F.count(F.lit(1)).alias("artist_count"), F.max("n").alias("largest_artist_count"))
    d = labels.join(domains, "node").groupBy("label").agg(*(F.count_if(F.col("domain") == x).alias(f"domain_{x}") for x in names))
    out = community_table(edges, labels).join(a, "label", "left").join(d, "label", "left")
    out = out.na.fill(0, ["artist_count", "largest_artist_count", *(f"domain_{x}" for x in names)])
    return out.withColumn("largest_artist_fraction", F.col("largest_artist_count") / F.col("nodes"))


def volume_check(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, difference) of the volume by strengths and by edges, 0 but for rounding."""
    ends = edges.select(F.col("u").alias("node"), "w").unionAll(edges.select("v", "w")).join(labels, "node").groupBy("label").agg(F.sum("w").alias("strength"))
    return community_table(edges, labels).join(ends, "label").select("label", (F.col("strength") - F.col("volume")).alias("difference"))


def modularity(table: DataFrame) -> DataFrame:
    """(modularity) from community_table(): sum of internal / m - (volume / 2 m) ** 2."""
    m = F.sum("volume").over(_all()) / 2
    return table.select((F.col("internal_weight") / m - F.pow(F.col("volume") / (2 * m), 2)).alias("q")).agg(F.sum("q").alias("modularity"))


def modularities(ends: DataFrame, by: list[str]) -> DataFrame:
    """(by..., modularity) of several partitions at once, from edges (by..., lu, lv, w) with the groups of their ends."""
    inside = F.sum(F.when(F.col("lu") == F.col("lv"), F.col("w")).otherwise(0.0)).alias("inside")
    sides = ends.groupBy(*by, F.col("lu").alias("label")).agg(F.sum("w").alias("w"), inside)
    sides = sides.unionByName(ends.groupBy(*by, F.col("lv").alias("label")).agg(F.sum("w").alias("w"), F.lit(0.0).alias("inside")))
    per = sides.groupBy(*by, "label").agg(F.sum("w").alias("volume"), F.sum("inside").alias("inside"))
    twice = F.sum("volume")
    return per.groupBy(by).agg((2 * F.sum("inside") / twice - F.sum(F.col("volume") * F.col("volume")) / (twice * twice)).alias("modularity"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, count, share) for all groups of two partitions, zeros included; share of the nodes of a."""
    x = a.select("node", F.col("label").alias("a")).join(b.select("node", F.col("label").alias("b")), "node")
    n = x.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    grid = n.groupBy("a").agg(F.sum("n").alias("size")).crossJoin(n.select("b").distinct())  # groups by groups
    return grid.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("count"), (F.coalesce("n", F.lit(0)) / F.col("size")).alias("share"))


def label_agreement(edges: DataFrame, labels: DataFrame, tags: DataFrame) -> DataFrame:
    """(edges, agreement, within_edges, within, between_edges, between): among edges of two tagged ends, the share of a common tag."""
    t = tags.where("size(tags) > 0")
    u, v = (t.select(F.col("node").alias(c), F.col("tags").alias(f"t{c}")) for c in "uv")
    e = _ends(edges, labels).join(u, "u").join(v, "v").select((F.col("lu") == F.col("lv")).alias("inside"), F.arrays_overlap("tu", "tv").alias("same"))
    share = lambda c: F.try_divide(F.count_if(c & F.col("same")), F.count_if(c))
    inside = F.col("inside")
    return e.agg(F.count(F.lit(1)).alias("edges"), share(F.lit(True)).alias("agreement"), F.count_if(inside).alias("within_edges"), share(inside).alias("within"), F.count_if(~inside).alias("between_edges"), share(~inside).alias("between"))


def cross_fractions(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(cross_edges, edge_fraction, weight_fraction)."""
    out = F.col("lu") != F.col("lv")
    return _ends(edges, labels).agg(F.count_if(out).alias("cross_edges"), (F.count_if(out) / F.count(F.lit(1))).alias("edge_fraction"), (F.coalesce(F.sum(F.when(out, F.col("w"))), F.lit(0.0)) / F.sum("w")).alias("weight_fraction"))


def size_summary(labels: DataFrame, top: int = 5) -> DataFrame:
    """(groups, min_size, median_size, max_size, largest array)."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest = n.orderBy(F.desc("n")).limit(top).agg(F.sort_array(F.collect_list("n"), asc=False).alias("largest"))
    return n.agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("min_size"), F.median("n").alias("median_size"), F.max("n").alias("max_size")).crossJoin(largest)


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n) of the nodes in both partitions."""
    return a.select("node", F.col("label").alias("a")).join(b.select("node", F.col("label").alias("b")), "node").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """(adjusted_rand) from a contingency table; 1 for trivial partitions that are equal."""
    cells = table.agg(F.sum(_pairs(F.col("n"))).alias("x"), F.sum("n").alias("n"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("ra"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("rb"))
    chance = F.col("ra") * F.col("rb") / _pairs(F.col("n"))
    value = F.coalesce(F.try_divide(F.col("x") - chance, (F.col("ra") + F.col("rb")) / 2 - chance), F.lit(1.0))
    return cells.crossJoin(rows).crossJoin(cols).select(value.alias("adjusted_rand"))  # one row each


def nmi(table: DataFrame) -> DataFrame:
    """(nmi): mutual information by the mean of the entropies; 1 where both are 0."""
    t = table.withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b"))).withColumn("all", F.sum("n").over(_all()))
    p = F.col("n") / F.col("all")
    info = t.agg(F.sum(p * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("i"))

    def entropy(side: str) -> DataFrame:
        q = F.col("n") / F.sum("n").over(_all())
        return table.groupBy(side).agg(F.sum("n").alias("n")).select((-q * F.log(q)).alias("h")).agg(F.sum("h").alias(f"h{side}"))

    value = F.coalesce(F.try_divide(F.col("i"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0))
    return info.crossJoin(entropy("a")).crossJoin(entropy("b")).select(value.alias("nmi"))  # one row each


def stability(memberships: DataFrame) -> DataFrame:
    """(pairs, ari_min, ari_median) over all pairs of runs of (run, node, label): a join per node and pair of runs, summed to
    contingency tables."""
    a = memberships.select("node", F.col("run").alias("ra"), F.col("label").alias("a"))
    b = memberships.select("node", F.col("run").alias("rb"), F.col("label").alias("b"))
    t = a.join(b, "node").where("ra < rb").groupBy("ra", "rb", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = ["ra", "rb"]
    cells = t.groupBy(both).agg(F.sum(_pairs(F.col("n"))).alias("x"), F.sum("n").alias("n"))
    sa = t.groupBy("ra", "rb", "a").agg(F.sum("n").alias("m")).groupBy(both).agg(F.sum(_pairs(F.col("m"))).alias("pa"))
    sb = t.groupBy("ra", "rb", "b").agg(F.sum("n").alias("m")).groupBy(both).agg(F.sum(_pairs(F.col("m"))).alias("pb"))
    chance = F.col("pa") * F.col("pb") / _pairs(F.col("n"))
    value = F.coalesce(F.try_divide(F.col("x") - chance, (F.col("pa") + F.col("pb")) / 2 - chance), F.lit(1.0))
    return cells.join(sa, both).join(sb, both).select(value.alias("v")).agg(F.count("v").alias("pairs"), F.min("v").alias("ari_min"), F.median("v").alias("ari_median"))


def low_high(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(node, low): whether the node's group has the smallest mean of (node, value); the boundary and groups below 1 are left out."""
    x = labels.where("label > 0")
    means = x.join(values, "node").groupBy("label").agg(F.avg("value").alias("m"))
    low = means.agg(F.min_by("label", F.struct("m", "label")).alias("low_label"))
    return x.crossJoin(F.broadcast(low)).select("node", (F.col("label") == F.col("low_label")).alias("low"))  # one row


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(common_nodes, low_high_agreement, both_low, a_low_b_high, a_high_b_low, both_high, adjusted_rand) of two low_high()."""
    x = a.select("node", F.col("low").alias("a")).join(b.select("node", F.col("low").alias("b")), "node")
    c = lambda p, q: F.count_if((F.col("a") == p) & (F.col("b") == q))
    counts = x.agg(F.count(F.lit(1)).alias("common_nodes"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("low_high_agreement"), c(True, True).alias("both_low"), c(True, False).alias("a_low_b_high"), c(False, True).alias("a_high_b_low"), c(False, False).alias("both_high"))
    return counts.crossJoin(adjusted_rand(x.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))))


def node_assignment(nodes: DataFrame, communities: DataFrame, domains: DataFrame) -> DataFrame:
    """``nodes`` (node, track_id, artist_id, tags) with community and domain, tags joined by a bar."""
    return nodes.join(communities, "node").join(domains, "node").select("node", "track_id", "artist_id", "community", "domain", F.array_join("tags", "|").alias("tags"))


def largest_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(rows, largest): of two runs' values by key."""
    x, y = a.select(key, F.col(value).alias("x")), b.select(key, F.col(value).alias("y"))
    return x.join(y, key).agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("x") - F.col("y"))).alias("largest"))
