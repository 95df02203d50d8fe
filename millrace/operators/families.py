"""Products that behave alike: cohesion of groups without their pairs, subgroups by attributes, clusters, and the family that a product borrows from.

A signature is rows (sku, slot, value): weekdays in slots 1 to 7, months in 8 to 19, months never seen missing (seasonality.signature).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.staging import staged

#: Weekdays and months of a signature.
SLOTS = 19
#: Joint months and slots without which two signatures can't be compared, and the likeness at which two products are alike.
JOINT_MONTHS, JOINT_SLOTS, ALIKE = 5, 3, 0.35
#: Members that a subgroup needs, its least cohesion, and what it must gain over its best parent, with an attribute that says what the product is or without.
MEMBERS, COHESION, GAIN, PLAIN_GAIN, DEPTH = 2, 0.35, 0.08, 0.20, 3
#: Ranks of attributes, fixed values: what a product is comes first, its incidental traits last, all others at 10.
RANKS = {
    "subcategory": 0, "sub_category": 0, "product_type": 1, "type": 1, "family": 1, "product_family": 1, "class": 2, "collection": 2, "style": 3, "vanity_type": 3, "mounting": 4, "mount_type": 4,
    "color": 20, "colour": 20, "finish": 20, "material": 20, "top_material": 20, "hardware_finish": 20, "size": 20, "dimensions": 20, "width": 20, "width_in": 20, "height": 20, "depth": 20, "weight": 20, "sink_count": 20,
}
#: Values that name no group, fixed values.
NO_GROUP = (
    "core", "misc", "miscellaneous", "other", "others", "general", "generic", "default", "uncategorized", "uncategorised", "none", "null", "n/a", "na", "various", "assorted",
    "unknown", "tbd", "item", "items", "product", "products", "sku", "new", "sale", "clearance", "everything else", "no category", "unsorted",
)


def baseline(signatures: DataFrame) -> DataFrame:
    """(slot, base): the catalogue's mean signature."""
    return signatures.groupBy("slot").agg(F.avg("value").alias("base"))


def distinctive(signatures: DataFrame) -> DataFrame:
    """Signatures less the catalogue's mean, which has 19 rows."""
    return signatures.join(F.broadcast(baseline(signatures)), "slot").select("sku", "slot", (F.col("value") - F.col("base")).alias("value"))


def cohesion(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """(group, members, cohesion): the mean correlation over all pairs of a group's members (group, sku) that have a signature; 0 for one alone.

    A correlation is the inner product of standardised signatures, so the sum over pairs follows from the sum of vectors: members are summed by the pattern of
    slots that they have, and patterns, of which there are few, meet in place of members.  Pairs that can't be compared count 0, two flat signatures 1.
    """
    patterns = signatures.groupBy("sku").agg(F.sum(F.expr("shiftleft(1, slot)")).cast("int").alias("own"))
    placed = members.select("group", "sku").distinct().join(patterns, "sku")
    size = placed.groupBy("group").agg(F.count("*").alias("members"))
    seen = placed.select("group", F.col("own").alias("met")).distinct()
    joint = placed.join(seen, "group").withColumn("joint", F.col("own").bitwiseAND(F.col("met")))
    comparable = (F.bit_count(F.shiftright("joint", 8)) >= JOINT_MONTHS) & (F.bit_count("joint") >= JOINT_SLOTS)
    joint = joint.where(comparable)
    values = joint.select("sku", "joint").distinct().join(signatures, "sku").where(F.expr("(joint & shiftleft(1, slot)) != 0"))
    stats = values.groupBy("sku", "joint").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"), F.collect_list(F.struct("slot", "value")).alias("vs"))
    flat = F.col("sd") < 1e-9
    z = F.transform("vs", lambda v: F.struct(v["slot"].cast("int").alias("slot"), ((v["value"] - F.col("mean")) / (F.col("sd") * F.sqrt("n"))).alias("z")))
    # flat members stand in a slot of their own, in which they agree with each other alone
    vectors = stats.select("sku", "joint", F.inline(F.when(flat, F.array(F.struct(F.lit(0).alias("slot"), F.lit(1.0).alias("z")))).otherwise(z)))
    sums = joint.join(vectors, ["sku", "joint"]).groupBy("group", "own", "met", "slot").agg(F.sum("z").alias("s"))
    other = sums.select("group", F.col("own").alias("met"), F.col("met").alias("own"), "slot", F.col("s").alias("t"))
    every = sums.join(other, ["group", "own", "met", "slot"]).groupBy("group").agg(F.sum(F.col("s") * F.col("t")).alias("total"))
    themselves = joint.where("own = met").groupBy("group").agg(F.count("*").alias("themselves"))
    pairs = F.col("members") * (F.col("members") - 1)
    mean = (F.coalesce("total", F.lit(0.0)) - F.coalesce("themselves", F.lit(0))) / pairs
    return size.join(every, "group", "left").join(themselves, "group", "left").select("group", "members", F.when(F.col("members") > 1, mean).otherwise(0.0).alias("cohesion"))


def attribute_columns(attributes: DataFrame) -> DataFrame:
    """(sku, name, value, rank) of attributes (sku, name, value) that can part a family: more than one value, and not nearly all their own."""
    value = F.trim(F.col("value").cast("string"))
    known = attributes.withColumn("value", value).where((F.col("value") != "") & ~F.lower("value").isin(*NO_GROUP))
    n = attributes.select("sku").distinct().agg(F.count("*").alias("n"))
    names = known.groupBy("name").agg(F.count_distinct("value").alias("kinds")).join(F.broadcast(n)).where("kinds > 1 AND kinds <= greatest(2, floor(0.75 * n))")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in RANKS.items() for x in item]), F.lower("name")), F.lit(10))
    return known.join(F.broadcast(names.select("name")), "name").select("sku", "name", "value", rank.alias("rank"))


def _subsets(parts: F.Column, proper: bool) -> F.Column:
    """The non-empty subsets of up to DEPTH of an array's elements, in the array's order; proper: without the whole."""
    empty = F.array(F.filter(parts, lambda x: F.lit(False)))
    grown = F.aggregate(parts, empty, lambda sets, x: F.concat(sets, F.transform(F.filter(sets, lambda s: F.size(s) < DEPTH), lambda s: F.concat(s, F.array(x)))))
    return F.filter(grown, lambda s: (F.size(s) > 0) & ((F.size(s) < F.size(parts)) if proper else F.lit(True)))


def _name(base: F.Column, parts: F.Column) -> F.Column:
    return F.concat_ws(" | ", base, F.transform(parts, lambda p: F.concat(p["name"], F.lit(":"), p["value"])))


def adaptive_groups(products: DataFrame, attributes: DataFrame, signatures: DataFrame) -> DataFrame:
    """(sku, base, group, level, members, cohesion, gain): per product the most trustworthy group of its family.

    products has (sku, base, days); base is null or a word of NO_GROUP for a product without family.  Subgroups by up to DEPTH attributes (sku, name, value) are the
    lattice of a family; one is taken if it has MEMBERS with half a year of days and a signature, agrees beyond the catalogue's rhythm, and agrees better than the
    family and than all its parents in the lattice.  Of several the one that says what the product is wins, then that with most members, cohesion and gain.
    """
    family = F.when(~F.lower(F.trim("base")).isin(*NO_GROUP) & (F.trim("base") != ""), F.col("base"))
    rows = products.select("sku", family.alias("base"), (F.coalesce("days", F.lit(0)) >= 180).alias("long"))
    usable = rows.where("long AND base IS NOT NULL").join(signatures.select("sku").distinct(), "sku", "left_semi").select("sku")
    parts = attribute_columns(attributes).groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "value"))).alias("parts"))
    placed = rows.where("base IS NOT NULL").join(parts, "sku").select("sku", "base", F.explode(_subsets(F.col("parts"), False)).alias("parts"))
    placed = placed.withColumn("group", _name(F.col("base"), F.col("parts")))
    of_base = rows.where("base IS NOT NULL").select("sku", F.col("base").alias("group"))
    members = placed.select("sku", "group").unionByName(of_base).join(usable, "sku", "left_semi")
    raw, specific = cohesion(members, signatures), cohesion(members, distinctive(signatures)).select("group", F.col("cohesion").alias("specific"))
    scored = staged(raw.join(specific, "group"))  # a row to a group
    groups = placed.select("base", "group", "parts").dropDuplicates(["group"])
    whole = scored.select(F.col("group").alias("base"), F.col("cohesion").alias("family_cohesion"))
    above = groups.select("group", F.explode(_subsets(F.col("parts"), True)).alias("p"), "base").select("group", _name(F.col("base"), F.col("p")).alias("parent"))
    parents = above.join(scored.where(F.col("members") >= MEMBERS).select(F.col("group").alias("parent"), F.col("cohesion").alias("c")), "parent").groupBy("group").agg(F.max("c").alias("parent_cohesion"))
    rank = F.array_min(F.transform("parts", lambda p: p["rank"]))
    judged = groups.withColumn("rank", rank).join(scored, "group").join(whole, "base", "left").join(parents, "group", "left")
    gain = F.col("cohesion") - F.greatest(F.coalesce("family_cohesion", F.lit(0.0)), F.coalesce("parent_cohesion", F.lit(-1.0)))
    passing = judged.withColumn("gain", gain).where((F.col("members") >= MEMBERS) & (F.col("specific") >= COHESION) & (F.col("gain") >= F.when(F.col("rank") < 10, GAIN).otherwise(PLAIN_GAIN)))
    order = Window.partitionBy("sku").orderBy("rank", F.desc("members"), F.desc("cohesion"), F.desc("gain"), F.size("parts"), "group")
    best = placed.select("sku", "group").join(passing, "group").withColumn("place", F.row_number().over(order)).where("place = 1")
    chosen = rows.select("sku", "base").join(best.select("sku", "group", "members", "cohesion", "gain"), "sku", "left")
    broad = scored.select(F.col("group").alias("base"), F.col("members").alias("m"), F.col("cohesion").alias("c"))
    met = chosen.join(broad, "base", "left")
    level = F.when(F.col("base").isNull(), "none").when(F.col("group").isNotNull(), "subgroup").otherwise("base")
    sub = F.col("group").isNotNull()
    return met.select(
        "sku", "base", F.coalesce("group", "base").alias("group"), level.alias("level"), F.when(sub, F.col("members")).otherwise(F.coalesce("m", F.lit(0))).alias("members"),
        F.when(sub, F.col("cohesion")).otherwise(F.coalesce("c", F.lit(0.0))).alias("cohesion"), "gain",
    )


def _likeness(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Correlation of a signature with each of many over their joint slots, by the rules of cohesion()."""
    joint = np.isfinite(many) & np.isfinite(one)
    n = joint.sum(1)
    x, y = np.where(joint, one, 0.0), np.where(joint, many, 0.0)
    with np.errstate(all="ignore"):
        x, y = (np.where(joint, v - (v.sum(1) / n)[:, None], 0.0) for v in (x, y))
        sx, sy = (np.sqrt((v * v).sum(1) / n) for v in (x, y))
        r = (x * y).sum(1) / n / (sx * sy)
    flat_x, flat_y = sx < 1e-9, sy < 1e-9
    r = np.where(flat_x | flat_y, (flat_x & flat_y).astype(float), np.nan_to_num(r))
    return np.where((joint[:, 7:].sum(1) >= JOINT_MONTHS) & (n >= JOINT_SLOTS), r, 0.0)


def _degrees(signatures: np.ndarray) -> np.ndarray:
    """Sum of each one's likeness with all, itself 1, by sums over the patterns of slots."""
    present = np.isfinite(signatures)
    patterns, own = np.unique(present, axis=0, return_inverse=True)
    own = own.reshape(-1)
    out = np.zeros(len(signatures))
    for a in range(len(patterns)):
        rows = own == a
        for b in range(len(patterns)):
            joint = patterns[a] & patterns[b]
            if joint[7:].sum() < JOINT_MONTHS or joint.sum() < JOINT_SLOTS:
                continue
            sides = []
            for part in (rows, own == b):
                v = signatures[part][:, joint]
                v = v - v.mean(1, keepdims=True)
                sd = v.std(1)
                sides.append((np.where((sd < 1e-9)[:, None], 0.0, v / np.where(sd < 1e-9, 1.0, sd)[:, None]) / np.sqrt(joint.sum()), sd < 1e-9))
            (z, flat), (w, flat_w) = sides
            out[rows] += z @ w.sum(0) + flat * flat_w.sum()
        if patterns[a][7:].sum() < JOINT_MONTHS or patterns[a].sum() < JOINT_SLOTS:
            out[rows] += 1.0
    return out


def complete_linkage(signatures: np.ndarray, alike: float) -> np.ndarray:
    """Cluster numbers: seeds in the order of their summed likeness take all that are alike with every member so far, the likest to the seed first.

    A seed is compared with what is left, so the work is members times clusters, and no table of pairs is held.
    """
    out = np.full(len(signatures), -1)
    found = 0
    for seed in np.lexsort((np.arange(len(signatures)), -np.round(_degrees(signatures), 9))).tolist():
        if out[seed] >= 0:
            continue
        out[seed] = found
        left = np.flatnonzero(out < 0)
        near = np.round(_likeness(signatures[seed], signatures[left]), 12)
        left = left[np.lexsort((left, -near))]
        left = left[np.sort(near)[::-1] >= alike]
        while len(left):
            taken, left = left[0], left[1:]
            out[taken] = found
            left = left[np.round(_likeness(signatures[taken], signatures[left]), 12) >= alike]
        found += 1
    return out


def _cluster_group(alike: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sku", ignore_index=True)
        numbers = complete_linkage(np.array(rows["signature"].tolist(), float), alike)
        return pd.DataFrame({"group": rows["group"], "sku": rows["sku"], "cluster": numbers})

    return run


def clusters(members: DataFrame, signatures: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(group, sku, cluster): a group's members (group, sku) with a signature, parted so that all in a cluster are alike beyond the catalogue's rhythm.

    A group goes to one task as 19 numbers a member (160 MB for a million); its table of pairs never exists.
    """
    values = F.map_from_entries(F.collect_list(F.struct("slot", "value")))
    slots = F.transform(F.sequence(F.lit(1), F.lit(19)), lambda s: F.coalesce(F.try_element_at("by_slot", s), F.lit(float("nan"))))
    vectors = distinctive(signatures).withColumn("slot", F.col("slot").cast("int")).groupBy("sku").agg(values.alias("by_slot")).select("sku", slots.alias("signature"))
    rows = members.select("group", "sku").distinct().join(vectors, "sku")
    return rows.groupBy("group").applyInPandas(_cluster_group(alike), "group string, sku string, cluster int")


def cluster_report(clustered: DataFrame, signatures: DataFrame) -> DataFrame:
    """(group, cluster, members, cohesion, distinctive): how well each cluster hangs together, raw and beyond the catalogue's rhythm."""
    named = clustered.select(F.struct("group", "cluster").alias("group"), "sku")
    raw = cohesion(named, signatures)
    own = cohesion(named, distinctive(signatures)).select("group", F.col("cohesion").alias("distinctive"))
    return raw.join(own, "group").select("group.group", "group.cluster", "members", "cohesion", "distinctive")


#: Days of its own that let a product's sales choose its family.
OWN_DAYS = 60


def _vectors(signatures: DataFrame) -> DataFrame:
    """(sku, vector): signatures as 19 numbers, nan where a slot is missing."""
    by_slot = signatures.groupBy("sku").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), "value"))).alias("by_slot"))
    return by_slot.select("sku", F.transform(F.sequence(F.lit(1), F.lit(19)), lambda s: F.coalesce(F.try_element_at("by_slot", s), F.lit(float("nan")))).alias("vector"))


def _families(members: DataFrame) -> DataFrame:
    """(group, clusters): per group its clusters' sums by slot, how many members have it, and the members' volumes; rows of members (group, cluster, sku, mean, vector)."""
    slots = members.select("group", "cluster", F.posexplode("vector").alias("slot", "v"))
    sums = slots.groupBy("group", "cluster", "slot").agg(F.coalesce(F.sum(F.when(~F.isnan("v"), F.col("v"))), F.lit(0.0)).alias("s"), F.count(F.when(~F.isnan("v"), 1)).alias("n"))
    wide = sums.groupBy("group", "cluster").agg(F.array_sort(F.collect_list(F.struct("slot", "s", "n"))).alias("slots"))
    volumes = members.groupBy("group", "cluster").agg(F.collect_list("mean").alias("means"))
    one = wide.join(volumes, ["group", "cluster"]).select("group", F.struct("cluster", F.col("slots.s").alias("sums"), F.col("slots.n").alias("counts"), "means").alias("c"))
    return one.groupBy("group").agg(F.array_sort(F.collect_list("c")).alias("clusters"))


def choose_family(vector: np.ndarray | None, base: np.ndarray, days: int, mean: float | None, own: int | None, clusters: list[dict]) -> tuple[int | None, str, float | None]:
    """The cluster that a product borrows from, why, and how well it fits; its own part is taken out of its cluster."""
    found = []
    for c in clusters:
        sums, counts, means = np.array(c["sums"], float), np.array(c["counts"], float), list(c["means"])
        if c["cluster"] == own:
            seen = np.isfinite(vector)
            sums, counts = sums - np.where(seen, vector, 0.0), counts - seen
            means.remove(mean)
        if means:
            found.append((c["cluster"], np.where(counts > 0, sums / np.where(counts > 0, counts, 1), np.nan), means))
    if not found:
        return None, "no relatives", None
    several = [f for f in found if len(f[2]) >= MEMBERS] or found
    centroids = np.array([f[1] for f in several])
    if vector is not None and days >= OWN_DAYS and ((np.isfinite(vector) & np.isfinite(centroids))[:, 7:].sum(1) >= JOINT_MONTHS).any():
        fit = _likeness(vector - base, centroids - base)
        best = int(np.argmax(np.round(fit, 12)))
        return (several[best][0], "own shape", float(fit[best])) if fit[best] >= ALIKE else (None, "own shape matches none", float(fit[best]))
    if len(found) == 1:
        return found[0][0], "one family", None
    if mean and mean > 0:
        apart = [abs(np.log((np.median(f[2]) or 1.0) / mean)) for f in several]
        return several[int(np.argmin(np.round(apart, 12)))][0], "volume", None
    return max(several, key=lambda f: len(f[2]))[0], "largest family", None


def _choose(base: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                vector = None if r.vector is None else np.array(r.vector, float)
                own = None if pd.isna(r.own) else int(r.own)
                out.append((r.sku, r.group, *choose_family(vector, base, int(r.days), None if pd.isna(r.mean) else float(r.mean), own, list(r.clusters))))
            yield pd.DataFrame(out, columns=["sku", "group", "cluster", "basis", "fit"]).astype({"cluster": "Int64"})

    return run


def relatives(products: DataFrame, clustered: DataFrame, signatures: DataFrame, young: DataFrame | None = None) -> DataFrame:
    """(sku, group, cluster, basis, fit): the family of its group that each product borrows from, or none.

    products has (sku, group, days, mean), clustered is clusters(), young the signatures of products too short for `signatures`.  A product with OWN_DAYS of sales goes to the
    cluster whose mean shape is likest beyond the catalogue's rhythm, if any is alike enough; one without goes by volume, and clusters of MEMBERS others are preferred.  Products meet
    clusters, not each other: a group's clusters are one row.
    """
    base = np.full(SLOTS, np.nan)
    for r in baseline(signatures).collect():  # 19 rows
        base[r["slot"] - 1] = r["base"]
    vectors = _vectors(signatures)
    own = clustered.withColumnRenamed("cluster", "own")
    members = clustered.join(vectors, "sku").join(products.select("sku", "mean"), "sku")
    targets = products.join(_vectors(signatures if young is None else signatures.unionByName(young)), "sku", "left").join(own, ["sku", "group"], "left")
    met = targets.join(_families(members), "group").select("sku", "group", "days", "mean", "own", "vector", "clusters")
    return met.mapInPandas(_choose(base), "sku string, group string, cluster long, basis string, fit double")


def donors(chosen: DataFrame, clustered: DataFrame) -> DataFrame:
    """(sku, donor): the members of each product's family, itself left out."""
    return chosen.where("cluster IS NOT NULL").select("sku", "group", "cluster").join(clustered.select("group", "cluster", F.col("sku").alias("donor")), ["group", "cluster"]).where("donor != sku").select("sku", "donor")
