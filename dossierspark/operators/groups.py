"""Order-dependent deduplication, exact and bounded per task.

Rows influence each other only along similarity links, so each connected component is decided on its own, in slices that carry
only what they are linked to: no component lands whole in one task and none is cut.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierspark.operators.ranking import running, top_n
from dossierspark.session import durable

def components(edges: DataFrame, a: str = "id_a", b: str = "id_b", max_rounds: int = 100) -> DataFrame:
    """(id, component) of all linked ids; the component is its smallest id.

    Each round names every id by its smallest neighbour, follows these names to their ends on the ids alone, and puts the ends in the place
    of the links: those inside a component vanish, so only the first round reads them all.
    """
    left = durable(edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct())
    known, ends = None, lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("other"))
    for _ in range(max_rounds):
        both = left.select(F.explode(F.array(ends("src", "dst"), ends("dst", "src"))).alias("e")).select("e.*")
        labels = durable(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("label")))
        for _ in range(max_rounds):
            # A label is itself an id, so one lookup halves the remaining path.
            after = durable(labels.withColumnRenamed("label", "old").join(labels.select(F.col("id").alias("old"), "label"), "old").select("id", "old", "label"))
            labels = after.select("id", "label")
            if after.filter(F.col("old") != F.col("label")).isEmpty():
                break
        else:
            raise RuntimeError("components did not settle")
        step = labels.withColumnRenamed("id", "component")
        known = labels.withColumnRenamed("label", "component") if known is None else known.join(step, "component", "left").select(
            "id", F.coalesce("label", "component").alias("component"))
        of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"_{end}"))
        left = durable(left.join(of("src"), "src").join(of("dst"), "dst").filter("_src <> _dst").select(
            F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).distinct())
        if left.isEmpty():
            return durable(known)
    raise RuntimeError("components did not settle")


#: Rows and links of a component that one task takes at once.
LOAD = 2_000_000
#: Calls that a load of small components is dealt to.
BINS = 4


def copies_of(rows: DataFrame, id_: str, key) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of rows with an equal ``key`` (a list of columns without nulls): one hub per key, no links between hubs."""
    # Written once: hubs and members would each make the keys again.
    keyed = durable(rows.select(F.col(id_).alias("id"), *[k.alias(f"_k{i}") for i, k in enumerate(key)]))
    names = [f"_k{i}" for i in range(len(key))]
    hubs = keyed.groupBy(*names).agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    members = keyed.join(hubs, names).select("id", "hub")
    return members, members.limit(0).select("hub", F.col("hub").alias("other"))


def hubs_of(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of links that join copies to one row (similarity 1) and different texts by pairs.

    A hub is the row that stands for a set of copies: members are (id, hub), links are (hub, other hub), both ways. Copies
    of one hub are all linked with each other, so no clique of copies is ever written out. Where ``pairs`` has ``forward`` and ``backward``,
    a link depends on the order: ``forward`` means that a new row like a meets an earlier one like b.
    """
    if "forward" not in pairs.columns:
        pairs = pairs.withColumns({"forward": F.lit(True), "backward": F.lit(True)})
    # Written once: copies, stands and links would each find all pairs again.
    pairs = durable(pairs)
    copies = pairs.filter(F.col("similarity") == 1.0).select(F.col("id_b").alias("id"), F.col("id_a").alias("hub"))
    stands = pairs.select(F.explode(F.when(F.col("similarity") == 1.0, F.array("id_a")).otherwise(F.array("id_a", "id_b"))).alias("id")).distinct()
    near = pairs.filter(F.col("similarity") < 1.0)
    ends = lambda x, y, holds: F.struct(F.col(x).alias("hub"), F.col(y).alias("other"), F.col(holds).alias("holds"))
    links = near.select(F.explode(F.array(ends("id_a", "id_b", "forward"), ends("id_b", "id_a", "backward"))).alias("e")).filter("e.holds").select(
        "e.hub", "e.other")
    return copies.unionByName(stands.withColumn("hub", F.col("id"))), links


def text_hubs(copies: tuple[DataFrame, DataFrame], pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` where pairs link the first rows of ``copies_of``: a pair holds for all copies of both."""
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    both = pairs.select(F.col("id_a").alias("hub"), F.col("id_b").alias("other")).unionByName(pairs.select(F.col("id_b").alias("hub"), F.col("id_a").alias("other")))
    return copies[0].unionByName(ends.withColumn("hub", F.col("id"))), both


def _hub_names(rows: DataFrame, relations, id_: str):
    """Hubs of relation k by number, ``id * relations + k``, where the ids leave room for it; else by text, ``k|id``."""
    if dict(rows.dtypes)[id_] in ("tinyint", "smallint", "int", "bigint"):
        many = len(relations)
        if all(v is None or abs(v) < 2**62 // many for v in rows.agg(F.min(id_), F.max(id_)).first()):
            return lambda k, c: F.col(c).cast("long") * many + k
    return lambda k, c: F.concat(F.lit(f"{k}|"), F.col(c).cast("string"))


def _linked_rows(rows: DataFrame, relations, id_: str) -> DataFrame:
    """Rows that have links, with their component, own hubs and the hubs linked to them.

    Members of a hub are linked with each other and with those of linked hubs.
    """
    named = _hub_names(rows, relations, id_)
    parts = [(m.select(F.col("id").alias(id_), named(k, "hub").alias("hub")), l.select(named(k, "hub").alias("hub"), named(k, "other").alias("other")))
             for k, (m, l) in enumerate(relations)]
    members = durable(reduce(DataFrame.unionByName, [m for m, _ in parts]).distinct())
    links = durable(reduce(DataFrame.unionByName, [l for _, l in parts]))
    # Components of hubs; the hubs of a row belong together.
    joined = members.groupBy(id_).agg(F.min("hub").alias("hub")).join(members.withColumnRenamed("hub", "other"), id_).filter("hub <> other").select("hub", "other")
    comp = components(links.unionByName(joined), "hub", "other").withColumnRenamed("id", "hub")
    others = links.groupBy("hub").agg(F.collect_set("other").alias("others"))
    none = F.array().cast(members.select(F.array("hub")).dtypes[0][1])
    near = (members.join(others, "hub", "left").join(comp, "hub", "left")
            .groupBy(id_).agg(F.collect_set("hub").alias("hubs"), F.flatten(F.collect_list(F.coalesce("others", none))).alias("others"),
                              F.min(F.coalesce("component", "hub")).alias("component")))
    return rows.join(near.select(id_, "component", "hubs", F.array_union("hubs", "others").alias("near")), id_)


def fold_linked(rows: DataFrame, relations, id_: str, seq: Column, priority: Column, follow: bool, load: int = LOAD) -> DataFrame:
    """(id, leader_seq): the group of every row that has links, named by the ``seq`` of its first row.

    Rows are taken in ``seq`` order (unique). A row joins the earliest group that it is linked to, else it starts one. With ``follow`` a group
    is met only at its leader, the row with the highest priority so far (the earlier at a tie); otherwise at every member.

    A component goes past in slices of about ``load`` rows and links. What travels with a slice are its rows with the hubs they are linked to,
    and of the groups so far those that stand at one of these hubs. Texts and sets never travel, and no component lands whole in a task.
    """
    linked = _linked_rows(rows.select(id_, seq.alias("_seq"), priority.alias("_priority")), relations, id_)
    weighed = running(linked, ["component"], [F.col("_seq")], {"_load": F.size("near") + 1})
    placed = durable(weighed.withColumn("_slice_no", F.floor((F.col("_load") - 1) / load)).drop("_load"))
    weights = {r[0]: r[1] for r in placed.groupBy("_slice_no").agg(F.sum(F.size("near") + 1)).collect()}
    hub = dict(placed.dtypes)["component"]
    place = f"component {hub}, leader_seq long, priority array<double>, hub {hub}"
    held = rows.sparkSession.createDataFrame([], place)  # follow: hubs of every leader; else the earliest group of every hub
    by = ["component", "leader_seq"] if follow else ["component", "hub"]
    kind, done = dict(rows.dtypes)[id_], None
    # Components do not meet, so many small ones share a call: a call a component costs more than its rows.
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = lambda size: F.pmod(F.xxhash64("component"), F.lit(size)).cast("int")
    last = int(max(weights, default=0))
    for r in range(last + 1):
        part = placed.filter(F.col("_slice_no") == r)
        size = max(width, -(-weights.get(r, 0) * BINS // load))
        asked = part.select("component", F.explode("near").alias("hub")).distinct()
        state = held.join(asked, ["component", "hub"], "left_semi")
        if follow:
            state = held.join(state.select(*by).distinct(), by, "left_semi")
        # A number of partitions of its own: the rows are few bytes, and would be put together into few tasks.
        sides = [side.withColumn("_bin", bins(size)).repartition(width, "_bin").groupBy("_bin") for side in (state, part)]
        out = durable(sides[0].cogroup(sides[1]).applyInPandas(_fold_step(id_, follow), f"{place}, {id_} {kind}, decided boolean"))
        named = out.filter("decided").select(id_, "leader_seq")
        done = named if done is None else done.unionByName(named)
        if r < last:
            fresh = out.filter("not decided").select(*held.columns)
            held = durable(held.join(fresh.select(*by).distinct(), by, "left_anti").unionByName(fresh))
    return done


def _fold_step(id_: str, follow: bool):
    """One slice of some components: first the groups that it meets, a row for each of their hubs, then its own rows."""
    names = ["component", "leader_seq", "priority", "hub", id_, "decided"]

    def step(state: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame([], columns=names)
        out = []
        # A group is named by its leader_seq and a hub by its own name, both of one component only.
        leaders: dict[int, tuple[tuple, list]] = {}
        at_hub: dict[int | str, set[int]] = {}
        for g, p, h in zip(state["leader_seq"], state["priority"], state["hub"]):
            leaders.setdefault(int(g), (tuple(p), []))[1].append(h)
            at_hub.setdefault(h, set()).add(int(g))
        changed = {}
        part = part.sort_values("_seq")
        for component, seq, id_value, near, own, rank in zip(part["component"], part["_seq"], part[id_], part["near"], part["hubs"], part["_priority"]):
            group = min((g for groups in [at_hub[h] for h in near.tolist() if h in at_hub] for g in groups), default=None)
            mine, hubs, new = tuple(rank), own.tolist(), group is None
            if new:
                group = int(seq)
            out.append((component, group, None, None, id_value, True))
            if follow and (new or mine > leaders[group][0]):
                for h in () if new else leaders[group][1]:
                    at_hub[h].discard(group)
                leaders[group] = mine, hubs
                changed[group] = component
                for h in hubs:
                    at_hub.setdefault(h, set()).add(group)
            elif not follow:
                for h in hubs:
                    if group < min(at_hub.get(h, ()), default=group + 1):
                        at_hub[h] = {group}
                        changed[h] = component
        if follow:
            out += [(c, g, list(leaders[g][0]), h, None, False) for g, c in sorted(changed.items()) for h in leaders[g][1]]
        else:
            out += [(c, min(at_hub[h]), [], h, None, False) for h, c in sorted(changed.items())]
        # As objects: whole numbers beside nulls would become doubles.
        return pd.DataFrame(out, columns=names, dtype=object)

    return step


def _groups_of(rows: DataFrame, founders: DataFrame, id_: str, seq: Column, priority: Column, out: str) -> DataFrame:
    """(out, leader_seq, members) per group: its best row by priority, the earlier at a tie. Rows without links are groups of their own."""
    named = rows.select(id_, seq.alias("_seq"), priority.alias("_priority")).join(founders, id_, "left").withColumn("leader_seq", F.coalesce("leader_seq", "_seq"))
    best = F.max(F.struct("_priority", (-F.col("_seq")).alias("_minus"), F.col(id_).alias("_id")))
    return named.groupBy("leader_seq").agg(best.alias("_best"), F.count(F.lit(1)).alias("members")).select(
        F.col("_best._id").alias(out), "leader_seq", "members")


def _doubles(columns) -> Column:
    return F.array(*[c.cast("double") for c in columns])


def leader_dedupe(rows: DataFrame, relations, id_: str, priority, seq: Column, load: int = LOAD) -> DataFrame:
    """Greedy near-duplicate removal: (id of the leader, leader_seq, members) of each group.

    Each row, in ``seq`` order (unique longs), joins the earliest group whose current leader it is linked to, and replaces a leader of lower
    priority. ``priority`` is a list of numeric columns without nulls, compared in turn; an equal one keeps the earlier leader.
    """
    rank = _doubles(priority)
    return _groups_of(rows, fold_linked(rows, relations, id_, seq, rank, True, load), id_, seq, rank, id_)


def member_groups(rows: DataFrame, relations, id_: str, rank, seq: Column, load: int = LOAD) -> DataFrame:
    """(id of the best row, leader_seq, members): each row, in ``seq`` order, joins the earliest group with any member it is linked to.

    Groups never merge. The best row of a group has the highest rank, the earlier one at a tie.
    """
    best = _doubles(rank)
    return _groups_of(rows, fold_linked(rows, relations, id_, seq, best, False, load), id_, seq, best, id_)


def _similar(a: set, b: set, threshold: float) -> bool:
    return bool(a) and bool(b) and len(a & b) >= threshold * len(a | b) - 1e-12


def greedy_ranked(hits: DataFrame, query: str, order, keys, tokens: str, k: int, threshold: float = 0.96, slice_rows: int = 1000) -> DataFrame:
    """Walks each query's ranked hits and skips repeats of any key or near-equal texts, up to k.

    ``order`` are ascending columns that tell all hits of a query apart. A skipped row registers none of its keys. All hits take part: each
    round takes the next ``slice_rows`` hits of the queries that are not full yet, with what they kept so far.
    """
    names = [n for n, _ in keys]
    shaped = durable(hits.withColumns({f"_k_{n}": c for n, c in keys}).withColumn("_order", F.struct(*order)).withColumn("_pos", F.lit(0).cast("long")))

    def walk(before: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        kept = before.sort_values("_pos").to_dict("records")
        seen = {n: {r[f"_k_{n}"] for r in kept} for n in names}
        sets = [set(r[tokens]) for r in kept]
        for row in pdf.sort_values("_n").drop(columns="_n").to_dict("records"):
            if len(kept) >= k:
                break
            values = {n: row[f"_k_{n}"] for n in names}
            mine = set(row[tokens])
            if any(v is not None and v in seen[n] for n, v in values.items()) or any(_similar(mine, s, threshold) for s in sets):
                continue
            for n, v in values.items():
                seen[n].add(v)
            sets.append(mine)
            kept.append(row | {"_pos": len(kept) + 1})
        return pd.DataFrame(kept, columns=before.columns)

    kept, left = shaped.limit(0), shaped
    while True:
        part = durable(top_n(left, [query], [F.col("_order")], slice_rows, "_n"))
        taken = durable(kept.groupBy(query).cogroup(part.groupBy(query)).applyInPandas(walk, shaped.schema))
        full = taken.groupBy(query).agg(F.count(F.lit(1)).alias("_kept"))
        last = part.groupBy(query).agg(F.max("_order").alias("_last"), F.count(F.lit(1)).alias("_size")).filter(F.col("_size") == slice_rows)
        open_ = durable(last.join(full, query, "left").filter(F.coalesce("_kept", F.lit(0)) < k).select(query, "_last"))
        kept = taken
        if not open_.limit(1).count():
            return kept.withColumnRenamed("_pos", "rank").drop("_order", *[f"_k_{n}" for n in names])
        left = shaped.join(open_, query).filter(F.col("_order") > F.col("_last")).drop("_last")
