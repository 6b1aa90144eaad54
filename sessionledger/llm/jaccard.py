"""Exact n-gram Jaccard join by a token-group matrix, and the classes that its links make.

Texts with one shingle set are one node. Two nodes link when ``100 * intersection >= percent * union``.

1. Order: shingles of very many documents go last, all others by hash. Any order gives the same links;
   this one keeps passages that half the corpus shares out of the search. A node's first
   ``n - ceil(t n) + 1`` shingles must hold one of any partner that is not larger, and the first
   ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller one suffice to be found by.
2. Groups: a node's group is the least node it meets at one of its shared first shingles, so near copies mostly
   meet in one group. A group over a bounded number of shingles is cut in blocks by hash.
3. Matrix: one row per shingle, group and class in it for the union of the members' found-by shingles, with the
   range of their sizes. Nodes are looked up in it: only groups that share such a shingle, have a fitting size
   and are not yet of the node's own class are candidates.
4. Bounds before sets move: parity bits, about one for every shingle of a set, never differ in more places
   than two sets do, so they rule pairs out safely. Then, at the group, a node must share enough with the union of its members.
5. Qualifying groups are opened: inside, nodes are compared by the rarest shingles of the group first.
   Pairs already in one class are not compared again, so a group of a thousand copies takes a few pivots
   and not half a million pairs. What is left unlinked was compared, or ruled out by a bound.

Nothing is capped: order, blocks and bounds change the work and not the links. Sets and shingles are told
apart by 64-bit hashes.

Null or wordless texts have an empty set, link with nothing, and are classes of their own. Rows with equal
sets are one class whatever their ids; a class whose ids are all null gets a null id. Repeated rows add
nothing. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionledger.llm.shingles import shingle_sets
from sessionledger.session import materialize

LOCAL_DOCS, LOCAL_REPEATS = 2_000, 2  # a shingle in so many of so many neighbouring documents may be a frequent one
FREQUENT = 4  # sightings that make it one
FREQUENT_SENT = 500_000  # most frequent shingles that the order knows; others count as rare
BLOCK_NODES, BLOCK_SHINGLES = 4_096, 2_000_000  # of a group that one task opens
SENT_ROWS = 300_000


def _ceil(n: int, a: int, b: int) -> int:
    return -(-n * a // b)


def _key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _parity(own: np.ndarray) -> bytes:
    """Parities of the set's counts by the last bits of the hash: a power of two from half the set's size on, 64 at least."""
    n = max(64, 1 << (len(own) // 2 - 1).bit_length())
    bits = np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _folded(parity: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width in words: the row of each set there (-1 if its own is narrower) and the rows; wider ones are folded."""
    width = np.array([len(x) // 8 for x in parity])
    out = {}
    for w in np.unique(width).tolist():
        row = np.full(len(parity), -1)
        has = np.flatnonzero(width >= w)
        row[has] = np.arange(len(has))
        rows = [np.bitwise_xor.reduce(np.frombuffer(parity[i], dtype=np.uint64).reshape(-1, w), axis=0) for i in has]
        out[w] = (row, np.array(rows))
    return out


def _measure(size: int):
    """Rows of both kinds: a document's set key and size, and shingles that many neighbouring documents share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[int, np.ndarray] = {}

        def frequent() -> pd.DataFrame:
            tokens, counts = np.unique(np.concatenate(list(near.values())), return_counts=True)
            near.clear()
            often = counts >= LOCAL_REPEATS
            return pd.DataFrame({"h": 0, "k": _signed(tokens[often]), "n": -counts[often]})

        for pdf in batches:
            keys, sizes = [], []
            for own in shingle_sets(pdf["t"].tolist(), size):
                k = _key(own)
                keys.append(k)
                sizes.append(len(own))
                near[k] = own
                if len(near) >= LOCAL_DOCS:
                    yield frequent()
            yield pd.DataFrame({"h": pdf["h"], "k": keys, "n": sizes})
        if near:
            yield frequent()

    return run


def _prefixes(size: int, percent: int, sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late, seen = sent.value, set()
        least = next(n for n in range(1, 101) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62
        for pdf in batches:
            rows = []
            for own in shingle_sets(pdf["t"].tolist(), size):
                n, k = len(own), _key(own)
                if n < least or k in seen:
                    continue
                seen.add(k)
                at = np.searchsorted(late, own)
                back = late[np.minimum(at, len(late) - 1)] == own if len(late) else np.zeros(n, dtype=bool)
                ordered = np.concatenate((own[~back], own[back]))
                p = n - _ceil(n, percent, 100) + 1
                rows.append((k, n, n - _ceil(n, 2 * percent, 100 + percent) + 1, _signed(ordered[:p]), _parity(own)))
            yield pd.DataFrame(rows, columns=["k", "n", "found_by", "tokens", "parity"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(_key(own), own.tobytes()) for own in shingle_sets(pdf["t"].tolist(), size)]
            yield pd.DataFrame(rows, columns=["k", "tokens"])

    return run


def _grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys in sorted batches; a run may go over several batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[by].to_numpy()
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            part = pdf.iloc[a:b]
            if held and (held[0].iloc[0][by].to_numpy() != part.iloc[0][by].to_numpy()).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _possible(percent: int):
    """Nodes of a group, own or visiting, that have a partner there which size and parity don't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, ["block"]):
            k, n, label, own = (pdf[c].to_numpy() for c in ("k", "n", "label", "own"))
            width = np.array([len(x) // 8 for x in pdf["parity"]])
            tables = _folded(pdf["parity"].tolist())
            keep = np.zeros(len(pdf), dtype=bool)
            for i in range(len(pdf)):
                other = np.flatnonzero((label != label[i]) & (own | own[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
                for w, (row, rows) in tables.items():
                    at = other[np.minimum(width[other], width[i]) == w]
                    if len(at):
                        differ = np.bitwise_count(rows[row[at]] ^ rows[row[i]]).sum(axis=1, dtype=np.int64)
                        if ((100 + percent) * differ <= (100 - percent) * (n[at] + n[i])).any():
                            keep[i] = True
                            break
            if keep.any():
                yield pd.DataFrame({"block": pdf["block"].to_numpy()[keep], "k": k[keep], "label": label[keep], "own": own[keep], "m": n[keep]})

    return run


def links(sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Verified links that join all linked sets which ``label`` holds apart; label is changed to the classes."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate(([0], sizes.cumsum()))
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(at)
    place = np.concatenate(([0], df.cumsum()))
    holders = np.repeat(np.arange(m), sizes)[np.argsort(at, kind="stable")]
    flag = np.zeros(len(tokens), dtype=np.int32)
    out: list[tuple[int, int]] = []

    def join(i: int, others: np.ndarray) -> None:
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            return
        own = at[ends[i]:ends[i + 1]]
        flag[own] = 1
        if 4 * len(others) > m:
            shared = np.add.reduceat(flag[at], ends[:-1])[others]
        else:
            shared = np.array([flag[at[ends[j]:ends[j + 1]]].sum() for j in others])
        flag[own] = 0
        for j in others[100 * shared >= percent * (sizes[others] + sizes[i] - shared)]:
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]

    tried: set[int] = set()
    for _ in range(8):  # pivots that gather the bulk of each class
        i = next((i for i in range(m) if int(label[i]) not in tried), None)
        if i is None:
            break
        join(i, np.flatnonzero(label != label[i]))
        tried.add(int(label[i]))
    names, counts = np.unique(label, return_counts=True)
    largest = names[counts.argmax()]
    for i in range(m):
        if label[i] == largest:
            continue  # its links are found from the other end
        own = at[ends[i]:ends[i + 1]]
        first = own[np.argsort(df[own], kind="stable")[:sizes[i] - _ceil(int(sizes[i]), percent, 100) + 1]]
        found = [holders[place[t]:place[t + 1]] for t in first if df[t] > 1]
        if found:
            others = np.unique(np.concatenate(found))
            join(i, others[label[others] != label[i]])
    return out


def _open(percent: int):
    """Links found in groups: rows of own members and of visitors, with their sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, ["block", "salt"]):
            pdf = pdf.drop_duplicates("k")
            sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["tokens"]]
            own = pdf["own"].to_numpy()
            if not own.all() and own.any():
                union = np.unique(np.concatenate([s for s, o in zip(sets, own) if o]))
                fits = np.array([o or 100 * np.isin(s, union, assume_unique=True).sum() >= percent * len(s) for s, o in zip(sets, own)])
                pdf, sets = pdf[fits], [s for s, f in zip(sets, fits) if f]
            if len(sets) > 1:
                k = pdf["k"].to_numpy()
                found = links(sets, pdf["label"].to_numpy().copy(), percent)
                if found:
                    yield pd.DataFrame([(k[i], k[j]) for i, j in found], columns=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``k, root``: the least node of each node's component, for all nodes that have an edge ``a, b``.

    Every round hooks each node to its least smaller neighbour, follows the hooks to the top and draws the
    edges between the tops anew. Only minima are taken per node, so a node with many edges is no heavy key.
    """
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    root = None
    while not left.isEmpty():
        hooks = materialize(left.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("p")))
        while True:
            up = hooks.select(F.col("k").alias("p"), F.col("p").alias("q"))
            hooked = materialize(hooks.join(up, "p", "left").select("k", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            hooks = hooked.select("k", "p")
            if hooked.filter("moved").isEmpty():
                break
        root = hooks if root is None else materialize(
            root.join(hooks.select(F.col("k").alias("p"), F.col("p").alias("q")), "p", "left").select("k", F.coalesce("q", "p").alias("p"))
            .unionByName(hooks.join(root.select("k"), "k", "left_anti")))
        ends = hooks.select(F.col("k").alias("b"), F.col("p").alias("bp"))
        starts = hooks.select(F.col("k").alias("a"), F.col("p").alias("ap"))
        left = materialize(left.join(ends, "b", "left").join(starts, "a", "left").select(F.coalesce("ap", "a").alias("x"), F.coalesce("bp", "b").alias("y"))
                           .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct())
    if root is None:
        return left.select(F.col("a").alias("k"), F.col("b").alias("root"))
    tops = root.select(F.col("p").alias("k"), F.col("p").alias("root")).distinct()
    return root.select("k", F.col("p").alias("root")).unionByName(tops)


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= SENT_ROWS else small


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: ``key, n_shingles, component`` (a number that linked and equal sets share, null for an empty set)."""
    spark = docs.sparkSession
    row = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(key).alias("id"), F.col(text).alias("t"))
    measured = materialize(row.select("h", F.coalesce("t", F.lit("")).alias("t")).mapInPandas(_measure(size), "h long, k long, n int"))
    nodes_of = measured.filter("n >= 0")
    often = (measured.filter("n < 0").groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") <= -FREQUENT).orderBy("n", "k").limit(FREQUENT_SENT).select("k").toPandas()["k"])
    late = np.sort(often.to_numpy(dtype=np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(late)

    firsts = materialize(row.select("t").filter("t is not null").mapInPandas(_prefixes(size, percent, sent), "k long, n int, found_by int, tokens array<long>, parity binary"))
    by_token = Window.partitionBy("token")
    rows = firsts.select("k", "n", "found_by", F.posexplode("tokens").alias("pos", "token"))
    # size and flag in one number: this is the widest shuffle
    rows = rows.select("token", "k", F.expr("2 * cast(n as long) + int(pos < found_by)").alias("place"))
    shared = materialize(
        rows.select("token", "k", "place", F.min("k").over(by_token).alias("least"), F.max("k").over(by_token).alias("most")).filter("least < most").distinct()
        .selectExpr("token", "k", "cast(place div 2 as int) as n", "place % 2 = 1 as finds", "least"))

    # groups by the least node met, in blocks of bounded size
    grouped = shared.groupBy("k").agg(F.first("n").alias("n"), F.min("least").alias("g"))
    sizes = grouped.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    nodes = materialize(grouped.join(sizes, "g").select("k", "n", "g", "blocks", F.xxhash64("g", F.pmod(F.xxhash64("k"), F.col("blocks"))).alias("block"), F.col("k").alias("label")))
    parity = firsts.select("k", "parity").dropDuplicates(["k"])

    def possible(visits: DataFrame) -> DataFrame:
        """Of (block, k, n, label, own) rows those with a partner in the block that the bounds leave."""
        return visits.join(parity, "k").repartition("block").sortWithinPartitions("block").mapInPandas(_possible(percent), "block long, k long, label long, own boolean, m int")

    def opened(visits: DataFrame) -> DataFrame:
        """Edges a, b of verified links."""
        left = materialize(possible(visits))
        wanted = left.select("k").distinct().join(nodes_of.groupBy("k").agg(F.min("h").alias("h")), "k").select("h").distinct()
        sets = row.filter("t is not null").join(_sent(materialize(wanted)), "h", "left_semi").select("t").mapInPandas(_sets(size), "k long, tokens binary")
        # visitors of a block beyond one task's memory are dealt to several, each with the block's own members
        guests = left.groupBy("block").agg((F.floor(F.sum(F.when(~F.col("own"), F.col("m")).otherwise(0)) / BLOCK_SHINGLES) + 1).alias("salts"))
        dealt = left.join(guests, "block").select(
            "block", "k", "label", "own", F.explode(F.when(F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("k"), F.col("salts"))))).alias("salt"))
        full = dealt.join(sets, "k").repartition("block", "salt").sortWithinPartitions("block", "salt", F.desc("own"))
        return materialize(full.mapInPandas(_open(percent), "a long, b long"))

    def relabelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        roots = components(edges)
        return materialize(nodes.join(roots.withColumnRenamed("root", "top"), "k", "left").withColumn("label", F.coalesce("top", "label")).drop("top"))

    visit = ["block", "k", "n", "label", "own"]
    edges = opened(nodes.withColumn("own", F.lit(True)).select(*visit))
    nodes = relabelled(nodes, edges)

    split = nodes.filter("blocks > 1")
    if not split.isEmpty():
        # one node of each class of a split group visits the group's first block
        first = F.xxhash64("g", F.lit(0).cast("long"))
        leaders = split.groupBy("g", "label").agg(F.min_by(F.struct("k", "n", "block"), "k").alias("l")).select(first.alias("block"), "l.k", "l.n", "label", F.lit(False).alias("own"), F.col("l.block").alias("home")).filter("home <> block").drop("home")
        hosts = split.filter(F.col("block") == first).select("block", "k", "n", "label", F.lit(True).alias("own"))
        edges = materialize(edges.unionByName(opened(leaders.unionByName(hosts))))
        nodes = relabelled(nodes, edges)

    placed = shared.select("token", "k", "n", "finds").join(nodes.select("k", "block", "label"), "k")
    matrix = placed.filter("finds").groupBy("token", F.col("block").alias("there"), F.col("label").alias("class")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    fits = (F.col("there") != F.col("block")) & (F.col("class") != F.col("label")) & (F.col("lo") <= F.col("n")) & (100 * F.col("hi") >= percent * F.col("n"))
    guests = materialize(placed.join(matrix, "token").filter(fits).select(F.col("there").alias("block"), "k", "n", "label").distinct())
    if not guests.isEmpty():
        hosts = nodes.join(guests.select("block").distinct(), "block", "left_semi").select("block", "k", "n", "label", F.lit(True).alias("own"))
        edges = materialize(edges.unionByName(opened(guests.withColumn("own", F.lit(False)).select(*visit).unionByName(hosts))))
        nodes = relabelled(nodes, edges)

    return _result(row, nodes_of, nodes)


def _result(row: DataFrame, measured: DataFrame, nodes: DataFrame) -> DataFrame:
    of = measured.groupBy("h").agg(F.first("k").alias("k"), F.first("n").alias("n"))
    keyed = row.select("h", "id").join(of, "h").join(nodes.select("k", "label"), "k", "left")
    return keyed.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "k")).alias("component"), "h")


def linked(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, percent: int = 85) -> DataFrame:
    """``key, n_shingles, component_id`` per row: the smallest id reachable by links, the row's own included."""
    rows = classes(docs, text, key, size, percent)
    least = rows.filter("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    return rows.join(least, "component", "left").select(F.col("id").alias(key), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of every class: the one of the smallest id. Rows with an empty set all stay."""
    rows = classes(docs, text, key, size, percent).filter("component is not null")
    rows = materialize(rows.groupBy("component", "h").agg(F.min("id").alias("id"), F.count("*").alias("m")))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("best"))
    chosen = materialize(rows.join(best, "component").select("h", "m", (F.col("best.h") == F.col("h")).alias("stays")).filter("m > 1 or not stays"))
    h = F.xxhash64(F.col(key), F.col(text))
    own = [F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    rest = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), h.alias("h"))
    single = rest.join(_sent(chosen.select("h")), "h", "left_anti")
    repeated = chosen.filter("stays").select("h")
    if repeated.isEmpty():
        return single.select(*own)
    # equal rows, of which one stays
    return single.unionByName(rest.join(_sent(repeated), "h").dropDuplicates(["h"]).select("d", "h")).select(*own)
