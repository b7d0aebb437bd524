"""Near-duplicate documents by bottom-k sketches of one hash function.

1. A pass over the texts gives each document's shingle count, a 128-bit hash of its
   shingle set and the k least shingle hashes. Equal sets fold to one class, which has a
   number of its own, so ids may be of any type.
2. Retained values form inverted lists. Documents that share SHARE * k retained values
   at least, as pairs at the threshold do but for some 1e-6 of cases, share one of
   their rarest k - SHARE * k + 1, so only those rarest are listed.
3. A list's least class is its hub. Overlaps of retained values with the hub's rule
   members out by the union sketch; texts travel for the others only, and the exact
   Jaccard similarity of full sets decides.
4. Where members of a hub's lists lie in different components after that, their full
   sets are listed by their rarest shingles, with room for partners of a size that could
   still share enough after that shingle. A passage that many documents share, but that
   is too little for a link, leaves no such room and so no pairs, however many they are.
   What shares a list with room and lies in different components is compared exactly, in
   blocks of bounded size.
5. Components of all links, by distributed stars.

No list, bucket or group is capped; long lists only mean more parts and blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.components import components
from cadenza.llm.store import keep, shared_folder
from cadenza.llm.words import U64, Words, chunks, shingles

#: Values that a sketch retains.
K = 64
#: Share of retained values that two documents at the threshold have in common, less 5 standard deviations at K = 64.
SHARE = 0.46
#: Sets up to this size are whole in the sketches of all that they can link with.
WHOLE = 48
#: Members of a hub that one task compares with it at a time, and bounds of a block: its members, its shingles (one larger set is a block of its own).
PART, BLOCK, BLOCK_SHINGLES = 256, 256, 1 << 17
#: Places in which the rows of one large group meet what is known of the group.
SALTS = 32
#: Bits for each needed text, and most bits, of the filter that keeps other texts out of a join.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 29


def _sets(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 63-bit shingle hashes)."""
    for a, b, data, offs in chunks(batch.column(text)):
        words = Words(data, offs, lower=True)
        h, first = words.hashes(), words.first
        for i in range(b - a):
            yield a + i, shingles(h[first[i] : first[i + 1]]) >> U64(1)


def _identity(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set, which name it."""
    with np.errstate(over="ignore"):
        return int((s * s * U64(0x9E3779B97F4A7C15) + (s << U64(7))).sum().view(np.int64)), int((s ^ (s >> U64(29))).sum().view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, h1, h2, sketch = [], [], [], []
        for _, s in _sets(batch, "text"):
            n.append(len(s))
            x, y = _identity(s)
            h1.append(x)
            h2.append(y)
            sketch.append(s[:K].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(sketch)],
            names=["id", "key", "n", "h1", "h2", "sketch"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for _, s in _sets(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("comp"), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], names=["node", "comp", "n", "tokens"])


def _promising(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sketches' union allows for a link; sketches of fewer than K values are whole sets."""
    z = np.sort(np.concatenate((x, y)))
    at = np.flatnonzero(z[1:] == z[:-1])
    if len(x) < K and len(y) < K:
        return 100 * len(at) >= percent * (len(z) - len(at))
    # distinct values before each common one
    return np.count_nonzero(at - np.arange(len(at)) < K) >= int(SHARE * K)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    z = np.sort(np.concatenate((a, b)))
    both = np.count_nonzero(z[1:] == z[:-1])
    return 100 * both >= percent * (len(a) + len(b) - both)


def _overlapping(percent: int):
    """Rows (hub, part, node, key, sketch), sorted with the hub first, to those that may link, and their hubs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, told = None, None, False
        for batch in batches:
            hub, part, node = (batch.column(c).to_pylist() for c in ("hub", "part", "node"))
            key = batch.column("key")
            sketches = batch.column("sketch")
            offs, values = sketches.offsets.to_numpy(), sketches.values.to_numpy()
            out: dict[str, list] = {c: [] for c in ("hub", "part", "node", "key")}
            for i in range(len(hub)):
                s = values[offs[i] : offs[i + 1]]
                if node[i] == hub[i]:
                    now, own, told = (hub[i], part[i]), (key[i].as_py(), s), False
                    continue
                if (hub[i], part[i]) != now:
                    raise ValueError("a member came before its hub")
                if _promising(own[1], s, percent):
                    rows = [(node[i], key[i].as_py())] if told else [(hub[i], own[0]), (node[i], key[i].as_py())]
                    told = True
                    for n, k in rows:
                        for c, v in zip(out, (hub[i], part[i], n, k), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in ("hub", "part", "node")), pa.array(out["key"], pa.binary())], names=list(out))

    return run


def _stars(percent: int):
    """Rows (hub, part, node, text), sorted with the hub first, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            a, b = [], []
            hub, node = (batch.column(c).to_numpy() for c in ("hub", "node"))
            for i, s in _sets(batch, "text"):
                if node[i] == hub[i]:
                    own = s
                elif _similar(own, s, percent):
                    a.append(hub[i])
                    b.append(node[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    count = np.diff(np.r_[heads, len(values)])
    out = np.zeros((m, m), np.float32)
    few = heads[count == 2]
    np.add.at(out, (owner[few], owner[few + 1]), 1)
    np.add.at(out, (owner[few + 1], owner[few]), 1)
    many, size = heads[count > 2], count[count > 2]
    for at in range(0, len(many), 4096):
        part, of = many[at : at + 4096], size[at : at + 4096]
        grid = np.zeros((m, len(part)), np.float32)
        rows = np.repeat(part - np.r_[0, np.cumsum(of)[:-1]], of) + np.arange(of.sum())
        grid[owner[rows], np.repeat(np.arange(len(part)), of)] = 1
        out += grid @ grid.T
    return out


def _block_links(node: list[int], comp: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components, as few as join what hangs together."""
    if len(set(comp)) < 2:
        return []
    both = _overlaps(sets)
    size = np.array([len(s) for s in sets], np.float32)
    found = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    of = {c: c for c in comp}

    def root(c: int) -> int:
        while of[c] != c:
            of[c] = c = of[of[c]]
        return c

    links = []
    for i, j in zip(*np.nonzero(np.triu(found, 1)), strict=True):
        x, y = root(comp[i]), root(comp[j])
        if x != y:
            of[max(x, y)] = min(x, y)
            links.append((node[i], node[j]))
    return links


def _blocks(percent: int):
    """Rows (hub, part, node, comp, tokens), sorted, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node, comp, sets = None, [], [], []

        def out() -> pa.RecordBatch:
            links = _block_links(node, comp, sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            hub, part, nodes, comps = (batch.column(c).to_pylist() for c in ("hub", "part", "node", "comp"))
            tokens = batch.column("tokens")
            offs, values = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            for i in range(len(hub)):
                if (hub[i], part[i]) != now:
                    if node:
                        yield out()
                    now, node, comp, sets = (hub[i], part[i]), [], [], []
                node.append(nodes[i])
                comp.append(comps[i])
                sets.append(values[offs[i] : offs[i + 1]])
        if node:
            yield out()

    return run


def _key(doc_id: Column, text: Column) -> Column:
    """128 bits that rows of one id and text share; null counts as an empty text, but not as an id."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-")), F.lit("\n"), F.coalesce(text, F.lit("")))))


def _with_text(need: DataFrame, texts: DataFrame) -> DataFrame:
    """need's rows with the texts of their keys; a filter of FILTER_BITS for each key keeps most other texts out of the shuffle."""
    bits = FILTER_BITS * need.select("key").distinct().count()
    if bits <= MOST_FILTER_BITS:  # beyond that, all texts are shuffled
        slot = F.pmod(F.xxhash64("key"), F.lit(max(bits, 1))) + 1
        place = F.bitmap_bit_position(slot)
        maps = need.select(F.bitmap_bucket_number(slot).alias("bucket"), place.alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("map"))
        byte = F.conv(F.hex(F.substring("map", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        texts = (
            texts.withColumn("bucket", F.bitmap_bucket_number(slot)).withColumn("place", place).join(F.broadcast(maps), "bucket")
            .where(byte.bitwiseAND(F.pow(F.lit(2), F.col("place") % 8).cast("int")) > 0)
        )
    return _dealt(need).join(texts.groupBy("key").agg(F.first("text").alias("text")), "key")


def _dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled, never broadcast.

    Spark sizes a table by its compressed files and doesn't see an explode, so what it takes
    for small may be many times what a driver holds.
    """
    return df.hint("merge")


def _spread(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with groups on key; the rows of a group meet it in SALTS places."""
    salted = _dealt(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], how).drop("salt")


def _memberships(heads: DataFrame) -> DataFrame:
    """(hub, hub_n, node, n) of lists with two members at least, hubs themselves included."""
    entries = heads.select("node", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    least = F.when(F.col("n") <= WHOLE, F.ceil(0.75 * F.col("s"))).otherwise(F.floor(SHARE * F.col("s")))
    rarest = (
        entries.join(_dealt(shared), "value")
        .groupBy("node", "n", "s")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("all"))
        .select("node", "n", F.explode(F.slice("all", F.lit(1), F.greatest(F.lit(0), F.size("all") - least + 1).cast("int"))).alias("x"))
        .select("node", "n", F.col("x.value").alias("value"))
    )
    hubs = rarest.groupBy("value").agg(F.min(F.struct("node", "n")).alias("h"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return rarest.join(_dealt(hubs), "value").select(F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), "node", "n").distinct()


def _hub_links(members: DataFrame, heads: DataFrame, texts: DataFrame, percent: int, folder: str) -> DataFrame:
    """Links (a, b) of hubs with members of their lists."""
    near = members.where((F.col("node") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))).select("hub", "node")
    large = near.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).where("parts > 1")
    rays = _spread(near, large, "hub", "left").select("hub", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).alias("part"), "node")
    rays = keep(rays, folder)
    need = _dealt(rays.unionByName(rays.select("hub", "part", F.col("hub").alias("node")).distinct())).join(heads.select("node", "key", "sketch"), "node")
    hub_first = ["hub", "part", F.col("node") != F.col("hub")]
    alike = need.repartition("hub", "part").sortWithinPartitions(*hub_first).select("hub", "part", "node", "key", "sketch")
    alike = keep(alike.mapInArrow(_overlapping(percent), "hub long, part long, node long, key binary"), folder)
    compared = _with_text(alike, texts).repartition("hub", "part").sortWithinPartitions(*hub_first).select("hub", "node", "text")
    return keep(compared.mapInArrow(_stars(percent), "a long, b long").distinct(), folder)


def _open(groups: DataFrame, key: str) -> DataFrame:
    """(key) of the groups whose (key, comp) rows name two components at least."""
    return groups.groupBy(key, "comp").agg(F.lit(1)).groupBy(key).agg(F.count(F.lit(1)).alias("comps")).where("comps > 1").select(key)


def _with_room(entries: DataFrame) -> DataFrame:
    """The entries whose room takes the least set of their list."""
    return _spread(entries, entries.groupBy("token").agg(F.min("n").alias("least")), "token").where("room >= least").drop("least")


def _prefixes(sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """(token, node, comp, n, room): sets by their rarest shingles, for all that could link but lie in different components.

    Two sets that link share a shingle after which each has as many left as both must
    share; the rarest that they share is one. room is the largest partner that this allows.
    """
    entries = sets.select("node", "comp", "n", F.explode("tokens").alias("token"))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = entries.join(_dealt(shared), "token").groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all"))
    use = F.greatest(F.lit(0), F.size("all") - F.ceil(percent * F.col("n") / 100) + 1).cast("int")
    first = ranked.select("node", "comp", "n", F.size("all").alias("m"), F.posexplode(F.slice("all", F.lit(1), use)).alias("j", "x"))
    room = F.floor((F.col("m") - F.col("j")) * (100 + percent) / percent) - F.col("n")
    lists = keep(first.select(F.col("x.token").alias("token"), "node", "comp", "n", room.alias("room")).where(100 * F.col("room") >= percent * F.col("n")), folder)
    for _ in range(2):  # the least set may go itself
        lists = keep(_with_room(lists), folder)
    return keep(_spread(lists, _open(lists, "token"), "token"), folder)


def _block_pairs(lists: DataFrame, percent: int, folder: str) -> DataFrame:
    """(hub, part, node, comp): members of lists in bounded blocks, and each pair of blocks that could hold a link as a part."""
    hubs = lists.groupBy("token").agg(F.min(F.struct("node", "comp")).alias("h"))
    placed = _spread(lists, hubs, "token").select(F.col("h.node").alias("hub"), "node", "comp", "n", (F.col("comp") == F.col("h.comp")).alias("core")).distinct()
    step = F.floor(F.log(F.col("n")) / float(np.log(100 / percent))).cast("int")
    placed = placed.withColumn("step", step)
    sizes = placed.groupBy("hub", "core", "step").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    large = sizes.where("blocks > 1").withColumn("group", F.xxhash64("hub", "core", "step"))
    placed = _spread(placed.withColumn("group", F.xxhash64("hub", "core", "step")), large.select("group", "blocks").distinct(), "group", "left")
    block = F.struct("core", "step", F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")), F.lit(0)).alias("b"))
    placed = keep(placed.select("hub", "node", "comp", block.alias("block")), folder)
    blocks = placed.groupBy("hub", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x, y = blocks.alias("x"), blocks.alias("y")
    # pairs of blocks of one hub, not of rows: steps at most one apart, not both in the hub's own component
    pairs = x.join(_dealt(y), F.col("x.hub") == F.col("y.hub")).where(
        (F.col("x.block") <= F.col("y.block"))
        & (F.abs(F.col("x.block.step") - F.col("y.block.step")) <= 1)
        & ~(F.col("x.block.core") & F.col("y.block.core"))
        & ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))
    )
    pairs = pairs.select(F.col("x.hub").alias("hub"), F.col("x.block").alias("b1"), F.col("y.block").alias("b2"), F.xxhash64("x.block", "y.block").alias("part"))
    sides = pairs.select("hub", "part", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    return keep(_dealt(sides).join(placed, ["hub", "block"]).select("hub", "part", "node", "comp"), folder)


def links(documents: DataFrame, id_col: str, text_col: str, percent: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, heads, links): a row for each document, a class for each set that is not empty, and (a, b) links that join all that hang together."""
    folder = shared_folder(documents.sparkSession)
    texts = documents.select(F.col(id_col).alias("id"), _key(F.col(id_col), F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    signatures = keep(texts.mapInArrow(_signatures, f"id {kind}, key binary, n long, h1 long, h2 long, sketch array<long>"), folder)
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key", "n", "sketch"))
    heads = signatures.where("n > 0").groupBy("h1", "h2").agg(least.alias("x")).select("h1", "h2", "x.id", "x.key", "x.n", "x.sketch")
    heads = keep(heads.withColumn("node", F.monotonically_increasing_id()), folder)  # written, so that numbers stay
    members = keep(_memberships(heads), folder)
    found = _hub_links(members, heads, texts, percent, folder)

    comps = keep(components(found), folder)
    placed = members.select("hub", "node").join(_dealt(comps), "node", "left").select("hub", "node", F.coalesce("component", "node").alias("comp"))
    rest = _spread(placed, _open(placed, "hub"), "hub").select("node", "comp").distinct()
    rest = keep(_dealt(rest).join(heads.select("node", "key"), "node"), folder)
    sets = keep(_with_text(rest, texts).select("node", "comp", "text").mapInArrow(_full_sets, "node long, comp long, n long, tokens array<long>"), folder)
    need = _block_pairs(_prefixes(sets, percent, folder), percent, folder)
    need = _dealt(need).join(sets.select("node", "tokens"), "node")
    more = need.repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(_blocks(percent), "a long, b long").distinct()
    return signatures, heads, keep(found.unionByName(more), folder)


def _placed(documents: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, key, n, component_id, first) per row: first says whether the row has the key that stands for its component."""
    signatures, heads, found = links(documents, id_col, text_col, percent)
    of = heads.select("h1", "h2", "node", "id", "key").join(_dealt(components(found)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = of.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("x"), F.count(F.lit(1)).alias("m")).where("m > 1")
    of = _spread(of, groups.select("component", "x"), "component", "left")
    of = of.select("h1", "h2", F.when(F.col("x").isNull(), F.col("id")).otherwise(F.col("x.id")).alias("component_id"), F.coalesce("x.key", "key").alias("first"))
    rows = signatures.select("id", "key", "n", "h1", "h2").join(_dealt(of), ["h1", "h2"], "left")
    lone = F.col("n") == 0
    return rows.select("id", "key", "n", F.when(lone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (lone | (F.col("key") == F.col("first"))).alias("first"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id reachable), kept (whether that is the row's own).

    Ids may be of any type that has an order. Texts are lower-cased (A-Z) and cut to
    words; a set holds the distinct 5-word shingles, or the whole sequence of fewer words.
    Rows link from ``percent`` per cent Jaccard similarity on. A null, empty or wordless
    text has an empty set and links with nothing. Repeated rows share a component; rows
    of one id but different texts are placed each by its own text. A row without an id can
    link others but names no component: alone or among its like, component_id is null and
    kept is true. Whole texts count, however long; one text at a time must fit a task.
    Other columns are ignored, and an empty table gives no rows.
    """
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return _placed(documents, id_col, text_col, percent).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def distinct_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row, with all its columns, of each group of near-duplicates: one of the least id, rows without an id last.

    Of rows that repeat id and text one stays; rows of one id but unrelated texts all do.
    Null, empty and wordless texts form no groups. An empty table gives no rows.
    """
    kept = _placed(documents, id_col, text_col, percent).where("first").select("key").distinct()
    rows = documents.select(F.struct("*").alias("row")).withColumn("key", _key(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")))
    told = [f"row.`{f.name}`" for f in documents.schema if f.dataType.typeName() != "map"]
    order = Window.partitionBy("key").orderBy(F.xxhash64(*told))  # the join has brought a key's rows together
    return rows.join(_dealt(kept), "key").withColumn("i", F.row_number().over(order)).where("i = 1").select("row.*")
