"""SimHash near-dedup by tiled exact comparison.

Fingerprints are compared with exclusive-or and bit counts in numpy, tile against tile, so
no pair within the radius is missed. A tile holds fingerprints that agree in how many bits
are set in each of their four 16-bit lanes: two fingerprints differ in at least as many bits
as their lane counts do, so a pair of tiles whose counts differ beyond the radius is skipped
before anything is moved. Copies share a fingerprint and are compared once.

On request documents are also linked at a given likeness of their sets of five words in a row.
Two fingerprints of the set only make candidates; each candidate is settled by the sets themselves.
Likeness asks for sets of like size, so these tiles are by size, and only sizes within the likeness of
each other are compared. A pair of tiles reports which of its documents have candidates, never the
pairs; the sets of those are brought to it once, and it reports edges that span what holds. Tiles are
cut by the bytes of their sets, so a pair of tiles fits one task however long or alike the texts are.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.llm.common import documents, stored, whole_text
from perkloom.llm.components import components

RADIUS = 3
SHINGLE = 3
TILE = 4096
LANES = 4
LANE_BITS = 16
HASH_SEED = 42
COUNTED_AT_ONCE = 65_536
# For links by likeness: sets with four fifths in common differ in some 19 of the 128 bits, give or
# take 4; unrelated ones in 64, give or take 6.
LIKENESS = 0.8
LIKE_SHINGLE = 5
CANDIDATE_RADIUS = 36
SECOND_HASH = 0x9E3779B97F4A7C15
LIKE_TILE = 4096
LIKE_TILE_BYTES = 8_000_000


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Hashes of the shingles: lower-cased A-Z, words between ASCII white space, repeats included;
    all words if there are fewer; none without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(shingle, len(words))
    starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    found = (digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends, strict=True))
    return np.fromiter(found, np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is set if it is in over half of the hashes; of none, 0."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED_AT_ONCE):
        part = hashes[at : at + COUNTED_AT_ONCE].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(hashes)).astype(np.uint8)).view(">u8")[0])


def simhashes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        found = (simhash(shingle_hashes(t, shingle)) for t in texts)
        return pd.Series(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return docs.select("doc_id", fp(whole_text()).alias("fp"))


def _lane_count(lane: int):
    return F.bit_count(F.shiftrightunsigned("fp", lane * LANE_BITS).bitwiseAND(F.lit(2**LANE_BITS - 1)))


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Lane count differences within the radius, one of each opposite pair."""
    near = product(range(-radius, radius + 1), repeat=LANES)
    return [d for d in near if sum(map(abs, d)) <= radius and d >= (0,) * LANES]


def _stars(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs of a x b within the radius connect: each fingerprint
    of a group to the group's smallest, so that a group of n gives n edges, not n * n / 2."""
    both = np.concatenate([a, b])
    label = np.arange(len(both))
    rows = max(1, 1_000_000 // len(b))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius)
        if len(i):
            label = _joined(label, i + at, j + len(a))
    moved = both[label] != both
    return both[moved], both[label][moved]


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after tying rows i to rows j; a label is the first row of its group."""
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        while not np.array_equal(shorter := label[label], label):
            label = shorter
        if np.array_equal(label[i], label[j]):
            return label


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect the distinct ``fp`` within ``radius`` bits of each other."""
    kinds = (LANE_BITS + 1) ** LANES
    kind = sum(_lane_count(n) * F.lit((LANE_BITS + 1) ** n) for n in range(LANES)).cast("int")
    kinded = stored(distinct.select("fp", kind.alias("kind")), "fingerprints")
    # One short row per kind of lane counts, of which there are 17^4 at most: broadcast.
    tiles_of = F.broadcast(
        kinded.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    )
    tiles = stored(
        kinded.join(tiles_of, "kind")
        .groupBy("kind", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"))
        .agg(F.collect_list("fp").alias("fps")),  # about ``tile`` of them
        "tiles",
    )
    steps = F.array(*[
        F.struct(*[F.lit(x).alias(f"d{n}") for n, x in enumerate(d)]) for d in _steps(radius)
    ])
    lane = lambda n: F.expr(f"kind div {(LANE_BITS + 1) ** n} % {LANE_BITS + 1}")
    moved = [lane(n) + F.col(f"_step.d{n}") for n in range(LANES)]
    inside = F.lit(True)
    for m in moved:
        inside = inside & m.between(0, LANE_BITS)
    other = sum(m * F.lit((LANE_BITS + 1) ** n) for n, m in enumerate(moved)).cast("int")
    assert kinds < 2**31
    left = (
        tiles.withColumn("_step", F.explode(steps)).where(inside)
        .select(F.col("kind").alias("kind_a"), F.col("tile").alias("tile_a"),
                F.col("fps").alias("fps_a"), other.alias("kind"))
        .join(tiles_of.select("kind"), "kind", "left_semi")
    )
    pairs = left.join(tiles, "kind").where(
        (F.col("kind_a") != F.col("kind")) | (F.col("tile_a") <= F.col("tile"))
    )

    @F.pandas_udf("array<struct<u:bigint,v:bigint>>")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a, b, strict=True):
            u, v = _stars(x.astype(np.int64).view(np.uint64), y.astype(np.int64).view(np.uint64), radius)
            found.append([{"u": p, "v": q} for p, q in zip(u.view(np.int64).tolist(), v.view(np.int64).tolist(), strict=True)])
        return pd.Series(found)

    return pairs.select(F.explode(near("fps_a", "fps")).alias("e")).select("e.u", "e.v")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """Groups of documents whose fingerprints are linked, directly or through others.

    Returns one row per input row: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest doc_id reachable, itself included. Null texts are empty; texts
    without words have fingerprint zero and are linked like any other. Rows without doc_id link
    others too; a component of such rows alone has a null id. Extra columns are ignored and an
    empty table gives an empty result."""
    fps = stored(simhashes(docs, shingle), "simhash")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(links(distinct, radius, tile))
    return fps.join(_named(distinct, found, "fp"), "fp").select("doc_id", _hex("fp"), "component_id")


def _named(nodes: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """(node, component_id) of nodes with ``first_id``, from their roots."""
    rooted = nodes.join(found.withColumnRenamed("node", node), node, "left").select(
        node, "first_id", F.coalesce("root", node).alias("root")
    )
    # Written, so that the join deals both sides anew and can split the nodes of a large group.
    smallest = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    return rooted.join(smallest, "root").select(node, "component_id")


def _hex(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint")


def shingle_set(text: str) -> np.ndarray:
    """Different hashes of five words in a row, sorted."""
    return np.unique(shingle_hashes(text, LIKE_SHINGLE))


def set_fingerprints(found: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set of hashes, whose errors are apart."""
    mixed = (found ^ (found >> np.uint64(29))) * np.uint64(SECOND_HASH)
    return simhash(found), simhash(mixed ^ (mixed >> np.uint64(32)))


def all_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp, like_fp, other_fp, n, digest): the fingerprint, those of the set of
    five words in a row, the size of the set and a digest of it."""
    import xxhash

    @F.pandas_udf("struct<fp:bigint,like_fp:bigint,other_fp:bigint,n:bigint,digest:bigint>")
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            long = shingle_set(text)
            fps = np.array([
                simhash(shingle_hashes(text, shingle)), *set_fingerprints(long),
                len(long), xxhash.xxh64_intdigest(long.tobytes(), HASH_SEED),
            ], np.uint64)
            rows.append(fps.view(np.int64).tolist())
        return pd.DataFrame(rows, columns=["fp", "like_fp", "other_fp", "n", "digest"], dtype=np.int64)

    return docs.select("doc_id", text_key(), read(whole_text()).alias("s")).select("doc_id", "text_key", "s.*")


def text_key():
    return F.xxhash64(whole_text()).alias("text_key")


def _alike(like_a, other_a, n_a, like_b, other_b, n_b, similarity: float, radius: int) -> np.ndarray:
    """Which of the fingerprints b are candidates of each of a: sets of like size within the radius."""
    bits = np.bitwise_count(like_a[:, None] ^ like_b) + np.bitwise_count(other_a[:, None] ^ other_b)
    small, large = np.minimum(n_a[:, None], n_b), np.maximum(n_a[:, None], n_b)
    return (bits <= radius) & (small >= similarity * large) & (large > 0)


def like_tiles(nodes: DataFrame, similarity: float, tile: int, tile_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Tiles of nodes (``node``, ``like_fp``, ``other_fp``, ``n``), and how many each step of size has.
    Sizes fall into steps of the ratio ``similarity``: only tiles of the same or the next step can hold
    like sets."""
    step = F.floor(F.log(F.greatest("n", F.lit(1))) / float(-np.log(similarity))).cast("int")
    sized = nodes.select("node", "like_fp", "other_fp", "n", step.alias("step"))
    # A row per step of a size, of which a long has some two hundred: broadcast.
    tiles_of = F.broadcast(sized.groupBy("step").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("n") * 8 / tile_bytes)).cast("int").alias("tiles")
    ))
    columns = ["node", "like_fp", "other_fp", "n"]
    tiles = stored(
        sized.join(tiles_of, "step")
        .groupBy("step", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
        .agg(F.collect_list(F.struct(*columns)).alias("rows"))  # about ``tile`` of them
        .select("step", "tile", *[f"rows.{c}" for c in columns]),
        "like-tiles",
    )
    return tiles, tiles_of


PAIR = ["own", "own_tile", "step", "tile"]


def with_candidates(tiles: DataFrame, tiles_of: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(PAIR, second, node): the nodes of each pair of tiles that have a candidate in it, and whether
    they are of its second tile."""
    columns = ["node", "like_fp", "other_fp", "n"]
    left = tiles.select(
        F.col("step").alias("own"), F.col("tile").alias("own_tile"), *[F.col(c).alias(f"{c}_a") for c in columns],
        F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"),
    )
    left = left.join(tiles_of, "step").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = left.where("own != step or own_tile <= tile").join(tiles, ["step", "tile"])

    def near(batches):
        for pdf in batches:
            for *pair, na, la, oa, sa, nb, lb, ob, sb in pdf.itertuples(index=False, name=None):
                na, la, oa, sa, nb, lb, ob, sb = (np.ascontiguousarray(x, np.int64) for x in (na, la, oa, sa, nb, lb, ob, sb))
                la, oa, lb, ob = (x.view(np.uint64) for x in (la, oa, lb, ob))
                one, two = np.zeros(len(na), bool), np.zeros(len(nb), bool)
                rows, same = max(1, 1_000_000 // len(nb)), pair[:2] == pair[2:]
                for at in range(0, len(na), rows):
                    part = slice(at, at + rows)
                    fits = _alike(la[part], oa[part], sa[part], lb, ob, sb, similarity, radius)
                    if same:
                        fits[np.arange(len(fits)), np.arange(at, at + len(fits))] = False
                    one[part] |= fits.any(1)
                    two |= fits.any(0)
                for second, nodes in ((False, na[one]), (True, nb[two & (not same)])):
                    yield pd.DataFrame({**dict(zip(PAIR, pair, strict=True)), "second": second, "node": nodes})

    both = [f"{c}_a" for c in columns] + columns
    return pairs.select(*PAIR, *both).mapInPandas(
        near, "own int, own_tile int, step int, tile int, second boolean, node bigint"
    )


def spanning(
    second: np.ndarray, like: np.ndarray, other: np.ndarray, n: np.ndarray, group: np.ndarray, sets: list[np.ndarray],
    similarity: float, radius: int, same: bool,
) -> tuple[list[int], list[int]]:
    """Places (i, j) of edges that connect what the like pairs of a pair of tiles connect. ``group``: rows of
    equal number are linked already. Every candidate pair that is not of one group yet is settled by
    its sets; those of one row with all others at once."""
    ends = np.cumsum([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ids = np.split(ids, ends[:-1])
    known = np.zeros(1 + max((int(x.max(initial=0)) for x in ids), default=0), bool)
    label = np.unique(group, return_inverse=True)[1]
    found = [], []
    for i in np.flatnonzero(~second).tolist():
        fits = _alike(like[i : i + 1], other[i : i + 1], n[i : i + 1], like, other, n, similarity, radius)[0]
        fits &= label != label[i]
        fits[: i + 1] &= not same
        js = np.flatnonzero(fits & (second | same))
        if not len(js):
            continue
        known[ids[i]] = True
        starts = np.cumsum(n[js]) - n[js]
        shared = np.add.reduceat(known[np.concatenate([ids[j] for j in js.tolist()])].astype(np.int64), starts)
        known[ids[i]] = False
        js = js[shared >= similarity * (n[i] + n[js] - shared)]
        _, first = np.unique(label[js], return_index=True)  # one edge to each group
        found[0].extend([i] * len(first))
        found[1].extend(js[first].tolist())
        label[np.isin(label, label[js])] = label[i]
    return found


def like_links(
    nodes: DataFrame, docs: DataFrame, similarity: float = LIKENESS, radius: int = CANDIDATE_RADIUS,
    tile: int = LIKE_TILE, tile_bytes: int = LIKE_TILE_BYTES,
) -> DataFrame:
    """Edges (u, v) that connect the nodes whose sets of five words in a row are as alike as asked.

    ``nodes``: node, like_fp, other_fp, n, digest, group (linked already if equal), and the row whose
    text stands for the node: first_id, text_key."""
    import xxhash

    tiles, tiles_of = like_tiles(nodes, similarity, tile, tile_bytes)
    near = stored(with_candidates(tiles, tiles_of, similarity, radius), "with-candidates")
    needed = stored(
        nodes.join(near.select("node").distinct(), "node", "left_semi")
        .select("node", "like_fp", "other_fp", "n", "digest", "group", "first_id", "text_key"), "needed",
    )

    @F.pandas_udf("struct<hashes:array<bigint>,digest:bigint>")
    def read(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        digests = np.array([xxhash.xxh64_intdigest(x.tobytes(), HASH_SEED) for x in sets], np.uint64)
        return pd.DataFrame({"hashes": [x.view(np.int64) for x in sets], "digest": digests.view(np.int64)})

    texts = docs.select(F.col("doc_id").alias("first_id"), text_key(), whole_text().alias("text"))
    # One text for each node, by the row that stands for it; the digest tells texts of one key apart.
    keyed = texts.join(
        needed, (texts["text_key"] == needed["text_key"]) & texts["first_id"].eqNullSafe(needed["first_id"])
    ).select("node", "like_fp", "other_fp", "n", "digest", "group", read("text").alias("read"))
    sets = stored(
        keyed.where("read.digest = digest").dropDuplicates(["node"])
        .select("node", "like_fp", "other_fp", "n", "group", "read.hashes"), "sets",
    )

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        pdf = pdf.sort_values("node")
        columns = [pdf[c].to_numpy(np.int64) for c in ("node", "like_fp", "other_fp", "n", "group")]
        node, like, other, n, group = columns
        i, j = spanning(
            pdf["second"].to_numpy(bool), like.view(np.uint64), other.view(np.uint64), n, group,
            [np.asarray(x, np.int64) for x in pdf["hashes"]], similarity, radius,
            (pdf["own"].iloc[0], pdf["own_tile"].iloc[0]) == (pdf["step"].iloc[0], pdf["tile"].iloc[0]),
        )
        return pd.DataFrame({"u": np.maximum(node[i], node[j]), "v": np.minimum(node[i], node[j])})

    return near.join(sets, "node").groupBy(*PAIR).applyInPandas(settle, "u bigint, v bigint")


def near_or_like(docs: DataFrame, similarity: float = LIKENESS, **options) -> DataFrame:
    """``near_duplicates`` with links by likeness added: one row per input row with ``doc_id``, ``text_key``
    (hash of the text), ``fingerprint``, ``component_id``, and ``keep_id``, ``keep_key``: doc_id and
    text_key of the row that stands for its group, the smallest id, rows without one last.

    Null texts are empty. Rows without words are linked by their fingerprint alone. Extra columns are
    ignored and an empty table gives an empty result."""
    seen = stored(all_fingerprints(docs), "fingerprints")
    same = ["fp", "like_fp", "other_fp", "n", "digest"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    nodes = stored(
        seen.groupBy(*same).agg(first).withColumn("node", F.monotonically_increasing_id()), "nodes",
    )
    leads = stored(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    by_bits = (
        links(leads, RADIUS).join(leads.select(F.col("fp").alias("u"), F.col("lead").alias("lead_u")), "u")
        .join(leads.select(F.col("fp").alias("v"), F.col("lead").alias("lead_v")), "v")
        .select(F.col("lead_u").alias("u"), F.col("lead_v").alias("v"))
    )
    grouped = stored(nodes.join(leads, "fp").withColumnRenamed("lead", "group"), "grouped")
    by_fp = grouped.select(F.col("node").alias("u"), F.col("group").alias("v"))
    named = grouped.select("*", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("text_key"))
    by_likeness = like_links(named, docs, similarity, **options)
    found = components(by_bits.unionByName(by_fp).unionByName(by_likeness))
    rooted = stored(nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    heads = stored(rooted.groupBy("root").agg(F.min("first").alias("keep")), "heads")
    kept = rooted.join(heads, "root").select(*same, "keep")
    return seen.join(kept, same).select(
        "doc_id", "text_key", _hex("fp"), F.col("keep.doc_id").alias("component_id"),
        F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_key").alias("keep_key"),
    )


def op2_simhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
