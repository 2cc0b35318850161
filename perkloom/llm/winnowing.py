"""Document fingerprints by winnowing.

A text is read as its code points without white space. Every k of them in a row have a
hash; from every w hashes in a row the smallest is kept, the rightmost on ties, with
its position. Two texts that share a passage of k + w - 1 code points, wherever it stands in
them, share a kept hash.

Code points are laid out four bytes each, so the k-gram at any place is a slice of bytes: all
hashes of a text take one pass, and all minima two. Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkloom.llm.common import documents, whole_text

SPACES = " \t\n\x0b\x0c\r"
K, W = 16, 16  # W is a power of four
PRIME = 2_147_483_647
POSITIONS = 4_294_967_296


def bare(text: Column) -> Column:
    """A text without its white space."""
    return F.translate(text, SPACES, "")


def kept_hashes(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds ``out``: the kept (hash, position) of ``text``, which has no white space, as
    hash * 2^32 + (2^32 - 1 - position), in the order of the windows. A text of fewer than k code
    points is one hash of all of them; an empty one keeps none."""
    # The bytes are a variable of the outer lambda: read from the row they would be copied each time.
    df = df.withColumn("_grams", F.expr(
        f"if({text} = '', cast(array() as array<bigint>), transform(array(encode({text}, 'UTF-32')), p -> "
        f"transform(sequence(0, greatest(cast(octet_length(p) div 4 as int) - {k}, 0)), i -> "
        f"pmod(xxhash64(substring(p, 4 * i + 1, {4 * k})), {PRIME}L) * {POSITIONS}L "
        f"+ ({POSITIONS - 1}L - i)))[0])"
    ))
    df = df.withColumn(out, F.expr(
        f"if(size(_grams) between 1 and {w - 1}, "
        f"concat(_grams, array_repeat(cast(null as bigint), {w} - size(_grams))), _grams)"
    )).drop("_grams")
    step = 1
    while step < w:  # minima of four neighbours that are minima of a quarter of the window
        df = df.withColumn(out, F.expr(
            f"transform(slice({out}, 1, greatest(size({out}) - {3 * step}, 0)), (x, i) -> "
            f"least(x, get({out}, i + {step}), get({out}, i + {2 * step}), get({out}, i + {3 * step})))"
        ))
        step *= 4
    return df.withColumn(out, F.array_distinct(out))


def hash_set(kept: str) -> Column:
    """Kept hashes without their positions."""
    return F.expr(f"array_distinct(transform({kept}, x -> cast(x div {POSITIONS} as int)))")


def positions(kept: str) -> Column:
    return F.expr(f"transform({kept}, x -> {POSITIONS - 1} - (x % {POSITIONS}))")


def fingerprint(kept: str) -> Column:
    """A digest of kept hashes and positions."""
    return F.sha2(F.array_join(F.col(kept), ",").cast("binary"), 256)


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of both; two texts without any are alike."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def with_fingerprints(texts: DataFrame) -> DataFrame:
    """Adds ``bare``, ``kept``, ``hashes`` and ``fingerprint`` of the whole ``text``."""
    return kept_hashes(texts.withColumn("bare", bare(F.col("text"))), "bare", "kept").withColumn(
        "hashes", hash_set("kept")
    ).withColumn("fingerprint", fingerprint("kept"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bare, kept, hashes, fingerprint) of every whole text; null is empty."""
    return with_fingerprints(docs.select("doc_id", whole_text().alias("text")))


def stitched(rows: DataFrame, whole: str, cut: str, kept: str, next_kept: str, out: str,
             k: int = K, w: int = W) -> DataFrame:
    """Adds ``out``: what ``kept_hashes`` keeps of ``whole``, whose first ``cut`` code points begin
    one text and whose rest begins another, given what is kept of those two.

    A hash is kept by a window that holds it. Where all windows that hold a hash lie in one of
    the two texts, the decision is taken over from there; only the windows across the seam and
    at the end are read again, some k + 2w code points each."""
    at = f"({POSITIONS - 1} - (x % {POSITIONS}))"
    # Hashes up to _before have all their windows in the first text; from _after to _upto, if
    # there are any, in the second.
    rows = rows.withColumn("_n", F.length(whole)).withColumns({
        "_before": F.col(cut) - (k + w - 1), "_after": F.col(cut) + (w - 1), "_upto": F.col("_n") - (k + w - 1),
    }).withColumns({
        "_second": F.col("_upto") >= F.col("_after"),
        "_from": F.greatest(F.lit(0), F.col("_before") - (w - 2)), "_end_from": F.col("_upto") - (w - 2),
    })
    rows = rows.withColumns({
        "_seam": F.expr(f"substring({whole}, _from + 1, if(_second, {cut} + {2 * w + k - 3}, _n) - _from)"),
        "_end": F.expr(f"if(_second, substring({whole}, _end_from + 1), '')"),
    })
    rows = kept_hashes(kept_hashes(rows, "_seam", "_seam_kept", k, w), "_end", "_end_kept", k, w)
    none = "cast(array() as array<bigint>)"
    return rows.withColumn(out, F.expr(
        f"concat(filter({kept}, x -> {at} <= _before), "
        f"filter(transform(_seam_kept, x -> x - _from), x -> {at} > _before and (not _second or {at} < _after)), "
        f"if(_second, filter(transform({next_kept}, x -> x - {cut}), x -> {at} between _after and _upto), {none}), "
        f"if(_second, filter(transform(_end_kept, x -> x - _end_from), x -> {at} > _upto), {none}))"
    )).drop("_n", "_before", "_after", "_upto", "_second", "_from", "_end_from",
            "_seam", "_end", "_seam_kept", "_end_kept")


class Ranges:
    """Ranges of descending doc_id of about ``rows_apart`` rows, at most ten thousand.

    Cut points are quantiles of ``ids``. The driver holds them and the first id of each
    range, nothing that grows beyond that number. Null ids are the last range."""

    def __init__(self, ids: DataFrame, rows_apart: int = 512):
        wanted = max(1, min(10_000, ids.count() // rows_apart))
        marks = [i / wanted for i in range(1, wanted)]
        found = ids.stat.approxQuantile("doc_id", marks, 0.2 / wanted) if marks else []
        cuts = sorted({int(c) for c in found or []})
        self.group = max(1, int(len(cuts) ** 0.5))
        self.groups = [cuts[i : i + self.group] for i in range(0, len(cuts), self.group)]
        self.cuts = len(cuts)
        firsts = dict(ids.groupBy(self.place().alias("r")).agg(F.max("doc_id")).collect())
        present = sorted(firsts)
        # The row that starts a range follows the last row of the range before it; the
        # first of all follows the last of all.
        self.first_id = [firsts.get(r) for r in range(self.cuts + 2)]
        before = {r: present[i - 1] for i, r in enumerate(present)}
        self.before = [before.get(r, r) for r in range(self.cuts + 2)]

    def place(self) -> Column:
        if not self.cuts:
            return F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.lit(0))
        groups = F.lit(self.groups)
        reached = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("doc_id")))
        coarse = reached(F.lit([g[0] for g in self.groups]))
        fine = F.when(coarse > 0, reached(F.element_at(groups, F.greatest(coarse, F.lit(1))))).otherwise(0)
        passed = F.greatest(coarse - 1, F.lit(0)) * self.group + fine
        return F.coalesce(F.lit(self.cuts) - passed, F.lit(self.cuts + 1))

    def start_here(self, place: str) -> Column:
        first = F.element_at(F.array(*[F.lit(i).cast("bigint") for i in self.first_id]), F.col(place) + 1)
        return F.col("doc_id").eqNullSafe(first)

    def range_before(self, place: str) -> Column:
        return F.element_at(F.lit(self.before), F.col(place) + 1)


def with_next(rows: DataFrame, ranges: Ranges, columns: list[str], add=lambda df: df) -> DataFrame:
    """Adds struct ``next`` with ``columns`` of the row after, by descending doc_id (null ids
    last), then text; the last row is followed by the first.

    One window per range; the row that starts a range is also laid at the end of the range
    before, so texts are shuffled once. ``add`` adds columns once rows are at their place, so
    that those are not shuffled."""
    ranged = rows.withColumn("_range", ranges.place())
    own = F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest"))
    ahead = F.struct(ranges.range_before("_range").alias("at"), F.lit(True).alias("guest"))
    laid = ranged.withColumn(
        "_seat", F.explode(F.when(ranges.start_here("_range"), F.array(own, ahead)).otherwise(F.array(own)))
    ).select(*rows.columns, F.col("_seat.at").alias("_at"), F.col("_seat.guest").alias("_guest"))
    inside = Window.partitionBy("_at").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "text")
    return (
        add(laid.repartition("_at")).withColumn("next", F.lead(F.struct(*columns)).over(inside))
        .where(~F.col("_guest")).drop("_at", "_guest")
    )


def edited(docs: DataFrame) -> DataFrame:
    """Every whole text with its edited text, what is kept of both and the next one's hashes.

    What is kept of the edited text is put together from its two texts (``stitched``)."""
    ranges = Ranges(docs.select("doc_id"))
    texts = docs.select("doc_id", whole_text().alias("text"))
    linked = with_next(texts, ranges, ["text", "kept", "hashes"], with_fingerprints)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    mine = F.substring("text", F.lit(1), n - third)
    both = linked.select(
        "doc_id", "kept", "hashes", "fingerprint", n.cast("bigint").alias("n_chars"),
        F.col("next.kept").alias("next_kept"), F.col("next.hashes").alias("next_hashes"),
        F.concat(mine, F.substring("next.text", F.lit(1), third)).alias("edited"),
        F.length(bare(mine)).alias("cut"),
    ).withColumn("edited_bare", bare(F.col("edited")))
    return stitched(both, "edited_bare", "cut", "kept", "next_kept", "edited_kept").withColumn(
        "edited_hashes", hash_set("edited_kept")
    )


def edited_likeness(docs: DataFrame) -> DataFrame:
    """How near each document's fingerprint is to that of an edited text and to the next one's.

    The edited text has the last third (rounded down, code points) replaced by as many first
    code points of the next document (all, if it has fewer). The next document is the one with
    the next smaller doc_id, and for the last the first. Returns one row per input row:
    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` and ``n_kept`` (hashes kept). Null
    texts are empty; texts without anything but white space have an empty fingerprint, and two of
    those are alike (1.0). Very long texts are read whole, as arrays of their code points. Rows
    with null or equal ids follow each other by text. An empty table gives
    an empty result; other columns, also of the same names, are not read."""
    return edited(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", fingerprint("edited_kept").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"),
        F.size("kept").alias("n_kept"),
    )


def op1_winnowing(spark, sf_dir):
    return edited_likeness(documents(spark, sf_dir))
