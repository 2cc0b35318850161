"""Phrase collocation mining by SON partitioning.

The corpus is dealt over a few shards, each of which Spark spreads over many tasks. A phrase that
the whole language holds ``support`` times is held by some shard in proportion to its words, so
every shard is mined completely at a support lowered to its share: words first, then pairs of
locally frequent words, then the phrases of three and four words made of locally frequent pairs.
What any shard found frequent is a candidate, unless its counts show that it cannot reach the support:
a shard that did not find it frequent holds it less often than its share. All candidates are counted
once more, by their words, over the whole corpus: those counts are exact.

Candidates reach the tasks as a bit map of their hashes, of a fixed size. A hash that two phrases
share can only make a further candidate, never lose one. Texts are cut into words once: tasks write
blocks of word numbers with the words themselves, and all counting reads blocks. Tasks pass counts
on in packed runs: sorted, cut by ranges of the hash and compressed, a few bytes an entry.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perkloom.llm.common import documents, stored, whole_text

SUPPORT = 30
LONGEST = 4
PER_LANG = 2000
COVERED = 80  # per cent of a candidate's places that a longer one must hold to drop it
SHARDS = 6
SCALE = 2_000_000
BITS = 27  # of the bit map's places: 16 MB
BLOCK_WORDS = 500_000
OPEN_BLOCKS, OPEN_LANGS = 4, 1024  # that a task holds at once
SLICE = 1 << 21  # bytes cut into words at once
TALLIED, TALLIED_TEXTS = 2_000_000, 300_000  # entries a task holds before it passes them on
HASH_BITS = 48
BUCKET_WORDS = 1_000_000  # words of the corpus for each range of hashes

LOWER = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9
)
EDGE = b"\xff"  # stands in no UTF-8 text: the border of a piece, word number 0
BLOCK = "lang string, shard int, head int, n bigint, words binary, ids binary"


class _Cutter:
    """Cuts the texts of one language into blocks."""

    def __init__(self, block_words: int):
        self.block_words = block_words
        self._fresh([], [EDGE])

    def _fresh(self, context: list[int], words: list[bytes]):
        self.numbers = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        for w in (EDGE, *words):
            self.numbers[w]
        self.parts, self.head = [np.array(context, np.int32)], len(context)
        self.held = 0

    def add(self, text: bytes):
        """Yields blocks that are full; the text may go on in the next one."""
        at = 0
        while at < len(text):
            end = min(len(text), at + SLICE)
            if end < len(text):  # never inside a word
                end = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1
                if end <= at:
                    ends = [e for e in (text.find(b" ", at), text.find(b"\n", at)) if e >= 0]
                    end = min(ends) + 1 if ends else len(text)
            tokens = text[at:end].translate(LOWER).replace(b"\n", b" \xff ").split()
            numbers = self.numbers.__getitem__
            self.parts.append(np.fromiter(map(numbers, tokens), np.int32, len(tokens)))
            self.held += len(tokens)
            at = end
            if self.held >= self.block_words:
                yield self.block()
        self.parts.append(np.zeros(1, np.int32))  # a text ends a piece

    def block(self) -> dict:
        ids, words = np.concatenate(self.parts), list(self.numbers)
        made = {
            "head": self.head, "n": int((ids[self.head :] > 0).sum()),
            "words": b"\n".join(words[1:]), "ids": ids.astype("<i4").tobytes(),
        }
        # Phrases may reach over into the next block, which starts with the words they need.
        tail = [words[i] for i in ids[-(LONGEST - 1) :]]
        order = {w: k for k, w in enumerate(dict.fromkeys([EDGE, *tail]))}
        self._fresh([order[w] for w in tail], list(order)[1:])
        return made


def blocks(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """BLOCK rows: word numbers of texts of one language and shard, and the words they stand for.

    Number 0 is the border of a piece; the first ``head`` numbers are context, counted in the block
    before. A shard is every ``shards``-th part of the scan."""

    def cut(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() % shards
        cutters, open_words = {}, 0

        def rows(lang, made):
            return pa.RecordBatch.from_pylist(
                [{"lang": lang, "shard": shard, **made}],
                pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("head", pa.int32()),
                           ("n", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())]),
            )

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if lang not in cutters:
                    cutters[lang] = _Cutter(block_words)
                cutter = cutters[lang]
                open_words -= cutter.held
                for made in cutter.add(text.as_py()):
                    yield rows(lang, made)
                open_words += cutter.held
                if open_words > OPEN_BLOCKS * block_words or len(cutters) > OPEN_LANGS:
                    full = max(cutters, key=lambda k: cutters[k].held)  # between texts: no context
                    open_words -= cutters[full].held
                    yield rows(full, cutters.pop(full).block())
        for lang, cutter in cutters.items():
            if cutter.held:
                yield rows(lang, cutter.block())

    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().alias("text"))
    return named.mapInArrow(cut, BLOCK)


class _Block:
    """A block read back: its words, numbers and which phrases start where."""

    def __init__(self, lang: str, head: int, words: bytes, ids: bytes):
        import xxhash

        self.lang, self.words = lang.encode(), [EDGE, *(words.split(b"\n") if words else [])]
        self.ids, self.head = np.frombuffer(ids, "<i4").astype(np.int64), head
        digest = xxhash.xxh64_intdigest
        self.word_hash = np.fromiter((digest(w) for w in self.words), np.uint64, len(self.words))
        self.seed = np.uint64(digest(self.lang))

    def hashes(self, longest: int) -> list[np.ndarray]:
        """Of the phrases of 1, 2, ... words that start at each place, whatever stands there."""
        each = self.word_hash[self.ids]
        found = [_mixed(each ^ self.seed)]
        for k in range(1, longest):
            found.append(_mixed(found[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + each[k:]))
        return found

    def counted(self, fits: np.ndarray, k: int) -> np.ndarray:
        """Places whose phrase of k words fits and does not end in the context."""
        places = np.flatnonzero(fits)
        return places[places + k > self.head]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _short(h: np.ndarray) -> np.ndarray:
    return h & np.uint64(2**HASH_BITS - 1)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then their next ones, ...: what is small packs well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _packed(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising numbers, as steps, and their counts."""
    steps = np.diff(numbers, prepend=numbers[:1])
    steps[:1] = numbers[:1]
    return _squeezed(_planes(steps) + _planes(counts))


def _squeezed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.compress(raw, 1)


def _loose(payload: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(payload)


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    halves = np.frombuffer(_loose(payload), np.uint8).reshape(2, 8, -1)
    steps, counts = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in halves)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of all parts, each number once, rising."""
    numbers, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(numbers)
    numbers, counts = numbers[order], counts[order]
    first = np.flatnonzero(np.diff(numbers, prepend=~numbers[:1]))
    return numbers[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class _Bits:
    """A bit map of hashes, a place for each value of their last bits."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.mask, self.packed = np.uint64(2**bits - 1), packed

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & self.mask
        return (self.packed[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bit_map(places: DataFrame, bits: int) -> np.ndarray:
    """The bits set at ``place``: at most 2^bits / 8 bytes reach the driver, whatever the input."""
    numbered = places.select(F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("at"))
    numbered = numbered.distinct().repartition("bucket")  # places travel, not maps that are mostly empty
    found = np.zeros((-(-(2**bits) // 32_768) + 1) * 4096, np.uint8)
    for r in numbered.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("map")).collect():
        first = (r["bucket"] - 1) * 4096
        found[first : first + 4096] = np.frombuffer(r["map"], np.uint8)
    return found


def _place(bits: int) -> Column:
    # The first bucket of a bit map starts at 1.
    return (F.col("h").bitwiseAND(F.lit(2**bits - 1).cast("bigint")) + 1).alias("place")


class _Tally:
    """Counts of hashes per language and shard, held up to a bound and passed on in packed runs."""

    def __init__(self, buckets: int, limit: int = TALLIED):
        self.limit, self.parts, self.held = limit, defaultdict(list), 0
        self.edges = np.array([(i << HASH_BITS) // buckets for i in range(1, buckets)], np.uint64)

    def add(self, key: tuple, hashes: np.ndarray, counts: np.ndarray | None = None):
        if counts is None:
            hashes, counts = np.unique(_short(hashes), return_counts=True)
        self.parts[key].append((_short(hashes), counts))
        self.held += len(hashes)
        if self.held >= self.limit:
            yield from self.batches()

    def batches(self):
        for (lang, shard), parts in self.parts.items():
            hashes, counts = _summed(parts)
            cuts = [0, *np.searchsorted(hashes, self.edges).tolist(), len(hashes)]
            full = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
            runs = [_packed(hashes[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]) for i in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(full), pa.string()), pa.array([shard] * len(full), pa.int32()),
                 pa.array(full, pa.int32()), pa.array(runs, pa.binary())],
                names=["lang", "shard", "bucket", "run"],
            )
        self.parts, self.held = defaultdict(list), 0


def _rows(batches):
    """(lang, shard, block) of batches of BLOCK rows, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i].as_py() for name in ("lang", "shard", "head", "words", "ids")}
            yield r["lang"], r["shard"], _Block(r["lang"], r["head"], r["words"], r["ids"])


def local_supports(cut: DataFrame, support: int) -> DataFrame:
    """(lang, shard, most, elsewhere): the most places a phrase has in a shard that does not find it
    frequent, and the sum of that over the language's shards. The local support of a shard is its
    share of the language's."""
    sizes = cut.groupBy("lang", "shard").agg(F.sum("n").alias("own"))
    totals = sizes.groupBy("lang").agg(F.sum("own").alias("all"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    shares = sizes.join(totals, "lang").withColumn("up", F.greatest(wide("own") * F.lit(support) - 1, F.lit(0))).select(
        "lang", "shard", F.expr("up div greatest(all, 1)").alias("most")
    )
    # Written, so that joins know how small it is.
    return stored(shares.join(shares.groupBy("lang").agg(F.sum("most").alias("elsewhere")), "lang"), "local-supports")


def _candidates(cut: DataFrame, count, supports: DataFrame, support: int, buckets: int) -> DataFrame:
    """(lang, h) of the hashes, out of those that ``count`` yields, that are locally frequent in some
    shard and may be frequent in all."""

    def run(batches):
        tally = _Tally(buckets)
        for lang, shard, block in _rows(batches):
            for found in count(block):
                yield from tally.add((lang, shard), *found)
        yield from tally.batches()

    def union(table: pa.Table) -> pa.Table:
        shards, local = defaultdict(list), []
        for shard, most, payload in zip(*(table.column(c).to_pylist() for c in ("shard", "most", "run")), strict=True):
            shards[shard, most].append(_unpacked(payload))
        while shards:
            (_, most), parts = shards.popitem()
            hashes, counts = _summed(parts)
            frequent = counts > most
            local.append((hashes[frequent], counts[frequent] - most))
        hashes, more = _summed(local)
        found = hashes[more + table.column("elsewhere")[0].as_py() >= support]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(found), pa.string()),
                         "h": pa.array(found.astype(np.int64))})

    runs = cut.select("lang", "shard", "head", "words", "ids").mapInArrow(
        run, "lang string, shard int, bucket int, run binary"
    )
    return runs.join(supports, ["lang", "shard"]).groupBy("lang", "bucket").applyInArrow(union, "lang string, h bigint")


def candidates(cut: DataFrame, support: int = SUPPORT, bits: int = BITS, buckets: int = 1) -> np.ndarray:
    """A bit map of the phrases, of one word to four, that are candidates."""
    sc = cut.sparkSession.sparkContext
    supports = local_supports(cut, support)
    found_by = lambda count: _candidates(cut, count, supports, support, buckets)

    def words(block):
        held = np.bincount(block.ids[block.head :], minlength=len(block.words))
        held[0] = 0
        there = np.flatnonzero(held)
        yield _mixed(block.word_hash[there] ^ block.seed), held[there]

    one = stored(found_by(words), "frequent-words")
    known_words = sc.broadcast(bit_map(one.select(_place(bits)), bits))

    def pairs(block):
        one, two = block.hashes(2)
        fits = (block.ids > 0) & _Bits(bits, known_words.value).has(one)
        yield (two[block.counted(fits[:-1] & fits[1:], 2)],)

    two = stored(found_by(pairs), "frequent-pairs")
    known_pairs = sc.broadcast(bit_map(two.select(_place(bits)), bits))

    def longer(block):
        hashes, word = block.hashes(LONGEST), block.ids > 0
        fits = word[:-1] & word[1:] & _Bits(bits, known_pairs.value).has(hashes[1])
        for k in range(3, LONGEST + 1):
            fits = fits[:-1] & fits[1:]  # all pairs inside are candidates
            yield (hashes[k - 1][block.counted(fits, k)],)

    more = stored(found_by(longer), "frequent-longer")
    known_words.unpersist()
    known_pairs.unpersist()
    return bit_map(one.unionByName(two).unionByName(more).select(_place(bits)), bits)


def counts(cut: DataFrame, found: np.ndarray, support: int = SUPPORT, bits: int = BITS, buckets: int = 1) -> DataFrame:
    """(lang, k, phrase, f): the candidates that have the support, counted by their words over the
    whole corpus."""
    shared = cut.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        import xxhash

        known, tally, held = _Bits(bits, shared.value), defaultdict(lambda: defaultdict(int)), 0

        def passed_on():
            for lang, by in tally.items():
                runs = defaultdict(list)
                for phrase, c in by.items():
                    runs[xxhash.xxh64_intdigest(phrase) % buckets].append((phrase, c))
                made = []
                for run in runs.values():
                    run.sort()
                    texts = b"\n".join([p for p, _ in run])
                    made.append(_squeezed(len(run).to_bytes(8, "little") + _planes(np.array([c for _, c in run])) + texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(made), pa.string()), pa.array(list(runs), pa.int32()), pa.array(made, pa.binary())],
                    names=["lang", "bucket", "run"],
                )
            tally.clear()

        for lang, _, block in _rows(batches):
            by = tally[lang]
            held -= len(by)
            for k, places, counted in _phrases(block, known):
                numbers = [block.ids[places + j].tolist() for j in range(k)]
                for c, *phrase in zip(counted.tolist(), *numbers, strict=True):
                    by[b" ".join([block.words[i] for i in phrase])] += c
            held += len(by)
            if held >= TALLIED_TEXTS:
                yield from passed_on()
                held = 0
        yield from passed_on()

    def merge(table: pa.Table) -> pa.Table:
        total = defaultdict(int)
        for payload in table.column("run"):
            raw = _loose(payload.as_py())
            n = int.from_bytes(raw[:8], "little")
            held = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, -1).T).view("<u8").ravel()
            for phrase, c in zip(raw[8 + 8 * n :].split(b"\n"), held.tolist(), strict=True):
                total[phrase] += c
        rows = [(p.count(b" ") + 1, p, f) for p, f in total.items() if f >= support]
        return pa.table({
            "lang": pa.array([table.column("lang")[0].as_py()] * len(rows), pa.string()),
            "k": pa.array([r[0] for r in rows], pa.int32()),
            "phrase": pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
            "f": pa.array([r[2] for r in rows], pa.int64()),
        })

    runs = cut.select("lang", "shard", "head", "words", "ids").mapInArrow(run, "lang string, bucket int, run binary")
    return runs.groupBy("lang", "bucket").applyInArrow(merge, "lang string, k int, phrase string, f bigint")


def _phrases(block: _Block, known: _Bits):
    """(k, places, held): a place of each candidate of k words, and how many the block holds. Phrases
    are told apart by the numbers of their words, never by hash."""
    fits, number = block.ids > 0, block.ids
    for k, hashes in enumerate(block.hashes(LONGEST), 1):
        if k > 1:
            # Both parts a word shorter are candidates as well.
            fits = fits[:-1] & fits[1:]
            number = number[:-1] * len(block.words) + block.ids[k - 1 :]
        fits = fits & known.has(hashes)
        at = np.flatnonzero(fits)
        _, first, inverse = np.unique(number[at], return_index=True, return_inverse=True)
        number = np.zeros(len(fits), np.int64)
        number[at] = inverse
        held = np.bincount(inverse[at + k > block.head], minlength=len(first))
        yield k, at[first[held > 0]], held[held > 0]


def collocations(
    docs: DataFrame, support: int = SUPPORT, per_lang: int = PER_LANG, shards: int = SHARDS,
    bits: int = BITS, block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """The ``per_lang`` best phrases of two to four words of each language.

    Returns ``lang`` (null: ``und``), ``rank``, ``phrase``, ``a`` (its places, overlapping ones
    included), ``l`` and ``r`` (places of the two parts at the cut with the lowest score), ``n`` (words of
    the language) and ``score``. Phrases need ``support`` places and are dropped where a longer one
    holds ``COVERED`` per cent of them. Ties are ranked by a, then by the phrase's bytes. Null and
    empty texts hold no words; a text of any length is read whole, in slices; repeated rows count
    each time; other columns are ignored; an empty table gives an empty result."""
    # Few blocks to a file, as a task holds all those of its files at once.
    cut = stored(blocks(docs, shards, block_words), "blocks", "zstd", maxRecordsPerFile=8)
    sizes = stored(cut.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    buckets = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // bucket_words))
    found = candidates(cut, support, bits, buckets)
    all_counts = stored(counts(cut, found, support, bits, buckets), "phrases")
    return ranked(all_counts, sizes, per_lang)


def ranked(counted: DataFrame, sizes: DataFrame, per_lang: int) -> DataFrame:
    """The list from exact counts (lang, k, phrase, f) of all phrases with the support."""
    words = F.split("phrase", " ", -1)
    phrases = counted.where("k > 1").withColumn("words", words)
    joined = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    # Parts of a longer candidate that it may drop.
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: joined(at, size)),
    ))
    covering = (
        phrases.where("k > 2").select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    )
    kept = phrases.join(covering, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.col("longest") * 100 < F.col("f") * COVERED)
    )
    cuts = kept.select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.col("k").alias("size"),
        F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"),
    ).select(
        "lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("first"),
        joined(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"),
    )
    part = counted.select("lang", "phrase", "f")
    both = cuts.join(part.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"]).join(
        part.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"]
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumn("up", wide("a") * F.lit(SCALE)).withColumn("down", wide("l") + wide("r"))
    scored = both.withColumn("score", F.expr("up div down").cast("bigint"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    top = (
        lowest.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        .withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= per_lang)
    )
    return top.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM w, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inner_parts AS (
  SELECT lang, f, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, f, ws, size, unnest(range(1, k - size + 2)) AS i
        FROM c, (VALUES (2), (3)) AS s(size) WHERE k > size)),
covering AS (SELECT lang, phrase, max(f) AS longest FROM inner_parts GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN covering USING (lang, phrase)
         WHERE longest IS NULL OR 100 * longest < 80 * f),
cuts AS (SELECT lang, phrase, f AS a, k, ws, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, p.f AS l, q.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * a) // (p.f + q.f) AS BIGINT) AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = array_to_string(cuts.ws[1:cut], ' ')
            JOIN f q ON q.lang = cuts.lang AND q.phrase = array_to_string(cuts.ws[cut + 1:cuts.k], ' ')),
best AS (SELECT * FROM scored
         QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM top JOIN sizes USING (lang) WHERE rank <= 2000
"""
