"""BPE encoding and decoding of whole texts by tree concatenation.

A long text is cut into leaves at arbitrary places; leaves are encoded in parallel, each by
the tokenizers library, and joined in pairs up a tree. At a join the tokens near the seam may
be wrong, as neither side saw the other. A window around the seam is encoded again and grows
until it agrees with both sides exactly:

* on the left it starts where a piece of the pre-tokenizer starts, far enough from the seam
  for that start to hold in the joined text (pieces are found from left to right, looking
  ahead a few characters), and on the right some piece of the window starts where a piece of
  the right side does, from where on both find the same pieces; or
* the window lies in one piece, a long run that the pre-tokenizer does not split, and its
  first and last tokens equal those of the two sides. Every two neighbours in the joined list
  are then neighbours in some encoding of a text, and a list of which that holds is the
  encoding of its text.

Most texts are one leaf, encoded whole. A one-leaf text of Latin-1 characters, whose classes no
edition of Unicode has changed since these pieces were defined, and without special tokens is
encoded from the same vocabulary's ranks, which is faster and gives the same ids.
"""

from __future__ import annotations

import hashlib
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.llm.common import documents, whole_text

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
LEAF = 32_768  # code points
MARGIN = 64  # bytes; longer than any special token and any look-ahead
WINDOW = 128  # bytes on either side of a seam, at first


class Encoded(NamedTuple):
    """A text and its tokens: ids, first byte of each, and whether a piece starts there."""

    data: bytes
    ids: np.ndarray
    at: np.ndarray
    starts: np.ndarray


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one visible character."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Codec:
    """A byte-level BPE tokenizer of the tokenizers library, without truncation and padding."""

    def __init__(self, path: str, ranks_path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        byte_of = _byte_of()
        self.special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.length = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            plain = i not in self.special and all(c in byte_of for c in token)
            self.length[i] = len(token) if plain else len(token.encode())
        self.names = np.array([f"{i},".encode() for i in range(size)])
        self.names = self.names.view(np.uint8).reshape(size, -1)
        self.special_texts = [self.tokenizer.id_to_token(i) for i in self.special]
        self.ranks = ranks(ranks_path) if ranks_path else None

    def ids(self, text: str) -> list[int]:
        if self.ranks and not any(s in text for s in self.special_texts):
            try:
                text.encode("latin-1")
                return self.ranks.encode_ordinary(text)
            except UnicodeEncodeError:
                pass
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def listed(self, ids: list[int]) -> bytes:
        """Decimal ids joined by commas."""
        digits = self.names[np.array(ids, np.int64)].ravel()
        return digits[digits != 0].tobytes()[:-1]

    def encode(self, text: str) -> Encoded:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int32)
        at = np.concatenate([[0], np.cumsum(self.length[ids])]).astype(np.int64)
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        starts = np.ones(len(ids), bool)
        starts[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        return Encoded(text.encode(), ids, at[:-1], starts)

    def joined(self, a: Encoded, b: Encoded, window: int = WINDOW) -> Encoded:
        if not len(a.ids) or not len(b.ids):
            return b if not len(a.ids) else a
        seam, reach = len(a.data), window
        while True:
            if (found := self._by_pieces(a, b, reach)) or (found := self._inside_a_piece(a, b, reach)):
                break
            if reach >= seam and reach >= len(b.data):
                return self.encode((a.data + b.data).decode())
            reach *= 2
        left, middle, right = found
        shift = seam + b.at[right:]
        return Encoded(
            a.data + b.data,
            np.concatenate([a.ids[:left], middle.ids, b.ids[right:]]),
            np.concatenate([a.at[:left], middle.at, shift]),
            np.concatenate([a.starts[:left], middle.starts, b.starts[right:]]),
        )

    def _by_pieces(self, a, b, reach):
        """Tokens kept of a, the window's tokens, first token kept of b."""
        seam = len(a.data)
        safe = np.nonzero(a.starts & (a.at <= seam - max(reach, MARGIN)))[0]
        left = int(safe[-1]) if len(safe) else 0
        far = np.nonzero(b.starts & (b.at >= reach + MARGIN))[0]
        end = int(b.at[far[0]]) if len(far) else len(b.data)
        start = int(a.at[left])
        if max(seam - start, end) > 4 * max(reach, MARGIN) and reach < max(seam, len(b.data)):
            return None  # pieces are long here; look again with a wider reach
        w = self.encode((a.data[start:] + b.data[:end]).decode())
        # Pieces that start at the same place on both sides, and are not near the window's end.
        limit = len(b.data) if end == len(b.data) else end - MARGIN
        ours = w.at[w.starts] + start - seam
        theirs = b.at[b.starts]
        common = np.intersect1d(ours, theirs)
        common = common[(common >= 0) & (common <= limit)]
        if left and w.ids[0] != a.ids[left]:
            return None
        if end == len(b.data):
            if not len(common):
                return left, self._placed(w, start, len(w.ids)), len(b.ids)
        elif not len(common):
            return None
        at = int(common[0])
        cut = int(np.searchsorted(w.at, at + seam - start))
        return left, self._placed(w, start, cut), int(np.searchsorted(b.at, at))

    def _inside_a_piece(self, a, b, reach):
        seam = len(a.data)
        left = int(np.searchsorted(a.at, seam - reach, "right")) - 1
        right = int(np.searchsorted(b.at, reach))
        # A token may start inside a character; a window may not.
        while left > 0 and a.data[a.at[left]] & 0xC0 == 0x80:
            left -= 1
        while right < len(b.ids) and b.data[b.at[right]] & 0xC0 == 0x80:
            right += 1
        if left < 0 or right >= len(b.ids) or reach < MARGIN:
            return None
        if a.starts[left + 1 :].any() or b.starts[1 : right + 1].any():
            return None  # pieces start near the seam: the other way will do
        start, end = int(a.at[left]), int(b.at[right])
        w = self.encode((a.data[start:] + b.data[:end]).decode())
        if w.starts[1:].any() or len(w.ids) < 2:
            return None
        if w.ids[0] != a.ids[left] or w.ids[-1] != b.ids[right - 1]:
            return None
        w = w._replace(starts=np.concatenate([a.starts[left : left + 1], w.starts[1:]]))
        return left, self._placed(w, start, len(w.ids)), right

    @staticmethod
    def _placed(w: Encoded, start: int, n: int) -> Encoded:
        return Encoded(w.data, w.ids[:n], w.at[:n] + start, w.starts[:n])

    def tree(self, leaves: list[Encoded]) -> Encoded:
        while len(leaves) > 1:
            pairs = [self.joined(a, b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
            leaves = pairs + leaves[len(pairs) * 2 :]
        return leaves[0]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@cache
def ranks(path: str):
    """The same vocabulary as byte sequences in order of merging; one per worker process."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
    )


@cache
def codec(path: str, ranks_path: str | None = None) -> Codec:
    """One per worker process."""
    return Codec(path, ranks_path)


def _digests(c: Codec, encoded: list[list[int]]) -> pd.DataFrame:
    return pd.DataFrame({
        "n_tokens": [len(i) for i in encoded],
        "ids_sha256": [hashlib.sha256(c.listed(i)).hexdigest() for i in encoded],
        "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in c.decode(encoded)],
    })


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
AT_ONCE = 256


def encoded(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, decoded by ``decoded``."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([
            c.tree([c.encode(t[i : i + leaf]) for i in range(0, max(1, len(t)), leaf)]).ids for t in texts
        ])

    return docs.select("doc_id", ids(whole_text()).alias("ids"))


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series(codec(path).decode([i.tolist() for i in ids]))

    return tokens.select("doc_id", text("ids").alias("text"))


def round_trip(
    docs: DataFrame, path: str | None = None, ranks_path: str | None = None, leaf: int = LEAF
) -> DataFrame:
    """Encode and decode every text: ``doc_id``, ``n_tokens``, ``ids_sha256`` (decimal ids joined
    by commas) and ``decoded_sha256``, one row per input row.

    Texts of more than ``leaf`` code points have their leaves encoded wherever Spark puts them
    and joined where the document is; the others are one leaf and are not moved. Null texts are
    empty and have no tokens. Rows with equal or null doc_id are kept apart. Extra columns are
    ignored and an empty table gives an empty result."""
    if path is None:
        path, ranks_path = vocabulary_path(), vocabulary_path(RANKS)

    @F.pandas_udf(DIGESTS)
    def whole(texts: pd.Series) -> pd.DataFrame:
        c = codec(path, ranks_path)
        parts = [_digests(c, [])]
        for at in range(0, len(texts), AT_ONCE):  # lists of ids are large
            parts.append(_digests(c, [c.ids(t) for t in texts.iloc[at : at + AT_ONCE]]))
        return pd.concat(parts, ignore_index=True)

    @F.pandas_udf("struct<ids:array<int>,starts:array<boolean>>")
    def leaf_tokens(texts: pd.Series) -> pd.DataFrame:
        c = codec(path)
        found = [c.encode(t) for t in texts]
        return pd.DataFrame({"ids": [e.ids for e in found], "starts": [e.starts for e in found]})

    @F.pandas_udf(DIGESTS)
    def tree(documents: pd.Series) -> pd.DataFrame:
        c, found = codec(path), [_digests(codec(path), [])]
        for leaves in documents:
            parts = []
            for p in leaves:
                ids = np.asarray(p["ids"], np.int32)
                at = np.concatenate([[0], np.cumsum(c.length[ids])])[:-1].astype(np.int64)
                parts.append(Encoded(p["text"].encode(), ids, at, np.asarray(p["starts"], bool)))
            found.append(_digests(c, [c.tree(parts).ids.tolist()]))
        return pd.concat(found, ignore_index=True)

    rows = docs.select("doc_id", whole_text().alias("text"))
    is_short = F.length("text") <= leaf
    single = rows.where(is_short).select("doc_id", whole("text").alias("d"))
    pieces = (
        rows.where(~is_short)
        .withColumn("_row", F.struct("doc_id", F.xxhash64("text"), F.monotonically_increasing_id()))
        .select("_row", F.posexplode(F.regexp_extract_all(
            "text", F.lit(f"(?s).{{1,{leaf}}}"), F.lit(0))).alias("pos", "text"))
        .repartition("_row", "pos")
        .withColumn("tokens", leaf_tokens("text"))
        .select("_row", F.struct("pos", "text", "tokens.ids", "tokens.starts").alias("leaf"))
    )
    trees = pieces.groupBy("_row").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    return single.unionByName(trees.select("_row.doc_id", tree("leaves").alias("d"))).select("doc_id", "d.*")


def op6_bpe(spark, sf_dir):
    return round_trip(documents(spark, sf_dir))
