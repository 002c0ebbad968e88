"""Operator 6: byte-pair encoding and decoding of whole texts.

Each pre-token is held as a contiguous array of part boundaries with the merge rank of every
adjacent pair; the smallest rank is found by scanning, its right boundary is deleted and the two
neighbouring ranks are refreshed, until no pair can merge. Pre-tokens repeat, so their ids are
kept in a bounded table per worker.

Defined results: a null text is encoded as the empty text (no tokens); a text of any length is
encoded whole; repeated rows give repeated results; an empty table gives an empty result. Only the
named id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed: the published pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered per worker, some 50 MB. When the table is full it is emptied; results do not depend on it.
MEMORY = 200_000
#: Longer pre-tokens merge by a heap over linked parts, as repeated scanning would take quadratic time.
SCAN_LIMIT = 256


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder of one byte-level vocabulary file in the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        letter = byte_letters()
        to_bytes = lambda s: bytes(letter[c] for c in s)
        vocab = {to_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.pieces = [b""] * size
        for k, v in vocab.items():
            self.pieces[v] = k
        for k, v in self.added.items():
            self.pieces[v] = k.encode()
        self.single = [vocab[bytes([b])] for b in range(256)]
        #: (left id, right id) -> (rank, merged id)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.find = regex.compile(PATTERN).findall
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.added else None
        self.memory: dict[str, tuple[int, str, bytes]] = {}
        self.ids: dict[str, tuple[int, ...]] = {}

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self._scan(word) if len(word) <= SCAN_LIMIT else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        far = (1 << 60, -1)
        get = self.merge.get
        ids = [self.single[b] for b in word]
        ranks = [get((ids[i], ids[i + 1]), far) for i in range(len(ids) - 1)]
        while ranks:
            best = min(ranks)
            if best is far or best[1] < 0:
                break
            i = ranks.index(best)
            ids[i] = best[1]
            del ids[i + 1]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), far)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), far)
        return ids

    def _heap(self, word: bytes) -> list[int]:
        """The same merges in the same order for long runs: (rank, position) heap with stale entries skipped."""
        import heapq

        n, get = len(word), self.merge.get
        ids = [self.single[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = to, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := get((to, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, to, ids[after[i]], m[1]))
            if (p := before[i]) >= 0 and (m := get((ids[p], to))):
                heapq.heappush(heap, (m[0], p, ids[p], to, m[1]))
        return [x for x in ids if x >= 0]

    def known(self, piece: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids as decimal text, and the bytes that they decode to."""
        ids = self.merge_word(piece.encode("utf-8"))
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        out = (len(ids), ",".join(map(str, ids)), b"".join([self.pieces[i] for i in ids]))
        if len(piece) <= SCAN_LIMIT:
            self.memory[piece] = out
        return out

    def ids_of(self, piece: str) -> tuple[int, ...]:
        out = tuple(self.merge_word(piece.encode("utf-8")))
        if len(self.ids) >= MEMORY:
            self.ids.clear()
        if len(piece) <= SCAN_LIMIT:
            self.ids[piece] = out
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                ids.append(self.added[part])
            else:
                for piece in self.find(part):
                    ids += self.ids.get(piece) or self.ids_of(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the comma-joined ids, SHA-256 of the decoded text."""
        count, ids, out = 0, [], []
        memory, known = self.memory, self.known
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                got = [(1, str(self.added[part]), part.encode())]
            else:
                got = [memory.get(p) or known(p) for p in self.find(part)]
            for n, s, b in got:
                count += n
                ids.append(s)
                out.append(b)
        decoded = b"".join(out).decode("utf-8", "replace")
        return count, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _vocabulary(name_or_path: str) -> str:
    """A path as it stands, or the place of a named public vocabulary on the machine that asks."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def encode_texts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""
    key = df.schema[id_col].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(_vocabulary(vocabulary))
        for b in it:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids = [c.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    schema = T.StructType([T.StructField("id", key), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema).toDF(id_col, "ids")


def decode_ids(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every id sequence; a null sequence gives the empty text."""
    key = df.schema[id_col].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(_vocabulary(vocabulary))
        for b in it:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.decode(x.as_py() or []) for x in part.column(1)], pa.string())], names=["id", "text"])

    schema = T.StructType([T.StructField("id", key), T.StructField("text", T.StringType())])
    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, schema).toDF(id_col, "text")


def token_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded in one pass."""
    key = df.schema[id_col].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(_vocabulary(vocabulary))
        for b in it:
            got = [c.digest(t.as_py() or "") for t in b.column(1)]
            n, ids, out = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("id", key), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
