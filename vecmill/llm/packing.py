"""Packing: documents' tokens into sequences of a fixed length.

Method: first-fit decreasing with a tournament tree of bin capacities, run
independently in random groups of documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.common import cut, table

LENGTH = 4096
END_ID = 2
#: Pieces under a sequence's length in a group, on average.
GROUP_PIECES = 4096
TOKENIZER = "word_bpe_49k.json"
#: Stretches and words whose ids a worker keeps (some 250 bytes each; of words, up to twice as many), fewer where they have
#: over CHARS_EACH characters on average. An executor may hold several idle workers, so that these bound what it keeps
#: between tasks to some 30 MB for each.
MOST_WORDS = 60_000
MOST_PARTS = 120_000
CHARS_EACH = 30


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Parts(dict):
    """ids of words that the pre-tokenizer makes of plain texts; words that weren't asked for while so many others came are dropped."""

    def __init__(self, tokenizer, most: int):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self._tokenize, self._most, self._chars, self._older = tokenizer.model.tokenize, most, 0, {}
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self._spelled = {n: as_bytes.pre_tokenize_str(chr(n))[0][0] for n in [0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)]}
        self._raw = [n.to_bytes(4, "little") for n in range(max(tokenizer.get_vocab().values()) + 1)]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._most or self._chars >= CHARS_EACH * self._most:
            self._older, self._chars = self.copy(), 0
            self.clear()
        ids = self._older.get(word)
        if ids is None:
            raw = self._raw
            ids = b"".join([raw[t.id] for t in self._tokenize(word if word.isascii() else word.translate(self._spelled))])
        self._chars += len(word)
        self[word] = ids
        return ids

    def rest(self) -> None:
        self._older = {}


class Encoder:
    """ids of whole texts (little-endian, 32 bits), made of those of their words.

    A plain text has ASCII's characters and Latin letters that normalizing leaves
    single letters. Its words are found as the pre-tokenizer finds them in what the
    normalizer makes of it: runs of letters in lower case, digits, endings behind an
    apostrophe, runs of marks. Words not met lately go to the vocabulary's model.

    Stretches between white space with other characters (or with ``<|``, which begins
    the vocabulary's own words) take the whole way, and what is between them is plain:
    the pre-tokenizer drops white space and never joins characters over it, and the
    normalizer works within stretches, so their ids depend on nothing else. They go
    together, with a mark that none holds between them.
    """

    MARK = "|"
    PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
    ODD = re.compile(
        r"(?<![^\t\n\r ])([!-;=-~À-ÖØ-öø-ÿ]*+(?:<(?!\|)[!-;=-~À-ÖØ-öø-ÿ]*+)*+(?:<\||[^\t\n\r -~À-ÖØ-öø-ÿ])[^\t\n\r ]*+)"
    )
    WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[!-/:-@\[-`{-~]+")

    def __init__(self, path: str, most: int = MOST_WORDS, most_parts: int = MOST_PARTS):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode = tokenizer.encode_batch_fast
        (self._mark,) = self._together([self.MARK])
        self._most, self._known, self._chars = most, {}, 0
        self._parts = _Parts(tokenizer, most_parts)

    def _together(self, words: list[str], between: str = " ") -> np.ndarray:
        (found,) = self._encode([between.join(words)], add_special_tokens=False)
        return np.array(found.ids, dtype="<u4")

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._parts.__getitem__, self.WORD.findall(text.lower())))

    def _learn(self, stretches: set[str]) -> None:
        other = []
        for w in stretches:
            if self.MARK in w:
                self._known[w] = self._together([w]).tobytes()
            else:
                other.append(w)
        if other:
            ids = self._together(other, f" {self.MARK} ")
            marks = np.flatnonzero(ids == self._mark)
            if len(marks) != len(other) - 1:
                raise ValueError("the tokenizer doesn't keep stretches apart")
            raw = ids.tobytes()
            for w, start, end in zip(other, [0, *(4 * marks + 4).tolist()], [*(4 * marks).tolist(), len(raw)]):
                self._known[w] = raw[start:end]

    def raw(self, text: str) -> bytes:
        """A text's ids."""
        if "<|" not in text and self.PLAIN.fullmatch(text):
            return self._plain(text)
        if len(self._known) >= self._most or self._chars >= CHARS_EACH * self._most:
            self._known, self._chars = {}, 0
        pieces = self.ODD.split(text)
        if new := set(pieces[1::2]).difference(self._known):
            self._learn(new)
            self._chars += sum(map(len, new))
        pieces[::2] = map(self._plain, pieces[::2])
        pieces[1::2] = map(self._known.__getitem__, pieces[1::2])
        return b"".join(pieces)

    def rest(self) -> None:
        """What isn't needed between tasks goes; the words met lately stay."""
        self._known, self._chars = {}, 0
        self._parts.rest()

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.raw(text), dtype="<u4").tolist()


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of this worker: the tasks it runs one after the other share what it keeps."""
    return Encoder(path)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut_pieces(path: str, length: int, end_id: int, keep_ids: bool):
    fields = [("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")]]
    schema = pa.schema([*fields, ("ids", pa.binary())] if keep_ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = encoder.raw(text.as_py() or "") + end
                for at in range(0, len(raw), 4 * length):
                    part = raw[at : at + 4 * length]
                    row = (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4)
                    rows.append((*row, part) if keep_ids else row)
                if keep_ids and len(rows) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        encoder.rest()

    return run


class Tournament:
    """Bins of equal capacity in order; each inner node knows the largest capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """Takes ``need`` from the first bin with that much left; the bin's number."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        tree[at] -= need
        found = at - self.leaves
        at >>= 1
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at >>= 1
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length; the longest are placed first, ties in the order given."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    used: dict[int, int] = {}
    bins = Tournament(len(lengths), capacity)
    for n in sorted(range(len(lengths)), key=lambda n: (-lengths[n], n)):
        b = bins.first_fit(lengths[n])
        out[n] = (b, used.get(b, 0))
        used[b] = used.get(b, 0) + lengths[n]
    return out


def _pack(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = first_fit_decreasing(group["length"].tolist(), length)
        group["bin"] = [b for b, _ in placed]
        group["offset"] = [o for _, o in placed]
        return group

    return run


def pack_documents(
    docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = False,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """The pieces of each row of ``docs`` (doc_id, text), with their sequences and offsets.

    A row's ids (and ``end_id``) are cut at multiples of ``length``. Full pieces
    are sequences; shorter ones are packed first-fit decreasing within groups dealt
    by hash. With ``keep_ids``, ``ids`` has each piece's ids (little-endian, 32 bits).

    A null text is empty: a piece of just ``end_id``. Null and repeated ids are
    rows like any other, and repeated rows are dealt over all groups. Other columns are not read. No rows give no rows.
    """
    path = tokenizer or tokenizer_path()
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cut_pieces(path, length, end_id, keep_ids), _PIECES + (", ids binary" if keep_ids else "")
    )
    # with its place in the table, as repeated rows would all draw one group; the draws are fixed once they are written
    pieces = cut(made.withColumn("draw", F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", F.monotonically_increasing_id())))
    full, short = pieces.where(F.col("length") == length), pieces.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group_pieces))
    dealt = short.withColumn("group", F.pmod("draw", F.lit(groups))).drop("draw")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    packed = dealt.groupBy("group").applyInPandas(_pack(length), f"{schema}, bin long, offset long")
    keep = [c for c in made.columns]
    # sequences of short pieces are even numbers, those of full pieces odd
    packed = packed.select(*keep, ((F.col("group") * F.lit(1 << 24) + F.col("bin")) * 2).alias("sequence_id"), "offset")
    alone = full.select(*keep, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
