"""Byte-level BPE encoding and decoding by a given rank file.

Encoding splits a text by the tokenizer's pattern and folds ranked merges over the bytes of each distinct
piece: a Spark higher-order function keeps the parts of a piece and the ranks of its adjacent pairs, joins the
pair of least rank (leftmost first) and looks up the two ranks that have changed. Ranks come from one literal:
an array of small maps, addressed by a checksum, so that a lookup does not scan the vocabulary.

All pieces take that one path; only its place differs. Frequent pieces of the whole corpus are folded once and
their ids are broadcast (a bound on their number and length, both parameters); each text's other distinct pieces
are folded in the text's own row, so nothing but the counts is shuffled and no text is moved. A piece of more
than `fold_bytes` bytes, for which the fold's copying would grow with the square of its length, is merged by a heap.

Decoding looks each id's bytes up in a literal and concatenates them (as hexadecimal digits, in linear time).
digests() decodes runs of known ids by the same table in Arrow batches, and the ids of pieces folded in the row by the literal.

Defined results: null and empty text give no ids and decode to the empty string; special tokens are
ordinary text; repeated rows are encoded alike; an unknown or null id makes decoding raise, null ids decode to
null; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from canopyflow.llm import textnp as T
from canopyflow.session import materialise, shared_dir

RANK_BUCKETS = 1 << 15
#: Characters to which a session's plan descriptions are held: each would repeat the rank literal, and the driver keeps them.
PLAN_CHARS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file (base64 piece, space, rank on each line); its path is a parameter everywhere."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank, leftmost first, is joined until none has a rank.

    A heap of pairs and linked neighbours make it n log n for pieces of any length.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The vocabulary as one constant: an array of RANK_BUCKETS small maps from hexadecimal byte string to rank.

    The optimizer parses the string once for a query and keeps the result as a literal.
    """
    import xxhash

    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for p, r in ranks.items():
        key = p.hex().upper()
        buckets[xxhash.xxh64_intdigest(key, 42) % RANK_BUCKETS][key] = r
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Low bits of a pair's number that hold where the pair starts among its piece's hexadecimal digits.
PLACE_BITS = 24
_PLACES = (1 << PLACE_BITS) - 1
#: The number, less its place, of a pair that has no rank: above all others.
_NO_RANK = 1 << 56


def fold_merges(piece: Column, table: Column) -> Column:
    """array<int> of ids of a binary column, by higher-order functions. table: a column of rank_literal().

    The fold's state is one array: for each part a number made of the rank of the pair that it begins, then the part's
    place. The least number is the pair to join (leftmost first); its right part leaves the array, and the two
    pairs around it are looked up. Two question marks, which are no digits, stand before and after the piece, so that
    every pair has neighbours and those that reach over an end have no rank.
    """
    return _let(F.concat(F.lit("??"), F.hex(piece), F.lit("??")), lambda digits: _folded(digits, table))


def _folded(digits: Column, table: Column) -> Column:
    """fold_merges() of a piece's hexadecimal digits between question marks. Places count digits from 1."""
    size = F.shiftright(F.octet_length(digits), 1) - 2
    end = size * 2 + 3

    def rank(start: Column, stop: Column) -> Column:
        part = F.substring(digits, start, stop - start)
        return F.try_element_at(F.get(table, F.xxhash64(part).bitwiseAND(RANK_BUCKETS - 1).cast("int")), part)

    def number(start: Column, stop: Column) -> Column:
        return F.coalesce(F.shiftleft(rank(start, stop).cast("long"), PLACE_BITS), F.lit(_NO_RANK)) + start

    def place(x: Column) -> Column:
        return x.bitwiseAND(_PLACES).cast("int")

    def join(state: Column, own: Column, at: Column) -> Column:  # own: the pair's number; at: its place in the state, counted from 1
        left = number(place(F.get(state, at - 2)), place(F.get(state, at + 1)))
        return F.flatten(F.array(F.slice(state, 1, at - 2), F.array(left, number(place(own), place(F.get(state, at + 2)))), F.slice(state, at + 2, F.size(state))))

    def step(state: Column, _: Column) -> Column:
        found = lambda own: _let(F.array_position(state, own).cast("int"), lambda at: join(state, own, at))
        return _let(F.array_min(state), lambda own: F.when(own < _NO_RANK, found(own)).otherwise(state))

    def ids(state: Column) -> Column:
        return F.transform(F.slice(state, 2, F.size(state) - 3), lambda x, i: rank(place(x), place(F.get(state, i + 2))))

    no_rank = lambda at: F.lit(_NO_RANK) + at
    pairs = F.transform(F.sequence(F.lit(3), end - 4, F.lit(2)), lambda i: number(i, i + 4))
    begin = F.concat(F.array(no_rank(F.lit(1))), pairs, F.array(no_rank(end - 2), no_rank(end), no_rank(end + 2)))
    folded = F.aggregate(F.sequence(F.lit(1), size - 1), begin, step, ids)
    none = F.array().cast("array<int>")
    whole = lambda: rank(F.lit(3), end)
    return F.when(size == 0, none).when(size == 1, F.array(whole())).otherwise(_let(whole(), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(folded)))


#: A pattern by which a space before anything but white space begins a piece, whatever stands before it: none of its matches
#: holds a space after its first character, but for those of white space alone, which leave the last one to what follows.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Cutter:
    """Cuts texts into pieces. By SPACED, a text is cut at its spaces first, as its words are fewer than its pieces and recur:
    rest() gives the words after a text's head, each standing for the pieces of a space and the word."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.odd = regex.compile(r" (?=\s|\Z)").search if pattern == SPACED else lambda text: True

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """(pieces of the head, words of the rest): a text with a space before white space or its end is all head."""
        if self.odd(text):
            return self.find(text), []
        words = text.split(" ")
        head = words.pop(0)
        return self.find(head) if head else [], words

    def word(self, word: str) -> list[str]:
        """The pieces of a space and a word."""
        return [" " + word] if word.isascii() and word.isalpha() else self.find(" " + word)


def pieces(docs: DataFrame, pattern: str, text: str = "text", kept: int = 1 << 18) -> DataFrame:
    """(piece string, n long): every piece of all texts with its number of occurrences.

    Each task sums its own pieces up; it passes on what it holds when that exceeds `kept` pieces.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(pattern)
        seen: Counter = Counter()
        words: Counter = Counter()

        def gather() -> None:
            for w, n in words.items():
                for p in cutter.word(w):
                    seen[p] += n
            words.clear()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])
            seen.clear()
            return made

        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                if t:
                    head, rest = cutter.cut(t)
                    seen.update(head)
                    words.update(rest)
                    if len(words) > kept // 4:
                        gather()
                    if len(seen) > kept:
                        yield out()
        gather()
        yield out()

    return docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Pieces(dict):
    """piece -> its ids as little-endian 32-bit integers. A piece without ids gets a negative number, as a reference
    to its place in `words` (-1 is the first), until forget()."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int], fold_bytes: int):
        super().__init__(known)
        self.words: list[bytes] = []
        self.ranks, self.fold_bytes, self.new = ranks, fold_bytes, []

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        if len(raw) > self.fold_bytes:
            return np.array(merge(raw, self.ranks), dtype="<i4").tobytes()
        self.words.append(raw)
        self.new.append(piece)
        self[piece] = made = np.array([-len(self.words)], dtype="<i4").tobytes()
        return made

    def forget(self) -> list[bytes]:
        """The words that were missing since the last call."""
        words, self.words = self.words, []
        for p in self.new:
            del self[p]
        self.new.clear()
        return words


class Splitter(dict):
    """word -> the ids of a space and the word, as Pieces has them. Words of known pieces are kept, up to `most` of them."""

    def __init__(self, pieces: Pieces, cutter: Cutter, most: int = 1 << 16):
        super().__init__()
        self.pieces, self.cutter, self.most = pieces, cutter, most

    def __missing__(self, word: str) -> bytes:
        parts = list(map(self.pieces.__getitem__, self.cutter.word(word)))
        made = parts[0] if len(parts) == 1 else b"".join(parts)
        if not any(len(p) == 4 and p[3] > 127 for p in parts):
            if len(self) >= self.most:
                self.clear()
            self[word] = made
        return made

    def ids(self, text: str) -> tuple[bytes, list[bytes]]:
        """The ids of a text and its words without ids, to which negative numbers refer."""
        head, rest = self.cutter.cut(text)
        made = b"".join([*map(self.pieces.__getitem__, head), *map(self.__getitem__, rest)])
        return made, self.pieces.forget()


class Spelling:
    """The bytes of ids, by a table of all."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size, self.at = np.zeros(max(ranks.values(), default=0) + 1, np.int64), np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.raw = np.frombuffer(b"".join(ranks), np.uint8)
        sizes, ids = np.fromiter(map(len, ranks), np.int64, len(ranks)), np.fromiter(ranks.values(), np.int64, len(ranks))
        self.size[ids], self.at[ids] = sizes, np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray, block: int = 1 << 18) -> bytes:
        out = []
        for k in range(0, len(ids), block):
            part = ids[k : k + block]
            sizes = self.size[part]
            ends = np.cumsum(sizes)
            out.append(self.raw[np.repeat(self.at[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


#: The last codec's tools in this worker process, by the codec's name.
_splitters: dict[str, tuple] = {}


class Codec:
    """A vocabulary with the ids of frequent pieces, broadcast to the workers as one Arrow table."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str, known: pa.Table | None = None, fold_bytes: int = 512):
        self.spark, self.ranks, self.pattern, self.fold_bytes = spark, ranks, pattern, fold_bytes
        self.literal = rank_literal(ranks)
        self.hold(known if known is not None else pa.table({"piece": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))}))

    def hold(self, known: pa.Table) -> None:
        """Broadcast the ids of these pieces (piece, ids). The table is pickled as it is, so the driver holds it once."""
        self.name, self.held = uuid.uuid4().hex, self.spark.sparkContext.broadcast((known, self.ranks))

    def __getstate__(self) -> dict:  # what the workers need
        return {"name": self.name, "held": self.held, "pattern": self.pattern, "fold_bytes": self.fold_bytes}

    def _tools(self) -> tuple:
        """(Splitter, Spelling), made once in a worker process."""
        if self.name not in _splitters:
            table, ranks = self.held.value
            table = table.combine_chunks()
            words = table.column("piece").to_pylist()
            known: dict[str, bytes] = {}
            if words:
                lists = table.column("ids").chunk(0)
                flat, off = lists.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes(), lists.offsets.to_numpy() * 4
                known = {w: flat[a:b] for w, a, b in zip(words, off[:-1].tolist(), off[1:].tolist())}
            _splitters.clear()
            _splitters[self.name] = (Splitter(Pieces(known, ranks, self.fold_bytes), Cutter(self.pattern)), Spelling(ranks))
        return _splitters[self.name]

    def _split(self, docs: DataFrame, text: str, keep: tuple[str, ...], spelled: bool) -> DataFrame:
        """The keep columns, each text in runs of known ids or of one word without ids: __refs array<int> (0, or the number of the word),
        __words array<binary>, and the runs, which are empty for a word: as __ids array<array<int>>, or if spelled as
        __bytes array<binary> (ids as little-endian integers) and __spelled array<binary> (what those ids decode to)."""
        codec = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            splitter, spelling = codec._tools()
            lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), x)
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                _, offsets = T.buffers(texts)
                for i, j in T.slices(offsets):
                    found = [splitter.ids(t) if t else (b"", []) for t in texts.slice(i, j - i).to_pylist()]
                    codes = np.frombuffer(b"".join([f[0] for f in found]), dtype="<i4")
                    text_at = np.cumsum([0, *(len(f[0]) // 4 for f in found)])
                    word_at = np.cumsum([0, *(len(f[1]) for f in found)])
                    missing = codes < 0
                    begins = missing.copy()
                    begins[1:] |= missing[:-1]
                    begins[text_at[text_at < len(codes)]] = True
                    begins = np.flatnonzero(begins)
                    first = np.searchsorted(begins, text_at)
                    known = codes[~missing]
                    id_at = np.concatenate([[0], np.cumsum(~missing)])[np.append(begins, len(codes))]
                    refs = np.where(missing[begins], -codes[begins], 0)
                    if spelled:
                        raw_at = np.concatenate([[0], np.cumsum(spelling.size[known])])[id_at]
                        binary = lambda at, raw: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw)])
                        runs = [binary(4 * id_at, known.tobytes()), binary(raw_at, spelling.decode(known))]
                    else:
                        runs = [lists(id_at, pa.array(known, pa.int32()))]
                    made = [lists(first, pa.array(refs, pa.int32())), lists(word_at, pa.array([w for f in found for w in f[1]], pa.binary())), *(lists(first, r) for r in runs)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), *made], names=[*batch.schema.names[:-1], *names])

        kinds = [("__refs", S.IntegerType()), ("__words", S.BinaryType())]
        kinds += [("__bytes", S.BinaryType()), ("__spelled", S.BinaryType())] if spelled else [("__ids", S.ArrayType(S.IntegerType()))]
        names = [name for name, _ in kinds]
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__in"))
        made = [S.StructField(name, S.ArrayType(kind)) for name, kind in kinds]
        return rows.mapInArrow(run, S.StructType([*rows.schema.fields[:-1], *made]))

    def _folded(self, docs: DataFrame, text: str, keep: tuple[str, ...], spelled: bool) -> DataFrame:
        """_split() with __folded array<array<int>>: the ids of words."""
        words = _let(self.literal, lambda table: F.transform("__words", lambda w: fold_merges(w, table)))
        runs = ("__bytes", "__spelled") if spelled else ("__ids",)
        return self._split(docs, text, keep, spelled).select(*[F.col(f"`{c}`") for c in keep], "__refs", *runs, words.alias("__folded"))

    def encode(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The keep columns with ids array<int>."""
        # flatten stays outside of lambdas, where Spark compiles it
        ids = F.flatten(_let(F.col("__folded"), lambda folded: F.zip_with("__refs", "__ids", lambda r, own: F.when(r > 0, F.get(folded, r - 1)).otherwise(own))))
        return self._folded(docs, text, keep, False).select(*[F.col(f"`{c}`") for c in keep], ids.alias("ids"))

    def _spelled(self, ids: Column, digits: Column) -> Column:
        """string: the digits of each id, one after another; a question mark, which is no digit, for what is unknown."""
        return F.array_join(F.transform(ids, lambda i: F.get(digits, i)), "", "?")

    def _digits(self) -> Column:
        """array<string>: the hexadecimal digits of each id's bytes."""
        digits = ["?"] * (max(self.ranks.values(), default=0) + 1)
        for p, r in self.ranks.items():
            digits[r] = p.hex()
        return F.split(F.lit(" ".join(digits)), " ")

    def bytes_of(self, ids: Column) -> Column:
        """binary: the bytes that array<int> ids stand for."""
        made = F.unhex(_let(self._digits(), lambda digits: self._spelled(ids, digits)))
        return F.when(ids.isNotNull(), F.coalesce(made, _unknown()))

    def decode(self, encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The keep columns with bytes binary; null ids give null."""
        return encoded.select(*[F.col(f"`{c}`") for c in keep], self.bytes_of(F.col(f"`{ids}`").cast("array<int>")).alias("bytes"))

    def digests(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The keep columns with n_tokens, ids_sha256 and decoded_sha256: a round trip without moving the ids.

        Runs of known ids come with their bytes and what they decode to; the ids of words folded here are turned and decoded here.
        """
        own = [F.col(f"`{c}`") for c in keep]
        little = lambda i: _let(F.lpad(F.hex(i), 8, "0"), lambda h: F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))
        turned = F.transform("__folded", lambda ids: F.array_join(F.transform(ids, little), ""))
        spelled = _let(self._digits(), lambda digits: F.transform("__folded", lambda ids: self._spelled(ids, digits)))
        joined = lambda runs, words: F.unhex(F.array_join(_let(words, lambda w: F.zip_with(runs, "__refs", lambda raw, r: F.when(r > 0, F.get(w, r - 1)).otherwise(F.hex(raw)))), ""))
        whole = self._folded(docs, text, keep, True).select(*own, joined("__bytes", turned).alias("__raw"), joined("__spelled", spelled).alias("__decoded"))
        n_tokens = F.shiftright(F.octet_length("__raw"), 2).cast("long")
        return whole.select(*own, n_tokens.alias("n_tokens"), F.sha2("__raw", 256).alias("ids_sha256"), F.sha2(F.coalesce("__decoded", _unknown()), 256).alias("decoded_sha256"))


def _unknown() -> Column:
    """Raises where it is evaluated."""
    return F.raise_error(F.lit("an id is not in the vocabulary")).cast("binary")


def frequent(counted: DataFrame, most: int) -> DataFrame:
    """(piece): the pieces whose class of frequency (16 to a doubling) holds, with all higher ones, at most `most` pieces."""
    level = F.floor(F.log2("n") * 16).cast("int")
    classes = sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("pieces")).collect(), reverse=True)
    least, room = None, most
    for c in classes:
        room -= c["pieces"]
        if room < 0:
            break
        least = c["level"]
    return counted.where(level >= F.lit(least) if least is not None else F.lit(False)).select("piece")


def train_free_codec(docs: DataFrame, ranks_path: str, pattern: str, cached_pieces: int = 600_000, cached_bytes: int = 64, fold_bytes: int = 512, text: str = "text", path: str | None = None) -> Codec:
    """A codec whose broadcast holds the ids of up to cached_pieces frequent pieces of docs, each of up to cached_bytes bytes."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    codec = Codec(spark, load_ranks(ranks_path), pattern, fold_bytes=fold_bytes)
    counted = pieces(docs, pattern, text).where((F.col("n") > 1) & (F.octet_length("piece") <= cached_bytes))
    counted = materialise(counted, f"{path or shared_dir(spark)}/pieces")
    top = frequent(counted, cached_pieces).repartition(2 * spark.sparkContext.defaultParallelism)
    folded = top.select("piece", _let(codec.literal, lambda table: fold_merges(F.col("piece").cast("binary"), table)).alias("ids"))
    codec.hold(folded.toArrow())
    pa.default_memory_pool().release_unused()
    return codec
