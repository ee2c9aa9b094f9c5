"""Byte-level BPE encoding and decoding with a public vocabulary of ranks.

Everything happens where the texts are, in one stage without an exchange, a file or a broadcast that grows:

1. Texts are cut into pieces by the vocabulary's pattern (a regular expression in the JVM).
2. Each task keeps a dictionary of the distinct pieces it has met and passes on each new one once, then the texts as numbers
   of pieces. A dictionary that has grown to its limit is given up for a new one.
3. The new pieces are encoded by Spark's higher-order functions: aggregate() folds over a piece's bytes, each step merging
   the adjacent pair of least rank, leftmost first, by a literal map from pairs to ranks (a perfect hash, as Spark looks a
   key of a map literal up by going through all of them).
4. The ids of its pieces are put in the place of each text's numbers.

Decoding concatenates the binary pieces that ids stand for. A task needs memory for its dictionary, which is limited, and for
some megabytes of texts, or the longest one. A lost task is simply run again.
"""

from __future__ import annotations

import base64
import gc
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import cut, lean, parts, read, trim_driver

NONE = 1 << 16  # ranks from here on mean: no token
LONG = 256  # pieces of more bytes are merged by a heap
_HIGH = 1 << 50
_SEP = "\x1f"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, read on the driver; its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One piece's ids, plainly: the definition."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
        if r == NONE:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in time n log n, for pieces of any length: a heap of pairs over linked tokens."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def push(i: int) -> None:
        j = ends[i]
        if j < n and (r := ranks.get(piece[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not live[i] or (j := ends[i]) >= n or ends[j] != end:
            continue  # one of the two has been merged since
        live[j], ends[i] = False, end
        if end < n:
            before[end] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[piece[i : ends[i]]] for i in range(n) if live[i]]


class RankMap:
    """The merges of a vocabulary as literals: a perfect hash from pairs of ids to ranks.

    A pair's key picks a multiplier; key times multiplier, modulo a prime, is its place in an array of key * NONE + rank.
    A pair that is not there finds another's entry or an empty one, which is further than NONE from its own key.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= NONE:
            raise ValueError("ids must be below 65536")
        pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    pairs[a * NONE + b] = rank
        self.places = next(n for n in range(len(pairs) * 3 // 2 + 1, 1 << 40) if n % 2 and all(n % q for q in range(3, int(n**0.5) + 1, 2)))
        self.groups = max(1, len(pairs) // 4)
        by: list[list[int]] = [[] for _ in range(self.groups)]
        for key in pairs:
            by[key % self.groups].append(key)
        # Free places are -1, which is short, as plans print their literals and Spark keeps the text of many plans.
        table, multipliers = [-1] * self.places, [1] * self.groups
        for g in sorted(range(self.groups), key=lambda g: -len(by[g])):
            m = 1
            while len(free := {k * m % self.places for k in by[g]}) < len(by[g]) or any(table[i] >= 0 for i in free):
                m += 1
            multipliers[g] = m
            for k in by[g]:
                table[k * m % self.places] = k * NONE + pairs[k]
        literal = lambda a: F.from_json(F.lit(json.dumps(a, separators=(",", ":"))), "array<bigint>")
        self.table, self.multipliers, self.bytes = literal(table), literal(multipliers), literal([ranks[bytes([i])] for i in range(256)])

    def rank(self, maps: Column, a: Column, b: Column) -> Column:
        """The rank of a pair of ids, which is the id of the merged token; NONE if there is no such token."""
        key = a * NONE + b
        place = key * F.get(maps["multipliers"], (key % self.groups).cast("int")) % self.places
        return F.least(F.pmod(F.get(maps["table"], place.cast("int")) - key * NONE, F.lit(_HIGH)), F.lit(NONE))

    def encode(self, piece: Column) -> Column:
        """array<bigint> of the ids of a string column of non-empty pieces that are no tokens themselves."""
        maps = F.struct(self.table.alias("table"), self.multipliers.alias("multipliers"), self.bytes.alias("bytes"))
        return _bind(maps, lambda m: self._encode(piece, m))  # so each literal is in the plan once

    def _encode(self, piece: Column, maps: Column) -> Column:
        # One number for each token: the rank of the pair it begins, its place and its id; so the least number is that of
        # the pair to merge, and neither place nor order change when others are merged.
        own = lambda x: x.bitwiseAND(NONE - 1)
        put = lambda rank, rest: F.shiftleft(F.coalesce(rank, F.lit(NONE)), 44).bitwiseOR(rest)

        def start(ids: Column) -> Column:
            return F.transform(ids, lambda x, i: put(self.rank(maps, x, F.get(ids, i + 1)), F.shiftleft(i.cast("bigint"), 16).bitwiseOR(x)))

        def merge(acc: Column, best: Column, at: Column) -> Column:
            new, last, after = F.shiftright(best, 44), F.get(acc, at - 2), F.get(acc, at + 1)
            low = lambda x: x.bitwiseAND((1 << 44) - 1)
            joined = put(self.rank(maps, new, own(after)), low(best).bitwiseAND(-NONE).bitwiseOR(new))
            ahead = F.when(at > 1, F.array(put(self.rank(maps, own(last), new), low(last)), joined)).otherwise(F.array(joined))
            return F.concat(F.slice(acc, 1, F.greatest(at - 2, F.lit(0))), ahead, F.slice(acc, at + 2, F.lit(1 << 30)))

        def step(acc: Column, _: Column) -> Column:
            found = lambda best: F.when(best >= NONE << 44, acc).otherwise(_bind(F.array_position(acc, best).cast("int"), lambda at: merge(acc, best, at)))
            return _bind(F.array_min(acc), found)

        latin = F.split(F.decode(F.encode(piece, "utf-8"), "ISO-8859-1"), "")  # one character for each byte
        ids = F.transform(latin, lambda c: F.get(maps["bytes"], F.ascii(c)))
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.octet_length(piece), F.lit(2))), _bind(ids, start), step, lambda acc: F.transform(acc, own))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern in a text column, each followed by _SEP, as one string; and null. If the text has a _SEP in
    it, an empty string, and the matches as an array. Strings cost a fraction of the memory of arrays."""
    every = F.regexp_replace(text, F.lit(f"(?U)({pattern})|(?s:.)"), F.lit(f"$1{_SEP}"))  # (?U): white space is Unicode's
    odd = F.contains(text, F.lit(_SEP))
    return F.when(odd, F.lit("")).otherwise(every), F.when(odd, F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0)))


def _pieces(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(all pieces of the rows, where each row's end) of columns t and pieces."""
    lists, arrays = pc.split_pattern(batch.column("t"), _SEP), batch.column("pieces")
    if arrays.null_count < len(arrays):
        lists = pa.array([a if b is None else b for a, b in zip(lists.to_pylist(), arrays.to_pylist(), strict=True)], pa.list_(pa.string()))
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[ends]


def _binary(data, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary array of consecutive runs of bytes, or one of strings."""
    offsets = np.concatenate([[0], ends]).astype("<i4")
    return pa.Array.from_buffers(kind or pa.binary(), len(ends), [None, pa.py_buffer(offsets), data])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces and their ids as bytes, some to a row: texts, their lengths, numbers of ids, ids."""
    for batch in batches:
        words, ids = batch.column("word"), batch.column("ids")
        short = lambda a: a.to_numpy(zero_copy_only=False).astype("<u2").tobytes()
        parts = "".join(words.to_pylist()).encode(), short(pc.binary_length(words)), short(pc.list_value_length(ids)), short(ids.flatten())
        yield pa.record_batch({k: pa.array([x], pa.binary()) for k, x in zip(("texts", "lengths", "sizes", "codes"), parts, strict=True)})


def common_pieces(texts: DataFrame, table: RankMap, ranks: dict[bytes, int], sample_rows: int, most_bytes: int) -> list[bytes]:
    """As _pack has it: the vocabulary's own texts, and the pieces of a sample of rows, encoded; those that occur most first, and of
    `most_bytes` bytes at most. `texts` has the columns t and pieces. This saves encoding a piece in every task that meets
    it; other pieces are encoded where they occur, so results do not depend on it."""
    own = [(p.decode(), [r]) for p, r in ranks.items() if p.decode("utf-8", "ignore").encode() == p]
    packed = next(_pack(iter([pa.record_batch({"word": pa.array([w for w, _ in own], pa.string()), "ids": pa.array([i for _, i in own], pa.list_(pa.int64()))})])))
    known = [packed.column(k)[0].as_py() for k in range(4)]
    tokens = texts.sparkSession.sparkContext.broadcast([w for w, _ in own])  # as large as the vocabulary

    @lean
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(tokens.value, pa.string())
        for batch in batches:
            for part in parts(batch, "t"):
                words = pc.unique(_pieces(part)[0])
                yield pa.record_batch({"word": words.filter(pc.invert(pc.is_in(words, value_set=known)))})

    n = texts.count()
    if not n:
        return known
    words = texts.sample(min(1.0, sample_rows / n), seed=1).mapInArrow(distinct, "word string")
    words = cut(words.where(F.octet_length("word") <= LONG).groupBy("word").agg(F.count("*").alias("n")))
    sizes = words.groupBy("n").agg(F.sum(F.octet_length("word")).alias("bytes"), F.count("*").alias("words")).collect()  # a row for each count
    bytes_, many, least = 0, 0, None
    for r in sorted(sizes, reverse=True):
        bytes_ += r.bytes
        if bytes_ > most_bytes:
            break
        many, least = many + r.words, r.n
    if least is None:
        return known
    more = words.where(F.col("n") >= least).repartition(1 + many // 8192).select("word", table.encode(F.col("word")).alias("ids"))
    rows = more.mapInArrow(_pack, "texts binary, lengths binary, sizes binary, codes binary").collect()  # most_bytes of texts, and about as much again
    return [b"".join([x, *(r[k] for r in rows)]) for k, x in enumerate(known)]


def encode_texts(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, sample_rows: int = 16_384, sample_bytes: int = 4 << 20, most_words: int = 1 << 18) -> DataFrame:
    """One row per input row: id_col, n_tokens (long), ids (binary: little-endian unsigned 32-bit), decoded (binary).

    Each match of `pattern` is encoded by itself, as the tiktoken library does, without special tokens; `decoded` is made
    from the ids, and null unless `decode`. Null and empty texts have no ids. Ids may be null or repeat; rows are encoded one
    by one, however long, and so are pieces: those of more than LONG bytes by merge_long. Other columns are not read. An
    empty table gives an empty result.

    The pieces of about sample_rows rows, sample_bytes of them at most, are encoded first and sent to all tasks; a task's
    dictionary of further pieces starts anew at most_words. These three are about time and memory, not about results.
    """
    sc, table = df.sparkSession.sparkContext, RankMap(ranks)
    id_type = df.schema[id_col].dataType.simpleString()
    as_string, as_array = split_pieces(F.coalesce(F.col(text_col), F.lit("")), pattern)
    rows = df.select(F.col(id_col).alias("id"), as_string.alias("t"), as_array.alias("pieces"))
    texts, lengths, sizes, codes = map(sc.broadcast, common_pieces(rows.select("t", "pieces"), table, ranks, sample_rows, sample_bytes))
    vocabulary = sc.broadcast(ranks)
    gc.collect()
    trim_driver(df.sparkSession)  # what building the tables took on the driver is no longer needed

    @lean
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of new pieces (word, its number n, and its ids if it is long), then rows of texts (id, their pieces' numbers)."""
        base = _binary(pa.py_buffer(texts.value), np.cumsum(np.frombuffer(lengths.value, "<u2"), dtype=np.int64), pa.string())
        known = base
        for batch in batches:
            for part in parts(batch, "t"):
                if len(known) > len(base) + most_words:
                    known = base
                flat, ends = _pieces(part)
                coded = flat.dictionary_encode()
                found = pc.index_in(coded.dictionary, value_set=known)
                fresh, at = pc.is_null(found).to_numpy(zero_copy_only=False), np.array(pc.fill_null(found, 0), np.int64)
                n = int(fresh.sum())
                at[fresh] = len(known) + np.arange(n)
                if n:
                    new = coded.dictionary.filter(pa.array(fresh))
                    known = pa.concat_arrays([known, new])
                    long = pc.greater(pc.binary_length(new), LONG)
                    ids = pa.array([merge_long(w.encode(), vocabulary.value) if x else None for w, x in zip(new.to_pylist(), long.to_pylist(), strict=True)] if pc.any(long).as_py() else [None] * n, pa.list_(pa.int64()))
                    yield pa.record_batch({"word": new, "given": ids, "n": pa.array(len(known) - n + np.arange(n)), "id": pa.nulls(n, part.column("id").type), "codes": pa.nulls(n, pa.binary())})
                numbers = at.astype("<u4")[coded.indices.to_numpy()]
                m = len(part)
                yield pa.record_batch({"word": pa.nulls(m, pa.string()), "given": pa.nulls(m, pa.list_(pa.int64())), "n": pa.nulls(m, pa.int64()), "id": part.column("id"), "codes": _binary(pa.py_buffer(numbers), 4 * ends)})

    @lean
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.frombuffer(sizes.value, "<u2").astype(np.int64), np.frombuffer(codes.value, "<u2")
        n_base, has = len(base[0]), [base]
        tokens = [b""] * (max(vocabulary.value.values()) + 1)
        for piece, rank in vocabulary.value.items():
            tokens[rank] = piece
        tokens = pa.array(tokens, pa.binary())
        for batch in batches:
            is_text = pc.is_null(batch.column("n")).to_numpy(zero_copy_only=False)
            turns = [0, *(np.flatnonzero(np.diff(is_text)) + 1), len(batch)]
            for a, b in zip(turns, turns[1:]):
                run = batch.slice(a, b - a)
                if not is_text[a]:
                    n, ids = run.column("n").to_numpy(), run.column("ids")
                    if n[0] == n_base:
                        has = [base]
                    if n[0] != sum(len(x[0]) for x in has) or n[-1] - n[0] != len(n) - 1:
                        raise RuntimeError("pieces did not come in order")
                    has.append((pc.list_value_length(ids).to_numpy(), ids.flatten().to_numpy().astype("<u2")))
                    continue
                if len(has) > 1:
                    has = [tuple(np.concatenate(c) for c in zip(*has, strict=True))]
                size, coded = has[0]
                start = np.cumsum(size) - size
                for part in parts(run, "codes"):
                    offsets = np.frombuffer(part.column("codes").buffers()[1], "<i4")[part.column("codes").offset :][: len(part) + 1]
                    which = np.frombuffer(part.column("codes").buffers()[2] or b"", "<u4")[offsets[0] // 4 : offsets[-1] // 4]
                    n = size[which]
                    upto = np.concatenate([[0], np.cumsum(n)])
                    ids = coded[np.repeat(start[which] - upto[:-1], n) + np.arange(upto[-1])].astype("<u4")
                    ends = upto[(offsets[1:] - offsets[0]) // 4]
                    out = {id_col: part.column("id"), "n_tokens": pa.array(np.diff(ends, prepend=0)), "ids": _binary(pa.py_buffer(ids), 4 * ends), "decoded": pa.nulls(len(part), pa.binary())}
                    if decode:
                        pieces = tokens.take(pa.array(ids))
                        out["decoded"] = _binary(pieces.buffers()[2] or pa.py_buffer(b""), np.frombuffer(pieces.buffers()[1], "<i4")[ends])
                    yield pa.record_batch(out)

    coded = F.when(F.col("word").isNotNull() & F.col("given").isNull(), table.encode(F.col("word"))).otherwise(F.col("given"))
    numbered = rows.mapInArrow(number, f"word string, given array<long>, n long, id {id_type}, codes binary")
    return numbered.select(coded.alias("ids"), "n", "id", "codes").mapInArrow(assemble, f"`{id_col}` {id_type}, n_tokens long, ids binary, decoded binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_texts(read(spark, sf_dir, "documents"), load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
