"""Language-model scores by a bigram model with Katz backoff, learnt from the corpus that it scores.

P(w | h) of a word w after a word h is d(c) c / T(h) where the bigram was seen c > 0 times, else alpha(h) P(w), and P(w) is
d(c) c / T where the word was seen, else the mass of all unseen words. d are Good-Turing discounts of counts up to KATZ, T(h)
is the count of h, and alpha(h) shares out exactly what the seen words leave: so each P(. | h) sums to 1 over all words seen,
the end, and one class of unseen words.

Texts never travel. They are encoded once in blocks of some millions of tokens, so each word and bigram is looked up once a
block, however often it occurs:

1. A block holds its tokens as numbers of its words, compressed, and one hash for each word.
2. A block sends the keys of its distinct words and bigrams with their counts in training texts to the parts of the count
   tables, as sorted packed arrays. A part sums the counts, answers each block with the totals in the order in which it asked,
   and leaves counts of counts; the keys, which nobody asks for again, stay with it. No key is hot: it comes once from a block.
3. A block evaluates its tokens recursively, bigram first, then word, then unseen word. What is left to others are the backoff
   weights of histories. Each seen bigram has one block that owns it and adds its share of its history's discounted and
   backed-off mass; only (document, history) pairs with unseen words then wait for their history's weight.
4. Weights and waiting pairs are joined by history, and everything is summed by document.

Blocks, counts and evaluated blocks are tables in the shared folder: what a lost executor worked on is done again from these.
Blocks and counts go once the blocks are evaluated, shuffle files as soon as the table made of them is there.
A packet of a block to a part is never empty, so there are at most as many as distinct n-grams in blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import cut, forget, lean, read, tidy, trim

KATZ = 5  # counts above this are not discounted
BLOCK_TOKENS, PART_KEYS = 1 << 21, 1 << 21
END = 0  # the number of the end in each block; no word is empty, so its text is b""
_BEGIN = np.uint64(0x9E3779B97F4A7C15)  # stands for the hash of the history of a first word


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, by planes of bytes (the upper ones are mostly zeros), compressed."""
    import zstandard

    flat = [a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zstandard.compress(np.array([len(arrays), *map(len, flat)], "<u8").tobytes() + b"".join(flat), 3)


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum([0, *np.frombuffer(raw, "<u8", n, 8)]).astype(int)
    return [np.ascontiguousarray(np.frombuffer(raw[a:b], np.uint8).reshape(8, -1).T).view("<u8").ravel() for a, b in zip(ends, ends[1:], strict=False)]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xBF58476D1CE4E5B9) + (b ^ (b >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where each occurs first, and each element's place among them; in less memory than np.unique."""
    order = np.argsort(a, kind="stable").astype(np.int32)
    a = a[order]
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    of = np.empty(len(a), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return a[new], order[new], of


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Documents as numbers of words: hashes of the words, lengths, whether they are trained on, and tokens."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, train: np.ndarray, tokens: np.ndarray):
        self.hashes, self.lengths, self.tokens = hashes, lengths.astype(np.int64), tokens.astype(np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.trained = np.repeat(train.astype(bool), self.lengths)
        self.words = len(hashes)
        pairs = np.empty(len(tokens), np.int64)  # histories; the number after the last word's is that of the beginning
        pairs[1:] = self.tokens[:-1]
        pairs[self.starts] = self.words
        pairs *= self.words
        pairs += self.tokens
        pairs, _, self.pair_of = _distinct(pairs)
        self.history, self.word = np.divmod(pairs, self.words)
        self.histories = np.append(hashes, _BEGIN)

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of words or bigrams, and the order that sorts them."""
        keys = _mix(self.hashes, np.uint64(order)) if order == 1 else _mix(self.histories[self.history], self.hashes[self.word])
        return keys, np.argsort(keys)

    def counts(self, order: int) -> np.ndarray:
        """How often each word or bigram occurs in training texts."""
        which = (self.tokens if order == 1 else self.pair_of)[self.trained]
        return np.bincount(which, minlength=self.words if order == 1 else len(self.word))


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """docs (id, train, t) as rows of documents (block, place, id, train, n_tokens) and of blocks (block, blob, n_keys: a bound)."""
    kind = docs.schema["id"].dataType
    schema = f"block long, place int, id {kind.simpleString()}, train boolean, n_tokens long, blob binary, n_keys long"

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        numbers, tokens, ids, train, held = _Numbers({b"": END}), [], [], [], 0

        def close() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            lengths = np.array([len(t) for t in tokens])
            number, n = uuid.uuid4().int >> 65, len(ids)
            none = [None] * n
            return pa.record_batch({
                "block": pa.array([number] * (n + 1), pa.int64()), "place": pa.array([*range(n), None], pa.int32()), "id": pa.concat_arrays([*ids, pa.nulls(1, ids[0].type)]),
                "train": pa.array([*train, None], pa.bool_()), "n_tokens": pa.array([*map(int, lengths), None], pa.int64()),
                "blob": pa.array([*none, _pack(hashes, lengths, np.array(train), np.concatenate(tokens))], pa.binary()), "n_keys": pa.array([*none, len(hashes) + int(lengths.sum())], pa.int64()),
            })

        for batch in batches:
            for i in range(len(batch)):
                words = batch.column("t")[i].as_py().encode("utf-8", "surrogatepass").lower().split()  # at ASCII white space
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                tokens[-1] = np.append(tokens[-1], np.int32(END))
                ids.append(batch.column("id").slice(i, 1))
                train.append(batch.column("train")[i].as_py())
                held += len(words) + 1
                if held >= size:
                    yield close()
                    numbers, tokens, ids, train, held = _Numbers({b"": END}), [], [], [], 0
                    trim()
        if ids:
            yield close()

    return docs.mapInArrow(encode, schema)


def _ask(blocks: DataFrame, parts: int) -> DataFrame:
    """part, block, order, blob: sorted keys (as differences) and training counts of a block's words and bigrams."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("block").to_pylist(), batch.column("blob"), strict=True):
                block = Block(*_unpack(blob.as_py()))
                for order in (1, 2):
                    keys, at = block.keys(order)
                    keys, counts = keys[at], block.counts(order)[at]
                    bounds = [0, *np.searchsorted(keys, edges), len(keys)]
                    sent = [(p, _pack(np.diff(keys[a:b], prepend=np.uint64(0)), counts[a:b])) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
                    yield pa.record_batch({"part": pa.array([p for p, _ in sent], pa.int32()), "block": pa.array([number] * len(sent), pa.int64()), "order": pa.array([order] * len(sent), pa.int32()), "blob": pa.array([x for _, x in sent], pa.binary())})
                del block, keys, at, counts, sent
                trim()

    return blocks.select("block", "blob").mapInArrow(lean(packets), "part int, block long, order int, blob binary")


_COUNTED = pa.schema([("part", pa.int32()), ("order", pa.int32()), ("block", pa.int64()), ("blob", pa.binary()), ("total", pa.int64()), ("types", pa.int64()), *[(f"n{r}", pa.int64()) for r in range(1, KATZ + 2)]])


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """A part of the tables of one order: sums of its counts (block is null), and an answer to each block.

    An answer is twice the count of each key, plus one if the block owns it, that is, if it asked first.
    """
    out = _sums(*(k.as_py() for k in key), table.sort_by("block"))  # so that owners do not depend on the order of arrival
    trim()
    return out


def _sums(part: int, order: int, table: pa.Table) -> pa.Table:
    blocks, packets = table.column("block").to_pylist(), [_unpack(b.as_py()) for b in table.column("blob")]
    cuts = np.cumsum([0, *(len(k) for k, _ in packets)])
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in packets])
    counts = np.concatenate([c for _, c in packets]).view(np.int64)
    del packets
    kinds, first, of = _distinct(keys)
    del keys
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, of, counts)
    del counts
    answer = 2 * total[of]
    answer[first] += 1
    model = {"total": int(total.sum()), "types": int((total > 0).sum()), **{f"n{r}": int((total == r).sum()) for r in range(1, KATZ + 2)}}
    rows = [model, *[{"block": b, "blob": _pack(answer[i:j])} for b, i, j in zip(blocks, cuts, cuts[1:], strict=False)]]
    return pa.Table.from_pylist([{"part": part, "order": order, **r} for r in rows], schema=_COUNTED)


def discounts(n: list[int]) -> np.ndarray:
    """Katz's discounts d(0) = 0, d(1), ..., d(KATZ), 1 from n[r - 1], the numbers of n-grams seen r times, for r to KATZ + 1.

    Where these numbers give no discount within (0, 1), as in small or odd corpora, it is (r - 1/2) / r for all r.
    """
    plain = [(r - 0.5) / r for r in range(1, KATZ + 1)]
    if n[0]:
        top = (KATZ + 1) * n[KATZ] / n[0]
        if top < 1:
            turing = [((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top) if n[r - 1] else 0.0 for r in range(1, KATZ + 1)]
            if all(0 < d < 1 for d in turing):
                plain = turing
    return np.array([0.0, *plain, 1.0])


class Model:
    """What all blocks need of the count tables: totals and discounts."""

    def __init__(self, stats: dict[int, tuple[int, int, list[int]]]):
        none = (0, 0, [0] * (KATZ + 1))
        self.total, self.types, n = stats.get(1, none)
        self.word_discounts, self.pair_discounts = discounts(n), discounts(stats.get(2, none)[2])
        left = sum(r * n[r - 1] * (1 - self.word_discounts[r]) for r in range(1, KATZ + 1))
        # If no word leaves any mass (all are frequent, or there are none), one more token does.
        self.divisor = self.total if left > 0 else self.total + 1
        self.unseen = left / self.divisor if left > 0 else 1 / self.divisor

    def word(self, count: np.ndarray) -> np.ndarray:
        """P(w) of words by their counts."""
        return np.where(count > 0, self.word_discounts[np.minimum(count, KATZ + 1)] * count / self.divisor, self.unseen)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.types + 1)))


_EVALUATED = "block long, place int, n_known long, base double, score double, history long, low double, mass double, count long, unseen long, seen long"


def evaluate(block: Block, words: np.ndarray, pairs: np.ndarray, owned: np.ndarray, model: Model) -> tuple[dict, dict, dict]:
    """By document, history and (document, history): sums, shares of weights, and numbers of tokens that wait for a weight.

    words and pairs: total counts of the block's words and bigrams; owned: which bigrams it accounts for.
    """
    p = model.word(words)
    of_history = np.append(words, words[END])[block.history]  # as many texts begin as end
    discount = model.pair_discounts[np.minimum(pairs, KATZ + 1)]
    seen = pairs > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(seen, np.log10(discount * pairs / of_history), np.log10(p[block.word]))
    low = seen & (pairs <= KATZ)
    has_low = np.zeros(block.words + 1, bool)
    has_low[block.history[low]] = True
    backs_off = ~seen & (of_history > 0)
    # A history that leaves no mass by discounts counts one more; whether it does is known here if a bigram shows that it leaves some.
    unsure = seen & (of_history > KATZ) & ~has_low[block.history]
    sums = lambda x: np.add.reduceat(x, block.starts)
    docs = {"n_known": sums((words > 0)[block.tokens].astype(np.int64)), "base": sums(model.base(words)[block.tokens]), "score": sums(value[block.pair_of])}

    mine = seen & owned
    share = np.where(pairs <= KATZ, pairs * (1 - discount), 0.0)
    at = block.history[mine]
    add = lambda w: np.bincount(at, weights=w, minlength=block.words + 1)
    used = np.flatnonzero(np.bincount(at, minlength=block.words + 1))
    shares = {"history": block.histories[used], "low": add(share[mine])[used], "mass": add(p[block.word][mine])[used]}

    some = (backs_off | unsure)[block.pair_of]
    which, waits = np.repeat(np.arange(len(block.lengths)), np.add.reduceat(some, block.starts, dtype=np.int64)), block.pair_of[some]
    codes, _, of = _distinct(which * (block.words + 1) + block.history[waits])
    doc, history = np.divmod(codes, block.words + 1)
    number = lambda x: np.bincount(of, weights=x[waits], minlength=len(codes)).astype(np.int64)
    return docs, shares, {"place": doc, "history": block.histories[history], "count": np.append(words, words[END])[history], "unseen": number(backs_off), "seen": number(unsure)}


def _evaluated(model: Model):
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("history", pa.int64()), ("low", pa.float64()), ("mass", pa.float64()), ("count", pa.int64()), ("unseen", pa.int64()), ("seen", pa.int64())])

    def work(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = scores(key, blocks, answers)
        trim()
        return out

    def scores(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(*_unpack(blocks.column("blob")[0].as_py()))
        answers = answers.sort_by([("order", "ascending"), ("part", "ascending")])
        got = {}
        for order in (1, 2):
            sent = [_unpack(b.as_py())[0] for o, b in zip(answers.column("order").to_pylist(), answers.column("blob"), strict=True) if o == order]
            at = block.keys(order)[1]
            got[order] = np.empty(len(at), np.int64)
            got[order][at] = np.concatenate(sent)
        docs, shares, waiting = evaluate(block, got[1] >> 1, got[2] >> 1, (got[2] & 1).astype(bool), model)
        docs["place"] = np.arange(len(block.lengths))
        out = []
        for rows in (docs, shares, waiting):
            n = len(next(iter(rows.values())))
            if "history" in rows:
                rows["history"] = rows["history"].view(np.int64)
            columns = {"block": np.full(n, key[0].as_py()), **rows}
            out.append(pa.Table.from_arrays([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema))
        return pa.concat_tables(out)

    return work


def _cut(df: DataFrame) -> DataFrame:
    with tidy(df.sparkSession):
        return cut(df)


def katz_scores(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, part_keys: int = PART_KEYS) -> DataFrame:
    """One row per input row: id_col, train, n_tokens, n_known, train_tokens (long), base_score, score (double, log10).

    Tokens are runs of other characters than ASCII white space, A-Z in lower case, and one end. The model learns from the rows
    for which `train` is true (null counts as false). base_score is that of single words with 0.1 added to each count and
    one unseen word. Null and empty texts are an end alone. Long texts count whole. Rows with null or repeated ids have a row
    each; repeated rows count each time. Other columns are not read. Without training texts every probability is 1; an
    empty table gives an empty result. Words are told apart by 64-bit hashes, bigrams by 64-bit hashes of these.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    encoded = _cut(_blocks(docs, block_tokens))
    blocks = encoded.where("blob IS NOT NULL")
    parts = max(1, -(-(blocks.agg(F.sum("n_keys")).first()[0] or 0) // part_keys))
    counted = _cut(_ask(blocks, parts).groupBy("part", "order").applyInArrow(_count, "part int, order int, block long, blob binary, total long, types long, " + ", ".join(f"n{r} long" for r in range(1, KATZ + 2))))
    sums = counted.where("block IS NULL").groupBy("order").agg(*[F.sum(c).alias(c) for c in ("total", "types", *[f"n{r}" for r in range(1, KATZ + 2)])]).collect()  # a row for words, a row for bigrams
    model = Model({r.order: (r.total, r.types, [r[f"n{i}"] for i in range(1, KATZ + 2)]) for r in sums})
    answers = counted.where("block IS NOT NULL").select("block", "part", "order", "blob")
    done = _cut(blocks.select("block", "blob").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_evaluated(model), _EVALUATED))
    rows = _cut(encoded.where("blob IS NULL").select("block", "place", "id", "train", "n_tokens"))
    forget(counted, encoded)

    weights = done.where("low IS NOT NULL").groupBy("history").agg(F.sum("low").alias("low"), F.sum("mass").alias("mass"))
    count = F.col("count").cast("double")
    alpha = F.when(F.col("low") > 0, F.col("low") / count).otherwise(1 / (count + 1)) / (1 - F.col("mass"))
    more = F.when(F.col("low") > 0, F.lit(0.0)).otherwise(F.log10(count / (count + 1)))
    waiting = done.where("unseen IS NOT NULL").select("block", "place", "history", "count", "unseen", "seen").join(weights, "history")
    waiting = waiting.select("block", "place", (F.col("unseen") * F.log10(alpha) + F.col("seen") * more).alias("score"))
    own = done.where("n_known IS NOT NULL").select("block", "place", "n_known", "base", "score")
    every = rows.unionByName(own, allowMissingColumns=True).unionByName(waiting, allowMissingColumns=True)
    out = every.groupBy("block", "place").agg(*[F.max(c).alias(c) for c in ("id", "train", "n_tokens", "n_known", "base")], F.sum("score").alias("score"))
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def held_out(id_col: str = "doc_id") -> Column:
    """The tenth of the documents that the model does not learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = katz_scores(read(spark, sf_dir, "documents"), ~held_out())
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op11_katz_scores": op11_katz_scores}
ORACLE_SQL: dict[str, str] = {}
