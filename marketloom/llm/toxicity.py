"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding homoglyphs and digit substitutions.

The score of a text is the sum of its hits' weights, less those inside exception phrases, normalised by length and
squashed to 0..1. The lexicon is fitted on a bounded sample of labelled rows (`training_rows`): words and word beginnings
that tell toxic from clean texts, each weighted by its log odds. The exception phrases come from the same rows: a word of
the lexicon with its neighbour, where clean texts have the two and toxic ones do not.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import cut, lean, read

#: Letters of other scripts that look like Latin ones, and signs that stand in for letters.
HOMOGLYPHS = str.maketrans("авеёзікмнорстухѕјԁɡαβεικνορτυχıļ", "abeesikmhopctyxsjdgabeikvoptuxil")
DIGITS = str.maketrans("01345789@$!|", "oieastbgasii")
_ODD = re.compile("[ƀ-᷿ -⁯＀-￯\U0001d400-\U0001d7ff]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_MIXED = re.compile(r"(?<![^\W_])[^\W_]*[0-9@$!|][^\W\d_][^\s]*|(?<![^\W\d_])[^\W\d_]+[0-9@$!|][^\s]*")  # tried once in each word
_WORD = re.compile(r"[^\W\d_]+")
_NEXT = re.compile(r" [^\W\d_]++(?!\w)")
PREFIXES = (4, 5, 6, 7, 8, 10, 12)


def fold(text: str) -> str:
    """Lower case, look-alike letters made Latin, and digits or signs inside words made letters."""
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower().translate(HOMOGLYPHS)
    return _MIXED.sub(lambda m: m[0].translate(DIGITS), text)


def features(text: str) -> set[str]:
    """The folded words of a text, and as `stem*` their beginnings."""
    words = {w for w in _WORD.findall(fold(text)) if len(w) >= 3}
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


def training_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 20_000, train_chars: int = 1 << 28) -> DataFrame:
    """The bounded sample that the lexicon and its exceptions are fitted on: (h, y, t), a row for each different text, whole.

    Labels are those of `labels`; null ones and null ids are left out, and an id or text labelled both ways counts as toxic.
    The sample is the `train_rows` labelled ids with the smallest hash, and of their texts, in the order of their digests, those
    that together have `train_chars` characters at most. Null texts count as empty. The sample is a table in the shared folder.
    """
    wanted = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    wanted = wanted.orderBy(F.xxhash64(id_col), id_col).limit(train_rows)
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(wanted), id_col)  # at most train_rows rows
    rows = cut(rows.groupBy(F.sha2("t", 256).alias("h")).agg(F.max((F.col("y") == 1).cast("int")).alias("y"), F.first("t").alias("t")))
    running = F.sum("n").over(Window.orderBy("h"))  # over digests and lengths of at most train_rows rows
    fits = rows.select("h", F.length("t").cast("long").alias("n")).withColumn("upto", running).where(F.col("upto") <= train_chars)
    return rows.join(F.broadcast(fits.select("h")), "h", "left_semi")


def learn_lexicon(rows: DataFrame, min_docs: int = 3) -> list[tuple[str, float]]:
    """(term, weight) of the lexicon from training_rows(), best first; a term that ends in * is a word's beginning.

    A greedy cover picks terms: each in turn is the one that explains most toxic texts not yet explained twice, among terms
    that are at least e^3 times as frequent in toxic texts; so chance companions of the real words are not picked. Equal texts
    count once, whole and however long. Without toxic labels or rows, as in empty tables, the lexicon is empty. What the
    driver holds is the telling terms of the sample's toxic texts, so it is bounded as the sample is.
    """

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for pdf in batches:
            for t, y in zip(pdf["t"], pdf["y"], strict=True):
                for f in features(t):
                    by[f][int(y == 1)] += 1
        yield pd.DataFrame([(f, *n) for f, n in by.items()], columns=["f", "clean", "toxic"])

    n_toxic, n = rows.agg(F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0)), F.count("*")).first()
    if not n_toxic:
        return []
    n_clean = n - n_toxic
    counted = rows.mapInPandas(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    strong = counted.withColumn("w", odds).where((F.col("toxic") >= min_docs) & (F.col("w") >= 3) & (F.col("toxic") >= 9 * F.col("clean")))
    strong = {r.f: (r.w, r.toxic, r.clean) for r in strong.collect()}
    names = rows.sparkSession.sparkContext.broadcast(frozenset(strong))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"fs": [sorted(features(t) & names.value) for t in pdf["t"]]})

    texts = [r.fs for r in rows.where("y = 1").mapInPandas(keep, "fs array<string>").collect()]  # of the sample, its toxic texts
    need, holders = [2] * len(texts), defaultdict(list)
    for i, fs in enumerate(texts):
        for f in fs:
            holders[f].append(i)
    lexicon: list[tuple[str, float]] = []
    gain = Counter({f: 2 * len(h) for f, h in holders.items()})
    while gain:
        # On ties a more telling term, then the longest.
        f = max(gain, key=lambda f: (gain[f], -strong[f][2], len(f), f))
        if gain[f] < 2 * min_docs:
            break
        lexicon.append((f, round(strong[f][0], 6)))
        for i in holders[f]:
            if need[i]:
                need[i] -= 1
                for g in texts[i]:
                    gain[g] -= 1
        # Words that begin with a chosen stem, and stems of a chosen stem, say the same.
        bare = f.rstrip("*")
        for g in [g for g in gain if g == f or f.endswith("*") and g.startswith(bare) or g.endswith("*") and bare.startswith(g[:-1])]:
            del gain[g]
    return lexicon


def learn_exceptions(rows: DataFrame, lexicon: Sequence[tuple[str, float]], min_docs: int = 3) -> list[str]:
    """Folded phrases of two words, one of them of the lexicon, in which it is harmless: at least `min_docs` clean texts of
    training_rows() hold the phrase and no toxic one does. A word of the lexicon is at least nine times as often toxic, so
    that many by chance are rare. Sorted; an empty lexicon or table has none.
    """
    lexicon = list(lexicon)
    if not lexicon:
        return []

    @lean
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(lexicon)
        for pdf in batches:
            out = [(p, y) for t, y in zip(pdf["t"], pdf["y"], strict=True) for p in m.phrases(fold(t))]
            yield pd.DataFrame(out, columns=["phrase", "y"])

    counted = rows.mapInPandas(pairs, "phrase string, y int").groupBy("phrase").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    return sorted(r.phrase for r in counted.where((F.col("toxic") == 0) & (F.col("n") >= min_docs)).collect())


class Matcher:
    """Scores texts against a lexicon; made once in each task."""

    def __init__(self, lexicon: Sequence[tuple[str, float]], exceptions: Sequence[str] = (), bias: float = 2.0):
        import ahocorasick

        self.bias, self.automaton, self.exceptions = bias, ahocorasick.Automaton(), ahocorasick.Automaton()
        for term, weight in lexicon:
            stem = term.rstrip("*")
            for form in {stem, stem.replace("l", "i")}:  # the digit 1 stands for either letter
                self.automaton.add_word(form, (len(form), term.endswith("*"), weight))
        for phrase in exceptions:
            self.exceptions.add_word(phrase, len(phrase))
        for a in (self.automaton, self.exceptions):
            if len(a):
                a.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the lexicon's terms in a folded text, exceptions or not."""
        hits = []
        for end, (n, stem, weight) in self.automaton.iter(text) if len(self.automaton) else ():
            s, e = end - n + 1, end + 1
            if (s == 0 or not text[s - 1].isalpha()) and (stem or e == len(text) or not text[e].isalpha()):
                hits.append((s, e, weight))
        return hits

    def phrases(self, text: str) -> set[str]:
        """Pairs of words, one space apart, of which one is a hit in a folded text."""
        out: set[str] = set()
        for s, e, _ in self.hits(text):
            while e < len(text) and text[e].isalpha():
                e += 1
            after, before = _NEXT.match(text, e), s - 1
            if after:
                out.add(text[s : after.end()])
            while before > 0 and text[before - 1].isalpha():
                before -= 1
            if 0 <= before < s - 1 and text[s - 1] == " " and (before == 0 or not text[before - 1].isalnum()):
                out.add(text[before:e])
        return out

    def score(self, text: str) -> float:
        """0 to 1; texts without hits, empty ones too, get the score of no evidence."""
        total, text = 0.0, fold(text)
        if len(self.automaton):
            hits = self.hits(text)
            if hits and len(self.exceptions):
                free = [(end - n + 1, end + 1) for end, n in self.exceptions.iter(text)]
                free = [(a, b) for a, b in free if not text[a - 1 : a].isalpha() and not text[b : b + 1].isalpha()]  # whole words
                hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in free)]
            total = sum(w for _, _, w in hits)
        words = text.count(" ") + text.count("\n") + 1
        return 1 / (1 + math.exp(min(self.bias - total / (1 + math.log10(1 + words / 100)), 700)))


def score_toxicity(df: DataFrame, lexicon: Sequence[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text", exceptions: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id_col, score (0 to 1). See toxicity_column."""
    return df.select(id_col, toxicity_column(F.col(text_col), lexicon, exceptions).alias("score"))


def toxicity_column(text: Column, lexicon: Sequence[tuple[str, float]], exceptions: Sequence[str] = ()) -> Column:
    """The score of a text column, 0 to 1, as a column. Null texts count as empty; both get the lowest score.

    The whole text counts, however long. Rows do not depend on each other, so repeated rows get equal scores, any other
    columns may go along, and there is no shuffle. An empty table gives an empty one.
    """
    lexicon, exceptions = list(lexicon), list(exceptions)

    @F.pandas_udf("double")
    @lean
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(lexicon, exceptions)
        for s in batches:
            yield pd.Series([m.score(t) for t in s], dtype=float)

    return score(F.coalesce(text, F.lit("")))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = training_rows(docs, read(spark, sf_dir, "labels").where(~held_out()))
    lexicon = learn_lexicon(rows)
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity_column(F.col("text"), lexicon, learn_exceptions(rows, lexicon)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
