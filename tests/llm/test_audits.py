"""Language-model scores, source divergence and filter interactions against plain Python, with nulls, ties, repeated rows and long texts."""

import heapq
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import common, filter_audit, katz, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Äpfel", "Été", "été", "naïve", "a b", "x\x1cy"]

    def text(n):
        return " ".join(vocabulary[min(int(rng.expovariate(0.08)), len(vocabulary) - 1)] for _ in range(n))

    base = text(220)
    texts = [None, "", "", " \t\n", "one", "ONE", base, base, base, base.upper(), base + " $", "A" * 300, "a" * 300, "frequent pair " * 40, "long " + "tail " * 30_000]
    texts += [text(rng.randrange(1, 260)) for _ in range(70)]
    texts += ["z" * 260 + "q", "z" * 260 + "r", "y" * 5000 + "1", "y" * 5000 + "2", "y" * 5000 + "1"]
    out = [(i, t, rng.choice(["en", "de"]) if i % 9 else None, rng.choice(["s1", "s2", "s3", "s4", "s5", "s6", None, ""]), 1) for i, t in enumerate(texts)]
    return [*out, (None, base, "en", "s1", 1), (None, "only one here", None, None, 1), (None, "only one here", "fr", "lone", 1), out[7], out[20], (300, None, "xx", "a", 1), (301, "rare", "xx", "b", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"t": F.lit("clash"), "n": F.lit(1), "item": F.lit("clash"), "block": F.lit(2)}).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Language-model scores


def crc(i):
    return None if i is None else zlib.crc32(str(i).encode())


def plain_katz(rows, train):
    """The definition, with dictionaries."""
    tokens = [[*WORDS.findall(lower(t)), None] for _, t in rows]
    words, pairs = Counter(), Counter()
    for ws, learn in zip(tokens, train, strict=True):
        if learn:
            words.update(ws)
            pairs.update(zip(["", *ws], ws, strict=False))
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c

    def discounts(counts):
        n = Counter(counts.values())
        top = 6 * n[6] / n[1] if n[1] else 1
        turing = {r: ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0 for r in range(1, 6)}
        return turing if all(0 < d < 1 for d in turing.values()) else {r: (r - 0.5) / r for r in range(1, 6)}

    d1, d2 = discounts(words), discounts(pairs)
    total = sum(words.values())
    kept = sum(c * d1.get(c, 1) for c in words.values())
    over = total if any(c <= 5 for c in words.values()) else total + 1

    def word(w):
        c = words[w]
        return c * d1.get(c, 1) / over if c else 1 - kept / over

    def pair(h, w):
        if h not in after:
            return word(w)
        seen = after[h]
        c_h = sum(seen.values())
        over = c_h if any(c <= 5 for c in seen.values()) else c_h + 1
        if w in seen:
            return seen[w] * d2.get(seen[w], 1) / over
        left = 1 - sum(c * d2.get(c, 1) for c in seen.values()) / over
        return left / (1 - sum(map(word, seen))) * word(w)

    out = []
    for ws in tokens:
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (len(words) + 1))) for w in ws)
        out.append((len(ws), sum(words[w] > 0 for w in ws), total, base, sum(math.log10(pair(h, w)) for h, w in zip(["", *ws], ws, strict=False))))
    return out, words, after, pair


@pytest.mark.parametrize("block_tokens, part_keys", [(1 << 22, 1 << 21), (500, 900)])
def test_katz(docs, rows, block_tokens, part_keys):
    train = [crc(r[0]) is None or crc(r[0]) % 10 != 0 for r in rows]
    want, words, after, pair = plain_katz([(r[0], r[1]) for r in rows], train)
    for h in [*list(after)[:40], "", "unheard"]:  # exactly normalised
        assert sum(pair(h, w) for w in [*words, "never seen"]) == pytest.approx(1, abs=1e-9)
    got = katz.katz_scores(docs, ~katz.held_out(), block_tokens=block_tokens, part_keys=part_keys).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *map(float, x[1:]))
    a = sorted(((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    b = sorted(((r[0], t, *w) for r, t, w in zip(rows, train, want, strict=True)), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9, abs=1e-9)


def test_katz_blocks_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    n = 400_000
    tokens, hashes = rng.zipf(1.3, n).clip(max=20_000).astype("u8") - 1, rng.integers(0, 2**63, 20_000, dtype="u8")
    lengths = np.full(n // 200, 200, "u8")
    tracemalloc.start()
    block = katz.Block(hashes, lengths, np.ones(len(lengths), "u8"), tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 56 * n  # bytes
    before = np.concatenate([[20_000] if i % 200 == 0 else [tokens[i - 1]] for i in range(n)]).astype(int)
    values, first, of = np.unique(before * 20_000 + tokens.astype(int), return_index=True, return_inverse=True)
    assert (block.history * 20_000 + block.word == values).all() and (block.pair_of == of).all()
    got = katz._distinct(before)
    assert all((a == b).all() for a, b in zip(got, np.unique(before, return_index=True, return_inverse=True), strict=True))


def test_katz_leaves_no_spent_files(spark, docs, monkeypatch):
    folders = [Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f.name for d in folders for f in d.rglob("shuffle_*.data")}
    monkeypatch.setattr(common, "trim_driver", lambda _: None)  # may remove shuffle files too, or may not
    option, tables = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(option, None)

    def cut(df):
        lay, end = shuffles(), time.monotonic() + 10
        tables.append(common.cut(df))
        while shuffles() - lay and time.monotonic() < end:
            time.sleep(0.1)
        assert not shuffles() - lay
        if "total" in df.columns:  # rows that answer no block hold sums and no keys
            assert tables[-1].where("block IS NULL AND total > 0").count() > 0 == tables[-1].where("block IS NULL AND blob IS NOT NULL").count()
        return tables[-1]

    monkeypatch.setattr(katz, "cut", cut)
    out = katz.katz_scores(docs, ~katz.held_out(), block_tokens=500, part_keys=900)
    left = [t.columns for t in tables if any(Path(f.removeprefix("file://")).exists() for f in t.inputFiles())]
    assert len(left) == 2 and not any("blob" in c for c in left)  # evaluated blocks, and the documents' rows
    assert out.count() == out.count() == docs.count() and spark.conf.get(option, None) == before


def test_katz_small_corpora(spark, docs, none):
    assert katz.katz_scores(none, F.lit(True)).count() == 0
    untrained = katz.katz_scores(docs.limit(5), F.lit(None).cast("boolean")).collect()
    assert len(untrained) == 5 and all(r.base_score == 0 and r.score == 0 and r.train_tokens == 0 for r in untrained)
    same = spark.createDataFrame([(i, "the same words " * 9) for i in range(12)] + [(99, "the other same")], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in same.collect()]
    want = plain_katz(rows, [i != 99 for i, _ in rows])[0]  # histories and words without any rare follower
    got = {r.doc_id: r for r in katz.katz_scores(same, F.col("doc_id") != 99).collect()}
    for (i, _), w in zip(rows, want, strict=True):
        assert (got[i].base_score, got[i].score) == pytest.approx(w[3:], rel=1e-9)


def test_katz_discounts():
    d = katz.discounts([100, 40, 20, 12, 8, 5])
    assert d[0] == 0 and d[-1] == 1 and all(0 < x < 1 for x in d[1:-1])
    assert list(katz.discounts([0] * 6)[1:-1]) == list(katz.discounts([1, 9, 1, 1, 1, 1])[1:-1]) == [(r - 0.5) / r for r in range(1, 6)]


# Source divergence


def plain_divergence(rows, least_docs, top=50):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least_docs]

        def p(c):
            n = sum(c[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}  # noqa: B023

        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        ps = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(whole[t] - ps[s][t], t.encode()) for t in kept if counts[lang, s][t] and ps[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", heapq.nsmallest(top, terms))):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("options", [{}, {"cell": 1, "width": 7, "wave": 2}, {"cell": 2, "width": 20, "wave": 1, "top": 3}, {"least_docs": 10_000}])
def test_source_divergence(docs, none, rows, options):
    least = options.get("least_docs", 5)
    got = source_divergence.source_divergence(docs, **({"least_docs": least} | options)).collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == plain_divergence(rows, least, options.get("top", 50))
    if not options:
        assert source_divergence.source_divergence(none).count() == 0


def test_probability():
    for total, terms in ((9, 2), (10**12, 10**6), (10**17, 5)):
        counts = np.array([0, 1, total // 3, total], np.int64)
        assert source_divergence.probability(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]


@pytest.mark.parametrize("players", [1, 2, 5, 6, 9])
def test_tournament(spark, players):
    d = spark.range(players).select(F.col("id").cast("int").alias("me"), F.explode(F.sequence(F.lit(0), F.lit(max(0, players + players % 2 - 2)))).alias("turn"))
    met = Counter()
    for r in d.withColumn("other", source_divergence.opponent(F.col("me"), F.col("turn"), F.lit(players))).collect():
        if r.other < players:
            met[frozenset((r.me, r.other))] += 1
    assert met == {frozenset(p): 2 for p in itertools.combinations(range(players), 2)}  # seen from both sides


# Filter interactions


def plain_masks(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _, source, _ in rows:
        t = t or ""
        ws = WORDS.findall(t)
        first = least.get(t)
        later = first is not None and (i is None or i > first)
        fails = (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), later)
        out.append((i, source or "", "".join(f for f, bad in zip("ABCDE", fails, strict=True) if bad)))
    return out


@pytest.mark.parametrize("digest", [16, 1])  # with one byte, different texts have equal hashes
def test_failure_masks(docs, none, rows, digest):
    got = filter_audit.failure_masks(docs, digest=digest).collect()
    named = Counter((r.id, r.part, "".join(f for i, f in enumerate("ABCDE") if r.mask >> i & 1)) for r in got)
    assert named == Counter(plain_masks(rows))
    if digest == 16:
        assert filter_audit.failure_masks(none).count() == 0


def test_interactions(spark, docs, none, rows):
    labels = [(i, i % 2 if i % 3 else None, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    masks = plain_masks(rows)
    want = {}
    for order in itertools.permutations("ABCDE"):
        for part in {p for _, p, _ in masks}:
            left = [m for m in masks if m[1] == part]
            for k, f in enumerate(order):
                gone = [m for m in left if f in m[2]]
                failing = [m for m in masks if m[1] == part and f in m[2]]
                left = [m for m in left if f not in m[2]]
                want[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(m[2] == f for m in failing), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)]
    shapley = Counter()
    for (part, order, k), v in want.items():
        shapley[part, order[k - 1]] += v[1]
    got = filter_audit.interactions(filter_audit.failure_masks(docs), frame).collect()
    assert len(got) == len(want)
    for r in got:
        assert list(r)[3:] == [*want[r.part, r.filter_order, r.step], shapley[r.part, r.filter_order[r.step - 1]]]
    assert filter_audit.interactions(filter_audit.failure_masks(none), frame).count() == 0
