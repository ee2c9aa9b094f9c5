"""The pipeline against plain Python, and the entry points."""

import gc
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from marketloom.llm import byte_bpe, toxicity
from marketloom.llm.common import cut


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: rng.choice(["al", "be", "ce", "de"]) + str(rng.randrange(3000))
    line = lambda: " ".join(word() for _ in range(12))
    notice = "\n".join(line() for _ in range(5))  # 60 words that many documents share
    rows = []
    for i in range(160):
        ls = [line() for _ in range(rng.randrange(2, 9))]
        if i % 8 == 0:
            w = ls[0].split()
            ls[0] = " ".join([*w[:5], rng.choice(["grolm", "snarf"]), *w[5:]])
        if i % 9 == 1:
            ls.insert(1, notice)
        rows.append((i, "\n".join(ls), "en", "big" if i % 3 else f"s{i % 4}", 0))
    for i in range(160, 190):  # near copies on one long line, copies
        w = rows[rng.choice([33, 35, 36])][1].replace("\n", " ").split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "s1", 0))
    rows += [(190, rows[5][1], "en", "s1", 0), (191, None, "en", "s2", 0), (192, "", "fr", None, 0), (193, "x", "fr", None, 0)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return f"file://{at}", rows


def brute(spark, at, rows):
    """The rows that reach the last stage, and the ids each has."""
    labels = spark.read.parquet(f"{at}/labels.parquet").where(~toxicity.held_out())
    sample = toxicity.training_rows(spark.read.parquet(f"{at}/documents.parquet"), labels)
    lexicon = toxicity.learn_lexicon(sample)
    m = toxicity.Matcher(lexicon, toxicity.learn_exceptions(sample, lexicon))
    docs = [(i, t or "") for i, t, *_ in rows if m.score(t or "") < 0.5]
    seen, kept = set(), []
    for i, t in docs:
        ls, gone = t.split("\n"), set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            gone |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
        if not gone or len(gone) < len(ls):
            kept.append((i, "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    sets = {}
    for i, t in kept:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    lead = {i: i for i, _ in kept}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and lead[a] != lead[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    lead[a] = lead[b] = min(lead[a], lead[b])
                    changed = True
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return {i: np.array(lib.encode_ordinary(t), "<u4").tobytes() for i, t in kept if lead[i] == i}


def test_pipeline(spark, corpus):
    at, rows = corpus
    want = brute(spark, at, rows)
    out = corpus_pipeline.run(spark, at).collect()
    copies = Counter(r.doc_id for r in out)
    assert set(copies) == set(want) and all(bytes(r.ids) == want[r.doc_id] and r.n_tokens * 4 == len(r.ids) for r in out)
    assert not set(copies) & {i for i in range(160) if i % 8 == 0} and 0 < len(want) < len(rows)
    source = {r[0]: r[3] for r in rows}
    by = defaultdict(set)
    for i, n in copies.items():
        by[source[i]].add(n)
    assert by["big"] == {1} and max(max(n) for n in by.values()) == 2


def test_stages_keep_columns(spark, corpus):
    at, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns, name
        assert stage(spark, docs.limit(0), at).count() == 0, name


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert set(e.oracle_sql()) <= names


def test_cut_frees_the_driver(spark):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    blocks = spark.sparkContext._gateway.new_array(spark._jvm.byte, 1024, 1 << 18)
    spark._jvm.java.lang.System.gc()  # now they are old, which short collections pass over
    before = used()
    del blocks
    gc.collect()
    assert cut(spark.range(10)).count() == 10
    assert used() < before - 200
