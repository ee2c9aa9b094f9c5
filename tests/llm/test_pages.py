import hashlib
import itertools
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketloom.llm import url_rules, warc
from marketloom.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"https://{'abc'[i % 3]}.Site{i % 5}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'fr', 'de', 'es')[i % 4]}/{i}?ref=x#t", f"<p>{i // 2}</p>") for i in range(80)]
    return [*out, (100, None, None), (101, "", ""), (102, "no scheme", "<p>1</p>"), (103, "http://org", "é" * 300_000), (104, "http://EXAMPLE.org/en/12?x", "é" * 300_000), (None, "http://x.com/de/1", "<p>1</p>"), (None, "x://y.com/fr/a b\nc", "only"), (5, out[5][1], out[5][2])]


def test_warc_round_trip(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sha", F.lit(1)).withColumn("k", F.lit(2))
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    index = warc.write_bundles(df, folder, frame_bytes=4000, bundle_bytes=3000)
    out = warc.resolve(warc.read_records(index, folder)).collect()
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((x for x in groups[h or ""] if x is not None), default=None)
        same = first is None or i == first
        want[(i, len(b), warc.sha1_base32(b), "response" if same else "revisit", None if same else first)] += 1
    assert Counter(map(tuple, out)) == want
    frames = index.select("bundle", "frame").distinct().count()
    assert 1 < warc.read_records(index, folder, task_frames=2).rdd.getNumPartitions() <= frames  # not merged into one task
    one = warc.read_records(index.where("page_id = 103"), folder).first()
    assert bytes(one.payload).decode() == "é" * 300_000
    none = warc.write_bundles(df.limit(0), f"{folder}-none")
    assert warc.resolve(warc.read_records(none, f"{folder}-none")).count() == 0


def test_warc_streams_whole(spark, rows, tmp_path):
    import zstandard

    folder = f"file://{tmp_path}"
    index = warc.write_bundles(spark.createDataFrame(rows, SCHEMA), folder, frame_bytes=2000)
    assert index.select("bundle", "frame").distinct().count() > 1
    text = b"".join(zstandard.ZstdDecompressor().stream_reader(p.open("rb"), read_across_frames=True).read() for p in (tmp_path / "bundles").glob("*.zst"))
    assert text.count(b"WARC/1.1\r\n") == len(rows) and hashlib.sha1(text).digest()


def test_warc_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], SCHEMA)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    out = {r.page_id: r.record_type for r in warc.resolve(warc.read_records(warc.write_bundles(df, folder, min_payload=3), folder)).collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def brute_host_path(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def test_url_rules(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("h")).withColumn("verdict", F.lit(1))
    out = url_rules.judge_urls(df, min_support=0.05).collect()
    want = Counter()
    for i, url, _ in rows:
        host, path = brute_host_path(url)
        fit = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[(i, host, path, *max(fit, key=lambda x: len(x[0]), default=(None, None)))] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in out) == want
    assert {r.verdict for r in out} <= {"allow", "block"}
    assert url_rules.judge_urls(df.limit(0)).count() == 0


def test_mined_rules_match_brute_force(spark):
    import itertools

    data = [(["a", "b"], "block")] * 6 + [(["a", "c"], "allow")] * 5 + [(["b", "c"], "block")] * 3 + [(["a"], "block")] + [(["d"], None)]
    mined = url_rules.mine_rules(spark.createDataFrame(data, "tokens array<string>, verdict string"), min_support=0.1, min_confidence=0.6)
    best = {}
    labelled = [(set(t), v) for t, v in data if v]
    for n in (1, 2):
        for part in itertools.combinations("abcd", n):
            hit = [v for t, v in labelled if set(part) <= t]
            for v in set(hit):
                if hit.count(v) / len(labelled) >= 0.1 and hit.count(v) / len(hit) >= 0.6:
                    best[part, v] = hit.count(v) / len(hit)
    want = {k for k, c in best.items() if not any(best.get((p, k[1]), 0) >= c for p in itertools.combinations(k[0], len(k[0]) - 1) if p)}
    assert {(tuple(r.tokens), r.verdict) for r in mined.collect()} == want
    rows = spark.createDataFrame([(["a", "c", "x"],), (["b"],), (["z"],)], "tokens array<string>")
    got = {tuple(r.tokens): r.verdict for r in url_rules.match_rules(rows, mined).collect()}
    assert got == {("a", "c", "x"): "allow", ("b",): "block"}


def test_many_common_tokens(spark):
    import time

    rng = random.Random(4)
    same = [f"k{i}" for i in range(30)]  # in the very same rows
    data = [(["d", *same], "block") if i % 2 else (["d"], "allow") for i in range(400)]
    schema = "tokens array<string>, verdict string"
    mined = url_rules.mine_rules(spark.createDataFrame(data, schema))
    assert [(r.tokens, r.needs, r.verdict, r.confidence, r.support) for r in mined.collect()] == [(["k0"], [sorted(same)], "block", 1.0, 0.5)]
    got = url_rules.match_rules(spark.createDataFrame([(["k17", "x"],), (["d"],), ([],), (None,)], "tokens array<string>"), mined).collect()
    assert [(r.tokens, r.verdict) for r in got] == [(["k17", "x"], "block")]
    noise = [(sorted(f"k{i}" for i in range(30) if rng.random() < 0.5), rng.choice(["allow", "block"])) for _ in range(400)]
    began = time.monotonic()
    rules = url_rules.mine_rules(spark.createDataFrame(noise, schema), min_support=0.02).collect()
    assert time.monotonic() - began < 60 and rules
    for r in rng.sample(rules, min(200, len(rules))):  # counts are those of whole rows
        hit = [v for t, v in noise if set(r.tokens) <= set(t)]
        assert r.confidence == hit.count(r.verdict) / len(hit) and r.support == hit.count(r.verdict) / 400


def test_rules_of_frequent_items(spark):
    # Rows of 12 items that imply nothing alone; the verdict hangs on the two that most rows have, p and q: not the rarest of a row.
    rng = random.Random(5)
    data = []
    for i in range(640):
        few = rng.sample([f"r{j}" for j in range(24)], 10)
        both = [t for t in "pq" if rng.random() < 0.7]
        data.append((sorted(few + both), "block" if len(both) == 2 else "allow"))
    mined = url_rules.mine_rules(spark.createDataFrame(data, "tokens array<string>, verdict string"), min_support=0.1)
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in mined.collect()}
    hit = [v for t, v in data if {"p", "q"} <= set(t)]
    assert got[("p", "q"), "block"] == (1.0, len(hit) / 640)
    want = {}
    items = sorted({t for ts, _ in data for t in ts})
    for n in (1, 2, 3, 4):
        for part in itertools.combinations(items, n):
            hit = [v for t, v in data if set(part) <= set(t)]
            for v in set(hit):
                if hit.count(v) / 640 >= 0.1 and hit.count(v) / len(hit) >= 0.7:
                    want[part, v] = hit.count(v) / len(hit)
    unbeaten = {k for k, c in want.items() if not any(want.get((p, k[1]), 0) >= c for p in itertools.combinations(k[0], len(k[0]) - 1) if p)}
    assert {k for k in got if len(k[0]) <= 4} == unbeaten and got.keys() >= unbeaten


def test_long_url_tokens(spark):
    long = "a" * 70
    urls = [f"http://x.com/{long}b", f"http://x.com/{long}c", f"http://x.com/{'a' * 64}", "http://x.com/q?" + "&".join(f"k{chr(97 + i)}{'z' * 80}=1" for i in range(26))]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r.t for r in df.select(url_rules.url_tokens(F.col("url"), url_rules.url_host(F.col("url")), url_rules.url_path(F.col("url"))).alias("t")).collect()]
    assert got[0] != got[1] and len({t for t in got[0] if t.startswith("path:")} & set(got[1])) == 0
    assert f"path:1={'a' * 64}" in got[2] and len([t for t in got[3] if t.startswith("key:")]) == 26 and max(map(len, sum(got, []))) < 120
