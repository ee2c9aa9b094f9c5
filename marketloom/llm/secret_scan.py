"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions near its hits, checksum validation.

One automaton holds the keywords of every kind. A text is walked once; where a keyword ends, that kind's expression is
matched at the keyword's start and nowhere else. Runs of hexadecimal digits have no keyword; they are found by one
possessive expression. Tokens of kinds with an embedded checksum count only if it fits.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import LOWER, UPPER, read

BASE62 = "0123456789" + UPPER + LOWER


def _crc62(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62 with leading zeros."""
    body, check = m[1][:-6], m[1][-6:]
    n, digits = binascii.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == check


def _jwt(m: re.Match) -> bool:
    """The first part is base64url of a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


#: kind, keywords in lower case, expression anchored at the keyword's start, test of the match. The base kinds come first.
Rule = tuple[str, tuple[str, ...], str, Callable[[re.Match], bool]]
BASE: tuple[Rule, ...] = (
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 12),
    ("access", ("akia",), r"(AKIA[A-Z0-9]+)", lambda m: len(m[1]) >= 18),
)
HEX = re.compile(r"[0-9a-f]{16,}+")
ADDED: tuple[Rule, ...] = (
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])", _crc62),
    ("npm", ("npm_",), r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])", _crc62),
    ("jwt", ("eyj",), r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _jwt),
    ("pem", ("-----begin ",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", lambda m: True),
)
KINDS = ("assign", "access", "hex", *(r[0] for r in ADDED))


@cache
def _automaton():
    import ahocorasick

    a, rules = ahocorasick.Automaton(), [(kind, re.compile(rx), test) for kind, _, rx, test in (*BASE, *ADDED)]
    for n, (_, words, _, _) in enumerate((*BASE, *ADDED)):
        for w in words:
            a.add_word(w, (n, len(w)))
    a.make_automaton()
    return a, rules


_FOLD = str.maketrans(UPPER, LOWER)


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind as listed; positions are code points."""
    a, rules = _automaton()
    lower = text.lower() if text.isascii() else text.translate(_FOLD)  # one character for one
    hits: list[list[int]] = [[] for _ in rules]
    for end, (n, size) in a.iter(lower):
        hits[n].append(end - size + 1)
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for (kind, rx, test), starts in zip(rules, hits, strict=True):
        at = 0
        for s in sorted(starts):
            if s >= at and (m := rx.match(text, s)):
                at = m.end()  # leftmost, non-overlapping: a match that fails its test still takes its place
                if test(m):
                    found.append((s, at, kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col and `secrets`, an array of (start, end, kind, value) over the whole text.

    Null and empty texts have none; a null id is carried along; repeated rows are scanned alike. Other columns are not
    read. Rows do not depend on each other: there is no shuffle.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["t"].tolist()
            pdf["secrets"] = [[{"start": s, "end": e, "kind": k, "value": t[s:e]} for s, e, k in find_secrets(t)] for t in texts]
            yield pdf[[id_col, "secrets"]]

    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(scan, f"`{id_col}` {id_type}, secrets array<struct<start:int,`end`:int,kind:string,value:string>>")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    spans = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("secrets")).alias("spans"))


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLE_SQL: dict[str, str] = {}
