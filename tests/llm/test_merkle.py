"""The Merkle manifest against a plain recursive build; proofs and tampering."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def around(levels_, at, fanout):
    for row in levels_[:-1]:
        low = at - at % fanout
        yield row[low:at], row[at + 1 : low + fanout]
        at //= fanout


def brute(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    sets = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in order}
    trees = {s: levels([leaf(r, r[4]) for r in sets[s]], fanout) for s in order}
    top = levels([trees[s][-1][0] for s in order], fanout)
    for k, s in enumerate(order):
        for i, r in enumerate(sets[s]):
            path = [*around(trees[s], i, fanout), *around(top, k, fanout)]
            change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = leaf(r, r[4].translate(LOWER) if change else r[4])
            for b, a in path:
                h = H("".join([*b, h, *a]))
            yield (r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], H("".join("".join(b + a) for b, a in path)), h)


def mine(docs, fanout):
    m = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, fanout)
    return m.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")),
                    merkle.folded(F.coalesce("other", "leaf"), F.col("path")))


def rows(n):
    out = [(i, "hot" if i < n * 2 // 3 else None if i < n * 2 // 3 + 2 else f"é{i % 21}", None if i % 7 == 0 else "en",
            i if i % 2 else None, None if i % 5 == 1 else f"Text É {i}") for i in range(n)]
    return out + [(None, "hot", "en", 1, "Q"), (None, "hot", "en", 1, "Q"), (5, "solo", "en", 1, "Z"), (5, "hot", None, 1, ""),
                  (5, "hot", None, 1, ""), (6, "", "", 0, ""), (7, "hot", "de", 9, "A" * 200_000)]


@pytest.mark.parametrize("n, fanout", [(300, 16), (60, 2), (20, 3)])
def test_equals_a_plain_build(spark, n, fanout):
    data = rows(n)
    docs = spark.createDataFrame(data, SCHEMA).withColumn("tree", F.lit("x")).withColumn("node", F.lit(1))
    got = sorted(map(tuple, mine(docs.repartition(5), fanout).collect()), key=repr)
    assert got == sorted(brute(data, fanout), key=repr)
    assert 0 < sum(r[5] == r[3] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    data = [(3, "a", "en", 1, "Xy"), (4, "b", "en", 1, "Xy")][:n]
    assert sorted(map(tuple, mine(spark.createDataFrame(data, SCHEMA), 16).collect())) == sorted(brute(data, 16))


def test_partitions_do_not_matter(spark):
    docs = spark.createDataFrame(rows(80), SCHEMA)
    key = lambda p: sorted(map(tuple, mine(docs.repartition(p), 4).collect()), key=repr)
    assert key(1) == key(9)
