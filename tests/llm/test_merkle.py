"""The Merkle manifest against a plain fold of lists."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from panelkit.llm import merkle, queries
from tests.llm.conftest import prose


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def record(*values) -> str:
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return digest("".join(parts))


def fold(leaves):
    """The root over some leaves, and for each the siblings before and after it, level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            path.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        at = [i // 3 for i in at]
        level = [digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def manifest(rows):
    """``(key, leaf, subroot, root, path)`` of rows ``(key, source, lang, n_chars, text)``."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0], record(*row)))
    order = lambda k: (k is not None, (k or "").encode())
    names = sorted(groups, key=order)
    tops = {}
    for name in names:
        groups[name].sort(key=lambda kv: (kv[0] is not None, kv[0] or 0, kv[1]))
        tops[name] = fold([leaf for _, leaf in groups[name]])
    root, upper = fold([tops[name][0] for name in names])
    return [
        (k, leaf, tops[name][0], root, path + above)
        for name, above in zip(names, upper, strict=True)
        for (k, leaf), path in zip(groups[name], tops[name][1], strict=True)
    ]


def seen(r):
    return r["doc_id"], r["leaf"], r["subroot"], r["root"], list(zip(r["lefts"], r["rights"], strict=True))


def test_manifest_of_tricky_rows(documents, tricky):
    docs = documents(tricky)
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    got = merkle.merkle_manifest(docs.repartition(5)).collect()
    assert sorted(map(seen, got), key=str) == sorted(manifest(rows), key=str)


def test_groups_over_several_buckets(documents):
    # one group ends inside its fourth run of 729, one fills a run, one passes it by one, some are tiny
    sizes = {"a": 3 * 729 + 5, "b": 729, "c": 730, "d": 1, None: 2, "e": 27, "ü": 4}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k * 7919 % 10_007, f"line {k}\nend", source))
            k += 1
    docs = documents(rows)
    plain = [(i, s, "en", len(t), t) for i, t, s in rows]
    got = {r["doc_id"]: seen(r) for r in merkle.merkle_manifest(docs).collect()}
    assert got == {e[0]: e for e in manifest(plain)}


def test_more_groups_than_a_bucket_holds(documents):
    rows = [(i, "t", f"s{i % 800}") for i in range(1000)]
    got = {r["doc_id"]: seen(r) for r in merkle.merkle_manifest(documents(rows)).collect()}
    assert got == {e[0]: e for e in manifest([(i, s, "en", 1, t) for i, t, s in rows])}


def test_one_row_and_no_row(documents):
    (one,) = merkle.merkle_manifest(documents([(7, None, None)])).collect()
    assert seen(one) == (7, record(7, None, "en", None, None), *[record(7, None, "en", None, None)] * 2, [])
    assert merkle.merkle_manifest(documents([])).collect() == []


def test_query_finds_tampered_texts(documents, tmp_path):
    rows = [(i, None if i % 9 == 0 else prose(i, 30) if i % 4 else "one line", f"s{i % 3}") for i in range(60)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark = documents(rows).sparkSession
    paths = {e[0]: e for e in manifest([(i, s, "en", None if t is None else len(t), t) for i, t, s in rows])}
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == 60
    for r in got:
        i, t, s = rows[r["doc_id"]]
        bad = zlib.crc32(str(i).encode()) % 2 == 0 and t is not None and "\n" in t
        assert r["verified"] == (not bad)
        _, leaf, subroot, root, path = paths[i]
        acc = record(i, s, "en", None if t is None else len(t), t.replace("\n", "") if bad else t)
        for a, b in path:
            acc = digest(a + acc + b)
        assert (r["leaf"], r["subroot"], r["root"], r["folded_root"]) == (leaf, subroot, root, acc)
        assert r["proof_sha256"] == digest("".join(a + b for a, b in path))


def test_fields_are_told_apart(spark):
    rows = spark.createDataFrame([("1:a", "b"), ("1", ":a1:b"), (None, "-"), ("-", None)], "a string, b string")
    digests = rows.select(merkle.record_digest([F.col("a"), F.col("b")])).distinct()
    assert digests.count() == 4
