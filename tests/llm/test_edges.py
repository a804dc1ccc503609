"""Missing values, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from panelkit.llm import cotraining, exact_dedup, jaccard, line_dedup, lm, mixing, packing, repetition, url_rules, warc
from panelkit.llm.components import connected_components
from panelkit.llm.prefix import running_totals
from tests.llm import brute
from tests.llm.conftest import changed, prose

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(documents, tricky):
    return documents(tricky)


@pytest.fixture(scope="module")
def nothing(documents):
    return documents([])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1 - i % 2, 0, 5) for i in range(1, 12)] + [(5, 0, 0, 5), (99, None, None, None), (None, 1, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, kept int")


def test_exact_duplicates(docs, tricky):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(tricky)
    groups = Counter(t or "" for _, t, _ in tricky)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == dict.fromkeys(by_digest, 1)
    for r in got:
        text = by_digest[r["text_sha256"]]
        keys = [i for i, t, _ in tricky if (t or "") == text]
        assert r["group_size"] == groups[text] == len(keys)
        assert r["keep_id"] == max((k for k in keys if k is not None), default=None)
    stay = exact_dedup.drop_exact_duplicates(docs)
    assert stay.columns == docs.columns
    rows = stay.collect()
    assert Counter(r["text"] or "" for r in rows) == dict.fromkeys(groups, 1)
    assert {r["doc_id"] for r in rows if r["text"] == prose(2, 90)} == {9}


def test_exact_duplicates_with_one_salt(docs):
    one = exact_dedup.exact_groups(docs, salts=1).collect()
    many = exact_dedup.exact_groups(docs.repartition(7), salts=5).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_a_million_rows_alike(spark):
    same = spark.range(1_000_000, numPartitions=4).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'' AS text", "id AS n")
    docs = same.unionByName(spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3)], "doc_id long, text string, n long"))
    got = exact_dedup.exact_duplicates(docs).groupBy("keep_id", "group_size", "kept").count().collect()
    expected = {(3, 1_000_001, True): 1, (3, 1_000_001, False): 1_000_000, (2, 2, True): 1, (2, 2, False): 1}
    assert {tuple(r)[:3]: r["count"] for r in got} == expected
    alone = exact_dedup.exact_duplicates(same).groupBy("keep_id", "group_size", "kept").count().collect()
    assert {tuple(r)[:3]: r["count"] for r in alone} == {(None, 1_000_000, True): 1, (None, 1_000_000, False): 999_999}
    stay = exact_dedup.drop_exact_duplicates(docs).collect()
    assert sorted(map(tuple, stay)) == [(2, "a", 2), (3, None, 3)]


@pytest.mark.parametrize("min_words", [1, 7, 50])
def test_repeated_lines(documents, min_words):
    shared = prose(7, 80, 9)
    rows = [
        (1, None), (2, ""), (3, "a b\n\n \nc d\na b\nc d"), (4, "x " * 60 + "\ny\n" + "x " * 60), (5, prose(8, 100) + "\n" + shared),
        (6, shared + "\n" + prose(9, 40)), (7, prose(10, 30) + "\n\n" + shared.replace("\n", "\n\n") + "\nend"), (8, shared), (9, "b\nb\nb\nb"),
        (10, prose(8, 100)), (11, "\n".join(["same line of six words here"] * 40)),
    ]
    got = line_dedup.repeated_lines(documents(rows), min_words=min_words).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in got} == brute.removed_lines(dict(rows), min_words)
    assert {r["doc_id"]: r["n_lines"] for r in got} == {k: len((t or "").split("\n")) for k, t in rows}


def test_repeated_lines_of_tricky_rows(docs, tricky):
    got = line_dedup.repeated_lines(docs).collect()
    assert len(got) == len({(i, t or "") for i, t, _ in tricky})
    clean = line_dedup.drop_repeated_lines(docs)
    assert clean.columns == docs.columns and clean.count() == len(tricky)
    by_key = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by_key[1] is None and by_key[7] == "" and by_key[6] == tricky[5][1]
    assert "Python" not in clean._jdf.queryExecution().toString()


def test_mixing(docs, tricky):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(tricky)
    sizes = Counter()
    for _, t, s in tricky:
        sizes[s] += len(brute.words(t))
    targets = brute.targets(sizes, 1.5 * sum(sizes.values()))
    for s, n in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == n and abs(r["target"] - targets[s]) < 1e-6 for r in own)
        assert sum(r["taken"] for r in own) == int(targets[s] + 1e-6)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns
    times = Counter((r["doc_id"], r["text"]) for r in again.collect())
    assert all(n <= 4 for n in times.values())  # two rows repeat key and text
    assert all(brute.words(t) for _, t in times)


def test_fill_targets_limits():
    sizes, weights = {"a": 10, "b": 100, "c": 0, "d": 1000}, {"a": 3.0, "b": 1.0, "c": 2.0, "d": 3.0}
    got = mixing.fill_targets(sizes, weights, 1665.0, 2.0)
    assert got == {"a": 20.0, "b": 200.0, "c": 0.0, "d": 1445.0}
    assert mixing.cycled_weights(["b", None, "a", "é"]) == {"a": 3.0, "b": 1.0, "é": 2.0, None: 3.0}


def test_running_totals(spark):
    rows = [(g, k, v) for g in ("a", None, "b") for k, v in [(3, 5), (1, None), (2, 7), (1, 2), (9, 0)] * 30]
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(5)
    got = running_totals(df, ["g"], ["k", "v"], "v", "before").collect()
    for g in ("a", None, "b"):
        own = sorted((r["before"], r["k"], r["v"] or 0) for r in got if r["g"] == g)
        total = 0
        for before, _, v in sorted(own, key=lambda r: (r[1], r[0], r[2])):
            assert before == total
            total += v


def test_quality_rules(docs, tricky):
    got = repetition.repetition_rules(docs).collect()
    assert len(got) == len(tricky)
    expected = Counter((i, *brute.quality(t).values()) for i, t, _ in tricky)
    names = list(brute.quality(""))
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == expected


def test_coverage_rejects_repeated_passages_only(documents):
    rows = [(1, prose(1, 400)), (2, prose(2, 100) + "\n" + prose(3, 30) + "\n" + prose(4, 20) + "\n" + prose(3, 30))]
    rows += [(3, prose(5, 200) + "\n" + prose(5, 200, 13)), (4, "ok line with words\n" * 30)]
    got = {r["doc_id"]: r["kept"] for r in repetition.repetition_rules(documents(rows)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_packing(docs, tricky):
    got = packing.pack_documents(docs, TOKENIZER, capacity=64, with_ids=True).toPandas()
    brute.check_places(got, 64)
    assert (got.ids.map(len) == got.length).all()
    whole = got.sort_values("start").groupby(["sequence_id", "offset"]).length.sum()
    assert whole.sum() == got.length.sum()
    assert (got[got.length < 64].groupby("doc_id", dropna=False).size() <= 2).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 2


def test_classifier(docs, labels, tricky):
    got = cotraining.quality_scores(docs, labels).collect()
    assert len(got) == len(tricky) and all(0 <= r["score"] <= 1 for r in got)
    kept = Counter((r["doc_id"]) for r in got if r["kept"])
    stay = cotraining.keep_good(docs, labels)
    assert stay.columns == docs.columns
    assert Counter(r["doc_id"] for r in stay.collect()) == kept
    free = cotraining.quality_scores(docs, labels.where("quality > 5")).collect()
    assert all(r["score"] == 0.5 and r["kept"] for r in free)


def test_lm(docs, tricky, monkeypatch):
    got = lm.lm_scores(docs, TOKENIZER, order=3, block_bytes=10_000).collect()
    assert len(got) == len(tricky)
    assert all(r["n_tokens"] == 0 and r["log_score"] == 0 and r["mean_log_score"] is None for r in got if r["doc_id"] in (1, 2, 3))
    same = [(r["n_backoff"], round(r["log_score"], 9)) for r in got if r["doc_id"] in (8, 9)]
    assert len(same) == 3 and len(set(same)) == 1
    with pytest.raises(ValueError):
        lm.lm_scores(docs, TOKENIZER, order=4)
    monkeypatch.setattr(lm, "MAX_ID", 40_000)
    with pytest.raises(ValueError):
        lm.lm_scores(docs, TOKENIZER)


@pytest.mark.parametrize(("order", "min_count", "block_bytes"), [(1, 2, 100), (2, 1, 3000), (2, 3, 8 << 20), (3, 1, 100), (3, 2, 5000)])
def test_lm_orders(documents, order, min_count, block_bytes):
    texts = {i: prose(i % 5, 20 + i) for i in range(12)} | {20: "one", 21: "one two", 22: "", 23: None, 24: "one two"}
    got = lm.lm_scores(documents(list(texts.items())).repartition(3), TOKENIZER, order=order, min_count=min_count, block_bytes=block_bytes)
    exact = Tokenizer.from_file(TOKENIZER)
    ids = {i: exact.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    expected = brute.backoff(ids, order, 0.4, min_count)
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, back, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_backoff"]) == (n, back) and math.isclose(r["log_score"], score, rel_tol=1e-9, abs_tol=1e-9)


def test_lm_rows_alike_are_in_several_blocks(spark):
    # a third of a table may repeat key and text; no block grows with them
    same = spark.range(3000, numPartitions=2).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "repeat('some words ', 20) AS text")
    blocks = lm._blocks(same, TOKENIZER, "doc_id", "text", 100_000).selectExpr("size(_ids) AS n").collect()
    assert len(blocks) > 4 and max(r["n"] for r in blocks) <= 512
    got = lm.lm_scores(same, TOKENIZER, block_bytes=100_000).groupBy("n_tokens", "n_backoff").count().collect()
    assert [(r["n_tokens"], r["n_backoff"], r["count"]) for r in got] == [(40, 0, 3000)]


def test_grams_of_wide_vocabularies_are_sorted_alike():
    # with many distinct tokens a triple and its place need more than 64 bits
    import numpy as np

    tokens = np.random.default_rng(2).integers(1, 60_000, 90_000).astype(np.uint16)
    sizes = np.array([0, 50_000, 1, 2, 39_997, 0])
    grams = lm._Grams(sizes, tokens, 3)
    starts = np.setdiff1d(np.arange(90_000), np.cumsum(sizes) - 1)
    assert grams.starts.tolist() == starts.tolist()
    pairs = tokens[starts].astype(np.uint32) << np.uint32(16) | tokens[starts + 1]
    assert (grams.pairs[grams.pair_at] == pairs).all() and (np.diff(grams.pairs.astype(np.int64)) > 0).all()
    assert np.bincount(grams.triple_at).tolist() == grams.own.tolist() and grams.fan.sum() == len(grams.own)


def test_jaccard(docs, tricky, documents):
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(tricky)
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[8, 87] == by[9, 87] == 8 and by[7, len(brute.shingles(tricky[5][1], 4))] == 6
    assert by[1, 0] == 1 and by[2, 0] == 2 and by[None, 0] is None and by[None, 57] is None
    assert {r["component_id"] for r in got if r["doc_id"] in (10, 11)} == {10}
    stay = jaccard.drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    kept = Counter(r["doc_id"] for r in stay.collect())
    assert (kept[6], kept[7], kept[8], kept[9], kept[10], kept[11], kept[5]) == (1, 0, 1, 0, 1, 0, 2)


def test_jaccard_blocks(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows, doc = [], 0
    for group in range(6):
        base = prose(100 + group, 120)
        for k in range((40, 3, 1, 25, 2, 60)[group]):
            rows.append((doc * 7 % 1009, changed(base, doc, (0.0, 0.01, 0.02, 0.03)[k % 4])))
            doc += 1
    got = jaccard.jaccard_components(documents(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(dict(rows), 4, 85, 100)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(400 - i, 401) for i in range(30)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {i: 371 for i in [*range(371, 401), 401]}
    assert got == expected


URLS = [
    (1, "http://WWW.Example.com/en/1?x"), (2, "https://example.com/en/"), (3, "http://a.b.example.com/en/x"), (4, "http://net/es/"),
    (5, "http://xnet/es/"), (6, "http://a.net/fr"), (7, "http://a.net/fr/é\n"), (8, None), (9, "no scheme"), (10, ""),
    (11, "http://a.com"), (12, "http://a.com#/"), (None, "ftp://b.com/"), (13, "x://y://com/"), (13, "x://y://com/"), (14, "http://a.com:80/"),
]


def test_url_rules(spark):
    rules = [
        url_rules.Rule("allow", "com", "/"), url_rules.Rule("block", "example.com", "/en/"), url_rules.Rule("allow", "www.example.com", "/en/"),
        url_rules.Rule("block", "net", "/es/"), url_rules.Rule("block", "net", "/fr"), url_rules.Rule("block", "é", "/"), url_rules.Rule("block", "b.com", ""),
    ]
    pages = spark.createDataFrame([(*r, "c", 1) for r in URLS], "page_id long, url string, host string, rule int")
    got = url_rules.judge_urls(pages, rules, default="block").collect()
    assert len(got) == len(URLS)

    def judged(url):
        host, path = url_rules.split_url(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return (host, path, best and best.name, best.verdict if best else "block")

    assert Counter(tuple(r)[:5] for r in got) == Counter((k, *judged(u)) for k, u in URLS)
    assert {r["page_id"]: r["rule"] for r in got}[7] == "net/fr" and max(r["n_candidates"] for r in got) < len(rules)
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, []).collect()} == {"allow"}


PAGES = [(5, "u5", "x" * 100), (3, "u3", "x" * 100), (4, "u4", "x" * 99), (6, "u6", "x" * 99), (7, None, None), (8, "a\r\nb", ""),
         (2, "u2", "é" * 50), (9, "u9", "é" * 50), (None, "n", "y" * 200), (10, "l", "z\r\n\r\n" * 60_000), (11, "l", "z\r\n\r\n" * 60_000)]


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300_000)
    pages = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id long, url string, html string, payload int").repartition(2)
    archives = warc.write_archives(pages, str(tmp_path))
    assert archives.count() == len(list(tmp_path.glob("*.warc.zst"))) >= 2
    got = {r["record_id"]: r for r in warc.read_archives(str(tmp_path), archives).collect()}
    assert len(got) == len(PAGES)
    for key, url, html in PAGES:
        r, body = got["" if key is None else str(key)], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert r["url"] == (url or "").replace("\r", "%0D").replace("\n", "%0A")
        first = {5: "3", 9: "2", 11: "10"}.get(key)
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if first else ("response", None))
        assert r["payload"] is None if first else bytes(r["payload"]) == body
    data = next(tmp_path.glob("*.warc.zst")).read_bytes()
    assert zstandard.FRAME_HEADER and data[:4] == b"\x5d\x2a\x4d\x18"
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_empty_tables(nothing, labels):
    frames = [
        exact_dedup.exact_duplicates(nothing), exact_dedup.drop_exact_duplicates(nothing), line_dedup.repeated_lines(nothing),
        line_dedup.drop_repeated_lines(nothing), mixing.mix_sources(nothing), mixing.mixed_documents(nothing),
        repetition.repetition_rules(nothing), packing.pack_documents(nothing, TOKENIZER), cotraining.quality_scores(nothing, labels),
        cotraining.keep_good(nothing, labels), lm.lm_scores(nothing, TOKENIZER), jaccard.jaccard_components(nothing),
        jaccard.drop_near_duplicates(nothing),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_link_block_skips_positions():
    import random

    import numpy as np

    r = random.Random(6)
    tokens = []
    for _ in range(30):
        base = r.sample(range(2000), r.randint(5, 200))
        for _ in range(r.randint(1, 4)):
            tokens.append(np.array(sorted({t if r.random() > 0.06 else r.randrange(2000) for t in base}), np.int64))
    r.shuffle(tokens)
    read: list[int] = []
    got = jaccard.link_block(tokens, 80, 100, read)
    root = list(range(len(tokens)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    whole = 0
    for i, a in enumerate(tokens):
        for j, b in enumerate(tokens):
            o = len(np.intersect1d(a, b))
            whole += o
            if i < j and 100 * o >= 80 * (len(a) + len(b) - o):
                root[find(i)] = find(j)
    names = {}
    for i, g in enumerate(got.tolist()):
        assert names.setdefault(find(i), g) == g
    assert len(set(got.tolist())) == len(names)
    # whole lists would hold every common member of every pair
    assert 0 < sum(read) < whole / 4


def test_urls_whose_hosts_hold_line_ends(spark):
    urls = ["http://a\nb.com/x", "http://com\n/x", "http://net/fr/\n", "http://a\n.net/fr/x", "http://xnet/fr/", "http://net\n/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_rules.Rule("allow", "com", "/"), url_rules.Rule("block", "net", "/fr/")]
    got = {r["page_id"]: (r["host"], r["rule"]) for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {0: ("a\nb.com", "com/"), 1: ("com\n", None), 2: ("net", "net/fr/"), 3: ("a\n.net", "net/fr/"), 4: ("xnet", None), 5: ("net\n", None)}


def test_rolling_hashes_equal_those_of_equal_windows():
    import numpy as np

    values = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rolling = repetition.RollingHashes(values)
    for n in (1, 2, 5, 10, 400):
        windows = [tuple(values[i : i + n].tolist()) for i in range(400 - n + 1)]
        names = rolling.windows(n).tolist()
        assert len(names) == len(windows) and len(set(zip(windows, names, strict=True))) == len(set(windows)) == len(set(names))
    assert len(rolling.windows(401)) == 0 and len(repetition.RollingHashes(values[:0]).windows(1)) == 0


def test_columns_of_quality_rules(docs):
    named = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert repetition.repetition_rules(docs).columns[:8] == named


def test_archives_are_read_back_by_many_tasks(spark, tmp_path):
    pages = spark.range(300).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(string(id), 50) AS html")
    archives = warc.write_archives(pages.repartition(12), str(tmp_path / "w"), "page_id", "url", "html")
    records = warc.read_archives(str(tmp_path / "w"), archives)
    assert archives.count() > 4 and records.rdd.getNumPartitions() == archives.count()
    assert records.count() == 300
