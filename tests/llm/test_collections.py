"""Operators over the whole collection: passages, leaks, shards, packing, near copies, urls, and the pipeline."""

import hashlib
import os
import zlib

import brute
import numpy as np
import pytest
from samples import edge_texts
from pyspark.sql import functions as F

from palimpsest.llm import common, decontaminate, jaccard_join, packing, queries, sharding, substring_dedup, url_rules
from palimpsest.llm.tokens import ChunkEncoder
from palimpsest.llm.words import Spans, WordHashes, sliding_min


def digests(rows):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)


def want_kept(docs):
    return sorted((-1 if d is None else d, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, w, k in brute.kept_words(docs))


# --- op2 ---------------------------------------------------------------------------------


def test_op2_on_whole_documents(spark, data, texts):
    assert digests(queries.op2_repeated_phrases(spark, data).collect()) == want_kept(texts)


def test_op2_edges(with_null_id, none):
    rows = [tuple(r) for r in with_null_id.select("doc_id", "text").collect()]
    assert digests(substring_dedup.deduplicated(with_null_id).collect()) == want_kept(rows)
    assert substring_dedup.deduplicated(none).count() == 0


def test_op2_slabs_and_blocks_do_not_matter(spark, edge, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 20_000)
    assert digests(substring_dedup.deduplicated(edge).collect()) == want_kept([tuple(r) for r in edge.select("doc_id", "text").collect()])
    assert list(substring_dedup.slabs(130, slab=30)) == [(0, 79), (30, 109), (60, 130)]
    assert not list(substring_dedup.slabs(49))


def test_automaton_finds_every_occurrence():
    words, hashes, spans = [b"%d" % (n % 13) for n in range(400)], WordHashes(), Spans()
    of = hashes.of(words)
    codes, phrases = substring_dedup.word_codes(of), spans.windows(of, substring_dedup.PHRASE)
    machine = substring_dedup.automaton_of({codes[k : k + 8] for k in (0, 5)})
    found = [end - 7 for end, _ in machine.iter(codes)]
    assert found == [k for k in range(393) if words[k : k + 8] in (words[0:8], words[5:13])]
    known = np.sort(phrases[[0, 5]])
    assert np.flatnonzero(substring_dedup.among(phrases, known)).tolist() == found


def test_op2_words_of_equal_codes_do_no_harm(spark, monkeypatch):
    """Four codes for all words, and many blocks: unequal phrases share their codes everywhere."""
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 2_000)
    monkeypatch.setattr(substring_dedup, "word_codes", lambda hashes: "".join("abcd"[int(h) % 4] for h in hashes))
    rng = np.random.default_rng(5)
    passages = [[f"w{n}" for n in rng.integers(0, 400, 90)] for _ in range(12)]
    rows = []
    for d in range(150):
        own = [f"w{n}" for n in rng.integers(0, 400, 60)]
        a, b = passages[d % 12], passages[(d * 5 + 1) % 12]
        rows.append((d, " ".join(own[:30] + a[: 50 + d % 40] + own[30:] + b[d % 30 :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(substring_dedup.deduplicated(docs).collect()) == want_kept(rows)


def test_span_hashes_and_minima():
    values = np.arange(40, dtype=np.uint64) % np.uint64(7)
    spans = Spans()
    windows = spans.windows(values, 5)
    assert all((windows[a] == windows[b]) == (values[a : a + 5].tolist() == values[b : b + 5].tolist()) for a in range(36) for b in range(36))
    assert sliding_min(values, 6).tolist() == [min(values[k : k + 6]) for k in range(35)]


# --- op3 ---------------------------------------------------------------------------------


def test_op3_on_whole_documents(spark, data, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["united"]) for r in queries.op3_simhash_decontamination(spark, data).collect()}
    assert got == brute.leaks(texts, items) and got


def test_op3_edges(spark, with_null_id, none):
    prose = dict(edge_texts())[1].split()
    items = spark.createDataFrame([(1, " ".join(prose[50:90])), (2, " ".join(prose[50:90])), (3, None), (4, ""), (5, "one two three"), (6, "word " * 12), (7, " ".join(prose[0:30] + ["changed"] + prose[31:60]))], "item_id long, text string")
    rows = [(d, t) for d, t in with_null_id.select("doc_id", "text").collect() if d is not None]
    want = brute.leaks(rows, [tuple(r) for r in items.collect()])
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["united"]) for r in decontaminate.leaks(with_null_id, items).collect()}
    assert got == want and {(5, 5), (6, 5), (10, 6), (1, 1), (1, 2)} <= set(got)
    clashing = items.selectExpr("item_id", "text", "1 as doc_id", "'a' as shingle", "2 as mass", "3 as n", "4 as item")
    assert {(r["doc_id"], r["item_id"]): (r["shared"], r["united"]) for r in decontaminate.leaks(with_null_id, clashing).collect()} == want
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(with_null_id, items.where("false")).count() == 0


def test_op3_items_cut_at_the_edges_of_a_text(spark):
    item = [f"i{n}" for n in range(40)]
    lead, tail = [f"a{n}" for n in range(50)], [f"b{n}" for n in range(50)]
    cut = {1: item[1:] + tail, 2: lead + item[:-1], 3: item[3:] + tail, 4: lead + item[:-3], 5: lead + item + tail, 6: item[15:] + tail}
    rows = [(d, " ".join(w)) for d, w in cut.items()]
    items = [(1, " ".join(item))]
    whole = [(7, " ".join(item[1:])), (8, " ".join(item[2:-1])), (9, " ".join(item[:20]))]
    docs = spark.createDataFrame(rows + whole, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["united"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == brute.leaks(rows + whole, items) and {d for d, _ in got} == {1, 2, 3, 4, 5}
    shorter = {(r["doc_id"], r["item_id"]): (r["shared"], r["united"]) for r in decontaminate.leaks(docs, benchmark, shorter=True).collect()}
    assert shorter == got | {(7, 1): (35, 36), (8, 1): (33, 36)}


def test_op3_reordered_and_cut_passages(spark):
    """Against all windows: halves and quarters that changed places, words changed, cuts at both edges, and items that share phrases."""
    rng = np.random.default_rng(11)
    phrase = ["choose", "the", "right", "answer", "from", "this", "list"]
    items = [(k, phrase + [f"i{n}" for n in rng.integers(0, 150, int(rng.integers(30, 70)))]) for k in range(12)]
    docs = []
    for d in range(240):
        words = list(items[d % 12][1])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"x{d}"
        if d % 4 == 1:
            cut = int(rng.integers(1, len(words)))
            words = words[cut:] + words[:cut]
        elif d % 4 == 2:
            words = words[int(rng.integers(0, 6)) : len(words) - int(rng.integers(0, 6))]
        lead, tail = ([f"{s}{d}.{n}" for n in range(int(rng.integers(0, 3)) * 20)] for s in "lt")
        docs.append((d, " ".join(lead + words + tail)))
    benchmark = [(k, " ".join(w)) for k, w in items]
    want = brute.leaks(docs, benchmark)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["united"]) for r in decontaminate.leaks(*frames).collect()}
    assert {k: v for k, v in got.items() if k not in want} == {} and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.99 * len(want) and len(want) > 60
    assert {d % 4 for d, _ in want} == {0, 1, 2, 3}


def test_op3_takes_a_large_benchmark_in_passes(spark, data, texts, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 300)
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["united"]) for r in queries.op3_simhash_decontamination(spark, data).collect()}
    assert got == brute.leaks(texts, items) and got


def test_blocks_guarantee_the_radius(spark):
    rng = np.random.default_rng(0)
    one = rng.integers(-(2**62), 2**62, 60)
    flips = [rng.choice(64, rng.integers(0, decontaminate.RADIUS + 1), replace=False) for _ in one]
    rows = [(n, int(a), int(np.int64(a) ^ np.bitwise_xor.reduce((np.uint64(1) << f.astype(np.uint64)), initial=np.uint64(0)).view(np.int64))) for n, (a, f) in enumerate(zip(one, flips))]
    df = spark.createDataFrame(rows, "item long, fingerprint long, other long")
    index = decontaminate.item_index(df)
    parts = F.array(*(F.struct(F.lit(k).alias("block"), decontaminate.block(F.col("other"), k).alias("value")) for k in range(decontaminate.BLOCKS)))
    asked = df.select("item", F.explode(parts).alias("e")).select("item", "e.block", "e.value")
    assert asked.join(index, ["item", "block", "value"]).select("item").distinct().count() == len(rows)


# --- op5 ---------------------------------------------------------------------------------


def check_shards(rows, n, shards=8):
    assert len(rows) == n
    counts = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_op5_on_whole_documents(spark, data, texts):
    rows = queries.op5_label_propagation_sharding(spark, data).collect()
    check_shards(rows, len(texts))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts)
    by_text, shard = {}, {r["doc_id"]: r["shard"] for r in rows}
    for d, t in texts:
        by_text.setdefault(t, []).append(shard[d])
    copies = [s for s in by_text.values() if len(s) > 1]
    assert sum(len(set(s)) > 1 for s in copies) <= 0.2 * len(copies)


def test_op5_splits_a_hot_group_evenly(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "same").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 2))).alias("text"))
    rows = sharding.balanced_shards(df).collect()
    check_shards(rows, 400)
    assert len({r["shard"] for r in rows if r["doc_id"] < 200}) <= 6


def test_op5_cuts_little_more_than_the_best(spark):
    """Links that are cut, against the fewest that equal shards allow: hubs of 2 to 30 copies could all stay whole."""
    rng = np.random.default_rng(4)
    sizes = [int(n) for n in rng.integers(2, 31, 60)]
    rows = [(f"text {h}",) for h, n in enumerate(sizes) for _ in range(n)] + [(f"alone {n}",) for n in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(n, t[0]) for n, t in enumerate(rows)], "doc_id long, text string")
    placed = sharding.balanced_shards(df)
    check_shards(placed.collect(), len(rows))
    shares = {}
    for r in placed.where("linked").groupBy("hub", "shard").count().collect():
        shares.setdefault(r["hub"], []).append(r["count"])
    links = sum(n * (n - 1) // 2 for n in sizes)
    cut = links - sum(c * (c - 1) // 2 for s in shares.values() for c in s)
    by_chance = links * 7 / 8
    assert cut <= 0.02 * by_chance
    assert {r["hub"]: r["shards"] for r in sharding.cut_links(placed).collect()} == {h: len(s) for h, s in shares.items()}


def test_op5_buckets_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    df = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") < 200, "same").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 2))).alias("text"))
    check_shards(sharding.balanced_shards(df).collect(), 400)


def test_op5_edges(with_null_id, none):
    rows = sharding.balanced_shards(with_null_id).collect()
    check_shards(rows, with_null_id.count())
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert sharding.balanced_shards(none).count() == 0
    check_shards(sharding.balanced_shards(with_null_id.limit(3)).collect(), 3)


# --- op6 ---------------------------------------------------------------------------------


def check_packing(rows, texts, size=1024):
    encoder, end, of = ChunkEncoder(), (2).to_bytes(4, "little"), {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    for doc in {d for d, _ in texts}:
        mine = [t for d, t in texts if d == doc]
        ids = encoder.ids(mine[0] or "") + end
        n = len(ids) // 4
        got = sorted(of[doc], key=lambda r: r["piece"])
        if len(mine) == 1:
            assert [r["piece"] for r in got] == list(range(len(got))) and [r["length"] for r in got[1:]] == [size] * (len(got) - 1)
        assert sum(r["length"] for r in got) == n * len(mine) and (n > size or len(got) == len(mine))
        assert all(r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in got)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), -(-sum(r["length"] for r in rows) // size)


def test_op6_on_whole_documents(spark, data, texts):
    bins, least = check_packing(queries.op6_minimum_bin_slack(spark, data).collect(), texts)
    assert bins <= 1.02 * least + 1


def test_op6_parts_of_lengths_do_not_matter(spark, data, texts, monkeypatch):
    monkeypatch.setattr(packing, "PART_PIECES", 2)
    bins, least = check_packing(queries.op6_minimum_bin_slack(spark, data).collect(), texts)
    assert bins <= 1.02 * least + 1


def test_op6_edges(with_null_id, none):
    check_packing(packing.packed(with_null_id).collect(), [tuple(r) for r in with_null_id.select("doc_id", "text").collect()])
    assert packing.packed(none).count() == 0


def test_fullest_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 30, rng.integers(1, 7))}
        got = packing.fullest(counts, 30)
        top, sums = max(counts), {0}
        for n, c in counts.items():
            for _ in range(c - (n == top)):
                sums |= {s + n for s in sums if s + n <= 30 - top}
        assert sum(n * k for n, k in got.items()) == top + max(sums) and all(k <= counts[n] for n, k in got.items())
    for _ in range(40):  # a combination applied at once, and the search repeated for each bin, come to the same bins
        counts = {int(n): int(rng.integers(1, 30)) for n in rng.integers(1, 40, 8)}
        left, bins = dict(counts), []
        while left:
            one = packing.fullest(left, 40)
            bins.append(sorted(one.items()))
            left = {n: c - one.get(n, 0) for n, c in left.items() if c > one.get(n, 0)}
        assert sorted(sorted(c.items()) for c, t in packing.minimum_bin_slack(counts, 40) for _ in range(t)) == sorted(bins)
    plan = packing.minimum_bin_slack({600: 3, 424: 2, 100: 9, 1024: 2})
    assert sum(k * t for c, t in plan for n, k in c.items() if n == 100) == 9


# --- op7 ---------------------------------------------------------------------------------


def test_op7_on_whole_documents(spark, data, texts):
    rows = queries.op7_bayesian_jaccard(spark, data).collect()
    assert {r["doc_id"]: (r["class_id"], r["text_id"], r["links"]) for r in rows} == brute.jaccard_classes(texts)


def near_copies(spark, n=60):
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(n):
        w = list(base)
        for e in range(d % 5):
            w[(d * 7 + e * 31) % 120] = f"x{d}.{e}"
        rows.append((d, " ".join(w)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("cell, size", [(8, 8 << 20), (1024, 8 << 20), (1024, 4000)])
def test_op7_cells_lose_no_link(spark, monkeypatch, cell, size):
    monkeypatch.setattr(jaccard_join, "BUCKET_CELL", cell)
    monkeypatch.setattr(jaccard_join, "GROUP_CELL", cell)
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", size)
    rows, df = near_copies(spark)
    got = {r["doc_id"]: (r["class_id"], r["text_id"], r["links"]) for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == brute.jaccard_classes(rows) and max(v[2] for v in got.values()) > 10


def test_op7_edges(edge, with_null_id, none):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    want = brute.jaccard_classes(list(dict.fromkeys(rows)))
    got = [(r["doc_id"], (r["class_id"], r["text_id"], r["links"])) for r in jaccard_join.jaccard_classes(with_null_id).collect()]
    assert len(got) == len(rows) + 1 and all(v == want[d] for d, v in got if d is not None)
    assert dict(got)[None][0] == want[1][0] and want[2][0] == want[3][0] == 2
    assert jaccard_join.jaccard_classes(none).count() == 0


def test_pruning_is_a_posterior():
    limits = jaccard_join.least_matches()
    assert [n for n, _ in limits] == list(range(16, 129, 16))
    rng, (n, least) = np.random.default_rng(1), limits[-1]
    s = rng.random(400_000)
    m = rng.binomial(n, s)
    for count in (least + 6, least + 10):  # the share of pairs with so many matches that reach the threshold
        exact = (s[m == count] >= 0.8008).mean()
        t = 0.8 + 0.2 / 256
        from math import comb

        assert exact == pytest.approx(sum(comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(count + 1)), abs=0.02)


@pytest.mark.parametrize("n", [100, 300, 1000, 3000, 20_000])
def test_pruning_drops_unrelated_texts_of_any_length(n):
    rng, limits = np.random.default_rng(3), jaccard_join.least_matches()
    sigs = [np.frombuffer(jaccard_join.compared_bytes(jaccard_join.signature(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)))), dtype=np.uint8) for _ in range(20)]
    assert all(len(jaccard_join.survivors(sigs[k], np.stack(sigs[k + 1 :]), limits)) == 0 for k in range(19))
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    near = np.concatenate([base[: n - n // 20], rng.integers(0, 2**64, n // 20, dtype=np.uint64)])
    one, two = (np.frombuffer(jaccard_join.compared_bytes(jaccard_join.signature(np.unique(x))), dtype=np.uint8) for x in (base, near))
    assert len(jaccard_join.survivors(one, two[None, :], limits)) == 1


def test_components_of_a_long_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = common.components(links, "path").collect()
    assert len(rows) == 301 and {r["class_id"] for r in rows} == {0}


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB_LINKS", 20)
    star = spark.range(1, 200).select(F.lit(5000).cast("long").alias("a"), (F.col("id") * 3).alias("b"))
    rest = spark.createDataFrame([(3, 1), (700, 701), (702, 701), (9000, 9000)], "a long, b long")
    got = {r["id"]: r["class_id"] for r in common.components(star.unionByName(rest), "star").collect()}
    assert got == {**{3 * n: 1 for n in range(1, 200)}, 5000: 1, 1: 1, 700: 700, 701: 700, 702: 700}


# --- op10 --------------------------------------------------------------------------------


URLS = ["https://A.Example.ORG/es/x?q=1#f", "http://example.org/en/19", "http://notexample.org/en/1", "http://x.com/fr/1", "http://x.com/de/2?a", "http://x.com?x=/de/", "no scheme", None, "", "http://", "ftp://h#f", "http://org/", "http://org", "http://b.example.org/en/2", "http://ÄB.com/de/"]


def test_op10_rules(spark):
    pages = spark.createDataFrame([(n, u, 1) for n, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, tokens int")
    marked = spark.createDataFrame([], "url string, tokens array<string>, bad int")
    rows = {r["page_id"]: r for r in url_rules.url_filter(pages, marked).collect()}
    assert len(rows) == len(URLS) + 1
    for n, u in enumerate([*URLS, URLS[0]]):
        kind, host, path = brute.url_rule(u)
        assert (rows[n]["host"], rows[n]["path"]) == brute.url_parts(u)
        assert rows[n]["rule"] == (host + path if host else None) and rows[n]["verdict"] == (kind or "allow")
    assert url_rules.url_filter(pages.where("false"), marked).count() == 0


def test_op10_mines_what_blocks(spark):
    rows = [(f"http://spam{n % 3}.net/win/{n}", 1) for n in range(60)] + [(f"http://good{n % 5}.net/win/{n}", 0) for n in range(60)] + [(f"http://good{n % 5}.net/a/{n}", int(n % 9 == 0)) for n in range(90)]
    pages = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(rows)], "page_id long, url string")
    marks = spark.createDataFrame(rows, "url string, bad int")
    marked = url_rules.parsed(pages).join(marks, "url").select("url", "tokens", "bad")
    rules = url_rules.mine(marked, support=0.05)
    found = [set(r["tokens"]) for r in rules.collect()]
    assert found and all(not (a < b) for a in found for b in found)
    got = {r["page_id"]: r["verdict"] for r in url_rules.url_filter(pages, marked).collect()}
    assert all(got[n] == "block" for n in range(60)) and all(got[n] == "allow" for n in range(60, 210))
    brute_hits = {u for u, tokens in url_rules.parsed(pages).select("url", "tokens").collect() if any(f <= set(tokens) for f in found)}
    assert {r["url"] for r in url_rules.matched(url_rules.parsed(pages), rules).collect()} == brute_hits


def test_op10_rules_are_those_of_counting(spark):
    """All combinations of the tokens of labelled urls, counted one by one."""
    from itertools import combinations

    rng = np.random.default_rng(2)
    rows = []
    for n in range(300):
        tokens = sorted({f"t{k}" for k in rng.integers(0, 7, 4)} | {f"u{int(rng.integers(0, 3))}", *("v1 v2 v3 v4 v5 v6".split() if n % 6 == 0 else [])})
        rows.append((f"http://h/{n}", tokens, int("t1" in tokens and "u0" in tokens and rng.random() < 0.9 or n % 6 == 0 or rng.random() < 0.1)))
    marked = spark.createDataFrame(rows, "url string, tokens array<string>, bad int")
    counts = {}
    for _, tokens, bad in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(tokens, k):
                seen = counts.setdefault(frozenset(c), [0, 0])
                seen[0] += 1
                seen[1] += bad
    rate = sum(r[2] for r in rows) / len(rows)

    def bound(p, n, z=1.96):
        return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)

    kept = {c: b / n for c, (n, b) in counts.items() if b >= 0.02 * 300 and b / n >= 0.6 and b / n / rate >= 1.5 and bound(b / n, n) >= 0.5}
    want = {c: p for c, p in kept.items() if not any(d < c and kept[d] >= p for d in kept)}
    got = {frozenset(r["tokens"]): r["confidence"] for r in url_rules.mine(marked, support=0.02).collect()}
    assert got == {c: pytest.approx(p) for c, p in want.items()} and len(got) > 3


def test_op10_labels_by_the_number_that_ends_the_path(spark):
    urls = ["http://a.net/2024/05/123.html", "http://a.net/x/7/", "http://a.net/2024/about", "http://a.net/9?id=5", "http://a.net/11.html#8", "http://a.net/12/index.html", "http://4.net/"]
    pages = spark.createDataFrame([(n, u, 1, 0) for n, u in enumerate(urls)], "page_id long, url string, doc_id int, bad int")
    labels = spark.createDataFrame([(d, int(d != 123), 0, "x") for d in (123, 2024, 5, 7, 8, 9, 11, 12, 4)], "doc_id long, quality int, toxic int, url string")
    got = {r["url"]: r["bad"] for r in url_rules.labelled_urls(pages, labels).collect()}
    assert got == {urls[0]: 1, urls[1]: 0, urls[3]: 0, urls[4]: 0}


def test_op10_on_whole_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()
    rows = {r["page_id"]: r for r in queries.op10_url_association_rules(spark, data).collect()}
    for page, url in pages:
        kind, host, path = brute.url_rule(url)
        r = rows[page]
        assert (r["host"], r["path"]) == brute.url_parts(url) and r["rule"] == (host + path if host else None)
        assert r["verdict"] == (kind or ("block" if r["mined"] else "allow"))


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, data, texts):
    import corpus_pipeline as pipeline
    from palimpsest.llm import pii, toxicity

    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = pipeline.run(spark, data).collect()
    score = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet")).scorer()
    kept = [(d, t) for d, t in texts if score(t) < toxicity.THRESHOLD]
    classes = brute.jaccard_classes(kept)
    kept = [(d, t) for d, t in kept if classes[d][0] == d]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, _ in brute.leaks(kept, items)}
    kept = [(d, t) for d, t in kept if d not in leaked]
    field = pii.default_field()
    kept = [(d, pii.masked_text(t, pii.spans_of([t], field)[0][1])) for d, t in kept]
    assert {r["doc_id"] for r in got} == {d for d, _ in kept} and len(kept) < len(texts)
    check_packing(got, kept)


def test_stages_keep_columns_and_edges(spark, data, with_null_id, none):
    import corpus_pipeline as pipeline

    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, with_null_id, data)
        assert out.columns == with_null_id.columns and out.count() > 0, name
        assert stage(spark, none, data).count() == 0, name
    _, packing_stage = pipeline.STAGES[-1]
    check_packing(packing_stage(spark, with_null_id, data).collect(), [tuple(r) for r in with_null_id.select("doc_id", "text").collect()])
    assert packing_stage(spark, none, data).count() == 0


def test_one_row_of_a_group_stays_whatever_its_ids(spark, data):
    """Rows without a doc_id, rows of one doc_id, and rows that are the same in all are judged as others are."""
    import corpus_pipeline as pipeline

    words = [f"w{n}" for n in range(60)]
    near, other = " ".join(words[:-1] + ["x"]), " ".join(f"y{n}" for n in range(60))
    rows = [(None, " ".join(words)), (None, near), (3, near), (3, near), (3, other), (7, " ".join(words)), (None, other), (9, "alone"), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    kept = [(r["doc_id"], r["text"]) for r in stages["ngram_jaccard_join"](spark, docs, data).collect()]
    assert sorted(kept, key=str) == sorted([(3, near), (3, other), (9, "alone"), kept[-1] if kept[-1][1] in (None, "") else next(k for k in kept if not k[1])], key=str)
    item = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    some = spark.createDataFrame([(None, f"a lead and {item} and a tail", "en", "s", 1), (1, other, "en", "s", 1), (1, item, "en", "s", 1)], docs.schema)
    assert [(r["doc_id"], r["text"]) for r in stages["benchmark_decontamination"](spark, some, data).collect()] == [(1, other)]


def test_stored_tables_make_no_files_or_folders_beside_their_rows(spark):
    """Each would be a chmod process of the JVM, which counts as large as the JVM while it begins."""
    made = common.stored(spark.range(0, 1000, 1, 3), "made")
    assert [f for f in os.listdir(made.stored_path.removeprefix("file:")) if not f.startswith("part-") or f.endswith(".crc")] == []
    assert sorted(r["id"] for r in made.collect()) == list(range(1000))
    assert common.stored(spark.range(0), "none").count() == 0
    path = made.stored_path
    common.dropped(made)
    assert not os.path.exists(path.removeprefix("file:"))
