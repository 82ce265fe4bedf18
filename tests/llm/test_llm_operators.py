"""The operators on small frames: edge cases, and brute-force versions of what SQL cannot say."""

import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import align, classifier, decontam, licenses, mixing, neardup, quality_rules, queries, sharding, tokens, url_rules
from folioflow.llm.common import Scratch, plain_words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "alpha beta", "en", "a", 10), (1, "alpha beta", "en", "a", 10), (1, "other text", None, "a", None), (None, "no id here", "en", None, 1), (2, None, None, None, None), (None, None, None, None, None),
    (3, "", "en", "b", 0), (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4), (6, "!!! ###", "en", "zz", 7), (7, "word " * 40000, "en", "a", 200000), (8, "x" * 300000, "en", "a", 300000), (9, "日本語 テキスト", "ja", "a", 8),
]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names the operators use inside."""
    df = frame(spark, ODD)
    for c in ("digest", "keys", "rid", "part", "tie", "copy", "n_copies", "shard", "bucket", "label", "score", "__place", "path", "key"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], DOCS)


def random_docs(seed, n=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(900)]
    passage = [rng.choice(pool) for _ in range(60)]
    out = []
    for i in range(n):
        words = [rng.choice(pool) for _ in range(rng.randint(40, 160))]
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage
        out.append(words)
    for i in range(0, n, 4):
        for rate in (0.02, 0.06):
            out.append([rng.choice(pool) if rng.random() < rate else w for w in out[i]])
    out += [list(out[2]) for _ in range(5)]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def brute_classes(docs, similarity=0.8):
    words = {i: plain_words(t) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, ta), (b, tb) in itertools.combinations(docs, 2):
        near = ta == tb or align.banded_distance(words[a], words[b], align.edit_limit(max(len(words[a]), len(words[b])), similarity)) is not None
        if near:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in parent}


def test_near_duplicates_against_brute_force(spark):
    """No false link; of the documents that brute force links, at similarities from 0.8 on, nearly all are in their class."""
    docs = random_docs(5)
    want = brute_classes(docs)
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in neardup.near_duplicate_classes(frame(spark, docs, "doc_id long, text string")).collect()}
    assert all(want[i] == want[c] for i, (c, _) in got.items())
    linked = [i for i in want if Counter(want.values())[want[i]] > 1]
    assert len(linked) > 40 and sum(got[i][0] == want[i] for i in linked) >= 0.95 * len(linked)
    sizes = Counter(c for c, _ in got.values())
    assert all(n == sizes[c] for c, n in got.values())
    kept = neardup.keep_one_per_class(frame(spark, docs, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(sizes)


def test_large_open_buckets_are_divided(spark):
    rng = random.Random(3)
    pool = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(pool) for _ in range(80)]
    docs = [passage + [rng.choice(pool) for _ in range(60)] for _ in range(50)]
    docs += [[rng.choice(pool) if rng.random() < 0.03 else w for w in d] for d in docs[:10]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = neardup.near_duplicate_classes(frame(spark, rows, "doc_id long, text string"), neardup.NearDupParams(bucket=4)).collect()
    want = brute_classes(rows)
    assert sum(r["class_id"] != want[r["doc_id"]] for r in got) <= 1


def test_texts_with_a_shared_passage_are_all_linked(spark):
    """Sixty texts of one long passage and a near copy of each, at similarities 0.9 and 0.85: each pair is found."""
    rng = random.Random(11)
    pool = [f"u{i}" for i in range(20000)]
    passage = [rng.choice(pool) for _ in range(150)]
    docs = [passage + [rng.choice(pool) for _ in range(50)] for _ in range(60)]
    for i, d in enumerate(docs[:60]):
        at = set(rng.sample(range(200), (20, 30)[i % 2]))
        docs.append([f"e{i}x{k}" if k in at else w for k, w in enumerate(d)])
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want = brute_classes(rows)
    assert len(set(want.values())) < 61
    got = neardup.near_duplicate_classes(frame(spark, rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_short_texts_are_all_linked(spark):
    """Near copies of 5 to 30 words, edited in any place as often as the similarity allows: classes are those of all pairs."""
    rng = random.Random(4)
    pool = [f"s{i}" for i in range(2000)]
    docs = [[rng.choice(pool) for _ in range(n)] for n in range(5, 26) for _ in range(4)]
    for i, d in enumerate(docs[:]):
        c, most = list(d), align.edit_limit(len(d), 0.8)
        for k in range(most):
            at = rng.randrange(len(c))
            c[at : at + (i + k) % 2] = [f"t{i}x{k}"]
        docs.append(c)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = neardup.near_duplicate_classes(frame(spark, rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_components_read_all_links_in_one_round_only(spark, monkeypatch):
    rng = random.Random(4)
    pairs = {(h, b) for b in range(20, 400) for h in rng.sample(range(20), 6) if h % 2 == b % 2} | {(k, k + 1) for k in range(500, 560)} | {(900, 700), (700, 800)}
    run, seen = neardup._Run(spark, neardup.NearDupParams()), []
    monkeypatch.setattr(run.tables, "save", lambda df, name, f=run.tables.save, **o: seen.append((name, (out := f(df, name, **o)).count())) or out)
    got = {r["rid"]: r["label"] for r in run.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    want = {x: x for p in pairs for x in p}
    while (step := {x: min([want[x], *(want[a] for a, b in pairs if b == x), *(want[b] for a, b in pairs if a == x)]) for x in want}) != want:
        want = step
    assert got == want
    links = [n for name, n in seen if name == "edges"]
    assert links[0] == len(pairs) and links[-1] == 0 and sum(links[1:]) < len(pairs) / 2


def test_block_links_lose_nothing():
    """Blocks of one group, met two by two, join the same texts as all pairs do."""
    rng = random.Random(2)
    pool = [f"b{i}" for i in range(60)]
    docs = [[rng.choice(pool) for _ in range(rng.randint(1, 24))] for _ in range(60)]
    docs += [[rng.choice(pool) if rng.random() < 0.1 else w for w in d] for d in docs]
    names = {w: i for i, w in enumerate(pool)}
    words = [np.array([names[w] for w in d], np.int64) for d in docs]
    for split in (0, 60):
        links = neardup.block_links(list(range(120)), list(range(120)), words, split, 0.8)
        parent = list(range(120))
        for a, b in [*links, *(p for p in itertools.combinations(range(120), 2) if not split or p[0] < split <= p[1])]:
            near = align.banded_distance(docs[a], docs[b], align.edit_limit(max(len(docs[a]), len(docs[b])), 0.8)) is not None
            if (a, b) in links:
                assert near
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = [new if x == old else x for x in parent]
            else:
                assert not near or parent[a] == parent[b]
        assert links


def test_near_duplicates_odd_rows(spark, odd, empty):
    got = neardup.near_duplicate_classes(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["class_id"], r["class_size"]))
    assert sorted(by[1]) == [(1, 1), (1, 2), (1, 2)] and by[2] == [(2, 1)] and by[3] == by[4] == [(3, 2)] and sorted(by[None], key=str) == [(None, 1), (None, 1)]
    kept = neardup.keep_one_per_class(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    assert neardup.near_duplicate_classes(empty).count() == 0 == neardup.keep_one_per_class(empty).count()


def test_sharding(spark, odd, empty):
    path = sharding.shard_to_files(spark, odd, bucket_bytes=50_000)
    rows = sharding.shard_report(spark, path).collect()
    assert len(rows) == len(ODD)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.shard_report(spark, sharding.shard_to_files(spark, empty)).count() == 0


def test_shards_come_out_alike_again(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 900).alias("text"))
    runs = [sharding.shard_report(spark, sharding.shard_to_files(spark, docs.repartition(7, "doc_id").sortWithinPartitions("doc_id"), bucket_bytes=2000)).collect() for _ in range(2)]
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in runs[0]) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in runs[1])
    with pytest.raises(ValueError):
        sharding.shard_to_files(spark, docs.withColumn("bucket", F.lit(1)), columns=("bucket",))


def test_sharding_shuffles_and_moves_few(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows = sharding.shard_report(spark, sharding.shard_to_files(spark, docs, bucket_bytes=2000)).collect()
    moved = sum(r["grown_shard"] == 16 for r in rows)
    assert 140 < moved < 340
    one = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])) if r["shard"] == 3]
    assert 180 < len(one) < 320 and abs(np.corrcoef(np.arange(len(one)), one)[0, 1]) < 0.25
    again = sharding.shard_report(spark, sharding.shard_to_files(spark, docs, bucket_bytes=2000)).collect()
    assert {(r["doc_id"], r["shard"]) for r in rows} == {(r["doc_id"], r["shard"]) for r in again}


def test_poisson_counts_follow_their_mean(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs, {"a": 3.0, "b": 1.0}, seed=3)
    counts = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(counts["a"] / 15000 - 1) < 0.05 and abs(counts["b"] / 5000 - 1) < 0.06
    per = Counter(r["n_copies"] for r in got.filter("source = 'a' and copy = 0").collect())
    p = [np.exp(-3)]
    for k in range(1, 8):
        p.append(p[-1] * 3 / k)
    assert all(abs(per[k] - 5000 * p[k]) < 5 * np.sqrt(5000 * p[k]) for k in range(1, 8))
    assert mixing.poisson_steps(0.0)[0] == 1.0 and abs(mixing.poisson_steps(40.0)[-1] - 1) < 1e-9


def test_rare_sources_are_replicated_at_any_rate(spark):
    docs = spark.range(40001).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, "a").alias("source"))
    rows = mixing.mix(docs, {"a": 1.0, "*": 1.0}, seed=3).filter("source is null").collect()
    assert {r["n_copies"] for r in rows} == {len(rows)} and abs(len(rows) - 20000) < 5 * np.sqrt(20000)
    assert sorted(r["copy"] for r in rows) == list(range(len(rows)))
    drawn = np.array([r["n"] for r in spark.range(4000).select(mixing.poisson_draw(3, F.col("id"), 1200.0).alias("n")).collect()])
    assert abs(drawn.mean() - 1200) < 5 * np.sqrt(1200 / 4000) and 0.88 < drawn.var() / 1200 < 1.12


def test_mixing_odd_rows(spark, odd, empty):
    got = mixing.mix(odd, {"a": 1.0, "*": 1.0}, seed=3)
    assert got.columns == [c for c in odd.columns if c not in ("copy", "n_copies")] + ["copy", "n_copies"]
    rows = got.collect()
    rates = mixing.mean_rates(odd, {"a": 1.0, "*": 1.0})
    assert set(rates) == {"a", "*"} and abs(rates["a"] * 6 + rates["*"] * 7 - 13) < 1e-9
    assert len({r["n_copies"] for r in rows if r["doc_id"] == 1}) <= 1 and len(rows) == sum(r["n_copies"] for r in rows if r["copy"] == 0)
    twice = mixing.mix(odd, {"a": 1.0, "*": 1.0}, seed=3, named=("copy_", "n_copies_"))
    assert twice.columns == [*odd.columns, "copy_", "n_copies_"] and {r["copy"] for r in twice.collect()} <= {"clash"}
    assert mixing.mix(odd, {"a": 1.0}).filter("source <> 'a' or source is null").count() == 0
    assert mixing.mix(empty, {"a": 1.0}).count() == 0 == mixing.mix(odd, {"q": 1.0}).count()


def test_token_files_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    path = tokens.encode_to_files(spark, odd, keep=("source",))
    rows = tokens.read_token_files(spark, path).orderBy("start").collect()
    at = 0
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(rows) == len(ODD)
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in ODD)
    assert Counter((r["doc_id"], tuple(r["tokens"])) for r in rows) == want
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["tokens"])
        at += r["n_tokens"]
    digest = {(r["start"], r["ids_crc32"]) for r in tokens.token_digest(spark, path).collect()}
    assert digest == {(r["start"], zlib.crc32(np.array(r["tokens"], "<u4").tobytes())) for r in rows}
    with pytest.raises(ValueError):
        tokens.encode_to_files(spark, odd, keep=("part",))
    parts = tokens.encode_to_files(spark, odd.unionByName(odd), part_bytes=100_000, keep=("tie",))
    assert sorted(r["start"] for r in tokens.token_digest(spark, parts).collect())[-1] > 2 * at - 200_000
    none = tokens.encode_to_files(spark, empty)
    assert tokens.token_digest(spark, none).count() == 0


def test_token_files_reach_workers_in_small_batches(spark, monkeypatch):
    kind, held = type(spark.range(0)), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def bounded(self, run, *args, plain=kind.mapInArrow, **options):
        def checked(batches):
            def seen():
                for b in batches:
                    assert b.slice(0, b.num_rows - 1).nbytes < 3 << 20, b.nbytes  # the last row may be longer than a batch
                    yield b

            return run(seen())

        return plain(self, checked, *args, **options)

    monkeypatch.setattr(kind, "mapInArrow", bounded)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" a b"), 1000)).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(3000, " a" * 2000000)], "doc_id long, text string"))
    rows = tokens.token_digest(spark, tokens.encode_to_files(spark, docs)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(3001)) and min(r["n_tokens"] for r in rows) > 2000 and rows[-1]["n_tokens"] == 2000001
    assert [r["start"] for r in rows] == [0, *itertools.accumulate(r["n_tokens"] for r in rows[:-1])]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == held


def test_token_file_format(spark):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = tokens.encode_to_files(spark, docs, row_group_bytes=1 << 16, page_bytes=1 << 12).removeprefix("file://")
    name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    meta = pq.ParquetFile(f"{path}/{name}").metadata
    column = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema.startswith("tokens"))
    assert column.has_offset_index and column.has_column_index and {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings)


def test_token_counts(spark, odd, empty):
    rows = tokens.count_tokens(odd, limit=10).collect()
    own = tokens.splitter(tokens.tokenizer_path())
    want = Counter((i, len((t or "").encode()), len(own.whole(t or ""))) for i, t, *_ in ODD)
    few = tokens.count_tokens(odd, limit=10, head=2).collect()  # nearly all pre-tokens meet by shuffle
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in few) == want
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 10) for r in rows) and tokens.count_tokens(empty).count() == 0


def test_token_counts_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = tokens.splitter(tokens.tokenizer_path())
    want = Counter((r["doc_id"], len(own.whole(r["text"] or ""))) for r in docs.collect())
    for head in (50, tokens.HEAD_PIECES):
        assert Counter((r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(docs, head=head).collect()) == want


def test_decontamination_odd_rows(spark, odd, empty):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item), (1, item), (None, "eleven " + item), (3, None), (4, ""), (5, "short one")], "item_id long, text string")
    docs = odd.unionByName(odd.limit(1).withColumn("text", F.lit(f"before {item.upper()} after")))
    hits = decontam.contamination_hits(docs, items).collect()
    assert {r["item_id"] for r in hits} == {None, 1} and len({r["doc_id"] for r in hits}) == 1
    assert next(r for r in hits if r["item_id"] == 1)["distance"] == 0
    clean = decontam.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1
    assert decontam.contamination_hits(empty, items).count() == 0 == decontam.contamination_hits(docs, items.limit(0)).count()
    tiny = decontam.DecontamParams(block_bytes=40)
    assert Counter(decontam.contamination_hits(docs, items, tiny).collect()) == Counter(hits)
    assert decontam.drop_contaminated(docs, items, tiny).count() == clean.count()


def test_decontamination_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination_hits(docs, items).collect()}
    want = set()
    probes = [(r["item_id"], plain_words(r["text"])) for r in items.collect()]
    for r in docs.collect():
        words = plain_words(r["text"])
        have = Counter(zip(words, words[1:]))
        for item_id, target in probes:
            n, limit = len(target), align.edit_limit(len(target), 0.8)
            if sum(min(have[p], 1) for p in set(zip(target, target[1:]))) < n - 1 - 2 * limit - 5:
                continue
            if any(align.banded_distance(words[s : s + n], target, limit) is not None for s in range(max(1, len(words) - n + 1))):
                want.add((r["doc_id"], item_id))
    assert got == want and want


def test_url_filter(spark):
    urls = ["https://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "ftp://x.com/de/", "http://com/fr/a", "http://spam-farm.net/fr/", "no url", None, "", "http://", "http://h", "http://org?x=/", "http://u:p@x.org:80/y", "HTTP://X.COM/FR/"]
    rows = url_rules.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1))).orderBy("page_id").collect()
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]
    assert got[:9] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("notexample.org", "/es/", "org/", "allow"),
        ("x.com", "/de/", "com/de/", "block"), ("com", "/fr/a", "com/fr/", "allow"), ("spam-farm.net", "/fr/", None, "block"), ("", "", None, "allow"), ("", "", None, "allow"),
    ]
    assert got[10] == ("", "", None, "allow") and got[11] == ("h", "", None, "allow") and got[12] == ("org", "", None, "allow") and got[14] == ("x.com", "/FR/", None, "allow")
    globs = [("https://m.casino-win.example.com/a", "block"), ("https://casino.example.net/", "block"), ("http://good.net/casino.html", "allow"), ("http://mycasino.net/", "allow"), ("http://good.net/x.casino.y/", "allow"), ("http://good.net/a/b.exe", "block"), ("http://casino", "allow"), ("http://a.exe/", "allow"), ("http://good.net/ads/1", "block"), ("http://x.org/ads/1", "allow")]
    found = url_rules.filter_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(globs)], "page_id long, url string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in found] == [v for _, v in globs] and len(url_rules.GLOBS) > 150
    assert url_rules.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_quality_odd_rows(spark, odd, empty):
    rows = quality_rules.quality_report(odd).collect()
    assert len(rows) == len(ODD) and all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (2, 3, 5, 6, 7, 8))
    good = frame(spark, [(1, "A line of many words that ends well. " * 1 + " ".join(f"t{i}" for i in range(60)) + ".", "en", "a", 1)])
    kept = quality_rules.keep_good(odd.select(good.columns).unionByName(good))
    assert [r["doc_id"] for r in kept.collect()] == [1] and kept.columns == good.columns
    dirty = good.withColumn("text", F.concat(F.lit("home | a | b | c\n"), F.col("text"), F.lit("\nAll rights reserved.")))
    both = [quality_rules.keep_good(dirty, remove_lines=x).first() for x in (True, False)]
    assert both[0]["text"] == good.first()["text"] and both[0]["n_chars"] == len(both[0]["text"]) and both[1]["text"] == dirty.first()["text"] and both[1]["n_chars"] == 1
    # White space outside of ASCII ends no word.
    assert quality_rules.judge("a\u00a0b\u2028c d")["n_words"] == 2 and not quality_rules.line_fails("x\u00a0" * 20)
    assert quality_rules.quality_report(empty).count() == 0 == quality_rules.keep_good(empty).count()


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scores = classifier.score_quality(docs, classifier.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in scores)
    good, bad = ([r["score"] for r in scores if r["quality"] == q] for q in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.97 and np.mean([r["predicted"] == r["quality"] for r in scores]) > 0.93


def test_classifier_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    w = classifier.train(odd, labels)
    rows = classifier.score_quality(odd, w).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert (classifier.train(odd, labels.limit(0)) == 0).all() and classifier.score_quality(empty, w).count() == 0


FILES = [
    (1, "p/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.\nMore words here."),
    (2, "p/src/a.py", "code with no statement"), (3, "p/src/b.py", "# SPDX-License-Identifier: Apache-2.0\ncode of some more words follows here"), (4, "p/src/deep/x/c.py", ""), (5, "q/d.py", "nothing"), (6, None, "Released under the MIT License."), (7, None, None),
    (8, "p/src/deep/COPYING", "This work is licensed under the GNU General Public License, version 3."), (9, "top.txt", "text. Licensed under CC BY-NC 4.0. " + "filler " * 300), (1, "p/z.py", "x"), (None, "p/z.py", "x"), (10, "p/w.py", "a license of some other kind " * 50),
]


def test_licenses(spark):
    df = spark.createDataFrame(FILES, "doc_id long, path string, text string").withColumn("uid", F.lit(1)).withColumn("term", F.lit("x"))
    rows = licenses.scan_licenses(df).collect()
    assert len(rows) == len(FILES)
    got = {(r["doc_id"], r["path"]): (r["license"], r["origin"], r["from_dir"]) for r in rows}
    assert got[1, "p/LICENSE"][:2] == ("MIT", "file") and got[2, "p/src/a.py"] == ("MIT", "inherited", "p") and got[3, "p/src/b.py"] == ("Apache-2.0", "header", None)
    assert got[4, "p/src/deep/x/c.py"] == ("GPL-3.0", "inherited", "p/src/deep") and got[5, "q/d.py"] == (None, None, None) and got[6, None][0] == "MIT" and got[7, None] == (None, None, None)
    assert got[9, "top.txt"][:2] == ("CC-BY-NC-4.0", "header") and got[None, "p/z.py"] == ("MIT", "inherited", "p") and got[10, "p/w.py"][1] == "inherited"
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_license_cosine_equals_brute_force(spark):
    import math

    df = spark.createDataFrame(FILES, "doc_id long, path string, text string")
    p = licenses.LicenseParams()
    units = {}
    import re

    for i, (_, path, text) in enumerate(FILES):
        found = [s for pattern in (r"\n|(?<=[.!?;])\s+", r"(?<=[.!?;])\s+|\n\s*\n") for s in re.split(pattern, text or "")]
        for s in dict.fromkeys(found):
            if re.search(p.trigger, s):
                w = licenses._py_terms(s)
                parts = [w] if len(w) <= p.window else [w[k : k + p.window] for k in range(0, len(w) - p.window // 2, p.window // 2)]
                units.setdefault(i, []).extend(parts)
    every = [u for us in units.values() for u in us] + [licenses._py_terms(t) for _, t in p.templates]
    df_count = Counter(t for u in every for t in set(u))
    idf = {t: math.log((1 + len(every)) / (1 + n)) + 1 for t, n in df_count.items()}

    def vector(words):
        v = {t: n * idf[t] for t, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    shapes = [(lic, vector(licenses._py_terms(t))) for lic, t in p.templates]
    want = {}
    for i, us in units.items():
        hits = [(round(sum(x * s.get(t, 0) for t, x in vector(u).items()), 6), lic, k, j) for k, u in enumerate(us) for j, (lic, s) in enumerate(shapes)]
        hits = [h for h in hits if h[0] >= p.min_cosine]
        ranks = []
        for lic in {h[1] for h in hits}:
            own = {}
            for c, name, k, _ in hits:
                if name == lic:
                    own[k] = max(c, own.get(k, 0))
            met = len({h[3] for h in hits if h[1] == lic}) / sum(n == lic for n, _ in p.templates)
            ranks.append((round(sum(own.values()), 4), met, lic, max(own.values())))
        want[FILES[i][0], FILES[i][1]] = (max(ranks)[3], max(ranks)[2]) if ranks else None
    for r in licenses.scan_licenses(df).filter("origin in ('file', 'header')").collect():
        cosine, lic = want.pop((r["doc_id"], r["path"]))
        assert r["license"] == lic and abs(r["cosine"] - cosine) < 2e-6
    assert not any(want.values())


def _wrapped(text, prefix="# ", width=60):
    import textwrap

    return "\n".join(textwrap.wrap(text, width, initial_indent=prefix, subsequent_indent=prefix, break_long_words=False))


def test_whole_licence_files_wrapped_at_a_line_width(spark):
    """Each licence text, wrapped as a comment, is taken for its own licence and not for a neighbouring one."""
    rows = [(i, f"d{i}/LICENSE", _wrapped(text), name) for i, (name, text) in enumerate(licenses.LICENSE_TEXTS)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {i: (name, "file") for i, _, _, name in rows}


def test_inheritance_equals_brute_force(spark):
    rng = random.Random(12)
    names = [name for name, _ in licenses.LICENSE_TEXTS]
    dirs = [""] + ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = []
    for i in range(160):
        d = rng.choice(dirs)
        own = rng.random()
        text = f"SPDX-License-Identifier: {rng.choice(names)}" if own < 0.2 else "nothing of note"
        rows.append((i, f"{d}/" * bool(d) + ("LICENSE" if own < 0.1 else f"f{i}.py"), text))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    declared = {}
    for i, path, text in sorted(rows, key=lambda r: (-(got[r[0]]["cosine"] or 0), r[1])):
        if text.startswith("SPDX"):
            declared.setdefault(path.rpartition("/")[0], (got[i]["license"], got[i]["cosine"]))
    for i, path, text in rows:
        r = got[i]
        if text.startswith("SPDX"):
            assert r["origin"] == "file" and r["license"] == text.split()[-1]
            continue
        at = path.rpartition("/")[0]
        while at not in declared and at:
            at = at.rpartition("/")[0]
        assert (r["license"], r["from_dir"]) == ((declared[at][0], at) if at in declared else (None, None)), path
    assert sum(r["origin"] == "inherited" for r in got.values()) > 40


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(d[0], quality_rules.clean_text(d[1]), *d[2:4], len(quality_rules.clean_text(d[1]))) for d in docs if quality_rules.judge(d[1])["kept"]]
    assert any(a[1] not in {d[1] for d in docs} for a in kept)
    classes = brute_classes([(d[0], d[1]) for d in kept])
    kept = [d for d in kept if classes[d[0]] == d[0]]
    index = decontam.ItemIndex(items, decontam.DecontamParams())
    kept = [d for d in kept if not index.search([d[1]])[0]]
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {r["doc_id"] for r in got} <= {d[0] for d in kept}
    assert len(kept) > 50
    import hashlib

    counts = Counter(d[3] for d in kept)
    scale = sum(w for s, w in queries.WEIGHTS.items() if counts.get(s))
    want = Counter()
    for d in kept:
        mean = queries.WEIGHTS[d[3]] / scale * len(kept) / counts[d[3]]
        u = (int(hashlib.md5(f"{queries.MIX_SEED}:{d[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want[d[0]] = sum(u >= x for x in mixing.poisson_steps(mean))
    assert Counter(r["doc_id"] for r in got) == +want
    table = tokens.splitter(tokens.tokenizer_path())
    texts = {d[0]: d[1] for d in kept}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["tokens"] == table.whole(texts[r["doc_id"]]) + [2] and r["start"] == at
        at += len(r["tokens"])


def test_pipeline_stages_on_odd_rows(spark, odd, empty, tmp_path):
    """Nulls, repeated rows, clashing names and empty tables pass every stage; columns stay as they are."""
    import corpus_pipeline

    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (None, None), (3, "")], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(70)) + "."
    docs = odd.unionByName(odd.limit(1).withColumn("text", F.lit(long)))
    want = {"quality_rules": 1, "near_dedup": 12, "decontamination": 14, "mixing": None, "token_files": 14}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        n = len(out.collect())
        assert want[name] is None or n == want[name], (name, n)
        assert name == "token_files" or out.columns == docs.columns
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_scratch_tables_go_to_the_shared_folder(spark):
    t = Scratch(spark, "x")
    df = t.save(spark.range(3), "a")
    assert df.count() == 3 and spark.sparkContext.getConf().get("spark.checkpoint.dir") in t.root
    t.drop(df)
