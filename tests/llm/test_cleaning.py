"""Line dedup, fingerprints, decontamination, quality, sharding: brute force and edge cases."""

import collections
import hashlib
import itertools
import os
import random
import re
import struct
import tracemalloc

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, line_dedup, order_minhash, quality, sharding

ODD = [(0, None), (1, ""), (2, "\n\n\n"), (3, "one two"), (4, "a\nb\nc\nd"), (5, "x\na\nb\nc\ny"), (6, "a\nb\nc"), (6, "a\nb\nc"), (7, "q\nq\nq\nq\nq"), (8, "w " * 30000), (9, "l\n" * 5000), (None, "a\nb\nc\nz"), (10, "ünï cödé\r\n\x00")]
SCHEMA = "doc_id long, text string, lang string, n_lines string, score string, shard string, starts string, a string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *["clash"] * 6) for i, t in ODD], SCHEMA).repartition(3)


def dedup_by_hand(rows):
    first, out = {}, collections.Counter()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    done = {}
    for k in order:
        if rows[k] in done:
            out[k] = done[rows[k]]
            continue
        lines = [] if rows[k][1] is None else rows[k][1].split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if first.setdefault(window, (k, at)) != (k, at):
                gone |= {at, at + 1, at + 2}
        out[k] = done[rows[k]] = (None if rows[k][1] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return [out[k] for k in range(len(rows))]


def test_line_dedup(odd):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*[c for c in odd.columns if c != "n_lines"], "n_lines", "n_removed"]
    want = sorted(((i, *r) for (i, _), r in zip(ODD, dedup_by_hand(ODD), strict=True)), key=str)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == want
    assert line_dedup.dedup_lines(odd.limit(0)).collect() == []
    assert line_dedup.line_report(odd).count() == len(ODD)


def test_line_dedup_equals_its_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = line_dedup.line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    at = ["doc_id", "n_lines", "n_removed", "text_sha256"]
    wanted = c.sql(f"select {', '.join(at)} from ({line_dedup.LINE_SQL})").fetchall()
    assert sorted(tuple(r[x] for x in at) for r in got.collect()) == sorted(wanted)


def test_fingerprints(spark, odd):
    rows = [(i, t) for i, t in ODD if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = order_minhash.neighbour_report(docs).collect()
    assert len(got) == len(rows)
    by_text = collections.defaultdict(set)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == len(r.edited_fingerprint) == 8 * order_minhash.SLOTS
        mine = [k for k, (i, _) in enumerate(order) if i == r.doc_id]
        options = set()
        for k in mine:
            t, after = order[k][1], order[(k + 1) % len(order)][1]
            n = len(t)
            options.add((n, hashlib.sha256((t[: n - n // 2] + after[: n // 2]).encode()).hexdigest()))
        assert (r.n_chars, r.edited_sha256) in options
        for k in mine:
            by_text[order[k][1]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert order_minhash.neighbour_report(docs.limit(0)).collect() == []
    alone = order_minhash.neighbour_report(docs.limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert order_minhash.neighbour_report(odd.select("doc_id", "text")).count() == len(ODD)


def test_fingerprints_follow_order_and_repeats(spark):
    words = [f"w{k}" for k in range(400)]
    half = words[:200] + [f"v{k}" for k in range(200)]
    texts = {"same": words, "edit": [*words[:-20], *["z"] * 20], "half": half, "turned": words[::-1], "other": [f"q{k}" for k in range(400)], "repeats": words[:50] * 8, "more": words[:50] * 4}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, text string")
    prints = {r.k: r.f for r in df.select("k", order_minhash.fingerprint(F.col("text")).alias("f")).collect()}

    def like(a, b):
        used = [(x, y) for x, y in zip(prints[a], prints[b], strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in used) / len(used)

    assert like("same", "same") == 1 and like("same", "edit") > 0.6 > like("same", "half") > 0.05
    assert like("same", "turned") < 0.05 and like("same", "other") == 0
    assert 0 < like("repeats", "more") < 1
    measured = df.alias("x").join(df.alias("y"), (F.col("x.k") == "same") & (F.col("y.k") == "half")).select(order_minhash.likeness(order_minhash.fingerprint(F.col("x.text")), order_minhash.fingerprint(F.col("y.text")))).first()[0]
    assert measured == pytest.approx(like("same", "half"))


def test_next_by_buckets(spark):
    rows = [(i * 7 % 101, f"text {i}") for i in range(101)] + [(5, "twin"), (5, "twin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = order_minhash.neighbour_report(docs).collect()
    by_id = collections.Counter(r.doc_id for r in got)
    assert by_id[5] == 3 and len(got) == 103


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits_by_hand(rows, tests, window=13):
    patterns = collections.defaultdict(set)
    for item, text in tests:
        w = words(text)
        n = min(window, len(w))
        for at in range(len(w) - n + 1) if n else ():
            patterns[tuple(w[at : at + n])].add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w, hit, items = words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for at in range(len(w) - n + 1):
                found = patterns.get(tuple(w[at : at + n]))
                if found:
                    hit |= set(range(at, at + n))
                    items |= found
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def spark_hash(*values):
    """xxhash64 of Spark: each value's hash is the seed of the next; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Small) else "<q", v)
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


class Small(int):
    """An int of 32 bits."""


def fingerprint_by_hand(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    if len(text) > order_minhash.LONG_WORD * len(words):
        words = [c for c in text if c not in " \t\n\x0b\f\r"]
    hashes = [spark_hash(w) for w in words]
    seen, chosen = collections.Counter(), collections.defaultdict(list)
    for at in range(max(len(hashes) - 1, 1) if hashes else 0):
        kmer = spark_hash(*hashes[at : at + 2]) >> 31
        packed = (spark_hash(kmer, Small(seen[kmer])) >> 31 << 31) | at
        seen[kmer] += 1
        chosen[packed >> 58].append(packed)
    out = []
    for slot in range(-32, 32):
        least = sorted(sorted(chosen[slot])[:2], key=lambda x: x & ((1 << 31) - 1))
        out.append(spark_hash(*[(x >> 31) & ((1 << 33) - 1) for x in least]) >> 32 & 0xFFFFFFFF if least else None)
    return out


def likeness_by_hand(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_fingerprints_equal_brute_force(spark, sf_dir):
    rows = [(i, t) for i, t in ODD] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(3)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(400))
    rows += [(90_000, han), (90_001, han[:200] + "x" + han[201:]), (90_002, "a b " * 50), (90_003, "one")]
    rows += [(None, f"no id {k}") for k in range(40)] + [(77, f"same id {k}") for k in range(40)]
    got = order_minhash.neighbour_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    as_signed = lambda t: spark_hash(t)
    turn = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, as_signed(r[1])))
    want = []
    for (i, t), (_, after) in zip(turn, [*turn[1:], turn[0]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(fingerprint_by_hand, (t, edited, after))
        hexed = lambda x: "".join("-" * 8 if v is None else f"{v:08x}" for v in x)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), likeness_by_hand(a, b), likeness_by_hand(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert next(r.near_next for r in got if r.doc_id == 90_000) > 0.9


def test_buckets_of_one_id_are_cut(spark):
    rows = [(None, f"no id {k}") for k in range(3000)] + [(k, f"text {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"text_hash": F.xxhash64("text"), "signatures": F.array(F.lit(1))})
    after, _ = order_minhash.with_next(docs, 16)
    assert max(r["count"] for r in after.groupBy("bucket").count().collect()) < 500


def benchmark_rows():
    long = " ".join(f"t{k}" for k in range(20))
    return [(10, long), (9, "Short, ITEM here"), (9, "short item here"), (2, "solo"), (3, ""), (4, None), (None, "no id given"), (5, " ".join(["rep"] * 15)), (6, "É été x Y")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    long = " ".join(f"t{k}" for k in range(20))
    rows = [*ODD, (20, long.upper()), (21, "pre " * 300 + " ".join(f"t{k}" for k in range(13)) + " post"), (22, "a short-ITEM here; Solo"), (23, "rep " * 40), (24, "no id given!"), (25, " ".join(f"t{k}" for k in range(12))), (26, "É été X y"), (27, "solo " * 3)]
    tests = benchmark_rows()
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], "doc_id long, text string, spans string, items string").repartition(3)
    bench = spark.createDataFrame(tests, "item_id long, text string")
    found = decontaminate.find_windows(docs, bench, keep=["doc_id"], block_bytes=block_bytes)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found.collect()), key=str)
    assert got == hits_by_hand(rows, tests)
    if block_bytes > 60:
        report = decontaminate.contamination_report(docs, bench)
        assert sorted(map(tuple, report.collect()), key=str) == got
        kept = decontaminate.decontaminate(docs, bench)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((g[0] for g in got if not g[5]), key=str)
        assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)
        assert decontaminate.contamination_report(docs.limit(0), bench).collect() == []


def test_wu_manber_random():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 5))
        words = rng.integers(0, 3, 12).astype(np.uint64)
        at = np.sort(rng.choice(13 - n, 4, replace=False))
        patterns = {k: tuple(words[k : k + n].tolist()) for k in at.tolist()}
        text = rng.integers(0, 3, 40).astype(np.uint64)
        want = {(k, p) for k in range(41 - n) for p, w in patterns.items() if tuple(text[k : k + n].tolist()) == w}
        found = [pair for starts, places in decontaminate.WuManber(words, at, n).find(text) for pair in zip(starts.tolist(), places.tolist(), strict=True)]
        assert set(found) == want and len(found) == len(want)


@pytest.mark.parametrize("compared", [1, 4096])
def test_searcher_equals_brute_force(monkeypatch, compared):
    monkeypatch.setattr(decontaminate, "COMPARED", compared)
    rng = random.Random(5)
    for _ in range(60):
        items = [(str(k), " ".join(rng.choices("abc", k=rng.randrange(9)))) for k in range(6)]
        text = rng.choices("abc", k=60)
        window, spans, owners = rng.choice([1, 2, 3, 5]), set(), set()
        for item, words in ((i, t.split()) for i, t in items):
            m = min(window, len(words))
            for at in range(61 - m) if m else ():
                if any(text[at : at + m] == words[k : k + m] for k in range(len(words) - m + 1)):
                    spans |= set(range(at, at + m))
                    owners.add(item)
        got, found = decontaminate.Searcher(items, window)([w.encode() for w in text])
        assert {w for a, b in got for w in range(a, b)} == spans and found == owners


def test_tables_of_a_benchmark_stay_small():
    rng = random.Random(1)
    items = [(str(k), " ".join(f"word{rng.randrange(50_000)}" for _ in range(400))) for k in range(1500)]
    text = sum(len(t) for _, t in items)
    tracemalloc.start()
    searcher = decontaminate.Searcher(items, 13)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 5 * text and peak < 12 * text and len(searcher.tables) == 1


def test_quality(spark, sf_dir, odd):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    report = quality.quality_report(docs, labels).cache()
    assert report.count() == docs.count() and report.where("score < 0 or score > 1 or score is null").count() == 0
    joined = report.join(labels, "doc_id").where("held_out")
    right = joined.where("predicted = quality").count() / joined.count()
    assert right > 0.95
    assert report.where(F.col("predicted") != (F.col("score") >= 0.7).cast("int")).count() == 0
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(odd, model)
    assert scored.columns == [*[c for c in odd.columns if c != "score"], "score"] and scored.count() == len(ODD)
    assert quality.score_quality(odd.limit(0), model).collect() == []
    assert quality.keep_good(odd, labels).columns == odd.columns
    empty = quality.quality_report(docs.limit(3), labels.limit(0)).collect()
    assert [r.score for r in empty] == [0.5] * 3
    odd_labels = labels.limit(2).select("doc_id", F.lit(None).cast("int").alias("quality")).unionByName(labels.select("doc_id", "quality").limit(1))
    assert quality.quality_report(docs.limit(3), odd_labels).count() == 3


def test_quality_fit_is_bounded(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    narrow = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    again = quality.fit_quality(narrow.unionAll(narrow), labels.withColumn("doc_id", F.col("doc_id").cast("int")))
    assert np.array_equal(model.w, again.w) and np.array_equal(model.v, again.v) and model.w0 == again.w0
    less = quality.fit_quality(docs, labels, fit_bytes=20_000)
    assert not np.array_equal(model.w, less.w) and np.count_nonzero(less.w) < np.count_nonzero(model.w)


def test_interactions_by_the_square_of_sums():
    rng = np.random.default_rng(1)
    size = quality.N_STATS + quality.BUCKETS
    model = quality.FactorisationMachine(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), 0.1, rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, quality.RANK)))
    text = "Some words, some of them again!"
    at, x = model.inputs(*quality.features(text))
    pairs = sum(model.v[i] @ model.v[j] * a * b for (i, a), (j, b) in itertools.combinations(list(zip(at, x, strict=True)), 2))
    z = model.w0 + model.w[at] @ x + pairs
    assert model.score(text) == pytest.approx(1 / (1 + np.exp(-z)))


def test_karmarkar_karp():
    rng = np.random.default_rng(3)
    for n, parts in ((0, 3), (1, 3), (7, 2), (500, 8)):
        sizes = [int(x) for x in rng.integers(1, 1000, n)]
        placed = sharding.karmarkar_karp(sizes, parts)
        sums = [sum(s for s, p in zip(sizes, placed, strict=True) if p == k) for k in range(parts)]
        assert len(placed) == n and set(placed) <= set(range(parts)) and sum(sums) == sum(sizes)
        if n == 500:
            assert max(sums) - min(sums) <= 2
    assert sorted(sum(s for s, p in zip([8, 7, 6, 5, 4], sharding.karmarkar_karp([8, 7, 6, 5, 4], 2), strict=True) if p == k) for k in (0, 1)) == [14, 16]


def test_differencing_of_partial_partitions():
    rng = random.Random(7)
    items = [[rng.randrange(1000) for _ in range(4)] for _ in range(300)] + [[5000], [7, 9]]
    placed = sharding.differenced(items, 4)
    totals = [0] * 4
    for sums, parts in zip(items, placed, strict=True):
        assert len(parts) == len(sums) == len(set(parts)), "sums that are apart stay apart"
        for x, part in zip(sums, parts, strict=True):
            totals[part] += x
    assert max(totals) - min(totals) <= 10
    assert sharding.differenced([], 3) == [] and sharding.differenced([[4]], 1) == [[0]]


@pytest.mark.parametrize(("cell", "heavy"), [(300, 20), (40, 400), (300, 700)])
def test_sharding_in_cells(spark, monkeypatch, cell, heavy):
    monkeypatch.setattr(sharding, "CELL_ITEMS", cell)
    monkeypatch.setattr(sharding, "HEAVY", heavy)
    rng = random.Random(cell)
    rows = [(i, "x" * rng.randrange(1, 400) + str(i)) for i in range(1500)] + [(5000 + i, "copy " * 30) for i in range(200)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sizes, copies = collections.Counter(), set()
    for r in got:
        sizes[r.shard] += len(r.text) + 1
        copies |= {r.shard} if r.doc_id >= 5000 else set()
    assert len(got) == len(rows) and len(copies) == 1 and len(sizes) == 8
    assert max(sizes.values()) - min(sizes.values()) <= 405, "no more than one text"


def test_sharding(spark, odd, tmp_path):
    rows = [(i, f"text number {i % 300} " * (i % 7 + 1)) for i in range(3000)] + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_report(docs).collect()
    assert len(got) == len(rows)
    slots, groups, sizes = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        groups[r.text_crc32, r["size"]].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and r["size"] in {len((t or "").encode()) + 1 for t in texts[r.doc_id]}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in groups.values())
    rest = sorted(sizes.values())[:-1]
    assert max(rest) - min(rest) < 0.02 * max(rest)
    assert sharding.shard_report(docs.limit(0)).collect() == []
    made = sharding.shard_by_bytes(odd)
    assert made.columns == [*[c for c in odd.columns if c != "shard"], "shard"] and made.count() == len(ODD)
    sharding.write_shards(docs.limit(50), str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50 and os.path.isdir(tmp_path / "s" / "shard=0")
