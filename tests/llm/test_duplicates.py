"""N-gram join and substring dedup against brute force; components; the pipeline."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import components, ngram_join, passages, units
from tidemill.llm.decontaminate import words_of


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 700)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    links = [*chain, *star, *loose, (7, 7), (9, 8), (8, 9)]
    rng.shuffle(links)
    links_between = [p for p in links if p[0] != p[1]]
    want = union_find({x for p in links_between for x in p}, links_between)
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def groups_by_hand(rows):
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    pairs = [(i, j) for k, (i, a) in enumerate(rows) for j, b in rows[:k] if a and b and 100 * len(a & b) >= 90 * len(a | b)]
    return union_find({i for i, _ in rows}, pairs)


def edited(rng, words, n):
    out = [*words]
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.random()}"
    return " ".join(out)


def corpus(seed):
    rng = random.Random(seed)
    rows = [None, "", "  \t", "one", "One", "two words", "two  words", "a a a a a a", "a a a", "x y z", "x\vy\x0bz", "\xa0nbsp here now"]
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 200]))]
        rows += [" ".join(base)] * rng.choice([1, 3])
        rows += [edited(rng, base, rng.randrange(6)) for _ in range(14)]
        rows += [edited(rng, edited(rng, base, 2).split(), 2) for _ in range(6)]
    passage = " ".join(f"p{k}" for k in range(80))
    rows += [passage + " " + " ".join(f"u{rng.random()}" for _ in range(rng.choice([3, 8, 40]))) for _ in range(25)]
    ids = [*range(len(rows))]
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want = groups_by_hand(rows)
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted((i, len(shingles(t)), want[i]) for i, t in rows)
    assert len(set(want.values())) < len(rows) - 20


def test_ngram_join_over_many_fragments_and_batches(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENT_TOKENS", 50)
    rows = corpus(3)
    want = groups_by_hand(rows)
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_ngram_join_odd_rows(spark):
    text = " ".join(map(str, range(50)))
    rows = [(1, text, "c"), (1, text, "c"), (2, text, "c"), (None, text, "c"), (3, None, "c"), (4, "", "c"), (5, "other", "c"), (5, text, "c"), (6, "w " * 30000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()), key=str)
    assert got == sorted([(1, 48, 1), (1, 48, 1), (2, 48, 1), (None, 48, None), (3, 0, 3), (4, 0, 4), (5, 1, 5), (5, 48, 1), (6, 1, 6)], key=str)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 1, None, 3, 4, 6], key=str)
    assert ngram_join.similar_documents(docs.limit(0)).collect() == []


def test_two_texts_of_one_id_both_link(spark):
    rng = random.Random(15)
    texts = {n: [f"{n}{rng.randrange(10**6)}" for _ in range(120)] for n in "ab"}
    rows = [(5, " ".join(texts["a"])), (5, " ".join(texts["b"])), (7, edited(rng, texts["a"], 1)), (8, edited(rng, texts["b"], 1)), (3, "alone here now")]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 5), (5, 5), (7, 5), (8, 5)]


def test_a_family_that_shares_much_and_links_nowhere_makes_no_pairs(spark, monkeypatch):
    rng, made, old = random.Random(16), [], ngram_join._links
    shared = " ".join(f"s{k}" for k in range(80))
    rows = [(k, shared + " " + " ".join(f"o{rng.random()}" for _ in range(6))) for k in range(60)]
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, *rest: made.append(pairs.count()) or old(pairs, *rest))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.doc_id == r.component_id for r in got) and sum(made) == 0


def sentences(rng, n, tag):
    return [" ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(rng.randrange(9, 16))).capitalize() + "." for _ in range(n)]


def test_passages(spark):
    rng = random.Random(6)
    passage = " ".join(sentences(rng, 5, "p"))
    altered = passage.replace("p", "P", 1)
    clean = [" ".join(sentences(rng, 12, f"c{k}x")) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100, clean[0] + "X"), (30, "Intro one here is. " + passage + " " + " ".join(sentences(rng, 4, "a"))), (31, " ".join(sentences(rng, 4, "b")) + " " + altered), (32, passage), (33, passage), (33, passage)]
    rows += [(40, None), (41, ""), (None, passage), (42, "short. " * 500), (43, "w " * 20000), (44, "license line of a few words only. " + " ".join(sentences(rng, 6, "d"))), (45, "license line of a few words only. " + " ".join(sentences(rng, 6, "f")))]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, spans string").repartition(4)
    got = passages.passage_report(docs).collect()
    assert {(r.doc_id, tuple(r.sources)) for r in got} == {(31, (30,)), (32, (30,)), (33, (30,)), (100, (0,))}
    texts = dict(rows)
    for r in got:
        span = texts[r.doc_id][r.start : r.stop]
        assert len(words_of(span)) == r.n_words >= passages.PASSAGE_WORDS
        if r.doc_id in (31, 32, 33):
            assert span.strip().lower() == passage.lower()
    cut = passages.remove_passages(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert left[32] == "" and left[30] == texts[30] and "P" not in left[31] and all(left[k] == clean[k] for k in range(20))
    assert passages.passage_report(docs.limit(0)).collect() == []


def test_near_passages_are_recalled(spark):
    rng = random.Random(8)
    rows, k = [], 0
    for _ in range(60):
        words = [f"v{rng.randrange(10**6)}" for _ in range(70)]
        other = [*words]
        other[rng.choice([1, 35, 68])] = "changed"
        for w in (words, other):
            rows.append((k, " ".join(w) + "."))
            k += 1
    got = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id for r in got}) >= 0.97 * k / 2
    assert all(r.sources == [r.doc_id - 1] for r in got)


def test_passages_are_found_across_other_borders(spark):
    rng = random.Random(11)
    passages_of = [[f"b{k}x{rng.randrange(10**6)}" for _ in range(60)] for k in range(4)]
    plain = lambda tag, n: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    first = [". ".join(" ".join(p[i : i + 10]) for i in range(0, 60, 10)) for p in passages_of]
    rows = [(k, " ".join(plain("a", 15)) + ". " + t + ". " + " ".join(plain("a", 15))) for k, t in enumerate(first)]
    shapes = [" ".join, lambda p: "\n".join(" ".join(p[i : i + 7]) for i in range(0, 60, 7)), lambda p: ", ".join(p), lambda p: "; ".join(" ".join(p[i : i + 13]) for i in range(0, 60, 13))]
    rows += [(10 + k, " ".join(plain("c", 20)) + " " + shape(p) + " " + " ".join(plain("c", 20))) for k, (shape, p) in enumerate(zip(shapes, passages_of, strict=True))]
    got = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.first_word, r.n_words, tuple(r.sources)) for r in got) == [(10 + k, 20, 60, (k,)) for k in range(4)]
    texts = dict(rows)
    assert all(words_of(texts[r.doc_id][r.start : r.stop]) == [w.encode() for w in passages_of[r.doc_id - 10]] for r in got)


def test_passages_with_a_replaced_word_are_found_whole(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(40):
        passage = sentences(rng, 5, f"q{k}x")
        words = " ".join(passage).split()
        at = rng.randrange(6, len(words) - 6)
        other = [*words[:at], "replaced" + "." * words[at].endswith("."), *words[at + 1 :]]
        rows += [(2 * k, " ".join(passage)), (2 * k + 1, " ".join(sentences(rng, 3, "r")) + " " + " ".join(other) + " " + " ".join(sentences(rng, 3, "s")))]
        want[2 * k + 1] = (len(words), (2 * k,))
    got = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, (r.n_words, tuple(r.sources))) for r in got) == sorted(want.items())


@pytest.mark.parametrize("seed", range(40))
def test_covered_spans_equal_brute_force(seed):
    rng, k, percent, least = random.Random(seed), units.WORDS, 80, 30
    starts, at = [], 0
    for _ in range(rng.randrange(1, 12)):
        at += rng.randrange(1, 18)
        n = rng.choice([1, 2, 8, 30, 90])
        starts += range(at, at + n)
        at += n
    pieces, want = [], set()
    for w in sorted({w + x for w in starts for x in range(k)}):
        if pieces and pieces[-1][1] == w:
            pieces[-1][1] = w + 1
        else:
            pieces.append([w, w + 1])
    for i in range(len(pieces)):
        for j in range(i, len(pieces)):
            gaps = [pieces[x + 1][0] - pieces[x][1] for x in range(i, j)]
            credit = sum(min(b - a, units.CREDIT) for a, b in pieces[i : j + 1])
            if max(gaps, default=0) <= units.GAP and 100 * credit >= percent * (credit + sum(gaps)) and pieces[j][1] - pieces[i][0] >= least:
                want |= set(range(pieces[i][0], pieces[j][1]))
    got = units.covered_spans(np.array(starts), least, percent)
    assert {w for a, b in got for w in range(a, b)} == want


@pytest.mark.parametrize("seed", range(20))
def test_edits_equal_the_table_of_distances(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(90))] for _ in range(2))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert units.edits(a, b) == row[-1]


def test_long_words_are_compared_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 32, 9000).astype("<u4")
    b = np.delete(a, [10, 4000, 8000])
    for piece in (300, 20_000):
        monkeypatch.setattr(passages, "PIECE", piece)
        assert passages.shared_passages(a, b, 40, 80) == [(0, 9000, 0, 8997)]
    assert not passages.alike(a[:200], rng.permutation(a[:200]), 80)


def test_moved_halves_are_found_apart():
    a = np.random.default_rng(4).integers(0, 1 << 32, 600).astype("<u4")
    assert sorted(passages.shared_passages(a, np.concatenate([a[305:], a[:305]]), 40, 80)) == [(0, 305, 295, 600), (305, 600, 0, 295)]


@pytest.mark.parametrize("share", [0.01, 0.02, 0.05])
def test_passages_with_changed_words_are_recalled(spark, share):
    rng, rows, found = random.Random(share), [], 0
    for k in range(80):
        text = sentences(rng, rng.randrange(5, 12), f"e{k}x")
        words = " ".join(text).split()
        other = [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]
        rows += [(2 * k, " ".join([*sentences(rng, 2, "r"), *words])), (2 * k + 1, " ".join([*sentences(rng, 3, "s"), *other, *sentences(rng, 2, "t")]))]
    rows += [(k, " ".join(sentences(rng, 20, "u"))) for k in range(1000, 1100)]
    got = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {r.doc_id for r in got if r.sources == [r.doc_id - 1]}
    assert {r.doc_id for r in got} == found and len(found) >= 0.95 * 80


def test_repeats_of_a_whole_table_equal_brute_force(spark, sf_dir):
    """Every 50 equal words in a row of a smaller doc_id are in a passage; words that are in no
    run of five words of another document are in none, but for the bridged ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, units.units_of(r.text)) for r in docs.collect())
    spans = collections.defaultdict(set)
    for r in passages.passage_report(docs).collect():
        spans[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    seen, runs, want, hit, loose = {}, collections.defaultdict(set), 0, 0, 0
    for i, words in rows:
        for k in range(len(words) - 4):
            runs[tuple(words[k : k + 5])].add(i)
    for i, words in rows:
        old = set()
        for k in range(len(words) - 49):
            key = tuple(words[k : k + 50])
            if seen.setdefault(key, i) < i and len(set(key)) > 10:
                old |= set(range(k, k + 50))
        want, hit = want + len(old), hit + len(old & spans[i])
        covered = {k + x for k in range(len(words) - 4) if len(runs[tuple(words[k : k + 5])]) > 1 for x in range(5)}
        loose += len(spans[i] - covered)
    assert hit >= 0.99 * want and want and loose <= 0.2 * sum(map(len, spans.values()))


def test_components_name_the_kept_document(spark):
    rng = random.Random(14)
    words = [f"g{k}x{rng.randrange(10**6)}" for k in range(90)]
    second = [*words[:30], *(f"h{k}" for k in range(8)), *words[38:]]
    third = [*second[:60], *(f"i{k}" for k in range(8)), *second[68:]]
    rows = [(3, " ".join(words)), (5, " ".join(second)), (7, " ".join(third)), (8, " ".join(third)), (9, " ".join(third))]
    got = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.first_word, r.n_words, tuple(r.sources)) for r in got) == [(k, 0, 90, (3,)) for k in (5, 7, 8, 9)]


def test_passages_are_found_beside_smaller_documents_that_share_less(spark):
    """Each paragraph of a passage also stands in a smaller document, which is like none of the others:
    30 words of the passage, too few; of the first passages a document of their own repeats itself."""
    rng = random.Random(23)
    other = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(6):
        passage = [f"p{k}y{j}z{rng.randrange(10**6)}" for j in range(60)]
        rows += [(100 * k + j, " ".join(other(70) + passage[15 * j : 15 * j + 30] + other(70))) for j in range(3)]
        if k < 2:
            rows.append((100 * k + 10, " ".join(passage[:30] + other(70) + passage[15:45] + other(70) + passage[30:] + other(70) + passage)))
        else:
            rows.append((100 * k + 10, " ".join(other(20) + passage + other(20))))
        rows += [(100 * k + 20 + j, " ".join(other(10 * j + 5) + passage + other(30))) for j in range(3)]
        want |= {(100 * k + 20 + j, 10 * j + 5, 60, (100 * k + 10,)) for j in range(3)}
    got = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, r.first_word, r.n_words, tuple(r.sources)) for r in got} == want


def test_a_phrase_of_many_documents_builds_few_pairs(spark, monkeypatch):
    rng = random.Random(24)
    other = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    phrase = [f"p{k}" for k in range(28)]
    rows = [(k, " ".join(other(60) + phrase + other(60))) for k in range(400)]
    ends = other(30)
    rows += [(1000 + k, " ".join(other(60) + phrase + ends[:2] + other(60))) for k in range(30)] + [(2000 + k, " ".join(other(60) + phrase + ends + other(60))) for k in range(30)]
    rows += [(500, " ".join(other(60) + phrase[20:] + ends[:20])), (501, " ".join(ends[8:] + other(60)))]
    held, staged = [], passages.staged

    def counted(df, name="table"):
        out = staged(df, name)
        if name == "held":
            held.append(out.count())
        return out

    monkeypatch.setattr(passages, "staged", counted)
    got = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, r.first_word, r.n_words, tuple(r.sources)) for r in got} == {(2000 + k, 60, 58, (2000,)) for k in range(1, 30)}
    assert held and sum(held) < 4 * len(rows)


def test_shingles_of_the_same_documents_make_one_group(spark, monkeypatch):
    rng = random.Random(25)
    other = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    phrase, ends = [f"p{k}" for k in range(28)], other(30)
    rows = [(k, " ".join(other(60) + phrase + other(60))) for k in range(3)] + [(10 + k, " ".join(other(60) + phrase + ends + other(60))) for k in range(7)]
    made, staged = [], passages.staged

    def counted(df, name="table"):
        out = staged(df, name)
        if name == "groups":
            made.append(out.count())
        return out

    monkeypatch.setattr(passages, "staged", counted)
    got = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, r.first_word, r.n_words, tuple(r.sources)) for r in got} == {(10 + k, 60, 58, (10,)) for k in range(1, 7)}
    assert 7 <= sum(made) <= 3 * len(rows)


def test_pairs_held_together_are_as_each_alone():
    rng = np.random.default_rng(26)
    mine = [rng.integers(0, 50, n).astype("<u4") for n in (0, 3, 5, 90, 140, 4, 70)]
    there = [np.concatenate([rng.integers(60, 90, 9), x[len(x) // 3 :], x[:9]]).astype("<u4") for x in mine]
    there[3] = there[3][:0]
    low, high = np.array([-np.inf, 0, -40, -np.inf, -30, 0, 5]), np.array([np.inf, 0, 0, np.inf, -25, 0, 5])
    begins, a, whole, starts, places = passages._shared_of(mine, there)
    beyond = passages._beyond(begins, a, whole, starts, places, low, high).to_pylist()
    for k, edges in enumerate(zip(begins, np.append(begins[1:], len(a)), strict=True)):
        shingles, at, to = passages._shared(mine[k], there[k])
        here = (starts >= edges[0]) & (starts < edges[1])
        assert (starts[here] - edges[0]).tolist() == at.tolist() and places[here].tolist() == to.tolist()
        near = {i for x in at for i in range(max(x - units.GAP - units.WORDS, 0), min(x + units.GAP + units.WORDS + 1, len(shingles)))}
        same = {int(x) for x, y in zip(at, to, strict=True) if low[k] - units.GAP <= y - x <= high[k] + units.GAP}
        assert set(beyond[k]) == {int(np.int32(np.uint32(int(shingles[i]) >> 32).view(np.int32))) for i in near - same} and len(set(beyond[k])) == len(beyond[k])


def test_passages_of_short_lines_and_of_scripts_without_spaces(spark):
    rng = random.Random(13)
    lines = "\n".join(" ".join(f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 5))) for _ in range(25))
    han = "。".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9)) for _ in range(6)) + "。"
    other = han.replace("。", "，")
    rows = [(1, lines), (2, "Start. " + lines + "\nend"), (3, lines), (4, han), (5, "前文" + other), (6, "menu " * 3)]
    got = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = len(words_of(lines))
    assert sorted((r.doc_id, r.first_word, r.n_words, tuple(r.sources)) for r in got) == [(2, 1, n, (1,)), (3, 0, n, (1,)), (5, 2, 54, (4,))]
    assert next(r.stop - r.start for r in got if r.doc_id == 5) == len(other)


def test_units_have_their_places():
    for text in ["", "Ab-c d\u2019e", "日本語の文。Next one, naïve\u00a0é！三", "\ud800x ไทย1ก"]:
        at = units.unit_places(text).tolist()
        found = [u.decode("utf-8", "surrogatepass") for u in units.units_of(text)]
        assert len(at) == len(found) and all(text[k:].lower().startswith(u) for k, u in zip(at, found, strict=True))


def test_bands_find_similar_sets():
    s, b, r = 0.8, passages.BANDS, passages.ROWS
    assert 1 - (1 - s**r) ** b > 0.95
    rng = np.random.default_rng(5)
    for _ in range(300):
        words = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        other = np.concatenate([rng.integers(0, 1 << 63, 50).astype(np.uint64), words[200:223], rng.integers(0, 1 << 63, 50).astype(np.uint64)])
        assert set(passages.paragraph_keys(words, np.array([400]))[1][0].tolist()) & set(passages.paragraph_keys(other, np.array([len(other)]))[1][0].tolist())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "\n")], "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = docs.unionByName(odd)
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, sf_dir), name)
        rows = out.collect()
        if name != "tokens":
            assert out.columns == columns
        assert {r.doc_id for r in rows} <= set(before)
        if name == "lines":
            assert {r.doc_id for r in rows} == set(before) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        elif name != "tokens":
            assert all(r.text == before[r.doc_id] for r in rows)
        if name == "near_duplicates":
            want = groups_by_hand(list(before.items()))
            assert {r.doc_id for r in rows} == {i for i, c in want.items() if i == c}
        before, docs = ({r.doc_id: r.text for r in rows} if name != "tokens" else before), out
    assert len(rows) == len(before)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, spark.createDataFrame([], spark.read.parquet(f"{sf_dir}/documents.parquet").schema), sf_dir).collect() == []


def test_spread_of_a_hot_group(spark):
    rng = random.Random(9)
    base = [f"h{rng.randrange(900)}" for _ in range(150)]
    rows = [(k, edited(rng, base, rng.randrange(5))) for k in range(120)] + [(k, " ".join(base)) for k in range(200, 260)]
    want = groups_by_hand(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(collections.Counter(want.values())) > 1
