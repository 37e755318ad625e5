"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import base64
import collections
import hashlib
import random
import re
import struct
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontam, langid, ngram_join, order, paragraphs, shards, suffix, syncmers, token_counts, urls
from sparkloom.llm.fmindex import FMIndex
from sparkloom.llm.graph import components
from sparkloom.ship import ship

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LOW = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, id string, key int, spans int, n int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [(k, words(rng.randint(1, 120)).capitalize() + ".\n" + words(40)) for k in range(40)]
    shared = words(60)
    out += [(50 + k, words(20) + "\n" + shared + "\n" + words(10)) for k in range(4)]
    base = words(90).split()
    for k in range(6):  # near copies
        edit = list(base)
        for _ in range(k):
            edit[rng.randrange(len(edit))] = "x" + str(k)
        out.append((60 + k, " ".join(edit)))
    out += [(70, out[3][1]), (71, out[3][1]), (72, None), (73, ""), (74, "  \n\t"), (75, "a" * 700), (76, "one two"), (77, "One  two"), (78, "é" * 300 + " ünï"), (None, words(30)), (None, None), (79, words(6000)), (80, out[5][1]), (80, out[5][1])]
    return out


@pytest.fixture
def docs(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, width):
    w = words_of(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = roots({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in expected.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_paragraphs(docs, empty, rows):
    out = paragraphs.substring_dedup(docs, min_words=25)
    assert set(out.columns) == {*docs.columns, "_n_paragraphs", "_removed"}
    got = {(r.doc_id, r.text): (r._n_paragraphs, r._removed) for r in out.collect()}
    by_id = collections.defaultdict(list)
    for (i, _), (_, gone) in got.items():
        by_id[i].append(gone)
    assert by_id[50] == [[]] and by_id[51] == by_id[52] == by_id[53] == [[1]]
    assert by_id[70] == by_id[71] and by_id[3] == [[]] and 1 in by_id[70][0]
    assert got[(72, None)][0] == 0 and got[(73, "")] == (1, [])
    lines = [(i, k, line) for i, t in sorted({x for x in rows if x[0] is not None and x[1]}) for k, line in enumerate(t.split("\n")) if len(words_of(line)) >= 25]
    for (i, k, a), (j, m, b) in combinations(lines, 2):  # each pair at 0.8 and no other
        x, y = shingles(a, 5), shingles(b, 5)
        if 100 * len(x & y) >= 80 * len(x | y):
            assert m in by_id[j][0], (i, k, j, m)
    runs = lambda t: {tuple(w[k : k + 25]) for w in [words_of(t)] for k in range(len(w) - 24)}
    for j, gone in ((i, g) for i, each in by_id.items() if i is not None for g in each):
        text = next(t for i, t in rows if i == j and t is not None) if gone else ""
        for m in gone:  # and no other: what goes is like a paragraph before it, or shares a passage with a row of a smaller id
            b = text.split("\n")[m]
            like = any((i, k) < (j, m) and 100 * len(shingles(a, 5) & shingles(b, 5)) >= 80 * len(shingles(a, 5) | shingles(b, 5)) for i, k, a in lines)
            assert like or any(i is not None and i < j and runs(t) & runs(text) for i, t in rows), (j, m)
    assert paragraphs.substring_dedup(empty).count() == 0


def test_passages_whatever_the_lines(spark):
    ship(spark)
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, broken = words(60), words(60)
    edited = [*passage[:30], "edited", *passage[31:]]
    lines = lambda w: "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))
    own = {k: (words(70), words(80)) for k in range(7)}
    texts = [" ".join(own[k][0] + passage + own[k][1]) for k in (0, 1)]  # inside a longer line
    texts += [" ".join(own[k][0]) + "\n" + lines(broken) + "\n" + " ".join(own[k][1]) for k in (2, 3)]  # over lines of 12 words
    texts.append(" ".join(own[4][0] + broken + own[4][1]))  # one of each kind
    texts.append(" ".join(own[5][0] + edited + own[5][1]))  # one word of 60 differs: 0.84 of the shingles
    texts.append(" ".join(own[6][0] + own[6][1]))
    got = {r.doc_id: r for r in paragraphs.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].text for k in (0, 2, 6)] == [texts[k] for k in (0, 2, 6)] and [got[k]._removed for k in (0, 2, 6)] == [[], [], []]
    for k in (1, 3, 4, 5):
        left = got[k].text.split()
        assert sum(w in {*passage, *broken} for w in left) <= (10 if k != 5 else 35), (k, left)
        assert [w for w in left if w in {*own[k][0], *own[k][1]}] == own[k][0] + own[k][1] and got[k]._removed
    assert got[3]._n_paragraphs == 7 and set(got[3]._removed) <= set(range(1, 6)) and len(got[3]._removed) >= 5


@pytest.mark.parametrize("leaf", [5, 64, 4096])
def test_bpe_tree(rows, leaf):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = bpe._sizes(RANKS, public_tokenizers.PATTERN)
    odd = ["it's  we'll\n\n  x", " \t\n a1b2 c", "日本語 テスト 12 34", "\u00a0a\u2003b  ", "😀 a😀b", "'s 's", "a" * 900, "9" * 500 + " " * 77]
    for t in [t for _, t in rows if t] + odd:
        ids = bpe.encode_tree(t, enc.encode_ordinary, sizes.__getitem__, leaf)
        assert ids == enc.encode_ordinary(t)
        assert bpe.decode_tree(ids, enc.decode_bytes, 7) == t.encode()


def test_places_that_no_match_crosses():
    """Random texts of every kind of character, cut into small leaves, and long texts without blanks, whose joins stay short."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = bpe._sizes(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(17)
    kinds = ["ab's", "'tll've", "059", "²½Ⅷ٣", " \t\n\u00a0\u3000", "。，！「」", ".,!_-$", "漢字かなカナ", "éÜßøΩя", "한국어", "\u0301\u200d", "😀🏽"]
    for _ in range(400):
        t = "".join("".join(rng.choices(rng.choice(kinds), k=rng.randint(1, 4))) for _ in range(rng.randint(1, 40)))
        assert bpe.encode_tree(t, enc.encode_ordinary, sizes.__getitem__, 3) == enc.encode_ordinary(t), repr(t)
    longest = []
    def encode(x):
        longest.append(len(x))
        return enc.encode_ordinary(x)
    han = "".join(chr(0x4E00 + rng.randrange(5000)) + "，" * (rng.random() < 0.1) for _ in range(60_000))
    base = base64.b64encode(rng.randbytes(60_000)).decode()
    for t in (han, base):
        assert bpe.encode_tree(t, encode, sizes.__getitem__) == enc.encode_ordinary(t)
    assert max(longest) <= bpe.LEAF_CHARS


def test_round_trip(docs, empty, rows):
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_syncmers(docs, empty, rows, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 7)
    got = syncmers.edited(docs).collect()
    assert len(got) == len(rows)
    known = sorted(((i, t or "") for i, t in rows if i is not None))
    full = sorted(((t or "") for i, t in rows if i is None), key=str)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for k, (i, t) in enumerate(known[:-1]):
        q = len(t) // 4
        want = hashlib.sha256((t[: len(t) - q] + known[k + 1][1][:q]).encode()).hexdigest()
        assert want in {r.edited_sha256 for r in by_id[i]}
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in by_id[i])
    assert by_id[70][0].fingerprint == by_id[71][0].fingerprint == by_id[3][0].fingerprint
    assert by_id[70][0].near_next == 1.0 and by_id[79][0].near_edited > 0.5 and len(full) == 2
    assert syncmers.edited(empty).count() == 0


def plain_anchors(text):
    """Closed syncmers by their definition: (place, hash) of the symbols' 5-mers whose least inner 2-mer is the first or the last."""
    long = lambda x: (x + 2**63) % 2**64 - 2**63
    of_text = lambda t: long(xxhash.xxh64(t.encode(), seed=42).intdigest())

    def of_longs(*xs):
        seed = 42
        for x in xs:
            seed = xxhash.xxh64(struct.pack("<q", x), seed=seed % 2**64).intdigest()
        return long(seed)

    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    h = [of_text(s) for w in words for s in ([w] if len(w) <= 24 else list(w))]
    out = []
    for k in range(len(h) - 4):
        inner = [of_longs(h[j], h[j + 1]) for j in range(k, k + 4)]
        if min(inner[0], inner[3]) <= min(inner[1:3]):
            out.append((k, of_longs(*h[k : k + 5]) >> 32))
    return out or ([(0, of_longs(*h) >> 32)] if h else [])


def test_fingerprints_by_their_definition(docs, rows):
    hanzi = "".join(chr(0x4E00 + (k * 7919) % 5000) for k in range(400))
    spark = docs.sparkSession
    odd = [(200, hanzi), (201, hanzi[:300] + " end"), (202, "x" * 24 + " " + "y" * 25 + " z"), (203, "")]
    table = {i: t or "" for i, t in [*rows, *odd] if i is not None}
    got = {r.doc_id: r for r in syncmers.edited(spark.createDataFrame(list(table.items()), "doc_id long, text string")).collect()}
    ids = sorted(table)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        q = len(table[i]) // 4
        new = table[i][: len(table[i]) - q] + table[j][:q]
        a, b, c = ([x & 0xFFFFFFFF for _, x in plain_anchors(t)] for t in (table[i], new, table[j]))
        like = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) if {*x} | {*y} else 1.0
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(table[i]), "".join(f"{x:08X}" for x in a), "".join(f"{x:08X}" for x in b)), i
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
    assert got[200].near_edited > 0.5 and len(got[200].fingerprint) > 400


def test_ranges_grow_slower_than_the_table():
    n = [order.n_ranges(r) for r in (0, 999, 10_000, 4_096_000, 16_384_000, 30_000_000_000)]
    assert n[:4] == [1, 1, 10, 4096] and n[4] == 8192 and n[5] < 400_000


def test_syncmers_are_context_free(spark):
    rng = random.Random(3)
    inner = " ".join(f"w{rng.randrange(99)}" for _ in range(50))
    df = spark.createDataFrame([(inner,), ("a b c d e f " + inner + " g h",)], "t string").select(syncmers.anchors(F.col("t")).alias("a"))
    x, y = (r.a for r in df.collect())
    assert [h.hash for h in x] == [h.hash for h in y if 6 <= h.pos <= 6 + 45]
    pairs = spark.createDataFrame([(inner, "a b c d e f " + inner)], "t string, u string").select(syncmers.matches(syncmers.anchors(F.col("t")), syncmers.anchors(F.col("u"))).alias("m")).first().m
    assert pairs and all(p.pos_b == p.pos_a + 6 for p in pairs)


def test_short_texts_have_fingerprints(spark):
    texts = [" ".join(f"w{n}x{k}x{j}" for j in range(n)) for n in range(1, 9) for k in range(40)] + ["", " \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", syncmers.hashes(syncmers.anchors(F.col("t"))).alias("h"))
    got = {r.t: tuple(r.h) for r in df.collect()}
    assert got[""] == got[" \n"] == () and all(got[t] for t in texts if t.split())
    assert len({got[t] for t in texts if t.split()}) == 320  # no two of these texts share a word
    a, b = df.select("h"), df.select(F.col("h").alias("g"), "t")
    assert a.crossJoin(b.where("t like 'w5x0x%'")).where(syncmers.likeness(F.col("h"), F.col("g")) == 1.0).count() == 1


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 50)])
def test_ngram_jaccard(docs, empty, rows, width, percent):
    got = ngram_join.ngram_jaccard(docs, width, percent).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    edges = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expected = roots(sets, edges)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id]), r
    assert ngram_join.ngram_jaccard(empty).count() == 0


def test_rows_of_one_id_link_by_their_own_texts(spark):
    ship(spark)
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, a), (5, b), (7, a + " x"), (9, b + " y"), (None, a), (None, "only here and nowhere else"), (None, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.component_id is not None)
    assert got == [(0, 27, 5), (5, 27, 5), (5, 27, 5), (7, 28, 5), (9, 28, 5)]


def test_ngram_links(docs, rows):
    got = ngram_join.ngram_jaccard(docs.where("doc_id is not null"), 2, 50, count_links=True).collect()
    sets = {i: frozenset(shingles(t, 2)) for i, t in rows if i is not None}
    different = set(sets.values())
    n_links = {s: sum(bool(s and o and s != o and 100 * len(s & o) >= 50 * len(s | o)) for o in different) for s in different}
    assert {r.doc_id: r.n_links for r in got} == {i: n_links[s] for i, s in sets.items()} and max(n_links.values()) > 2
    plain = ngram_join.ngram_jaccard(docs.where("doc_id is not null"), 2, 50).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(map(tuple, plain))


def test_shards(docs, empty, rows):
    got = shards.shard(docs, shards=4, slots=64).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for s in range(4):
        places = sorted(r.slot for r in got if r.shard == s)
        assert places == list(range(len(places)))
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    load, slots = collections.Counter(), collections.Counter()
    for r in got:
        load[r.shard] += r["size"]
        slots[r.vslot] += r["size"]
    # near equal bytes: no more apart than the largest slot, and no shard holds more than its share and that
    assert max(load[s] for s in range(4)) - min(load[s] for s in range(4)) <= max(slots.values())
    assert shards.shard(empty).count() == 0


def test_rebalance_moves_little():
    rng = random.Random(2)
    sizes = {k: rng.randrange(50, 150) for k in range(400)}
    old = shards.assign(sizes, 8)
    new = shards.rebalance(old, sizes, 9)
    load = collections.Counter()
    for k, s in new.items():
        load[s] += sizes[k]
    assert all(new[k] == old[k] or new[k] == 8 for k in sizes)
    assert max(load.values()) - min(load.values()) < 400
    fewer = shards.rebalance(old, sizes, 7)
    assert all(fewer[k] == old[k] for k in sizes if old[k] < 7)


def test_slot_map_versions(spark):
    m = shards.SlotMap(spark)
    m.write(1, {0: 1, 1: 0})
    m.write(2, {0: 1, 1: 2})
    assert {r.vslot: r.shard for r in m.read(1).collect()} == {0: 1, 1: 0} and {r.vslot: r.shard for r in m.read(2).collect()} == {0: 1, 1: 2}
    with pytest.raises(Exception, match="exist"):
        m.write(1, {0: 0})


def test_fm_index():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = FMIndex(text, sample=5)
    patterns = np.array([p for p in np.ndindex(4, 4, 4) if 0 not in p], np.int64)
    lo, hi = index.search(patterns, np.full(len(patterns), 3))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        places = sorted(index.locate(np.arange(a, b)).tolist())
        assert places == [k for k in range(len(text) - 2) if (text[k : k + 3] == p).all()]


@pytest.mark.parametrize("block,most", [(200_000, 16), (60, 16), (60, 1)])
def test_contamination(spark, docs, empty, rows, block, most, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(decontam, "PASS_BLOCKS", most)
    rng = random.Random(8)
    items = []
    for k in range(8):
        w = words_of(rows[k][1])
        items.append((k, " ".join(w[3 : 3 + rng.randint(8, 30)]).upper()))
    items += [(100, "one two"), (101, None), (102, ""), (None, "one"), (103, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: rx.findall((t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    expected = collections.defaultdict(list)
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        expected[i].append((len(w), len(hit), sorted(found)))
    got = [(str(r.id), r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), r["items"]) for r in decontam.contamination(docs, bench).collect()]
    assert sorted(got) == sorted((str(i), *e) for i, each in expected.items() for e in each)
    clean = decontam.decontaminate(docs, bench)
    left = [(str(r.doc_id), len(split(r.text))) for r in clean.collect()]
    assert sorted(left) == sorted((str(i), n - hit) for i, each in expected.items() for n, hit, _ in each)
    assert clean.columns == docs.columns and clean.where("doc_id = 72").first().text is None
    assert clean.where("doc_id = 79").first().text == dict(rows)[79]
    assert decontam.contamination(empty, bench).count() == 0 and decontam.contamination(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


@pytest.mark.parametrize("block,most", [(200_000, 16), (3, 16), (3, 2)])
def test_contamination_has_a_row_for_each_row(spark, block, most, monkeypatch):
    ship(spark)
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(decontam, "PASS_BLOCKS", most)
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon zeta"), (3, "gamma delta")], "item_id long, text string")
    rows = [(None, "x alpha beta gamma y"), (None, "x delta epsilon zeta y"), (None, "one two three four five"), (7, "alpha beta gamma delta"), (7, "one two three four"), (8, "gamma delta"), (8, "gamma delta")]
    got = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    found = sorted((r.id or 0, r.n_words, [(s["first"], s["last"]) for s in r.spans], r["items"]) for r in got)
    assert found == sorted([(0, 5, [(1, 3)], ["1"]), (0, 5, [(1, 3)], ["2"]), (0, 5, [], []), (7, 4, [(0, 3)], ["1", "3"]), (7, 4, [], []), (8, 2, [(0, 1)], ["3"]), (8, 2, [(0, 1)], ["3"])])


@pytest.mark.parametrize("length", [65, 70, 200, 331])
def test_suffixes_of_a_block_are_sorted(length):
    """Against plain comparison, on bytes that repeat at any distance: ties reach beyond the first bytes, the cover's ranks and the words after them."""
    assert {(a - b) % 31 for a in suffix.COVER for b in suffix.COVER} == set(range(31))
    rng = np.random.default_rng(length)
    pieces = [rng.integers(97, 99, 400, dtype=np.uint8) for _ in range(3)]
    for k in range(12):
        more = np.concatenate([pieces[k % 3][rng.integers(0, 50) :], rng.integers(97, 99, rng.integers(1, 60), dtype=np.uint8), pieces[k % 2]])
        more[rng.integers(0, len(more))] = 120
        pieces.append(more)
    pieces.append(np.full(500, 97, np.uint8))
    raw, ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
    start = np.concatenate([np.arange(e - len(p), e - length + 1) for p, e in zip(pieces, ends, strict=True)])
    bucket = start % 2
    count = collections.Counter((b, raw[s : s + length].tobytes()) for s, b in zip(start, bucket, strict=True))
    expected = [count[b, raw[s : s + length].tobytes()] > 1 for s, b in zip(start, bucket, strict=True)]
    assert suffix.repeated(raw, bucket, start, length).tolist() == expected and 0 < sum(expected) < len(expected)


@pytest.mark.parametrize("big", [20_000, 2])
@pytest.mark.parametrize("length", [200, 70])
def test_suffix_dedup(docs, empty, rows, big, length, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_ROWS", big)
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    expected = collections.defaultdict(list)
    for i, b in texts:
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                cover[k : k + length] = b"\x01" * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        expected[i].append((len(b), sum(cover), len(re.findall(rb"\x01+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    got = suffix.suffix_dedup(docs, length).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) in expected[r.doc_id], r.doc_id
    assert suffix.suffix_dedup(empty, length).count() == 0


def test_language_id(spark, empty):
    ship(spark)
    rng = random.Random(6)
    stems = {"aa": ["the", "and", "ing", "tion", "er"], "bb": ["der", "und", "sch", "keit", "zu"], "cc": ["qué", "ción", "los", "ñar", "es"]}
    make = lambda k: " ".join("".join(rng.choices(stems[k], k=2)) for _ in range(60))
    train = spark.createDataFrame([(n, make(k), k) for n, k in enumerate(list(stems) * 40)] + [(999, None, "aa"), (998, "x", None)], "doc_id long, text string, lang string")
    filters = langid.learn(train)
    test = spark.createDataFrame([(n, make(k), k) for n, k in enumerate(list(stems) * 20)] + [(900, None, "und"), (901, "", "und"), (902, "12 .. 3", "und")], "doc_id long, text string, lang string")
    got = langid.predict(test, filters).collect()
    assert all(r._lang == r.lang and 0 <= r._score <= 1 for r in got)
    assert langid.predict(test.limit(3), langid.learn(train.limit(0))).where("_lang <> 'und'").count() == 0
    assert langid.predict(empty, filters).count() == 0


def test_language_scores_are_shares_of_ngrams(spark):
    """Against plain sets of n-grams: the filters' false positives are taken off."""
    ship(spark)
    rng = random.Random(9)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(80))
    train = [(n, make(k), k) for n, k in enumerate(["abcdefgh", "efghijkl", "qrstuvwx"] * 30)]
    table = spark.createDataFrame(train, "doc_id long, text string, lang string")
    filters = langid.learn(table)
    grams = lambda t: [w[k : k + 5] for w in [" " + t + " "] for k in range(len(w) - 4)]
    count = {k: collections.Counter(g for _, t, lang in train if lang == k for g in grams(t)) for k in filters.languages}
    held = {k: {g for g, n in c.items() if n >= langid.LEAST} for k, c in count.items()}
    test = [(n, make(k)) for n, k in enumerate(["abcdefgh", "efghijkl", "qrstuvwx", "abcdefghijkl"] * 10)]
    for r in langid.predict(spark.createDataFrame(test, "doc_id long, text string").withColumn("_lang", F.lit(1)), filters).collect():
        share = {k: sum(g in s for g in grams(r.text)) / len(grams(r.text)) for k, s in held.items()}
        assert r._score == pytest.approx(max(share.values()), abs=0.03) and share[r._lang] >= max(share.values()) - 0.03


def test_held_out_accuracy(spark):
    from pathlib import Path

    from sparkloom.llm import queries

    sf = Path("/root/testdata/sf0.01")
    if not sf.exists():
        pytest.skip("no test tables")
    told = queries.op8_language_id(spark, str(sf)).join(spark.read.parquet(str(sf / "documents.parquet")).select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_sample_of_long_texts_is_bounded(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 40_000)
    train = spark.createDataFrame([(n, f"{'ab cd ef ' if n % 2 else 'xy zw uv '}" * 400, "a" if n % 2 else "b") for n in range(60)], "doc_id long, text string, lang string")
    assert langid.learn(train).languages == ["a", "b"]


def test_trees_as_columns_are_the_trees(spark):
    rng = random.Random(3)
    made = [(f"http{'s' * rng.randint(0, 1)}://h{rng.randrange(9)}.{rng.choice(['com', 'net', 'org'])}/{'a/' * rng.randint(0, 4)}{rng.randrange(10**rng.randint(1, 6))}", 0) for _ in range(600)]
    rows = [(u, int(u.count("/") > 4 or u.startswith("https"))) for u, _ in made]
    model = urls.train(spark.createDataFrame(rows[:400], "url string, blocked int"))
    tested = spark.createDataFrame(rows[400:], "url string, blocked int").withColumn("_host", F.lit("mine")).withColumn("x", F.lit(1))
    out = urls.judge(tested, model, []).collect()
    assert set(out[0].asDict()) == {"url", "blocked", "x", "_host", "_path", "_rule", "_verdict", "_score"} and all(r._host.startswith("h") for r in out)
    right = sum((r._verdict == "block") == bool(r.blocked) for r in out) / len(out)
    assert right > 0.95
    hosted = tested.select("url", urls.host(F.col("url")).alias("h"), urls.path(F.col("url")).alias("p"))
    rated = urls.with_rates(hosted, "h", "p", model.rates, model.prior)
    x = urls.features(F.col("url"), F.col("h"), F.col("p")) | urls.rate_features()
    data = rated.select("url", *[c.alias(k) for k, c in x.items()]).toPandas().drop_duplicates("url").set_index("url")
    total = model.base + sum(t.predict(data.to_numpy(float)) for t in model.trees)
    plain = dict(zip(data.index, 1 / (1 + np.exp(-total)), strict=True))
    assert all(r._score == pytest.approx(plain[r.url]) for r in out)


def test_url_rules(spark):
    urls_ = ["http://A.Example.com/en/7?x", "https://net/de/", "http://xnet/de/", "ftp://b.example.net/de/81#k", "http://example.org/es", "nothing", None, "x://h://com/en/1", "http://com/en/", "http://q.com?/en/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls_)], "page_id long, url string")
    model = urls.train(urls.labelled_by_rules(pages, urls.RULES))
    got = {r.page_id: (r._host, r._path, r._rule) for r in urls.judge(pages, model, urls.RULES).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7") and got[1] == ("net", "/de/", "net/de/") and got[2][2] is None
    assert got[3] == ("b.example.net", "/de/81", "example.net/de/8") and got[4] == ("example.org", "/es", None)
    assert got[5] == got[6] == ("", "", None) and got[7][0] == "h:" and got[8][2] == "com/en/" and got[9][:2] == ("q.com", "")


def test_url_rates_of_all_suffixes(spark):
    rows = [(f"http://h{k}.s{k}/p{k}/{n}", k % 2) for k in range(100) for n in range(3)]
    model = urls.train(spark.createDataFrame(rows, "url string, blocked int"))
    rates = {r.k: r.rate for r in model.rates.collect()}
    assert rates == {f"{c}{k}": pytest.approx((3 * (k % 2) + 2.5) / 8) for k in range(100) for c in (".s", "/p")}
    assert set(urls.judge(spark.createDataFrame([(u,) for u, _ in rows], "url string"), model, urls.RULES).columns) == {"url", "_host", "_path", "_rule", "_verdict", "_score"}


def test_boosted_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    base, trees = urls.boost(x[:1500], y[:1500])
    score = base + sum(t.predict(x[1500:]) for t in trees)
    assert ((score > 0) == (y[1500:] > 0)).mean() > 0.95


def test_token_counts(docs, empty, rows):
    got = collections.defaultdict(list)
    for r in token_counts.section_token_counts(docs.where("doc_id is not null and doc_id <> 80"), RANKS, public_tokenizers.PATTERN).collect():
        got[r.doc_id].append(r)
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for i, t in rows:
        if i is None or i == 80:
            continue
        t = t or ""
        expected, at = collections.Counter(), 0
        starts = [0] + [k + 1 for k, c in enumerate(t.encode()[:-1]) if c == 10]
        for token in enc.encode_ordinary(t):
            expected[sum(s <= at for s in starts) - 1] += 1
            at += len(enc.decode_single_token_bytes(token))
        assert {r.section: r.n_tokens for r in got[i]} == {k: expected[k] for k in range(len(starts))}
        assert sum(r.n_bytes for r in got[i]) == len(t.encode())
    assert token_counts.section_token_counts(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_counts_of_spans_and_fields(spark):
    ship(spark)
    rows = [(1, "one two three", [0, 4, 4, 13], "title", "body text é"), (2, None, None, None, "x"), (3, "a\nb", None, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edges array<long>, title string, body string")
    got = collections.defaultdict(list)
    for r in token_counts.section_token_counts(df, RANKS, public_tokenizers.PATTERN, bounds="edges").orderBy("doc_id", "section").collect():
        got[r.doc_id].append((r.n_bytes, r.n_tokens))
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    assert [b for b, _ in got[1]] == [4, 0, 9] and sum(n for _, n in got[1]) == len(enc.encode_ordinary("one two three")) and got[1][1] == (0, 0)
    assert got[2] == [(0, 0)] and [b for b, _ in got[3]] == [2, 1]
    told = {(r.doc_id, r.field): r for r in token_counts.field_token_counts(df, RANKS, public_tokenizers.PATTERN, ["title", "body"]).collect()}
    assert told[1, "title"].n_bytes == 6 and told[1, "body"].n_bytes == len("body text é".encode())
    for i, whole in ((1, "title\nbody text é"), (2, "\nx"), (3, "\n")):
        assert told[i, "title"].n_tokens + told[i, "body"].n_tokens == told[i, "body"].doc_tokens == len(enc.encode_ordinary(whole))


def test_boundary_rules():
    sizes, bounds = np.array([2, 4, 1]), np.array([0, 3, 7])
    assert token_counts.attribute(sizes, bounds, "first").tolist() == [2, 1]
    assert token_counts.attribute(sizes, bounds, "last").tolist() == [1, 2]
    assert token_counts.attribute(sizes, bounds, "most").tolist() == [1, 2]


def test_near_duplicates_judge_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a, 1), (9, a + " x", 2), (9, c, 3), (None, a, 4), (None, b, 5), (None, None, 6), (7, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert sorted(r.n for r in kept.collect()) == [1, 3, 5, 6, 7]


def test_pipeline(spark, tmp_path, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(i, t, "aa" if t else None, "s", len(t or "")) for i, t in rows if i is not None], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words_of(rows[0][1])[:12]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, names = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        names.append({r.doc_id: r for r in now.collect()})
        assert now.columns == docs.columns
    language, near, repeats, bench = names
    assert {72, 73, 74} & set(language) == set() and 79 in language
    assert 70 not in near and 71 not in near and 3 in near
    assert repeats[50].text.count("\n") == 2 and repeats[51].text.count("\n") == 1
    assert all(r.n_chars == len(r.text) for r in bench.values())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: enc.decode(r.token_ids) for r in out} == {i: r.text for i, r in bench.items()}


def test_stages_begin_with_collected_heaps(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "a b c", "en", "web", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    full = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    dict(corpus_pipeline.STAGES)["token_ids"](spark, docs, "")
    assert full() > before
