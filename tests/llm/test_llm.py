"""Small cases of every operator against brute force: nulls, empty texts, ties, repeated rows, empty tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from undertow.llm import decontaminate, exactdedup, hilbert, jaccard, langid, licenses, pieces, tokenfile, toxicity, wrapper
from undertow.llm.common import work_dir

BASE = " ".join(f"w{i}" for i in range(120))
TEXTS = [BASE, BASE, BASE.replace("w60 ", "x "), "", None, "a b", "a b", "A  b", " ".join(f"v{i}" for i in range(40)), "é ▁ \0 x" + "z" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(5, 20))), (2, "v3 v4"), (3, ""), (4, None), (5, "a b c")], "item_id long, text string")
    r = by_id(decontaminate.report(docs, items))
    assert (r[0].n_hit, r[0].n_items, r[8].n_hit, r[5].n_hit, r[4].n_words) == (15, 1, 2, 0, 0)
    full = by_id(decontaminate.decontaminate(docs, items))
    assert full[8].clean_text.startswith("v0 v1 v2  v5") and full[4].clean_text is None
    assert decontaminate.report(docs.where("false"), items).count() == 0
    assert not decontaminate.report(docs, items.where("false")).where("contaminated").count()


def brute_contamination(docs, items, window=10):
    """(doc, words, hit words, items) by looking for each window of each item at each place."""
    import re

    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[at : at + n]), set()).add(str(item))
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= own
        out.append((doc, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [500_000, 40])
def test_decontaminate_against_brute_force(spark, monkeypatch, words):
    """With one automaton and with several; repeated rows, clashing names, a very long text, short items, no items."""
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", words)
    rng = np.random.default_rng(10)
    text = lambda n, most=6: " ".join(rng.choice([f"W{i}" for i in range(most)], n))
    items = [(i, text(rng.integers(0, 30))) for i in range(12)] + [(20, "w1 é"), (21, None), (None, "w1 w2"), (20, text(12)), (22, items0 := text(15)), (23, items0)]
    docs = [(i, text(rng.integers(0, 80), 7)) for i in range(40)] + [(1, "é w1 é!"), (2, None), (2, None), (50, text(30_000, 9)), (None, items0)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_hit int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, it)
    assert got.columns[:2] == ["doc_id", "text"] and got.columns.count("n_hit") == 1
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r.hit_items)) for r in got.collect()), key=str) == brute_contamination(docs, items)
    assert decontaminate.decontaminate(df.where("false"), it).count() == 0


def brute_components(rows, k, numer, denom):
    """(n_shingles, component) by comparing all pairs of word shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and denom * len(x & sets[j]) >= numer * len(x | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    name = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted(((key, len(s), name[find(i)] if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=str)


def jaccard_rows(spark, rows, **limits):
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **limits)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def family(rng, size, edits, words=150, tag="f"):
    """A text and variants of it, each with some words replaced."""
    base = [f"{tag}{i}" for i in range(words)]
    out = []
    for v in range(size):
        w = list(base)
        for at in rng.choice(words, rng.integers(0, edits + 1), replace=False):
            w[at] = f"{tag}x{v}y{at}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limits", [{"shingle": 3, "numer": 90, "denom": 100}, {"shingle": 5, "numer": 80, "denom": 100}, {"shingle": 1, "numer": 50, "denom": 100}])
def test_jaccard_against_brute_force(spark, limits):
    """A chain, a family of many near copies (some linked, some just not), copies, short texts, nulls, a shared passage."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [*TEXTS, *family(rng, 150, 6), *family(rng, 60, 12, 400, "g")]
    texts += [" ".join(f"c{i}" for i in range(at, at + 200)) for at in range(0, 120, 4)]  # a chain
    texts += [passage + " " + " ".join(f"q{v}z{i}" for i in range(rng.integers(1, 90))) for v in range(150)]
    texts += [f"{a} {b}" for a in "xyz" for b in "xyz"] * 2
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, "another text under a known key"), (None, texts[12]), (None, "only null keys have this"), (None, "only null keys have this"), (None, None)]
    assert jaccard_rows(spark, rows, **{k: v for k, v in limits.items()}) == brute_components(rows, limits["shingle"], limits["numer"], limits["denom"])


def test_jaccard_of_blocks_over_a_tile(spark, monkeypatch):
    rows = list(enumerate(family(np.random.default_rng(6), 120, 8, 100)))
    monkeypatch.setattr(jaccard, "TILE", 7)
    assert jaccard_rows(spark, rows) == brute_components(rows, 3, 90, 100)
    assert jaccard_rows(spark, []) == []


def test_clashing_digests_get_numbers_of_their_own(spark):
    f = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 1), (5, None, None)], "key long, node long, check long")
    r = by_id(jaccard.numbered(f), "key")
    assert r[1].node == r[3].node != r[2].node and r[4].node == 8 and r[5].node is None and r[2]["first"] == 7


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 6, (300, 64))
    points[150:] = points[:150] + (rng.random((150, 64)) < 0.05)
    sizes = points.sum(axis=1)
    tree = jaccard.CountTree(points, sizes)
    assert len(tree.levels) > 1
    for p, n in zip(points, sizes):
        want = {i for i in range(300) if np.minimum(points[i], p).sum() >= jaccard.need(sizes[i], n) and 10 * min(n, sizes[i]) >= 9 * max(n, sizes[i])}
        assert set(tree.search(p, int(n)).tolist()) == want


@pytest.mark.parametrize(("numer", "denom"), [(90, 100), (80, 100), (50, 100), (100, 100)])
def test_linked_sets_share_a_part(numer, denom):
    rng = np.random.default_rng(2)
    keys = lambda x: {int(k) for b in jaccard.bands(len(x), numer, denom) for k in jaccard.part_keys(x, *b, numer, denom)}
    for n in [*range(1, 40), 57, 300, 900]:
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for swap in range(n // 2 + 1):
            t = np.unique(np.concatenate([s[swap:], rng.integers(0, 2**63, int(rng.integers(0, swap + 1))).astype(np.uint64)]))
            same = len(np.intersect1d(s, t))
            if len(t) and denom * same >= numer * (len(s) + len(t) - same):
                assert keys(s) & keys(t)


def test_points_fold_to_coarser_ones():
    s = np.random.default_rng(3).integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 40, 3000):
        raw = jaccard.point_of(s[:n])
        assert jaccard.folded(raw, n, 32).tolist() == np.bincount((s[:n] & np.uint64(31)).astype(int), minlength=32).tolist()
    many = np.zeros(70_000, np.uint64)  # counts over one and two bytes
    assert jaccard.folded(jaccard.point_of(many), len(many), 64)[0] == 70_000 and jaccard.folded(jaccard.point_of(many[:300]), 300, 32)[0] == 300


def test_exact_dedup(docs):
    r = by_id(exactdedup.exact_dedup(docs))
    assert [r[i].keep_id for i in range(10)] == [1, 1, 2, 4, 4, 6, 6, 7, 8, 9]
    assert [r[i].kept for i in range(5)] == [False, True, True, False, True] and r[5].group_size == 2


@pytest.mark.parametrize("digest", [exactdedup.sha256, lambda body: F.length(body).cast("string").cast("binary")])
def test_exact_dedup_against_brute_force(spark, digest):
    """Also with a digest that puts different texts together, with nulls, repeated rows and clashing names."""
    rows = [(i, ["a", "b", "ab", "ba", None, "", "a "][i % 7], i) for i in range(40)] + [(3, "a", 1), (3, "a", 1), (None, "a", 1), (None, "no key", 1), (None, "no key", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = exactdedup.exact_dedup(df, digest=digest)
    assert out.columns == ["doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"]
    want = []
    for k, t, _ in rows:
        same = [x for x, u, _ in rows if (u or "") == (t or "")]
        keep = max((x for x in same if x is not None), default=None)
        want.append((k, t, keep, len(same), keep is None or k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert exactdedup.exact_dedup(df.where("false")).count() == 0


def test_hilbert_index_is_a_curve(spark):
    side = 4
    cells = spark.range(side**2).select((F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    path = sorted((r[2], r[0], r[1]) for r in cells.select("x", "y", hilbert.hilbert_index([F.col("x"), F.col("y")], 2)).collect())
    assert [p[0] for p in path] == list(range(side**2))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(path, path[1:]))


def check_shards(rows, texts, shards=16, over=0.0):
    """Size, crc, gapless slots, whole groups; bytes of a shard near the mean but for ``over`` and the largest document."""
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts), key=str)
    slots, where, size = {}, {}, {}
    for r in rows:
        assert 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
        size[r.shard] = size.get(r.shard, 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, count = sum(size.values()) / shards, {}
    for _, t in texts:
        count[t or ""] = count.get(t or "", 0) + len((t or "").encode()) + 1
    for t, b in count.items():
        assert b > mean or len(where[zlib.crc32(t.encode()), len(t.encode()) + 1]) == 1
    longest = max(len((t or "").encode()) + 1 for _, t in texts)
    assert all(abs(b - mean) <= over * mean + 2 * longest + 0.02 * mean for b in size.values())
    return size


def shards_of(spark, rows, **kw):
    return hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), **kw)


def test_hilbert_shards_keep_equal_texts_and_even_bytes(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["a", "bb", "ccc"], rng.integers(1, 40))) + str(i) for i in range(2000)]
    texts += ["three equal texts of some length " * 30] * 3 + ["many equal short texts"] * 90 + [None, "", None]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 7}") for i, t in enumerate(texts)]
    check_shards(shards_of(spark, rows).collect(), [(r[0], r[1]) for r in rows])


def test_hilbert_shards_of_hot_groups_repeats_and_no_rows(spark):
    rows = [(i % 50, "hot text that fills many shards", "en", "s") for i in range(900)] + [(None, "x", None, None), (None, "x", None, None), (1, "y" * 400, "de", "s")]
    size = check_shards(shards_of(spark, rows).collect(), [(r[0], r[1]) for r in rows])
    assert len(size) == 16
    assert shards_of(spark, []).count() == 0
    few = shards_of(spark, [(1, "a", "en", "s"), (2, "a", "en", "s"), (3, "b", "de", "t")], shards=2).collect()
    assert len(few) == 3 and all(sorted(r.slot for r in few if r.shard == k) == list(range(sum(r.shard == k for r in few))) for k in (0, 1))


def test_shards_are_skipped_by_the_ranges_of_their_cells(spark):
    rows = [(i, f"text {i} " + "w " * (i % 97), ["en", "de", "fr", "es"][i % 4], f"src{i % 9}") for i in range(3000)]
    out = shards_of(spark, rows)
    ranges, cells = hilbert.shard_ranges(out).collect(), out.select("cell0", "cell1", "cell2").distinct().collect()
    for c in ("cell0", "cell1", "cell2"):
        values = {r[c] for r in cells}
        read = sum(r[f"{c}_min"] <= v <= r[f"{c}_max"] for v in values for r in ranges)
        assert read < 0.8 * len(values) * len(ranges), (c, read)


def licence_rows(spark, rows):
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    return [(r.doc_id, r) for r in out.collect()]


def test_licenses(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. MIT License; mit-license."
    r = dict(licence_rows(spark, [(1, text), (2, None), (3, ""), (4, "GNU general public license"), (None, "apache license")]))
    assert (r[1].n_base, r[1].base_labels, r[1].labels, r[1].first_word) == (2, "mit", "mit", 20)
    assert (r[2].n_words, r[2].labels, r[4].base_labels, r[None].labels) == (0, "", "gpl", "apache")
    assert licence_rows(spark, []) == []


def test_licence_base_columns_against_brute_force(spark):
    import re

    rng, words = np.random.default_rng(8), ["mit", "license", "License,", "apache", "general", "public", "PUBLIC", "gnu", "the", "é", "licence", "\n", "-", "under"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(300)]
    rows += [(7, "mit license again"), (8, rows[8][1]), (9, None)]
    got = sorted((k, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for k, r in licence_rows(spark, rows))
    want = []
    for key, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((key, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_licence_texts_are_told_apart_and_apart_from_prose(spark):
    full = [t for _, _, t in licenses.TEMPLATES]
    label = [x for x, _, _ in licenses.TEMPLATES]
    rows = [(i, f"Some words before. {t}\nand after") for i, t in enumerate(full)]
    rows += [(100, " some words between ".join(full)), (101, "the software is provided with a permission notice and the following conditions of use"), (102, "Licensed under CC BY-NC 4.0."), (103, "licensed for all by nc and cc 4 0 under")]
    mit = full[0].split()
    rows += [(104, " ".join(mit[40:])), (105, " ".join(w for i, w in enumerate(mit) if i % 6 or i < 40)), (106, " ".join(mit[::2]))]
    r = dict(licence_rows(spark, rows))
    own = {"gpl"}  # the base phrase stands in the lesser and the affero licences too
    for i in range(len(full)):
        assert set(r[i].labels.split(",")) - own == {label[i]} - own and r[i].score == 1.0, (i, r[i])
    assert r[100].labels == ",".join(sorted(set(label))) and r[101].labels == r[103].labels == r[104].labels == r[106].labels == ""
    assert r[102].labels == "cc-by-nc" and r[105].labels == "mit"


def piece_model():
    return pieces.Pieces(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())


def plain_viterbi(p, text):
    """Ids of the best path over the whole text by trying all pieces at all positions."""
    marked = pieces.SPACE + text.replace(pieces.SPACE, "\0").replace(" ", pieces.SPACE)
    best, back = [0.0], [None]
    for end in range(1, len(marked) + 1):
        ways = [(best[end - 1] + p.unknown, -1, end - 1, None)]
        for start in range(max(0, end - 16), end):
            if (hit := p.scores.get(marked[start:end])) is not None:
                ways.append((best[start] + hit[1], end - start, start, hit[0]))
        score, _, start, i = max(ways, key=lambda w: (w[0], w[1]))
        best.append(score), back.append((start, i))
    ids, at = [], len(marked)
    while at:
        start, i = back[at]
        ids += [i] if i is not None else [p.byte_ids[x] for x in reversed((pieces.SPACE if marked[start] == "\0" else marked[start]).encode())]
        at = start
    return ids[::-1] if text else []


ODD_TEXTS = ["", " a  b ", "x", "\u2581 é①\n\t", "Hello, world; it_(is) »so,«", " " * 20, "z" * 300, "in  the\nmiddle.Of it", "日本語 text", "😀😀"]


def test_pieces_best_path_and_round_trip():
    p, rng = piece_model(), np.random.default_rng(4)
    signs = ["a", "b", "the", " ", "  ", ".", ",", "(", "_", "»", "é", "1", "\n", "\t", "\u2581", "😀", "Z", "'", "-", "ing"]
    texts = [*ODD_TEXTS, *("".join(rng.choice(signs, rng.integers(1, 90))) for _ in range(200))]
    values, counts = p.encode([t.encode() for t in texts])
    own = [x.tolist() for x in np.split(values, np.cumsum(counts)[:-1])]
    assert own == [plain_viterbi(p, t) for t in texts]
    assert p.decode(values, counts) == texts
    values, counts = p.encode([b"\0x\0", None, b"\0"])
    assert p.decode(values, counts) == ["\0x\0", "", "\0"] and counts[1] == 0


def test_encode_and_decode_pieces(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, t, 0, 0) for i, t in enumerate(ODD_TEXTS)] + [(0, "repeated", 1, 1), (0, "repeated", 1, 1), (None, None, 2, 2), (9, "w " * 30_000, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids int, decoded int")
    encoded = pieces.encode_pieces(docs, model)
    assert encoded.columns == ["doc_id", "text", "decoded", "piece_ids", "piece_ids_n"]
    back = pieces.decode_pieces(encoded, model).collect()
    assert len(back) == len(rows) and all(r.decoded == (r.text or "") and r.piece_ids_n == len(r.piece_ids) for r in back)
    assert pieces.report(docs.where("false"), model).count() == 0
    assert all(r.round_trip for r in pieces.report(docs, model).collect())
    lists = spark.createDataFrame([(1, None), (2, []), (3, [1, 2, -5, 99_999]), (4, [None])], "doc_id long, piece_ids array<int>")
    assert [r.decoded for r in pieces.decode_pieces(lists, model).orderBy("doc_id").collect()] == [None, "", "", ""]


def test_token_files(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    cat = tokenfile.write_token_files(docs, path, work_dir(spark, "t"), end_id=2, vocab=49_408)
    r = by_id(tokenfile.read_token_files(cat), "key")
    start, tok = 0, Tokenizer.from_file(path)
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r[i].start, r[i].n_tokens, r[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    found = by_id(tokenfile.lookup(cat, spark.createDataFrame([(5,), (999,)], "doc_id long")), "key")
    assert list(found) == [5] and found[5].ids[-1] == 2


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    assert sorted(tokenfile.PerfectHash.build(keys).slots(keys)) == list(range(len(keys)))


def test_word_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), np.random.default_rng(5)
    tok, own = Tokenizer.from_file(path), tokenfile.WordTokens(path, 2)
    signs = ["a", "b", "the", " ", "  ", ".", ",", "'s", "'t", "'", "_", "»", "É", "e\u0301", "1", "²", "\n", "▁", "😀", "Z", "ß", "Σ", "-", "İ", "\xa0", "\x85", "K", "ж", "中", "<|", "<|endoftext|>"]
    texts = ["It's DONE., (ok), don't!", "a.'s b)., É́ ç!\n\nX", "<|endoftext|>, x <|EndOfText|>", "1.5, 2;", " a\tb, c", ""]
    texts += ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(1500)]
    for t, ids in zip(texts, own.encode([t.encode() for t in texts])):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_token_files_with_repeated_and_null_keys_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 12)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "no key"), (None, None), *[(5, f"five again {i}") for i in range(6)], (7, "seven"), (-3, "minus three words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cat = tokenfile.write_token_files(docs, path, work_dir(spark, "t"), end_id=2, vocab=49_408)
    assert cat.count() > 4
    got = tokenfile.read_token_files(cat).orderBy("start").collect()
    assert [r.key for r in got] == [None, None, -3, *[5] * 6, 7]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    found = tokenfile.lookup(cat, spark.createDataFrame([(5,), (5,), (7,), (6,), (None,)], "doc_id long")).collect()
    assert sorted(r.key for r in found) == [*[5] * 6, 7] and len({tuple(r.ids) for r in found}) == 7
    assert tokenfile.report(docs.where("false"), path).count() == 0


def test_languages(spark):
    rows = [(i, f"the and of to {i} with" if i % 2 else f"der und die das {i} mit", "en" if i % 2 else "de") for i in range(80)]
    docs = spark.createDataFrame([*rows, (90, None, None), (91, "123 !", "en")], "doc_id long, text string, lang string")
    r = by_id(langid.report(docs))
    assert all(r[i].lang_pred == ("en" if i % 2 else "de") for i in range(80)) and r[90].lang_pred == r[91].lang_pred == "und"
    assert langid.report(docs.where("false")).count() == 0


def test_languages_of_a_family_are_told_pair_by_pair():
    rng = np.random.default_rng(3)
    place = {"en": -1.0, "de": 0.0, "nl": 1.0}  # in a line: the middle one is between the others
    rows = []
    for lang, at in place.items():
        for _ in range(60):
            v = np.zeros(langid.DIM, np.float32)
            v[:2] = at + rng.normal(0, 0.1), 0.2
            rows.append((v, lang))
    model = langid.train(rows)
    x, y = np.stack([np.append(v, np.float32(1)) for v, _ in rows]), [lang for _, lang in rows]
    assert model.families == [[0, 1, 2]] and model.within[0].shape == (3, langid.DIM + 1)
    assert [model.langs[langid.vote(model.within[0] @ v, 3)[0]] for v in x] == y
    assert langid.vote(np.array([0.2, -0.5, 0.1]), 3)[0] == 2  # one vote each: by the sums


def test_every_language_is_learnt(spark):
    langs = [f"x{i:03d}" for i in range(120)]
    rows = [(len(langs) * k + i, " ".join(chr(0x4E00 + 40 * i + (k + j) % 40) * 2 for j in range(8)), lang) for i, lang in enumerate(langs) for k in range(3)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == langs


def test_toxicity(spark):
    rows = [(i, f"word{i} some text here " + ("you idiot" if i % 4 == 0 else "my friend")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    r = by_id(toxicity.report(docs, labels))
    assert all(r[i].predicted == int(i % 4 == 0) for i in range(400)) and 0 <= r[900].score <= 1


def test_toxicity_settings_over_folds(spark):
    texts = [(i, f"vile rotten word{i}" if i % 4 == 0 else f"plain kind word{i}") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    tried = toxicity.cross_validate(docs, labels, [toxicity.Settings(), toxicity.Settings(l1=1000.0)]).collect()
    fits, stiff = sorted(tried, key=lambda r: r.l1)
    assert (fits.rows, stiff.rows) == (200, 200)
    assert (fits.precision, fits.recall) == (1.0, 1.0)
    assert fits.log_loss < stiff.log_loss


def test_wrapper(spark):
    page = "<html><head><title>t</title></head><body><nav><a>Menu</a></nav><div>Always here</div>{}<footer>f</footer></body></html>"
    rows = [(i, "http://h/x", page.format(f"<div><p>Story {i} &amp; <b>mo{i}</b>re{i}<p>end{i}</div>")) for i in range(12)]
    rows += [(20, "http://k/", page.format("<article><h1>T</h1><p>x\n y<br>z</p><div class='comments'>no</div><script>var a='</p>'</script></article>")), (21, None, None), (22, "", "")]
    r = by_id(wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert r[3].text == "Story 3 & mo3re3 end3" and r[20].text == "T x y z" and (r[21].text, r[22].n_chars) == ("", 0)


def article_pages(spark, rows):
    return by_id(wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")


def test_wrapper_template_tells_slots_without_any_mark(spark):
    """Plain divs: what repeats over the host's articles goes, some variants of it too; what varies stays."""
    page = "<html><body><div>Our site <b>today</b></div><div>{}</div><div>{}</div><div>Write to us</div></body></html>"
    rows = [(i, "http://plain/x", page.format(f"Tip {i % 3}", "".join(f"<p>Story {i} part {k}</p>" for k in range(1 + i % 4)))) for i in range(30)]
    r = article_pages(spark, rows)
    assert all(r[i].text == " ".join(f"Story {i} part {k}" for k in range(1 + i % 4)) for i in range(30))


def test_wrapper_near_copies_are_no_template(spark):
    page = "<html><body><div><p>One long story</p><p>its middle {}</p><p>its end</p></div></body></html>"
    r = article_pages(spark, [(i, "http://near/x", page.format("new" if i == 3 else "old")) for i in range(20)])
    assert all(r[i].text.endswith("its end") and r[i].text.startswith("One long story its middle") for i in range(20))


def test_wrapper_keeps_all_of_the_article(spark):
    inside = [
        '<p title="the hidden truth">one</p>', '<section class="legal">two</section>', '<p class="share-prices">three</p>', "<math><mi>x</mi></math> four",
        '<p data-id="comments" aria-label="ad">five</p>', "<P>six &#233;&nbsp;&lt;b&gt;", "<pre>a\n  b</pre>",
    ]
    outside = ['<div class="comment-list">no</div>', '<p hidden>no</p>', '<div id="cookie-banner">no</div>', "<aside>no</aside>", '<form>no</form>', '<div style="display: none">no</div>', "<script>no</script>", "<!-- no -->"]
    rows = [(1, "http://a/1", f"<body><main><article>{''.join(inside + outside)}</article><article><p>a longer second article of the page</article></main>")]
    rows += [(2, "http://a/2", "<div>" * 20_000 + "deep" + "</div>" * 20_000), (3, "http://a/3", "x" + "<b" * 50_000), (5, "http://a/5", "<p>shown</p><!-- a > b"), (6, "http://a/6", "<p>shown</p><script>a > b"), (4, None, "no markup"), (4, None, "no markup"), (None, "x", "<p>p</p>")]
    r = article_pages(spark, rows)
    assert r[1].text == "one two three x four five six é <b> a b a longer second article of the page"
    assert r[5].text == r[6].text == "shown" and r[3].n_chars == 100_001
    assert r[2].text == "deep" and r[4].text == "no markup" and r[None].text == "p"
    assert article_pages(spark, []) == {}
    twice = wrapper.extract(spark.createDataFrame(rows[-3:], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2)))
    assert twice.columns == ["page_id", "url", "html", "host", "text", "n_chars"] and twice.count() == 3


def brute_matching(a, b):
    """Simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_matching(x, y))
    return 1 + m[-1][-1]


def test_shapes_weigh_as_simple_tree_matching():
    rng = np.random.default_rng(7)

    def tree(deep):
        return ("abc"[rng.integers(3)], [tree(deep - 1) for _ in range(rng.integers(0, 4))] if deep else [])

    shapes = wrapper.Shapes()
    number = lambda t: shapes.number(t[0], tuple(number(c) for c in t[1]))
    for _ in range(300):
        a, b = ("r", tree(3)[1]), ("r", tree(3)[1])
        assert shapes.weight(number(a), number(b)) == brute_matching(a, b)


def test_templates_do_not_depend_on_the_order_of_tasks():
    pages = [wrapper.parse("<div>" + "".join(f"<p>{i} {k}</p>" for k in range(1 + i % 3)) + "</div><i>same</i>") for i in range(6)]
    shapes, trees = wrapper.Shapes(), []
    for i, p in enumerate(pages):
        trees.append(wrapper.as_template(p, i))
        wrapper.numbered(trees[-1], shapes)
    dump = wrapper.dumped(wrapper.loaded(wrapper.dumped(trees[2])))
    assert dump == wrapper.dumped(trees[2])
    t = trees[0]
    for u in trees[1:]:
        t = wrapper.merge(t, u, shapes)
    assert [c.sig for c in t.children] == ["div", "i"] and len(t.children[0].children) == 3 and len(t.children[1].children[0].sample) == 6


def test_wrapper_copies_and_split_articles(spark):
    page = "<html><body><nav>Menu</nav><div>Always here</div>{}<footer>f</footer></body></html>"
    rows = [(i, "http://copies/x", page.format("<div><p>One story</p><p>its end</p></div>")) for i in range(12)]
    rows += [(20 + i, "http://few/x", page.format(f"<div><p>Story {i}</p></div>")) for i in range(5)]
    split = "<article><p>First part</p></article><div class='ad'><article>Buy</article></div><article><p>A second and longer part</p></article>"
    rows += [(30, "http://split/x", page.format(split)), (31, "http://parts/x", page.format("<div itemprop='articleBody'>One</div><aside>no</aside><div itemprop='articleBody'>Two two</div>"))]
    r = by_id(wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert all(r[i].text == "Always here One story its end" for i in range(12))
    assert [r[20 + i].text for i in range(5)] == [f"Story {i}" for i in range(5)]
    assert (r[30].text, r[31].text) == ("First part A second and longer part", "One Two two")


def test_wrapper_template_of_pages_with_ids_of_their_own(spark):
    """No mark tells the parts; ids and numbered classes differ from page to page, and so do numbers of paragraphs."""
    rows = []
    for i in range(400):
        own = "".join(f"<p id='p{i}-{k}'>Article {i} says {k} {'xyz'[k % 3] * (i % 7)}</p>" for k in range(1 + i % 4))
        rows.append((i, f"http://h/{i}", f"<div class='c{i}'>Site menu</div><div id='post-{i}' class='post item-{i}'>{own}<p>Read our terms here</p></div><div>Foot line</div>"))
    r = by_id(wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)), "page_id")
    for i in range(400):
        assert r[i].text == " ".join(" ".join(f"Article {i} says {k} {'xyz'[k % 3] * (i % 7)}".split()) for k in range(1 + i % 4))


def test_wrapper_slots_are_told_by_all_articles(spark):
    """A line that is the same on the articles of the 140 least digests, and another on each of 260 others, is content."""
    import zlib

    lines, same = [], 0
    for i in range(400):
        tries = ["Same line", *(f"Line {i} {k}" for k in range(1000))][0 if same < 140 else 1 :]
        line = next(x for x in tries if (zlib.crc32(f"{x} Story {i} Foot".encode()) < 1 << 31) == (x == "Same line"))
        lines, same = [*lines, line], same + (line == "Same line")
    assert same == 140
    page = "<html><body><div>{}</div><div><p>Story {}</p></div><i>Foot</i><script 'a>raw</script></body></html>"
    r = article_pages(spark, [(i, "http://all/x", page.format(x, i)) for i, x in enumerate(lines)])
    assert [r[i].text for i in range(400)] == [f"{x} Story {i}" for i, x in enumerate(lines)]


def test_wrapper_reads_each_page_once(spark, tmp_path, monkeypatch):
    """One plan has the pages' html: templates, slots and texts follow from what it has made of it."""
    page = "<html><body><div>Our site</div><div><p>Story {}</p></div><i>Foot</i></body></html>"
    rows = [(i, "http://once/x", page.format(i)) for i in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, raw_markup string").write.parquet(str(tmp_path / "pages"))
    plans, write = [], wrapper.written
    monkeypatch.setattr(wrapper, "written", lambda df, name: plans.append(df) or write(df, name))
    plans.append(wrapper.extract(spark.read.parquet(str(tmp_path / "pages")), html="raw_markup", columns=["page_id"]))
    assert [by_id(plans[-1], "page_id")[i].text for i in range(30)] == [f"Story {i}" for i in range(30)]
    assert sum("raw_markup" in x._jdf.queryExecution().optimizedPlan().toString() for x in plans) == 1


def test_wrapper_pages_of_one_layout():
    """Layouts are shared by pages that differ in texts, links and ids; what is remembered of slots is what is found anew."""
    rng = np.random.default_rng(5)
    shapes = wrapper.Shapes()
    trees, pages = wrapper.Trees(shapes), []
    for i in range(300):
        own = "".join(f"<p id='p{i}'>{rng.integers(9)} &amp; <a href='/{i}'>{k}</a>" for k in range(rng.integers(1, 5)))
        page = f"<div>menu</div><article>{own}<p>{'foot' if rng.random() < 0.7 else i}</article><!-- {i} --><p>{['last', 'other'][rng.integers(2)]}"
        found, texts, digests = wrapper.tokens(page)
        layout = shapes.layout(found)
        assert len(found) > len(texts) == len(layout.texts)
        trees.add("h", layout, i, digests)
        pages.append((layout.code, texts, digests))
    assert len(shapes.layouts) == 4
    assert trees.held["h"].n == len(trees.held["h"].sample) == wrapper.SAMPLE and sum(n for n, _ in trees.known["h"].values()) == 300 - wrapper.SAMPLE
    (host,), (text,), (n,) = trees.out()
    assert (host, n) == ("h", 300)
    template = shapes.template(wrapper.dumped(wrapper.settled(wrapper.loaded(text))))
    for code, texts, digests in pages:
        read = shapes.read(code)
        slots = read.slots(template, digests, shapes)
        assert slots == wrapper.slots_of(read.root, template, shapes, digests, []) and min(slots) >= 0
        assert read.text(texts) == wrapper.clean(" ".join(texts[1:-1]))
    assert any(read.met for read in shapes.reads.values()) and len(shapes.reads) == 4


def test_wrapper_templates_stay_small_and_fast():
    import time

    shapes, t, began = wrapper.Shapes(), None, time.process_time()
    for i in range(700):
        page = wrapper.parse("<div>menu</div>" + "".join(f"<div class='{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}'><p>text {i} {k}</p></div>" for k in range(6)) + "<i>foot</i>")
        u = wrapper.as_template(page, i * 7919 % 10007)
        wrapper.numbered(u, shapes)
        t = u if t is None else wrapper.merge(t, u, shapes)
    assert wrapper.numbered(t, shapes) <= wrapper.NODES + 20 and time.process_time() - began < 60


def test_wrapper_matches_deep_trees_without_a_limit():
    deep = lambda n, end: wrapper.parse("<div>" * n + end + "</div>" * n)
    shapes = wrapper.Shapes()
    a, b = (wrapper.as_template(p, 1) for p in (deep(3000, "<p>x</p>"), deep(3000, "<p>x</p><b>y</b>")))
    wrapper.numbered(a, shapes), wrapper.numbered(b, shapes)
    assert shapes.weight(a.shape, b.shape) == 1 + 3000 + 2


def test_licenses_of_full_texts_names_and_tags(spark):
    cases = {
        'Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n 1. Definitions. "License" shall mean the terms': "apache",
        "CC0 1.0 Universal Public Domain Dedication": "cc0", "// SPDX-License-Identifier: MIT": "mit", "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl", "Eclipse Public License - v 2.0": "epl",
        "under Creative Commons Attribution 3.0 Unported": "cc-by", "Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa", "Licensed under CC BY-NC-ND 4.0": "cc-by-nc-nd",
        "CC BY-NC 4.0 and CC BY 2.5": "cc-by,cc-by-nc", "attribution 4.0 cc by nc spdx identifier license mit": "", "\u212airk wor\u212a cc by 4.0": "cc-by",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases
