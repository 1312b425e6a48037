"""Vector codes, the prefix trie and the byte network against brute force on small cases."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.llm import bytecnn, prefixtrie, vectorcodes

VECTORS = "vec_id long, embedding array<float>, label int"


def lloyd(x, parts, entries, rounds):
    """x: rows of integers in order of their keys. Codes, errors, codebooks."""
    x = x.reshape(len(x), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = ((x[:, :, None] - book[None]) ** 2).sum(-1)
        at = far.argmin(-1)
        for p in range(parts if turn < rounds else 0):
            for e in range(book.shape[1]):
                if (own := x[at[:, p] == e, p]).size:
                    book[p, e] = own.sum(0) // len(own)
    return at, far.min(-1).sum(1), book


def test_codes_equal_plain_lloyd_with_hot_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate((rng.normal(0, 0.2, (150, 16)), np.repeat(rng.normal(0, 0.2, (1, 16)), 150, 0), rng.normal(0.5, 0.1, (60, 16)))).astype(np.float32)
    rows = [(i * 3, [float(v) for v in row], None if i % 5 == 0 else i % 3) for i, row in enumerate(values)]
    bad = [(1, None, 1), (2, [0.1, None] + [0.0] * 14, 1), (4, [float("nan")] + [0.0] * 15, 1), (5, [float("inf")] + [0.0] * 15, 1), (7, [0.1] * 9, 1), (8, [], 1)]
    table = spark.createDataFrame(rows + bad, VECTORS).withColumns({"code": F.lit("own"), "error": F.lit(1)}).repartition(5)
    at, error, book = lloyd(np.floor(values.astype(float) * 4096).astype(np.int64), 8, 16, 6)
    got = {r.vec_id: r for r in vectorcodes.report(table).collect()}
    assert sorted(got) == [r[0] for r in rows]
    by_label = {}
    for (_, _, label), e in zip(rows, error):
        by_label[label] = by_label.get(label, 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, book.ravel())).encode()).hexdigest()
    for i, (key, _, label) in enumerate(rows):
        r = got[key]
        assert (r.code, r.error, r.label_error, r.codebooks_sha256) == ("".join(f"{e:02x}" for e in at[i]), error[i], by_label[label], sha)


def test_codes_of_few_repeated_and_no_vectors(spark):
    few = spark.createDataFrame([(5, [1.0] * 8, 1), (5, [1.0] * 8, 1), (None, [0.0] * 8, None)], VECTORS)
    got = vectorcodes.report(few).collect()
    assert sorted(r.code for r in got) == ["00" * 8, "00" * 8, "02" * 8] and all(r.error == 0 and r.label_error == 0 for r in got)
    assert vectorcodes.report(few.where("false")).count() == 0 and vectorcodes.report(few.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"), "label")).count() == 0


def test_a_code_names_the_integers_that_its_error_is_from(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(0, 0.3, 10)], 0) for i in range(40)]  # 10 components: 8 parts of 2, filled up
    table = spark.createDataFrame(rows, VECTORS)
    model = vectorcodes.fit_codebooks(table, entries=4, rounds=2)
    assert model[1].shape == (8, 4, 2)
    for r in vectorcodes.decode(vectorcodes.encode(table, model), model).collect():
        whole = np.floor(np.array(r.embedding, np.float64) * 4096)
        assert len(r.decoded) == 10 and ((whole - np.array(r.decoded)) ** 2).sum() == r.error
    huge = spark.createDataFrame([(1, [3e38, -3e38] + [0.0] * 6, 0), (2, [0.0] * 8, 0)], VECTORS)
    assert {r.error for r in vectorcodes.report(huge).collect()} == {0}


def trie(rows):
    """All columns by their definitions; rows are (conv, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), tie, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for k, members in nodes.items():
        below = [n for n in nodes if n[: len(k)] == k]
        kids = lambda n: [m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(k))))
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")) - (len(nodes[n]) - 1) * n[-1][1].translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ").count("") for n in below if n)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids(k)), sum(not kids(n) for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.fixture
def small_blocks(monkeypatch):
    """Strides of 2 blocks and chunks of 4 numbers, so that few turns span several of each."""
    monkeypatch.setattr(prefixtrie, "STRIDE", 2)
    monkeypatch.setattr(prefixtrie, "CHUNK_BITS", 2)


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_equals_brute_force(spark, small_blocks):
    rng = np.random.default_rng(11)
    rows = []
    for c in [*range(0, 45), -3, -20, -45, 100, 107]:
        n = int(rng.integers(0, 7)) if c % 9 else int(rng.integers(15, 45))
        for turn in range(n):
            text = "same words in all" if turn < 9 + c % 3 else f"{rng.integers(0, 2)} \t x\n\x0by" if turn < 30 else str(c)
            rows.append((c, None if c == 6 and turn == 3 else turn, None if turn == 2 else ["user", "assistant"][turn % 2], None if turn == 4 else text))
    rows += [(7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (8, 2, "", "u:x"), (8, 2, "u", ":x"), (None, 1, "user", "nobody")]
    table = spark.createDataFrame(rows, TURNS).withColumn("c", F.lit("clash")).repartition(7)
    assert told(prefixtrie.report(table)) == trie(rows)


def test_trie_of_a_hot_conversation_and_of_copies(spark, small_blocks):
    rows = [(1, t, "user", f"turn {t}") for t in range(150)] + [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(3)]
    assert told(prefixtrie.report(spark.createDataFrame(rows, TURNS).repartition(9))) == trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefixtrie.report(empty).count() == 0
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)  # its only turn goes, and conversation 0 isn't there
    assert told(prefixtrie.report(spark.createDataFrame([(c, 0, "user", "x")], TURNS))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows = []
    for i in range(n):
        own = [str(w) for w in rng.choice(words, int(rng.integers(20, 200)))]
        rows.append((i, " ".join(own if i % 4 else [w + rng.choice(["%%%", "$$$", "!!"]) for w in own]), int(i % 4 > 0)))
    return rows


def test_network_gradient_is_that_of_its_loss():
    p = {k: v.astype(np.float64) for k, v in bytecnn.start(3).items()}
    p = {k: v + np.random.default_rng(1).normal(0, 0.05, v.shape) for k, v in p.items()}
    text = b"some bytes! " * 70
    loss = lambda q: float(bytecnn.forward(bytecnn.Filters(q["filters"]).halves(text)[0], q)["logit"])
    halves, at, x = bytecnn.Filters(p["filters"]).halves(text, True)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    bytecnn.backward(bytecnn.forward(halves, p), at, x, 1.0, p, g)
    rng = np.random.default_rng(2)
    for k in p:
        for _ in range(6):
            i = tuple(int(rng.integers(0, n)) for n in p[k].shape) if k != "filters" else (int(rng.integers(0, 6)), text[int(rng.integers(0, 12))], int(rng.integers(0, 16)))
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-4)


def test_network_reads_every_byte_of_a_long_text():
    rng = np.random.default_rng(5)
    filters = rng.normal(0, 1, bytecnn.SHAPES["filters"]).astype(np.float32)
    for n in (0, 1, 5, 255, 256, 257, 700):
        text = bytes(rng.integers(1, 255, n, dtype=np.uint8))
        x = (text or b"\0") + b"\0" * 6
        answers = np.array([sum(filters[w, x[i + w]] for w in range(6)) for i in range(max(n, 1))])
        want = [answers[i : i + 256].max(0) for i in range(0, len(answers), 256)]
        assert np.allclose(bytecnn.Filters(filters).halves(text)[0], want, atol=1e-5)
    tables = bytecnn.Filters(filters)
    long = bytes(rng.integers(1, 255, 3 * bytecnn.SLICE // 2, dtype=np.uint8))
    top, at, _ = tables.halves(long, True)
    assert len(top) == -(-len(long) // 256) and all(a // 256 == i for i, row in enumerate(at) for a in row)
    assert np.allclose(top[600], tables.halves(long[600 * 256 : 601 * 256 + 5])[0][0], atol=1e-5)


def test_quality_on_held_out_rows_and_edges(spark):
    rows = texts(900)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(2000, "", "x", 0.5), (2001, None, "x", 0.5), (2002, rows[4][1], "x", 0.5), (None, "a b", "x", 0.5)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(1, 0, 0), (None, 1, 0), (3000, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in bytecnn.report(docs, labels).collect()}
    assert len(got) == 904 and got[2000].score == got[2001].score and got[2002].score == got[4].score and not got[None].held_out
    held = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert len(held) > 120 and sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in bytecnn.report(docs, none).collect()} == {0.5}
    assert bytecnn.report(docs.where("false"), none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in bytecnn.report(docs, one).collect())
    told = bytecnn.score_quality(docs.withColumn("score", F.lit("own")), None)
    assert told.columns == ["doc_id", "text", "score"] and dict(told.dtypes)["score"] == "double"
